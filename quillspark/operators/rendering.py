"""Texts built from tables, paragraphs and groups: contexts, retrieval texts, memory blocks."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table_text(table: Column, most_rows: int = 80) -> Column:
    """Rows as ``a | b | c`` lines; what is cut off is said in a last line."""
    lines = F.transform(F.slice(table, 1, most_rows), lambda r: F.array_join(r, " | "))
    return F.concat(F.array_join(lines, "\n"), F.when(F.size(table) > most_rows, F.concat(F.lit("\n... "), (F.size(table) - most_rows).cast("string"), F.lit(" more rows"))).otherwise(F.lit("")))


def context_text(pre: Column, table: Column, post: Column, most_chars: int = 800) -> Column:
    """Paragraphs cut at ``most_chars``, then the table, then the rest; empty parts leave no line."""
    cut = lambda a: F.array_join(F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.when(F.length(x) > most_chars, F.concat(F.left(x, F.lit(most_chars)), F.lit("..."))).otherwise(x)), "\n")
    part = lambda name, x: F.when(F.length(F.coalesce(x, F.lit(""))) > 0, F.concat(F.lit(f"{name}:\n"), x))
    return F.concat_ws("\n\n", part("TEXT", cut(pre)), part("TABLE", table_text(table)), part("MORE", cut(post)))


def variants(df: DataFrame, **texts: Column) -> DataFrame:
    """One row a variant of a retrieval text."""
    return df.withColumn("_v", F.explode(F.array(*(F.struct(F.lit(k).alias("variant"), v.alias("text")) for k, v in texts.items())))).select(*df.columns, "_v.*")


def groups(df: DataFrame, key: str, position: str, most_ids: int = 30) -> DataFrame:
    """Support, first member and the first ids of each group. Ids are ranked before they are gathered, so a group sends ``most_ids`` at most."""
    from pyspark.sql import Window as W

    r = df.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(position)))
    head = r.where(F.col("_r") <= most_ids).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", position))), lambda s: s[position]).alias("ids"))
    return df.groupBy(key).agg(F.count("*").alias("support"), F.min(position).alias("prototype")).join(head, key)


def memory_block(arm: Column, cases: Column, strategies: Column) -> Column:
    """The memory part of a prompt: cases, strategies, both or nothing, by arm."""
    c, s = F.concat(F.lit("CASES:\n"), cases), F.concat(F.lit("STRATEGIES:\n"), strategies)
    return F.when(arm == "case", c).when(arm == "strategy", s).when(arm == "both", F.concat_ws("\n\n", c, s)).otherwise("")


def case_record(**fields: Column) -> Column:
    """A case as canonical JSON: fields in the order of the alphabet, nulls left out."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))))


#: How a rule-based strategy speaks of each operator.
STEP_TEXT = {"add": "add the two amounts", "subtract": "subtract the second amount from the first", "multiply": "multiply the two amounts", "divide": "divide the first amount by the second", "exp": "raise the first amount to the second", "greater": "compare the two amounts", "table_max": "take the largest cell of the row", "table_min": "take the smallest cell of the row", "table_sum": "sum the cells of the row", "table_average": "average the cells of the row"}


def strategy_text(ops: Column) -> Column:
    """A strategy from operators alone: numbered steps, each in fixed words; results of earlier steps are carried on."""
    words = F.create_map(*(F.lit(v) for kv in STEP_TEXT.items() for v in kv))
    step = lambda o, i: F.concat(F.lit("Step "), (i + 1).cast("string"), F.lit(": "), F.coalesce(F.try_element_at(words, o), F.concat(F.lit("apply "), o)), F.when(i > 0, " using the result so far").otherwise(""), F.lit("."))
    return F.array_join(F.transform(ops, step), " ")


def numeric_features(question: Column, table: Column, program: Column) -> Column:
    """Map of 20 numbers that describe a record without its answer."""
    low = F.lower(question)
    count = lambda form: F.regexp_count(low, F.lit(form)).cast("double")
    rows = F.size(table).cast("double")
    cells = F.aggregate(F.transform(table, F.size), F.lit(0), lambda a, v: a + v).cast("double")
    numbers = F.aggregate(F.transform(table, lambda r: F.size(F.filter(r, lambda c: c.rlike("[0-9]")))), F.lit(0), lambda a, v: a + v).cast("double")
    ops = F.regexp_count(program, F.lit(r"[a-z_]+\(")).cast("double")
    named = {
        "q_chars": F.length(question).cast("double"), "q_words": count(r"\S+"), "q_numbers": count("[0-9]+"), "q_years": count(r"\b(?:19|20)[0-9]{2}\b"), "q_percent": count("percent|%"),
        "q_change": count("change|increase|decrease|growth"), "q_average": count("average|mean"), "q_total": count("total|sum"), "q_compare": count("more|less|greater|than"), "q_ratio": count("ratio|share|portion"),
        "t_rows": rows, "t_cells": cells, "t_numbers": numbers, "t_number_share": F.coalesce(F.try_divide(numbers, cells), F.lit(0.0)), "t_width": F.coalesce(F.try_divide(cells, rows), F.lit(0.0)),
        "p_steps": ops, "p_constants": F.regexp_count(program, F.lit("const_")).cast("double"), "p_references": F.regexp_count(program, F.lit("#[0-9]+")).cast("double"), "p_table": F.regexp_count(program, F.lit("table_")).cast("double"), "p_chars": F.length(program).cast("double"),
    }
    return F.create_map(*(x for k, v in named.items() for x in (F.lit(k), F.coalesce(v, F.lit(0.0)))))


class _Rows(HTMLParser):
    """Cells of the rows of the tables of a page; nested tags inside a cell only lend their text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list[str]] = []
        self.cell: list[str] | None = None

    def _close(self) -> None:
        if self.cell is not None and self.rows:
            self.rows[-1].append(" ".join("".join(self.cell).split()).replace("|", "/"))
        self.cell = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("td", "th", "tr"):
            self._close()
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th"):
            if not self.rows:
                self.rows.append([])
            self.cell = []
        elif tag == "br" and self.cell is not None:
            self.cell.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th", "tr", "table"):
            self._close()

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell.append(data)


def _markdown(page: str | None) -> str:
    p = _Rows()
    p.feed(page or "")
    p.close()
    p._close()
    rows = [r for r in p.rows if r]
    if not rows:
        return ""
    width = max(map(len, rows))
    line = lambda cells: "| " + " | ".join([*cells, *[""] * (width - len(cells))]) + " |"
    return "\n".join([line(rows[0]), line(["---"] * width), *map(line, rows[1:])])


@F.pandas_udf(T.StringType())
def html_markdown(pages: pd.Series) -> pd.Series:
    """The rows of a page's tables as one Markdown table, short rows filled up; empty without a table."""
    return pages.map(_markdown)


def table_csv(table: Column, most_rows: int = 80) -> Column:
    """Rows as comma-separated lines; cells with a comma, quote or line end are quoted."""
    cell = lambda c: F.when(c.rlike("[,\"\n]"), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    return F.array_join(F.transform(F.slice(table, 1, most_rows), lambda r: F.array_join(F.transform(r, cell), ",")), "\n")


def table_sentences(table: Column, most_rows: int = 80) -> Column:
    """``the <column> of <row> is <cell>`` for each cell below the header; blank cells go."""
    head = F.get(table, F.lit(0))
    one = lambda r: F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size(r) - 1, F.lit(1))), lambda i: F.when(F.trim(F.coalesce(F.get(r, i), F.lit(""))) != "", F.concat(F.lit("the "), F.coalesce(F.get(head, i), F.lit("")), F.lit(" of "), F.get(r, F.lit(0)), F.lit(" is "), F.get(r, i)))), lambda x: x.isNotNull())
    return F.array_join(F.flatten(F.transform(F.slice(table, 2, most_rows), one)), "; ")


def retrieval_text(question: Column, family: Column, table: Column, memory_side: bool) -> Column:
    """What a record is found by: its question and the table's first column; on the memory's side its family too. Never an answer or program."""
    labels = F.array_join(F.transform(table, lambda r: F.get(r, F.lit(0))), "; ")
    return F.concat_ws("\n", F.concat(F.lit("Question: "), question), F.concat(F.lit("Rows: "), labels), *([F.concat(F.lit("Family: "), family)] if memory_side else []))


def top_groups(df: DataFrame, key: str, position: str, top: int, most_ids: int = 30) -> DataFrame:
    """``groups`` of the ``top`` largest groups, ties by key."""
    best = df.groupBy(key).agg(F.count("*").alias("_c")).orderBy(F.desc("_c"), key).limit(top).select(key)
    return groups(df.join(best, key, "left_semi"), key, position, most_ids)


def arm_prompt(arm: Column, question: Column, context: Column, cases: Column, strategies: Column) -> Column:
    """The whole prompt of an arm: what to do, the arm's memory, the context, the question."""
    memory = memory_block(arm, cases, strategies)
    return F.concat_ws("\n\n", F.lit("Answer with PROGRAM: and ANSWER: lines."), F.when(memory != "", memory), F.concat(F.lit("CONTEXT:\n"), context), F.concat(F.lit("QUESTION: "), question))
