"""Derivation texts such as ``(1,200 - 1,000) / 1,000``: tokens, operators, operand counts, families."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let


def tokens(x: Column) -> Column:
    """Numbers as O1, O2, ... in order of appearance, operators and brackets as they are, neighbouring words as one WORD. A minus that no number or bracket precedes belongs to its number."""
    raw = F.regexp_extract_all(F.regexp_replace(x, r"\s+", ""), F.lit(r"(?<![0-9)%])-?[$]?[0-9][0-9,]*(?:[.][0-9]+)?%?|[$]?[0-9][0-9,]*(?:[.][0-9]+)?%?|[-+*/()]|[A-Za-z]+"), F.lit(0))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("n"))
    fold = F.aggregate(raw, start, lambda a, t: F.struct(F.concat(a["out"], F.array(F.when(t.rlike("[0-9]"), F.concat(F.lit("O"), (a["n"] + 1).cast("string"))).when(t.rlike("^[A-Za-z]+$"), "WORD").otherwise(t))).alias("out"), (a["n"] + t.rlike("[0-9]").cast("int")).alias("n")))
    return fold["out"]


def operand_count(toks: Column) -> Column:
    """The number of the last operand, as they are numbered in order."""
    return F.coalesce(F.array_max(F.transform(toks, lambda t: F.regexp_extract(t, "^O([0-9]+)$", 1).try_cast("int"))), F.lit(0))


def operators(toks: Column) -> Column:
    """Operator names, those in deeper brackets not reordered."""
    names = F.create_map(*(F.lit(v) for v in ("+", "add", "-", "subtract", "*", "multiply", "/", "divide")))
    return F.transform(F.filter(toks, lambda t: t.isin("+", "-", "*", "/")), lambda t: F.element_at(names, t))


def depth(toks: Column) -> Column:
    """Most brackets that are open at one place."""
    brackets = F.filter(toks, lambda t: t.isin("(", ")"))
    opened = lambda i: F.aggregate(F.slice(brackets, 1, i), F.lit(0), lambda n, t: n + F.when(t == "(", 1).otherwise(-1))
    return F.coalesce(F.array_max(F.transform(F.sequence(F.lit(1), F.greatest(F.size(brackets), F.lit(1))), opened)), F.lit(0))


#: A family for a sequence of operators, for so many operands, where the tokens read like this. The
#: first row that fits counts. A sum divided by its length would have an ``add`` too, so its row never fits.
SHAPES = [
    ("percent_change", ["subtract", "divide"], 0, 99, r"^\( O.*/ O"),
    ("average_or_sum_divide", ["divide"], 3, 99, r"\+"),
    ("ratio", ["divide"], 2, 2, ""),
    ("difference", ["subtract"], 2, 2, ""),
    ("sum", ["add"], 2, 99, ""),
    ("product", ["multiply"], 2, 2, ""),
]
#: What any other derivation is called by the operators that it holds, the first row that fits.
MIXTURES = [("change_or_composed_ratio", {"divide", "subtract"}), ("division_composition", {"divide"}), ("difference_composition", {"subtract"}), ("aggregation", {"add"}), ("multiplication_composition", {"multiply"})]


def family(toks: Column) -> Column:
    """What a derivation computes, by the tables above; unparsed without operators, other if no row fits."""

    def look(v: Column) -> Column:
        rows = [F.when((v["ops"] == F.array(*map(F.lit, ops))) & v["n"].between(least, most) & v["text"].rlike(form), name) for name, ops, least, most, form in SHAPES]
        rows += [F.when(F.size(F.array_except(F.array(*map(F.lit, sorted(held))), v["ops"])) == 0, name) for name, held in MIXTURES]
        return F.when(F.size(v["ops"]) == 0, "unparsed").otherwise(F.coalesce(*rows, F.lit("other")))

    return let(F.struct(operators(toks).alias("ops"), operand_count(toks).alias("n"), F.array_join(toks, " ").alias("text")), look)


def inferred_operators(derivation: Column) -> Column:
    """Operators that a derivation's signs and words speak of, in a fixed order."""
    low = F.lower(derivation)
    signs = {"add": r"\+", "subtract": "-", "multiply": r"\*|×| x ", "divide": "/|÷", "average": r"\b(average|avg)\b", "count_or_multi_item": "##"}
    return F.coalesce(F.array_compact(F.array(*(F.when(low.rlike(form), name) for name, form in signs.items()))), F.array().cast("array<string>"))


def inferred_operator(kind: Column, derivation: Column, compares: Column) -> Column:
    """One label for a question: a comparison, a kind of span, a count, or the last operator of its derivation."""
    last = F.element_at(F.concat(F.array(F.lit("arithmetic")), inferred_operators(F.coalesce(derivation, F.lit("")))), -1)
    return F.when(kind.isNull() | (kind == ""), None).when(compares, "comparison").when(kind == "span", "span").when(kind.isin("spans", "multi-span", "multi_span"), "multi_span").when(kind.isin("count", "counting"), "count").when(kind == "arithmetic", last).otherwise(kind)


def operands(program: Column) -> Column:
    """Distinct numbers of a program that a context should hold: not 0, 1, 100, years or single characters."""
    n = F.regexp_extract_all(program, F.lit(r"(?<![#_0-9.])[0-9]+(?:,[0-9]{3})*(?:[.][0-9]+)?"), F.lit(0))
    return F.filter(F.array_distinct(n), lambda v: ~v.isin("0", "1", "100") & ~v.rlike("^(19|20)[0-9]{2}$") & (F.length(v) > 1))


def coverage(wanted: Column, context: Column) -> Column:
    """Share of the wanted numbers that the context holds once grouping commas and dollar signs before digits are gone; 1 if none are wanted."""
    c = F.regexp_replace(F.regexp_replace(context, r"([0-9]),([0-9])", "$1$2"), r"[$]([0-9])", "$1")
    hit = F.size(F.filter(wanted, lambda v: F.contains(c, v)))
    return F.when(F.size(wanted) == 0, F.lit(1.0)).otherwise(hit / F.size(wanted))
