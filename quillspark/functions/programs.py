"""The arithmetic program language: ``op(a, b), op(#0, c)`` over numbers, constants and table rows.

Linear programs are parsed and folded by Column expressions. Nested programs need recursion and go
through one Arrow-batched function that returns the same steps, in post-order.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import let
from .numbers import cell_number, lenient_number, strict_number

OPS = ("add", "subtract", "multiply", "divide", "exp", "greater")
TABLE_OPS = ("table_max", "table_min", "table_sum", "table_average")
STEP = T.StructType([T.StructField(n, T.StringType()) for n in ("op", "a", "b")])
PARSED = T.StructType([T.StructField("steps", T.ArrayType(STEP)), T.StructField("error", T.StringType())])
_FORM = r"^([a-z_]+)\(([^(),]+), ([^(),]+)\)$"


def parse_linear(program: Column) -> Column:
    """Steps of a linear program; null unless every step is well formed and refers only to earlier steps."""
    parts = F.split(program, r"(?<=\)), ")
    steps = F.transform(parts, lambda p, i: F.struct(F.regexp_extract(p, _FORM, 1).alias("op"), F.trim(F.regexp_extract(p, _FORM, 2)).alias("a"), F.trim(F.regexp_extract(p, _FORM, 3)).alias("b"), i.alias("i"), p.rlike(_FORM).alias("ok")))
    back = lambda x, i: ~x.startswith("#") | (x.rlike("^#[0-9]+$") & (F.substring(x, 2, 9).try_cast("int") < i))
    good = F.forall(steps, lambda s: s["ok"] & s["op"].isin(*OPS, *TABLE_OPS) & F.coalesce(back(s["a"], s["i"]), F.lit(False)) & F.coalesce(back(s["b"], s["i"]), F.lit(False)))
    return F.when(good, F.transform(steps, lambda s: F.struct(s["op"].alias("op"), s["a"].alias("a"), s["b"].alias("b"))))


def parse_linear_coded(program: Column) -> Column:
    """struct<steps, error> of a linear program: empty, part, form, operator, arity or reference says why there are none.

    Parts stand between top-level ``, `` and all text must be used up.
    """
    text = F.ltrim(program)
    parts = F.split(text, r"(?<=\)), ", -1)
    args = lambda p: F.transform(F.split(F.regexp_extract(p, r"^[^(]*\((.*)\)$", 1), ", "), lambda a: F.trim(a))
    rows = F.transform(parts, lambda p, i: F.struct(F.regexp_extract(p, r"^([a-z_]+)\(", 1).alias("op"), args(p).alias("args"), i.alias("i"), p.alias("p")))

    def fault(r: Column) -> Column:
        back = lambda x: ~x.startswith("#") | F.coalesce(x.rlike("^#[0-9]+$") & (F.substring(x, 2, 9).try_cast("int") < r["i"]), F.lit(False))
        return (
            F.when((F.trim(r["p"]) == "") | r["p"].startswith(","), "part")
            .when(~r["p"].rlike(r"^[^()]+\([^()]*\)$"), "form")
            .when(~r["op"].isin(*OPS, *TABLE_OPS), "operator")
            .when((F.size(r["args"]) != 2) | F.exists(r["args"], lambda a: a == ""), "arity")
            .when(~F.forall(r["args"], back), "reference")
        )

    error = lambda rs: F.get(F.filter(F.transform(rs, fault), lambda e: e.isNotNull()), F.lit(0))
    steps = lambda rs: F.transform(rs, lambda r: F.struct(r["op"].alias("op"), F.get(r["args"], F.lit(0)).alias("a"), F.get(r["args"], F.lit(1)).alias("b")))
    whole = let(rows, lambda rs: let(error(rs), lambda e: F.struct(F.when(e.isNull(), steps(rs)).alias("steps"), e.alias("error"))))
    return F.when(program.isNull() | (F.trim(text) == ""), F.struct(F.lit(None).cast("array<struct<op:string,a:string,b:string>>").alias("steps"), F.lit("empty").alias("error"))).otherwise(whole)


def lenient_tokens(program: Column) -> Column:
    """``op(``, operands and ``)`` one by one, with EOF at the end; operands part only at a comma and a space."""
    toks = F.flatten(F.transform(F.split(program, ", "), lambda p: F.regexp_extract_all(p, F.lit(r"[^()]*\(|\)|[^()]+"), F.lit(0))))
    return F.concat(toks, F.array(F.lit("EOF")))


def official_run(program: Column, table: Column) -> Column:
    """struct<invalid, value, flag> of the public scorer's reading of a program.

    Four tokens make a step. Every fourth token must be an operator and every fourth after it a bracket;
    a last step without its bracket is not run. A reference in a table operation is invalid, row labels
    are exact, and an invalid program has no value.
    """
    toks = let(lenient_tokens(program), lambda t: F.slice(t, 1, F.size(t) - 1))

    def run(t: Column) -> Column:
        n = F.floor(F.size(t) / 4).cast("int")
        at = lambda i: F.get(t, i)
        steps = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.rtrim(at(4 * i), F.lit("(")).alias("op"), F.trim(at(4 * i + 1)).alias("a"), F.trim(at(4 * i + 2)).alias("b"), (at(4 * i).endswith("(") & (at(4 * i + 3) == ")")).alias("ok"))))
        steps = F.coalesce(steps, F.array().cast("array<struct<op:string,a:string,b:string,ok:boolean>>"))
        rest = (F.size(t) % 4 > 0) & ~F.coalesce(F.rtrim(at(4 * n), F.lit("(")).isin(*OPS, *TABLE_OPS), F.lit(False))
        bad = rest | ~F.forall(steps, lambda s: s["ok"] & s["op"].isin(*OPS, *TABLE_OPS))
        plain = F.transform(steps, lambda s: F.struct(s["op"].alias("op"), s["a"].alias("a"), s["b"].alias("b")))
        return let(F.struct(bad.alias("bad"), execute(F.when(~bad, plain), table, number=lenient_number, exact=True).alias("run")), lambda r: F.struct((r["bad"] | ~r["run"]["ok"]).alias("invalid"), answer(r["run"]).alias("value"), F.when(r["run"]["ok"], r["run"]["flag"]).alias("flag")))

    return let(toks, run)


def best_effort_steps(program: Column) -> Column:
    """Whatever reads like ``op(a, b)`` in a text, in order; null if nothing does."""
    found = F.regexp_extract_all(program, F.lit(r"[a-z_]+\(\s*[^(),]+\s*,\s*[^(),]+\s*\)"), F.lit(0))
    step = lambda p, k: F.trim(F.regexp_extract(p, r"([a-z_]+)\(\s*([^(),]+)\s*,\s*([^(),]+)\s*\)", k))
    steps = F.filter(F.transform(found, lambda p: F.struct(step(p, 1).alias("op"), step(p, 2).alias("a"), step(p, 3).alias("b"))), lambda s: s["op"].isin(*OPS, *TABLE_OPS))
    return let(steps, lambda x: F.when(F.size(x) > 0, x))


def flat_audit(program: Column) -> Column:
    """struct<ops, operands, n_steps, parse_ok, kind>: what a program holds without parsing it; an empty one is a span."""
    text = F.coalesce(program, F.lit(""))
    count = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c)))
    ops = operations(text)
    inner = F.regexp_extract_all(text, F.lit(r"(?<=[(,])\s*([^(),]+?)\s*(?=[,)])"), F.lit(1))
    return F.struct(ops.alias("ops"), inner.alias("operands"), F.size(ops).alias("n_steps"), ((F.size(ops) > 0) & (count("(") == count(")")) & (F.size(ops) == count("("))).alias("parse_ok"), F.when(F.trim(text) == "", "span").otherwise("program").alias("kind"))


def is_linear(program: Column) -> Column:
    """Whether a comma stands outside all brackets."""
    start = F.struct(F.lit(0).alias("deep"), F.lit(False).alias("seen"))
    step = lambda a, c: F.struct((a["deep"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)).alias("deep"), (a["seen"] | ((c == ",") & (a["deep"] == 0))).alias("seen"))
    return F.aggregate(F.filter(F.split(program, ""), lambda c: c.isin("(", ")", ",")), start, step)["seen"]


def any_steps(program: Column) -> Column:
    """Steps of a cleaned program, read as linear if a comma stands outside all brackets and as nested otherwise."""
    return let(clean_program(program), lambda p: F.when(is_linear(p), parse_linear_coded(p)["steps"]))


def require(run: Column, program: Column) -> Column:
    """The value of a run, or the failure of the whole query: for programs that must execute, such as golds."""
    return F.when(run["ok"], answer(run)).otherwise(F.raise_error(F.concat(F.lit("program does not execute: "), F.coalesce(program, F.lit("null")))))


def operator_only(program: Column) -> Column:
    return F.coalesce(F.trim(program).rlike("^[a-z_]+$"), F.lit(False))


def category(status: Column) -> Column:
    """Where a failed answer failed: extraction, operator_only, parse, execution or wrong_result."""
    names = {"no_program": "extraction", "operator_only": "operator_only", "parse_fail": "parse", "exec_fail": "execution", "wrong_result": "wrong_result"}
    return F.element_at(F.create_map(*(F.lit(x) for kv in [*names.items(), ("success", "")] for x in kv)), status)


def row_values(table: Column, label: Column, exact: bool = False) -> Column:
    """Numbers of the last row with this label (``exact``: letter by letter); null if there is none or a cell is no number."""
    name = lambda c: c if exact else F.lower(F.trim(c))
    row = let(name(label), lambda want: F.try_element_at(F.filter(table, lambda r: name(F.get(r, F.lit(0))) == want), F.lit(-1)))
    cells = let(row, lambda r: F.transform(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), cell_number))
    return let(cells, lambda c: F.when((F.size(c) > 0) & ~F.exists(c, lambda v: v.isNull()), c))


def _row_op(op: Column, values: Column) -> Column:
    total = lambda cells: F.aggregate(cells, F.lit(0.0), lambda s, v: s + v)
    return let(values, lambda cells: F.when(op == "table_max", F.array_max(cells)).when(op == "table_min", F.array_min(cells)).when(op == "table_sum", total(cells)).when(op == "table_average", F.try_divide(total(cells), F.size(cells))))


def _arithmetic(op: Column, a: Column, b: Column) -> Column:
    return (
        F.when(op == "add", a + b)
        .when(op == "subtract", a - b)
        .when(op == "multiply", a * b)
        .when(op == "divide", F.try_divide(a, b))
        .when(op == "exp", F.when((a < 0) & (b != F.floor(b)), None).otherwise(F.pow(a, b)))
        .when(op == "greater", (a > b).cast("double"))
    )


def execute(steps: Column, table: Column | None = None, known_rows: Column | None = None, number=strict_number, exact: bool = False) -> Column:
    """struct<vals array<double>, flag string, ok boolean>: the value of each step.

    A step is invalid on an operand without a value, division by zero, a negative base with a
    fractional exponent, an unknown row, a reference in a table operation or a cell that is no number;
    what follows an invalid step is invalid. ``greater`` puts yes or no in ``flag`` and 1 or 0 in ``vals``.
    ``known_rows`` (map of row label to numbers) stands in for a table, as in a step's grounding. ``number``
    is the dialect of operands, ``exact`` asks for row labels letter by letter. Every value is computed
    once: use the result through one column.
    """

    def step(acc: Column, s: Column) -> Column:
        arg = lambda x: F.when(x.startswith("#"), F.get(acc["vals"], F.substring(x, 2, 9).try_cast("int"))).otherwise(number(x))
        plain = let(F.struct(arg(s["a"]).alias("a"), arg(s["b"]).alias("b")), lambda v: _arithmetic(s["op"], v["a"], v["b"]))
        cells = None if table is None and known_rows is None else row_values(table, s["a"], exact) if known_rows is None else F.try_element_at(known_rows, s["a"])
        value = plain if cells is None else F.when(s["op"].startswith("table_"), F.when(~s["a"].startswith("#"), _row_op(s["op"], cells))).otherwise(plain)
        done = lambda v: F.struct(F.concat(acc["vals"], F.array(v)).alias("vals"), F.when(s["op"] == "greater", F.when(v == 1, "yes").when(v == 0, "no")).alias("flag"), (acc["ok"] & v.isNotNull()).alias("ok"))
        return let(let(value, lambda v: F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)), done)

    start = F.struct(F.array().cast("array<double>").alias("vals"), F.lit(None).cast("string").alias("flag"), F.lit(True).alias("ok"))
    return F.when(steps.isNotNull(), F.aggregate(steps, start, step))


def answer(run: Column) -> Column:
    """Last value rounded to five places, or null."""
    return F.when(run["ok"], F.round(F.try_element_at(run["vals"], F.lit(-1)), 5))


def template(steps: Column) -> Column:
    """Steps with operands as NUM, CONST, PCT, REF or ROW."""
    kind = lambda x: F.when(x.startswith("#"), x).when(x.startswith("const_"), "CONST").when(x.endswith("%"), "PCT").when(strict_number(x).isNotNull(), "NUM").when(x == "none", "none").otherwise("ROW")
    return F.array_join(F.transform(steps, lambda s: F.concat(s["op"], F.lit("("), kind(s["a"]), F.lit(", "), kind(s["b"]), F.lit(")"))), ", ")


def operations(program: Column) -> Column:
    return F.regexp_extract_all(program, F.lit(r"([a-z_]+)\("), F.lit(1))


def op_family(ops: Column) -> Column:
    """First match wins."""
    has = lambda o: F.array_contains(ops, o)
    return F.when(has("greater"), "comparison").when(F.exists(ops, lambda o: o.startswith("table_")), "table_aggregation").when(has("divide") & has("subtract"), "change").when(has("divide"), "ratio").when(has("add"), "aggregation").when(has("multiply"), "scaling").otherwise("other")


#: Families by the operators that a program holds, first match wins; and which families pass for each other.
ALIGNED = [("comparison", ("greater",)), ("average", ("table_average",)), ("aggregation", ("table_sum",)), ("aggregation", ("table_max",)), ("aggregation", ("table_min",)), ("percentage_change", ("divide", "subtract")), ("ratio", ("divide",)), ("difference", ("subtract",)), ("aggregation", ("add",)), ("multiplication", ("multiply",))]
COMPATIBLE = [("percentage_change", "difference"), ("ratio", "average"), ("aggregation", "average"), ("unit_scaling", "multiplication"), ("multi_step", "percentage_change", "difference", "ratio")]


def aligned_family(ops: Column) -> Column:
    """The family by the second set of rules."""
    return F.coalesce(*(F.when(F.size(F.array_except(F.array(*map(F.lit, held)), ops)) == 0, name) for name, held in ALIGNED), F.lit("other"))


def compatible(a: Column, b: Column) -> Column:
    """Whether two families are equal or stand in one group."""
    out = a == b
    for g in COMPATIBLE:
        out = out | (a.isin(*g) & b.isin(*g))
    return out


def known_operations(program: Column) -> Column:
    """Operators of a text that the language knows, in order."""
    return F.filter(operations(program), lambda o: o.isin(*OPS, *TABLE_OPS))


def operation_set(program: Column) -> Column:
    """Distinct known operators; table operators also count as what they do."""
    plain = F.transform(known_operations(program), lambda o: F.regexp_replace(o, "^table_", ""))
    return F.array_sort(F.array_distinct(F.concat(known_operations(program), plain)))


#: What a record's questions and answers are told apart by.
RATIO_WORDS, SUM_WORDS = r"\b(ratio|proportion|percent|percentage|rate|multiple|growth)\b", r"\b(sum|total|average|avg|mean)\b"
SUPERLATIVES, COMPARED = r"\b(most|least|maximum|max|min|minimum|greatest|largest|lowest|highest)\b", r"\b(greater|less|larger|smaller|higher|lower|more|fewer|exceed(s|ed)?|increase|decrease|decline)\b"
YES_OR_NO = r"^(does|do|did|is|are|was|were|has|have|had)\b"


def program_family(ops: Column, question: Column) -> Column:
    """What a program computes, by its operators and the words of its question."""
    has = lambda *o: F.size(F.array_except(F.array(*map(F.lit, o)), ops)) == 0
    only = lambda *o: ops == F.array(*map(F.lit, o))
    asks = F.lower(question).rlike(RATIO_WORDS)
    pure = F.size(F.array_except(ops, F.array(F.lit("add")))) == 0
    name = (
        F.when(F.size(ops) == 0, "unparsed")
        .when(only("divide") & asks, "ratio")
        .when(has("subtract", "divide") & ~F.array_contains(ops, "multiply"), F.when(asks, "change_rate").otherwise("difference_then_ratio"))
        .when(pure, "aggregation_sum")
        .when(has("add", "divide") & ~F.array_contains(ops, "subtract"), "average_or_composed_division")
        .when(only("subtract"), "difference")
        .when(only("multiply"), "multiplication")
        .when(has("multiply", "divide", "subtract"), "projection_or_compound_change")
    )
    mixed = F.coalesce(*(F.when(F.array_contains(ops, o), f"{n}_composition") for o, n in (("divide", "division"), ("subtract", "difference"), ("multiply", "multiplication"))))
    return F.concat(F.lit("program:"), F.coalesce(name, mixed, F.concat(F.lit("sequence:"), F.array_join(ops, ">"))))


def span_family(question: Column, answer: Column) -> Column:
    """What a question whose answer is a span looks for."""
    q, compares = F.lower(question), F.lower(question).rlike(COMPARED) | F.lower(question).rlike(SUPERLATIVES)
    return F.concat(F.lit("span:"), F.when(q.rlike(YES_OR_NO) & compares, "comparison_yesno").when(q.rlike(SUPERLATIVES), "superlative_lookup").when(compares, "comparison_lookup").when(F.coalesce(answer, F.lit("")).rlike("[,;]"), "multi_value_lookup").when(q.rlike(SUM_WORDS) | q.rlike(RATIO_WORDS), "computed_value_lookup").otherwise("direct_lookup"))


def step_bucket(n: Column) -> Column:
    return F.when(n >= 5, "5plus").otherwise(n.cast("string"))


def evidence(texts: Column, tables: Column) -> Column:
    """text+table, text, table or none, by how many of each support an answer."""
    return F.when((texts > 0) & (tables > 0), "text+table").when(texts > 0, "text").when(tables > 0, "table").otherwise("none")


def schema_key(program: Column, question: Column, answer: Column, texts: Column, tables: Column, scale: Column) -> Column:
    """``type|family|ops=|steps=|ev=|tables=|scale=`` of a record."""
    ops = operations(F.coalesce(program, F.lit("")))
    is_program = F.size(ops) > 0
    used = F.when(tables > 1, "multi").when(tables == 1, "single").otherwise("none")
    return F.concat_ws(
        "|",
        F.when(is_program, "program").otherwise("span"),
        F.when(is_program, program_family(ops, question)).otherwise(span_family(question, answer)),
        F.concat(F.lit("ops="), F.when(is_program, F.array_join(F.array_sort(F.array_distinct(ops)), "+")).otherwise("none")),
        F.concat(F.lit("steps="), step_bucket(F.size(ops))),
        F.concat(F.lit("ev="), evidence(texts, tables)),
        F.concat(F.lit("tables="), used),
        F.concat(F.lit("scale="), F.when(scale == "", "none").otherwise(scale)),
    )


def split_key(key: Column) -> Column:
    """Map of the parts of a schema key: type, family, and what stands before each ``=``."""
    parts = F.split(key, r"\|")
    rest = F.transform(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0))), lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.regexp_replace(p, "^[^=]*=", "").alias("value")))
    return F.map_from_entries(F.concat(F.array(F.struct(F.lit("type").alias("key"), F.get(parts, F.lit(0)).alias("value")), F.struct(F.lit("family").alias("key"), F.get(parts, F.lit(1)).alias("value"))), rest))


def bucket(ops: Column, program: Column) -> Column:
    """Difficulty bucket A to H; first match wins."""
    n = F.size(ops)
    return F.when(F.array_contains(ops, "greater"), "A").when(F.exists(ops, lambda o: o.startswith("table_")), "B").when(program.contains("const_") & (n >= 3), "C").when(n >= 4, "D").when(n == 3, "E").when(n == 2, "F").when(n == 1, "G").otherwise("H")


def clean_program(x: Column) -> Column:
    """A model's output as program text: fences, labels and comments go, compare is greater, lines are joined."""
    y = F.regexp_replace(x, "(?s)```[a-z]*", "")
    y = F.regexp_replace(y, r"(?i)^\s*program:\s*", "")
    y = F.regexp_replace(y, r"#[^0-9\n][^\n]*", "")
    y = F.regexp_replace(F.trim(y), r"\)\s*\n+\s*", "), ")
    y = F.regexp_replace(y, r"\bcompare\(", "greater(")
    y = F.regexp_replace(y, r",\s*,+", ",")
    return F.trim(F.regexp_replace(y, r"[,;\s]+$|\s*EOF\s*$", ""))


def program_of_response(x: Column) -> Column:
    """What stands after ``PROGRAM:`` up to ``ANSWER:`` or the end; null if there is none."""
    y = F.trim(F.regexp_extract(x, r"(?is)program:\s*(.+?)(?=\n\s*answer:|$)", 1))
    return F.when(y != "", y)


def failure(program: Column, steps: Column, run: Column, correct: Column) -> Column:
    """no_program, operator_only, parse_fail, exec_fail, wrong_result or success."""
    return F.when(program.isNull() | (F.trim(program) == ""), "no_program").when(program.rlike("^[a-z_]+$"), "operator_only").when(steps.isNull(), "parse_fail").when(~run["ok"], "exec_fail").when(~F.coalesce(correct, F.lit(False)), "wrong_result").otherwise("success")


def _nested(text: str | None) -> tuple[list[dict] | None, str | None]:
    """Post-order steps of a nested program, or why there are none."""
    if text is None or not text.strip():
        return None, "empty"
    steps: list[dict] = []
    at, n = 0, len(text)

    def expression() -> str:
        nonlocal at
        start = at
        while at < n and text[at] not in "(),":
            at += 1
        name = text[start:at].strip()
        if not name:
            raise ValueError("operand")
        if at < n and text[at] == "(":
            if name not in OPS + TABLE_OPS:
                raise ValueError("operator")
            at += 1
            args = [expression()]
            while at < n and text[at] == ",":
                at += 1
                args.append(expression())
            if at >= n or text[at] != ")":
                raise ValueError("bracket")
            at += 1
            while at < n and text[at] == " ":
                at += 1
            if len(args) != 2:
                raise ValueError("arity")
            steps.append({"op": name, "a": args[0], "b": args[1]})
            return f"#{len(steps) - 1}"
        return name

    try:
        root = expression()
        if at != n:
            raise ValueError("rest")
        if not root.startswith("#"):
            raise ValueError("operand")
    except (ValueError, RecursionError) as e:
        return None, str(e) if isinstance(e, ValueError) else "depth"
    return steps, None


@F.pandas_udf(PARSED)
def parse_nested(programs: pd.Series) -> pd.DataFrame:
    """Steps of a nested program in post-order, or an error code."""
    return pd.DataFrame([dict(zip(("steps", "error"), _nested(p), strict=True)) for p in programs], columns=["steps", "error"])


_PRIME = (1 << 61) - 1


def _at_point(steps: list[dict], salt: str) -> int | None:
    """The program's value modulo a prime where each operand is a number drawn by its text; null where that is undefined."""
    draw = lambda x: int.from_bytes(hashlib.blake2b(f"{salt}|{x}".encode(), digest_size=8).digest(), "big") % _PRIME
    done: list[int] = []
    for s in steps:
        if s["op"] in TABLE_OPS:
            done.append(draw(f"{s['op']}:{s['a']}"))
            continue
        a, b = (done[int(x[1:])] if x.startswith("#") and x[1:].isdigit() and int(x[1:]) < len(done) else int(x[6:]) if re.fullmatch(r"const_[0-9]+", x) else draw(x) for x in (s["a"], s["b"]))
        if s["op"] == "add":
            v = a + b
        elif s["op"] == "subtract":
            v = a - b
        elif s["op"] == "multiply":
            v = a * b
        elif s["op"] == "divide":
            if not b % _PRIME:
                return None
            v = a * pow(b, -1, _PRIME)
        else:
            v = draw(f"{s['op']}:{a % _PRIME}:{b % _PRIME}")
        done.append(v % _PRIME)
    return done[-1] if done else None


@F.pandas_udf(T.BooleanType())
def same_algebra(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether two programs are the same function of their operands: their values agree at three drawn points. Null where one is not parsed or is undefined."""
    plain = lambda s: [x if isinstance(x, dict) else x.asDict() for x in s]

    def same(x, y):
        if x is None or y is None:
            return None
        got = [(_at_point(plain(x), k), _at_point(plain(y), k)) for k in "abc"]
        return None if any(None in g for g in got) else all(p == q for p, q in got)

    return pd.Series([same(x, y) for x, y in zip(a, b, strict=True)], dtype=object)


def _canonical(steps: list[dict]) -> str:
    """Fully nested text with the operands of add and multiply in order."""
    done: list[str] = []
    for s in steps:
        args = [done[int(x[1:])] if x.startswith("#") and x[1:].isdigit() and int(x[1:]) < len(done) else x for x in (s["a"], s["b"])]
        if s["op"] in ("add", "multiply"):
            args.sort()
        done.append(f"{s['op']}({args[0]}, {args[1]})")
    return done[-1] if done else ""


@F.pandas_udf(T.StringType())
def canonical_form(steps: pd.Series) -> pd.Series:
    """One text for programs that are equal up to the order of operands of add and multiply; null for null."""
    return pd.Series([None if s is None else _canonical([x if isinstance(x, dict) else x.asDict() for x in s]) for s in steps], dtype=object)


#: Tokens that every program shares, in the order of their numbers.
VOCABULARY = ["EOF", "UNK", "GO", ")", *(f"{o}(" for o in (*OPS, *TABLE_OPS)), "const_1", "const_2", "const_3", "const_4", "const_5", "const_6", "const_7", "const_8", "const_9", "const_10", "const_100", "const_1000", "const_10000", "const_100000", "const_1000000", "const_10000000", "const_1000000000", "const_m1", "#0", "#1", "#2", "#3", "#4", "#5", "#6", "#7", "#8", "#9", "#10", "none"]


def token_indices(tokens: Column, numbers: Column) -> Column:
    """Numbers of a program's tokens: those of the shared vocabulary, then those of the record's own numbers (array of texts); unknown tokens are UNK."""
    shared = F.array(*map(F.lit, VOCABULARY))
    at = lambda arr, t: F.nullif(F.array_position(arr, t), F.lit(0).cast("long")) - 1
    return F.transform(tokens, lambda t: F.coalesce(at(shared, t), at(numbers, t) + len(VOCABULARY), F.lit(VOCABULARY.index("UNK")).cast("long")))


def tokens_of_indices(indices: Column, numbers: Column) -> Column:
    """The tokens again; an index beyond the record's numbers is null."""
    shared = F.array(*map(F.lit, VOCABULARY))
    return F.transform(indices, lambda i: F.when(i < len(VOCABULARY), F.get(shared, i.cast("int"))).otherwise(F.get(numbers, (i - len(VOCABULARY)).cast("int"))))
