"""Numeric text: dialects of coercion, tolerant equality, scales."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let


def _num(x: Column) -> Column:
    return F.when(x.rlike(r"^\s*[-+]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][-+]?[0-9]+)?\s*$"), F.trim(x).try_cast("double"))


def strict_number(x: Column) -> Column:
    """Commas and dollar signs go; const_m1 is -1, const_X is X, a trailing % divides by 100; else null."""
    plain = lambda y: F.when(y == "const_m1", F.lit(-1.0)).when(y.startswith("const_"), _num(F.substring(y, 7, 1 << 20))).when(y.endswith("%"), _num(F.regexp_replace(y, "%$", "")) / 100).otherwise(_num(y))
    return let(F.regexp_replace(F.trim(x), "[,$]", ""), plain)


def lenient_number(x: Column) -> Column:
    """Commas go; a number; else with % anywhere a hundredth; else with const a constant; else null."""

    def read(y: Column) -> Column:
        tail = F.regexp_replace(y, "const_", "")
        return F.coalesce(_num(y), F.when(y.contains("%"), _num(F.regexp_replace(y, "%", "")) / 100), F.when(y.contains("const"), F.when(tail == "m1", F.lit(-1.0)).otherwise(_num(tail))))

    return let(F.regexp_replace(F.trim(x), ",", ""), read)


def unsigned_number(x: Column) -> Column:
    """The dialect that strips $ , - and %: signs are lost and % does not scale."""
    y = F.regexp_replace(F.trim(x), "[$,%-]", "")
    return F.coalesce(_num(y), F.when(y.contains("const_"), _num(F.regexp_replace(y, "const_m?", ""))))


def cell_number(x: Column) -> Column:
    """A table cell: $ and what follows a bracket go, then as lenient."""
    return lenient_number(F.regexp_replace(F.regexp_replace(x, "[$]", ""), r"\(.*$", ""))


def row_numbers(cells: Column) -> Column:
    """All cells as numbers, or null if any is none."""
    n = F.transform(cells, cell_number)
    return F.when(~F.exists(n, lambda v: v.isNull()), n)


def last_number(x: Column) -> Column:
    """(value, percent) of the last number; brackets without a minus are negative."""
    hit = F.element_at(F.regexp_extract_all(x, F.lit(r"\(?[-+]?[$]?[0-9][0-9,]*(?:[.][0-9]+)?\)?%?"), F.lit(0)), -1)
    hit = F.when(F.size(F.regexp_extract_all(x, F.lit("[0-9]"), F.lit(0))) > 0, hit)
    v = F.regexp_replace(hit, "[^0-9.+-]", "").try_cast("double")
    return F.struct(F.when(hit.startswith("(") & hit.contains(")") & ~hit.contains("-"), -v).otherwise(v).alias("value"), F.coalesce(hit.endswith("%"), F.lit(False)).alias("percent"))


def scale_factor(x: Column) -> Column:
    y = F.lower(F.coalesce(x, F.lit("")))
    return F.when(y.contains("thousand"), 1e3).when(y.contains("million"), 1e6).when(y.contains("billion"), 1e9).when(y.contains("percent"), 0.01).otherwise(1.0)


def safe_ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def same_at(a: Column, b: Column, digits: int = 5) -> Column:
    return F.round(a, digits) == F.round(b, digits)


def close(a: Column, b: Column, rel: float = 0.0, absolute: float = 0.0) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(absolute), F.abs(b) * rel)


def scale_tolerant(pred: Column, gold: Column, tol: float = 1e-3) -> Column:
    """Whether pred, a hundred times or a hundredth of it is within tolerance."""
    return F.exists(F.array(F.lit(1.0), F.lit(100.0), F.lit(0.01)), lambda f: F.abs(pred * f - gold) <= F.greatest(F.lit(tol), F.abs(gold) * tol))


def error_class(pred: Column, gold: Column) -> Column:
    r = F.try_divide(pred, gold)
    return (
        F.when(pred.isNull(), "missing")
        .when(F.abs(pred - gold) <= 1e-9, "correct")
        .when((F.abs(r - 100) <= 1) | (F.abs(r - 0.01) <= 0.001), "percent_scale")
        .when((F.abs(r - 1000) <= 10) | (F.abs(r - 0.001) <= 1e-5), "thousands_scale")
        .when((F.abs(pred) < 1e-9) & (F.abs(gold) > 1), "zero_result")
        .when(F.abs(r - 1) < 0.05, "small_error")
        .otherwise("wrong")
    )


def single_number(x: Column) -> Column:
    """Whether a cell is one number and nothing else, whatever signs it wears."""
    return F.coalesce(F.regexp_replace(F.trim(x), r"[$€£%,()\s]", "").rlike(r"^[-+]?([0-9]+([.][0-9]*)?|[.][0-9]+)$"), F.lit(False))


def decimals(x: Column) -> Column:
    """Digits after the point of the first number."""
    return F.length(F.regexp_extract(F.regexp_replace(x, ",", ""), r"[0-9]+(?:[.]([0-9]+))?", 1))


def percent_expected(question: Column, gold: Column, pred: Column) -> Column:
    some = lambda c: F.coalesce(c, F.lit(""))
    return some(gold).contains("%") | some(pred).contains("%") | F.lower(some(question)).contains("percent")


def reconciled(question: Column, gold: Column, pred: Column) -> Column:
    """struct<pred, gold, percent>: both last numbers, the prediction times 100 where a percentage is meant and it is a small number without a sign for it."""
    both = F.struct(last_number(gold).alias("g"), last_number(pred).alias("p"))

    def at_scale(v: Column) -> Column:
        want = percent_expected(question, gold, pred) | v["g"]["percent"]
        p = v["p"]["value"]
        p = F.when(want & ~v["p"]["percent"] & (F.abs(p) <= 1.5), p * 100).otherwise(p)
        ok = v["g"]["value"].isNotNull() & p.isNotNull()
        return F.struct(F.when(ok, p).alias("pred"), F.when(ok, v["g"]["value"]).alias("gold"), F.when(ok, want).alias("percent"))

    return let(both, at_scale)


def mixed_close(a: Column, b: Column) -> Column:
    """Equal within a thousandth of the smaller number, a tenth at most, or one part in 10^9."""
    slack = F.least(F.abs(F.least(a, b) / 1000), F.lit(0.1))
    return F.abs(a - b) <= F.greatest(slack, F.greatest(F.abs(a), F.abs(b)) * 1e-9)


def percent_context(*texts: Column) -> Column:
    """Whether one of the texts speaks of percentages."""
    out = F.lit(False)
    for t in texts:
        out = out | F.lower(F.coalesce(t, F.lit(""))).rlike("%|percent|basis point")
    return out


def context_match(pred: Column, gold: Column, percent: Column, tol: float = 1e-3) -> Column:
    """Equal within tolerance; where percentages are spoken of also at a hundred times or a hundredth."""
    near = lambda a: F.abs(a - gold) <= F.greatest(F.lit(tol), F.abs(gold) * tol)
    return near(pred) | (percent & scale_tolerant(pred, gold, tol))
