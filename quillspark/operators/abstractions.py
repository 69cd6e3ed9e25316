"""Checks of abstract strategy texts against the programs they stand for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MENTIONS = (("add", r"\b(add|sum|total|plus)\b"), ("subtract", r"\b(subtract|minus|difference|less)\b"), ("multiply", r"\b(multiply|times|product)\b"), ("divide", r"\b(divide|ratio|divided|per)\b"), ("greater", r"\b(greater|compare|larger)\b"))


def mentioned(text: Column) -> Column:
    """Operations that a text speaks of."""
    t = F.lower(text)
    return F.array_compact(F.array(*(F.when(t.rlike(p), F.lit(n)) for n, p in _MENTIONS)))


def fidelity(gold_ops: Column, text: Column) -> Column:
    """struct<extra, missing, mismatch>: operations only in the text, only in the program."""
    m, g = mentioned(text), F.array_distinct(gold_ops)
    extra, missing = F.array_sort(F.array_except(m, g)), F.array_sort(F.array_except(g, m))
    return F.struct(extra.alias("extra"), missing.alias("missing"), ((F.size(extra) > 0) | (F.size(missing) > 0)).alias("mismatch"))


def scale_mentions(text: Column) -> Column:
    t = F.lower(text)
    return F.struct(t.rlike(r"\b(x|times|multiply by|\*) ?100\b").alias("times_100"), t.rlike(r"(divide by|/) ?100\b").alias("by_100"), t.rlike("percent|%").alias("percent"))


def degenerate(text: Column, least: int = 20) -> Column:
    """Too short, or one word said over and over."""
    w = F.split(F.lower(F.trim(text)), r"\s+")
    return (F.length(text) < least) | (F.size(F.array_distinct(w)) * 3 < F.size(w))


def contaminated(gold_ops: Column, text: Column, secret: Column) -> Column:
    """A text that names the secret value, holds a year, misses or invents operations, or is degenerate."""
    f = fidelity(gold_ops, text)
    return f["mismatch"] | degenerate(text) | F.contains(text, secret) | text.rlike(r"\b(19|20)[0-9]{2}\b")


def outcome_class(before: Column, after: Column) -> Column:
    """repaired, broken, unchanged_right or unchanged_wrong."""
    return F.when(~before & after, "repaired").when(before & ~after, "broken").when(before, "unchanged_right").otherwise("unchanged_wrong")


#: Operators that a strategy may name, and words that stand for some of them.
NAMED = ("add", "subtract", "multiply", "divide", "table_sum", "table_average", "table_max", "table_min")
STANDS_FOR = {"divide": ("ratio", "percentage"), "subtract": ("difference", "change")}
GENERIC = ("find relevant values", "calculate the answer", "look at the table", "use the information", "perform the calculation")


def preserved(ops: Column, text: Column) -> Column:
    """Array of issues: no_operations_mentioned, operation_mismatch. Operators may be named or stood for by a word."""
    low = F.lower(text)
    named = F.array_compact(F.array(*(F.when(F.contains(low, F.lit(o)) | F.contains(low, F.lit(o.replace("_", " "))), o) for o in NAMED)))
    stood = F.lit(False)
    for op, words in STANDS_FOR.items():
        stood = stood | (F.array_contains(ops, op) & low.rlike("|".join(words)))
    some = F.size(ops) > 0
    return F.array_compact(F.array(F.when(some & (F.size(named) == 0), "no_operations_mentioned"), F.when(some & ~F.arrays_overlap(ops, named) & ~stood, "operation_mismatch")))


def overlong(ops: Column, text: Column, most_ops: int = 2, most_chars: int = 2000) -> Column:
    """Whether a text is suspiciously long for so simple a program."""
    return (F.size(ops) <= most_ops) & (F.length(text) > most_chars)


def thin(text: Column, least: int = 200) -> Column:
    """Array of issues: too_short, too_generic, no_procedural_content."""
    low = F.lower(text)
    generic = sum((F.contains(low, F.lit(g)).cast("int") for g in GENERIC), F.lit(0))
    return F.array_compact(F.array(F.when(F.length(text) < least, "too_short"), F.when(generic >= 3, "too_generic"), F.when(~low.rlike("operand|role|value|step|then|calculate"), "no_procedural_content")))


def quality_issues(ops: Column, text: Column, template: Column) -> Column:
    """Array of issues of an abstraction: operations missing or invented, a factor of 100 said both ways, its template repeated word for word."""
    f, sc = fidelity(ops, text), scale_mentions(text)
    return F.array_compact(F.array(F.when(F.size(f["missing"]) > 0, "missing_operation"), F.when(F.size(f["extra"]) > 0, "invented_operation"), F.when(sc["times_100"] & sc["by_100"], "scale_conflict"), F.when((F.length(template) > 0) & F.contains(F.lower(text), F.lower(template)), "template_leakage")))
