"""Keyword rules over questions and answers: families, types, roles, scales, leaks, plain answers and error classes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and patterns of the published rules. "Within" lists hold parts of words, "padded"
# ones whole words between blanks (a word beside a comma or a question mark is none).
FLAGS = {
    "asks_percent": ["percent", "percentage", "%"],
    "asks_ratio": ["ratio", "portion", "share", "per ", "margin"],
    "asks_change": ["change", "increase", "decrease", "growth", "decline", "difference"],
    "asks_average": ["average", "mean"],
    "asks_sum": ["total", "sum", "combined"],
    "asks_compare": ["greater", "higher", "less", "lower", "more than", "compared"],
    "asks_maxmin": ["maximum", "minimum", "largest", "smallest", "highest", "lowest"],
}
PERCENT = ["percent", "percentage"]
CHANGE = [
    "change", "changed", "increase", "increased", "decrease", "decreased", "growth", "decline", "difference", "compared", "from", "to",
    "year over year", "year-over-year",
]
COMPARISON = ["greater", "higher", "lower", "less", "more than", "compare", "compared to"]
AVERAGE = ["average", "mean"]
DIFFERENCE = ["difference", "change in", "increase in", "decrease in"]
RATIO = ["per", "ratio", "margin", "share", "portion", "as a percentage of", "percent of", "percentage of"]
AGGREGATION = ["total", "sum", "combined", "aggregate"]
MULTIPLICATION = ["product", "multiply", "times"]
UNIT_SCALING = ["basis point", "basis points", "thousand", "thousands", "million", "millions", "billion", "billions"]
ROLES = [
    (["fraction", "decimal"], ["fraction_target"]),
    (["per"], ["numerator", "denominator", "per_unit"]),
    (["ratio", "margin"], ["numerator", "denominator"]),
    (["share", "portion", "of total", "percent of", "percentage of"], ["part", "whole"]),
    (["increase", "increased", "decrease", "decreased", "change", "growth", "decline", "compared"], ["old_value", "new_value"]),
    (["prior", "previous", "earlier", "beginning", "initial"], ["old_value"]),
    (["current", "ending", "final", "latest"], ["new_value"]),
    (["average", "mean"], ["sum_components", "count"]),
    (["total", "sum", "combined", "aggregate"], ["sum_components"]),
    (["greater", "higher", "lower", "less", "more than"], ["left_compare", "right_compare"]),
    (["volume", "transactions", "cards", "units"], ["quantity"]),
    (["price", "cost", "expense", "revenue", "income", "sales"], ["monetary_metric"]),
    (["share", "shares", "per share"], ["share_metric"]),
    (["thousand", "thousands", "million", "millions", "billion", "billions", "basis point", "basis points"], ["scaling_factor"]),
]
YES_NO = ["is ", "are ", "was ", "were ", "did ", "does ", "do ", "has ", "have ", "can ", "will "]
PHRASES = [
    (r"\b(?:19|20)\d{2}\b", "a reporting period"),
    (r"\$\s*\d[\d,]*(?:\.\d+)?", "a monetary value"),
    (r"\b\d{1,3}(?:,\d{3})+\b", "a numeric value"),
    (r"\b\d+\.\d+\b", "a numeric value"),
    (r"\b(?!0\b|1\b)\d+\b", "a numeric value"),
]
LEAKS = [
    ("four_digit_year", r"\b(?:19|20)\d{2}\b"),
    ("currency_or_large_number", r"\$\s*\d|\b\d{1,3}(?:,\d{3})+\b|\b\d+\.\d+\b"),
    ("standalone_number", r"\b\d+\b"),
]
NUMBER_SIGNS, PUNCTUATION = "'\"\\$€£¥%(),[]", "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SCALES = [("hundred", 100.0), ("thousand", 1e3), ("million", 1e6), ("billion", 1e9), ("percent", 0.01)]


def _low(x: Column) -> Column:
    return F.lower(F.coalesce(x, F.lit("")))


def within(x: Column, words: list[str]) -> Column:
    """Whether the lower-cased text holds any of the words, inside others too."""
    return reduce(lambda a, b: a | b, (F.contains(_low(x), F.lit(w)) for w in words))


def padded(x: Column, words: list[str]) -> Column:
    """Whether any of the words stands between blanks (or an end) of the lower-cased text."""
    y = F.concat(F.lit(" "), _low(x), F.lit(" "))
    return reduce(lambda a, b: a | b, (F.contains(y, F.lit(f" {w} ")) for w in words))


def years(x: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"\b(?:19|20)\d{2}\b"), F.lit(0))


def question_flags(x: Column) -> Column:
    """struct of what a question asks for, one boolean for each entry of ``FLAGS``."""
    return F.struct(*(within(x, words).alias(name) for name, words in FLAGS.items()))


def question_family(x: Column) -> Column:
    """First rule set: by the flags, comparisons first."""
    f = {name: within(x, words) for name, words in FLAGS.items()}
    return (
        F.when(f["asks_compare"], "comparison").when(f["asks_average"] | f["asks_maxmin"], "table_aggregation").when(f["asks_change"], "change")
        .when(f["asks_ratio"] | f["asks_percent"], "ratio").when(f["asks_sum"], "aggregation").otherwise("other")
    )


def predicted_family(x: Column) -> Column:
    """Second rule set: whole words, comparisons first; two different years alone make it multi_step."""
    percent = within(x, ["%"]) | padded(x, PERCENT)
    return (
        F.when(padded(x, COMPARISON), "comparison").when(padded(x, AVERAGE), "average").when(percent & padded(x, CHANGE), "percentage_change")
        .when(padded(x, DIFFERENCE), "difference").when(padded(x, RATIO) | percent, "ratio").when(padded(x, AGGREGATION), "aggregation")
        .when(padded(x, MULTIPLICATION), "multiplication").when(padded(x, UNIT_SCALING), "unit_scaling")
        .when(F.size(F.array_distinct(years(x))) >= 2, "multi_step").otherwise("other")
    )


def recorded_family(flags: Column) -> Column:
    """Third rule set, over the flags that a record holds."""
    asks = lambda n: F.coalesce(flags[f"asks_{n}"], F.lit(False))
    return F.when(asks("change"), "change").when(asks("ratio") | asks("percent"), "ratio_percent").when(asks("sum"), "aggregation").when(asks("average"), "average").when(asks("compare"), "comparison").otherwise("other")


def question_type(x: Column) -> Column:
    y = _low(x)
    yes_no = reduce(lambda a, b: a | b, (F.startswith(y, F.lit(w)) for w in YES_NO))
    return F.when(yes_no, "yes/no?").when(F.startswith(y, F.lit("what ")), "what").when(F.startswith(y, F.lit("how much")), "how_much").when(F.startswith(y, F.lit("how many")), "how_many").otherwise("other")


def roles(x: Column) -> Column:
    """The roles that a question's words call for, sorted, each once."""
    found = [F.when(within(x, ["%"]) | padded(x, PERCENT), F.array(F.lit("percent_target")))]
    found += [F.when(padded(x, words), F.array(*map(F.lit, names))) for words, names in ROLES]
    none = F.array().cast("array<string>")
    return F.sort_array(F.array_distinct(F.flatten(F.array(*(F.coalesce(f, none) for f in found)))))


def scale_hint(x: Column) -> Column:
    return F.when(within(x, ["%", "percent"]), "percent").when(within(x, ["billion", "(in b"]), "billion").when(within(x, ["million"]), "million").when(within(x, ["thousand"]), "thousand").otherwise("none")


def scale_profile(text: Column, answer: Column, scale: Column) -> Column:
    """struct of what a question, its answer and its scale together speak of; the answer alone decides on fractions below one and raw numbers."""
    every = F.concat_ws(" ", *(F.coalesce(c.cast("string"), F.lit("")) for c in (text, answer, scale)))
    own, fraction = _low(answer.cast("string")), within(every, ["fraction", "0-1"])
    million, billion, thousand, basis = (within(every, [w]) for w in ("million", "billion", "thousand", "basis point"))
    return F.struct(
        within(every, ["%", "percent"]).alias("asks_or_outputs_percent"), (fraction | own.rlike(r"\b0\.\d+")).alias("fraction_convention"), (~(within(own, ["%", "percent"]) | fraction)).alias("raw_number_convention"),
        million.alias("has_million"), billion.alias("has_billion"), thousand.alias("has_thousand"), basis.alias("has_basis_points"), (million | billion | thousand | basis).alias("has_scale_word"),
    )


def one_space(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "), "^ | $", "")


def sanitize(x: Column) -> Column:
    """Years, money and numbers become phrases; 0 and 1 stay. Null is the empty text."""
    return one_space(reduce(lambda y, rule: F.regexp_replace(y, *rule), PHRASES, one_space(x)))


def leak_hits(x: Column) -> Column:
    """[(type, text)] of all years, money or grouped or decimal numbers, and numbers, in that order; 0 and 1 are none."""
    found = [_typed(x, name, pattern) for name, pattern in LEAKS]
    return F.filter(F.concat(*found), lambda h: ~h["text"].isin("0", "1"))


def _typed(x: Column, name: str, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(pattern), F.lit(0)), lambda t: F.struct(F.lit(name).alias("type"), t.alias("text")))


def word_scale(x: Column) -> Column:
    """The factor that a scale word stands for; 1 for other words."""
    return reduce(lambda out, s: F.when(F.contains(F.lower(x), F.lit(s[0])), F.lit(s[1])).otherwise(out), reversed(SCALES), F.lit(1.0))


def is_number(x: Column) -> Column:
    """Whether a text is a number, with signs of money, brackets, commas or a percent sign, or one with a scale word after it."""
    words = F.filter(F.transform(F.split(F.trim(x), r"\s+"), lambda w: F.translate(w, NUMBER_SIGNS, "")), lambda w: w != "")
    first = F.coalesce(F.get(words, F.lit(0)).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.lit(False))
    return first & ((F.size(words) < 2) | (word_scale(F.coalesce(F.get(words, F.lit(1)), F.lit(""))) != 1))


def number_text(x: Column) -> Column:
    """The value of a number's text as text, at its scale, negative in brackets, percent as hundredths, four places. Whole numbers have no point; a number that starts with its point has no value (``None``)."""
    found = F.regexp_extract(F.translate(x, NUMBER_SIGNS, ""), r"[+-]?\d+(?:\.\d+)?|[+-]?\.\d+", 0)
    scale = word_scale(F.regexp_extract(x, r"[\d.]+\s?[a-zA-Z]+", 0))
    percent = x.rlike(r"[\d.\s]+%")
    whole = ~F.contains(found, F.lit(".")) & ~percent & (scale != 0.01)
    value = F.round(found.cast("double") * scale * F.when(x.rlike(r"\([\d.\s]+\)"), -1.0).otherwise(1.0) * F.when(percent, 0.01).otherwise(1.0), 4)
    point = F.regexp_replace(F.regexp_replace(F.format_string("%.4f", value), r"0+$", ""), r"\.$", ".0")
    return F.when(found.rlike(r"^[+-]?\."), "None").when(found == "", "None").when(whole, value.cast("decimal(38,0)").cast("string")).otherwise(point)


def plain_answer(x: Column) -> Column:
    """An answer for comparison: lower case, words without punctuation and articles, numbers as ``number_text``."""

    def token(t: Column) -> Column:
        bare = F.when(is_number(t), t).otherwise(F.translate(t, PUNCTUATION, ""))
        return one_space(F.regexp_replace(F.when(is_number(bare), number_text(bare)).otherwise(bare), r"\b(a|an|the)\b", " "))

    return F.array_join(F.filter(F.transform(F.split(_low(x), " "), token), lambda t: t != ""), " ")


def error_class(pred: Column, gold: Column, is_list: Column | None = None) -> Column:
    """Why a wrong numeric answer is wrong, by its ratio to the gold value. A gold of zero has an endless ratio; null is not a number."""
    ratio = F.when(gold == 0, F.lit(float("inf"))).otherwise(pred / F.when(gold != 0, gold))
    listed = F.lit(False) if is_list is None else F.coalesce(is_list, F.lit(False))
    return (
        F.when((F.abs(ratio - 100) < 1) | (F.abs(ratio - 0.01) < 0.001), "scale_percent_error")
        .when((F.abs(ratio - 1000) < 10) | (F.abs(ratio - 0.001) < 0.00001), "scale_thousands_error")
        .when((F.abs(pred) < 0.01) & (F.abs(gold) > 100), "wrong_operands_zero_result")
        .when(F.try_divide(F.abs(pred - gold), F.greatest(F.abs(gold), F.abs(pred))) < 0.05, "calculation_error_small")
        .when(listed, "returned_list_instead_of_sum").otherwise("wrong_extraction_or_logic")
    )


def failure_class(pred: Column, gold: Column) -> Column:
    """Why an answer fails, both as JSON texts: kinds that differ, near or far numbers, texts that hold one another, lists of other lengths."""
    kind = lambda c: F.when(c.rlike(r"^\s*\["), "list").when(c.rlike(r'^\s*"'), "str").when(c.rlike(r"^\s*-?\d+\s*$"), "int").when(c.rlike(r"^\s*-?[\d.]+([eE][+-]?\d+)?\s*$"), "float").when(c.rlike("^(true|false)$"), "bool").otherwise("NoneType")
    p, g = kind(F.coalesce(pred, F.lit("null"))), kind(F.coalesce(gold, F.lit("null")))
    ratio = F.when(gold.try_cast("double") == 0, F.lit(float("inf"))).otherwise(F.abs(F.try_divide(pred.try_cast("double"), gold.try_cast("double"))))
    text = lambda c: F.lower(F.trim(F.regexp_replace(c, r'^\s*"|"\s*$', "")))
    items = lambda c: F.size(F.from_json(c, "array<string>"))
    numbers = F.when(ratio.between(0.95, 1.05), "numeric_close").when((ratio < 0.1) | (ratio > 10), "numeric_scale_error").otherwise("numeric_wrong_value")
    texts = F.when(F.contains(text(pred), text(gold)) | F.contains(text(gold), text(pred)), "string_partial_match").otherwise("string_no_match")
    lists = F.when(items(gold) != items(pred), F.concat(F.lit("list_length_mismatch_"), items(gold).cast("string"), F.lit("_vs_"), items(pred).cast("string"))).otherwise("list_wrong_elements")
    return F.when(p != g, F.concat(F.lit("type_mismatch_"), g, F.lit("_to_"), p)).when(g.isin("int", "float"), numbers).when(g == "str", texts).when(g == "list", lists).otherwise("other")
