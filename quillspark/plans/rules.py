"""Queries of the keyword rules over questions that are put together from orders; every word of every list occurs.

The SQL states the words and bounds of each rule on its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R

LEADS = ["What", "what is", "How much", "how many", "Is", "are", "Was", "were", "did", "Does", "do", "has", "have", "can", "Will", "Which", "whatever", ""]
PARTS = [
    "percent", "percentage", "%", "change", "changed", "increase", "increased", "decrease", "decreased", "growth", "decline", "difference", "compared", "from", "to", "year over year", "year-over-year",
    "greater", "higher", "lower", "less", "more than", "compare", "compared to", "average", "mean", "change in", "increase in", "decrease in", "per", "ratio", "margin", "share", "portion",
    "as a percentage of", "percent of", "percentage of", "total", "sum", "combined", "aggregate", "product", "multiply", "times", "basis point", "basis points", "thousand", "thousands", "million", "millions",
    "billion", "billions", "(in b", "fraction", "decimal", "of total", "prior", "previous", "earlier", "beginning", "initial", "current", "ending", "final", "latest", "volume", "transactions", "cards", "units",
    "price", "cost", "expense", "revenue", "income", "sales", "shares", "per share", "maximum", "minimum", "largest", "smallest", "highest", "lowest", "0-1", "in 2018", "1999 and 2019", "$5", "$ 1,200.50", "12,345",
    "3.75", "0", "1", "42", "share,", "total?", "orders", "Percent", "BILLION", "summary", "meaning",
]
ANSWERS = ["0.25", "12%", "7", "0-1", "a fraction", "5 percent", "1.0", "10.5"]
#: Tokens and what each becomes as an answer.
TOKENS = {
    "1,000": "1000", "$5.50": "5.5", "12%": "0.12", "(134)": "-134", "1000!": "1000", "the": "", "An": "", "apples.": "apples", "-7": "-7", ".5": "None", "3e2": "3", "5million": "5million", "U.S.": "us",
    "0.25%": "0.0025", "[42]": "42", "€9": "9", "+8": "8", "1.0": "1.0", "12.50": "12.5", "(1.5)": "-1.5", "007": "7", "A-B": "ab", "0": "0", "4.": "4", "x1": "x1", "--": "", "the-end": "theend",
}


def _pick(words: list[str], factor: int, plus: int):
    return F.element_at(F.array(*map(F.lit, words)), ((F.col("o_orderkey") * factor + plus) % len(words) + 1).cast("int"))


def _pick_sql(words: list[str], factor: int, plus: int) -> str:
    return "([" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + f"])[(o_orderkey * {factor} + {plus}) % {len(words)} + 1]"


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.floor("o_totalprice").cast("long").alias("t"))
    more = F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit(" "), _pick(PARTS, 13, 5)))
    last = F.when(F.col("o_orderkey") % 3 > 1, F.concat(F.lit(" the "), _pick(PARTS, 29, 17)))
    q = F.concat(_pick(LEADS, 5, 1), F.lit(" "), _pick(PARTS, 7, 3), F.coalesce(more, F.lit("")), F.coalesce(last, F.lit("")))
    return o.select("o_orderkey", "t", q.alias("q"), _pick(ANSWERS, 11, 2).alias("a"))


_Q = f"""q AS (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS t, {_pick_sql(LEADS, 5, 1)} || ' ' || {_pick_sql(PARTS, 7, 3)} || CASE WHEN o_orderkey % 3 > 0 THEN ' ' || {_pick_sql(PARTS, 13, 5)} ELSE '' END
|| CASE WHEN o_orderkey % 3 > 1 THEN ' the ' || {_pick_sql(PARTS, 29, 17)} ELSE '' END AS q, {_pick_sql(ANSWERS, 11, 2)} AS a FROM orders), y AS (SELECT *, lower(q) AS y, ' ' || lower(q) || ' ' AS z FROM q)"""


def h5(spark, sf_dir):
    return _questions(spark, sf_dir).select("o_orderkey", R.sanitize(F.concat("q", F.lit("  at "), F.col("t"))).alias("clean"))


def h6(spark, sf_dir):
    return _questions(spark, sf_dir).select("o_orderkey", F.array_join(F.transform(R.leak_hits(F.concat("q", F.lit(" at "), F.col("t"))), lambda h: F.concat_ws("=", h["type"], h["text"])), ";").alias("leaks"))


def h7(spark, sf_dir):
    words = list(TOKENS)
    x = F.concat_ws(" ", _pick(words, 7, 2), F.lit("of"), _pick(words, 11, 4), F.lit(""), _pick(words, 5, 9))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", R.plain_answer(x).alias("answer"))


def h9(spark, sf_dir):
    return _questions(spark, sf_dir).groupBy(R.question_type(F.col("q")).alias("qtype")).agg(F.count("*").alias("n"), F.min("q").alias("first"))


def h10(spark, sf_dir):
    f = R.question_flags(F.col("q"))
    return _questions(spark, sf_dir).select("o_orderkey", R.question_family(F.col("q")).alias("family"), R.predicted_family(F.col("q")).alias("predicted"), R.recorded_family(f).alias("recorded"), F.array_join(F.filter(F.array(*(F.when(f[n], n) for n in R.FLAGS)), lambda v: v.isNotNull()), ",").alias("flags"))


def h10b(spark, sf_dir):
    """How the three rule sets agree."""
    q = _questions(spark, sf_dir)
    return q.groupBy(R.question_family(F.col("q")).alias("first"), R.predicted_family(F.col("q")).alias("second"), R.recorded_family(R.question_flags(F.col("q"))).alias("third")).agg(F.count("*").alias("n"))


def h11(spark, sf_dir):
    return _questions(spark, sf_dir).select("o_orderkey", F.array_join(R.roles(F.col("q")), ",").alias("roles"), R.scale_hint(F.col("q")).alias("scale"))


def h12(spark, sf_dir):
    return _questions(spark, sf_dir).select("o_orderkey", R.scale_profile(F.col("q"), F.col("a"), _pick(["", "basis points", "thousand"], 1, 0)).alias("p")).select("o_orderkey", "p.*")


_FACTORS = [1.0, 100.5, 0.0101, 1005.0, 0.001, 1.04, 0.97, 1.06, 0.0, 2.0, -100.0, 99.0]


def h30(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    gold = F.when(F.col("o_orderkey") % 13 == 0, F.lit(0.0)).when(F.col("o_orderkey") % 13 == 1, F.lit(50.0)).otherwise(F.floor("o_totalprice").cast("double"))
    pred = F.when(F.col("o_orderkey") % 17 == 0, F.lit(None)).otherwise(gold * F.element_at(F.array(*map(F.lit, _FACTORS)), (F.col("o_orderkey") % 12 + 1).cast("int")))
    return o.select("o_orderkey", R.error_class(pred, gold, F.col("o_orderkey") % 5 == 0).alias("kind"))


def h30b(spark, sf_dir):
    forms = [("{t}", "{t}"), ("{t}", "{t}0"), ("{t}", "{t}00"), ('"a {t}"', '"A {t} b"'), ('"x"', '"y"'), ("[1, {t}]", "[1]"), ("[1]", "[{t}]"), ("{t}", '"{t}"'), ("{t}.5", "{t}"), ("null", "{t}"), ("0", "{t}"), ("null", "null")]
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (F.floor("o_totalprice").cast("long") + 1).cast("string").alias("t"))
    side = lambda i: F.replace(_pick([f[i] for f in forms], 1, 0), F.lit("{t}"), F.col("t"))
    return o.groupBy((F.col("o_orderkey") % len(forms)).alias("form"), R.failure_class(side(1), side(0)).alias("kind")).agg(F.count("*").alias("n"))


QUERIES = {
    "h5_sanitize": h5, "h6_leak_hits": h6, "h7_normalize_answer": h7, "h9_question_type": h9, "h10_question_family": h10, "h10_rule_sets": h10b, "h11_roles": h11, "h12_scale_profiles": h12, "h30_error_classes": h30, "h30_failure_classes": h30b,
}


def _any(column: str, *words: str, pad: bool = False) -> str:
    return "(" + " OR ".join(f"contains({column}, '{f' {w} ' if pad else w}')" for w in words) + ")"


_PERCENT, _RATIO, _CHANGE = _any("y", "percent", "%"), _any("y", "ratio", "portion", "share", "per ", "margin"), _any("y", "change", "increase", "decrease", "growth", "decline", "difference")
_MEAN, _SUM, _COMPARE = _any("y", "average", "mean"), _any("y", "total", "sum", "combined"), _any("y", "greater", "higher", "less", "lower", "more than", "compared")
_EXTREME = _any("y", "maximum", "minimum", "largest", "smallest", "highest", "lowest")
_FIRST = f"CASE WHEN {_COMPARE} THEN 'comparison' WHEN {_MEAN} OR {_EXTREME} THEN 'table_aggregation' WHEN {_CHANGE} THEN 'change' WHEN {_RATIO} OR {_PERCENT} THEN 'ratio' WHEN {_SUM} THEN 'aggregation' ELSE 'other' END"
_WORD = lambda *w: _any("z", *w, pad=True)
_SHARE = f"(contains(y, '%') OR {_WORD('percent', 'percentage')})"
_MOVES = _WORD("change", "changed", "increase", "increased", "decrease", "decreased", "growth", "decline", "difference", "compared", "from", "to", "year over year", "year-over-year")
_SECOND = f"""CASE WHEN {_WORD("greater", "higher", "lower", "less", "more than", "compare", "compared to")} THEN 'comparison' WHEN {_WORD("average", "mean")} THEN 'average' WHEN {_SHARE} AND {_MOVES} THEN 'percentage_change'
WHEN {_WORD("difference", "change in", "increase in", "decrease in")} THEN 'difference' WHEN {_WORD("per", "ratio", "margin", "share", "portion", "as a percentage of", "percent of", "percentage of")} OR {_SHARE} THEN 'ratio'
WHEN {_WORD("total", "sum", "combined", "aggregate")} THEN 'aggregation' WHEN {_WORD("product", "multiply", "times")} THEN 'multiplication'
WHEN {_WORD("basis point", "basis points", "thousand", "thousands", "million", "millions", "billion", "billions")} THEN 'unit_scaling' WHEN len(list_distinct(regexp_extract_all(y, '\\b(?:19|20)[0-9][0-9]\\b'))) >= 2 THEN 'multi_step' ELSE 'other' END"""
_THIRD = f"CASE WHEN {_CHANGE} THEN 'change' WHEN {_RATIO} OR {_PERCENT} THEN 'ratio_percent' WHEN {_SUM} THEN 'aggregation' WHEN {_MEAN} THEN 'average' WHEN {_COMPARE} THEN 'comparison' ELSE 'other' END"
_ROLE = [
    (_SHARE, "percent_target"), (_WORD("fraction", "decimal"), "fraction_target"), (_WORD("per", "ratio", "margin"), "numerator"), (_WORD("per", "ratio", "margin"), "denominator"), (_WORD("per"), "per_unit"),
    (_WORD("share", "portion", "of total", "percent of", "percentage of"), "part"), (_WORD("share", "portion", "of total", "percent of", "percentage of"), "whole"),
    (_WORD("increase", "increased", "decrease", "decreased", "change", "growth", "decline", "compared", "prior", "previous", "earlier", "beginning", "initial"), "old_value"),
    (_WORD("increase", "increased", "decrease", "decreased", "change", "growth", "decline", "compared", "current", "ending", "final", "latest"), "new_value"),
    (_WORD("average", "mean", "total", "sum", "combined", "aggregate"), "sum_components"), (_WORD("average", "mean"), "count"),
    (_WORD("greater", "higher", "lower", "less", "more than"), "left_compare"), (_WORD("greater", "higher", "lower", "less", "more than"), "right_compare"), (_WORD("volume", "transactions", "cards", "units"), "quantity"),
    (_WORD("price", "cost", "expense", "revenue", "income", "sales"), "monetary_metric"), (_WORD("share", "shares", "per share"), "share_metric"),
    (_WORD("thousand", "thousands", "million", "millions", "billion", "billions", "basis point", "basis points"), "scaling_factor"),
]
_CLEAN = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(q || '  at ' || t, '\s+', ' ', 'g'), '\b(19|20)[0-9][0-9]\b', 'a reporting period', 'g'), '[$]\s*[0-9][0-9,]*([.][0-9]+)?', 'a monetary value', 'g'), '\b[0-9]{1,3}(,[0-9]{3})+\b', 'a numeric value', 'g'), '\b[0-9]+[.][0-9]+\b', 'a numeric value', 'g'), '\b([2-9]|[0-9]{2,})\b', 'a numeric value', 'g'), '\s+', ' ', 'g'))"""
_LEAK = lambda name, p: f"list_transform(regexp_extract_all(q || ' at ' || t, '{p}'), lambda h: ['{name}', h])"
_TOKEN = "VALUES " + ", ".join(f"({i}, '{v}')" for i, v in enumerate(TOKENS.values()))
_N = len(TOKENS)
_FACTOR = "[" + ", ".join(map(repr, _FACTORS)) + "]"
ORACLES = {
    "h5_sanitize": f"WITH {_Q} SELECT o_orderkey, {_CLEAN} AS clean FROM q",
    "h6_leak_hits": f"""WITH {_Q} SELECT o_orderkey, array_to_string(list_transform(list_filter(list_concat({_LEAK("four_digit_year", "\\b(?:19|20)[0-9][0-9]\\b")}, {_LEAK("currency_or_large_number", "[$]\\s*[0-9]|\\b[0-9]{1,3}(?:,[0-9]{3})+\\b|\\b[0-9]+[.][0-9]+\\b")}, {_LEAK("standalone_number", "\\b[0-9]+\\b")}), lambda h: h[2] NOT IN ('0', '1')), lambda h: h[1] || '=' || h[2]), ';') AS leaks FROM q""",
    "h7_normalize_answer": f"WITH t(i, v) AS ({_TOKEN}) SELECT o_orderkey, array_to_string(list_filter([a.v, 'of', b.v, c.v], lambda x: x <> ''), ' ') AS answer FROM orders JOIN t a ON a.i = (o_orderkey * 7 + 2) % {_N} JOIN t b ON b.i = (o_orderkey * 11 + 4) % {_N} JOIN t c ON c.i = (o_orderkey * 5 + 9) % {_N}",
    "h9_question_type": f"WITH {_Q} SELECT CASE WHEN regexp_matches(y, '^(is|are|was|were|did|does|do|has|have|can|will) ') THEN 'yes/no?' WHEN regexp_matches(y, '^what ') THEN 'what' WHEN regexp_matches(y, '^how much') THEN 'how_much' WHEN regexp_matches(y, '^how many') THEN 'how_many' ELSE 'other' END AS qtype, count(*) AS n, min(q) AS first FROM y GROUP BY 1",
    "h10_question_family": f"""WITH {_Q} SELECT o_orderkey, {_FIRST} AS family, {_SECOND} AS predicted, {_THIRD} AS recorded, concat_ws(',', {", ".join(f"CASE WHEN {c} THEN 'asks_{n}' END" for c, n in ((_PERCENT, "percent"), (_RATIO, "ratio"), (_CHANGE, "change"), (_MEAN, "average"), (_SUM, "sum"), (_COMPARE, "compare"), (_EXTREME, "maxmin")))}) AS flags FROM y""",
    "h10_rule_sets": f"WITH {_Q} SELECT {_FIRST} AS first, {_SECOND} AS second, {_THIRD} AS third, count(*) AS n FROM y GROUP BY ALL",
    "h11_roles": f"""WITH {_Q} SELECT o_orderkey, array_to_string(list_sort(list_filter([{", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in _ROLE)}], lambda r: r IS NOT NULL)), ',') AS roles, CASE WHEN contains(y, '%') OR contains(y, 'percent') THEN 'percent' WHEN contains(y, 'billion') OR contains(y, '(in b') THEN 'billion' WHEN contains(y, 'million') THEN 'million' WHEN contains(y, 'thousand') THEN 'thousand' ELSE 'none' END AS scale FROM y""",
    "h12_scale_profiles": f"WITH {_Q}, w AS (SELECT o_orderkey, lower(a) AS a, lower(q || ' ' || a || ' ' || (['', 'basis points', 'thousand'])[o_orderkey % 3 + 1]) AS w FROM q) SELECT o_orderkey, regexp_matches(w, '%|percent') AS asks_or_outputs_percent, regexp_matches(w, 'fraction|0-1') OR regexp_matches(a, '\\b0[.][0-9]') AS fraction_convention, NOT (regexp_matches(a, '%|percent') OR regexp_matches(w, 'fraction|0-1')) AS raw_number_convention, contains(w, 'million') AS has_million, contains(w, 'billion') AS has_billion, contains(w, 'thousand') AS has_thousand, contains(w, 'basis point') AS has_basis_points, regexp_matches(w, 'million|billion|thousand|basis point') AS has_scale_word FROM w",
    "h30_error_classes": f"""WITH x AS (SELECT o_orderkey, CASE o_orderkey % 13 WHEN 0 THEN 0.0 WHEN 1 THEN 50.0 ELSE floor(o_totalprice) END::DOUBLE AS g FROM orders), p AS (SELECT *, CASE WHEN o_orderkey % 17 <> 0 THEN g * ({_FACTOR})[o_orderkey % 12 + 1]::DOUBLE END AS p FROM x),
r AS (SELECT *, CASE WHEN g = 0 THEN 'inf'::DOUBLE ELSE p / g END AS r FROM p)
SELECT o_orderkey, CASE WHEN p IS NOT NULL AND (abs(r - 100) < 1 OR abs(r - 0.01) < 0.001) THEN 'scale_percent_error' WHEN p IS NOT NULL AND (abs(r - 1000) < 10 OR abs(r - 0.001) < 0.00001) THEN 'scale_thousands_error' WHEN abs(p) < 0.01 AND abs(g) > 100 THEN 'wrong_operands_zero_result'
WHEN greatest(abs(g), abs(p)) > 0 AND abs(p - g) / greatest(abs(g), abs(p)) < 0.05 THEN 'calculation_error_small' WHEN o_orderkey % 5 = 0 THEN 'returned_list_instead_of_sum' ELSE 'wrong_extraction_or_logic' END AS kind FROM r""",
    "h30_failure_classes": "SELECT o_orderkey % 12 AS form, CASE o_orderkey % 12 WHEN 0 THEN 'numeric_close' WHEN 1 THEN 'numeric_wrong_value' WHEN 2 THEN 'numeric_scale_error' WHEN 3 THEN 'string_partial_match' WHEN 4 THEN 'string_no_match' WHEN 5 THEN 'list_length_mismatch_2_vs_1' WHEN 6 THEN 'list_wrong_elements' WHEN 7 THEN 'type_mismatch_int_to_str' WHEN 8 THEN 'type_mismatch_float_to_int' WHEN 9 THEN 'type_mismatch_NoneType_to_int' WHEN 10 THEN 'numeric_scale_error' ELSE 'other' END AS kind, count(*) AS n FROM orders GROUP BY ALL",
}
