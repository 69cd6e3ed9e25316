"""Queries of text, HTML, numeric-text, JSON and array functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import numbers as N
from ..functions import text as X


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _long(c):
    return c.cast("long")


def h1(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(X.collapse(F.col("text")).cast("binary")).alias("md5"), X.truncate(F.col("text"), 20).alias("short"))


def h3(spark, sf_dir):
    t = X.norm_tokens(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", _long(F.size(t)).alias("tokens"), _long(X.token_estimate(F.col("text"))).alias("estimate"))


def _phrases(spark, sf_dir):
    """Short made-up sentences with numbers, years, money and percentages from orders."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    y = F.year("o_orderdate").cast("string")
    price = F.floor("o_totalprice").cast("long").cast("string")
    s = F.concat(F.lit("What was the change in total of order "), F.col("o_orderkey").cast("string"), F.lit(" from "), y, F.lit(" worth $"), price, F.lit(" at "), (F.col("o_orderkey") % 100).cast("string"), F.when(F.col("o_orderkey") % 3 == 0, F.lit("% in million")).otherwise(F.lit(" of the prior share")))
    return o.select("o_orderkey", s.alias("s"))


_S = "SELECT o_orderkey, 'What was the change in total of order ' || o_orderkey || ' from ' || year(o_orderdate) || ' worth $' || floor(o_totalprice)::BIGINT || ' at ' || (o_orderkey % 100) || CASE WHEN o_orderkey % 3 = 0 THEN '% in million' ELSE ' of the prior share' END AS s FROM orders"


def h4(spark, sf_dir):
    return _phrases(spark, sf_dir).select("o_orderkey", X.question_template(F.col("s")).alias("years_first"), X.question_template(F.col("s"), False).alias("numbers_first"))


def h19(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    t = X.html_to_text(F.col("html"))
    return p.select("page_id", _long(F.size(F.split(t, "\n"))).alias("lines"), F.md5(t.cast("binary")).alias("md5"))


def h21(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", X.hierarchy_markers(F.col("html")).alias("m")).select("page_id", "m.*")


def _cells(spark, sf_dir):
    """Numbers of lines as text in the forms that documents use."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    q, k = F.col("l_quantity").cast("long").cast("string"), F.col("l_orderkey") % 6
    x = F.when(k == 0, q).when(k == 1, F.concat(F.lit("$"), q, F.lit(",000"))).when(k == 2, F.concat(q, F.lit("%"))).when(k == 3, F.concat(F.lit("const_"), q)).when(k == 4, F.concat(F.lit("-"), q, F.lit(".5"))).otherwise(F.concat(F.lit("("), q, F.lit(") x")))
    return li.select("l_orderkey", x.alias("x"))


_C = "SELECT l_orderkey, l_orderkey % 6 AS k, l_quantity::BIGINT AS q FROM lineitem"


def h22(spark, sf_dir):
    x = F.col("x")
    return _cells(spark, sf_dir).select("l_orderkey", F.round(N.strict_number(x), 6).alias("strict"), F.round(N.lenient_number(x), 6).alias("lenient"), F.round(N.unsigned_number(x), 6).alias("unsigned"))


def h24(spark, sf_dir):
    return _cells(spark, sf_dir).select("l_orderkey", N.last_number(F.concat(F.lit("it was "), F.col("x"))).alias("n")).select("l_orderkey", "n.value", "n.percent")


def h26(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_totalprice").alias("g"), (F.col("o_totalprice") * F.element_at(F.array(*(F.lit(f) for f in (1.0, 100.0, 0.01, 1000.0, 1.004, 2.0))), (F.col("o_orderkey") % 6 + 1).cast("int"))).alias("p"))
    return o.select("o_orderkey", N.same_at(F.col("p"), F.col("g"), 2).alias("same"), N.close(F.col("p"), F.col("g"), rel=0.01).alias("close"), N.scale_tolerant(F.col("p"), F.col("g")).alias("tolerant"), N.error_class(F.col("p"), F.col("g")).alias("kind"))


def h29(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.sum("l_tax").alias("a"), F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0)).alias("b"))
    return li.select("l_orderkey", F.round(N.safe_ratio(F.col("a"), F.col("b")), 9).alias("ratio"))


def h32(spark, sf_dir):
    y = A.years(F.col("s"))
    return _phrases(spark, sf_dir).select("o_orderkey", _long(F.size(y)).alias("n"), _long(F.get(y, F.lit(0))).alias("first_year"))


def _sequences(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda s: s["event_type"]).alias("s"))


_SEQ = "s AS (SELECT user_id, list(event_type ORDER BY event_id) AS s FROM events GROUP BY user_id)"


def h34(spark, sf_dir):
    a, b = _sequences(spark, sf_dir), _sequences(spark, sf_dir).select((F.col("user_id") - 1).alias("user_id"), F.col("s").alias("t"))
    return a.join(b, "user_id").select("user_id", F.round(A.edit_similarity(F.col("s"), F.col("t")), 9).alias("alignment"), F.round(A.multiset_cosine(F.col("s"), F.col("t")), 9).alias("multiset"), F.round(A.jaccard(F.col("s"), F.col("t")), 9).alias("jaccard"), F.round(A.bag_f1(F.col("s"), F.col("t")), 9).alias("f1"), F.array_join(F.array_sort(F.array_except("s", "t")), ",").alias("extra"))


def h38(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    m = F.from_json(X.json_object(F.concat(F.lit("noise "), F.col("props"), F.lit(" tail"))), "map<string,string>")
    return e.select("event_id", F.try_element_at(m, F.lit("k")).try_cast("long").alias("k"), m.isNotNull().alias("ok"))


def h18(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return n.select("l_orderkey", X.count_label(F.col("n")).alias("label"))


def b13(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda s: s["role"]).alias("pool"))
    v = A.valid_refs(F.array(F.lit(0), (F.col("conv_id") % 7).cast("int"), F.lit(-1)), F.col("pool"))
    return o.select("conv_id", F.explode(v).alias("v")).select("conv_id", F.col("v.ref").cast("long").alias("ref"), "v.valid", "v.value").distinct()


def b6(spark, sf_dir):
    s = _sequences(spark, sf_dir)
    return s.select("user_id", F.array_join(A.keep_or_all(F.col("s"), lambda x: x == "purchase"), ",").alias("kept"))


def b16(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("u", F.regexp_replace("url", "^[a-z]+://", ""))
    return p.select("page_id", X.company_of(F.col("u")).alias("company"), X.report_of(F.col("u")).alias("report"))


_YEAR, _NUM = "regexp_replace({0}, '\\b(19|20)[0-9][0-9]\\b', '<year>', 'g')", "regexp_replace({0}, '[$]?[0-9][0-9,]*([.][0-9]+)?%?', '<num>', 'g')"
_LOW = "trim(regexp_replace(lower(s), '\\s+', ' ', 'g'))"


QUERIES = {
    "b6_filter_with_fallback": b6, "b13_reference_validity": b13, "b16_id_parts": b16, "h1_collapse_truncate": h1, "h3_tokens": h3, "h4_question_template": h4, "h18_count_label": h18, "h19_html_to_text": h19, "h21_hierarchy_markers": h21,
    "h22_number_dialects": h22, "h24_last_number": h24, "h26_tolerant_equality": h26, "h29_safe_ratio": h29, "h32_years": h32, "h34_sequence_similarity": h34, "h38_json_from_noise": h38,
}
ORACLES = {
    "b6_filter_with_fallback": f"WITH {_SEQ} SELECT user_id, array_to_string(CASE WHEN list_contains(s, 'purchase') THEN list_filter(s, lambda x: x = 'purchase') ELSE s END, ',') AS kept FROM s",
    "b13_reference_validity": "WITH p AS (SELECT conv_id, list(role ORDER BY turn, role) AS pool FROM conversations GROUP BY conv_id) SELECT DISTINCT conv_id, ref, ref >= 0 AND ref < len(pool) AS valid, CASE WHEN ref >= 0 THEN pool[ref + 1] END AS value FROM (SELECT conv_id, pool, unnest([0, conv_id % 7, -1]) AS ref FROM p)",
    "b16_id_parts": "WITH u AS (SELECT page_id, string_split(regexp_replace(url, '^[a-z]+://', ''), '/') AS p FROM pages) SELECT page_id, p[1] AS company, array_to_string(p[1:2], '/') AS report FROM u",
    "h1_collapse_truncate": r"SELECT doc_id, md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS md5, CASE WHEN length(text) > 20 THEN rtrim(left(text, 20)) || '...' ELSE text END AS short FROM documents",
    "h3_tokens": r"SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+(?:-[a-z0-9]+)?|%')) AS tokens, len(regexp_extract_all(text, '[A-Za-z0-9]+|[^\sA-Za-z0-9]')) AS estimate FROM documents",
    "h4_question_template": f"SELECT o_orderkey, {_NUM.format(_YEAR.format(_LOW))} AS years_first, {_YEAR.format(_NUM.format(_LOW))} AS numbers_first FROM ({_S})",
    "h18_count_label": "SELECT l_orderkey, (['zero', 'one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight'])[count(*) + 1] AS label FROM lineitem GROUP BY l_orderkey",
    "h21_hierarchy_markers": "SELECT page_id, len(regexp_extract_all(html, 'rowspan')) AS rowspans, len(regexp_extract_all(html, 'colspan')) AS colspans, len(regexp_extract_all(html, '<th')) AS heads, len(regexp_extract_all(html, '<li')) AS items, len(regexp_extract_all(html, '<p')) AS paragraphs FROM pages",
    "h19_html_to_text": r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?i)</(tr|p|div|li|h[1-6])\s*>', chr(10), 'g'), '(?i)<(td|th)[^>]*>', '|', 'g'), '<[^>]*>', '', 'g') AS y FROM pages),
b AS (SELECT page_id, list_filter(list_transform(string_split(y, chr(10)), lambda l: array_to_string(list_filter(list_transform(string_split(l, '|'), lambda c: trim(regexp_replace(c, '[ \t\r]+', ' ', 'g'))), lambda c: c <> ''), ' | ')), lambda l: l <> '') AS ls FROM a)
SELECT page_id, greatest(len(ls), 1) AS lines, md5(array_to_string(ls, chr(10))) AS md5 FROM b""",
    "h22_number_dialects": f"SELECT l_orderkey, round(CASE k WHEN 0 THEN q WHEN 1 THEN q * 1000 WHEN 2 THEN q / 100 WHEN 3 THEN q WHEN 4 THEN -q - 0.5 END, 6)::DOUBLE AS strict, round(CASE k WHEN 0 THEN q WHEN 2 THEN q / 100 WHEN 3 THEN q WHEN 4 THEN -q - 0.5 END, 6)::DOUBLE AS lenient, round(CASE k WHEN 0 THEN q WHEN 1 THEN q * 1000 WHEN 2 THEN q WHEN 3 THEN q WHEN 4 THEN q + 0.5 END, 6)::DOUBLE AS unsigned FROM ({_C})",
    "h24_last_number": f"SELECT l_orderkey, CASE k WHEN 1 THEN q * 1000 WHEN 4 THEN -q - 0.5 WHEN 5 THEN -q ELSE q END::DOUBLE AS value, k = 2 AS percent FROM ({_C})",
    "h26_tolerant_equality": "SELECT o_orderkey, o_orderkey % 6 = 0 AS same, o_orderkey % 6 IN (0, 4) AS close, o_orderkey % 6 IN (0, 1, 2) AS tolerant, CASE o_orderkey % 6 WHEN 0 THEN 'correct' WHEN 1 THEN 'percent_scale' WHEN 2 THEN 'percent_scale' WHEN 3 THEN 'thousands_scale' WHEN 4 THEN 'small_error' ELSE 'wrong' END AS kind FROM orders",
    "h29_safe_ratio": "SELECT l_orderkey, round(coalesce(sum(l_tax) / nullif(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END), 0), 0), 9) AS ratio FROM lineitem GROUP BY l_orderkey",
    "h32_years": f"SELECT o_orderkey, len(y) AS n, y[1]::BIGINT AS first_year FROM (SELECT o_orderkey, regexp_extract_all(s, '\\b((?:19|20)[0-9]{{2}})\\b', 1) AS y FROM ({_S}))",
    "h34_sequence_similarity": f"""WITH {_SEQ}, p AS (SELECT a.user_id, a.s, b.s AS t, list_distinct(list_concat(a.s, b.s)) AS u, list_intersect(list_distinct(a.s), list_distinct(b.s)) AS i FROM s a JOIN s b ON b.user_id = a.user_id + 1),
c AS (SELECT *, array_to_string(list_transform(s, lambda x: left(x, 1)), '') AS x, array_to_string(list_transform(t, lambda x: left(x, 1)), '') AS y, list_transform(u, lambda k: len(list_filter(s, lambda v: v = k))::DOUBLE) AS m, list_transform(u, lambda k: len(list_filter(t, lambda v: v = k))::DOUBLE) AS w, len(i) / len(list_distinct(s)) AS pr, len(i) / len(list_distinct(t)) AS re FROM p)
SELECT user_id, round(1 - levenshtein(x, y) / greatest(length(x), length(y)), 9) AS alignment, round(list_inner_product(m, w) / (sqrt(list_inner_product(m, m)) * sqrt(list_inner_product(w, w))), 9) AS multiset, round(len(i) / len(u), 9) AS jaccard, round(CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END, 9) AS f1, array_to_string(list_sort(list_filter(list_distinct(s), lambda v: NOT list_contains(t, v))), ',') AS extra FROM c""",
    "h38_json_from_noise": "SELECT event_id, regexp_extract(props, '\"k\": ?([0-9]+)', 1)::BIGINT AS k, true AS ok FROM events",
}
