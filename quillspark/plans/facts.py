"""Queries of fact retrieval within documents, alignment and likeness of bags, stored accumulators and strict execution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import programs as P
from ..operators import accumulators as S
from ..operators import facts as V
from ..operators import matching as M
from ..sources.files import scratch
from .programs import _programs

DIMS, K = 16, 2


def j25(spark, sf_dir):
    """Of each conversation's turns the two nearest to its first one, and the program's numbers that they hold."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    c = c.groupBy("conv_id", "turn").agg(F.min(F.concat_ws(" ", "text", (F.col("turn") * 3).cast("string"), F.lit("and"), (F.col("conv_id") % 4 * 2.5).cast("string"))).alias("text")).withColumnRenamed("conv_id", "id")
    first = c.groupBy("id").agg(F.min_by("text", "turn").alias("text"), F.min("turn").alias("turn"))
    facts = c.join(first.select("id", F.col("turn").alias("first")), "id").where("turn > first").select("id", F.col("turn").alias("fact"), "text")
    program = F.concat(F.lit("divide("), (F.col("id") % 4 * 2.5).cast("string"), F.lit(", const_100), add(#0, "), (F.col("turn") * 3 + 3).cast("string"), F.lit("%)"))
    q = first.withColumn("program", program)
    got = V.operand_coverage(q, V.top_facts(first.select("id", "text"), facts, K, DIMS))
    return got.select("id", F.col("wanted").cast("long").alias("wanted"), F.col("found").cast("long").alias("found"), F.round("coverage", 6).alias("coverage"), "covered")


def _bags(sizes, seed):
    """Up to three bags of words that follow from the key."""
    word = lambda a, m: F.concat(F.lit("w"), ((F.col("o_orderkey") * a + seed) % m).cast("string"))
    bags = [F.array(word(3 + i, 5), word(7 * i + 1, 4), F.lit("x")) for i in range(3)]
    return F.slice(F.array(*bags), 1, sizes)


def k2(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", _bags(F.col("o_orderkey").cast("int") % 4, 0).alias("a"), _bags(F.col("o_orderkey").cast("int") % 3 + 1, 2).alias("b"))
    return M.aligned(o, "a", "b").select("o_orderkey", "f1")


def d15b(spark, sf_dir):
    """Events by type, accumulated in batches of which one is written twice, merged and finished."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("w", F.col("user_id") % 3)
    folder = scratch(spark)
    for batch in (2, 0, 1, 3, 0):
        S.commit(S.states(e.where(F.col("event_id") % 4 == batch), "value", "event_type", weight="w"), folder, f"b{batch}")
    done = S.finished(S.merged(S.stored(spark, folder), "event_type"), "event_type")
    return done.select("event_type", *(F.round(c, 6).alias(c) for c in ("n", "mean", "sd", "least", "most")))


def d16b(spark, sf_dir):
    """Medians from merged sketches, held against the exact rank: the share of values below them is near a half."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("value is not null")
    folder = scratch(spark)
    for batch in range(3):
        S.commit(S.states(e.where(F.col("event_id") % 3 == batch), "value", "event_type", quantiles=True), folder, f"b{batch}")
    done = S.finished(S.merged(S.stored(spark, folder), "event_type"), "event_type")
    near = e.join(done.select("event_type", "median"), "event_type").groupBy("event_type").agg(F.avg((F.col("value") <= F.col("median")).cast("double")).alias("share"), F.count("*").alias("n"))
    return near.select("event_type", "n", (F.abs(F.col("share") - 0.5) < 0.05).alias("near"))


def _lines(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey")
    return li.agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("ls"))  # seven lines at most


def b7(spark, sf_dir):
    """Lines that hold a keyword whatever the blanks, or all of them."""
    items = F.transform("ls", lambda x: F.concat(x["l_returnflag"], F.lit("  "), x["l_linenumber"].cast("string")))
    keyword = F.concat(F.lit("r "), (F.col("l_orderkey") % 4 + 1).cast("string"))
    return _lines(spark, sf_dir).select("l_orderkey", F.array_join(A.keep_keyword(items, keyword), ",").alias("kept"))


def h33(spark, sf_dir):
    part = lambda early: F.transform(F.filter("ls", lambda x: (x["l_linenumber"] <= 3) == F.lit(early)), lambda x: x["l_returnflag"])
    return _lines(spark, sf_dir).select("l_orderkey", F.round(A.multiset_cosine(part(True), part(False)), 6).alias("cosine"))


def j11(spark, sf_dir):
    """Programs that must execute: a failure would fail the query."""
    p = _programs(spark, sf_dir).where((F.col("o_orderkey") % 7).isin(0, 1, 2, 4))
    run = P.execute(P.parse_linear(F.col("program")), F.col("table"))
    return p.withColumn("run", run).select("o_orderkey", P.require(F.col("run"), F.col("program")).alias("value"))


QUERIES = {"j25_fact_coverage": j25, "k2_bag_alignment": k2, "d15_stored_states": d15b, "d16_sketch_states": d16b, "b7_keyword_filter": b7, "h33_multiset_cosine": h33, "j11_strict_executor": j11}

_SLOTS = "SELECT id, fact, h % 16 AS slot, sum(CASE WHEN (h // 16) % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS v FROM (SELECT id, fact, ('0x' || substr(md5(unnest(regexp_extract_all(lower(text), '[a-z0-9]+'))), 1, 8))::BIGINT AS h FROM t) GROUP BY ALL"
_BAG = lambda seed: "[" + ", ".join(f"['w' || ((o_orderkey * {3 + i} + {seed}) % 5), 'w' || ((o_orderkey * {7 * i + 1} + {seed}) % 4), 'x']" for i in range(3)) + "]"
_F1 = lambda i, j: f"CASE WHEN len(a) < {i} OR len(b) < {j} THEN 0 ELSE 2.0::DOUBLE * len(list_intersect(a[{i}], b[{j}])) / (len(list_distinct(a[{i}])) + len(list_distinct(b[{j}]))) END"
_BEST = ", ".join(" + ".join(_F1(i + 1, j) for i, j in enumerate(p)) for p in ((1, 2, 3), (1, 3, 2), (2, 1, 3), (2, 3, 1), (3, 1, 2), (3, 2, 1)))
ORACLES = {
    "j25_fact_coverage": f"""WITH t AS (SELECT conv_id AS id, turn AS fact, min(text || ' ' || turn * 3 || ' and ' || (conv_id % 4 * 2.5)::DECIMAL(9, 1)) AS text FROM conversations GROUP BY ALL), s AS ({_SLOTS}), n AS (SELECT *, v / sqrt(sum(v * v) OVER (PARTITION BY id, fact)) AS w FROM s WHERE v <> 0),
f AS (SELECT id, min(fact) AS first FROM t GROUP BY id), d AS (SELECT t.id, t.fact, round(coalesce(sum(a.w * b.w), 0), 5) AS score FROM t JOIN f ON f.id = t.id AND t.fact > f.first LEFT JOIN n a ON a.id = t.id AND a.fact = t.fact LEFT JOIN n b ON b.id = t.id AND b.fact = f.first AND b.slot = a.slot GROUP BY ALL),
r AS (SELECT id, fact FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, fact) <= 2), h AS (SELECT id, flatten(list(list_transform(regexp_extract_all(text, '-?[0-9]+(?:[.][0-9]+)?'), lambda x: x::DOUBLE))) AS held FROM r JOIN t USING (id, fact) GROUP BY id),
w AS (SELECT f.id, [f.id % 4 * 2.5::DOUBLE, (f.first * 3 + 3)::DOUBLE] AS n, coalesce(held, []) AS held FROM f LEFT JOIN h USING (id)), c AS (SELECT id, len(list_filter(n, lambda x: list_contains(held, x))) AS found FROM w)
SELECT id, 2::BIGINT AS wanted, found::BIGINT AS found, round(found / 2.0::DOUBLE, 6) AS coverage, found = 2 AS covered FROM c""",
    "k2_bag_alignment": f"WITH x AS (SELECT o_orderkey, ({_BAG(0)})[:(o_orderkey % 4)] AS a, ({_BAG(2)})[:(o_orderkey % 3 + 1)] AS b FROM orders) SELECT o_orderkey, round(greatest({_BEST}) / greatest(len(a), len(b))::DOUBLE, 2) AS f1 FROM x",
    "d15_stored_states": "WITH e AS (SELECT event_type, value, (user_id % 3)::DOUBLE AS w FROM events WHERE value IS NOT NULL), s AS (SELECT event_type, sum(w) AS n, sum(value * w) AS t, sum(value * value * w) AS q, min(value) AS least, max(value) AS most FROM e GROUP BY ALL) SELECT event_type, round(n, 6) AS n, round(t / n, 6) AS mean, round(sqrt(greatest(q / n - (t / n) * (t / n), 0)), 6) AS sd, round(least, 6) AS least, round(most, 6) AS most FROM s",
    "d16_sketch_states": "SELECT event_type, count(value) AS n, true AS near FROM events WHERE value IS NOT NULL GROUP BY ALL",
    "b7_keyword_filter": "WITH i AS (SELECT l_orderkey, list(l_returnflag || '  ' || l_linenumber ORDER BY l_linenumber, l_returnflag) AS ls FROM lineitem GROUP BY ALL), k AS (SELECT *, list_filter(ls, lambda x: contains(lower(replace(x, ' ', '')), 'r' || (l_orderkey % 4 + 1))) AS kept FROM i) SELECT l_orderkey, array_to_string(CASE WHEN len(kept) > 0 THEN kept ELSE ls END, ',') AS kept FROM k",
    "h33_multiset_cosine": "WITH c AS (SELECT l_orderkey, l_returnflag, count(*) FILTER (l_linenumber <= 3) AS a, count(*) FILTER (l_linenumber > 3) AS b FROM lineitem GROUP BY ALL) SELECT l_orderkey, round(CASE WHEN sum(a) = 0 OR sum(b) = 0 THEN 0 ELSE sum(a * b) / sqrt(sum(a * a)) / sqrt(sum(b * b)) END::DOUBLE, 6) AS cosine FROM c GROUP BY l_orderkey",
    "j11_strict_executor": "WITH q AS (SELECT l_orderkey AS o_orderkey, sum(l_quantity::BIGINT) AS s, max(l_quantity::BIGINT) AS m FROM lineitem GROUP BY ALL) SELECT o_orderkey, round(CASE o_orderkey % 7 WHEN 0 THEN (floor(o_totalprice) - 100) / 2 WHEN 1 THEN s WHEN 2 THEN m + floor(o_totalprice) ELSE (floor(o_totalprice) > 150000)::INT END::DOUBLE, 5) AS value FROM orders JOIN q USING (o_orderkey) WHERE o_orderkey % 7 IN (0, 1, 2, 4)",
}
