"""Exact vector search: cosine top-k joins with deterministic ties, exclusions, voting and de-duplication."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import dot, norm, unit
from ..shipping import ship

#: Bytes of query vectors up to which they are sent to every task.
SENT_BYTES = 32 << 20
#: Beyond that: queries of a block and sources of a group that meet in a task.
QUERIES, SOURCES = 4_096, 65_536
#: Scores (queries times rows of vectors) that a task holds at a time.
SCORES = 4 << 20


def best_columns(s: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k highest scores of each row, in no order; of equal scores those that come first."""
    if s.shape[1] <= k:
        return np.broadcast_to(np.arange(s.shape[1]), s.shape)
    least = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
    above, level = s > least, s == least
    take = above | (level & (np.cumsum(level, axis=1) <= k - above.sum(1, keepdims=True)))
    return np.nonzero(take)[1].reshape(len(s), k)


class _Queries:
    """A block of queries and the k best sources that each has met."""

    def __init__(self, ids: np.ndarray, vectors: pa.Array, grp: list, k: int, digits: int, exclude: str | None) -> None:
        self.ids, self.k, self.digits, self.exclude = ids, k, digits, exclude
        self.x = _unit_rows(vectors, len(ids))
        self.codes = {g: i for i, g in enumerate(dict.fromkeys(grp))}
        self.grp = np.array([self.codes[g] for g in grp], np.int64)
        self.s, self.i = np.full((len(ids), 0), -np.inf), np.zeros((len(ids), 0), np.int64)

    def meet(self, sid: np.ndarray, vectors: pa.Array, grp: list) -> None:
        step = max(1, SCORES // max(1, len(self.ids)))
        for at in range(0, len(sid) if len(self.ids) else 0, step):
            own = np.arange(at, min(at + step, len(sid)))
            own = own[np.argsort(sid[own], kind="stable")]  # of equal scores the smaller id comes first
            part = sid[own]
            s = np.rint(self.x @ _unit_rows(vectors.take(pa.array(own)), len(own)).T * 10**self.digits) / 10**self.digits
            s[self.ids[:, None] == part[None]] = -np.inf
            if self.exclude:
                same = self.grp[:, None] == np.array([self.codes.get(grp[r], -1) for r in own], np.int64)[None]
                s[same if self.exclude == "same" else ~same] = -np.inf
            some = best_columns(s, self.k)
            s, i = np.hstack([self.s, np.take_along_axis(s, some, 1)]), np.hstack([self.i, part[some]])
            order = np.lexsort((i, -s), axis=1)[:, : self.k]
            self.s, self.i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)

    def found(self) -> pa.RecordBatch:
        ok = np.isfinite(self.s)
        return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(self.ids[:, None], ok.shape)[ok]), pa.array(self.i[ok]), pa.array(self.s[ok])], names=["target_id", "source_id", "score"])


def _unit_rows(vectors: pa.Array, n: int) -> np.ndarray:
    if not n:
        return np.zeros((0, 0))
    y = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)


def top_k(queries: DataFrame, sources: DataFrame, k: int = 3, digits: int = 7, exclude: str | None = None) -> DataFrame:
    """(target_id, rank, source_id, score): the k sources of highest cosine for each query, ties by smaller id.

    queries: (target_id, vector, grp), sources: (source_id, vector, grp). A source is left out for the
    query of the same id, and with ``exclude='same'`` or ``'other'`` for those of the same or of
    another grp. Queries of up to ``SENT_BYTES`` are sent to where the sources are; more of them are dealt
    in blocks that meet groups of sources, a task each. Either way a task keeps only its k best sources a
    query, so what is shuffled for the ranking is queries times tasks times k, not queries times sources.
    """
    spark = queries.sparkSession
    ship(spark)
    of = lambda df, key: df.select(F.col(key).cast("long").alias("id"), F.transform("vector", lambda x: x.cast("double")).alias("vector"), F.col("grp").cast("string").alias("grp")).where("vector is not null")
    q, src = of(queries, "target_id"), of(sources, "source_id")
    count, width = q.agg(F.count("*"), F.max(F.size("vector"))).first()
    schema = "target_id long, source_id long, score double"
    if count * 8 * (width or 1) > SENT_BYTES:
        return ranked(_dealt(q, src, count, k, digits, exclude).select("target_id", "source_id", "score"), k)
    t = q.toArrow()  # SENT_BYTES at most
    sent = spark.sparkContext.broadcast((t.column("id").to_numpy(), t.column("vector").combine_chunks(), t.column("grp").to_pylist()))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Queries(*sent.value, k, digits, exclude)
        for b in batches:
            block.meet(b.column("id").to_numpy(), b.column("vector"), b.column("grp").to_pylist())
        yield block.found()

    return ranked(src.mapInArrow(score, schema), k)


def _dealt(q: DataFrame, src: DataFrame, count: int, k: int, digits: int, exclude: str | None) -> DataFrame:
    """The k best of every pair of a block of queries and a group of sources; a task streams the group past the block."""
    spark = q.sparkSession
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = src.count()
    blocks, groups = -(-count // QUERIES), max(-(-n // SOURCES), min(spread, -(-n // 1024)), 1)
    at = lambda parts: F.pmod(F.xxhash64("id"), F.lit(parts))
    each = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
    left = q.withColumn("own", at(blocks)).withColumn("other", each(groups)).select((F.col("own") * groups + F.col("other")).alias("task"), F.lit(0).alias("side"), "id", "vector", "grp")
    right = src.withColumn("own", at(groups)).withColumn("other", each(blocks)).select((F.col("other") * groups + F.col("own")).alias("task"), F.lit(1).alias("side"), "id", "vector", "grp")
    dealt = left.unionByName(right).repartition(max(spread, min(blocks * groups, 100_000)), "task").sortWithinPartitions("task", "side")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, block, held = None, None, []

        def opened() -> _Queries | None:
            if not held:
                return None
            t = pa.Table.from_batches(held)
            return _Queries(t.column("id").to_numpy(), t.column("vector").combine_chunks(), t.column("grp").to_pylist(), k, digits, exclude)

        for b in batches:
            keys = b.column("task").to_numpy() * 2 + b.column("side").to_numpy()
            edges = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1)) if len(keys) else []
            for i, start in enumerate(edges):
                part = b.slice(start, (edges[i + 1] if i + 1 < len(edges) else len(keys)) - start)
                now, side = divmod(int(keys[start]), 2)
                if now != task:
                    if block is not None:
                        yield block.found()
                    task, block, held = now, None, []
                if side == 0:
                    held.append(part)
                    continue
                if held:
                    block, held = opened(), []
                if block is not None:  # the hash may have left this block of queries empty
                    block.meet(part.column("id").to_numpy(), part.column("vector"), part.column("grp").to_pylist())
        if block is not None:
            yield block.found()

    return dealt.mapInArrow(score, "target_id long, source_id long, score double")


def ranked(found: DataFrame, k: int, *by: str) -> DataFrame:
    """The k best rows of each target by score, ties by smaller id."""
    w = W.partitionBy(*(by or ("target_id",))).orderBy(F.desc("score"), "source_id")
    return found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def raw_cosine(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with ``cosine`` of two vector columns that are not normalised; null for a zero vector."""
    return pairs.withColumn("cosine", F.try_divide(dot(F.col(a), F.col(b)), norm(F.col(a)) * norm(F.col(b))))


def hit_at_k(hits: DataFrame, targets: DataFrame, sources: DataFrame, key: str, k: int = 3) -> DataFrame:
    """By key of the target: share of targets with a hit of the same key at rank 1 and within k."""
    h = hits.join(targets.select("target_id", F.col(key).alias("want")), "target_id").join(sources.select("source_id", F.col(key).alias("got")), "source_id")
    per = h.groupBy("target_id", "want").agg(F.max((F.col("want").eqNullSafe(F.col("got")) & (F.col("rank") == 1)).cast("int")).alias("h1"), F.max((F.col("want").eqNullSafe(F.col("got")) & (F.col("rank") <= k)).cast("int")).alias("hk"))
    return per.groupBy(F.col("want").alias(key)).agg(F.count("*").alias("n"), F.avg("h1").alias("hit_1"), F.avg("hk").alias("hit_k"))


def anchored(hits: DataFrame, sources: DataFrame, families: DataFrame, k: int = 3) -> DataFrame:
    """Re-rank strategies by the votes of a target's retrieved cases, then by cosine; no votes leave all strategies.

    hits: (target_id, source_id, ...), sources: (source_id, struct), families: (strategy_id, family,
    target_id, cosine), one row for each family of a strategy and target.
    """
    votes = hits.join(sources, "source_id").join(families.select("strategy_id", "family", "target_id").distinct(), "target_id").where("struct = family").groupBy("target_id", "strategy_id").agg(F.count("*").alias("votes"))
    every = families.groupBy("target_id", "strategy_id").agg(F.max("cosine").alias("cosine"))
    j = every.join(votes, ["target_id", "strategy_id"], "left").withColumn("any", F.sum(F.coalesce("votes", F.lit(0))).over(W.partitionBy("target_id")))
    j = j.where("votes is not null or any = 0").withColumn("votes", F.coalesce("votes", F.lit(1)))
    w = W.partitionBy("target_id").orderBy(F.desc("votes"), F.desc("cosine"), "strategy_id")
    return j.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).select("target_id", "rank", "strategy_id", "votes", "cosine")


def best_of_family(hits: DataFrame, family: str, k: int = 3) -> DataFrame:
    """Of hits (target_id, source_id, score, family) the best of each family, then the k best."""
    w = W.partitionBy("target_id", family).orderBy(F.desc("score"), "source_id")
    return ranked(hits.drop("rank").withColumn("_f", F.row_number().over(w)).where("_f = 1").drop("_f"), k)


def crowding(hits: DataFrame, family: str) -> DataFrame:
    """How many distinct families a target's hits have: histogram."""
    per = hits.groupBy("target_id").agg(F.count_distinct(family).alias("families"))
    return per.groupBy("families").agg(F.count("*").alias("targets"))


def centroids(vectors: DataFrame, key: str, vec: str) -> DataFrame:
    """Element-wise mean of the vectors of each key."""
    x = vectors.select(key, F.posexplode(vec).alias("pos", "v")).groupBy(key, "pos").agg(F.avg(F.col("v").cast("double")).alias("m"))
    return x.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centroid"))


def check_hits(stored: DataFrame, live: DataFrame) -> DataFrame:
    """Violations (check, target_id) of stored (target_id, rank, source_id, score) against a recomputation."""
    j = stored.alias("s").join(live.alias("l"), (F.col("s.target_id") == F.col("l.target_id")) & (F.col("s.rank") == F.col("l.rank")), "full_outer")
    kind = F.when(F.col("s.target_id").isNull(), "missing").when(F.col("l.target_id").isNull(), "extra").when(F.col("s.source_id") != F.col("l.source_id"), "other_source").when(F.abs(F.col("s.score") - F.col("l.score")) > 1e-7, "other_score")
    a = j.select(kind.alias("check"), F.coalesce("s.target_id", "l.target_id").alias("target_id")).where("check is not null")
    w = W.partitionBy("target_id").orderBy("rank")
    b = stored.withColumn("before", F.lag("score").over(w)).where((F.col("score") > F.col("before")) | F.isnan("score") | F.col("score").isNull()).select(F.lit("not_descending").alias("check"), "target_id")
    return a.unionByName(b).distinct()


def cache(hits: DataFrame) -> DataFrame:
    """One row a target: ids and scores in rank order, with their mean, least and greatest score."""
    g = hits.groupBy("target_id").agg(F.array_sort(F.collect_list(F.struct("rank", "source_id", "score"))).alias("h"))
    s = F.transform("h", lambda x: x["score"])
    return g.select("target_id", F.transform("h", lambda x: x["source_id"]).alias("source_ids"), (F.aggregate(s, F.lit(0.0), lambda a, v: a + v) / F.size(s)).alias("mean"), F.array_min(s).alias("least"), F.array_max(s).alias("greatest"))


def hashed_vectors(texts: DataFrame, key: str, text: str, dims: int = 64, whole: bool = False) -> DataFrame:
    """(key, vector): an encoder without a model. Words fall into ``dims`` slots by hash, with a sign; the vector has length 1, or is zero without words.

    It is zero too where signs cancel in every slot; ``whole`` counts the words of such a text without signs.
    """
    w = F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z0-9]+"), F.lit(0)))
    h = F.conv(F.substring(F.md5(F.col("w")), 1, 8), 16, 10).cast("long")
    per = texts.select(key, w.alias("w")).select(key, (h % dims).cast("int").alias("slot"), F.when(F.floor(h / dims) % 2 == 0, 1).otherwise(-1).alias("sign")).groupBy(key, "slot").agg(F.sum("sign").cast("double").alias("v"), F.count("*").cast("double").alias("n"))
    held = F.collect_list(F.when(F.col("v") != 0, F.struct("slot", "v")))
    unsigned = F.collect_list(F.struct("slot", F.col("n").alias("v")))
    vec = per.groupBy(key).agg(F.map_from_entries(F.when(F.size(held) > 0, held).otherwise(unsigned) if whole else held).alias("m"))  # dims entries at most
    filled = texts.select(key).distinct().join(vec, key, "left").select(key, F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("v"))
    return filled.select(key, F.when(norm(F.col("v")) > 0, unit(F.col("v"))).otherwise(F.col("v")).alias("vector"))


def encoding_faults(stored: DataFrame, live: DataFrame, key: str, vec: str = "vector", near: float = 1e-6, unit_near: float = 1e-5) -> DataFrame:
    """(check, key) of stored vectors that are not what the encoder gives now: missing, length, other_values, not_unit."""
    j = stored.select(key, F.col(vec).alias("a")).join(live.select(key, F.col(vec).alias("b")), key, "full_outer")
    apart = F.array_max(F.zip_with("a", "b", lambda x, y: F.abs(x.cast("double") - y.cast("double"))))
    checks = F.array_compact(F.array(F.when(F.col("a").isNull() | F.col("b").isNull(), "missing"), F.when(F.size("a") != F.size("b"), "length"), F.when((F.size("a") == F.size("b")) & (apart > near), "other_values"), F.when(F.abs(norm(F.col("a")) - 1) > unit_near, "not_unit")))
    return j.select(F.explode(checks).alias("check"), key)


def family_hits(plain: DataFrame, anchored_hits: DataFrame, wanted: DataFrame, most: int = 3) -> DataFrame:
    """(k, baseline, anchored): share of targets with a strategy of the wanted family within the first k, for k up to ``most``.

    Both rankings: (target_id, rank, family), a row for each family of a strategy; wanted: (target_id, family).
    """
    first = lambda h, name: h.join(wanted.withColumnRenamed("family", "_want"), "target_id").where("family = _want").groupBy("target_id").agg(F.min("rank").alias(name))
    j = wanted.select("target_id").join(first(plain, "p"), "target_id", "left").join(first(anchored_hits, "a"), "target_id", "left")
    rate = lambda c: F.avg(F.coalesce((F.col(c) <= F.col("k")).cast("double"), F.lit(0.0)))
    return j.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(most)))).groupBy("k").agg(rate("p").alias("baseline"), rate("a").alias("anchored"))


def leading_dims(vectors: DataFrame, key: str, vec: str, n: int = 64) -> DataFrame:
    """The first n components of a vector as columns d0, d1, ...; null where it is shorter."""
    return vectors.select(key, *(F.get(F.col(vec), F.lit(i)).alias(f"d{i}") for i in range(n)))


def hit_rates(hits: DataFrame, targets: DataFrame, sources: DataFrame, key: str, k: int = 3) -> DataFrame:
    """(targets, eligible, top_1, top_k, eligible_top_1, eligible_top_k): over all targets, and over those of whose key a source exists at all."""
    h = hits.join(sources.select("source_id", F.col(key).alias("got")), "source_id").join(targets.select("target_id", F.col(key).alias("want")), "target_id").where(F.col("got").eqNullSafe(F.col("want")))
    best = h.groupBy("target_id").agg(F.min("rank").alias("best"))
    some = sources.select(F.col(key).alias("_k")).distinct().withColumn("_has", F.lit(True))
    t = targets.select("target_id", F.col(key).alias("want")).join(some, F.col("want").eqNullSafe(F.col("_k")), "left").join(best, "target_id", "left")
    ok = lambda n: F.coalesce((F.col("best") <= n).cast("double"), F.lit(0.0))
    has = F.coalesce("_has", F.lit(False))
    return t.agg(F.count("*").alias("targets"), F.count_if(has).alias("eligible"), F.avg(ok(1)).alias("top_1"), F.avg(ok(k)).alias("top_k"), F.avg(F.when(has, ok(1))).alias("eligible_top_1"), F.avg(F.when(has, ok(k))).alias("eligible_top_k"))


def index_defects(left: DataFrame, right: DataFrame, position: str, key: str) -> DataFrame:
    """(position, a, b) where two lists of ids, each with its own positions, do not hold the same id; also where one list has ended."""
    a, b = left.select(position, F.col(key).alias("a")), right.select(position, F.col(key).alias("b"))
    return a.join(b, position, "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
