"""Hard negatives by exact inner products behind bounds on rotated vectors.

Vectors are scaled to integers. An orthogonal rotation turns them so that the leading components carry
most of their length. For a block of anchors and a block of rows the products are summed over leading
components a few at a time; what the rest can add is at most the product of the two remaining norms. A
pair whose bound, widened by the rounding of doubles, is below what it would have to beat is dropped
early; the survivors' scores are integer products. The rotation only steers how early pairs are dropped.

Scale. Anchors are a hundredth of the rows and meet all of them, in blocks: a task holds one block of
``ANCHORS`` anchors and streams one group of ``GROUP`` rows past it, ``BATCH`` at a time, and keeps five
scores for each anchor (and positive). A row is shuffled once for each block of anchors, which costs little beside
the products it takes part in. Labels are dealt by hash, so a label that a third of all rows has is many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_rows, park, partitions

#: Anchors that a task holds, rows that it streams past them, and how many at a time.
ANCHORS, GROUP, BATCH = 2_048, 65_536, 2_048
#: Positives of an anchor and negatives of a positive.
FIRST = 5
#: Vectors that the rotation is fitted on at most (about), and bytes of them.
SAMPLE, SAMPLE_BYTES = 20_000, 32 << 20
#: Components summed at a time, and the share of pairs below which survivors are verified at once.
LEAD, FEW = 16, 0.02
#: Squared norms of scaled vectors from which products may leave 64 bits.
MOST_NORM = float(1 << 62)


def scaled(vec: Column) -> Column:
    """floor(256 x) of each component as a long."""
    return F.transform(vec, lambda x: F.floor(x * 256).cast("long"))


def usable(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(id, label, vec, d) of the rows that take part, one for each id."""
    v = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), v.alias("raw")).where("id is not null and label is not null and raw is not null")
    finite = ~F.exists("raw", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > 2.0**40))
    rows = rows.where(F.coalesce(finite, F.lit(False))).withColumn("vec", scaled(F.col("raw")))
    norm = F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    rows = rows.where(norm < MOST_NORM).groupBy("id").agg(F.min(F.struct("label", "raw", "vec")).alias("r"))
    label = F.when(F.col("id") % 7 == 0, (F.col("r.label") + 1) % 10).otherwise(F.col("r.label"))
    return rows.select("id", label.alias("label"), F.col("r.vec").alias("vec"), F.size("r.vec").alias("d"))


def rotations(rows: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vectors the eigenvectors of their second moments, largest first, from a sample by hash (``SAMPLE`` vectors and ``SAMPLE_BYTES`` at most, about)."""
    n, width = rows.agg(F.count("*"), F.max("d")).first()
    if not n:
        return {}
    most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * max(1, width))))
    some = rows.where(F.pmod(F.xxhash64("id", F.lit("turn")), F.lit(1 << 30)) < (1 << 30) * min(1.0, most / n)).select("d", "vec").limit(2 * most).toArrow()
    dims, out = some.column("d").to_numpy(), {}
    for d in np.unique(dims[dims > 0]).tolist():
        x = some.column("vec").filter(pa.array(dims == d)).combine_chunks().flatten().to_numpy().reshape(-1, d).astype(np.float64)
        out[d] = np.ascontiguousarray(np.linalg.eigh(x.T @ x)[1][:, ::-1])
    return out


class Block:
    """Vectors of one length: integers, rotated doubles, norms of what is left after each group of leading components."""

    def __init__(self, vec: pa.Array, d: int, turn: np.ndarray | None) -> None:
        self.whole = vec.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        x = self.whole.astype(np.float64)
        self.turned = x @ turn if turn is not None else x
        self.norm = np.linalg.norm(x, axis=1)
        cuts = range(0, d, LEAD)
        self.rest = [np.linalg.norm(self.turned[:, c + LEAD :], axis=1) for c in cuts]


def survivors(a: Block, b: Block, least: np.ndarray, may: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, score) of the pairs in ``may`` whose integer product is at least ``least`` of i; no such pair is missed."""
    d = a.whole.shape[1]
    # a rotated product in doubles is off by less than this, rotation and sums included
    slack = 8.0 * (d + 8) ** 1.5 * np.finfo(float).eps
    total = np.zeros(may.shape)
    for k, c in enumerate(range(0, d, LEAD)):
        total += a.turned[:, c : c + LEAD] @ b.turned[:, c : c + LEAD].T
        # norms are widened as well, so that their own rounding drops nothing
        bound = total + np.outer(a.rest[k], b.rest[k]) * (1 + slack) + slack * np.outer(a.norm, b.norm)
        may &= bound >= least[:, None]
        if may.sum() <= FEW * may.size:
            break
    i, j = np.nonzero(may)
    step = max(1, (8 << 20) // max(1, d))
    score = np.concatenate([np.zeros(0, np.int64), *(np.einsum("ij,ij->i", a.whole[i[s : s + step]], b.whole[j[s : s + step]]) for s in range(0, len(i), step))])
    good = score >= least[i]
    return i[good], j[good], score[good]


class Best:
    """The first ``FIRST`` (score, id) of each slot: higher scores first, ties by smaller id."""

    def __init__(self, slots: int) -> None:
        self.slot, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(slots, np.iinfo(np.int64).min)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        slot, score, ids = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        keep = place < FIRST
        self.slot, self.score, self.id = slot[keep], score[keep], ids[keep]
        full = place == FIRST - 1
        self.least[slot[full]] = score[full]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Table]]:
    """(task, rows) of tasks' rows that come sorted by task, anchors first; a task's other rows come ``BATCH`` at a time, so a group is never held whole."""
    held: list[pa.Table] = []
    now: tuple[str, bool] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        keys = list(zip(batch.column("task").to_pylist(), batch.column("anchor").to_pylist(), strict=True))
        at = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[at]:
                if held and (now != keys[at] or (not now[1] and sum(t.num_rows for t in held) >= BATCH)):
                    yield now[0], pa.concat_tables(held)
                    held = []
                now = keys[at]
                held.append(table.slice(at, i - at))
                at = i
    if held:
        yield now[0], pa.concat_tables(held)


def _dealt(anchors: DataFrame, rows: DataFrame, by: list[str]) -> DataFrame:
    """Anchors and rows of every pair of an anchor block and a row group that agree in ``by``, with the name of their task."""
    sizes = lambda df, most, name: df.groupBy(*by).agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias(name))
    parts = park(sizes(anchors, ANCHORS, "blocks").join(sizes(rows, GROUP, "groups"), by))
    own = lambda name: F.pmod(F.xxhash64("id"), F.col(name)).cast("int")
    task = lambda x, y: F.concat_ws("|", *by, x, y)
    left = anchors.join(parts, by).withColumn("at", own("blocks")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    right = rows.join(parts, by).withColumn("at", own("groups")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    columns = ["id", "label", "d", "vec"]
    none = F.array().cast("array<long>")
    left = left.select(task("at", "other").alias("task"), F.lit(True).alias("anchor"), *columns, *(c if c in anchors.columns else none.alias(c) for c in ("positives", "scores")))
    right = right.select(task("other", "at").alias("task"), F.lit(False).alias("anchor"), *columns, none.alias("positives"), none.alias("scores"))
    return left.unionByName(right)


def mine(anchors: DataFrame, rows: DataFrame, turns: dict[int, np.ndarray], negatives: bool) -> DataFrame:
    """(anchor, positive, id, score): for each anchor the first rows of its label (``positive`` null), or for each of its positives the first rows of other labels in that positive's band, of every task."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(turns)  # one square matrix for each length of vectors
    far = np.iinfo(np.int64).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, best, held = None, None, None

        def out() -> pa.RecordBatch:
            ids, _, _, slot_anchor, slot_positive, _, _ = held
            anchor = ids[slot_anchor[best.slot]]
            positive = pa.array(slot_positive[best.slot], pa.int64()) if negatives else pa.nulls(len(anchor), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), positive, pa.array(best.id, pa.int64()), pa.array(best.score, pa.int64())], names=["anchor", "positive", "id", "score"])

        for name, t in _batches(batches):
            t = t.combine_chunks()
            d = t.column("d")[0].as_py()
            if t.column("anchor")[0].as_py():
                if best is not None:
                    yield out()
                ids, label = t.column("id").to_numpy(), t.column("label").to_numpy()
                if negatives:
                    n = np.array([len(x) for x in t.column("scores").to_pylist()], np.int64)
                    slot_anchor = np.repeat(np.arange(len(ids)), n)
                    slot_positive, high = (t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("positives", "scores"))
                else:
                    slot_anchor, slot_positive, high = np.arange(len(ids)), ids, np.full(len(ids), far)
                low = np.array([-(-80 * int(s) // 100) for s in high], np.int64) if negatives else np.full(len(ids), -far)
                task, best, held = name, Best(len(slot_anchor)), (ids, label, Block(t.column("vec").combine_chunks(), d, sent.value.get(d)), slot_anchor, slot_positive, low, high)
                continue
            if name != task:  # the hash left this block of anchors empty
                continue
            ids, label, block, slot_anchor, _, low, high = held
            other, other_label = t.column("id").to_numpy(), t.column("label").to_numpy()
            may = (label[:, None] != other_label[None, :]) if negatives else (label[:, None] == other_label[None, :]) & (ids[:, None] != other[None, :])
            # what a row must reach to be among the first of any of the anchor's slots; a full slot's last score may be met by a smaller id
            need = np.full(len(ids), far)
            np.minimum.at(need, slot_anchor, np.where(low <= high, np.maximum(low, best.least), far))
            i, j, score = survivors(block, Block(t.column("vec").combine_chunks(), d, sent.value.get(d)), need, may)
            if negatives:
                order = np.argsort(slot_anchor, kind="stable")
                first, last = np.searchsorted(slot_anchor[order], [i, i + 1])
                for k in range(int((last - first).max()) if len(i) else 0):
                    has = np.flatnonzero(first + k < last)
                    slot = order[first[has] + k]
                    ok = (score[has] >= low[slot]) & (score[has] <= high[slot]) & (score[has] >= best.least[slot])
                    best.add(slot[ok], score[has][ok], other[j[has][ok]])
            else:
                best.add(i, score, other[j])
        if best is not None:
            yield out()

    dealt = _dealt(anchors, rows, ["d"] if negatives else ["d", "label"])
    dealt = dealt.repartition(partitions(spark), "task").sortWithinPartitions("task", F.desc("anchor"))
    return dealt.mapInArrow(run, "anchor long, positive long, id long, score long")


def hard_negatives(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); anchors are the rows whose id is divisible by 100.

    Rows with a null id, label or vector or with a null or non-finite component take no part, nor do
    empty vectors and those whose components pass 2^40 or whose squared norm passes 2^62 once scaled (their products leave
    64 bits). Vectors of other lengths than the anchor's are never compared. Rows that repeat an id are one
    row, the smallest by label and vector. An anchor without positives, or a positive without a row in its
    band (a negative score has none), gives no rows. Ties go to the smaller id.
    """
    spark = vectors.sparkSession
    arrow_rows(spark, BATCH)
    rows = park(usable(vectors, id_col, vec_col, label_col).where("d > 0"))
    turns = rotations(rows)
    anchors = rows.where("id % 100 = 0")
    first = lambda df, *by: df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), "id"))).where(F.col("rank") <= FIRST)
    positive = park(first(mine(anchors, rows, turns, False), "anchor").select("anchor", F.col("id").alias("positive"), "score"))
    wanted = positive.groupBy(F.col("anchor").alias("id")).agg(F.sort_array(F.collect_list(F.struct("positive", "score"))).alias("p"))  # FIRST for an anchor
    asked = anchors.join(wanted, "id").select("id", "label", "d", "vec", F.col("p.positive").alias("positives"), F.col("p.score").alias("scores"))
    found = first(mine(asked, rows, turns, True), "anchor", "positive").withColumnRenamed("score", "negative_score")
    out = found.join(positive, ["anchor", "positive"])
    return out.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("positive_score"), "negative_score")


def op13(spark, sf_dir):
    """Full result over ``embeddings``."""
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: All products of anchors and rows, without bounds.
OP13_SQL = """
WITH v AS (SELECT vec_id, label::BIGINT AS label, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0),
g AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY label, e) = 1),
x AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(e, lambda c: floor(256 * c)) AS e FROM g),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score FROM x a JOIN x b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b)::INT AS rank, n.b AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b) <= 5
"""
