"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, one representative a group.

Exactness. Two unit vectors whose cosine is at least ``t`` are at most ``sin(acos(t))`` apart in any
direction across a plane. If x lies in the cell of centroid a, y can only be linked to it if no other
centroid b beats a for y by more than that times the distance of a and b. So y is sent as a visitor to
every earlier cell of which that holds, and no link is lost. Pairs are compared where at least one of
the two is at home, which happens once.

Scale. Equal vectors are one weighted row before anything is compared. Cells hold rows of one label
and dimension. Labels of few rows are one cell; the centroids of the others are fitted on a sample of
their own rows, as many as their rows ask for. Where a codebook's cells would still hold too many rows
a second and third codebook part them again (a cell is then one centroid of each). A cell of many rows is
dealt in blocks of ``BLOCK`` rows and each pair of blocks is a task's matrix product. A pair of blocks
emits counts by row and a star for each group of linked rows, never the pairs themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, park, partitions, streamed, unpark
from .graph import connected_components

#: Rows of a block; a product of two blocks takes 8 * BLOCK**2 bytes.
BLOCK = 2048
#: Rows that a cell should hold at home.
CELL_ROWS = 8_000
#: Vectors of all labels together that centroids are fitted on, and those a centroid needs. They bound a codebook, not the cells: more codebooks part them further.
SAMPLE, SAMPLE_A_CELL = 20_000, 20
#: Labels that get centroids of their own, largest first; further ones stay one cell each.
PARTED, MOST_BOOKS = 400, 3


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit rows."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        s = np.zeros_like(c)
        np.add.at(s, near, x)
        norm = np.linalg.norm(s, axis=1)
        alive = norm > 1e-9
        c = np.where(alive[:, None], s / np.where(alive, norm, 1)[:, None], c)
    return c


def _clean(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = v.isNotNull() & F.col(label_col).isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0) & F.col(id_col).isNotNull()
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), v.alias("vec"), F.coalesce(ok, F.lit(False)).alias("ok"))


def codebooks(x: np.ndarray, rows: int) -> list[np.ndarray]:
    """Centroids from unit rows ``x`` of a label that has ``rows`` vectors: one codebook, or more where its cells would be too large."""
    most = max(1, len(x) // SAMPLE_A_CELL)
    out: list[np.ndarray] = []
    while rows > CELL_ROWS and most > 1 and len(out) < MOST_BOOKS:
        k = int(min(most, -(-rows // CELL_ROWS)))
        c = spherical_kmeans(x, k, seed=7 + len(out))
        out.append(c)
        rows //= k
        rest = x - c[(x @ c.T).argmax(1)]  # the next codebook tells apart what this one puts together
        norm = np.linalg.norm(rest, axis=1)
        x = rest[norm > 1e-9] / norm[norm > 1e-9][:, None]
        most = max(1, len(x) // SAMPLE_A_CELL)
    return out


def reached(y: np.ndarray, c: np.ndarray, gaps: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """The home of each row and which cells may hold a row linked to it."""
    s = y @ c.T
    goes = np.ones(s.shape, bool)
    for b in range(len(c)):
        goes &= s[:, b : b + 1] - s <= reach * gaps[b] + 1e-9
    home = s.argmax(1)
    goes[np.arange(len(y)), home] = True
    return home, goes


def _unit(vec: pa.Array, dim: int) -> np.ndarray:
    y = vec.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    y = y / np.abs(y).max(1, keepdims=True)
    return y / np.linalg.norm(y, axis=1, keepdims=True)


def stars(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the nodes below n that the edges (i, j) connect to a smaller one."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    node = np.flatnonzero(label != np.arange(n))
    return node, label[node]


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each input row.

    Vectors that are null, empty, zero or hold null or non-finite components, and those with a null
    label, link with nothing: 0 links, their own component. Rows with a null id come back with a null
    component and are not kept. Vectors of other lengths are never compared. Repeated ids are rows of one node.
    """
    spark = vectors.sparkSession
    arrow_rows(spark, 4096)
    rows = _clean(vectors, id_col, vec_col, label_col)
    good = rows.where("ok")
    reps = park(good.groupBy("label", "vec").agg(F.min("id").alias("rep"), F.countDistinct("id").alias("w")).withColumn("d", F.size("vec")))
    large = reps.groupBy("label", "d").count().where(F.col("count") > CELL_ROWS).orderBy(F.desc("count"), "label", "d").limit(PARTED).collect()  # PARTED rows at most
    books: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]] = {}
    if large:
        total = sum(r["count"] for r in large)
        named = spark.createDataFrame([(r["label"], r["d"], r["count"]) for r in large], "label string, d int, n long")
        some = reps.join(F.broadcast(named), ["label", "d"]).where(F.pmod(F.xxhash64("rep", F.lit("fit")), F.lit(1 << 20)) < (1 << 20) * min(1.0, SAMPLE / total))
        for (label, d), t in some.select("label", "d", "n", "vec", "rep").orderBy("rep").limit(2 * SAMPLE).toPandas().groupby(["label", "d"]):
            x = np.stack(t["vec"].to_numpy()).astype(np.float64)
            x = x / np.abs(x).max(1, keepdims=True)
            books[label, int(d)] = [(c, np.linalg.norm(c[:, None] - c[None], axis=2)) for c in codebooks(x / np.linalg.norm(x, axis=1, keepdims=True), int(t["n"].iloc[0]))]
    reach = math.sin(math.acos(threshold)) + 1e-9
    sent = spark.sparkContext.broadcast(books)  # SAMPLE / SAMPLE_A_CELL centroids a level

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = list(zip(b.column("label").to_pylist(), b.column("d").to_pylist(), strict=True))
            pos, cell, home = [], [], []
            for key in set(keys):
                own = np.array([i for i, k in enumerate(keys) if k == key])
                at, here, index = np.arange(len(own)), np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)  # row, cell that it visits, its home
                book = sent.value.get(key, [])
                y = _unit(b.column("vec").take(pa.array(own)), key[1]) if book else None
                for c, gaps in book:
                    h, goes = reached(y, c, gaps, reach)
                    index = index * len(c) + h
                    r, to = np.nonzero(goes[at])
                    at, here = at[r], here[r] * len(c) + to
                keep = here <= index[at]
                at, here = at[keep], here[keep]
                pos.append(own[at]), cell.append(here), home.append(here == index[at])
            take = pa.array(np.concatenate(pos) if pos else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in ("rep", "w", "label", "d", "vec")), pa.array(np.concatenate(cell) if cell else [], pa.int64()), pa.array(np.concatenate(home) if home else [], pa.bool_())], names=["rep", "w", "label", "d", "vec", "cell", "home"])

    dealt = park(reps.select("rep", "w", "label", "d", "vec").mapInArrow(assign, "rep long, w long, label string, d int, vec array<double>, cell long, home boolean"))
    by = ["label", "d", "cell"]
    counts = dealt.groupBy(*by).agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    keyed = dealt.join(counts, by).withColumn("blk", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    keyed = keyed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keyed = keyed.select("rep", "w", "d", "vec", "home", (F.col("blk") <= F.col("other")).alias("left"), (F.col("blk") >= F.col("other")).alias("right"), F.xxhash64(*by, F.least("blk", "other"), F.greatest("blk", "other")).alias("key"), F.struct(*by, F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j")).cast("string").alias("task"))

    def compare(task: object, t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        rep, w, home = (t.column(c).to_numpy() for c in ("rep", "w", "home"))
        left, right = t.column("left").to_numpy(), t.column("right").to_numpy()
        x = _unit(t.column("vec").combine_chunks(), t.column("d")[0].as_py())
        one = bool((left & right).all())
        a = np.flatnonzero(left)
        b = a if one else np.flatnonzero(right)
        i, j = np.nonzero(x[a] @ x[b].T >= threshold)
        i, j = a[i], b[j]
        ok = (home[i] | home[j]) & ((i < j) if one else True)
        i, j = i[ok], j[ok]
        number = (np.bincount(i, w[j], len(rep)) + np.bincount(j, w[i], len(rep))).astype(np.int64)
        node, root = stars(i, j, len(rep))
        got = np.flatnonzero(number)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([rep[got], rep[node]]), pa.int64()), pa.array(np.concatenate([np.zeros(len(got), np.int64), rep[root]]), mask=np.arange(len(got) + len(node)) < len(got)), pa.array(np.concatenate([number[got], np.zeros(len(node), np.int64)]), pa.int64())], names=["a", "b", "n"])

    found = park(keyed.repartition(partitions(spark), "key").sortWithinPartitions("key", "task").drop("key").mapInArrow(streamed("task", compare), "a long, b long, n long"))
    unpark(dealt)
    number = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    comp = connected_components(found.where("b is not null"))
    per = reps.join(number, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    per = per.select("label", "vec", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = good.join(per, ["label", "vec"]).select("id", "n_links", "component_id")
    alone = rows.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op1(spark, sf_dir):
    """Full result over ``embeddings``."""
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: Vectors as in the operator; reachability by a recursive query over the links.
OP1_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
good AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(v.vec_id, coalesce(c.m, v.vec_id)) AS component_id, v.vec_id = least(v.vec_id, coalesce(c.m, v.vec_id)) AS kept
FROM v LEFT JOIN (SELECT a, count(DISTINCT b) AS n FROM links GROUP BY a) n ON n.a = v.vec_id
LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) c ON c.a = v.vec_id
"""
