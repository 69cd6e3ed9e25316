"""Document fingerprints: one canonical digest a text, exact inside equal buckets.

The canonical text is NFKC, case-folded, with runs of white space as one space and none at the ends.
Its 128-bit xxhash in hexadecimal is the fingerprint. Texts that fall into one bucket are compared byte
by byte with the bucket's first; one that differs gets a longer fingerprint of its own, so equal
fingerprints mean equal canonical texts.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, park, partitions, pick
from .ranges import ranges, row_hash

#: Rows of a range of ids, rows and characters that are held at a time; rows of a bucket compared with its first in one task.
RANGE_ROWS, HELD_ROWS, HELD_CHARS, BUCKET_ROWS = 16_384, 1024, 4 << 20, 512
Hasher = Callable[[bytes], str]


def canonical(text: str | None) -> bytes:
    """NFKC, case folded (and NFKC again, as folding may undo it), white space folded, in UTF-8."""
    t = text or ""
    if not t.isascii():
        t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold())
    else:
        t = t.lower()
    return " ".join(t.split()).encode()


def digest(plain: bytes) -> str:
    import xxhash

    return xxhash.xxh3_128_hexdigest(plain)


def longer(plain: bytes, hasher: Hasher = digest) -> str:
    """Fingerprint of a text whose bucket belongs to another text."""
    return hasher(plain) + "-" + hashlib.sha256(plain).hexdigest()


def resolve(marks: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hasher: Hasher = digest) -> DataFrame:
    """(doc_id, fingerprint, other) of texts whose bytes differ from the first of their bucket; empty but for a hash collision.

    marks: (doc_id, fingerprint) of all documents. Only buckets of several documents are read again,
    in chunks of a bounded size that each hold the bucket's first text.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    several = marks.where("doc_id is not null").groupBy("fingerprint").agg(F.count("*").alias("m"), F.min("doc_id").alias("first")).where("m > 1")
    rows = marks.join(several, "fingerprint").withColumn("chunks", F.ceil(F.col("m") / BUCKET_ROWS).cast("int"))
    led = rows.select("doc_id", "fingerprint", F.pmod(F.xxhash64("doc_id"), "chunks").cast("int").alias("chunk"), F.lit(False).alias("leads")).distinct()
    lead = several.select(F.col("first").alias("doc_id"), "fingerprint", F.explode(F.sequence(F.lit(0), F.ceil(F.col("m") / BUCKET_ROWS).cast("int") - 1)).alias("chunk"), F.lit(True).alias("leads"))
    dealt = park(led.unionByName(lead))
    texts = pick(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), dealt).withColumn("key", F.concat_ws(":", "fingerprint", "chunk"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, None  # the bucket's first text, in front of the rows that it is compared with
        for b in batches:
            odd = []
            for key, i, mark, leads, text in zip(*(b.column(c).to_pylist() for c in ("key", "doc_id", "fingerprint", "leads", "text")), strict=True):
                plain = canonical(text)
                if key != now:
                    now, own = key, None
                if hasher(plain) != mark:
                    continue  # another row of a repeated id
                if leads:
                    own = plain if own is None else min(own, plain)
                elif own is not None and plain != own:
                    odd.append((i, mark, longer(plain, hasher)))
            if odd:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*odd, strict=True)], names=["doc_id", "fingerprint", "other"])

    n = partitions(spark)
    return texts.repartition(n, "key").sortWithinPartitions("key", F.desc("leads")).mapInArrow(compare, "doc_id long, fingerprint string, other string").distinct()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hasher: Hasher = digest) -> DataFrame:
    """(doc_id, fingerprint) of each row; equal fingerprints mean equal canonical texts. Null texts count as empty, null ids pass through.

    Rows that repeat an id each keep their own text's fingerprint.
    """
    arrow_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([hasher(canonical(x)) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "fingerprint"])

    marks = park(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, "doc_id long, fingerprint string"))
    return settled(marks, resolve(marks, docs, id_col, text_col, hasher))


def settled(marks: DataFrame, odd: DataFrame) -> DataFrame:
    out = marks.join(odd, ["doc_id", "fingerprint"], "left")
    return out.withColumn("fingerprint", F.coalesce("other", "fingerprint")).select(*marks.columns)


def with_next(docs: DataFrame, work, schema: str, id_col: str = "doc_id", text_col: str = "text", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Rows in ascending id order (null ids last; rows of one id by a hash of the text, then the text), each with the text after it; after the last comes the first.

    ``work(ids, texts, next_texts)`` makes record batches of up to ``HELD_ROWS`` rows or ``HELD_CHARS``
    characters. Rows are cut into ranges, an id that repeats without end into several; the first row of
    a range is also sent to the range before it, so every row meets its successor in one shuffle.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), row_hash(text_col).alias("hash"), F.col(text_col).alias("text"))
    cut = ranges(rows, "id", "hash", range_rows, partitions(spark))
    sent = spark.sparkContext.broadcast(cut)  # 16 bytes a range

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(sent.value.place(b.column(0), b.column(1)), pa.int32()), b.column(0), b.column(1)], names=["part", "id", "hash"])

    first = rows.select("id", "hash").mapInArrow(place, "part int, id long, hash long").groupBy("part").agg(F.min(F.struct("id", "hash")).alias("low")).orderBy("part").collect()  # one row a range
    to = spark.sparkContext.broadcast({r["part"]: (first[k - 1]["part"], *r["low"]) for k, r in enumerate(first)})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part, ids, hashes = sent.value.place(b.column(0), b.column(1)), b.column(0), b.column(1)
            also, dest = [], []
            for p in np.unique(part).tolist():
                before, low, h = to.value[p]
                own = np.flatnonzero((part == p) & (hashes.to_numpy() == h))
                lead = next((i for i in own.tolist() if ids[i].as_py() == low), None)  # of equal rows one does
                if lead is not None:
                    also.append(lead), dest.append(before)
            take = pa.array(np.concatenate([np.arange(len(ids)), np.array(also, np.int64)]))
            kind = np.arange(len(take)) >= len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([part, np.array(dest, np.int64)]), pa.int32()), pa.array(kind), *(b.column(c).take(take) for c in range(3))], names=["part", "after", "id", "hash", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        texts: list[str] = []
        now, closed, size = None, False, 0
        for b in batches:
            for p, after, i, text in zip(*(b.column(c).to_pylist() for c in ("part", "after", "id", "text")), strict=True):
                text = text or ""
                if p != now:
                    now, closed = p, False
                if closed:
                    continue
                if texts and (after or len(texts) >= HELD_ROWS or size >= HELD_CHARS):
                    yield from work(pa.array(ids, pa.int64()), texts, [*texts[1:], text])
                    ids, texts, size = [], [], 0
                if after:
                    closed = True
                else:
                    ids.append(i), texts.append(text)
                    size += len(text)

    dealt = rows.mapInArrow(deal, "part int, after boolean, id long, hash long, text string")
    dealt = dealt.repartition(max(partitions(spark), cut.count // 8), "part").sortWithinPartitions("part", "after", F.col("id").asc_nulls_last(), "hash", "text")
    return dealt.select("part", "after", "id", "text").mapInArrow(run, schema)


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many from the start of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hasher: Hasher = digest) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one row for each input row.

    Null texts count as empty, rows are in the order of ``with_next``. Equal canonical texts have equal
    fingerprints, whether they stand in the table or come about by the edit, and different ones have
    different fingerprints: where a digest turns out to belong to several texts (by bytes within the
    table, by their SHA-256 with the edited ones) each of them gets its longer form.
    """

    def work(ids: pa.Array, texts: list[str], after: list[str]) -> Iterator[pa.RecordBatch]:
        changed = [edited(a, b) for a, b in zip(texts, after, strict=True)]
        plain, new, nxt = [canonical(x) for x in texts], [canonical(x) for x in changed], canonical(after[-1])
        follow, sha = [*plain[1:], nxt], lambda x: hashlib.sha256(x).digest()
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array([len(x) for x in texts], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed]), pa.array([hasher(x) for x in plain]), pa.array([hasher(x) for x in new]), pa.array([float(a == b) for a, b in zip(plain, new, strict=True)]), pa.array([float(a == b) for a, b in zip(plain, follow, strict=True)]), pa.array(list(map(sha, plain)), pa.binary()), pa.array(list(map(sha, new)), pa.binary())],
            names=[*names, "sha", "new_sha"],
        )

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    marks = park(with_next(docs, work, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, sha binary, new_sha binary", id_col, text_col))
    odd = resolve(marks.select("doc_id", "fingerprint"), docs, id_col, text_col, hasher).select("fingerprint")
    both = marks.select("fingerprint", "sha").unionByName(marks.select(F.col("edited_fingerprint").alias("fingerprint"), F.col("new_sha").alias("sha")))
    shared = park(both.groupBy("fingerprint").agg(F.min("sha").alias("a"), F.max("sha").alias("b")).where("a <> b").select("fingerprint").unionByName(odd).distinct())
    if shared.isEmpty():  # no digest belongs to two texts
        return marks.select(*names)
    long = lambda f, sha_: F.concat_ws("-", f, F.lower(F.hex(sha_)))
    for f, sha_ in (("fingerprint", "sha"), ("edited_fingerprint", "new_sha")):
        marks = marks.join(shared.select(F.col("fingerprint").alias("_f"), F.lit(True).alias("_several")), F.col(f) == F.col("_f"), "left").withColumn(f, F.when(F.col("_several"), long(F.col(f), F.col(sha_))).otherwise(F.col(f))).drop("_f", "_several")
    return marks.select(*names)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``edited_fingerprints`` of all ``documents``."""
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
