"""Token counts kept by deltas: signed changes update additive totals, each batch commits once.

A batch is aggregated to one row for each (source, lang, tokenizer) before it is written, so the store
grows with batches times groups, not with documents. A batch is committed by a rename and never applied
again. Compaction folds committed batches into one, which names them, so it can be interrupted anywhere.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import fast_encoder
from .common import arrow_rows, park, shared_dir
from .textkit import groups, words

KEYS = ("source", "lang", "tokenizer")


def insert(counts: DataFrame) -> DataFrame:
    """Signed changes of new documents: counts has source, lang, tokenizer, n_tokens."""
    return counts.select(*KEYS, F.lit(1).cast("long").alias("docs"), F.col("n_tokens").cast("long").alias("tokens"))


def delete(counts: DataFrame) -> DataFrame:
    """Signed changes of documents that go; counts as they were inserted or last revised."""
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("docs"), (-F.col("n_tokens")).cast("long").alias("tokens"))


def revise(counts: DataFrame) -> DataFrame:
    """Signed changes of revised counts: counts has old_tokens beside n_tokens."""
    return counts.select(*KEYS, F.lit(0).cast("long").alias("docs"), (F.coalesce("n_tokens", F.lit(0)) - F.coalesce("old_tokens", F.lit(0))).cast("long").alias("tokens"))


class TokenRollup:
    """Totals in a folder of the shared file system; one writer at a time.

    Null counts count as 0, null keys are a group of their own, an empty batch commits and changes
    nothing, repeated rows of a batch each count. Totals that sum to no document and no token stay as
    rows with zeros. A batch is written under another name and renamed, which commits it; whatever a
    lost writer leaves is not read. A fold holds the sums of the batches that it names; from its rename
    on they are not read any more, whether or not they are deleted yet, and each leaves a mark that it
    was committed.
    """

    SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.folder)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _path(self, kind: str, name: str) -> str:
        if not re.fullmatch(r"[\w.-]+", name):
            raise ValueError(f"batch names are letters, digits, '_', '.' and '-': {name!r}")
        return f"{self.folder}/{kind}={name}"

    def _names(self, kind: str) -> set[str]:
        fs, path = self._fs()
        if not fs.exists(path(self.folder)):
            return set()
        return {n.removeprefix(f"{kind}=") for s in fs.listStatus(path(self.folder)) if (n := s.getPath().getName()).startswith(f"{kind}=")}

    def committed(self, name: str) -> bool:
        """Whether a batch was committed, folded or not."""
        fs, path = self._fs()
        return any(fs.exists(path(self._path(kind, name))) for kind in ("batch", "done"))

    def _publish(self, sums: DataFrame, target: str, folded: list[tuple[str, str]] | None = None) -> None:
        fs, path = self._fs()
        stage = f"{self.folder}/stage-{uuid.uuid4().hex}"
        sums.coalesce(1).write.parquet(f"{stage}/sums")  # one row a group
        if folded is not None:
            self.spark.createDataFrame(folded, "kind string, name string").coalesce(1).write.parquet(f"{stage}/folded")
        if not fs.rename(path(stage), path(target)):
            raise OSError(f"{stage} could not be renamed to {target}")

    def apply(self, name: str, changes: DataFrame) -> bool:
        """Commit a batch; False if it was committed before, whatever its rows are now."""
        if self.committed(name):
            return False
        self._publish(changes.groupBy(*KEYS).agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")), self._path("batch", name))
        return True

    def _live(self) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
        """(kind, name) of what counts, and of what a fold stands for but is not deleted yet."""
        there = {(kind, n) for kind in ("batch", "fold") for n in self._names(kind)}
        gone = {(r.kind, r.name) for _, n in (x for x in there if x[0] == "fold") for r in self.spark.read.parquet(f"{self._path('fold', n)}/folded").collect()}  # names of batches
        return sorted(there - gone), sorted(there & gone)

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) over all committed batches."""
        live, _ = self._live()
        rows = self.spark.read.schema(self.SCHEMA).parquet(*(f"{self._path(*x)}/sums" for x in live)) if live else self.spark.createDataFrame([], self.SCHEMA)
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))

    def compact(self, name: str) -> None:
        """Fold all committed batches and folds into fold ``name``, then clear what folds stand for, also what an interrupted call left."""
        fs, path = self._fs()
        target = self._path("fold", name)
        live, _ = self._live()
        if not fs.exists(path(target)) and live:
            self._publish(self.totals().select(*KEYS, F.col("n_docs").alias("docs"), F.col("n_tokens").alias("tokens")), target, live)
        for kind, n in self._live()[1]:
            if kind == "batch":
                fs.create(path(self._path("done", n)), True).close()
            fs.delete(path(self._path(kind, n)), True)


#: Documents with fewer words are deleted and inserted again.
LEAST_WORDS = 20
FILES = ("word_bpe_49k", "byte_bpe_50k")


def token_counts(docs: DataFrame, paths: dict[str, str], text_col: str = "text") -> DataFrame:
    """docs' other columns with ``words`` and a column of token counts for each tokenizer version in ``paths``; null texts count 0. Row-wise, whole texts."""
    arrow_rows(docs.sparkSession)
    keep = [c for c in docs.columns if c != text_col and c != "words" and c not in paths]
    schema = T.StructType([*docs.select(keep).schema.fields, *(T.StructField(n, T.LongType()) for n in ("words", *paths))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(text_col)
            n_words = np.concatenate([np.zeros(0, np.int64), *(np.diff(words(buf, off)[2]) for _, _, buf, off in groups(text))])
            counts = [np.concatenate([np.zeros(0, np.int64), *(np.diff(at) for _, _, _, at, _ in fast_encoder(p).encode(text))]) for p in paths.values()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(x, pa.int64()) for x in (n_words, *counts))], names=[*keep, "words", *paths])

    return docs.mapInArrow(run, schema)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all ``documents`` by two tokenizers: inserted with word counts for want of better, revised to the tokenizers' counts, short documents deleted and inserted again, with replays of committed batches and a compaction between."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    versions = {f"{n}-1": public_tokenizers.path(f"{n}.json") for n in FILES}
    n = park(token_counts(docs.select("source", "lang", "text"), versions))
    each = n.select("source", "lang", "words", F.explode(F.create_map(*(x for v in versions for x in (F.lit(v), F.col(v))))).alias("tokenizer", "n_tokens"))
    guess = each.withColumn("n_tokens", F.col("words"))
    short = each.where(F.col("words") < LEAST_WORDS)
    store = TokenRollup(spark, shared_dir(spark))
    batches = [
        ("insert", insert(guess)),
        ("revise", revise(each.withColumn("old_tokens", F.col("words")))),
        ("delete-short", delete(short)),
        ("insert-short", insert(short)),
    ]
    for k, (name, changes) in enumerate(batches):
        store.apply(name, changes)
        if k == 1:
            store.compact("first")
    for name, changes in batches[1:3]:
        store.apply(name, changes)
    return store.totals()
