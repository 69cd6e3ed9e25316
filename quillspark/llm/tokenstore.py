"""Token ids in binary shards, each with a minimal perfect hash from document id to its ids.

A shard file holds, in ascending document order: a JSON header, the raw ids (little-endian, 16 bits
if the vocabulary fits and 32 if not),
where each document's ids start, the document ids, and the index. The index is a cascade of bit
arrays: a key sits at its hash in the first level where no other key falls, and its rank among all
set bits is its slot. A slot holds a 32-bit fingerprint of the key and the number of its document, so
a lookup costs a bounded number of probes and unknown keys are told apart by the fingerprint.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import fast_encoder
from .common import arrow_rows, park, partitions, shared_dir
from .fsio import read_range, write_whole
from .ranges import ranges, row_hash
from .textkit import U64, mix

MAGIC = b"QTS1"
#: Documents and bytes of ids at which a shard is closed; documents of a range of keys, which one task sorts and writes shard by shard.
SHARD_DOCS, SHARD_BYTES, RANGE_DOCS = 4096, 16 << 20, 65_536
#: Most levels of an index before keys are kept in a plain list, and bits a key in each level.
LEVELS, GAMMA = 24, 2.0


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: slots 0 to n - 1."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, rest: np.ndarray) -> None:
        self.sizes, self.bits, self.rest = sizes, bits, rest
        self.base = np.concatenate([[0], np.cumsum(sizes)])
        self.flat = np.unpackbits(bits, count=int(self.base[-1])).astype(bool) if len(bits) else np.zeros(0, bool)
        self.rank = np.concatenate([[0], np.cumsum(self.flat)])

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + U64(0x9E3779B97F4A7C15 * (level + 1) % (1 << 64))) % U64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, bits, left = [], [], keys.astype(U64)
        while len(left) and len(sizes) < LEVELS:
            size = max(64, int(GAMMA * len(left)))
            at = cls._at(left, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size), bits.append(alone)
            left = left[~alone[at]]
        return cls(np.array(sizes, np.int64), np.packbits(np.concatenate(bits)) if bits else np.zeros(0, np.uint8), np.sort(left))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; some slot or -1 for a key that was not in the set."""
        keys = keys.astype(U64)
        out = np.full(len(keys), -1)
        left = np.arange(len(keys))
        for level, size in enumerate(self.sizes.tolist()):
            at = self.base[level] + self._at(keys[left], level, size)
            hit = self.flat[at]
            out[left[hit]] = self.rank[at[hit]]
            left = left[~hit]
        if len(self.rest) and len(left):
            p = np.minimum(np.searchsorted(self.rest, keys[left]), len(self.rest) - 1)
            hit = self.rest[p] == keys[left]
            out[left[hit]] = self.rank[-1] + p[hit]
        return out


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.astype(U64) ^ U64(0xA0761D6478BD642F)) >> U64(32)).astype(np.uint32)


def pack_shard(keys: np.ndarray, has: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> list[bytes]:
    """keys ascending (those without ``has`` are null and stand last); starts: one entry more than documents."""
    own, first = np.unique(keys[has], return_index=True)
    index = PerfectHash.build(own.view(U64))
    slot = index.slots(own.view(U64))
    doc, mark = np.zeros(len(own), np.int32), np.zeros(len(own), np.uint32)
    doc[slot], mark[slot] = first, fingerprint(own.view(U64))
    parts = {"ids": ids, "starts": starts.astype("<i8"), "keys": keys.astype("<i8"), "has": has.astype("u1"), "sizes": index.sizes.astype("<i8"), "bits": index.bits, "rest": index.rest.astype("<u8"), "slot_doc": doc.astype("<i4"), "slot_mark": mark.astype("<u4")}
    at, sections = 0, {}
    for name, a in parts.items():
        sections[name] = [at, len(a), a.dtype.str]
        at += a.nbytes
    head = json.dumps({"docs": len(keys), "tokens": len(ids), "sections": sections}).encode()
    return [MAGIC, len(head).to_bytes(4, "little"), head, *(a.tobytes() for a in parts.values())]


class Shard:
    """A shard file; reads only the parts it needs."""

    def __init__(self, uri: str) -> None:
        self.uri = uri
        lead = read_range(uri, 0, 8)
        if lead[:4] != MAGIC:
            raise ValueError(f"{uri} is no token shard")
        n = int.from_bytes(lead[4:], "little")
        self.head, self.base = json.loads(read_range(uri, 8, n)), 8 + n
        self.index = PerfectHash(self.part("sizes"), self.part("bits"), self.part("rest"))
        self.starts, self.doc, self.mark, self.keys = self.part("starts"), self.part("slot_doc"), self.part("slot_mark"), self.part("keys")

    def part(self, name: str, first: int = 0, count: int | None = None) -> np.ndarray:
        at, n, kind = self.head["sections"][name]
        kind = np.dtype(kind)
        count = n - first if count is None else count
        return np.frombuffer(read_range(self.uri, self.base + at + first * kind.itemsize, count * kind.itemsize), kind)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key's first document in this shard, -1 where the fingerprint or the stored key says it is not here."""
        if not len(self.doc):
            return np.full(len(keys), -1)
        slot = self.index.slots(keys.view(U64))
        ok = (slot >= 0) & (self.mark[np.maximum(slot, 0)] == fingerprint(keys.view(U64)))
        doc = np.where(ok, self.doc[np.maximum(slot, 0)], 0)
        return np.where(ok & (self.keys[doc] == keys), doc, -1)  # two keys may share a fingerprint

    def get(self, key: int) -> np.ndarray | None:
        """The ids of a document, in constant time: one index probe and one range read."""
        d = int(self.find(np.array([key], np.int64))[0])
        return None if d < 0 else self.part("ids", int(self.starts[d]), int(self.starts[d + 1] - self.starts[d]))


def id_type(path: str, end_id: int) -> str:
    """The smallest unsigned type that holds every id of a tokenizer file and the end id."""
    from tokenizers import Tokenizer

    return "<u2" if max(end_id, Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) - 1) < 1 << 16 else "<u4"


def write_token_store(docs: DataFrame, folder: str, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = SHARD_DOCS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode whole texts (null: empty), append ``end_id`` to each, write shards; returns their manifest.

    Manifest: part, shard, path, n_docs, n_tokens, first_token, min_key, max_key, one row for a shard in
    ascending document order. Rows of one id keep their own places, one after another; a lookup finds
    the first. Rows with a null id stand at the very end and are not indexed. An empty table gives an
    empty manifest. A task holds one shard, which is closed at ``shard_docs`` documents or
    ``shard_bytes`` bytes of ids, so long texts make shards of fewer documents; an id that repeats
    without end, or null, is many ranges and shards.
    """
    spark = docs.sparkSession
    arrow_rows(spark, 512)
    source = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"), row_hash(text_col).alias("hash"))
    cut = ranges(source, "key", "hash", RANGE_DOCS, partitions(spark))
    sent, kind = spark.sparkContext.broadcast(cut), id_type(path, end_id)  # 16 bytes a range

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, cut = fast_encoder(path), sent.value
        for b in batches:
            for i, j, ids, at, _ in enc.encode(b.column(1)):
                key, hashed = b.column(0).slice(i, j - i), b.column(2).slice(i, j - i)
                ids = ids.astype(kind)
                yield pa.RecordBatch.from_arrays([pa.array(cut.place(key, hashed), pa.int32()), key.is_null(), key, hashed, pa.array([ids[x:y].tobytes() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())], names=["part", "nokey", "key", "hash", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], kind).tobytes()
        keys: list[int | None] = []
        blobs: list[bytes] = []
        part, shard, size = None, 0, 0

        def close() -> pa.RecordBatch:
            starts = np.concatenate([[0], np.cumsum([len(x) // len(end) + 1 for x in blobs])])
            ids = np.frombuffer(b"".join(x for p in blobs for x in (p, end)), kind)
            own = [k for k in keys if k is not None]
            uri = f"{folder}/shard-{part:06d}-{shard:05d}.qts"
            write_whole(uri, pack_shard(np.array([k or 0 for k in keys], np.int64), np.array([k is not None for k in keys]), starts, ids))
            row = {"part": part, "shard": shard, "path": uri, "n_docs": len(keys), "n_tokens": len(ids), "min_key": own[0] if own else None, "max_key": own[-1] if own else None}
            return pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("min_key", pa.int64()), ("max_key", pa.int64())]))

        for b in batches:
            for p, k, ids in zip(*(b.column(c).to_pylist() for c in ("part", "key", "ids")), strict=True):
                if keys and (p != part or len(keys) >= shard_docs or size >= shard_bytes):
                    yield close()
                    shard, size = shard + 1 if p == part else 0, 0
                    keys.clear(), blobs.clear()
                elif p != part:
                    shard = 0
                part = p
                keys.append(k), blobs.append(ids)
                size += len(ids)
        if keys:
            yield close()

    rows = source.mapInArrow(encode, "part int, nokey boolean, key long, hash long, ids binary")
    parts = rows.repartition(max(partitions(spark), cut.count // 4), "part").sortWithinPartitions("part", "nokey", "key", "hash").drop("nokey", "hash")
    manifest = park(parts.mapInArrow(write, "part int, shard int, path string, n_docs long, n_tokens long, min_key long, max_key long"))
    before = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    sums = manifest.groupBy("part").agg(F.sum("n_tokens").alias("in_part"))  # one row a range
    sums = sums.select("part", F.coalesce(F.sum("in_part").over(before(W.orderBy("part"))), F.lit(0)).alias("lead"))
    inside = F.coalesce(F.sum("n_tokens").over(before(W.partitionBy("part").orderBy("shard"))), F.lit(0))
    return manifest.join(sums, "part").withColumn("first_token", F.col("lead") + inside).drop("lead")


def places(keys: np.ndarray, has: np.ndarray, find: Callable[[np.ndarray], np.ndarray], uri: str = "shard") -> np.ndarray:
    """Number of the document of each stored row: by ``find`` for the first row of a key, by its place for the others."""
    lead = has.copy()
    lead[1:] &= keys[1:] != keys[:-1]
    at = np.arange(len(keys))
    at[lead] = find(keys[lead].astype(np.int64))
    if (at < 0).any() or (keys[at] != keys)[lead].any():
        raise ValueError(f"{uri}: the index does not find its own keys")
    return at


def read_token_store(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every stored document, found by its key through each shard's index.

    Rows that the index does not hold (null ids, later rows of an id) are taken in the order of the file.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, first in zip(b.column("path").to_pylist(), b.column("first_token").to_pylist(), strict=True):
                s = Shard(uri)
                keys, has, ids = s.keys, s.part("has").astype(bool), s.part("ids")
                at = places(keys, has, s.find, uri)
                start, end = s.starts[at], s.starts[at + 1]
                crc = [zlib.crc32(ids[x:y].astype("<u4").tobytes()) for x, y in zip(start.tolist(), end.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64), mask=~has), pa.array(first + start, pa.int64()), pa.array(end - start, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = manifest.select("path", "first_token").repartition(max(1, partitions(manifest.sparkSession)), "path")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


class TokenStore:
    """Keyed access from one process: the manifest's key ranges lead to a shard, its index to the ids."""

    def __init__(self, manifest: DataFrame) -> None:
        self.rows = sorted(manifest.where("min_key is not null").select("first_token", "min_key", "max_key", "path").toLocalIterator())
        self.high = np.array([r["max_key"] for r in self.rows], np.int64)
        self.open: dict[str, Shard] = {}

    def get(self, key: int) -> np.ndarray | None:
        """The ids of a document, of the first stored row where an id repeats; null for an id that is not there."""
        k = int(np.searchsorted(self.high, key, "left"))  # shards stand in the order of their keys: the first that may hold it
        if k == len(self.rows) or key < self.rows[k]["min_key"]:
            return None
        uri = self.rows[k]["path"]
        if uri not in self.open:
            self.open[uri] = Shard(uri)
        return self.open[uri].get(key)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full result over ``documents``: written with the word tokenizer and read back."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_token_store(write_token_store(docs, shared_dir(spark), public_tokenizers.path("word_bpe_49k.json")))
