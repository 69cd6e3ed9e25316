"""BPE encoding and decoding by content-defined chunks that are encoded once and reused.

A rolling hash of the last 16 bytes picks the cuts, so a passage that documents share falls into the
same chunks wherever it stands. A worker keeps the ids of the chunks that it has met, keyed by their
bytes; the chunks of a batch that are not among them are encoded together: by the tokenizers library, or
by ``PieceEncoder``, which gives the same ids sooner, where the file is byte-level BPE.

A chunk's ids near its ends are not those of the whole text: a cut may fall within a word. So each join
is repaired. A window that reaches from the last but one word start of the left chunk to the second
word start of the right chunk is encoded anew. The join is settled if the window's ids begin with those
that the left chunk has for the window's first word and end with those that the right chunk has for its
last: between the two the window's ids replace the chunks'. If they do not agree, or a chunk has fewer
than two word starts, the two chunks become one, which is encoded as a whole, and its joins are tried
again, until every join that is left agrees. In the worst case that is the whole text.

Why agreement is enough: a word start is white space before a character that is none. A pre-tokenizer
that keeps white space apart from words starts afresh there whatever stands before, so what follows in
the text, in the chunk and in the window is cut alike from a word start on that all three have in
common. Files that promise less (no pre-tokenizer, added tokens that hold or strip white space) are
encoded text by text.

Decoding looks up each id's bytes and decodes the joined bytes as UTF-8.
"""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import arrow_rows, lean
from .pieces import PieceEncoder, family
from .textkit import CHUNK, groups, ragged

#: Bytes of a chunk: at least LEAST, and MEAN more on average (a power of two) until the rolling hash cuts.
LEAST, MEAN = 64, 256
#: Bytes of chunks and windows, and pieces, that a worker remembers; beyond that it forgets all and goes on.
MEMO_BYTES, MEMO_PIECES = 12 << 20, 200_000
#: Characters that surely begin a word after white space: ASCII signs and letters, letters of two bytes, ideographs and Hangul.
_SOLID = np.zeros(256, bool)
_SOLID[[*range(0x21, 0x7F), *range(0xC3, 0xCC), *range(0xD0, 0xD6), *range(0xE4, 0xEE)]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_GEAR = np.random.default_rng(64).integers(0, 1 << 32, 256, dtype=np.uint32)
#: A chunk's ids as bytes, then of its last but one, last, first and second word start the number of ids before it, and the places of the two that end windows; None where it has fewer.
Entry = tuple[bytes, tuple[int, int, int, int, int, int] | None]


def cut_points(buf: np.ndarray, off: np.ndarray, least: int = LEAST, mean: int = MEAN) -> list[list[int]]:
    """For each text its start, the places where the rolling hash cuts it, and its end."""
    n = len(buf)
    h = _GEAR[buf]
    for k in (1, 2, 4, 8):  # h becomes a hash of the last 16 bytes
        nxt = h.copy()
        nxt[k:] += h[:-k] << np.uint32(k) if n > k else np.uint32(0)
        h = nxt
    hit = np.flatnonzero((h >> np.uint32(20)) % np.uint32(mean) == 0) + 1
    hit = hit[hit < n]
    for _ in range(3):  # a cut within a character moves behind it
        hit = hit + ((hit < n) & ((buf[np.minimum(hit, n - 1)] & 0xC0) == 0x80))
    out, hits, k = [], hit.tolist(), 0
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        own = [a]
        k = bisect_left(hits, a, k)
        while k < len(hits) and hits[k] < b:
            if hits[k] - own[-1] >= least:
                own.append(hits[k])
            k += 1
        own.append(b)
        out.append(own)
    return out


def plain_tokenizer(spec: dict):
    """The library's tokenizer without truncation, padding and post-processor, which only adds special tokens and trims offsets."""
    from tokenizers import Tokenizer

    return Tokenizer.from_str(json.dumps(spec | {"truncation": None, "padding": None, "post_processor": None}))


class ChunkEncoder:
    """Encodes texts with one tokenizer file as the library does; keeps what it has encoded."""

    def __init__(self, path: str, least: int = LEAST, mean: int = MEAN) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        odd = any(t["lstrip"] or t["rstrip"] or any(c.isspace() for c in t["content"]) for t in spec["added_tokens"])
        self.whole = odd or not spec["pre_tokenizer"]
        known = family(spec) == "bytes"
        self.pieces = PieceEncoder(path, False, MEMO_PIECES) if known else None
        self.bytes = decoder(path).len if known else None
        self.tok = None if known else plain_tokenizer(spec)
        self.least, self.mean = least, mean
        self.made = self.reused = self.repaired = self.merged = 0
        self.forget()

    def forget(self) -> None:
        self.chunks: dict[bytes, Entry] = {}
        self.windows: dict[bytes, bytes] = {}
        self.held = 0

    def _entry(self, chunk: bytes, enc) -> Entry:
        ids = np.array(enc.ids, np.uint32).tobytes()
        if self.whole or len(chunk) < 8:
            return ids, None
        raw = np.frombuffer(chunk, np.uint8)
        at = np.flatnonzero(_BLANK[raw[:-1]] & _SOLID[raw[1:]])
        if len(at) < 2:
            return ids, None
        plain, spans = chunk.isascii(), enc.offsets
        first = [s for s, _ in spans]
        ends = {}
        for p in {int(at[0]), int(at[1]), int(at[-2]), int(at[-1])}:
            c = p if plain else len(chunk[:p].decode())
            k = bisect_left(first, c)
            if k and spans[k - 1][1] > c:
                return ids, None  # an id reaches over the word start
            ends[p] = k
        a, b, c, d = ends[int(at[-2])], ends[int(at[-1])], ends[int(at[0])], ends[int(at[1])]
        return ids, (a, b, c, d, int(at[-2]), int(at[1])) if a < b and c < d else None

    def _entries(self, chunks: list[bytes]) -> Iterator[Entry]:
        """As ``_entry``, for a byte-level file: an id's place in the text follows from the bytes of those before it."""
        for _, _, ids, at, buf in self.pieces.encode(pa.array(chunks, pa.binary())):
            start = np.concatenate([[0], np.cumsum(self.bytes[ids])])
            edge = start[at]
            word = np.flatnonzero(_BLANK[buf[:-1]] & _SOLID[buf[1:]])
            lo, hi = np.searchsorted(word, edge[:-1]), np.searchsorted(word, edge[1:] - 1)
            own = np.flatnonzero(hi - lo >= 2)
            place = np.stack([word[hi[own] - 2], word[hi[own] - 1], word[lo[own]], word[lo[own] + 1]])
            k = np.searchsorted(start, place)
            good = (start[k] == place).all(0)
            ends: list[tuple[int, int, int, int, int, int] | None] = [None] * (len(at) - 1)
            rows = np.concatenate([k - at[own], place[[0, 3]] - edge[own]]).T
            for c, r, ok in zip(own.tolist(), rows.tolist(), good.tolist(), strict=True):
                if ok:
                    ends[c] = tuple(r)
            raw, at4 = ids.tobytes(), (4 * at).tolist()
            for x, y, e in zip(at4, at4[1:], ends, strict=False):
                yield raw[x:y], e

    def _know(self, chunks: list[bytes]) -> list[Entry]:
        known = self.chunks
        new = list({c for c in chunks if c not in known})
        self.made += len(new)
        self.reused += len(chunks) - len(new)
        if new:
            if self.pieces and not self.whole:
                known.update(zip(new, self._entries(new), strict=True))
            else:
                for c, e in zip(new, self.tok.encode_batch([c.decode("utf-8", "replace") for c in new], add_special_tokens=False), strict=True):
                    known[c] = self._entry(c, e)
            self.held += sum(map(len, new))
        return [known[c] for c in chunks]

    def _look(self, windows: list[bytes]) -> list[bytes]:
        known = self.windows
        new = list({w for w in windows if w not in known})
        if new and self.pieces:
            for i, j, ids, cut, _ in self.pieces.encode(pa.array(new, pa.binary())):
                raw, cut = ids.tobytes(), (4 * cut).tolist()
                known.update(zip(new[i:j], (raw[x:y] for x, y in zip(cut, cut[1:], strict=False)), strict=True))
        elif new:
            for w, e in zip(new, self.tok.encode_batch_fast([w.decode("utf-8", "replace") for w in new], add_special_tokens=False), strict=True):
                known[w] = np.array(e.ids, np.uint32).tobytes()
        self.held += sum(map(len, new))
        return [known[w] for w in windows]

    def _join(self, raw: bytes, cuts: list[list[int]]) -> list[tuple[list[Entry], list[bytes]]]:
        """For each text its pieces and, for each join, the ids that stand in for both sides' (see the module's text). ``cuts`` are thinned to the joins that agree."""
        pieces = [[*p] for p in _split(self._know([raw[a:b] for c in cuts for a, b in zip(c, c[1:])]), [len(c) - 1 for c in cuts])]
        joins: list[list[bytes | None]] = [[None] * (len(p) - 1) for p in pieces]
        todo = [(t, k) for t, j in enumerate(joins) for k in range(len(j))]
        while todo:
            asked, windows = [], []
            for t, k in todo:
                left, right, c = pieces[t][k][1], pieces[t][k + 1][1], cuts[t]
                if left and right:
                    asked.append((t, k))
                    windows.append(raw[c[k] + left[4] : c[k + 1] + right[5]])
            for (t, k), w in zip(asked, self._look(windows), strict=True):
                (a, left), (b, right) = pieces[t][k], pieces[t][k + 1]
                lead, tail = a[4 * left[0] : 4 * left[1]], b[4 * right[2] : 4 * right[3]]
                if len(w) >= len(lead) + len(tail) and w.startswith(lead) and w.endswith(tail):
                    joins[t][k] = w[: len(w) - len(tail)]
                    self.repaired += 1
            bad: dict[int, set[int]] = {}
            for t, k in todo:
                if joins[t][k] is None:
                    bad.setdefault(t, set()).add(k)
            todo = self._merge(raw, cuts, pieces, joins, bad)
        return list(zip(pieces, joins, strict=True))

    def _merge(self, raw: bytes, cuts: list[list[int]], pieces: list[list[Entry]], joins: list[list[bytes | None]], bad: dict[int, set[int]]) -> list[tuple[int, int]]:
        """Take out the joins in ``bad``, encode what they part as one piece; the joins beside such pieces are to be tried again."""
        at, want, again = [], [], []
        for t, ks in bad.items():
            self.merged += len(ks)
            keep = [k for k in range(len(joins[t])) if k not in ks]
            cuts[t] = [cuts[t][0], *(cuts[t][k + 1] for k in keep), cuts[t][-1]]
            runs = [-1, *keep, len(joins[t])]  # a piece is now what stands between two kept joins
            old, joins[t] = pieces[t], [joins[t][k] for k in keep]
            pieces[t] = []
            for m, (x, y) in enumerate(zip(runs, runs[1:], strict=False)):
                pieces[t].append(old[x + 1])
                if y - x > 1:
                    at.append((t, m))
                    want.append(raw[cuts[t][m] : cuts[t][m + 1]])
        for (t, m), e in zip(at, self._know(want), strict=True):
            pieces[t][m] = e
            for k in (m - 1, m):
                if 0 <= k < len(joins[t]) and (t, k) not in again[-2:]:
                    joins[t][k] = None
                    again.append((t, k))
        return again

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(first row, end row, ids, where each text's ids start with one entry more, the texts' bytes)."""
        for i, j, buf, off in groups(texts, CHUNK):
            if self.held > MEMO_BYTES:
                self.forget()
            raw = buf.tobytes()
            cuts = [[a, b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)] if self.whole or not len(buf) else cut_points(buf, off, self.least, self.mean)
            out, sizes = [], [0]
            for pieces, joins in self._join(raw, cuts):
                begin, n = 0, 0
                for k, (ids, ends) in enumerate(pieces):
                    end = 4 * ends[0] if k < len(joins) else len(ids)
                    out.append(ids[begin:end])
                    n += max(0, end - begin)
                    if k < len(joins):
                        out.append(joins[k])
                        n += len(joins[k])
                        begin = 4 * pieces[k + 1][1][2]
                sizes.append(n // 4)
            yield i, j, np.frombuffer(b"".join(out), np.uint32), np.cumsum(sizes), buf


def _split(items: list, counts: list[int]) -> Iterator[list]:
    at = 0
    for n in counts:
        yield items[at : at + n]
        at += n


class ByteDecoder:
    """Bytes of the ids of a byte-level vocabulary."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        # the usual printable stand-ins of the 256 bytes
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        chars = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(own)))}
        vocab = dict(j["model"]["vocab"]) | {t["content"]: t["id"] for t in j["added_tokens"]}
        size = max(vocab.values()) + 1
        table = [b""] * size
        for t, i in vocab.items():
            table[i] = bytes(chars[c] for c in t) if all(c in chars for c in t) else t.encode()
        self.len = np.fromiter(map(len, table), np.int64, size)
        self.at = np.cumsum(self.len) - self.len
        self.pool = np.frombuffer(b"".join(table), np.uint8)

    def decode(self, ids: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts, and where each starts with one entry more."""
        n = self.len[ids]
        return self.pool[ragged(n, self.at[ids])], np.concatenate([[0], np.cumsum(n)])[start]


@lru_cache(4)
def encoder(path: str) -> ChunkEncoder:
    """A worker's encoder for a file; it lives as long as the worker."""
    return ChunkEncoder(path)


@lru_cache(4)
def fast_encoder(path: str) -> PieceEncoder | ChunkEncoder:
    """As ``encoder``; by pieces alone where the file's family is known."""
    with open(path, encoding="utf-8") as f:
        kind = family(json.load(f))
    return PieceEncoder(path, kind == "words") if kind else encoder(path)


@lru_cache(4)
def decoder(path: str) -> ByteDecoder:
    return ByteDecoder(path)


def _default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _afterwards(run, path: str):
    """run, after which the worker forgets the chunks: they are reused within a task, and what comes next has the memory."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            enc = encoder(path)
            enc.forget()
            if enc.pieces:
                enc.pieces.forget()

    return lean(work)


def bpe_round_trip(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """Each row with its ``ids`` (array<int>), ``n_tokens`` and ``decoded`` text; null texts count as empty.

    Columns of these names that the input has already are replaced. Row-wise: no shuffle, repeated
    rows and null ids pass through, and a worker holds a few MB of text beside its bounded memo.
    """
    path = path or _default_path()
    arrow_rows(docs.sparkSession)
    keep = [c for c in docs.columns if c not in ("ids", "n_tokens", "decoded")]
    schema = T.StructType([*docs.select(keep).schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, dec = encoder(path), decoder(path)
        for b in batches:
            for i, j, ids, at, _ in enc.encode(b.column(text_col)):
                data, off = dec.decode(ids, at)
                part = b.slice(i, j - i)
                text = pa.array([data[x:y].tobytes().decode("utf-8", "replace") for x, y in zip(off[:-1], off[1:], strict=True)], pa.string())
                cols = [part.column(c) for c in keep]
                yield pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32))), pa.array(np.diff(at), pa.int64()), text], names=[*keep, "ids", "n_tokens", "decoded"])

    return docs.mapInArrow(_afterwards(run, path), schema)


def bpe_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): the same encoding and decoding, digested where it is made."""
    path = path or _default_path()
    arrow_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, dec = encoder(path), decoder(path)
        for b in batches:
            for i, j, ids, at, _ in enc.encode(b.column(1)):
                data, off = dec.decode(ids, at)
                decimal, doff = decimals(ids, at)
                sha = [hashlib.sha256(decimal[x : max(x, y - 1)]).hexdigest() for x, y in zip(doff[:-1].tolist(), doff[1:].tolist(), strict=True)]
                plain = data if not len(data) or _valid(data, off) else None
                out = [hashlib.sha256(data[x:y] if plain is not None else data[x:y].tobytes().decode("utf-8", "replace").encode()).hexdigest() for x, y in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.diff(at), pa.int64()), pa.array(sha), pa.array(out)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(_afterwards(run, path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _valid(data: np.ndarray, off: np.ndarray) -> bool:
    """Whether all texts are valid UTF-8 (each on its own)."""
    try:
        data.tobytes().decode("utf-8")
    except UnicodeDecodeError:
        return False
    inner = off[(off > 0) & (off < len(data))]
    return not ((data[inner] & 0xC0) == 0x80).any()


_digits: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def decimals(ids: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of "id," for all ids, and where each text starts with one entry more (its last comma is to be left out)."""
    top = 1 << max(16, int(ids.max()).bit_length() if len(ids) else 16)
    if top not in _digits:
        all_ = [b"%d," % k for k in range(top)]
        n = np.fromiter(map(len, all_), np.int64, top)
        _digits[top] = np.frombuffer(b"".join(all_), np.uint8), n, np.cumsum(n) - n
    pool, n, at = _digits[top]
    k = n[ids]
    return pool[ragged(k, at[ids])], np.concatenate([[0], np.cumsum(k)])[start]


def op6(spark, sf_dir):
    """Full result over ``documents``."""
    return bpe_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
