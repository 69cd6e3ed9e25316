"""Quality: supervised subword embeddings averaged over a text, softmax output, trained by numpy SGD.

A text's features are its words, its pairs of neighbouring words in order and the runs of three and four
characters of each word with its borders, hashed. Training keeps a vector for each hash; scoring needs
only each vector's difference of class logits, one number a hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back
from .labelled import SAMPLE_BYTES, remainder, sample
from .textkit import SPACE, U64, groups, mix, span_hashes, words
from .toxicity import score_texts

#: Labelled rows that the model is fitted on; their features take about 25 kB each in the driver.
SAMPLE = 4_000
_BITS = 16
#: Words, runs of three characters, runs of four and word pairs; each kind has its own range of slots and the same share of the average.
_KINDS = 4


def _characters(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, all white space as one blank, and the text of each."""
    start = np.flatnonzero((buf & 0xC0) != 0x80)
    size = np.diff(np.append(start, len(buf)))
    lead = buf[start].astype(np.uint32)
    code = np.where(size > 1, lead & (np.uint32(0x7F) >> size.astype(np.uint32)), lead)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        code[more] = (code[more] << np.uint32(6)) | (buf[start[more] + k] & 0x3F)
    code[SPACE[buf[start]]] = 0x20
    return code, np.searchsorted(off, start, "right") - 1


def _slots(buf: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind (text of each feature, its slot). Runs cross neither words nor texts; a blank stands at a word's borders."""
    n = len(off) - 1
    s, e, first = words(buf, off)
    word, of = span_hashes(buf, s, e), np.repeat(np.arange(n), np.diff(first))
    out = [(of, (word >> U64(64 - _BITS)).astype(np.int64))]
    code, text = _characters(buf, off)
    blank = code == 0x20
    mixed = code * np.uint32(2654435761)
    for k, width in ((1, 3), (2, 4)):
        m = len(code) - width + 1
        if m < 1:
            out.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
            continue
        h, ok = mixed[:m].copy(), text[:m] == text[width - 1 :]
        for j in range(1, width):
            h = h * np.uint32(31) + mixed[j : m + j]
            if j < width - 1:
                ok &= ~blank[j : m + j]
        h = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - _BITS)
        out.append((text[:m][ok], h[ok].astype(np.int64) + (k << _BITS)))
    pair = np.flatnonzero(of[1:] == of[:-1])
    out.append((of[pair], (mix(word[pair] * U64(3) + word[pair + 1]) >> U64(64 - _BITS)).astype(np.int64) + (3 << _BITS)))
    return out


class QualityModel:
    """Two classes; label 1 is good."""

    def __init__(self, texts: pa.Array, y: np.ndarray, dim: int = 8, epochs: int = 4, rate: float = 6.0, batch: int = 32, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        size = _KINDS << _BITS
        e = ((rng.random((dim, size)) - 0.5) / dim).astype(np.float32)
        w, bias = ((rng.random((dim, 2)) - 0.5)).astype(np.float32), np.zeros(2, np.float32)
        rows = []  # each text: distinct slots and their shares
        for _, _, buf, off in groups(texts):
            kinds = _slots(buf, off)
            bags: list[list[np.ndarray]] = [[] for _ in range(len(off) - 1)]
            for of, slot in kinds:
                at = np.searchsorted(of, np.arange(len(off)))
                for t in range(len(off) - 1):
                    bags[t].append(slot[at[t] : at[t + 1]])
            slots, shares = [], []
            for b in bags:
                parts = [np.unique(p, return_counts=True) for p in b if len(p)]
                slots.append(np.concatenate([p[0] for p in parts]).astype(np.int32) if parts else np.zeros(0, np.int32))
                shares.append(np.concatenate([p[1] / p[1].sum() / len(parts) for p in parts]).astype(np.float32) if parts else np.zeros(0, np.float32))
            # views of two arrays a group, which the system takes back whole
            at, slot, share = np.cumsum([0, *map(len, slots)]).tolist(), np.concatenate(slots), np.concatenate(shares)
            rows += [(slot[a:b], share[a:b]) for a, b in zip(at, at[1:], strict=False)]
        balance = np.clip(len(y) / 2 / np.maximum(np.bincount(y, minlength=2), 1), 0.3, 3.0) if len(y) else np.ones(2)
        for epoch in range(epochs if len(y) else 0):
            lr = rate * (1 - epoch / epochs)
            order = rng.permutation(len(y))
            for k in range(0, len(order), batch):
                pick = [i for i in order[k : k + batch] if len(rows[i][0])]
                if not pick:
                    continue
                slot, share = np.concatenate([rows[i][0] for i in pick]), np.concatenate([rows[i][1] for i in pick])
                lens = np.array([len(rows[i][0]) for i in pick])
                start = np.cumsum(lens) - lens
                h = np.stack([np.add.reduceat(e[d][slot] * share, start) for d in range(dim)], 1)
                z = h @ w + bias
                z -= z.max(1, keepdims=True)
                p = np.exp(z)
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(pick)), y[pick]] -= 1
                p *= balance[y[pick]][:, None]
                back = p @ w.T
                w -= (lr / 20 / len(pick)) * (h.T @ p)
                bias -= (lr / 20 / len(pick)) * p.sum(0)
                for d in range(dim):
                    np.subtract.at(e[d], slot, np.float32(lr) * np.repeat(back[:, d].astype(np.float32), lens) * share)
        self.table = (e.T @ (w[:, 1] - w[:, 0])).astype(np.float32)
        self.bias = float(bias[1] - bias[0])

    def score(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        n = len(off) - 1
        if not len(buf):
            return np.full(n, 1 / (1 + np.exp(-self.bias)))
        total, kinds = np.zeros(n), np.zeros(n)
        for of, slot in _slots(buf, off):
            c = np.bincount(of, minlength=n)
            total += np.bincount(of, self.table[slot], n) / np.maximum(c, 1)
            kinds += c > 0
        return 1 / (1 + np.exp(-(total / np.maximum(kinds, 1) + self.bias)))


def fit_quality(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> QualityModel:
    """Learns from at most ``bound`` labelled rows and ``most_bytes`` bytes of their texts, rows whose crc32 of the id modulo 3 is not 1."""
    model = QualityModel(*sample(docs, labels, "quality", remainder("doc_id", 3) != 1, bound, most_bytes))
    give_back()
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each document; empty and null texts get the prior's score.

    Repeated rows score alike. A null id is not held out. A table without labels gives every text 0.5 or near it.
    """
    model = fit_quality(docs, labels, bound, most_bytes)
    scored = score_texts(docs.select(F.col("doc_id"), F.col("text")), model, "text", "score")
    return scored.select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9(spark, sf_dir):
    """Full result over ``documents``."""
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
