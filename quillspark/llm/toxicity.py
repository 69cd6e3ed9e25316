"""Toxicity: boosted trees over dense features of a text, calibrated by isotonic regression.

The lexicon has a fixed English part and a learned part: words and word beginnings that labelled toxic
texts hold far more often than others, kept as weights by hash. The sample is halved: a text's features
for the trees come from the lexicon of the other half, and the margins that isotonic regression is
fitted on from trees of the other half; the lexicon and the trees that score are those of all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, give_back, lean
from .labelled import SAMPLE_BYTES, remainder, sample
from .textkit import U64, groups, span_hashes, words

INSULTS = "idiot idiots moron morons stupid dumb loser losers pathetic worthless trash garbage scum clown disgusting vile filthy ugly jerk creep freak fool imbecile cretin dimwit halfwit bastard pig swine vermin parasite maggot hate hateful kill die shut crap damn suck sucks".split()
SECOND_PERSON = "you your yours youre yourself u ur thou tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer tú ti tus usted ustedes vosotros".split()
#: Labelled rows that the model is fitted on, drawn by a hash of the id.
SAMPLE = 6_000
_SLOTS = 1 << 19
#: Word beginnings in bytes that the learned lexicon tells apart; 0 is the whole word.
STEMS = (0, 4, 5, 6)
_PARTS = np.ones(256, bool)
_PARTS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100), 0x40, 0x24]] = False
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
for _a, _b in zip("013457@$", "oieastas", strict=True):
    _FOLD[ord(_a)] = ord(_b)
_UPPER, _LETTER, _PUNCT, _SWAP = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = True
_LETTER[[*range(65, 91), *range(97, 123), *range(0xC3, 0xCA)]] = True
_PUNCT[[ord(c) for c in "!?*#$%&@^~"]] = True
_SWAP[[ord(c) for c in "013457@$*!|+"]] = True
FEATURES = ("fixed_density", "learned_density", "learned_hits", "best", "near_second", "second_density", "capitals", "shouts", "punctuation", "obfuscated", "repeats", "log_words")


def _hash_words(ws: list[str]) -> np.ndarray:
    folded = [bytes(_FOLD[np.frombuffer(w.encode(), np.uint8)]) for w in ws]
    at = np.cumsum([0, *map(len, folded)])
    return np.unique(span_hashes(np.frombuffer(b"".join(folded), np.uint8), at[:-1], at[1:]))


_FIXED, _SECOND = _hash_words(INSULTS), _hash_words(SECOND_PERSON)


def _among(h: np.ndarray, few: np.ndarray) -> np.ndarray:
    p = np.minimum(np.searchsorted(few, h), len(few) - 1)
    return few[p] == h


def _terms(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(text of each word, word lengths, whole-word hashes, slots of each stem or -1)."""
    s, e, first = words(buf, off, _PARTS)
    folded = _FOLD[buf]
    whole = span_hashes(folded, s, e)
    slots = [(whole % U64(_SLOTS)).astype(np.int64)]
    for n in STEMS[1:]:
        h = span_hashes(folded, s, np.minimum(s + n, e)) + U64(n)
        slots.append(np.where(e - s > n, (h % U64(_SLOTS)).astype(np.int64), -1))
    return np.repeat(np.arange(len(off) - 1), np.diff(first)), first, whole, slots


def features(buf: np.ndarray, off: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text; all zeros for an empty one."""
    n = len(off) - 1
    if not len(buf):
        return np.zeros((n, len(FEATURES)))
    of, first, whole, slots = _terms(buf, off)
    size, count = np.maximum(np.diff(off), 1), np.maximum(np.diff(first), 1)
    per = lambda x: np.bincount(of, x, n)
    weight = lexicon[slots[0]] if len(of) else np.zeros(0)
    for s in slots[1:]:
        weight = np.maximum(weight, np.where(s >= 0, lexicon[s], 0))
    fixed, second = _among(whole, _FIXED) if len(of) else np.zeros(0, bool), _among(whole, _SECOND) if len(of) else np.zeros(0, bool)
    bad = np.flatnonzero((weight > 1.5) | fixed)
    you = np.flatnonzero(second)
    near = np.zeros(len(of))
    if len(bad) and len(you):
        p = np.searchsorted(you, bad)
        for q in (np.minimum(p, len(you) - 1), np.maximum(p - 1, 0)):
            near[bad] = np.maximum(near[bad], (np.abs(you[q] - bad) <= 5) & (of[you[q]] == of[bad]))
    best = np.zeros(n)
    np.maximum.at(best, of, weight)
    text = np.repeat(np.arange(n), np.diff(off))
    byte = lambda m: np.bincount(text[m], minlength=n) / size
    up, let = _UPPER[buf], _LETTER[buf]
    inner = np.zeros(len(buf), bool)
    inner[1:-1] = _SWAP[buf[1:-1]] & let[:-2] & let[2:]
    again = np.zeros(len(buf), bool)
    again[2:] = let[2:] & (buf[2:] == buf[1:-1]) & (buf[2:] == buf[:-2])
    shout = np.zeros(len(buf), bool)
    shout[2:] = up[2:] & up[1:-1] & up[:-2]
    return np.stack([per(fixed) / count, per(weight) / count, per(weight > 1.5), best, per(near), per(second) / count, byte(up), byte(shout), byte(_PUNCT[buf]), byte(inner), byte(again), np.log1p(np.diff(first))], 1)


def learn_lexicon(texts: pa.Array, y: np.ndarray) -> np.ndarray:
    """Weights by slot: log odds of toxic texts holding a word or stem, 0 below 1.5 or in fewer than 3 of them."""
    seen = np.zeros((2, _SLOTS))
    for i, j, buf, off in groups(texts):
        of, _, _, slots = _terms(buf, off)
        for s in slots:
            pair = np.unique(of[s >= 0] * _SLOTS + s[s >= 0])
            for k in (0, 1):
                seen[k] += np.bincount(pair[y[i:j][pair // _SLOTS] == k] % _SLOTS, minlength=_SLOTS)
    n = np.maximum(np.bincount(y, minlength=2), 1)
    odds = np.log((seen[1] + 0.2) / n[1]) - np.log((seen[0] + 0.2) / n[0])
    return np.where((seen[1] >= 3) & (odds > 1.5), odds, 0).astype(np.float32)


class BoostedTrees:
    """Gradient-boosted regression trees on quantile bins, logistic loss, Newton leaves."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, l2: float = 1.0) -> None:
        self.n, self.depth, self.rate, self.bins, self.l2 = trees, depth, rate, bins, l2

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
        b = np.stack([np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T, strict=True)], 1)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3) if len(y) else 0.5
        self.base, self.trees = float(np.log(p / (1 - p))), []
        f = np.full(len(y), self.base)
        for _ in range(self.n if len(y) else 0):
            q = 1 / (1 + np.exp(-f))
            g, h = y - q, q * (1 - q)
            node, splits = np.zeros(len(y), np.int64), []
            for level in range(self.depth):
                width = 1 << level
                feat, cut = np.zeros(width, np.int64), np.full(width, self.bins)
                top = np.zeros(width)
                for k in range(x.shape[1]):
                    cell = node * self.bins + b[:, k]
                    gs = np.bincount(cell, g, width * self.bins).reshape(width, -1).cumsum(1)
                    hs = np.bincount(cell, h, width * self.bins).reshape(width, -1).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.l2) + (gt - gs) ** 2 / (ht - hs + self.l2) - gt**2 / (ht + self.l2)
                    gain[(hs < 1) | (ht - hs < 1)] = 0
                    at = gain.argmax(1)
                    own = gain[np.arange(width), at]
                    feat, cut, top = np.where(own > top, k, feat), np.where(own > top, at, cut), np.maximum(own, top)
                splits.append((feat, cut))
                node = 2 * node + (b[np.arange(len(y)), feat[node]] > cut[node])
            leaf = self.rate * np.bincount(node, g, 1 << self.depth) / (np.bincount(node, h, 1 << self.depth) + self.l2)
            f += leaf[node]
            self.trees.append((splits, leaf))
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = np.stack([np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T, strict=True)], 1)
        f, row = np.full(len(x), self.base), np.arange(len(x))
        for splits, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for feat, cut in splits:
                node = 2 * node + (b[row, feat[node]] > cut[node])
            f += leaf[node]
        return f


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators fit: ascending points and their values."""
    xs, inv = np.unique(x, return_inverse=True)
    w = np.bincount(inv).astype(float)
    v = np.bincount(inv, y) / w
    blocks: list[list[float]] = []
    for a, b, c in zip(v.tolist(), w.tolist(), xs.tolist(), strict=True):
        blocks.append([a, b, c, c])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            a2, b2, _, hi = blocks.pop()
            p = blocks[-1]
            p[0], p[1], p[3] = (p[0] * p[1] + a2 * b2) / (p[1] + b2), p[1] + b2, hi
    at = np.array([z for p in blocks for z in (p[2], p[3])])
    return at, np.array([z for p in blocks for z in (p[0], p[0])])


class ToxicityModel:
    """Lexicon, trees and calibration, each from all rows; what one step tells the next comes from the half that the row is not in."""

    def __init__(self, texts: pa.Array, y: np.ndarray) -> None:
        part = np.random.default_rng(11).random(len(y)) < 0.5
        halves = [np.flatnonzero(part), np.flatnonzero(~part)]
        turns = (halves, halves[::-1])
        x, margin = np.zeros((len(y), len(FEATURES))), np.zeros(len(y))
        for own, other in turns:  # features by a lexicon that has not seen the text, as with new texts
            self.lexicon = learn_lexicon(texts.take(pa.array(own)), y[own])
            x[other] = self._features(texts.take(pa.array(other)))
        for own, other in turns:
            margin[other] = BoostedTrees().fit(x[own], y[own]).margin(x[other])
        self.trees, self.lexicon = BoostedTrees().fit(x, y), learn_lexicon(texts, y)
        # two made-up calibration rows keep the ends off 0 and 1 and a table without labels defined
        self.at, self.value = isotonic(np.concatenate([[-9.0, 9.0], margin]), np.concatenate([[0, 1], y]).astype(float))

    def _features(self, texts: pa.Array) -> np.ndarray:
        return np.concatenate([np.zeros((0, len(FEATURES))), *(features(buf, off, self.lexicon) for _, _, buf, off in groups(texts))])

    def score(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        return np.interp(self.trees.margin(features(buf, off, self.lexicon)), self.at, self.value)


def score_texts(docs: DataFrame, model: object, text_col: str, column: str) -> DataFrame:
    """docs with the model's score of each whole text (null: empty) in ``column``; row-wise, no shuffle."""
    arrow_rows(docs.sparkSession)
    from pyspark.sql import types as T

    keep = [c for c in docs.columns if c != column]
    schema = T.StructType([*docs.select(keep).schema.fields, T.StructField(column, T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few MB, whatever the table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [sent.value.score(buf, off) for _, _, buf, off in groups(b.column(text_col))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(np.concatenate([np.zeros(0), *parts]), pa.float64())], names=[*keep, column])

    return docs.mapInArrow(lean(run), schema)


def fit_toxicity(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> ToxicityModel:
    """Learns from at most ``bound`` labelled rows and ``most_bytes`` bytes of their texts, rows whose crc32 of the id modulo 5 is not 0."""
    model = ToxicityModel(*sample(docs, labels, "toxic", remainder("doc_id", 5) != 0, bound, most_bytes))
    give_back()
    return model


def toxicity_scores(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each document; empty and null texts get a score too.

    Repeated rows score alike. A null id is not held out. A table without labels gives every text the
    same middling score.
    """
    model = fit_toxicity(docs, labels, bound, most_bytes)
    scored = score_texts(docs.select(F.col("doc_id"), F.col("text")), model, "text", "score")
    return scored.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8(spark, sf_dir):
    """Full result over ``documents``."""
    return toxicity_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
