"""Dealing a table into key ranges of about equal size, however often a key repeats."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sampled rows a range; they only steer how even the ranges are.
SAMPLED = 64


class Ranges:
    """Ascending bounds on (key, hash); rows with a null key come after all others, ordered by hash alone.

    A key that holds many rows has several bounds, which part its rows by their hash.
    """

    def __init__(self, keys: np.ndarray, hashes: np.ndarray, null_hashes: np.ndarray) -> None:
        self.keys, self.hashes, self.null_hashes = keys, hashes, null_hashes

    @property
    def count(self) -> int:
        return len(self.keys) + len(self.null_hashes) + 2

    def place(self, key: pa.Array, hashed: pa.Array) -> np.ndarray:
        """The range of each row."""
        null = key.is_null().to_numpy(zero_copy_only=False)
        k, h = key.fill_null(0).to_numpy(), hashed.to_numpy()
        lo, out = np.searchsorted(self.keys, k, "left"), np.searchsorted(self.keys, k, "right")
        for a in np.unique(lo[(lo < out) & ~null]).tolist():
            own = (lo == a) & (lo < out) & ~null
            b = int(out[own][0])
            out[own] = a + np.searchsorted(self.hashes[a:b], h[own], "right")
        return np.where(null, len(self.keys) + 1 + np.searchsorted(self.null_hashes, h, "right"), out)


def ranges(rows: DataFrame, key: str, hashed: str, most_rows: int, least: int = 1) -> Ranges:
    """Ranges of about ``most_rows`` rows of (key, hashed), at least ``least`` of them where there are rows enough.

    The bounds come from a random sample of ``SAMPLED`` rows a range; every row has its range whatever was drawn.
    """
    n = rows.count()
    parts = max(n // most_rows + 1, min(least, n // 64 + 1))
    if parts < 2:
        none = np.zeros(0, np.int64)
        return Ranges(none, none, none)
    some = rows.select(key, hashed)
    rate = SAMPLED * parts / n
    t = (some.sample(False, rate, 7) if rate < 0.9 else some).toArrow()  # SAMPLED rows a range
    k, h = t.column(0).combine_chunks(), t.column(1).combine_chunks()
    null = k.is_null().to_numpy(zero_copy_only=False)
    k, h = k.fill_null(0).to_numpy(), h.to_numpy()
    order = np.lexsort((h, k, null))
    at = order[np.unique(np.linspace(0, len(order), parts, endpoint=False).astype(np.int64)[1:])] if len(order) else order
    own, rest = at[~null[at]], at[null[at]]
    return Ranges(k[own], h[own], h[rest])


def row_hash(text: str):
    """What orders rows of one key: a hash of the text."""
    return F.coalesce(F.xxhash64(F.col(text)), F.lit(0)).cast("long")
