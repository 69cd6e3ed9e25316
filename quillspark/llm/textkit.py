"""Vectorised work on the bytes of many texts at once (numpy only)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_R = 0x9E3779B97F4A7C15
_RINV = pow(_R, -1, 1 << 64)
#: ASCII white space, as in the word pattern [^\x20\x09-\x0D]+
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text worked on at a time; a longer text is taken alone and whole.
CHUNK = 1 << 20
_pow: dict[str, np.ndarray] = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow["up"]) < n:
        n = 1 << (n - 1).bit_length()
        for name, r in (("up", _R), ("down", _RINV)):
            x = np.full(n, r, U64)
            x[0] = 1
            _pow[name] = np.cumprod(x, dtype=U64)
    return _pow["up"], _pow["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes, equal for equal bytes wherever they stand."""
    if not len(starts):
        return np.zeros(0, U64)
    up, down = _powers(len(buf) + 1)
    c = np.zeros(len(buf) + 1, U64)
    np.cumsum((buf.astype(U64) + U64(1)) * up[: len(buf)], out=c[1:])
    return mix((c[ends] - c[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


#: Words of more bytes are hashed one by one.
_LONG = 64


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, mixed eight bytes at a time (not a polynomial of the bytes, for which equal hashes are easy to make)."""
    n = (ends - starts).astype(np.int64)
    h = mix(n.astype(U64) * U64(0xD6E8FEB86659FD93) + U64(1))
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    lanes = np.ndarray(len(buf) + 1, "<u8", padded.data, strides=(1,))
    left = np.flatnonzero(n <= _LONG)
    for k in range(0, _LONG, 8):
        left = left[n[left] > k]
        if not len(left):
            break
        lane = lanes[starts[left] + k]
        rest = n[left] - k
        cut = rest < 8
        lane[cut] &= (U64(1) << (U64(8) * rest[cut].astype(U64))) - U64(1)
        h[left] = mix((h[left] ^ lane) * U64(0x9E3779B97F4A7C15) + U64(0x632BE59BD9B4E019))
    far = np.flatnonzero(n > _LONG)
    if len(far):
        import xxhash

        raw = buf.tobytes()
        h[far] = [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(starts[far].tolist(), ends[far].tolist(), strict=True)]
    return h


def groups(texts: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with at most ``most`` bytes, or a single longer text. Null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if not n:
        return
    if texts.null_count:
        texts = texts.fill_null("" if not pa.types.is_binary(texts.type) else b"")
    _, offs, data = texts.buffers()
    off = np.frombuffer(offs, np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def words(buf: np.ndarray, off: np.ndarray, parts: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all runs of bytes that are not in ``parts``, and how many come before each text (one more entry than texts)."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    solid = ~parts[buf]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    starts = np.flatnonzero(solid & (~before | edge[:n]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


_ROLE = np.array([0x8CB92BA72F3D8DD7, 0xAAAAAB5CC3F0D1A5, 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD], U64)


def shingle_sets(buf: np.ndarray, off: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes (62 bits) of its shingles of ``width`` words, lower-cased A-Z; fewer words make one shingle, none an empty set."""
    starts, ends, first = words(buf, off)
    w = word_hashes(LOWER[buf], starts, ends)
    n = len(w)
    roles = mix(np.arange(1, width + 1, dtype=U64) * _ROLE[0])
    roles |= U64(1)
    full = np.zeros(max(0, n - width + 1), U64)
    for j in range(width):
        full += w[j : n - width + 1 + j] * roles[j] if len(full) else full
    full = mix(full) >> U64(2)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(full[a : b - width + 1]))
        elif b > a:
            out.append(mix(np.array([(w[a:b] * roles[: b - a]).sum(dtype=U64) + U64(int(b - a))], U64)) >> U64(2))
        else:
            out.append(np.zeros(0, U64))
    return out


def exact_sets(texts: list[tuple[np.ndarray, np.ndarray]], width: int = 5) -> list[np.ndarray]:
    """As ``shingle_sets`` for all texts of (bytes, offsets) groups together, with numbers that are equal only for equal shingles: no hashes."""
    number: dict[bytes, int] = {}
    ids, counts = [np.zeros(0, np.int64)], []
    for buf, off in texts:
        s, e, first = words(buf, off)
        raw, give, count = LOWER[buf].tobytes(), number.setdefault, number.__len__
        ids.append(np.fromiter((give(raw[a:b], count()) for a, b in zip(s.tolist(), e.tolist(), strict=True)), np.int64, len(s)))
        counts.append(np.diff(first))
    w, n = np.concatenate(ids), np.concatenate([np.zeros(0, np.int64), *counts])
    end = np.cumsum(n)
    # a text of fewer words is one shingle, filled up with a word that no text has
    short = (n > 0) & (n < width)
    if short.any():
        size = np.where(short, width, n)
        at = np.cumsum(size) - size
        full = np.full(int(size.sum()), len(number), np.int64)
        full[ragged(n, at)] = w
        w, n, end = full, size, np.cumsum(size)
    run, most = w, len(number) + 1
    for k in range(1, width):  # each round numbers the runs of one more word
        if len(run) < 2:
            break
        run = np.unique(run[:-1] * most + w[k:], return_inverse=True)[1].astype(np.int64)
    return [np.unique(run[b - a : b - width + 1]) if a >= width else np.zeros(0, np.int64) for a, b in zip(n.tolist(), end.tolist(), strict=True)]


def plain_words(buf: np.ndarray, off: np.ndarray) -> list[bytes]:
    """Each text's words, lower-cased A-Z, with single spaces between."""
    if not len(buf):
        return [b""] * (len(off) - 1)
    solid = ~SPACE[buf]
    keep = solid.copy()
    keep[1:] |= solid[:-1]  # the first white space after a word
    inner = off[1:-1][off[1:-1] < len(buf)]
    keep[inner] = solid[inner]
    low = np.where(solid, LOWER[buf], np.uint8(0x20))[keep].tobytes()
    at = np.concatenate([[0], np.cumsum(keep)])[off].tolist()
    return [low[a:b].rstrip(b" ") for a, b in zip(at, at[1:], strict=False)]


def ragged(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of each run, one run after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    keep = lengths > 0
    lengths, starts = lengths[keep], starts[keep]
    step = np.ones(total, np.int64)
    at = np.cumsum(lengths)[:-1]
    step[0] = starts[0]
    step[at] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(step)
