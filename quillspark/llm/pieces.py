"""Fast counting and encoding for pre-tokenizers that are known to start afresh at white space.

Two families of tokenizer files are known here: byte-level BPE without a normaliser, and BPE with word
ends that folds white space to one space and drops it. In both nothing reaches over a single space or
line feed between two characters of which neither is white space nor combining, nor over the place
before a mark such as a comma that follows a letter. A text is cut there; a piece that a worker has met before is
looked up by its bytes, the others go to the tokenizers library in one call. ``bpe.ChunkEncoder`` makes
no such assumption and is used for all other files.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa

from .textkit import CHUNK, LOWER, groups, ragged

#: Pieces and ids that a worker remembers; when either is passed it forgets all and goes on.
MEMO_PIECES, MEMO_IDS = 1_000_000, 6_000_000
_GAP = np.zeros(256, bool)
_GAP[[0x20, 0x0A]] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[0x21:0x7F] = True
#: Lead bytes of two-byte letters and signs that neither combine nor count as white space.
_TWO = np.zeros(256, bool)
_TWO[0xC3:0xCC] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: Lead bytes of two-byte letters, but for the signs that end in 0x97 and 0xB7; the dotted capital I (0xC4 0xB0) is left out too, its small form ends in a combining dot.
_WORDY = np.zeros(256, bool)
_WORDY[0xC3:0xCA] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ",.;:!?"]] = True


def family(spec: dict) -> str | None:
    """``bytes`` or ``words`` for what stands in a file of a known family, else None."""
    if spec["model"].get("type") != "BPE" or any(t["lstrip"] or t["rstrip"] or any(c.isspace() for c in t["content"]) for t in spec["added_tokens"]):
        return None
    kinds = lambda x, many: [x["type"], *(y["type"] for y in x.get(many, ()))] if x else []
    before, cut = kinds(spec["normalizer"], "normalizers"), kinds(spec["pre_tokenizer"], "pretokenizers")
    if not before and cut == ["ByteLevel"] and not spec["pre_tokenizer"]["add_prefix_space"] and spec["pre_tokenizer"].get("use_regex", True):
        return "bytes"
    if before == ["Sequence", "NFC", "Replace", "Lowercase"] and cut == ["Sequence", "Split", "ByteLevel"] and spec["pre_tokenizer"]["pretokenizers"][0]["behavior"] == "Removed":
        return "words"
    return None


class PieceEncoder:
    """Encodes texts by pieces; ``drops``: the tokenizer drops white space, so a piece is keyed without the gap it begins with."""

    def __init__(self, path: str, drops: bool, pieces: int | None = None) -> None:
        """pieces: how many to remember, MEMO_PIECES by default."""
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.drops, self.most = drops, pieces
        self.forget()

    def forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.at, self.n = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.ids, self.used = np.zeros(1 << 18, np.uint32), 0

    def _learn(self, held: int) -> None:
        """Encode the pieces that have been given places from ``held`` on."""
        new = list(islice(reversed(self.place), len(self.place) - held))[::-1]
        found = [e.ids for e in self.tok.encode_batch_fast([x.decode("utf-8", "replace") for x in new], add_special_tokens=False)]
        n = np.fromiter(map(len, found), np.int64, len(found))
        total = int(n.sum())
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.place) > len(self.at):
            self.at, self.n = np.concatenate([self.at, np.zeros_like(self.at)]), np.concatenate([self.n, np.zeros_like(self.n)])
        self.ids[self.used : self.used + total] = np.fromiter(chain.from_iterable(found), np.uint32, total)
        self.at[held : len(self.place)], self.n[held : len(self.place)] = self.used + np.cumsum(n) - n, n
        self.used += total

    def cuts(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Where the pieces of all texts start, ascending."""
        n = len(buf)
        cut = np.zeros(n + 1, bool)
        gap = np.flatnonzero(_GAP[buf])
        gap = gap[(gap > 0) & (gap < n - 1)]
        back = buf[gap - 1]
        ok = _PLAIN[back] | ((back >= 0x80) & _TWO[buf[np.maximum(gap - 2, 0)]])
        after = buf[gap + 1]
        ok &= _PLAIN[after] | _TWO[after]
        cut[gap[ok]] = True
        mark = np.flatnonzero(_MARK[buf])
        mark = mark[mark > 1]
        back, back2 = buf[mark - 1], buf[mark - 2]
        cut[mark[_LETTER[back] | ((back >= 0x80) & _WORDY[back2] & (back != 0x97) & (back != 0xB7) & ~((back2 == 0xC4) & (back == 0xB0)))]] = True
        edge = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < n)]
        cut[edge - 1] &= ~_GAP[buf[edge - 1]]  # a gap that ends a text has nothing behind it
        cut[off[:-1][off[1:] > off[:-1]]] = True
        cut[n] = False
        return np.flatnonzero(cut)

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(first row, end row, ids, where each text's ids start with one entry more, the texts' bytes)."""
        for i, j, buf, off in groups(texts, CHUNK):
            if not len(buf):
                yield i, j, np.zeros(0, np.uint32), np.zeros(j - i + 1, np.int64), buf
                continue
            if len(self.place) > (self.most or MEMO_PIECES) or self.used > MEMO_IDS:
                self.forget()
            s = self.cuts(buf, off)
            e = np.append(s[1:], len(buf))
            head = s + (_GAP[buf[s]] & (e > s + 1)) if self.drops else s
            raw, place = buf.tobytes(), self.place
            if self.drops and b"<|" not in raw:  # this family folds A-Z anyway, but added tokens are told by case
                raw = LOWER[buf].tobytes()
            held, give, count = len(place), place.setdefault, place.__len__
            at = np.fromiter((give(raw[a:b], count()) for a, b in zip(head.tolist(), e.tolist(), strict=True)), np.int64, len(s))
            if len(place) > held:
                self._learn(held)
            n = self.n[at]
            before = np.concatenate([[0], np.cumsum(n)])
            yield i, j, self.ids[ragged(n, self.at[at])], before[np.searchsorted(s, off)], buf
