"""Byte-level BPE through the `tokenizers` library, with a vectorised memo of pre-tokens.

A byte-level BPE without a normaliser encodes each pre-token on its own, so a text's ids are
the ids of its pre-tokens in order. `Encoder` cuts texts into pre-tokens with numpy, asks the
library once for each distinct pre-token, and gathers the rest from a hash table, whose entries
keep their code points: what it finds is compared letter by letter, and a pre-token that only
shares another's hash goes to the library itself. Texts with
characters whose class could differ between Unicode versions, or that hold the literal of a
special token, go to the library whole.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np

#: Splitting pattern of the byte-level pre-tokenizer (a fixed value of the vocabulary file):
#: 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+
OTHER, LETTER, NUMBER, SPACE, UNSURE = 0, 1, 2, 3, 7
_SPACES = {9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}
_LIMIT = 0x3400
_PIECE = 1 << 18
#: Code points that the memo's entries hold at most, beyond those of one group of texts.
_HELD = 1 << 22
#: Pre-tokens that the library is given at once.
_RUN = 1000
_MUL = 0x9E3779B97F4A7C15
_BASE = 0xD1342543DE82EF95
_MASK = (1 << 64) - 1


def _classes() -> np.ndarray:
    """Class of each code point below `_LIMIT`; unassigned in old Unicode or odd: UNSURE."""
    old = unicodedata.ucd_3_2_0
    table = np.full(_LIMIT + 1, UNSURE, np.uint8)
    for c in range(_LIMIT):
        a, b = unicodedata.category(chr(c)), old.category(chr(c))
        if c in _SPACES:
            table[c] = SPACE
        elif a[0] != b[0] or a in ("Cn", "Co", "Cs", "Zs", "Zl", "Zp") or c in (0x85, 0x180E, *range(0x1C, 0x20)):
            table[c] = UNSURE
        else:
            table[c] = {"L": LETTER, "N": NUMBER}.get(a[0], OTHER)
    return table


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for b in (_BASE, inverse):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class Encoder:
    """`encode(texts)` gives (ids of all texts in order, number of ids of each text)."""

    def __init__(self, path: str, slots_log2: int = 20, fill: float = 0.75):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.path, self._whole = path, None
        # pre-tokens are cut already: for these the library need not run its pattern again
        self.words = Tokenizer.from_file(path)
        self.words.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.special = [t.content for t in self.words.get_added_tokens_decoder().values()]
        self.classes = _classes()
        self.slots_log2, self.fill = slots_log2, fill
        self.pow, self.inv = _powers(_PIECE + 1)
        self.dtype = np.uint16 if self.words.get_vocab_size() <= 65536 else np.uint32
        self._reset()

    @property
    def library(self):
        """The tokenizer as it is, for whole texts; loaded when the first one needs it."""
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self.path)
        return self._whole

    def _reset(self) -> None:
        n = 1 << self.slots_log2
        self.keys, self.entry = np.zeros(n, np.uint64), np.zeros(n, np.int32)
        # of each entry: its ids in `store` and its code points in `held`
        self.offset, self.length, self.n = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), 0
        self.at, self.size = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.store, self.used = np.zeros(1 << 18, self.dtype), 0
        self.held, self.n_held = np.zeros(1 << 18, np.uint16), 0  # the memo has none from `_LIMIT` on

    def _full(self, entries: int, points: int) -> bool:
        return self.n > 0 and (self.n + entries > self.fill * (1 << self.slots_log2) or self.n_held + points > _HELD)

    def _library(self, texts: list[str]) -> list[list[int]]:
        # few at a time: the library's own objects take a hundred times the ids' room
        runs = (texts[a : a + _RUN] for a in range(0, len(texts), _RUN))
        return [e.ids for run in runs for e in self.words.encode_batch_fast(run, add_special_tokens=False)]

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Entry of each hash, -1 where there is none."""
        mask = (1 << self.slots_log2) - 1
        slot = (hashes >> np.uint64(64 - self.slots_log2)).astype(np.int64)
        key = self.keys[slot]
        out = np.where(key == hashes, self.entry[slot], -1)
        open_ = np.flatnonzero((key != hashes) & (key != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & mask
            key = self.keys[slot[open_]]
            hit = key == hashes[open_]
            out[open_[hit]] = self.entry[slot[open_[hit]]]
            open_ = open_[~hit & (key != 0)]
        return out

    def _add(self, hashes: np.ndarray, pieces: list[str], points: np.ndarray) -> None:
        """Entries for new, distinct hashes; `points` are all code points of `pieces`."""
        while self.n + len(hashes) > self.fill * (1 << self.slots_log2):  # only an empty memo grows
            self.slots_log2 += 1
            self._reset()
        ids = self._library(pieces)
        lengths = np.fromiter(map(len, ids), np.int32, len(ids))
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat = np.fromiter((x for i in ids for x in i), self.dtype, int(lengths.sum()))
        first, self.n = self.n, self.n + len(ids)
        while self.n > len(self.offset):
            more = 2 * len(self.offset)
            self.offset, self.length, self.at, self.size = (np.resize(x, more) for x in (self.offset, self.length, self.at, self.size))
        while self.used + len(flat) > len(self.store):
            self.store = np.resize(self.store, 2 * len(self.store))
        while self.n_held + len(points) > len(self.held):
            self.held = np.resize(self.held, 2 * len(self.held))
        self.offset[first : self.n] = self.used + np.cumsum(lengths) - lengths
        self.length[first : self.n] = lengths
        self.store[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.at[first : self.n] = self.n_held + np.cumsum(sizes) - sizes
        self.size[first : self.n] = sizes
        self.held[self.n_held : self.n_held + len(points)] = points
        self.n_held += len(points)
        mask = (1 << self.slots_log2) - 1
        slot = (hashes >> np.uint64(64 - self.slots_log2)).astype(np.int64)
        left = np.arange(len(hashes))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            self.keys[slot[free]] = hashes[free]
            won = free[self.keys[slot[free]] == hashes[free]]
            self.entry[slot[won]] = first + won
            left = np.setdiff1d(left, won, assume_unique=True)
            slot[left] = (slot[left] + 1) & mask

    def _starts(self, points: np.ndarray, kinds: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Positions where pre-tokens begin; `first` are those where pieces begin."""
        n = len(points)
        start = np.empty(n, bool)
        start[0] = True
        np.not_equal(kinds[1:], kinds[:-1], out=start[1:])
        edge = np.zeros(n + 1, bool)
        edge[first] = True
        edge[n] = True
        start[edge[:n]] = True
        # the last white space before a non-space stands alone, or joins it if it is U+0020
        after = np.flatnonzero((kinds[1:] != SPACE) & (kinds[:-1] == SPACE)) + 1
        after = after[~edge[after]]
        start[after - 1] = True
        start[after[points[after - 1] == 32]] = False
        quotes = np.flatnonzero(points == 39)
        quotes = quotes[start[quotes]]
        for ending in ("s", "t", "re", "ve", "m", "ll", "d"):
            at = quotes[quotes + len(ending) < n]
            for k, letter in enumerate(ending, 1):
                at = at[(points[at + k] == ord(letter)) & ~edge[at + k]]
            start[at + 1] = False
            cut = at + len(ending) + 1
            start[cut[cut < n]] = True
        return np.flatnonzero(start)

    def _pieces(self, text: str) -> list[str]:
        """`text` in pieces; each cut stands between a letter and white space, where pre-tokens always part."""
        if len(text) <= _PIECE:
            return [text]
        kinds = self.classes[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), _LIMIT)]
        cuts = np.flatnonzero((kinds[1:] == SPACE) & (kinds[:-1] == LETTER)) + 1
        out, at = [], 0
        while len(text) - at > _PIECE:
            k = np.searchsorted(cuts, at + _PIECE, "right") - 1
            cut = int(cuts[k]) if k >= 0 and cuts[k] > at else int(cuts[k + 1]) if k + 1 < len(cuts) else len(text)
            out.append(text[at:cut])
            at = cut
        return [*out, text[at:]] if at < len(text) else out

    def _group(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "".join(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        first = np.cumsum(sizes) - sizes
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(points)
        if not n:
            return np.zeros(0, self.dtype), np.zeros(len(pieces), np.int64)
        kinds = self.classes[np.minimum(points, _LIMIT)]
        if n + 1 > len(self.pow):
            self.pow, self.inv = _powers(2 * n)
        starts = self._starts(points, kinds, first[first < n])
        ends = np.append(starts[1:], n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(_MUL)) * self.pow[:n], out=total[1:])
        h = (total[ends] - total[starts]) * self.inv[starts]
        h ^= (ends - starts).astype(np.uint64) << np.uint64(40)
        h ^= h >> np.uint64(31)
        h *= np.uint64(_MUL)
        h ^= h >> np.uint64(29)
        h |= np.uint64(1)
        found = self._find(h)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new, at = np.unique(h[missing], return_index=True)
            at = missing[at]
            if self._full(len(new), int((ends[at] - starts[at]).sum())):  # forget all, then take in the whole group
                self._reset()
                missing = np.arange(len(h))
                new, at = np.unique(h, return_index=True)
            spans = list(zip(starts[at].tolist(), ends[at].tolist(), strict=True))
            self._add(new, [joined[a:b] for a, b in spans], np.concatenate([points[a:b] for a, b in spans]))
            found[missing] = self._find(h[missing])
        lengths, offset, store = self.length[found].astype(np.int64), self.offset[found], self.store
        other = self._others(found, points, starts, ends)
        if len(other):
            own = self._library([joined[a:b] for a, b in zip(starts[other].tolist(), ends[other].tolist(), strict=True)])
            lengths[other] = [len(i) for i in own]
            offset[other] = self.used + np.cumsum(lengths[other]) - lengths[other]
            store = np.concatenate([store[: self.used], np.array([x for i in own for x in i], self.dtype)])
        upto = np.append(0, np.cumsum(lengths))
        ids = store[np.repeat(offset - upto[:-1], lengths) + np.arange(upto[-1])]
        cut = np.searchsorted(starts, np.append(first, n))
        return ids, np.diff(upto[cut])

    def _others(self, found: np.ndarray, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Pre-tokens whose entry stands for other code points than theirs."""
        sizes = ends - starts
        same = self.size[found] == sizes
        place = np.repeat(np.where(same, self.at[found], 0) - starts, sizes) + np.arange(len(points))
        unlike = self.held[np.minimum(place, len(self.held) - 1)] != points
        return np.flatnonzero(~same | np.logical_or.reduceat(unlike, starts))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        counts = np.zeros(len(texts), np.int64)
        parts: list[tuple[np.ndarray, int]] = []
        group: list[str] = []
        owners: list[int] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if group:
                ids, each = self._group(group)
                np.add.at(counts, owners, each)
                parts.append(ids)
                group.clear()
                owners.clear()
                size = 0

        for k, text in enumerate(texts):
            if not text:
                continue
            sure = text.isascii() or not (self.classes[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), _LIMIT)] == UNSURE).any()
            if text.isascii() and any(c in text for c in "\x1c\x1d\x1e\x1f"):
                sure = False
            if not sure or any(s in text for s in self.special):
                flush()
                ids = self.library.encode(text, add_special_tokens=False).ids
                counts[k] = len(ids)
                parts.append(np.array(ids, self.dtype))
                continue
            for piece in self._pieces(text):
                if size + len(piece) > _PIECE:
                    flush()
                group.append(piece)
                owners.append(k)
                size += len(piece)
        flush()
        return (np.concatenate(parts) if parts else np.zeros(0, self.dtype)), counts


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def forget() -> None:
    """Lets the encoders of this Python worker go; the next task that encodes loads its own."""
    _ENCODERS.clear()
