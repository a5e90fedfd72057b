"""Splitting of texts for byte-level BPE, and a table of encoded pieces.

The split follows the published pattern of the vocabulary (contractions; runs of
letters, digits or other marks with one blank before them; white space), computed on
arrays of code points for many texts at once.  Pieces repeat, so each distinct piece is
encoded once while it stays in a table of fixed size.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np
import regex

from .common import Rolling, _spread

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
_CLASSES: list[np.ndarray] = []
_POINTS = _spread(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _classes() -> np.ndarray:
    if not _CLASSES:
        kind = np.zeros(0x110000, np.uint8)
        for low in range(0, 0x110000, 0x10000):
            if low == 0:
                points = [*range(0xD800), *range(0xE000, 0x10000)]
            else:
                points = range(low, low + 0x10000)
            points = np.array(points)
            chars = points.astype("<u4").tobytes().decode("utf-32-le")
            for name, value in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", SPACE)):
                for m in regex.finditer(name, chars):
                    kind[points[m.start() : m.end()]] = value
        _CLASSES.append(kind)
    return _CLASSES[0]


def starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pieces begin; ``first`` holds where texts begin."""
    n = len(points)
    kind = _classes()[points]
    opens = np.zeros(n + 1, bool)
    opens[first] = True
    begin = opens.copy()
    begin[n] = True
    begin[1:n] |= kind[1:] != kind[:-1]
    # The last blank before a word leaves its run; a plain blank joins the word.
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~opens[1:n])
    begin[last] = True
    begin[last[points[last] == 0x20] + 1] = False
    # Contractions: an apostrophe that begins a piece, with s t m d or re ve ll.
    quote = np.flatnonzero((points == 0x27) & begin[:n])
    if len(quote):
        padded = np.concatenate((points, [0, 0]))
        a, b = padded[quote + 1], padded[quote + 2]
        same = lambda k: ~opens[np.minimum(quote + k, n)] & (quote + k < n)
        one = np.isin(a, [ord(c) for c in "stmd"]) & same(1)
        two = np.zeros(len(quote), bool)
        for pair in ("re", "ve", "ll"):
            two |= (a == ord(pair[0])) & (b == ord(pair[1]))
        two &= same(1) & same(2)
        for chosen, size in ((one, 2), (two, 3)):
            at = quote[chosen]
            begin[at + 1] = False
            begin[at + size] = True
    return np.flatnonzero(begin[:n])


class PieceTable:
    """Encodes texts piece by piece; distinct pieces go through ``encode`` once.

    Pieces are looked up by 64-bit hashes, then compared by their code points; a piece that
    differs from the one kept under its hash is encoded by itself.  The table has a fixed
    number of places and starts again when its ids or code points exceed a fixed count, so
    its memory is bounded; both only decide what is encoded again.
    """

    PLACES = 19
    MOST_IDS = 4_000_000
    MOST_POINTS = 6_000_000
    POINTS_AT_ONCE = 1 << 18

    def __init__(self, encode: Callable[[list[str]], list]):
        self.encode_pieces = encode
        self.reset()

    def reset(self) -> None:
        size = 1 << self.PLACES
        self.keys = np.zeros(size, np.uint64)
        self.where = np.zeros(size, np.int32)
        self.sizes = np.zeros(size, np.int32)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        # The code points of the piece in each place.
        self.text_at = np.zeros(size, np.int32)
        self.lengths = np.zeros(size, np.int32)
        self.points, self.points_used = np.zeros(1 << 16, np.uint32), 0

    def encode(self, texts: list[str]):
        """For each text in turn, its ids as an array."""
        low, held = 0, 0
        for i, text in enumerate(texts):
            if i > low and held + len(text) > self.POINTS_AT_ONCE:
                yield from self._encode(texts[low:i])
                low, held = i, 0
            held += len(text)
        yield from self._encode(texts[low:])

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        joined = "".join(texts)
        if not joined:
            return [np.empty(0, np.uint32) for _ in texts]
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        edges = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        begin = starts(points, edges[:-1][edges[:-1] < len(points)])
        end = np.append(begin[1:], len(points))
        length = end - begin
        keys = Rolling(_POINTS[points]).slices(begin, end)
        place = (keys >> np.uint64(64 - self.PLACES)).astype(np.int64)
        where, sizes, text_at = (x[place].astype(np.int64) for x in (self.where, self.sizes, self.text_at))
        same = self.lengths[place] == length
        missing = np.flatnonzero((self.keys[place] != keys) | (sizes == 0))
        if len(missing):
            new, at, back = np.unique(keys[missing], return_index=True, return_inverse=True)
            at = missing[at]
            offsets, counts = self._add(joined, begin[at], end[at])
            text_offsets = self._keep(points, begin[at], length[at])
            where[missing], sizes[missing] = offsets[back], counts[back]
            text_at[missing], same[missing] = text_offsets[back], length[at][back] == length[missing]
            slot = (new >> np.uint64(64 - self.PLACES)).astype(np.int64)
            self.keys[slot], self.where[slot], self.sizes[slot] = new, offsets, counts
            self.text_at[slot], self.lengths[slot] = text_offsets, length[at]
        # Pieces lie side by side, so one gather sets every piece against the one found for it.
        kept = np.repeat(np.where(same, text_at, 0) - begin, length) + np.arange(len(points))
        same &= ~np.logical_or.reduceat(self.points[np.minimum(kept, len(self.points) - 1)] != points, begin)
        wrong = np.flatnonzero(~same)
        if len(wrong):
            where[wrong], sizes[wrong] = self._add(joined, begin[wrong], end[wrong])
        past = np.concatenate(([0], np.cumsum(sizes)))
        ids = self.flat[np.repeat(where - past[:-1], sizes) + np.arange(past[-1])]
        bounds = past[np.searchsorted(begin, edges)]
        if self.used > self.MOST_IDS or self.points_used > self.MOST_POINTS:
            self.reset()
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def _add(self, joined: str, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encode pieces and append their ids: where they lie and how many they are."""
        found = self.encode_pieces([joined[s:e] for s, e in zip(begin.tolist(), end.tolist(), strict=True)])
        counts = np.fromiter(map(len, found), np.int64, len(found))
        total = int(counts.sum())
        self.flat = _room(self.flat, self.used + total)
        offsets = self.used + np.cumsum(counts) - counts
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(found), np.uint32, total)
        self.used += total
        return offsets, counts

    def _keep(self, points: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Append the code points of pieces: where they lie."""
        past = np.cumsum(length)
        total = int(past[-1])
        self.points = _room(self.points, self.points_used + total)
        self.points[self.points_used : self.points_used + total] = points[np.repeat(begin - past + length, length) + np.arange(total)]
        offsets = self.points_used + past - length
        self.points_used += total
        return offsets


def _room(values: np.ndarray, n: int) -> np.ndarray:
    """The array, doubled until it holds ``n`` values."""
    while n > len(values):
        values = np.concatenate((values, np.zeros_like(values)))
    return values
