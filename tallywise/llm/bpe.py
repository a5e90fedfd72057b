"""Byte-level BPE encoding and decoding by tree reduction.

A piece is encoded by halves.  The encodings of two neighbours are joined by encoding
the window around their border again, one token on either side first, then two, four and
so on, until the tokens left outside provably stay as they are.  The proof needs
neighbouring pairs only: a sequence of tokens is *the* encoding of its bytes exactly if
every two neighbours, encoded together, give those two tokens again.  Pairs inside an
encoding satisfy this, so only the pairs at the window's ends are looked at.

Encodings form a monoid under that join, with the empty sequence as its unit; pieces of a
text, which never merge across their border, are simply concatenated, and so are decoded
bytes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .pretokens import PieceTable, starts

Ids = tuple[int, ...]


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary: one line per token, its bytes in base64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class TreeCodec:
    """Encoding and decoding with one vocabulary."""

    LEAF = 6  # bytes encoded without further halving
    REMEMBERED = 100_000  # windows kept in memory before starting again
    JOINED = 1 << 14  # tokens decoded without further halving

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.sizes = np.fromiter(map(len, self.tokens), np.int64, len(self.tokens))
        self._offsets = np.cumsum(self.sizes) - self.sizes
        self._bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self._windows: dict[bytes, Ids] = {}
        self._pairs: dict[tuple[int, int], bool] = {}

    def merged(self, data: bytes) -> Ids:
        """Plain merging: the lowest rank first, the leftmost of equals."""
        if len(data) > 64:
            return self._merged_long(data)
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks, none = self.ranks, 1 << 60
        costs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while costs:
            least = min(costs)
            if least == none:
                break
            i = costs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i:
                costs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
            if i < len(costs):
                costs[i] = ranks.get(parts[i] + parts[i + 1], none)
        return tuple(ranks[p] for p in parts)

    def _merged_long(self, data: bytes) -> Ids:
        """The same with a heap over linked parts."""
        n, ranks = len(data), self.ranks
        parts: list[bytes | None] = [data[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(ranks[data[i : i + 2]], i, 2) for i in range(n - 1) if data[i : i + 2] in ranks]
        heapify(heap)
        while heap:
            _, i, size = heappop(heap)
            left = parts[i]
            if left is None or after[i] >= n:
                continue
            j = after[i]
            if len(left) + len(parts[j]) != size:
                continue  # one of the two has changed since
            parts[i], parts[j] = left + parts[j], None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < n:
                    both = parts[a] + parts[after[a]]
                    if both in ranks:
                        heappush(heap, (ranks[both], a, len(both)))
        return tuple(ranks[p] for p in parts if p is not None)

    def _window(self, data: bytes) -> Ids:
        found = self._windows.get(data)
        if found is None:
            found = self.merged(data)
            if len(data) <= 64:
                if len(self._windows) >= self.REMEMBERED:
                    self._windows.clear()
                self._windows[data] = found
        return found

    def stable(self, a: int, b: int) -> bool:
        """Do two tokens stay as they are side by side?"""
        found = self._pairs.get((a, b))
        if found is None:
            found = self.merged(self.tokens[a] + self.tokens[b]) == (a, b)
            if len(self._pairs) >= self.REMEMBERED:
                self._pairs.clear()
            self._pairs[a, b] = found
        return found

    def join(self, left: Ids, right: Ids) -> Ids:
        """The encoding of two neighbours' bytes from their encodings."""
        if not left or not right:
            return left or right
        if self.stable(left[-1], right[0]):
            return left + right
        reach = 1
        while True:
            head, tail = left[:-reach], right[reach:]
            inner = self._window(b"".join(map(self.tokens.__getitem__, left[-reach:] + right[:reach])))
            if (not head or self.stable(head[-1], inner[0])) and (not tail or self.stable(inner[-1], tail[0])):
                return head + inner + tail
            reach *= 2

    def encode_piece(self, data: bytes) -> Ids:
        if len(data) <= self.LEAF:
            return self._window(data)
        token = self.ranks.get(data)
        if token is not None:
            return (token,)
        half = len(data) // 2
        return self.join(self.encode_piece(data[:half]), self.encode_piece(data[half:]))

    def encode_pieces(self, pieces: list[str]) -> list[Ids]:
        return [self.encode_piece(p.encode()) for p in pieces]

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= self.JOINED:
            sizes = self.sizes[ids]
            past = np.cumsum(sizes)
            total = int(past[-1]) if len(past) else 0
            return self._bytes[np.repeat(self._offsets[ids] - past + sizes, sizes) + np.arange(total)].tobytes()
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


_CODECS: dict[str, TreeCodec] = {}
_TABLES: dict[str, PieceTable] = {}


def _codec(path: str) -> TreeCodec:
    """One codec per worker process and vocabulary."""
    if path not in _CODECS:
        _CODECS[path] = TreeCodec(read_ranks(path))
    return _CODECS[path]


def encode(docs: DataFrame, ranks_path: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """``docs`` with the token ids of ``text`` as little-endian unsigned 32-bit integers.

    Null texts count as empty and give an empty value; rows, repeated or not, are
    independent and keep all their columns; an existing column ``out`` is replaced; an
    empty table gives an empty table.  Texts are never cut: a worker's memory follows
    the longest one.  There is no shuffle.
    """
    small_batches(docs.sparkSession)

    def ids(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(ranks_path)
        pieces = _TABLES.setdefault(ranks_path, PieceTable(codec.encode_pieces))
        for batch in column:
            texts = batch.to_pylist()
            made = []
            for piece_ids, one in zip(pieces.encode(texts), texts, strict=True):
                size = len(one.encode())
                # The pieces were found by hash: a text whose ids have another length is encoded plainly.
                if int(codec.sizes[piece_ids].sum()) != size:
                    piece_ids = np.array(_plain(codec, one), np.uint32)
                made.append(piece_ids.astype("<u4").tobytes())
            yield pa.array(made, pa.binary())

    column = F.arrow_udf(ids, "binary")(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    return docs.withColumn(out, column)


def _plain(codec: TreeCodec, text: str) -> list[int]:
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    at = [*starts(points, np.array([0])).tolist(), len(text)]
    return [i for a, b in zip(at, at[1:], strict=False) for i in codec.encode_piece(text[a:b].encode())]


def decode(docs: DataFrame, ranks_path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the bytes of ``ids`` (as ``encode`` writes them); null ids give empty bytes."""
    small_batches(docs.sparkSession)

    def bytes_of(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(ranks_path)
        for batch in column:
            yield pa.array([codec.decode(np.frombuffer(b, "<u4")) for b in batch.to_pylist()], pa.binary())

    return docs.withColumn(out, F.arrow_udf(bytes_of, "binary")(F.coalesce(F.col(f"`{ids}`"), F.lit(b""))))


def token_array(ids):
    """The ids of ``encode`` as an array of integers, for readers that want one."""

    def arrays(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in column:
            yield pa.array(
                [None if b is None else np.frombuffer(b, "<u4").astype(np.int32) for b in batch.to_pylist()],
                pa.list_(pa.int32()),
            )

    return F.arrow_udf(arrays, "array<int>")(ids)
