"""Helpers shared by the text operators: batch sizes, stored tables, vectorised words."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path

# Rows and bytes that reach a Python worker at once.  A text longer than the
# bytes still travels whole, alone in its batch.
BATCH_ROWS = 256
BATCH_BYTES = 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that a worker's memory follows the longest text, not the row count."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it again: lineage ends there."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _spread(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit mixing function (splitmix64)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """64-bit hashes of any slices of a sequence, by prefix sums modulo 2**64."""

    BASE = 0x9E3779B97F4A7C15
    _up = np.ones(1, np.uint64)
    _down = np.ones(1, np.uint64)

    def __init__(self, values: np.ndarray):
        up, _ = self._powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    @classmethod
    def _powers(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls._up) < n:
            size = max(n, 2 * len(cls._up))
            inverse = pow(cls.BASE, -1, 1 << 64)
            for name, base in (("_up", cls.BASE), ("_down", inverse)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps, dtype=np.uint64))
        return cls._up, cls._down

    def slices(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        _, down = self._powers(len(self.sums))
        return _spread((self.sums[ends] - self.sums[starts]) * down[starts])


_BYTE_VALUES = _spread(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
LONG_WORD = 64  # bytes
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


class Words:
    """The words (runs without ASCII white space) of many texts at once.

    ``doc`` is each word's text number, ``start``/``end`` its bytes in ``buffer``
    and ``hash`` a 64-bit hash of those bytes.
    """

    def __init__(self, texts: list[bytes]):
        self.texts = len(texts)
        self.buffer = b" ".join([*texts, b""])
        data = np.frombuffer(self.buffer, np.uint8)
        inside = ~_SPACE[data]
        edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.offsets = np.concatenate(([0], np.cumsum(sizes)))
        self.first = np.searchsorted(self.start, self.offsets)  # first word of each text, and the end
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.hash = Rolling(_BYTE_VALUES[data]).slices(self.start, self.end)
        # Sums modulo 2**64 cannot tell some long words apart (Thue-Morse); those get a digest.
        for i in np.flatnonzero(self.end - self.start > LONG_WORD).tolist():
            digest = blake2b(self.buffer[self.start[i] : self.end[i]], digest_size=8).digest()
            self.hash[i] = int.from_bytes(digest, "little")

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of all runs of ``size`` words inside one text."""
        n = len(self.hash)
        if n < size:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        at = np.arange(n - size + 1)
        at = at[self.doc[at] == self.doc[at + size - 1]]
        return at, Rolling(self.hash).slices(at, at + size)


def chunks(texts: list[bytes], limit: int = 1 << 18):
    """Consecutive ranges of ``texts`` of about ``limit`` bytes, one text at least."""
    low, held = 0, 0
    for i, text in enumerate(texts):
        if i > low and held + len(text) > limit:
            yield low, i
            low, held = i, 0
        held += len(text)
    if low < len(texts):
        yield low, len(texts)
