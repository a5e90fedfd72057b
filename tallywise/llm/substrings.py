"""Removal of repeated word windows by super-k-mers.

Each window of 35 words has a minimiser, the least hash of its runs of eight words.
Consecutive windows with the same minimiser form a super-k-mer; equal windows have equal
minimisers, so a minimiser that stands in one place of the corpus has no repeated window and
its words stay where they are.  The others travel, packed as one string, to their minimiser's
bucket, where the windows are sorted and equal ones counted, word for word.

Texts that repeat as a whole travel once, with their number.  A bucket above a fixed size is
not gathered: its windows travel one by one, grouped by their own words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, chunks, small_batches
from .jaccard import grouped

WINDOW = 35  # words
RUN = 8  # words a minimiser is taken from
HOT = 4096  # super-k-mers of a bucket that one task gathers


def super_kmers(words: Words, window: int = WINDOW, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of windows and minimiser of each super-k-mer, and how often that stands in it."""
    n = len(words.hash)
    none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    if n < window:
        return none
    at, hashes = words.windows(run)
    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    least[at] = hashes
    runs = least.copy()
    # Minimum over window - run + 1 neighbours, by doubling.
    reach, wanted = 1, window - run + 1
    while 2 * reach <= wanted:
        least[: n - reach] = np.minimum(least[: n - reach], least[reach:])
        reach *= 2
    if reach < wanted:
        least[: n - wanted + reach] = np.minimum(least[: n - wanted + reach], least[wanted - reach :])
    starts = np.arange(n - window + 1)
    starts = starts[words.doc[starts] == words.doc[starts + window - 1]]
    if not len(starts):
        return none
    value = least[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (value[1:] != value[:-1]) | (words.doc[starts[1:]] != words.doc[starts[:-1]])
    first = np.flatnonzero(new)
    start, count, value = starts[first], np.diff(np.append(first, len(starts))), value[first]
    held = count + window - run  # runs in it
    begin = np.cumsum(held) - held
    same = runs[np.repeat(start - begin, held) + np.arange(held.sum())] == np.repeat(value, held)
    return start, count, value, np.add.reduceat(same.astype(np.int32), begin)


def repeated(packed: list[bytes], weights: list[int], window: int = WINDOW) -> list[list[int]]:
    """For each string of a bucket, the windows (by their first word) that stand in the bucket more than once."""
    distinct: dict[bytes, int] = {}
    for p, w in zip(packed, weights, strict=True):
        distinct[p] = distinct.get(p, 0) + w
    if len(distinct) == 1:
        (p, weight), = distinct.items()
        words = p.count(b" ") + 1
        if weight > 1:
            return [list(range(words - window + 1))] * len(packed)
    entries = []
    for number, p in enumerate(distinct):
        edge = np.concatenate(([0], np.flatnonzero(np.frombuffer(p, np.uint8) == 0x20) + 1, [len(p) + 1])).tolist()
        entries += [(p[edge[j] : edge[j + window] - 1], number, j) for j in range(len(edge) - window)]
    entries.sort()
    weight = list(distinct.values())
    found: list[list[int]] = [[] for _ in distinct]
    low = 0
    for high in range(1, len(entries) + 1):
        if high == len(entries) or entries[high][0] != entries[low][0]:
            if sum(weight[e[1]] for e in entries[low:high]) > 1:
                for _, number, j in entries[low:high]:
                    found[number].append(j)
            low = high
    place = {p: i for i, p in enumerate(distinct)}
    return [found[place[p]] for p in packed]


def kept_words(text: bytes, starts, window: int = WINDOW) -> tuple[int, int, bytes]:
    """Number of words, number removed and what stays, joined by single blanks."""
    words = text.split()
    if starts is None or not len(starts):
        return len(words), 0, b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    starts = np.unique(np.asarray(starts, np.int64))
    change[starts] += 1
    change[starts + window] -= 1
    gone = np.cumsum(change[:-1]) > 0
    return len(words), int(gone.sum()), b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)


def _keys(text):
    """Two hashes that name a text: 64 and 32 bits."""
    return F.xxhash64(text).alias("k1"), F.hash(F.lit(1), text).alias("k2")


def dedupe(docs: DataFrame, window: int = WINDOW, run: int = RUN, hot: int = HOT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept (bytes).

    Words are runs of anything but ASCII white space; a word goes if a window over it stands
    anywhere else too, same text included.  Null texts count as empty; texts shorter than a
    window keep all words; repeated rows, equal texts of other ids too, lose every window;
    extra columns are ignored; an empty table gives an empty one.  Whole texts are known by
    96 bits of hashes.
    """
    return by_document(docs, dedupe_texts(docs, window, run, hot))


def by_document(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """Columns of ``dedupe_texts``, or what was made of them, for each row of ``docs``."""
    rows = docs.select("doc_id", *_keys(F.coalesce("text", F.lit(""))))
    return rows.join(texts, ["k1", "k2"]).drop("k1", "k2")


def dedupe_texts(docs: DataFrame, window: int = WINDOW, run: int = RUN, hot: int = HOT) -> DataFrame:
    """As ``dedupe``, one row per distinct text, named by its hashes k1 and k2."""
    small_batches(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(*_keys(text), text.alias("text"))
    # The one shuffle of texts: all uses of ``texts`` share it, so all take all of its columns.
    texts = rows.groupBy("k1", "k2").agg(F.first("text").alias("text"), F.count("*").alias("copies"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            data = [t.encode() for t in batch["text"]]
            k1, k2, copies = (batch[c].to_numpy() for c in ("k1", "k2", "copies"))
            for low, high in chunks(data):
                words = Words(data[low:high])
                first, count, least, times = super_kmers(words, window, run)
                doc = words.doc[first] if len(first) else first
                yield pd.DataFrame(
                    {
                        "k1": k1[low + doc], "k2": k2[low + doc], "weight": copies[low + doc] * times,
                        "place": first - words.first[doc] << 32 | count, "least": least.view(np.int64),
                    }
                )

    pieces = texts.mapInPandas(cut, "k1 long, k2 int, weight long, place long, least long")
    shared = pieces.groupBy("least").agg(F.sum("weight").alias("weight"), F.count("*").alias("held")).where("weight > 1")
    wanted = (
        pieces.drop("weight")
        .join(shared.drop("weight"), "least")
        .groupBy("k1", "k2")
        .agg(F.collect_list(F.struct("place", "least", (F.col("held") > hot).alias("hot"))).alias("pieces"))
    )

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["least", "k1", "k2", "start", "copies", "packed"]
        for batch in batches:
            out, held = [], 0
            for k1, k2, text, copies, found in batch[["k1", "k2", "text", "copies", "pieces"]].itertuples(index=False):
                words = text.encode().split()
                line = b" ".join(words)
                edge = np.concatenate(([0], np.cumsum([len(w) + 1 for w in words]))).tolist()
                for p in found:
                    low, many = divmod(p["place"], 1 << 32)
                    high = low + many
                    spans = [(i, i + 1) for i in range(low, high)] if p["hot"] else [(low, high)]
                    for a, b in spans:
                        packed = line[edge[a] : edge[b + window - 1] - 1]
                        out.append((p["least"], k1, k2, a, copies, packed))
                        held += len(packed)
                if held > 1 << 22:
                    yield pd.DataFrame(out, columns=columns)
                    out, held = [], 0
            yield pd.DataFrame(out, columns=columns)

    def packed(one_by_one: bool) -> DataFrame:
        chosen = F.filter("pieces", lambda p: p.hot == one_by_one)
        mine = wanted.select("k1", "k2", chosen.alias("pieces")).where(F.size("pieces") > 0)
        return texts.join(mine, ["k1", "k2"]).mapInPandas(
            pack, "least long, k1 long, k2 int, start int, copies long, packed binary"
        )

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for group in grouped(batches, ["least"]):
            for k1, k2, start, found in zip(
                group["k1"], group["k2"], group["start"], repeated(list(group["packed"]), group["copies"].tolist(), window), strict=True
            ):
                if found:
                    out.append((k1, k2, [int(start) + j for j in found]))
            if len(out) > 2000:
                yield pd.DataFrame(out, columns=["k1", "k2", "starts"])
                out = []
        yield pd.DataFrame(out, columns=["k1", "k2", "starts"])

    buckets = packed(one_by_one=False).repartition("least").sortWithinPartitions("least")
    found = buckets.mapInPandas(count, "k1 long, k2 int, starts array<int>")
    single = packed(one_by_one=True)
    again = single.groupBy("packed").agg(F.sum("copies").alias("weight")).where("weight > 1").select("packed")
    found = found.unionByName(single.join(again, "packed").select("k1", "k2", F.array("start").alias("starts")))
    starts = found.groupBy("k1", "k2").agg(F.flatten(F.collect_list("starts")).alias("starts"))

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [kept_words(t.encode(), s, window) for t, s in zip(batch["text"], batch["starts"], strict=True)]
            yield pd.DataFrame(
                {"k1": batch["k1"], "k2": batch["k2"], "n_words": [m[0] for m in made], "n_removed": [m[1] for m in made], "kept": [m[2] for m in made]}
            )

    done = texts.join(starts, ["k1", "k2"], "left")
    return done.mapInPandas(keep, "k1 long, k2 int, n_words long, n_removed long, kept binary")
