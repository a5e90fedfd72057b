"""Benchmark decontamination: BM25 with block-max WAND, then overlap of question and answer.

Terms are runs of five words, which is what the overlap is counted by, so that a threshold
exists that loses nothing.  An inverted index holds for each term the items with it and
their BM25 weights.  Every passage of every text (64 words, each starting 32 after the last)
is a query: block-max WAND walks the postings of its terms in item order, skips whole blocks
that cannot reach the threshold, and retrieves all items at or above it.

An item retrieved for any passage counts if the text holds most of its terms, and at least
half of those of its question (the first two thirds) and of its answer (the rest).  One
changed word breaks five terms, more than a fifth of a short item's; so items of 15 to 28 words
also count where a run of the text equals the item but for one word, question and answer being
measured by words in place.

The threshold is an item's own: the least weight that the best passage of a text accepted by
these rules can have.  Such a text holds at least four fifths of the terms, scattered over any
number of passages, or all terms that one changed word leaves; every term stands whole in some
passage; so some passage holds the heaviest of them.  Weights are stored as shares of it.
They come from the frequencies and lengths of all items, however many indexes hold them.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, Words, chunks, small_batches, stored

SHINGLE = 5
PASSAGE, STEP = 64, 32  # words; every run of five stands whole in a passage
BLOCK = 16  # postings that share a largest weight
OVERLAP = 0.8
PART_OVERLAP = 0.5
ANSWER = 1 / 3  # share of an item that belongs to its answer
SHORT = range(15, 29)  # words of items that may have one word changed
K1, B = 1.2, 0.75
SLACK = 1e-9  # of sums of weights
INDEX_BYTES = 1 << 20  # item text in one index; more items make more indexes, searched in turn
KEPT = 8  # indexes that a worker holds at once

_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def plain(text: str | None) -> bytes:
    """Small letters, digits and other alphabets; all else is blank."""
    return (text or "").encode().translate(_TABLE)


def _shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of a text's runs of five words."""
    at = np.arange(max(0, len(words) - SHINGLE + 1))
    return Rolling(words).slices(at, at + SHINGLE)


def _cut(many: int) -> int:
    """How many of so many terms or words belong to the question."""
    return max(1, round(many * (1 - ANSWER)))


@dataclass
class Index:
    ids: np.ndarray  # item ids
    words: list[np.ndarray]  # word hashes of each item
    whole: np.ndarray  # each item's weights added up, as a multiple of its threshold
    terms: np.ndarray  # sorted hashes
    first: np.ndarray  # first posting of each term, and the end
    item: np.ndarray  # postings, by term, then item
    weight: np.ndarray  # as a share of the item's threshold
    flags: np.ndarray = field(init=False)  # 2**20, by the first bits of the terms
    shingles: list[np.ndarray] = field(init=False)  # terms of each item, in order
    most: np.ndarray = field(init=False)  # largest weight of each term

    def __post_init__(self):
        self.flags = np.zeros(1 << 20, bool)
        self.flags[(self.terms >> np.uint64(44)).astype(np.int64)] = True
        self.shingles = [_shingles(w) for w in self.words]
        self.most = np.maximum.reduceat(self.weight, self.first[:-1]) if len(self.terms) else np.empty(0)

    def dump(self) -> bytes:
        parts = (self.ids, self.words, self.whole, self.terms, self.first, self.item, self.weight)
        return zstandard.compress(pickle.dumps(parts))

    @staticmethod
    def load(data: bytes) -> Index:
        return Index(*pickle.loads(zstandard.decompress(data)))


@dataclass
class Totals:
    """Facts about all items, of which an index may hold a part."""

    items: int
    terms: int  # in all items together
    have: dict[int, int]  # items that hold a term, by its hash


def threshold(words: int, shingles: np.ndarray, weight: np.ndarray) -> float:
    """The least weight that the best passage of an accepted text can have.

    ``weight`` is that of each of the item's terms, in order, ``words`` the item's length.
    """
    many = len(shingles)
    names, at, times = np.unique(shingles, return_index=True, return_counts=True)
    light = np.argsort(weight[at], kind="stable")
    held = np.cumsum(times[light]) / many
    # Accepted with these terms and all lighter ones at the least: the heaviest of them.
    least = weight[at][light][np.flatnonzero(held >= OVERLAP)[0]]
    if words in SHORT:
        before, after = np.maximum.accumulate(weight), np.maximum.accumulate(weight[::-1])[::-1]
        for changed in range(words):
            left = before[changed - SHINGLE] if changed >= SHINGLE else 0.0
            right = after[changed + 1] if changed + 1 < many else 0.0
            least = min(least, max(left, right))
    return float(least)


def build(rows: list[tuple[int, str]], totals: Totals | None = None) -> Index:
    """An index of the rows, weighted by ``totals``, or by the rows' own if they are all there are."""
    rows = sorted({(i, t) for i, t in rows if i is not None and t})
    words = Words([plain(t) for _, t in rows])
    own = [words.hash[words.first[k] : words.first[k + 1]] for k in range(len(rows))]
    kept = [k for k, w in enumerate(own) if len(w) >= SHINGLE]
    ids, own = np.array([rows[k][0] for k in kept], np.int64), [own[k] for k in kept]
    each = [_shingles(w) for w in own]
    none = np.empty(0, np.uint64)
    if totals is None:
        names, times = np.unique(np.concatenate([np.unique(s) for s in each] or [none]), return_counts=True)
        totals = Totals(len(each), sum(map(len, each)), dict(zip(names.tolist(), times.tolist(), strict=True)))
    mean = totals.terms / max(totals.items, 1)
    posted, whole = [], np.zeros(len(each))
    for k, s in enumerate(each):
        names, back, tf = np.unique(s, return_inverse=True, return_counts=True)
        have = np.array([totals.have[n] for n in names.tolist()], float)
        idf = np.log(1 + (totals.items - have + 0.5) / (have + 0.5))
        weight = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(s) / mean))
        weight = weight / threshold(len(own[k]), s, weight[back])
        whole[k] = weight.sum()
        posted.append((names, np.full(len(names), k), weight))
    name, item, weight = (np.concatenate(x) for x in zip(*posted, strict=True)) if posted else (none, np.empty(0, np.int64), np.empty(0))
    order = np.lexsort((item, name))
    terms, first = np.unique(name[order], return_index=True)
    return Index(ids, own, whole, terms, np.append(first, len(name)), item[order], weight[order])


def retrieve(index: Index, terms: list[int]) -> dict[int, float]:
    """Items whose weights over distinct, ascending terms reach their threshold, by block-max WAND.

    Cursors stand in the postings of the terms.  The first item at which the largest weights of
    the cursors up to it reach 1 is the pivot: no item before it can.  If the blocks that the
    pivot would stand in cannot reach 1 either, the cursors go beyond the first of these blocks
    to end, or to the next cursor's item, whichever comes first.
    """
    found: dict[int, float] = {}
    items, weights, first, most = index.item, index.weight, index.first, index.most
    cursors = [(int(items[first[t]]), t, int(first[t])) for t in terms]

    def moved(cursor: tuple[int, int, int], to: int) -> list[tuple[int, int, int]]:
        _, t, at = cursor
        end = int(first[t + 1])
        at += int(np.searchsorted(items[at:end], to))
        return [(int(items[at]), t, at)] if at < end else []

    while cursors:
        cursors.sort()
        reach, pivot = 0.0, -1
        for k, (_, t, _) in enumerate(cursors):
            reach += most[t]
            if reach >= 1 - SLACK:
                pivot = k
                break
        if pivot < 0:
            break
        item = cursors[pivot][0]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
            pivot += 1
        front, rest = cursors[: pivot + 1], cursors[pivot + 1 :]
        reach, until = 0.0, rest[0][0] if rest else len(index.ids)
        for _, t, at in front:
            end = int(first[t + 1])
            at += int(np.searchsorted(items[at:end], item))
            if at == end:
                continue
            low = int(first[t]) + (at - int(first[t])) // BLOCK * BLOCK
            high = min(low + BLOCK, end)
            reach += weights[low:high].max()
            until = min(until, int(items[high - 1]) + 1)
        if reach < 1 - SLACK:
            cursors = [c for f in front for c in moved(f, max(until, item + 1))] + rest
        elif front[0][0] == item:
            score = sum(float(weights[at]) for _, _, at in front)
            if score >= 1 - SLACK:
                found[item] = score / float(index.whole[item])
            cursors = [c for f in front for c in moved(f, item + 1)] + rest
        else:
            cursors = [c for f in front for c in moved(f, item)] + rest
    return found


def candidates(index: Index, words: Words) -> dict[int, dict[int, float]]:
    """For each text number the items that a passage retrieves, with the best share of their whole weight."""
    found: dict[int, dict[int, float]] = {}
    at, hashes = words.windows(SHINGLE)
    flagged = np.flatnonzero(index.flags[(hashes >> np.uint64(44)).astype(np.int64)])
    if not len(flagged) or not len(index.terms):
        return found
    spot = np.minimum(np.searchsorted(index.terms, hashes[flagged]), len(index.terms) - 1)
    same = index.terms[spot] == hashes[flagged]
    place, term = at[flagged[same]], spot[same]
    if not len(place):
        return found
    # A run stands in the passage that begins in its half, and in the one before if it ends there.
    sizes = np.diff(words.first)
    passages = -(-sizes // STEP)
    before = np.cumsum(passages) - passages
    doc = words.doc[place]
    half, inside = np.divmod(place - words.first[doc], STEP)
    also = (half > 0) & (inside + STEP + SHINGLE <= PASSAGE)
    passage = np.concatenate([before[doc] + half, (before[doc] + half - 1)[also]])
    passage, term = np.divmod(np.unique(passage * len(index.terms) + np.concatenate([term, term[also]])), len(index.terms))
    names, first = np.unique(passage, return_index=True)
    text = np.searchsorted(before, names, "right") - 1
    for k, low, high in zip(text.tolist(), first.tolist(), [*first[1:].tolist(), len(term)], strict=True):
        for item, share in retrieve(index, term[low:high].tolist()).items():
            best = found.setdefault(k, {})
            best[item] = max(best.get(item, 0.0), min(1.0, share))
    return found


def verified(wanted: np.ndarray, there: np.ndarray) -> tuple[float, float, float]:
    """Shares of the item's terms, of its question's and of its answer's that stand in a text."""
    held = np.isin(wanted, there)
    cut = _cut(len(wanted))
    question = float(held[:cut].mean())
    return float(held.mean()), question, float(held[cut:].mean()) if len(wanted) > cut else question


def edited(item: np.ndarray, own: np.ndarray, wanted: np.ndarray, there: np.ndarray) -> tuple[float, float] | None:
    """Shares of question and answer in place, in a run of the text that is the item but for one word."""
    order = np.argsort(there, kind="stable")
    names, first, times = np.unique(there[order], return_index=True, return_counts=True)
    spot = np.minimum(np.searchsorted(names, wanted), len(names) - 1) if len(names) else np.empty(0, np.int64)
    starts = [
        order[first[s] : first[s] + times[s]] - k for k, s in enumerate(spot.tolist()) if names[s] == wanted[k]
    ]  # where the run would begin if this term is in place
    start = np.unique(np.concatenate(starts)) if starts else np.empty(0, np.int64)
    start = start[(start >= 0) & (start + len(item) <= len(own))]
    cut, best = _cut(len(item)), None
    for low in range(0, len(start), 4096):
        same = own[start[low : low + 4096, None] + np.arange(len(item))] == item
        for row in same[same.sum(axis=1) >= len(item) - 1]:
            made = (float(row[:cut].mean()), float(row[cut:].mean()))
            best = made if best is None else max(best, made)
    return best


def leaks(index: Index, texts: list[str | None]) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in texts]
    data = [plain(t) for t in texts]
    for low, high in chunks(data):
        words = Words(data[low:high])
        for k, items in sorted(candidates(index, words).items()):
            own = words.hash[words.first[k] : words.first[k + 1]]
            there = _shingles(own)
            for item, score in sorted(items.items()):
                wanted = index.shingles[item]
                whole, question, answer = verified(wanted, there)
                if not (whole >= OVERLAP and question >= PART_OVERLAP and answer >= PART_OVERLAP):
                    shares = edited(index.words[item], own, wanted, there) if len(index.words[item]) in SHORT else None
                    if shares is None or min(shares) < PART_OVERLAP:
                        continue
                    question, answer = shares
                made = {"item_id": int(index.ids[item]), "score": score, "question": question, "answer": answer}
                if made not in out[low + k]:
                    out[low + k].append(made)
    return out


LEAKS = "array<struct<item_id:long,score:double,question:double,answer:double>>"


def _searcher(parts: list):
    """One column over all indexes, of which a worker holds a few at a time."""

    def load(number: int) -> Index:
        made = Index.load(parts[number].value)
        vars(parts[number]).pop("_value", None)  # the bytes are read again from the worker's file when needed
        return made

    def look(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = lru_cache(maxsize=KEPT)(load)
        for texts in column:
            rows, found = texts.tolist(), [[] for _ in texts]
            for number in range(len(parts)):
                for mine, more in zip(found, leaks(index(number), rows), strict=True):
                    mine += [x for x in more if x not in mine]
            yield pd.Series([sorted(mine, key=lambda x: tuple(x.values())) for mine in found])

    return F.pandas_udf(look, LEAKS)


def _terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Distinct terms of each item, and in a row without a term how many it has."""
    for batch in batches:
        words = Words([plain(t) for t in batch["text"]])
        for k, part in enumerate(batch["part"]):
            mine = _shingles(words.hash[words.first[k] : words.first[k + 1]])
            if len(mine):
                names = np.unique(mine).view(np.int64)
                yield pd.DataFrame(
                    {"part": part, "term": pd.array([None, *names], "Int64"), "terms": np.concatenate([[len(mine)], np.zeros(len(names), int)])}
                )


def indexes(items: DataFrame) -> DataFrame:
    """``items`` (item_id, text) as stored indexes of bounded size (part, index), built in tasks."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text"))
    rows = rows.where("item_id is not null and text is not null").dropDuplicates()
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    rows = rows.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(total // INDEX_BYTES + 1)))
    terms = stored(rows.select("part", "text").mapInPandas(_terms, "part long, term long, terms long"), "item-terms")
    sums = terms.where("term is null").agg(F.count("*").alias("items"), F.coalesce(F.sum("terms"), F.lit(0)).alias("terms")).first()
    of_terms = terms.where("term is not null")
    have = of_terms.select("part", "term").distinct().join(of_terms.groupBy("term").agg(F.count("*").alias("have")), "term")

    def make(mine: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(counts):
            return pd.DataFrame({"part": [], "index": []})
        held = dict(zip(counts["term"].to_numpy(np.int64).view(np.uint64).tolist(), counts["have"].tolist(), strict=True))
        made = build(list(zip(mine["item_id"], mine["text"], strict=True)), Totals(sums.items, sums.terms, held))
        return pd.DataFrame({"part": [int(mine["part"].iloc[0])], "index": [made.dump()]})

    made = rows.groupBy("part").cogroup(have.groupBy("part")).applyInPandas(make, "part long, index binary")
    return stored(made, "item-indexes")


def find(docs: DataFrame, items: DataFrame, text: str = "text", out: str = "leaks") -> DataFrame:
    """``docs`` with ``out``: the items of ``items`` (item_id, text) that each whole text holds.

    Null and empty texts and items hold and give nothing; items without an id have no name to
    report and are left to ``clean``; items of fewer than five words are
    left out, since a run so short proves nothing; equal items of one id count once; repeated
    rows get equal answers; other columns stay; either table may be empty.  Items are split
    by hash into indexes of bounded size, which tasks build and store; the driver passes one
    after another on to the executors, and a worker holds ``KEPT`` of them at a time.  Scores do
    not depend on their number.  There is no shuffle of texts.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = [spark.sparkContext.broadcast(bytes(r["index"])) for r in indexes(items).orderBy("part").toLocalIterator()]
    found = _searcher(parts)(F.col(f"`{text}`")) if parts else F.array().cast(LEAKS)
    return docs.withColumn(out, found)


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold an item, one without an id too; other rows are left as they are.

    Null and empty texts hold nothing and stay, as do repeated rows and all columns; without items
    nothing goes; an empty table stays empty.
    """
    named = items.withColumn("item_id", F.coalesce("item_id", F.lit(0)))  # ids do not matter here
    return find(docs, named, out="__leaks").where(F.size("__leaks") == 0).drop("__leaks")
