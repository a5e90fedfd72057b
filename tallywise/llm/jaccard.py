"""Similarity join on sets of word shingles, with Bayesian pruning of candidates.

Texts that share a band of MinHash values are candidates.  Their remaining values are
compared a few at a time; a pair is dropped once the posterior probability that its
similarity reaches the threshold, from a uniform prior, falls below a tolerance.  Pairs that
stay are verified on their sets.

Pairs are never rows.  Texts with equal sets are one node; a bucket of nodes is split into
blocks, and a task compares two blocks in memory and hands on one row per node: how many
links it found and the least node it hangs together with.  A pair that shares several bands
counts in the first.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, Words, _spread, chunks, small_batches, stored
from .components import components

SHINGLE = 5  # words
THRESHOLD = 0.8
HASHES = 64
BAND = 3  # values in a band: a pair at the threshold shares none of the 21 bands once in three million
BANDS = HASHES // BAND
STEP = 8  # values compared before pairs are judged again
TOLERANCE = 1e-6
BLOCK = 512  # nodes

_FACTORS = _spread(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_SHIFTS = _spread(np.arange(1001, 1001 + HASHES, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For 8, 16, ... values compared, the fewest equal ones that a pair needs to stay.

    With k of n equal the posterior is Beta(k + 1, n - k + 1), and the probability of a
    similarity of at least t is that of at most k successes in n + 1 trials of chance t.
    """
    needed = []
    for n in range(STEP, HASHES + 1, STEP):
        total, k = 0.0, -1
        while total < tolerance:
            k += 1
            total += comb(n + 1, k) * threshold**k * (1 - threshold) ** (n + 1 - k)
        needed.append(k)
    return needed


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each, and where each text's begin (and the end)."""
    words = Words(texts)
    at, hashes = words.windows(SHINGLE)
    doc = words.doc[at]
    sizes = np.diff(words.first)
    short = np.flatnonzero((sizes > 0) & (sizes < SHINGLE))
    if len(short):
        hashes = np.append(hashes, Rolling(words.hash).slices(words.first[short], words.first[short + 1]))
        doc = np.append(doc, short)
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    hashes, doc = hashes[new], doc[new]
    return hashes, np.searchsorted(doc, np.arange(len(texts) + 1))


def sketches(texts: list[bytes]) -> Iterator[tuple]:
    """(hash of the set, another, size, MinHash values) of each text; size 0 without words."""
    for low, high in chunks(texts):
        hashes, first = shingle_sets(texts[low:high])
        full = np.flatnonzero(np.diff(first))
        starts = first[full]
        out = [(None, None, 0, None)] * (high - low)
        if len(full):
            one = np.add.reduceat(_spread(hashes ^ np.uint64(0x5851F42D4C957F2D)), starts).astype(np.int64)
            two = np.add.reduceat(_spread(hashes ^ np.uint64(0x14057B7EF767814F)), starts).astype(np.int64)
            values = np.empty((len(full), HASHES), np.uint32)
            for k in range(HASHES):
                values[:, k] = np.minimum.reduceat(((hashes * _FACTORS[k] + _SHIFTS[k]) >> np.uint64(32)).astype(np.uint32), starts)
            sizes = np.diff(first)[full]
            for i, place in enumerate(full.tolist()):
                out[place] = (int(one[i]), int(two[i]), int(sizes[i]), values[i].tobytes())
        yield from out


def grouped(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Groups of equal ``keys`` of a sorted partition, as arrays, across batch borders."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        if held and (held[-1][keys].iloc[-1].to_numpy() == batch[keys].iloc[0].to_numpy()).all():
            change = _changes(batch, keys)
            if len(change) == 0:
                held.append(batch)
                continue
            yield _arrays(pd.concat([*held, batch.iloc[: change[0]]]))
            batch = batch.iloc[change[0] :]
        elif held:
            yield _arrays(pd.concat(held))
        change = [0, *_changes(batch, keys).tolist()]
        columns = _arrays(batch)
        for a, b in zip(change, change[1:], strict=False):
            yield {k: v[a:b] for k, v in columns.items()}
        held = [batch.iloc[change[-1] :]]
    if held:
        yield _arrays(pd.concat(held))


def _changes(batch: pd.DataFrame, keys: list[str]) -> np.ndarray:
    differs = np.zeros(len(batch) - 1, bool)
    for k in keys:
        v = batch[k].to_numpy()
        differs |= v[1:] != v[:-1]
    return np.flatnonzero(differs) + 1


def _arrays(batch: pd.DataFrame) -> dict[str, np.ndarray]:
    return {c: batch[c].to_numpy() for c in batch.columns}


def hopeful_pairs(group: dict[str, np.ndarray], needed: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a task whose first shared band is the task's and that Bayesian pruning leaves."""
    n, band = len(group["node"]), int(group["band"][0])
    values = np.frombuffer(b"".join(group["sketch"]), np.uint32).reshape(n, HASHES)
    if group["i"][0] == group["j"][0]:
        left, right = np.triu_indices(n, 1)
    else:
        mine = group["block"] == group["i"][0]
        a, b = np.flatnonzero(mine), np.flatnonzero(~mine)
        left, right = np.repeat(a, len(b)), np.tile(b, len(a))
    size = group["size"]
    # Sets whose sizes differ too much cannot reach the threshold.
    fits = np.minimum(size[left], size[right]) >= THRESHOLD * np.maximum(size[left], size[right])
    left, right = left[fits], right[fits]
    equal = np.zeros(len(left), np.int64)
    for step, least in enumerate(needed):
        part = slice(step * STEP, (step + 1) * STEP)
        equal += (values[left, part] == values[right, part]).sum(axis=1)
        stays = equal >= least
        left, right, equal = left[stays], right[stays], equal[stays]
    if band and len(left):
        new = np.ones(len(left), bool)
        for b in range(band):
            part = slice(BAND * b, BAND * (b + 1))
            new &= (values[left, part] != values[right, part]).any(axis=1)
        left, right = left[new], right[new]
    return left, right


def links(group: dict[str, np.ndarray], needed: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a task that reach the threshold exactly."""
    left, right = hopeful_pairs(group, needed)
    if not len(left):
        return left, right
    sets = [np.frombuffer(s, np.uint64) for s in group["shingles"]]
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    names, ids = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.cumsum(sizes) - sizes
    order = np.argsort(left, kind="stable")
    left, right = left[order], right[order]
    kept = np.zeros(len(left), bool)
    marked = np.zeros(len(names), bool)
    bounds = [0, *(np.flatnonzero(np.diff(left)) + 1).tolist(), len(left)]
    for a, b in zip(bounds, bounds[1:], strict=False):
        one = left[a]
        mine = ids[first[one] : first[one] + sizes[one]]
        marked[mine] = True
        for c in range(a, b, 64):  # a bounded number of sets at a time
            other = right[c : min(c + 64, b)]
            n = sizes[other]
            at = np.cumsum(n) - n
            common = np.add.reduceat(marked[ids[np.repeat(first[other] - at, n) + np.arange(n.sum())]].astype(np.int64), at)
            kept[c : c + len(other)] = common >= THRESHOLD * (n + sizes[one] - common) - 1e-9
        marked[mine] = False
    return left[kept], right[kept]


TASK = ["band", "key", "i", "j"]


def _hopeful(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    needed, out = least_matches(), []
    for group in grouped(batches, TASK):
        if len(group["node"]) > 1:
            used = np.unique(np.concatenate(hopeful_pairs(group, needed)))
            if len(used):
                out.append(pd.DataFrame({k: v[used] for k, v in group.items()}))
                if sum(map(len, out)) >= 1000:
                    yield pd.concat(out)
                    out = []
    if out:
        yield pd.concat(out)


def _linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    needed = least_matches()
    for group in grouped(batches, TASK):
        left, right = links(group, needed)
        if not len(left):
            continue
        node, copies = group["node"], group["copies"]
        count = np.bincount(left, copies[right], len(node)) + np.bincount(right, copies[left], len(node))
        root = np.argsort(np.argsort(node))  # least node first
        while True:  # least label of the neighbours, until it rests
            low = root.copy()
            np.minimum.at(low, left, root[right])
            np.minimum.at(low, right, root[left])
            if (low == root).all():
                break
            root = low
        used = np.flatnonzero(count)
        yield pd.DataFrame({"node": node[used], "links": count[used].astype(np.int64), "root": np.sort(node)[root[used]]})


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, text_hash, class_id, n_links, is_first.

    ``class_id`` is the least doc_id of the texts that hang together by links, ``n_links``
    the number of other rows whose shingle sets have a Jaccard similarity of 0.8 or more
    (small letters, words between ASCII white space, five to a shingle; a shorter text is one
    shingle).  ``is_first`` marks the rows of the class's least (doc_id, text): repeated rows
    share it.  Null texts and texts without words are classes of their own with no links,
    whose class_id is their doc_id.  Null ids count as larger than all; extra columns are
    ignored; an empty table gives an empty one.  Sets are known by two 64-bit hashes.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text_hash = F.xxhash64("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))

    def sketch(column: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in column:
            found = sketches([(t or "").lower().encode() for t in texts])
            made = pd.DataFrame(list(found), columns=["node", "check", "size", "sketch"])
            yield made.astype({"node": "Int64", "check": "Int64"})

    made = F.pandas_udf(sketch, "node long, check long, size int, sketch binary")("text")
    known = stored(rows.select("doc_id", text_hash.alias("text_hash"), made.alias("s")).select("doc_id", "text_hash", "s.*"), "sketches")
    full = known.where("size > 0")
    nodes = full.groupBy("node", "check", "size").agg(
        F.count("*").alias("copies"), F.min("text_hash").alias("text_hash"), F.first("sketch").alias("sketch")
    )
    nodes = stored(nodes, "nodes")

    bands = F.array(*(F.xxhash64(F.lit(b), F.substring("sketch", 4 * BAND * b + 1, 4 * BAND)) for b in range(BANDS)))
    bands = nodes.select("node", F.posexplode(bands).alias("band", "key"))
    shared = bands.groupBy("band", "key").agg(F.count("*").alias("held")).where("held > 1")
    blocks = F.ceil(F.col("held") / BLOCK)
    members = (
        bands.join(shared, ["band", "key"])
        .select("band", "key", "node", F.pmod(F.xxhash64("node"), blocks).alias("block"), blocks.alias("blocks"))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("band", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node")
    )
    tasks = members.join(nodes.select("node", "size", "copies", "sketch"), "node")
    schema = "node long, band int, key long, i long, j long, block long, size int, copies long, sketch binary"
    tasks = tasks.select(*(c.split(" ")[0] for c in schema.split(", "))).repartition(*TASK).sortWithinPartitions(*TASK)
    hopeful = stored(tasks.mapInPandas(_hopeful, schema), "hopeful")

    # The sets of the nodes still in question, from one text of each.
    wanted = hopeful.select("node").distinct().join(nodes.select("node", "text_hash"), "node")
    texts = rows.groupBy(text_hash.alias("text_hash")).agg(F.first("text").alias("text"))

    def sets(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in column:
            hashes, first = shingle_sets([t.lower().encode() for t in texts])
            yield pd.Series([hashes[a:b].tobytes() for a, b in zip(first, first[1:], strict=False)])

    shingles = texts.join(wanted, "text_hash").select("node", F.pandas_udf(sets, "binary")("text").alias("shingles"))
    ready = hopeful.join(shingles, "node").repartition(*TASK).sortWithinPartitions(*TASK)
    linked = stored(ready.mapInPandas(_linked, "node long, links long, root long"), "links")

    counts = linked.groupBy("node").agg(F.sum("links").alias("links"))
    hang = components(linked.select(F.col("node").alias("u"), F.col("root").alias("v")))
    facts = nodes.select("node", "copies").join(counts, "node", "left").join(hang, "node", "left")
    facts = facts.select(
        "node",
        F.coalesce("component", "node").alias("component"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    placed = stored(known.select("doc_id", "text_hash", "node").join(facts, "node", "left"), "placed")
    firsts = (
        placed.where("component is not null")
        .groupBy("component")
        .agg(F.min("doc_id").alias("class_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("least"))
        .select("component", "class_id", F.col("least.doc_id").alias("first_id"), F.col("least.text_hash").alias("first_hash"))
    )
    alone = F.col("component").isNull()
    return placed.join(firsts, "component", "left").select(
        "doc_id",
        "text_hash",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        (alone | F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_hash") == F.col("first_hash"))).alias("is_first"),
    )


def first_of_groups(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class left: the least doc_id, of repeated rows any one.

    Columns stay.  Rows without words have no class and all stay.
    """
    keep = near_duplicates(docs).where("is_first").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    marked = docs.withColumn("__hash", F.xxhash64("text"))
    kept = marked.join(keep, marked["doc_id"].eqNullSafe(keep["__id"]) & (marked["__hash"] == keep["__hash"]), "left_semi")
    words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    once = kept.where(words).dropDuplicates(["doc_id", "__hash"])
    return once.unionByName(kept.where(~words)).drop("__hash")
