"""Cross-entropy difference of a target and a background language model.

Both are bigram models over one vocabulary, all words of the corpus, with the same smoothing;
the background's counts are scaled to the target's size, so that the two are matched.  With

    p(w | v) = (c(v w) + M / V) / (c(v) + M)

a token's loss under the target less its loss under the background is the sum of two terms,
one of the bigram and one of its first word, and a document's score is the mean over its
tokens: the lower, the closer to the target.

Documents are dealt to chunks.  A chunk counts its own bigrams and contexts first and asks
for each distinct one once, packed by bucket; a bucket adds the counts of all chunks up and
answers with the sums, in the order asked.  So a frequent word costs one entry a chunk, not
one a document, and no table of n-grams is held or sent whole.  A document's own n-grams are
taken out of the counts it is scored with.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, _spread, small_batches

CHUNK_BYTES = 4 << 20
MASS = 2.0  # M, the weight of the uniform distribution
KEY_BITS = 48  # of an n-gram's hash inside its bucket

ASKED = "kind int, bucket int, chunk long, keys binary, counts binary, of_target binary"
NAMED = 2  # the kind of the row that carries a chunk's target documents

_START = np.uint64(0xA0761D6478BD642F)


def ngrams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each token's bigram and of its context, the word before or the beginning."""
    before = np.empty_like(words.hash)
    before[1:] = words.hash[:-1]
    before[words.first[:-1][np.diff(words.first) > 0]] = _START
    return _spread(before * np.uint64(0x9E3779B97F4A7C15) + words.hash), _spread(before ^ np.uint64(0xE7037ED1A0B428DB))


def pack(values: np.ndarray, width: int) -> bytes:
    """Integers as bytes, the first bytes of all first, compressed."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = raw.reshape(width, -1).T
    return out.view("<u8").ravel()


def distinct(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, where each occurrence's is, and the first of each bucket (and the end).

    Keys are ordered by bucket, then by the bits that stay; the bucket is a range of the
    hash's first bits, so plain order will do.
    """
    names, back = np.unique(keys, return_inverse=True)
    bucket = ((names >> np.uint64(40)) * np.uint64(buckets)) >> np.uint64(24)
    return names, back, np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))


def terms(target: np.ndarray, background: np.ndarray, kind: int, scale: float, vocabulary: float) -> np.ndarray:
    """Loss under the target less loss under the background: of bigrams (0) or contexts (1)."""
    extra = MASS if kind else MASS / vocabulary
    ratio = np.log(target + extra) - np.log(background * scale + extra)
    return ratio if kind else -ratio


def own_counts(doc: np.ndarray, place: np.ndarray, many: int) -> np.ndarray:
    """For each occurrence, how often its document holds the same n-gram."""
    _, back, counts = np.unique(doc * many + place, return_inverse=True, return_counts=True)
    return counts[back]


def score(docs: DataFrame, target: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_tokens, score.

    ``target`` (doc_id) names the documents of the target model; all others make up the
    background.  Null ids are never in the target; a text without words has 0 tokens and a null score;
    with an empty target or background the missing counts are zero; repeated rows count as
    often as they stand there and get equal scores; extra columns are ignored; an empty table
    gives an empty one.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text"))
    named = target.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()

    def survey(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = Words([t.encode() for t in batch["text"]])
            heard = np.full(len(batch), None, object)
            if len(batch):
                heard[0] = np.unique(words.hash).view(np.int64)  # of the whole batch, on its first row
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "tokens": np.diff(words.first), "heard": heard})

    surveyed = rows.select("doc_id", "text").mapInPandas(survey, "doc_id long, tokens long, heard array<long>")
    counted = surveyed.join(named.withColumn("in_target", F.lit(True)), "doc_id", "left")
    sums = counted.agg(
        F.sum(F.when(F.col("in_target"), F.col("tokens"))).alias("t"), F.sum("tokens").alias("all")
    ).first()
    # Each task drops its repeated words before they travel.
    vocabulary = float(surveyed.select(F.explode("heard").alias("word")).distinct().count() or 1)
    in_target, in_all = sums.t or 0, sums["all"] or 0
    scale = in_target / (in_all - in_target) if in_target and in_all > in_target else 1.0

    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    many = int(size // CHUNK_BYTES + 1)
    chunk = F.pmod(F.xxhash64("key"), F.lit(many)).alias("chunk")
    parts = rows.select("doc_id", "text", "key", chunk).groupBy("chunk")
    flags = rows.select("doc_id", "key", chunk).distinct().join(named, "doc_id").select("chunk", "key").toDF("chunk", "key").groupBy("chunk")

    def ask(key: tuple, mine: pd.DataFrame, flagged: pd.DataFrame) -> pd.DataFrame:
        words = Words([t.encode() for t in mine["text"]])
        wanted = mine["key"].isin(flagged["key"]).to_numpy()[words.doc]
        named_here = np.unique(flagged["key"].to_numpy(np.int64)).tobytes()
        out = [(NAMED, int(key[0]), key[0], named_here, b"", b"")]
        for kind, keys in enumerate(ngrams(words)):
            names, back, first = distinct(keys, many)
            both = np.bincount(back, minlength=len(names))
            of_target = np.bincount(back[wanted], minlength=len(names))
            names = names & np.uint64((1 << KEY_BITS) - 1)
            for b in np.flatnonzero(np.diff(first)).tolist():
                part = slice(first[b], first[b + 1])
                # Sorted by the bits that stay, for small steps.
                order = np.argsort(names[part], kind="stable")
                sent = names[part][order]
                steps = np.diff(sent, prepend=np.uint64(0))
                out.append((kind, b, key[0], pack(steps, 6), pack(both[part][order], 4), pack(of_target[part][order], 4)))
        return pd.DataFrame(out, columns=["kind", "bucket", "chunk", "keys", "counts", "of_target"])

    asked = parts.cogroup(flags).applyInPandas(ask, ASKED)

    def answer(mine: pd.DataFrame) -> pd.DataFrame:
        if mine["kind"].iloc[0] == NAMED:
            return mine
        keys = [np.cumsum(unpack(k, 6)) for k in mine["keys"]]
        names, back = np.unique(np.concatenate(keys), return_inverse=True)
        ends = np.cumsum([len(k) for k in keys])
        out = {"keys": b""}
        for column in ("counts", "of_target"):
            sums = np.bincount(back, np.concatenate([unpack(c, 4) for c in mine[column]]), len(names))[back].astype(np.uint64)
            out[column] = [pack(sums[e - len(k) : e], 5) for e, k in zip(ends, keys, strict=True)]
        return mine.assign(**out)

    answered = asked.groupBy("kind", "bucket").applyInPandas(answer, ASKED)

    def add(mine: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        words = Words([t.encode() for t in mine["text"]])
        total = np.zeros(len(words.hash))
        by = {(r.kind, r.bucket): r for r in replies.itertuples(index=False)}
        named_here = np.frombuffer(next(r.keys for k, r in by.items() if k[0] == NAMED), np.int64)
        is_target = np.isin(mine["key"].to_numpy(), named_here)[words.doc]
        for kind, keys in enumerate(ngrams(words)):
            names, back, first = distinct(keys, many)
            names = names & np.uint64((1 << KEY_BITS) - 1)
            both, of_target = np.zeros(len(names)), np.zeros(len(names))
            for b in np.flatnonzero(np.diff(first)).tolist():
                part = slice(first[b], first[b + 1])
                order = first[b] + np.argsort(names[part], kind="stable")
                both[order] = unpack(by[kind, b].counts, 5)
                of_target[order] = unpack(by[kind, b].of_target, 5)
            own = own_counts(words.doc, back, len(names))
            target_counts = of_target[back] - np.where(is_target, own, 0)
            others = (both - of_target)[back] - np.where(is_target, 0, own)
            total += terms(target_counts, others, kind, scale, vocabulary)
        tokens = np.diff(words.first)
        sums = np.bincount(words.doc, total, words.texts)
        return pd.DataFrame(
            {"doc_id": mine["doc_id"].astype("Int64"), "n_tokens": tokens, "score": pd.Series(sums / np.maximum(tokens, 1)).where(tokens > 0)}
        )

    return parts.cogroup(answered.groupBy("chunk")).applyInPandas(add, "doc_id long, n_tokens long, score double")
