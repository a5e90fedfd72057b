"""Toxicity by non-negative positive-unlabelled learning.

Known are texts confirmed as toxic (P) and texts about which nothing is known (U), toxic
ones among them.  With the share ``prior`` of toxic texts, the risk on clean texts is the
risk of calling all of U clean, less the part that U's toxic texts have in it; the latter
is seen from P.  A flexible model drives that difference below zero by learning U by heart,
so it is held at zero: where a batch's difference is negative, the step goes the other way.

Features are the presence of single words anywhere in the whole text; those that tell P
from U best are chosen.  P and U are bounded samples picked by hash from all rows, each
text once; counting them, choosing words and scoring run on Spark, the driver holds only
the words and one short list of word numbers per sampled text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored

CONFIRMED = 4096  # toxic texts learnt from, at most
UNLABELLED = 8192  # other texts learnt from, at most
VOCABULARY = 2048  # words that are features, at most
LONGEST = 64  # characters of a word that may be a feature
WORD = re.compile(r"[^\W\d_]+")
DEFAULT_PRIOR = 0.1  # where the labels name no clean text


def words_of(text: str | None) -> set[str]:
    """The distinct words of a whole text, in small letters."""
    return set(WORD.findall((text or "").lower()))


@dataclass
class Model:
    """Word weights; ``words`` maps a word to its place in ``weights``."""

    words: dict[str, int]
    weights: np.ndarray
    shift: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        raw = np.full(len(texts), self.shift)
        for i, text in enumerate(texts):
            for word in words_of(text) & self.words.keys():
                raw[i] += self.weights[self.words[word]]
        return _sigmoid(raw)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def train(
    p: np.ndarray, u: np.ndarray, prior: float, steps: int = 1500, batch: int = 1024, rate: float = 0.02, ridge: float = 1e-4, seed: int = 1
) -> tuple[np.ndarray, float]:
    """Linear weights and shift that minimise the non-negative risk; rows of ``p`` and ``u`` are texts.

    Logistic loss, Adam steps, batches with P and U in proportion.
    """
    rng = np.random.default_rng(seed)
    p, u = (np.hstack([x, np.ones((len(x), 1), np.float32)]) for x in (p, u))
    w = np.zeros(p.shape[1])
    w[-1] = np.log(prior / (1 - prior))
    mean, square, step = np.zeros_like(w), np.zeros_like(w), 0
    parts = max(1, -(-len(u) // batch))
    for _ in range(-(-steps // parts)):
        order_p, order_u = rng.permutation(len(p)), rng.permutation(len(u))
        for k in range(parts):
            xp, xu = p[order_p[k::parts]], u[order_u[k::parts]]
            if not len(xp) or not len(xu):
                continue
            fp, fu = xp @ w, xu @ w
            # Mean losses: softplus(-f) for "toxic", softplus(f) for "clean".
            clean = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
            grad_clean = xu.T @ _sigmoid(fu) / len(xu) - prior * (xp.T @ _sigmoid(fp)) / len(xp)
            if clean >= 0:
                grad = grad_clean - prior * (xp.T @ _sigmoid(-fp)) / len(xp)
            else:
                grad = -grad_clean
            grad = grad + ridge * np.append(w[:-1], 0.0)
            step += 1
            mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
            w -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def _picked(docs: DataFrame, n: int) -> DataFrame:
    """At most ``n`` distinct texts of ``docs`` by hash: one for each of ``n`` bins of hashes."""
    keyed = docs.select("text", F.xxhash64("text").alias("key"))
    place = F.pmod(F.xxhash64(F.col("key").cast("string")), F.lit(n))
    keys = keyed.groupBy(place.alias("bin")).agg(F.min("key").alias("key")).select("key")
    # No more than n keys; the texts are met where they lie.
    return keyed.join(F.broadcast(keys), "key").groupBy("key").agg(F.first("text").alias("text"))


def sample(docs: DataFrame, labels: DataFrame, confirmed: int = CONFIRMED, unlabelled: int = UNLABELLED) -> DataFrame:
    """(toxic, key, text): bounded samples of confirmed toxic texts and of all texts."""
    docs = docs.select("doc_id", "text").where("text is not null")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(confirmed))
    # Twice as many ids as texts wanted, since some may be copies; at most 2 * confirmed of them.
    named = labels.where("toxic = 1 and doc_id is not null").select("doc_id")
    ids = None
    for seed in (0, 1):
        mine = named.where(F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)) == seed)
        least = mine.groupBy(place.alias("bin")).agg(F.min_by("doc_id", F.xxhash64("doc_id")).alias("doc_id")).select("doc_id")
        ids = least if ids is None else ids.unionByName(least)
    known = docs.join(F.broadcast(ids), "doc_id", "left_semi")
    marked = _picked(known, confirmed).withColumn("toxic", F.lit(True))
    return marked.unionByName(_picked(docs, unlabelled).withColumn("toxic", F.lit(False)))


def prior_of(labels: DataFrame) -> float:
    """The share of toxic texts among the labelled ones, kept between 0.01 and 0.9."""
    row = labels.agg(F.sum(F.col("toxic").cast("double")).alias("toxic"), F.count("toxic").alias("n")).first()
    if not row.n or row.toxic in (None, row.n):
        return DEFAULT_PRIOR
    return min(0.9, max(0.01, row.toxic / row.n))


def _vocabulary(rows: DataFrame, size: int) -> list[str]:
    """Words whose presence tells the two samples apart, by the likelihood ratio of their shares.

    Only ratios beyond what the best of as many words without any bearing would reach by
    chance (twice the logarithm of their number) count, the largest first.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen = {True: Counter(), False: Counter()}
            for toxic, text in zip(batch["toxic"].tolist(), batch["text"].tolist(), strict=True):
                seen[toxic].update(w for w in words_of(text) if len(w) <= LONGEST)
            for toxic, found in seen.items():
                yield pd.DataFrame({"word": pd.Series(list(found), dtype=object), "p": [n * toxic for n in found.values()], "u": [n * (not toxic) for n in found.values()]})

    sizes = rows.groupBy("toxic").count().collect()
    held = {r.toxic: r["count"] for r in sizes}
    n_p, n_u = float(held.get(True, 0)), float(held.get(False, 0))
    counts = rows.mapInPandas(count, "word string, p long, u long").groupBy("word").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    counts = counts.where("p + u >= 3")
    words = counts.count()

    def gain(held, n: float):
        """Twice the log likelihood of the texts with and without the word beyond that of the pooled share."""
        share = (F.col("p") + F.col("u")) / (n_p + n_u)
        rest = n - held
        with_word = F.when(held > 0, held * F.log(held / (n * share))).otherwise(0.0)
        return 2 * (with_word + F.when(rest > 0, rest * F.log(rest / (n * (1 - share)))).otherwise(0.0))

    ratio = gain(F.col("p"), n_p) + gain(F.col("u"), n_u)
    best = counts.withColumn("ratio", ratio).where(F.col("ratio") > 2 * np.log(max(words, 2)))
    best = best.orderBy(F.desc("ratio"), "word").limit(size).select("word")
    return sorted(r.word for r in best.collect())


def fit(docs: DataFrame, labels: DataFrame, prior: float | None = None, size: int = VOCABULARY) -> Model | None:
    """Train on ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic); None without a confirmed toxic text.

    Only rows with ``toxic`` = 1 are used as examples; whether another text is labelled clean
    plays no part but in the share ``prior``, unless that is given.  A doc_id labelled more
    than once counts as toxic if any row says so.  Null texts and null ids teach nothing.
    """
    small_batches(docs.sparkSession)
    prior = prior_of(labels) if prior is None else prior
    rows = stored(sample(docs, labels), "toxicity-sample")
    if rows.where("toxic").limit(1).count() == 0:
        return None
    words = {w: i for i, w in enumerate(_vocabulary(rows, size))}

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held = [np.array(sorted(words[w] for w in words_of(t) & words.keys()), "<u2").tobytes() for t in batch["text"]]
            yield pd.DataFrame({"toxic": batch["toxic"], "key": batch["key"], "held": held})

    found = rows.mapInPandas(look, "toxic boolean, key long, held binary").collect()
    found.sort(key=lambda r: (r.toxic, r.key))
    sets = {}
    for toxic in (True, False):
        mine = [np.frombuffer(r.held, "<u2") for r in found if r.toxic == toxic]
        x = np.zeros((len(mine), len(words)), np.float32)
        for row, held in zip(x, mine, strict=True):
            row[held] = 1
        sets[toxic] = x
    weights, shift = train(sets[True], sets[False], prior)
    return Model(words, weights, shift)


def score(docs: DataFrame, model: Model | None, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with ``out``: how likely each whole text is toxic, between 0 and 1.

    Null and empty texts get the score of a text without any known word, all texts 0 without
    a model.  Rows are independent, repeated rows get equal scores, other columns stay, a
    column ``out`` is replaced, an empty table stays empty.  There is no shuffle.
    """
    small_batches(docs.sparkSession)
    if model is None:
        return docs.withColumn(out, F.lit(0.0))

    def look(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in column:
            yield pd.Series(model.scores(texts.tolist()))

    return docs.withColumn(out, F.pandas_udf(look, "double")(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
