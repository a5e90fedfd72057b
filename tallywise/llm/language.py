"""Language identification with a small convolutional network over bytes.

Each byte has a learned vector; filters two, three and four bytes wide run over windows of
fixed length; every filter's largest answer in a window goes through a softmax layer.  All
windows of a text count, by the bytes they hold.  Training and application are numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

WIDTHS = (2, 3, 4)
FILTERS = 16  # of each width
WINDOW = 128  # bytes
DEPTH = 8  # size of a byte's vector
UNKNOWN = "und"
UNLABELLED = "unlabelled"  # a text with letters where no row has a language to learn from
PER_LANGUAGE = 512  # labelled texts looked at for each language, at most
MOST_LANGUAGES = 200
SLICE = 256  # characters taken from the beginning, the middle and the end of a training text

# Capital letters count as small ones and all digits as one.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32
FOLD[ord("0") : ord("9") + 1] = ord("0")


@dataclass
class ByteNet:
    languages: list[str]
    vectors: np.ndarray  # 256 x DEPTH; byte 0, the padding, is zero
    filters: np.ndarray  # (widest * DEPTH) x all filters, zero beyond a filter's width
    bias: np.ndarray
    weights: np.ndarray  # all filters x languages
    offset: np.ndarray

    def _columns(self, windows: np.ndarray) -> np.ndarray:
        """Vectors of the bytes seen from each place side by side; all windows' first places come first."""
        n, widest = len(windows), max(WIDTHS)
        padded = np.zeros((WINDOW + widest - 1, n), np.uint8)
        padded[:WINDOW] = windows.T
        x = self.vectors[padded]
        return np.concatenate([x[j : j + WINDOW] for j in range(widest)], axis=2).reshape(WINDOW * n, -1)

    def _answers(self, windows: np.ndarray) -> np.ndarray:
        """Places x windows x filters."""
        return (self._columns(windows) @ self.filters).reshape(WINDOW, len(windows), -1)

    def probabilities(self, windows: np.ndarray, at_once: int = 128) -> np.ndarray:
        out = np.empty((len(windows), len(self.languages)), np.float32)
        for i in range(0, len(windows), at_once):
            hidden = np.maximum(self._answers(windows[i : i + at_once]).max(axis=0) + self.bias, 0)
            out[i : i + at_once] = _softmax(hidden @ self.weights + self.offset)
        return out


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts cut into windows of fixed length, and each text's number of windows."""
    counts = np.fromiter((-(-len(t) // WINDOW) for t in texts), np.int64, len(texts))
    joined = b"".join(t.ljust(int(n) * WINDOW, b"\0") for t, n in zip(texts, counts, strict=True))
    return FOLD[np.frombuffer(joined, np.uint8)].reshape(-1, WINDOW), counts


def train(texts: list[str], languages: list[str], rounds: int = 12, seed: int = 7) -> ByteNet:
    """Fit a network by Adam on labelled texts; the same input gives the same network."""
    names = sorted(set(languages))
    windows, counts = windows_of([t.encode() for t in texts])
    labels = np.repeat([names.index(x) for x in languages], counts)
    rng = np.random.default_rng(seed)
    many, widest = FILTERS * len(WIDTHS), max(WIDTHS)
    mask = np.repeat([[j // DEPTH < w for j in range(widest * DEPTH)] for w in WIDTHS], FILTERS, axis=0).T
    net = ByteNet(
        names,
        rng.normal(0, 0.5, (256, DEPTH)).astype(np.float32),
        (rng.normal(0, 0.25, (widest * DEPTH, many)) * mask).astype(np.float32),
        np.zeros(many, np.float32),
        rng.normal(0, 0.2, (many, len(names))).astype(np.float32),
        np.zeros(len(names), np.float32),
    )
    net.vectors[0] = 0
    share = np.bincount(labels, minlength=len(names))
    value = (len(labels) / (len(names) * np.maximum(share, 1)))[labels].astype(np.float32)
    fitted = ("vectors", "filters", "bias", "weights", "offset")
    first = {k: np.zeros_like(getattr(net, k)) for k in fitted}
    second = {k: np.zeros_like(getattr(net, k)) for k in fitted}
    step = 0
    for _ in range(rounds):
        order = rng.permutation(len(windows))
        for i in range(0, len(order), 64):
            part = order[i : i + 64]
            made = net._answers(windows[part])
            where = made.argmax(axis=0)
            top = np.take_along_axis(made, where[None], 0)[0] + net.bias
            hidden = np.maximum(top, 0)
            error = _softmax(hidden @ net.weights + net.offset)
            error[np.arange(len(part)), labels[part]] -= 1
            error *= value[part][:, None] / len(part)
            back = (error @ net.weights.T) * (top > 0)
            # Only the place of a filter's largest answer learns.
            padded = np.zeros((len(part), WINDOW + widest - 1), np.uint8)
            padded[:, :WINDOW] = windows[part]
            seen = padded[np.arange(len(part))[:, None, None], where[:, :, None] + np.arange(widest)]
            columns = net.vectors[seen].reshape(len(part), many, widest * DEPTH)
            grads = {
                "weights": hidden.T @ error,
                "offset": error.sum(0),
                "bias": back.sum(0),
                "filters": np.einsum("nfk,nf->kf", columns, back) * mask,
                "vectors": np.zeros_like(net.vectors),
            }
            to_bytes = (back[:, :, None] * net.filters.T).reshape(len(part), many, widest, DEPTH)
            np.add.at(grads["vectors"], seen, to_bytes)
            grads["vectors"][0] = 0
            step += 1
            for k in fitted:
                first[k] = 0.9 * first[k] + 0.1 * grads[k]
                second[k] = 0.999 * second[k] + 0.001 * grads[k] ** 2
                change = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                setattr(net, k, (getattr(net, k) - 0.01 * change).astype(np.float32))
    return net


def labelled_sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> list[tuple[str, str]]:
    """Up to ``per_language`` texts of each language, picked by the texts' hashes.

    Texts fall into ``per_language`` bins by hash and the least hash of a bin is taken, so
    repeated rows count once and the driver gets a bounded number of slices, never texts.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text")
    key = F.xxhash64("text")
    picked = (
        rows.groupBy("lang", F.pmod(F.xxhash64(key), F.lit(per_language)).alias("bin"))
        .agg(F.min(key).alias("key"))
        .select("lang", "key")
        .limit(per_language * MOST_LANGUAGES + 1)
        .collect()
    )
    if len(picked) > per_language * MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not picked:
        return []
    small = docs.sparkSession.createDataFrame(picked, "lang string, key bigint")
    middle = (F.length("text") / 2).cast("int")
    slices = F.array(
        F.substring("text", 1, SLICE),
        F.substring("text", F.greatest(middle, F.lit(1)), F.lit(SLICE)),
        F.when(F.length("text") > 2 * SLICE, F.substring("text", -SLICE, SLICE)).otherwise(F.lit("")),
    )
    found = (
        rows.withColumn("key", key)
        .join(F.broadcast(small), ["lang", "key"], "left_semi")  # at most per_language rows a language
        .groupBy("lang", "key")
        .agg(F.min(slices).alias("slices"))
        .collect()
    )
    return [(x, r.lang) for r in sorted(found, key=lambda r: (r.lang, r.key)) for x in r.slices if x]


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> ByteNet | None:
    """A network trained on rows with a text and a language; None if there are none."""
    sample = labelled_sample(docs, per_language)
    return train([t for t, _ in sample], [x for _, x in sample]) if sample else None


def identify(docs: DataFrame, net: ByteNet | None, text: str = "text", unfitted: str = UNKNOWN) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the mean probability over all windows.

    A text that is null, empty or without a letter is ``und`` with score 0; if there is no
    network, all others are ``unfitted`` with score 0.  Equal scores go to the language first in the alphabet.  Rows are
    independent: repeated rows get equal answers, other columns stay (of the same names:
    replaced), an empty table stays empty.  There is no shuffle.
    """
    small_batches(docs.sparkSession)

    def predict(column: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in column:
            known = np.array([t is not None and any(map(str.isalpha, t)) for t in texts], bool)
            names = np.where(known, unfitted, UNKNOWN).astype(object)
            scores = np.zeros(len(texts))
            chosen = [t.encode() for t, k in zip(texts, known, strict=True) if k] if net is not None else []
            if chosen:
                windows, counts = windows_of(chosen)
                held = (windows != 0).sum(axis=1)
                weighted = net.probabilities(windows) * held[:, None]
                first = np.cumsum(counts) - counts
                mean = np.add.reduceat(weighted, first) / np.add.reduceat(held, first)[:, None]
                best = mean.argmax(axis=1)
                names[known] = [net.languages[i] for i in best]
                scores[known] = np.clip(mean[np.arange(len(best)), best], 0, 1)
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    made = F.pandas_udf(predict, "lang_pred string, score double")(F.col(f"`{text}`"))
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.select(*kept, made.alias("__made")).select(*kept, "__made.lang_pred", "__made.score")
