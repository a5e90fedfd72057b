"""Personal data: generated candidates, boosted trees, calibrated thresholds.

Four kinds have fixed rules, whose matches always count.  Generators of high recall
propose more spans, overlapping ones too: loose forms of the four kinds and secrets (long
mixed tokens, values after words like "password" or "token").  Boosted regression trees
score each proposal by its form and by what stands around it.  They learn from the corpus
itself: what the fixed rules and the strict secret forms accept against what is surely none
(a failing checksum, a part above 255, a piece of something else, plain words).  All other
proposals are unlabelled: the trees never learn from them, they only judge them.  Forms are
compared without the marks that the rules decide by, so that a loose form looks like the
strict one.  Scores are calibrated on proposals kept aside, and each kind's threshold is the
least one whose precision there reaches the wanted one.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

KINDS = ("email", "ip", "card", "phone", "secret")


class Runs:
    """Leftmost matches, one after another, of a pattern that opens with a run of marks.

    What follows the run begins with none of its marks, so a match from inside a run exists
    only where one from its beginning does: only beginnings of runs, and the place where the
    match before ended, are tried.  With possessive repeats every text takes linear time.
    """

    def __init__(self, marks: str, rest: str):
        self.here = re.compile(f"[{marks}]++{rest}")
        self.next = re.compile(f"(?<![{marks}])[{marks}]++{rest}")

    def finditer(self, text: str) -> Iterator[re.Match]:
        found = self.next.search(text)
        while found:
            yield found
            found = self.here.match(text, found.end()) or self.next.search(text, found.end())


# Fixed rules of the four base kinds; possessive repeats give the same matches without going back.
EMAIL = Runs(r"A-Za-z0-9._%+-", r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = Runs(r"0-9", r"(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Strict forms a secret is learned from.
SECRET = re.compile(r"AKIA[A-Z0-9]{16}|(?<=token = \")[0-9a-f]{32,40}(?=\")|(?<=password=)[0-9a-f]{12,20}(?![0-9a-f])")

# Generators: looser than the rules.
LOOSE = {
    "email": Runs(r"A-Za-z0-9._%+-", r" ?(?:@|\[at\]|\(at\)) ?[A-Za-z0-9-]++(?:(?:\.|\[dot\]|\(dot\))[A-Za-z0-9-]++)*+"),
    "ip": re.compile(r"[0-9]{1,4}(?:(?:\.|\[\.\]|\(\.\)|\[dot\])[0-9]{1,4}){2,4}"),
    "card": re.compile(r"[0-9](?:[ .-]?[0-9]){10,20}"),
    "phone": re.compile(r"[+(]?[0-9](?:[ ().-]{0,2}[0-9]){6,16}"),
    "secret": re.compile(r"[A-Za-z0-9_/+-]{10,}"),
}
CONTEXT = 24  # characters looked at on either side
HINTS = (
    re.compile(r"mail|contact|write", re.I),
    re.compile(r"\bip\b|host|server|addr", re.I),
    re.compile(r"card|visa|pay|iban|account", re.I),
    re.compile(r"phone|tel|call|mobile|fax", re.I),
)
SAMPLE = 4096  # proposals of each kind and rule answer the trees learn from, at most
PRECISION = 0.99


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed rules by kind, then start: leftmost, non-overlapping per kind, failing matches dropped."""
    found = []
    if "@" in text:
        found += [("email", *m.span()) for m in EMAIL.finditer(text)]
    if not _ANY_DIGIT.search(text):
        return found
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(_at_most_255(p) for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = _digits(m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return found


_ANY_DIGIT = re.compile("[0-9]")


def _at_most_255(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def proposals(text: str) -> list[tuple[str, int, int]]:
    """All spans the generators propose; kinds overlap."""
    found = []
    if "@" in text or "[at]" in text or "(at)" in text:
        found += [("email", *m.span()) for m in LOOSE["email"].finditer(text)]
    if _ANY_DIGIT.search(text):
        for kind in ("ip", "card", "phone"):
            found += [(kind, *m.span()) for m in LOOSE[kind].finditer(text)]
        found += [("secret", *m.span()) for m in LOOSE["secret"].finditer(text) if _ANY_DIGIT.search(m[0])]
    return found


_DATE = re.compile(r"(?:19|20)[0-9]{2}[ .-][0-9]{1,2}[ .-][0-9]{1,2}|[0-9]{1,2}[ .-][0-9]{1,2}[ .-](?:19|20)[0-9]{2}")
_DECIMAL = re.compile(r"[0-9]+\.[0-9]+")
_WORDLIKE = re.compile(r"[0-9]+|[A-Z]?[a-z]*[0-9]{0,4}|[A-Z]+[0-9]{0,4}")


def strict(kind: str, span: str) -> str:
    """A span in the spelling of its kind's rule, without what the rule tells it by."""
    if kind == "email":
        return re.sub(r"\[dot\]|\(dot\)", ".", re.sub(r" ?(?:@|\[at\]|\(at\)) ?", "@", span))
    if kind == "ip":
        return re.sub(r"\[\.\]|\(\.\)|\[dot\]", ".", span)
    if kind == "card":
        return _digits(span)
    if kind == "phone":  # as dialled inside the country
        return " ".join(re.findall("[0-9]+", re.sub(r"^\+[0-9]{1,3}[ ().-]+", "", span)))
    return span


class Certain:
    """Spans that the rules accept; those of one kind never overlap."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        self.edges: dict[str, tuple[list[int], list[int]]] = {}
        for kind, start, end in spans:
            starts, ends = self.edges.setdefault(kind, ([], []))
            starts.append(start)
            ends.append(end)

    def other(self, kind: str, start: int, end: int) -> bool:
        """Does a span of another kind overlap this one?"""
        for k, (starts, ends) in self.edges.items():
            last = bisect_left(starts, end) - 1
            if k != kind and last >= 0 and ends[last] > start:
                return True
        return False


def none(text: str, kind: str, start: int, end: int, certain: Certain) -> float | None:
    """Weight of a proposal that is surely not of its kind; None if it may be.

    What fails only a check counts as much as would have passed it by chance.
    """
    span = strict(kind, text[start:end])
    if certain.other(kind, start, end):
        return 1.0
    if kind == "email":
        last = span.rpartition("@")[2].rpartition(".")
        return None if last[0] and len(last[2]) >= 2 and last[2].isalpha() else 1.0
    if kind == "secret":
        parts = re.split("[_/+-]", span)
        plain = not any(map(str.isalpha, span)) or all(_WORDLIKE.fullmatch(p) for p in parts)
        return 1.0 if plain else None
    if text[start - 1 : start].isalnum() or re.match(r"(?!x[0-9]|ext)[^\W_]", text[end : end + 3]):
        return 1.0  # inside a word
    digits = len(_digits(span))
    if kind == "ip":
        parts = span.split(".")
        if len(parts) != 4:
            return 1.0
        return None if all(map(_at_most_255, parts)) else 0.256**4
    if kind == "card":
        if not 13 <= digits <= 19 or min(map(len, re.findall("[0-9]+", text[start:end]))) < 3:
            return 1.0
        return None if luhn(span) else 1 / 9
    whole = text[start:end]
    return 1.0 if len(_digits(whole)) > 15 or _DATE.fullmatch(whole) or _DECIMAL.fullmatch(whole) else None


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Form of the span in its strict spelling, then of its surroundings."""
    span = strict(kind, text[start:end])
    digits = _digits(span)
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    letters = sum(map(str.isalpha, span))
    upper = sum(map(str.isupper, span))
    parts = re.split(r"[^0-9]+", span)
    counts = np.unique(list(span), return_counts=True)[1] / len(span)
    row = [
        KINDS.index(kind), len(span), len(digits), letters, upper, len(set(span)),
        float(-(counts * np.log2(counts)).sum()),
        span.count("."), span.count("-"), span.count(" "), max(map(len, parts)), len(parts[-1]),
        len(re.findall(r"[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])", span)),
    ]
    return [float(x) for x in row] + [float(bool(h.search(before))) for h in HINTS]


@dataclass
class Trees:
    """Boosted regression trees over quantised features, for the logistic loss.

    ``nodes`` holds for each tree (feature, cut, left, right, value) arrays.
    """

    start: float
    rate: float
    nodes: list[tuple[np.ndarray, ...]]

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for feature, cut, left, right, value in self.nodes:
            at = np.zeros(len(x), np.int64)
            while True:
                inner = feature[at] >= 0
                if not inner.any():
                    break
                goes = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= cut[at]
                at = np.where(inner, np.where(goes, left[at], right[at]), at)
            total += self.rate * value[at]
        return total


def boost(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 4, rate: float = 0.3, bins: int = 32, weight: np.ndarray | None = None) -> Trees:
    """Gradient boosting with Newton steps; splits are sought among quantiles."""
    weight = np.ones(len(x)) if weight is None else weight
    share = np.clip(np.average(y, weights=weight), 0.001, 0.999)
    model = Trees(float(np.log(share / (1 - share))), rate, [])
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins))) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    score = np.full(len(x), model.start)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, curve = weight * (y - p), weight * np.maximum(p * (1 - p), 1e-6)
        feature, cut, left, right, value = [], [], [], [], []

        def grow(rows: np.ndarray, level: int) -> int:
            me = len(feature)
            g, h = grad[rows].sum(), curve[rows].sum()
            for part, v in ((feature, -1), (cut, 0.0), (left, -1), (right, -1), (value, g / (h + 1))):
                part.append(v)
            best = (1e-3, -1, 0)
            if level < depth and len(rows) >= 8:
                for j, c in enumerate(cuts):
                    if len(c) < 2:
                        continue
                    gs = np.cumsum(np.bincount(binned[rows, j], grad[rows], len(c) + 1))[:-1]
                    hs = np.cumsum(np.bincount(binned[rows, j], curve[rows], len(c) + 1))[:-1]
                    gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                    k = int(gain[:-1].argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], j, k)
            if best[1] >= 0:
                _, j, k = best
                goes = binned[rows, j] <= k
                feature[me], cut[me] = j, cuts[j][k]
                left[me] = grow(rows[goes], level + 1)
                right[me] = grow(rows[~goes], level + 1)
            return me

        grow(np.arange(len(x)), 0)
        model.nodes.append(tuple(map(np.array, (feature, cut, left, right, value))))
        score = score + rate * (Trees(0.0, 1.0, model.nodes[-1:]).raw(x))
    return model


@dataclass
class Model:
    trees: Trees | None
    scale: float  # calibration of raw scores: sigmoid(scale * raw + shift)
    shift: float
    thresholds: dict[str, float]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * self.trees.raw(x) + self.shift)))


def calibrated(trees: Trees, x: np.ndarray, y: np.ndarray, precision: float = PRECISION, weight: np.ndarray | None = None) -> Model:
    """Platt scaling and one threshold per kind, from proposals the trees have not seen."""
    weight = np.ones(len(x)) if weight is None else weight
    raw, scale, shift = trees.raw(x), 1.0, 0.0
    for _ in range(50):  # Newton's method for two parameters, slightly ridged
        p = 1 / (1 + np.exp(-(scale * raw + shift)))
        w, off = weight * np.maximum(p * (1 - p), 1e-9), weight * (y - p)
        g = np.array([(off * raw).sum() - 0.01 * (scale - 1), off.sum() - 0.01 * shift])
        h = np.array([[(w * raw * raw).sum() + 0.01, (w * raw).sum()], [(w * raw).sum(), w.sum() + 0.01]])
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        scale, shift = scale + step[0], shift + step[1]
    model = Model(trees, float(scale), float(shift), {})
    p = model.probabilities(x)
    for i, kind in enumerate(KINDS):
        mine = x[:, 0] == i
        order = np.argsort(-p[mine], kind="stable")
        hits = np.cumsum((weight * y)[mine][order])
        exact = hits / np.cumsum(weight[mine][order])
        good = np.flatnonzero(exact >= precision)
        # Between the last score that is good enough and the next one, every threshold is as precise.
        ranked = np.append(p[mine][order], 0.0)
        model.thresholds[kind] = max(0.5, float(ranked[good[-1] : good[-1] + 2].mean())) if len(good) else math.inf
    return model


def _labelled(text: str) -> list[tuple[str, int, int, int, float]]:
    """Proposals that the rules accept (1) or that are surely none (0), with their weights; no others."""
    true = base_spans(text) + [("secret", *m.span()) for m in SECRET.finditer(text)]
    held, certain, out = set(true), Certain(true), []
    for p in proposals(text):
        weight = 1.0 if p in held else none(text, *p, certain)
        if weight is not None:
            out.append((*p, int(p in held), weight))
    return out


def fit(docs: DataFrame, sample: int = SAMPLE, seed: int = 1) -> Model:
    """Train on the corpus' own proposals: at most ``sample`` of each kind and answer, by hash.

    All texts are looked at; each bin of hashes keeps its least one, so the driver gets a
    bounded number of feature rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.where(F.col("text").rlike("[0-9@]")).select("text")

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, seen = [], set()
            for text in batch["text"]:
                for kind, s, e, answer, weight in _labelled(text):
                    shown = text[max(0, s - CONTEXT) : e + CONTEXT]
                    if e - s <= 200 and (kind, answer, shown) not in seen:
                        seen.add((kind, answer, shown))
                        out.append((kind, answer, weight, features(text, kind, s, e), shown))
            yield pd.DataFrame(out, columns=["kind", "answer", "weight", "x", "shown"])

    found = rows.mapInPandas(look, "kind string, answer int, weight double, x array<double>, shown string")
    found = found.withColumn("key", F.xxhash64("shown"))
    kept = (
        found.groupBy("kind", "answer", F.pmod(F.xxhash64("key"), F.lit(sample)).alias("bin"))
        .agg(F.min(F.struct("key", "x", "weight")).alias("least"))
        .select("answer", "least.key", "least.x", "least.weight")
        .collect()
    )
    if not kept:
        return Model(None, 1.0, 0.0, dict.fromkeys(KINDS, math.inf))
    kept.sort(key=lambda r: (r.key, r.answer, r.x, r.weight))
    x, y, weight = np.array([r.x for r in kept]), np.array([r.answer for r in kept], float), np.array([r.weight for r in kept])
    aside = np.random.default_rng(seed).random(len(x)) < 0.3
    if aside.all() or not aside.any():
        aside = np.arange(len(x)) % 2 == 0
    if aside.all() or not len(x[~aside]):
        return Model(None, 1.0, 0.0, dict.fromkeys(KINDS, math.inf))
    return calibrated(boost(x[~aside], y[~aside], weight=weight[~aside]), x[aside], y[aside], weight=weight[aside])


def spans_of(texts: list[str], model: Model) -> list[list[tuple[str, int, int, bool]]]:
    """For each text its spans (kind, start, end, by a fixed rule), by kind, then start."""
    out, rows, where = [], [], []
    for i, text in enumerate(texts):
        base = base_spans(text)
        out.append([(*b, True) for b in base])
        known = set(base)
        certain = Certain(base + [("secret", *m.span()) for m in SECRET.finditer(text)])
        for p in proposals(text) if model.trees is not None else ():
            if p not in known and none(text, *p, certain) is None:
                known.add(p)
                rows.append(features(text, *p))
                where.append((i, p))
    if rows:
        p = model.probabilities(np.array(rows))
        for (i, span), q in zip(where, p, strict=True):
            if q >= model.thresholds[span[0]]:
                out[i].append((*span, False))
    order = {k: n for n, k in enumerate(KINDS)}
    return [sorted(spans, key=lambda s: (order[s[0]], s[1], s[2])) for spans in out]


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def find(docs: DataFrame, model: Model, text: str = "text", out: str = "pii") -> DataFrame:
    """``docs`` with ``out``: the spans of each whole text in code points, end exclusive.

    Null and empty texts have none.  Rows are independent, repeated rows get equal spans,
    other columns stay, an empty table stays empty.  There is no shuffle.
    """
    small_batches(docs.sparkSession)

    def look(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in column:
            yield pd.Series([[dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in found] for found in spans_of(texts.tolist(), model)])

    return docs.withColumn(out, F.pandas_udf(look, SPANS)(F.coalesce(F.col(f"`{text}`"), F.lit(""))))


def redact(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; overlapping spans make one.

    Null texts stay null.
    """
    small_batches(docs.sparkSession)

    def clean(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in column:
            whole = [t or "" for t in texts]
            made = [redacted(t, s) for t, s in zip(whole, spans_of(whole, model), strict=True)]
            yield pd.Series([None if t is None else m for t, m in zip(texts, made, strict=True)], dtype=object)

    return docs.withColumn(text, F.pandas_udf(clean, "string")(F.col(f"`{text}`")))


def redacted(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    out, done = [], 0
    groups: list[list] = []
    for kind, s, e, base in sorted(spans, key=lambda x: (x[1], -x[2])):
        if groups and s < groups[-1][2]:
            groups[-1][2] = max(groups[-1][2], e)
            if base and not groups[-1][3]:
                groups[-1][0], groups[-1][3] = kind, True
        else:
            groups.append([kind, s, e, base])
    for kind, s, e, _ in groups:
        out += [text[done:s], f"[{kind}]"]
        done = e
    return "".join(out) + text[done:]
