import random
from collections import Counter

import pytest

from tallywise.llm import substrings


def brute(rows, window):
    split = [(d, (t or "").encode().split()) for d, t in rows]
    counts = Counter(tuple(w[i : i + window]) for _, w in split for i in range(len(w) - window + 1))
    out = Counter()
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if counts[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out[d, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g)] += 1
    return out


def found(df):
    return Counter((r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in df.collect())


@pytest.mark.parametrize("hot", [substrings.HOT, 0, 3])
def test_documents(documents, texts, hot):
    assert found(substrings.dedupe(documents, hot=hot)) == brute(texts.items(), 35)


def test_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert found(substrings.dedupe(odd_docs.withColumnRenamed("source", "kept"))) == brute(rows, 35)
    assert substrings.dedupe(no_docs).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_small_alphabet(spark, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice("ab") * rng.randrange(1, 3) for _ in range(rng.randrange(0, 60)))) for i in range(60)]
    rows += [(100, "p q r " * 14), (101, "z " * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(substrings.dedupe(df, window=7, run=3)) == brute(rows, 7)
