import numpy as np
from pyspark.sql import functions as F

from tallywise.llm import language, queries


def test_held_out_accuracy(spark, data, documents):
    found = queries.QUERIES["op1_language"](spark, data).join(documents.select("doc_id", "lang"), "doc_id")
    held = found.where("held_out and lang is not null")
    assert held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


def test_odd_rows(odd_docs, no_docs):
    net = language.fit(odd_docs)
    found = language.identify(odd_docs.withColumnRenamed("source", "score"), net).collect()
    assert len(found) == odd_docs.count()
    for r in found:
        known = r.text is not None and any(map(str.isalpha, r.text))
        assert (r.lang_pred == "und") == (not known)
        assert 0 <= r.score <= 1
    assert language.fit(no_docs) is None
    assert {r.lang_pred for r in language.identify(odd_docs, None).collect()} == {"und"}
    assert language.identify(no_docs, net).count() == 0


def test_all_windows_count():
    net = language.train(["aaaa bbbb " * 9, "zzzz yyyy " * 9] * 8, ["a", "z"] * 8)
    windows, counts = language.windows_of([b"aaaa bbbb " * 13, b"", b"zzzz yyyy " * 400])
    assert counts.tolist() == [2, 0, 32]
    p = net.probabilities(windows)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-5)
    assert p[:2, 0].min() > 0.5 and p[2:, 1].min() > 0.5


def test_sample_is_bounded(documents):
    per = 5
    sample = language.labelled_sample(documents, per)
    languages = documents.select("lang").distinct().count()
    assert 0 < len(sample) <= 3 * per * languages
    assert max(len(t) for t, _ in sample) <= language.SLICE
