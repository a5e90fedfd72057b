import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywise.llm import queries, toxicity


def plain_risk(w, b, p, u, prior):
    """The non-negative risk, text by text."""
    loss = lambda f, y: float(np.log1p(np.exp(-y * f)))
    value = lambda x: float(x @ w + b)
    positive = sum(loss(value(x), 1) for x in p) / len(p)
    clean = sum(loss(value(x), -1) for x in u) / len(u) - prior * sum(loss(value(x), -1) for x in p) / len(p)
    return prior * positive + max(0.0, clean)


def made(rng, n, d=12):
    """Texts of ``d`` words; the toxic ones hold at least one of words 0 to 2."""
    toxic = rng.random(n) < 0.2
    x = (rng.random((n, d)) < 0.3).astype(np.float32)
    x[:, :3] = 0
    x[toxic, rng.integers(0, 3, toxic.sum())] = 1
    return x, toxic


def test_training_lowers_the_risk_and_finds_toxic_texts_without_clean_examples():
    rng = np.random.default_rng(5)
    x, toxic = made(rng, 3000)
    p, u = x[:1500][toxic[:1500]], x[1500:]
    w, b = toxicity.train(p, u, 0.2)
    assert plain_risk(w, b, p, u, 0.2) < 0.3 * plain_risk(np.zeros(12), 0.0, p, u, 0.2)
    held, answer = made(rng, 1000)
    assert np.mean((held @ w + b > 0) == answer) > 0.98


def test_the_corrected_risk_is_not_plain_learning_of_unlabelled_as_clean():
    rng = np.random.default_rng(6)
    x, toxic = made(rng, 3000)
    p, u = x[:300][toxic[:300]], x[300:]
    # Unlabelled taken as clean: one row in six of those with a toxic word is called toxic only.
    w, b = np.zeros(12), 0.0
    for _ in range(400):
        f = np.concatenate([p, u]) @ w + b
        off = 1 / (1 + np.exp(-f)) - np.concatenate([np.ones(len(p)), np.zeros(len(u))])
        w, b = w - 2 * np.concatenate([p, u]).T @ off / len(f), b - 2 * off.mean()
    naive = np.mean(u[toxic[300:]] @ w + b > 0)
    w, b = toxicity.train(p, u, 0.2)
    assert naive < 0.1 and np.mean(u[toxic[300:]] @ w + b > 0) > 0.98


def test_documents(spark, data, texts):
    rows = queries.QUERIES["op12_toxicity"](spark, data).collect()
    assert len(rows) == len(texts)
    import zlib

    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    clean = [r.predicted for r in rows if r.held_out and labels.get(r.doc_id) == 0]
    assert np.mean(clean) <= 0.1


def test_held_out_texts_of_a_corpus(spark):
    rng = np.random.default_rng(3)
    insults, words = [f"bad{c}" for c in "abcdef"], [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(600)]
    rows, labels, toxic = [], [], {}
    for i in range(3000):
        text = rng.choice(words, rng.integers(5, 120)).tolist()
        toxic[i] = rng.random() < 0.12
        if toxic[i]:
            for at in rng.integers(0, len(text), rng.integers(1, 4)):
                text.insert(int(at), str(rng.choice(insults)).title() + ",")
        rows.append((i, " ".join(text)))
        if i % 5 and rng.random() < 0.5:
            labels.append((i, int(toxic[i])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs.where("doc_id % 5 <> 0"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert set(insults) == {w for w in model.words if w.startswith("bad")}
    held = {r.doc_id: r.score >= 0.5 for r in toxicity.score(docs.where("doc_id % 5 = 0"), model).collect()}
    assert np.mean([held[i] for i in held if toxic[i]]) >= 0.9
    assert np.mean([held[i] for i in held if not toxic[i]]) <= 0.01


def test_scores_are_a_plain_sum(spark):
    model = toxicity.Model({"bad": 0, "größe": 1}, np.array([3.0, -1.0]), -2.0)
    rows = [(1, "Bad, bad!"), (2, None), (3, ""), (4, "GRÖSSE Größe_bad"), (5, "bad " * 100_000), (5, "bad " * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    got = [r.score for r in toxicity.score(df, model).orderBy("doc_id").collect()]
    want = [1 / (1 + np.exp(-x)) for x in (1, -2, -2, 0, 1, 1)]
    assert got == pytest.approx(want)
    assert toxicity.score(df.limit(0), model).count() == 0


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 1), (6, 0, 0), (1, 0, 0), (3, None, None)], "doc_id long, toxic int, text int")
    model = toxicity.fit(odd_docs, labels)
    assert model is not None and toxicity.score(odd_docs, model).count() == odd_docs.count()
    for docs, known in ((no_docs, labels), (odd_docs, labels.limit(0)), (odd_docs, labels.where("toxic = 0"))):
        assert toxicity.fit(docs, known) is None
    assert {r.score for r in toxicity.score(odd_docs, None).collect()} == {0.0}
