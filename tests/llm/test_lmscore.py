import math
from collections import Counter

from pyspark.sql import functions as F

from tallywise.llm import lmscore


def brute(rows, good):
    counts = [Counter(), Counter()], [Counter(), Counter()]
    vocabulary = set()
    for d, t in rows:
        w = (t or "").encode().split()
        vocabulary.update(w)
        part = counts[d in good]
        part[0].update(zip([None, *w][:-1], w, strict=True))
        part[1].update([None, *w][:-1])
    (bb, cb), (bt, ct) = counts
    nt, nb = sum(ct.values()), sum(cb.values())
    scale, v, m = nt / nb if nt and nb else 1.0, len(vocabulary), lmscore.MASS
    out = []
    for d, t in rows:
        w = (t or "").encode().split()
        pairs = list(zip([None, *w][:-1], w, strict=True))
        ob, oc = Counter(pairs), Counter(p for p, _ in pairs)
        g, total = d in good, 0.0
        for p, x in pairs:
            a = (bt[p, x] - g * ob[p, x] + m / v) / (ct[p] - g * oc[p] + m)
            b = ((bb[p, x] - (not g) * ob[p, x]) * scale + m / v) / ((cb[p] - (not g) * oc[p]) * scale + m)
            total += math.log(b) - math.log(a)
        out.append((d, len(w), total / len(w) if w else None))
    return out


def same(found, wanted, close):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or 0)
    found, wanted = sorted(map(tuple, found), key=key), sorted(wanted, key=key)
    assert [r[:2] for r in found] == [r[:2] for r in wanted]
    assert all(a == b or abs(a - b) < close for (*_, a), (*_, b) in zip(found, wanted, strict=True))


def test_documents(spark, data, documents, texts):
    labels = spark.read.parquet(f"{data}/labels.parquet").where("quality = 1 and toxic = 0").select("doc_id")
    good = {r.doc_id for r in labels.collect()}
    same(lmscore.score(documents, labels).collect(), brute(sorted(texts.items()), good), 1e-9)


def test_odd_rows(spark, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(lmscore, "CHUNK_BYTES", 500)
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    target = spark.createDataFrame([(1,), (None,), (6,), (6,)], "doc_id long")
    same(lmscore.score(odd_docs.withColumnRenamed("source", "score"), target).collect(), brute(rows, {1, 6}), 1e-9)
    same(lmscore.score(odd_docs, target.limit(0)).collect(), brute(rows, set()), 1e-9)
    assert lmscore.score(no_docs, target).count() == 0


def test_prefers_the_target(spark):
    rows = [(i, "good words here and there " * 4) for i in range(5)] + [(i, "bad stuff all over again " * 4) for i in range(5, 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    scores = lmscore.score(df, df.where("doc_id < 4").select("doc_id")).groupBy(F.col("doc_id") < 5).agg(F.max("score"), F.min("score"))
    got = {r[0]: (r[1], r[2]) for r in scores.collect()}
    assert got[True][0] < got[False][1]
