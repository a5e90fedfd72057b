import random

import numpy as np
from pyspark.sql import functions as F

from tallywise.llm import queries, topk


def brute(rows, k=10):
    """Sorted results of every query row; a row's own place is left out, not its id."""
    out = []
    for at, (q, own) in enumerate(rows):
        if q % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(own, v, strict=False)), i) for n, (i, v) in enumerate(rows) if n != at)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def found(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def test_embeddings(spark, data):
    raw = spark.read.parquet(f"{data}/embeddings.parquet").collect()
    rows = [(r.vec_id, [int(np.floor(float(x) * 1024)) for x in r.embedding]) for r in raw]
    assert found(queries.QUERIES["op3_topk"](spark, data)) == brute(rows)


def test_ties_repeats_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERIES", 2)
    monkeypatch.setattr(topk, "CANDIDATES", 50)
    rng = random.Random(5)
    rows = [(i, [rng.randrange(-3, 4) for _ in range(3)]) for i in range(600)]
    rows += [rows[7]] * 4 + [(500, [0, 0]), (500, [3, 3, 3])] + [rows[100]] * 2
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, vector array<long>, score string")
    got = topk.search(df, F.col("vec_id") % 100 == 0)
    assert found(got) == brute(rows)
    assert got.where("query_id = 500").select("query_key").distinct().count() == 3


def test_large_components(spark):
    rows = [(i, [(-1) ** i * (1 << (i % 30)), 200 - i, -(1 << 29)]) for i in range(150)] + [(151, [1 << 40, 0, -1])]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    assert found(topk.search(df, F.col("vec_id") % 100 == 0)) == brute(rows)


def test_nulls_few_and_none(spark):
    rows = [(0, [1, 2]), (1, [3, 4]), (None, [9, 9]), (2, None), (3, [None, 1]), (100, [])]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    got = found(topk.search(df, F.col("vec_id") % 100 == 0))
    assert got == [(0, 1, 1, 11), (0, 2, 100, 0), (100, 1, 0, 0), (100, 2, 1, 0)]
    assert topk.search(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
