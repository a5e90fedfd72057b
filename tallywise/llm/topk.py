"""Exact top-k search by inner product with a pivot table.

Every vector's distances to a fixed set of pivots are computed once.  For a query the
triangle inequality bounds each candidate's distance from below, by the largest difference
to any pivot, and so its inner product from above, since 2<q, x> = |q|^2 + |x|^2 - |q - x|^2.
Candidates are evaluated in the order of their bounds until the next bound is below the
k-th best score: what is left cannot enter.  Queries and candidates meet in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small_batches, stored

PIVOTS = 32
SAMPLE = 1024  # vectors that pivots are chosen from
# Rows of a tile, queries by candidates: each row of one side goes to every block of the other.
QUERIES = 4096
CANDIDATES = 8192
MET = "query_id long, query_key long, rows long, vec_id long, score long, copies long"
STEP = 128  # candidates evaluated before the next look at the bound


def choose_pivots(vectors: np.ndarray, many: int = PIVOTS) -> np.ndarray:
    """Pivots far from one another, each the farthest from those before."""
    if not len(vectors):
        return vectors
    x = vectors.astype(float)
    chosen = [0]
    near = ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < min(many, len(x)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return vectors[chosen]


def _padded(rows, width: int, kind=np.int64) -> np.ndarray:
    out = np.zeros((len(rows), width), kind)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def _distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    x, p = vectors.astype(float), pivots.astype(float)
    return np.sqrt(np.maximum(((x[:, None] - p[None]) ** 2).sum(axis=2), 0)) if len(x) * len(p) < 1 << 18 else np.vstack(
        [_distances(x[i : i + 2048], p) for i in range(0, len(x), 2048)]
    )


def best_of_block(query: np.ndarray, query_far: np.ndarray, ids: np.ndarray, vectors: np.ndarray, far: np.ndarray, norms: np.ndarray, copies: np.ndarray, k: int):
    """Places of a block's candidates that can be among the k best, and their scores; exact.

    A candidate of no copies takes no part.
    """
    apart = np.abs(far - query_far).max(axis=1) if far.shape[1] else np.zeros(len(ids))
    size = float((query.astype(float) ** 2).sum())
    bound = (size + norms - apart**2) / 2
    bound = bound + 1e-9 * (size + norms) + 1  # for rounding
    order = np.argsort(-bound, kind="stable")
    order = order[copies[order] > 0]
    places, scores, worst = np.empty(0, np.int64), np.empty(0, np.int64), None
    for at in range(0, len(order), STEP):
        if worst is not None and bound[order[at]] < worst:
            break
        part = order[at : at + STEP]
        places = np.append(places, part)
        scores = np.append(scores, vectors[part] @ query)
        top = np.lexsort((ids[places], -scores))
        # Repeated rows take as many of the k places.
        enough = int(np.searchsorted(np.cumsum(copies[places[top]]), k)) + 1
        if enough <= len(top):
            worst = scores[top[enough - 1]]
        places, scores = places[top[:enough]], scores[top[:enough]]
    return places, scores


def search(rows: DataFrame, is_query, k: int = 10) -> DataFrame:
    """The ``k`` highest inner products of each query: query_id, rank (from 1), vec_id, score, query_key.

    ``rows`` has vec_id and vector (array<long>); ``is_query`` is a condition on its columns.
    Every row that ``is_query`` holds for is a query, and all rows but itself are its candidates,
    all of them if fewer than ``k``; ties go to the smaller vec_id.  Rows that share an id are
    queries of their own, each the others' candidate: ``query_key``, a hash of id and vector,
    tells their results apart, and equal rows give equal results, once each.  Null ids and
    vectors, and vectors holding a null, take no part; shorter vectors count as filled up with
    zeros; repeated rows count as often as they stand there; scores must fit 64 bits.  Extra
    columns are ignored; an empty table gives an empty one.
    """
    spark = rows.sparkSession
    small_batches(spark)
    valid = F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull())
    known = rows.where(valid).withColumn("asked", is_query).groupBy("vec_id", "vector", "asked").agg(F.count("*").alias("copies"))
    facts = known.agg(
        F.count("*").alias("n"), F.sum(F.col("asked").cast("long")).alias("q"), F.max(F.size("vector")).alias("width"),
        F.min(F.array_min("vector")).alias("low"), F.max(F.array_max("vector")).alias("high"),
    ).first()
    width, key = facts.width or 0, F.xxhash64("vec_id", "vector")
    # The narrowest signed integers that hold every component.
    kind = np.min_scalar_type(min(facts.low or 0, -(facts.high or 0) - 1, -1))
    sample = known.select("vector", key.alias("key")).orderBy("key").limit(SAMPLE).collect()
    pivots = choose_pivots(_padded([r.vector for r in sample], width))
    many_queries, many_candidates = -(-(facts.q or 0) // QUERIES) or 1, -(-facts.n // CANDIDATES) or 1

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = _padded(batch["vector"].tolist(), width)
            far = _distances(vectors, pivots) if len(pivots) else np.zeros((len(vectors), 0))
            yield pd.DataFrame(
                {
                    "vec_id": batch["vec_id"], "asked": batch["asked"], "copies": batch["copies"],
                    "packed": [v.tobytes() for v in vectors.astype(kind)], "far": [f.tobytes() for f in far], "key": batch["key"],
                }
            )

    table = known.withColumn("key", key).mapInPandas(
        pack, "vec_id long, asked boolean, copies long, packed binary, far binary, key long"
    )
    table = stored(table, "pivot-table")
    queries = table.where("asked").select("vec_id", "key", "copies", "packed", "far")
    queries = queries.withColumn("q", F.pmod(F.xxhash64("key"), F.lit(many_queries))).withColumn(
        "c", F.explode(F.sequence(F.lit(0), F.lit(many_candidates - 1)))
    )
    candidates = table.withColumn("c", F.pmod("key", F.lit(many_candidates)).cast("int")).withColumn(
        "q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many_queries - 1).cast("long")))
    )
    count = len(pivots)

    def meet(one: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        ids, keys, copies = (other[c].to_numpy() for c in ("vec_id", "key", "copies"))
        vectors = np.frombuffer(b"".join(other["packed"]), kind).reshape(len(other), width).astype(np.int64)
        far = np.frombuffer(b"".join(other["far"])).reshape(len(other), count)
        norms = (vectors.astype(float) ** 2).sum(axis=1)
        out = []
        for query in one.itertuples(index=False):
            others = copies - ((ids == query.vec_id) & (keys == query.key))
            places, scores = best_of_block(
                np.frombuffer(query.packed, kind).astype(np.int64), np.frombuffer(query.far), ids, vectors, far, norms, others, k
            )
            found = {"query_id": query.vec_id, "query_key": query.key, "rows": query.copies, "vec_id": ids[places], "score": scores}
            out.append(pd.DataFrame(found | {"copies": others[places]}))
        return pd.concat(out) if out else pd.DataFrame(columns=MET.replace(" long", "").split(", "))

    met = queries.groupBy("q", "c").cogroup(candidates.groupBy("q", "c")).applyInPandas(
        meet, MET
    )
    best = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    top = met.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
    each = top.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least("copies", F.lit(k).cast("long")))))
    return (
        each.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
        .select("query_id", "rank", "vec_id", "score", "query_key")
    )
