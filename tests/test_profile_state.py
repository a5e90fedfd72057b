"""The stored state of a growing table against the profile of the whole."""

import math
import shutil

import pytest
from pyspark.sql import functions as F

from tallywise.operators import profile, quality
from tallywise.operators import profile_state as states

EXACT = ("row_count", "non_null", "null_count", "min", "max")
CLOSE = ("sum", "mean", "std")


@pytest.fixture()
def folders(tmp_path):
    return str(tmp_path / "growing"), str(tmp_path / "state")


def rows(spark, low, high):
    return spark.range(low, high, numPartitions=3).selectExpr(
        "id", "if(id % 10 = 0, null, (id * 7919 % 10007) / 3.0) as v", "concat('name ', id % 500) as s", "if(id % 4 = 0, double('NaN'), 1e9 + id % 3) as w",
        "cast(null as int) as none", "date_add(date'2020-01-01', cast(id % 1000 as int)) as d", "map('k', id % 9) as m",
    )


def by_column(df):
    return {r["column"]: r.asDict() for r in df.collect()}


def test_state_after_appending_is_the_profile_of_the_whole(spark, folders):
    source, state = folders
    for low, high in ((0, 20_000), (20_000, 20_001), (20_001, 60_000)):
        rows(spark, low, high).write.mode("append").parquet(source)
        assert states.update(spark, source, state) >= 1
        assert states.update(spark, source, state) == 0
    grown = by_column(states.merged(spark, source, state))
    again = state + "-again"
    states.update(spark, source, again)
    whole = by_column(states.merged(spark, source, again))
    df = spark.read.parquet(source)
    nulls = {r["column"]: r["null_count"] for r in quality.null_report(df).collect()}
    stats = by_column(profile.column_stats(df, ["id", "v", "w"]))
    assert {c: r["null_count"] for c, r in grown.items()} == nulls
    for c, r in grown.items():
        assert [r[x] for x in EXACT] == [whole[c][x] for x in EXACT]
        assert r["row_count"] == 60_000
        for x in CLOSE:
            assert r[x] == whole[c][x] or math.isclose(r[x], whole[c][x], rel_tol=1e-7)
            if c in stats:
                assert math.isclose(r[x], stats[c][x], rel_tol=1e-7)
    # The sketches keep to their stated error, merged or not.
    counts = {r["column"]: r["unique_count"] for r in profile.column_counts(df).collect()}
    for found in (grown, whole):
        for c, r in found.items():
            assert abs(r["distinct_count"] - counts[c]) <= 4 * 2 ** -(states.LG_K / 2) * counts[c]
        for q, name in ((0.25, "q25"), (0.5, "median"), (0.75, "q75")):
            rank = df.where(F.col("v") <= found["v"][name]).count() / df.where("v is not null").count()
            assert abs(rank - q) <= 0.005
        assert found["none"]["median"] is None and found["s"]["median"] is None


def test_only_new_files_are_read(spark, folders):
    source, state = folders
    rows(spark, 0, 100).write.parquet(source + "/part=1")
    assert states.update(spark, source, state) == 3
    before = by_column(states.merged(spark, source, state))
    rows(spark, 100, 200).coalesce(1).write.parquet(source + "/part=2")
    assert states.update(spark, source, state) == 1
    assert by_column(states.merged(spark, source, state))["id"]["max"] == 199
    # A file that is gone no longer counts; its state may stay.
    shutil.rmtree(source + "/part=2")
    assert states.update(spark, source, state) == 0
    assert by_column(states.merged(spark, source, state)) == before
    plan = states.merged(spark, source, state)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "content" not in plan.split("ReadSchema")[1]


def test_columns_that_come_later_and_empty_files(spark, folders):
    source, state = folders
    spark.createDataFrame([(1,), (None,)], "a int").coalesce(1).write.mode("append").parquet(source)
    states.update(spark, source, state)
    spark.createDataFrame([(5, 2.5)], "a int, b double").coalesce(1).write.mode("append").parquet(source)
    spark.createDataFrame([], "a int, b double").coalesce(1).write.mode("append").parquet(source)
    states.update(spark, source, state)
    found = by_column(states.merged(spark, source, state))
    assert (found["a"]["row_count"], found["a"]["null_count"], found["a"]["sum"]) == (3, 1, 6.0)
    assert (found["b"]["row_count"], found["b"]["null_count"], found["b"]["std"]) == (3, 2, None)
