"""Running totals over a globally ordered frame, without a single-task window."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shuffle_partitions

# Rows looked at for each range to place the cuts, and ranges whose totals are added up together.
SAMPLED = 32
TOGETHER = 256


def cut_points(df: DataFrame, order: list[Column], ranges: int | None = None) -> DataFrame:
    """One row: where to cut ``df`` into ranges of similar size, as sorted runs of cuts, ``cuts``.

    The rows with the least hashes of their order columns are the sample, so the
    same rows always give the same cuts.  Without ``ranges`` there are as many as
    shuffle partitions, which is how a cluster is told the size of its data.
    """
    ranges = ranges or shuffle_partitions(df.sparkSession)
    width = max(1, math.isqrt(ranges))
    keys = df.select(F.struct(*order).alias("_key"))
    sample = keys.orderBy(F.xxhash64("_key"), "_key").limit(ranges * SAMPLED)
    step = F.ceil(F.size("_all") / F.lit(ranges))
    cuts = sample.agg(F.sort_array(F.collect_list("_key")).alias("_all")).select(
        F.filter("_all", lambda k, i: (i > 0) & (i % step == 0)).alias("_cuts")
    )
    runs = F.sequence(F.lit(0), F.floor((F.size("_cuts") - 1) / F.lit(width)).cast("int"))
    runs = F.when(F.size("_cuts") > 0, F.transform(runs, lambda g: F.slice("_cuts", g * width + 1, width)))
    return cuts.select(runs.alias("cuts"))


def with_range(df: DataFrame, order: list[Column], cuts: DataFrame) -> DataFrame:
    """Add ``_range``: how many cuts lie at or before a row.

    First the runs that begin there are counted, then the cuts of the last of them, so the
    work for a row grows with the root of the number of ranges.
    """
    begun = F.coalesce(F.size(F.filter("_cuts", lambda run: F.get(run, F.lit(0)) <= F.col("_key"))), F.lit(0))
    run = F.get("_cuts", F.col("_begun") - 1)
    inside = F.size(F.filter(run, lambda c: c <= F.col("_key")))
    before = (F.col("_begun") - 1) * F.size(F.get("_cuts", F.lit(0)))
    return (
        df.withColumn("_cuts", cuts.scalar())
        .withColumn("_key", F.struct(*order))
        .withColumn("_begun", F.when(F.col("_cuts").isNull(), 0).otherwise(begun))
        .withColumn("_range", F.when(F.col("_begun") == 0, 0).otherwise(before + inside))
        .drop("_cuts", "_key", "_begun")
    )


def _offsets(sums: DataFrame, ranges: int) -> DataFrame:
    """(_range, _sum_before, _rows_before, total) from one row (_range, _sum, _rows) per range.

    Totals of neighbouring ranges are added up first, as often as needed to leave few: no
    window runs over more than ``TOGETHER`` rows, whatever the number of ranges.
    """
    if ranges <= TOGETHER:
        order = Window.orderBy("_range")
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return sums.select(
            "_range",
            F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_sum_before"),
            F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
            F.sum("_sum").over(whole).alias("total"),
        )
    part = F.floor(F.col("_range") / TOGETHER)
    joint = sums.groupBy(part.alias("_range")).agg(F.sum("_sum").alias("_sum"), F.sum("_rows").alias("_rows"))
    above = _offsets(joint, -(-ranges // TOGETHER)).select(
        F.col("_range").alias("_part"), F.col("_sum_before").alias("_sum_above"), F.col("_rows_before").alias("_rows_above"), "total"
    )
    before = Window.partitionBy("_part").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return (
        sums.withColumn("_part", part)
        .select(
            "_range",
            "_part",
            F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_sum_in"),
            F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_in"),
        )
        .join(F.broadcast(above), "_part")
        .select(
            "_range",
            (F.col("_sum_in") + F.col("_sum_above")).alias("_sum_before"),
            (F.col("_rows_in") + F.col("_rows_above")).alias("_rows_before"),
            "total",
        )
    )


def running_total(df: DataFrame, order: list[Column], value: str, ranges: int | None = None) -> DataFrame:
    """Add ``running`` (inclusive prefix sum), ``total`` and ``position`` (1-based).

    ``order`` are ascending expressions and must be a total order.  Rows are cut
    into ranges of the whole order, so a value shared by many rows is still split
    by the later order columns; each range is summed on its own and shifted by
    the totals of the ranges before it.
    """
    # Both readers share this exchange.
    ranged = with_range(df, order, cut_points(df, order, ranges)).repartition("_range")
    # One row per range, whatever the data.
    sums = ranged.groupBy("_range").agg(F.sum(value).alias("_sum"), F.count(F.lit(1)).alias("_rows"))
    offsets = _offsets(sums, ranges or shuffle_partitions(df.sparkSession))
    within = Window.partitionBy("_range").orderBy(*order)
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        ranged.withColumn("_running", F.sum(value).over(upto))
        .withColumn("_position", F.row_number().over(within))
        .join(F.broadcast(offsets), "_range")
        .select(
            *df.columns,
            (F.coalesce("_running", F.lit(0)) + F.col("_sum_before")).alias("running"),
            "total",
            (F.col("_position") + F.col("_rows_before")).cast("bigint").alias("position"),
        )
    )
