"""Ranked groups: top, bottom, n-th, share of the leaders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.coerce import is_numeric, name_of, number
from ..functions.sums import steady_sum
from .prefix import running_total


def group_totals(df: DataFrame, dimension: str, measure: str) -> DataFrame:
    """Sum per group; rows without a group or a value are dropped.

    Groups of equal total are ties in every ranking, so a total must not depend on how the
    rows were split over tasks.
    """
    key = name_of(dimension)
    if is_numeric(df.schema[dimension].dataType):
        key = F.when(~F.isnan(key.cast("double")), key)
    value = "_value" if dimension == measure else measure
    return (
        df.select(key.alias(dimension), number(df, measure).alias(value))
        .na.drop()
        .groupBy(name_of(dimension))
        .agg(steady_sum(name_of(value)).alias(value))
    )


def _order(totals: DataFrame, ascending: bool) -> list:
    dimension, value = totals.columns
    by_value = name_of(value).asc() if ascending else name_of(value).desc()
    return [by_value, name_of(dimension).asc()]


def top_n(
    df: DataFrame,
    dimension: str,
    measure: str,
    n: int = V.DEFAULT_TOP_N,
    ascending: bool = False,
) -> DataFrame:
    """The first ``n`` groups by summed measure, ties by group name."""
    totals = group_totals(df, dimension, measure)
    return totals.orderBy(*_order(totals, ascending)).limit(n)


def bottom_n(df: DataFrame, dimension: str, measure: str, n: int = V.DEFAULT_TOP_N) -> DataFrame:
    """The last ``n`` groups by summed measure, smallest first."""
    return top_n(df, dimension, measure, n, ascending=True)


def nth_ranked(
    df: DataFrame, dimension: str, measure: str, n: int, ascending: bool = False
) -> DataFrame:
    """The group at 1-based rank ``n``; empty when there are fewer groups.

    Ranks are counted over ranges of the order: a deep rank gathers no more rows
    in one task than a high one.
    """
    totals = group_totals(df, dimension, measure)
    value = name_of(totals.columns[1])
    order = [value if ascending else -value, name_of(totals.columns[0])]
    placed = running_total(totals, order, totals.columns[1])
    return placed.where(F.col("position") == n).select("position", *map(name_of, totals.columns))


def rank_availability(df: DataFrame, dimension: str, measure: str, n: int) -> DataFrame:
    """How many ranks exist, and whether rank ``n`` is one of them."""
    return (
        group_totals(df, dimension, measure)
        .agg(F.count(F.lit(1)).alias("available"))
        .select(
            F.lit(n).cast("bigint").alias("requested"),
            "available",
            ((F.lit(n) >= 1) & (F.lit(n) <= F.col("available"))).alias("found"),
        )
    )


def top3_share(
    df: DataFrame,
    dimension: str,
    measure: str,
    n: int = V.DEFAULT_TOP_N,
    ascending: bool = False,
) -> DataFrame:
    """Leader and the share of the first three within the ``n`` shown rows, percent."""
    return shown_share(top_n(df, dimension, measure, n, ascending), ascending)


def shown_share(shown: DataFrame, ascending: bool = False) -> DataFrame:
    """The same for rows already ranked (at most the ``n`` of a top-n)."""
    dimension, value = shown.columns
    place = F.row_number().over(Window.orderBy(*_order(shown, ascending)))
    ranked = shown.withColumn("_place", place)
    total = F.sum(name_of(value))
    first_three = F.sum(F.when(F.col("_place") <= 3, name_of(value)))
    return ranked.agg(
        F.max(F.when(F.col("_place") == 1, name_of(dimension).cast("string"))).alias("leader"),
        F.max(F.when(F.col("_place") == 1, name_of(value))).alias("leader_value"),
        F.when(
            F.count(F.lit(1)) >= 3,
            first_three / F.when(total == 0, F.lit(1.0)).otherwise(total) * 100,
        ).alias("top3_share"),
        F.count(F.lit(1)).alias("shown"),
    )
