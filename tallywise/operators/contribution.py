"""Pareto contribution, ABC classes and the vital few."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.coerce import name_of
from .prefix import running_total
from .ranking import group_totals


def pareto(df: DataFrame, dimension: str, measure: str) -> DataFrame:
    """All groups by falling total with running percent and ABC class.

    Columns: position, dimension, measure, total, cum_pct, abc.  Empty when the
    total is not positive.  With negative totals the running percent may pass
    100 and come back; such rows are class C.
    """
    totals = group_totals(df, dimension, measure)
    value = totals.columns[1]
    ordered = running_total(totals, [-name_of(value), name_of(dimension)], value)
    a_limit, b_limit = V.ABC_LIMITS
    return (
        ordered.where(F.col("total") > 0)
        .withColumn("cum_pct", F.col("running") / F.col("total") * 100)
        .withColumn(
            "abc",
            F.when(F.col("cum_pct") <= a_limit, "A")
            .when(F.col("cum_pct") <= b_limit, "B")
            .otherwise("C"),
        )
        .select("position", name_of(dimension), name_of(value), "total", "cum_pct", "abc")
    )


def abc_classes(ranked: DataFrame) -> DataFrame:
    """Groups and value per ABC class of a Pareto frame: (abc, groups, class_value)."""
    value = ranked.columns[2]
    return ranked.groupBy("abc").agg(
        F.count(F.lit(1)).alias("groups"), F.sum(name_of(value)).alias("class_value")
    )


def vital_few(ranked: DataFrame) -> DataFrame:
    """Groups within the first 80 % of the total, and with the one that crosses it."""
    within = F.col("cum_pct") <= V.VITAL_SHARE
    return ranked.agg(
        F.count(F.lit(1)).alias("groups"),
        F.max("total").alias("total"),
        F.count_if(within).alias("top_80pct_count"),
        (F.min(F.when(~within, F.col("position")))).alias("crossing"),
    )
