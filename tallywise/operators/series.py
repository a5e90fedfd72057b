"""Calendar series: gap-free totals, trend, steps and changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.calendar import fill_gaps, period
from ..functions.coerce import moment, name_of, number


def resample_sum(
    df: DataFrame,
    date_col: str,
    measure: str,
    freq: str = "MS",
    keys: list[str] = (),
    keep_null_measure: bool = False,
) -> DataFrame:
    """Total per calendar period and key, empty periods as 0: (keys..., x, y).

    ``keep_null_measure`` lets rows without a value still stretch the calendar.
    """
    rows = df.select(
        *[name_of(k).alias(k) for k in keys],
        period(moment(df, date_col), freq).alias("x"),
        number(df, measure).alias("y"),
    ).where(F.col("x").isNotNull())
    if not keep_null_measure:
        rows = rows.where(F.col("y").isNotNull())
    totals = rows.groupBy(*keys, "x").agg(F.coalesce(F.sum("y"), F.lit(0.0)).alias("y"))
    return fill_gaps(totals, "x", ["y"], freq, list(keys))


def trend(
    df: DataFrame,
    date_col: str,
    measure: str,
    freq: str = "MS",
    periods: int = V.MOVING_PERIODS,
) -> DataFrame:
    """Series with a trailing mean over the last ``periods`` periods: (x, y, moving_avg)."""
    series = resample_sum(df, date_col, measure, freq)
    # One row per calendar period: the unpartitioned window is bounded by time.
    trailing = Window.orderBy("x").rowsBetween(-(periods - 1), Window.currentRow)
    return series.withColumn("moving_avg", F.avg("y").over(trailing))


def mean_step(series: DataFrame) -> DataFrame:
    """Mean difference between neighbouring periods: (steps, mean_step)."""
    before = F.lag("y").over(Window.orderBy("x"))
    return series.select((F.col("y") - before).alias("d")).agg(
        F.count("d").alias("steps"), F.coalesce(F.avg("d"), F.lit(0.0)).alias("mean_step")
    )


def series_change(series: DataFrame) -> DataFrame:
    """Change from the first to the last point, percent; null when either is 0."""
    ends = series.agg(
        F.min("x").alias("first_x"),
        F.max("x").alias("last_x"),
        F.min_by("y", "x").alias("first_y"),
        F.max_by("y", "x").alias("last_y"),
    )
    defined = (F.col("first_y") != 0) & (F.col("last_y") != 0)
    change = (F.col("last_y") - F.col("first_y")) / F.abs("first_y") * 100
    return ends.withColumn("change_pct", F.when(defined, change))


def yoy_compare(df: DataFrame, date_col: str, measure: str) -> DataFrame:
    """Each month against the same month a year before: (x, y, y_prior, delta, change_pct)."""
    series = resample_sum(df, date_col, measure, "MS")
    prior = F.lag("y", 12).over(Window.orderBy("x"))
    with_prior = series.withColumn("y_prior", prior)
    delta = F.col("y") - F.col("y_prior")
    return with_prior.select(
        "x",
        "y",
        "y_prior",
        delta.alias("delta"),
        F.when(F.col("y_prior") != 0, delta / F.abs("y_prior") * 100).alias("change_pct"),
    )
