"""KPI cards: totals, change against the month before, sparkline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.calendar import fill_gaps, period
from ..functions.coerce import moment, number


def _by_month(df: DataFrame, measures: list[str], date_col: str | None) -> DataFrame:
    """Sums and counts of all measures per month in one scan; null month = no date."""
    month = period(moment(df, date_col), "MS") if date_col else F.lit(None).cast("date")
    rows = df.select(
        month.alias("x"), *[number(df, m).alias(f"m{i}") for i, m in enumerate(measures)]
    )
    span = range(len(measures))
    return rows.groupBy("x").agg(
        *[F.coalesce(F.sum(f"m{i}"), F.lit(0.0)).alias(f"s{i}") for i in span],
        *[F.count(f"m{i}").alias(f"c{i}") for i in span],
    )


def _per_measure(df: DataFrame, measures: list[str], keep: list[str], fields: dict) -> DataFrame:
    """Turn the s0, c0, s1, c1 ... columns into one row per measure."""
    return df.select(
        *keep,
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("ordinal"),
                        F.lit(m).alias("name"),
                        *[F.col(f"{prefix}{i}").alias(out) for prefix, out in fields.items()],
                    )
                    for i, m in enumerate(measures)
                ]
            )
        ),
    )


def kpi_totals(
    df: DataFrame, measures: list[str], limit: int | None = None, monthly: DataFrame | None = None
) -> DataFrame:
    """Sum, mean and non-null count per measure; measures without values are left out.

    Here and below all measures count unless ``limit`` cuts their list, and ``monthly`` holds
    the sums and counts of all months (``Cube.monthly``), if they are at hand.
    """
    measures = measures[:limit]
    if monthly is None:
        whole = _by_month(df, measures, None)
    else:
        whole = monthly.agg(*[F.sum(f"{p}{i}").alias(f"{p}{i}") for i in range(len(measures)) for p in "sc"])
    long = _per_measure(whole, measures, [], {"s": "total", "c": "count"})
    return long.where(F.col("count") > 0).select(
        "ordinal",
        "name",
        F.round("total", 2).alias("value"),
        F.round(F.col("total") / F.col("count"), 2).alias("avg"),
        "count",
    )


def kpi_series(
    df: DataFrame,
    measures: list[str],
    date_col: str,
    limit: int | None = None,
    monthly: DataFrame | None = None,
) -> DataFrame:
    """Gap-free monthly sums per measure: (ordinal, name, x, y).

    The calendar spans all dated rows, also those without a value.
    """
    measures = measures[:limit]
    by_month = _by_month(df, measures, date_col) if monthly is None else monthly
    dated = by_month.where(F.col("x").isNotNull())
    sums = [f"s{i}" for i in range(len(measures))]
    filled = fill_gaps(dated.select("x", *sums), "x", sums, "MS")
    return _per_measure(filled, measures, ["x"], {"s": "y"})


def _latest(series: DataFrame, count: int) -> DataFrame:
    newest = Window.partitionBy("ordinal", "name").orderBy(F.col("x").desc())
    return series.withColumn("back", F.row_number().over(newest)).where(F.col("back") <= count)


def _change(last_two: DataFrame) -> DataFrame:
    current = F.max(F.when(F.col("back") == 1, F.col("y")))
    previous = F.max(F.when(F.col("back") == 2, F.col("y")))
    change = (F.col("current") - F.col("previous")) / F.abs("previous") * 100
    return (
        last_two.groupBy("ordinal", "name")
        .agg(current.alias("current"), previous.alias("previous"))
        .withColumn("change", F.when(F.col("previous") != 0, change))
        .select(
            "ordinal",
            "name",
            "current",
            "previous",
            F.round("change", 2).alias("change_pct"),
            F.when(F.col("change") > V.KPI_TREND_PCT, "up")
            .when(F.col("change") < -V.KPI_TREND_PCT, "down")
            .otherwise("stable")
            .alias("trend"),
        )
    )


def kpi_change(
    df: DataFrame,
    measures: list[str],
    date_col: str,
    limit: int | None = None,
    complete_only: bool = False,
    monthly: DataFrame | None = None,
) -> DataFrame:
    """Last calendar month against the one before.

    ``complete_only`` leaves out the newest month, which may be a partial one.
    """
    series = kpi_series(df, measures, date_col, limit, monthly)
    if complete_only:
        newest = F.max("x").over(Window.partitionBy("ordinal"))
        series = series.withColumn("_newest", newest).where("x < _newest").drop("_newest")
    return _change(_latest(series, 2))


def kpi_sparkline(
    df: DataFrame, measures: list[str], date_col: str, limit: int | None = None
) -> DataFrame:
    """The last twelve monthly sums per measure."""
    series = kpi_series(df, measures, date_col, limit)
    return _latest(series, V.SPARKLINE_PERIODS).select("ordinal", "name", "x", "y")


def kpi_summary(
    df: DataFrame,
    measures: list[str],
    date_col: str | None = None,
    limit: int | None = None,
    monthly: DataFrame | None = None,
) -> DataFrame:
    """One row per measure: value, avg, count, change_pct, trend, sparkline."""
    measures = measures[:limit]
    totals = kpi_totals(df, measures, limit, monthly)
    if date_col is None:
        return totals.select(
            "*",
            F.lit(None).cast("double").alias("change_pct"),
            F.lit("stable").alias("trend"),
            F.array().cast("array<struct<x:date,y:double>>").alias("sparkline"),
        )
    recent = _latest(kpi_series(df, measures, date_col, limit, monthly), V.SPARKLINE_PERIODS)
    lines = recent.groupBy("ordinal").agg(
        F.array_sort(F.collect_list(F.struct("x", "y"))).alias("sparkline")
    )
    change = _change(recent.where(F.col("back") <= 2)).select("ordinal", "change_pct", "trend")
    # All three frames have at most one row per measure.
    return (
        totals.join(F.broadcast(change), "ordinal", "left")
        .join(F.broadcast(lines), "ordinal", "left")
        .withColumn("trend", F.coalesce("trend", F.lit("stable")))
        .withColumn(
            "sparkline",
            F.coalesce("sparkline", F.array().cast("array<struct<x:date,y:double>>")),
        )
    )
