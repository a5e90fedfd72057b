"""Calendar periods: labels, steps and gap filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Frequency code -> truncation unit, step.
FREQUENCIES = {
    "D": ("day", "INTERVAL 1 DAY"),
    "W": ("week", "INTERVAL 7 DAYS"),
    "MS": ("month", "INTERVAL 1 MONTH"),
    "QS": ("quarter", "INTERVAL 3 MONTHS"),
    "YS": ("year", "INTERVAL 12 MONTHS"),
}


def step(freq: str) -> str:
    return FREQUENCIES[freq][1]


def period(ts: Column, freq: str) -> Column:
    """Label of the period ``ts`` falls in: its first day, for weeks the closing Sunday."""
    unit = FREQUENCIES[freq][0]
    day = ts.cast("date")
    if unit == "day":
        return day
    if unit == "week":
        return F.date_add(F.trunc(day, "week"), 6)
    return F.trunc(day, unit)


def add_periods(label: Column, count: Column | int, freq: str) -> Column:
    """``label`` moved by ``count`` periods."""
    count = F.lit(count) if isinstance(count, int) else count
    months = {"MS": 1, "QS": 3, "YS": 12}.get(freq)
    if months:
        return F.add_months(label, (count * months).cast("int"))
    return F.date_add(label, (count * (7 if freq == "W" else 1)).cast("int"))


def fill_gaps(
    bins: DataFrame, label: str, values: list[str], freq: str, keys: list[str] = ()
) -> DataFrame:
    """Add the missing periods between two present ones, with zero values.

    Each row looks at the next label and emits the periods up to it, so no
    second scan and no join with a calendar is needed.  ``bins`` holds at most
    one row per period (and key), which bounds the window by the calendar.
    """
    order = Window.partitionBy(*keys).orderBy(label)
    upto = F.coalesce(add_periods(F.lead(label).over(order), -1, freq), F.col(label))
    spread = bins.withColumn("_upto", upto).select(
        *keys,
        F.posexplode(F.sequence(F.col(label), F.col("_upto"), F.expr(step(freq)))).alias(
            "_gap", "_label"
        ),
        *values,
    )
    return spread.select(
        *keys,
        F.col("_label").alias(label),
        *[
            F.when(F.col("_gap") == 0, F.col(v)).otherwise(F.lit(0).cast(bins.schema[v].dataType)).alias(v)
            for v in values
        ],
    )
