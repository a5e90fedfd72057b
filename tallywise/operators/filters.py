"""Row filters, value look-up and slicer contents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.coerce import is_temporal, moment, name_of


def year_equals(df: DataFrame, column: str, year: int) -> Column:
    """Rows of one calendar year, as a range that file statistics can answer."""
    if not is_temporal(df.schema[column].dataType):
        return F.year(moment(df, column)) == int(year)
    kind = df.schema[column].dataType.simpleString()
    start, end = (F.lit(f"{y:04d}-01-01").cast(kind) for y in (int(year), int(year) + 1))
    return (name_of(column) >= start) & (name_of(column) < end)


def text_equals(column: str, value) -> Column:
    """Equal as text, whatever the case; never true for null."""
    return F.lower(name_of(column).cast("string")) == str(value).lower()


def text_differs(column: str, value) -> Column:
    """Not equal as text, whatever the case; null rows stay."""
    return ~F.lower(name_of(column).cast("string")).eqNullSafe(F.lit(str(value).lower()))


def text_contains(column: str, value, literal: bool = False) -> Column:
    """Holds a pattern, whatever the case; ``literal`` turns pattern signs off."""
    text = name_of(column).cast("string")
    if literal:
        return F.contains(F.lower(text), F.lit(str(value).lower()))
    return text.rlike("(?i)" + str(value))


def predicate(df: DataFrame, column: str, op: str, value=None) -> Column | None:
    """The condition of one filter record; None for one that does not filter."""
    if column not in df.columns:
        return None
    if op == "year_eq":
        try:
            return year_equals(df, column, int(value))
        except (TypeError, ValueError):
            return None
    if op == "eq":
        return text_equals(column, value)
    if op == "neq":
        return text_differs(column, value)
    return None


def apply_filters(df: DataFrame, filters: list[dict]) -> DataFrame:
    """All filter records at once; unknown columns and operators are skipped."""
    conditions = [predicate(df, f["column"], f.get("op"), f.get("value")) for f in filters]
    conditions = [c for c in conditions if c is not None]
    return df.where(reduce(lambda a, b: a & b, conditions)) if conditions else df


def merge_filters(active: list[dict], new: list[dict]) -> list[dict]:
    """New records replace the active ones on the same columns."""
    replaced = {f["column"] for f in new}
    return [f for f in active if f["column"] not in replaced] + list(new)


def filter_contains(df: DataFrame, texts: dict[str, str], literal: bool = False) -> DataFrame:
    """Rows that hold every text in its column; unknown columns are skipped."""
    conditions = [text_contains(c, t, literal) for c, t in texts.items() if c in df.columns]
    return df.where(reduce(lambda a, b: a & b, conditions)) if conditions else df


def _values(df: DataFrame, columns: list[str]) -> DataFrame:
    """Long form of some columns as text: (ordinal, column, value)."""
    return df.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("ordinal"),
                        F.lit(c).alias("column"),
                        name_of(c).cast("string").alias("value"),
                    )
                    for i, c in enumerate(columns)
                ]
            )
        )
    ).where(F.col("value").isNotNull())


def literal_lookup(df: DataFrame, dimensions: list[str], literals: DataFrame) -> DataFrame:
    """The first dimension that holds each literal, whatever the case: (literal, column).

    Values that no literal asks for are dropped before they are grouped.
    """
    asked = literals.select("literal").distinct().withColumn("folded", F.lower("literal"))
    held = (
        _values(df, dimensions)
        .withColumn("folded", F.lower("value"))
        .join(asked.select("folded").distinct(), "folded", "left_semi")
        .groupBy("folded")
        .agg(F.min(F.struct("ordinal", "column")).alias("place"))
    )
    return asked.join(held, "folded").select("literal", F.col("place.column").alias("column"))


def slicer_values(
    df: DataFrame,
    dimensions: list[str],
    max_columns: int | None = None,
    max_values: int = V.SLICER_VALUES,
) -> DataFrame:
    """Choices offered per dimension, the most frequent first: (ordinal, column, place, value, rows).

    A report of the ``max_values`` most frequent values of every column; only a
    display limits the columns.
    """
    counted = (
        _values(df, dimensions[:max_columns])
        .groupBy("ordinal", "column", "value")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    return most_frequent(counted, max_values)


def most_frequent(counted: DataFrame, max_values: int = V.SLICER_VALUES) -> DataFrame:
    """The choices among counted values (ordinal, column, value, rows)."""
    place = F.row_number().over(
        Window.partitionBy("ordinal", "column").orderBy(F.col("rows").desc(), "value")
    )
    return counted.select("ordinal", "column", place.alias("place"), "value", "rows").where(
        F.col("place") <= max_values
    )


def slicer_dates(df: DataFrame, date_col: str) -> DataFrame:
    """First and last day of a date column; no row when it holds no date."""
    day = moment(df, date_col).cast("date")
    return (
        df.agg(F.min(day).alias("min"), F.max(day).alias("max"))
        .where(F.col("min").isNotNull())
        .select(F.lit(date_col).alias("column"), "min", "max")
    )
