"""Header cleaning, empty rows, date parsing: what happens once, on entry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.coerce import date_readings, is_text, name_of, nan_to_null, number, text_to_timestamp


def clean_headers(df: DataFrame) -> DataFrame:
    """Strip blanks around column names; two names that become equal are an error."""
    names = [c.strip() for c in df.columns]
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        raise ValueError(f"duplicate column names after stripping: {', '.join(repeated)}")
    return df.toDF(*names)


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Drop rows in which every column is null (or NaN)."""
    return df.na.drop("all")


def date_formats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """How the dates of each text column are written: one row per column.

    (ordinal, column, non_null, month_first, day_first, format, share): how many values are
    dates if 3/4/2024 is read month first, and if day first; the reading that fits more
    values is the column's, month first where both fit as many, and ``share`` is its part of
    the non-null values (null without any).  One aggregation over all columns; only dates
    told apart by place alone are parsed twice.
    """
    texts = [
        (i, field.name)
        for i, field in enumerate(df.schema.fields)
        if is_text(field.dataType) and (columns is None or field.name in columns)
    ]
    if not texts:
        return df.sparkSession.createDataFrame([], DATE_FORMATS)
    # Both flags come from one reading.
    read = df.select(
        *[F.when(name_of(c).isNotNull(), date_readings(name_of(c))).alias(f"_{i}") for i, c in texts]
    )
    counts = read.agg(
        F.array(
            *[
                F.struct(
                    F.lit(i).alias("ordinal"),
                    F.lit(c).alias("column"),
                    F.count(f"_{i}").alias("non_null"),
                    F.count_if(F.col(f"_{i}.month_first")).alias("month_first"),
                    F.count_if(F.col(f"_{i}.day_first")).alias("day_first"),
                )
                for i, c in texts
            ]
        ).alias("counts")
    )
    return counts.select(F.inline("counts")).select(
        "ordinal",
        "column",
        "non_null",
        "month_first",
        "day_first",
        F.when(F.col("day_first") > F.col("month_first"), "day first").otherwise("month first").alias("format"),
        F.try_divide(F.greatest("month_first", "day_first"), F.col("non_null")).alias("share"),
    )


DATE_FORMATS = (
    "ordinal int, column string, non_null bigint, month_first bigint, day_first bigint, format string, share double"
)


def date_orders(df: DataFrame, columns: list[str] | None = None, share: float = V.DATE_PARSE_SHARE) -> dict[str, bool]:
    """Text columns of which at least ``share`` of the non-null values are dates, and whether day first.

    One row per text column comes back.
    """
    found = date_formats(df, columns).where(F.col("share") >= share).collect()
    return {r["column"]: r["format"] == "day first" for r in sorted(found, key=lambda r: r["ordinal"])}


def date_text_columns(df: DataFrame, share: float = V.DATE_PARSE_SHARE) -> list[str]:
    """Text columns of which at least ``share`` of the non-null values are dates."""
    return list(date_orders(df, share=share))


def parse_dates(
    df: DataFrame, columns: list[str] | None = None, share: float = V.DATE_PARSE_SHARE
) -> DataFrame:
    """Turn text columns that mostly hold dates into timestamps; the rest of them is null.

    Each column is read day first or month first throughout, whichever fits more of its
    values.  Named ``columns`` are all turned, whatever their share.
    """
    if columns is None:
        chosen = date_orders(df, share=share)
    else:
        chosen = dict.fromkeys(columns, False) | date_orders(df, columns, 0.0)
    if not chosen:
        return df
    return df.select(
        *[
            text_to_timestamp(name_of(c), chosen[c]).alias(c) if c in chosen else name_of(c)
            for c in df.columns
        ]
    )


def coerce_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Replace the named columns by doubles, null where the text is not a number."""
    chosen = set(columns)
    return df.select(
        *[number(df, c).alias(c) if c in chosen else name_of(c) for c in df.columns]
    )


def clean(df: DataFrame) -> DataFrame:
    """The whole entry step: headers, NaN, empty rows, dates held as text."""
    return parse_dates(drop_empty_rows(nan_to_null(clean_headers(df))))
