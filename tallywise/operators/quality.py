"""Nulls, duplicates, outliers and the quality score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.coerce import name_of, nan_to_null, number
from .profile import column_quantiles

# Up to this many columns, rows are grouped as they are.
DIRECT_COLUMNS = 4


def null_report(df: DataFrame) -> DataFrame:
    """Null count and percent per column: (ordinal, column, total_rows, null_count, null_pct)."""
    df = nan_to_null(df)
    counts = df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        *[F.count(name_of(c)).alias(f"n{i}") for i, c in enumerate(df.columns)],
    )
    long = counts.select(
        "total_rows",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("ordinal"),
                        F.lit(c).alias("column"),
                        (F.col("total_rows") - F.col(f"n{i}")).alias("null_count"),
                    )
                    for i, c in enumerate(df.columns)
                ]
            )
        ),
    )
    share = F.try_divide(F.col("null_count"), F.col("total_rows")) * 100
    return long.select(
        "ordinal",
        "column",
        "total_rows",
        "null_count",
        F.coalesce(F.round(share, 2), F.lit(0.0)).alias("null_pct"),
    )


def duplicate_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Copies after the first, nulls equal: (total_rows, duplicate_rows).

    Wide rows are first compared by a 64-bit hash.  Only rows whose hash occurs
    more than once are then grouped on all columns, so unique rows are shuffled
    as eight bytes and equal hashes of different rows do not count.
    """
    names = columns or df.columns
    rows = nan_to_null(df.select(*[name_of(c) for c in names]))
    total = rows.agg(F.count(F.lit(1)).alias("total_rows"))
    if len(names) > DIRECT_COLUMNS:
        hashed = rows.withColumn("_h", F.xxhash64(*[name_of(c) for c in names]))
        repeated = hashed.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
        rows = hashed.join(repeated.select("_h"), "_h", "left_semi")
        names = ["_h", *names]
    copies = (
        rows.groupBy(*[name_of(c) for c in names])
        .agg(F.count(F.lit(1)).alias("_n"))
        .agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"))
    )
    return total.select("total_rows", copies.scalar().alias("duplicate_rows"))


def iqr_outliers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Tukey fences and the rows outside them: (ordinal, column, non_null, lower, upper, outliers).

    Fewer than four values give no fences and no outliers.
    """
    spread = F.col("quantiles")[1] - F.col("quantiles")[0]
    enough = F.col("n") >= 4
    fences = column_quantiles(df, columns, [0.25, 0.75]).select(
        "ordinal",
        "n",
        F.when(enough, F.col("quantiles")[0] - V.TUKEY_FACTOR * spread).alias("lower"),
        F.when(enough, F.col("quantiles")[1] + V.TUKEY_FACTOR * spread).alias("upper"),
    )
    # One row per column: a single map value for the whole second scan.
    by_column = fences.agg(
        F.map_from_entries(
            F.collect_list(F.struct("ordinal", F.struct("n", "lower", "upper")))
        ).alias("m")
    ).scalar()
    values = df.select(*[number(df, c).alias(f"v{i}") for i, c in enumerate(columns)])
    counted = values.withColumn("_m", by_column).agg(
        F.first("_m").alias("_m"),
        *[
            F.count_if(
                (F.col(f"v{i}") < F.col("_m")[i]["lower"]) | (F.col(f"v{i}") > F.col("_m")[i]["upper"])
            ).alias(f"o{i}")
            for i in range(len(columns))
        ],
    )
    return counted.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("ordinal"),
                        F.lit(c).alias("column"),
                        F.coalesce(F.col("_m")[i]["n"], F.lit(0)).alias("non_null"),
                        F.col("_m")[i]["lower"].alias("lower"),
                        F.col("_m")[i]["upper"].alias("upper"),
                        F.col(f"o{i}").alias("outliers"),
                    )
                    for i, c in enumerate(columns)
                ]
            )
        )
    )


def quality_score(df: DataFrame) -> DataFrame:
    """Score from 100 down, by null cells and duplicate rows: one row.

    Pass the table with its calendar columns to weigh those too.
    """
    nulls = null_report(df).agg(
        F.max("total_rows").alias("total_rows"),
        F.count(F.lit(1)).alias("total_columns"),
        F.sum("null_count").alias("null_cells"),
    )
    duplicates = duplicate_rows(df).select("duplicate_rows").scalar()
    null_share = F.try_divide(
        F.col("null_cells"), F.col("total_rows") * F.greatest("total_columns", F.lit(1))
    )
    duplicate_share = F.try_divide(F.col("duplicate_rows"), F.col("total_rows"))
    score = F.round(
        100.0 - null_share * V.NULL_WEIGHT - duplicate_share * V.DUPLICATE_WEIGHT, 1
    )
    return nulls.withColumn("duplicate_rows", duplicates).select(
        "total_rows",
        "total_columns",
        "null_cells",
        "duplicate_rows",
        F.greatest(F.lit(0.0), F.coalesce(score, F.lit(100.0))).alias("quality_score"),
    )


def quality_issues(df: DataFrame, measures: list[str]) -> DataFrame:
    """What stands out: (rank, kind, metric, columns), only rows that apply."""
    duplicates = duplicate_rows(df).where("duplicate_rows > 0").select(
        F.lit(1).alias("rank"),
        F.lit("duplicates").alias("kind"),
        F.col("duplicate_rows").alias("metric"),
        F.array().cast("array<string>").alias("columns"),
    )
    high_null = null_report(df).where(
        F.try_divide(F.col("null_count"), F.col("total_rows")) > V.HIGH_NULL_SHARE
    )
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    parts = [duplicates, _issue(high_null, 2, "high_null")]
    if measures:
        heavy = iqr_outliers(df, measures).where(
            F.try_divide(F.col("outliers"), total) > V.HEAVY_OUTLIER_SHARE
        )
        parts.append(_issue(heavy, 3, "heavy_outliers"))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _issue(columns: DataFrame, rank: int, kind: str) -> DataFrame:
    """Up to five column names in table order; no row when there is none."""
    named = F.array_sort(F.collect_list(F.struct("ordinal", "column")))
    return (
        columns.agg(F.count(F.lit(1)).alias("metric"), named.alias("found"))
        .where("metric > 0")
        .select(
            F.lit(rank).alias("rank"),
            F.lit(kind).alias("kind"),
            "metric",
            F.transform(F.slice("found", 1, 5), lambda s: s["column"]).alias("columns"),
        )
    )


def missing_ranking(df: DataFrame, limit: int = V.MISSING_COLUMNS) -> DataFrame:
    """Columns with nulls, the emptiest first: (column, null_pct)."""
    return (
        null_report(df)
        .where("null_pct > 0")
        .orderBy(F.col("null_pct").desc(), "ordinal")
        .limit(limit)
        .select("column", "null_pct")
    )
