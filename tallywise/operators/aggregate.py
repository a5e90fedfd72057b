"""Generic group-by, distinct counts and drill-down levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import moment, name_of, number
from .distinct import distinct_values
from .quantiles import exact_quantiles

NUMERIC_FUNCTIONS = ("sum", "mean", "median", "std", "var")
FUNCTIONS = NUMERIC_FUNCTIONS + ("count", "min", "max", "nunique", "first", "last")


def aggregate_by(
    df: DataFrame,
    group_by: str,
    agg_col: str,
    func: str = "sum",
    order_key: str | None = None,
) -> DataFrame:
    """One aggregate per group, largest first: (group_by, <func>_<agg_col>).

    Null groups are dropped.  ``first`` and ``last`` need ``order_key``, since
    rows have no order of their own; they skip null values.
    """
    if func not in FUNCTIONS:
        raise ValueError(f"unknown aggregate {func!r}; one of {', '.join(FUNCTIONS)}")
    out = f"{func}_{agg_col}"
    value = number(df, agg_col) if func in NUMERIC_FUNCTIONS else name_of(agg_col)
    if func in ("first", "last") and order_key is None:
        raise ValueError(f"{func!r} needs order_key")
    columns = [name_of(group_by).alias("_k"), value.alias("_v")]
    if order_key is not None:
        columns.append(name_of(order_key).alias("_o"))
    rows = df.select(*columns).where(F.col("_k").isNotNull())
    if func == "median":
        found = exact_quantiles(rows, ["_k"], "_v", [0.5])
        result = found.select("_k", F.col("quantiles")[0].alias(out))
    else:
        result = rows.groupBy("_k").agg(_aggregate(func).alias(out))
    return result.select(F.col("_k").alias(group_by), name_of(out)).orderBy(
        name_of(out).desc_nulls_last(), name_of(group_by)
    )


def _aggregate(func: str) -> Column:
    present = F.col("_v").isNotNull()
    return {
        "sum": lambda: F.coalesce(F.sum("_v"), F.lit(0.0)),
        "mean": lambda: F.avg("_v"),
        "count": lambda: F.count("_v"),
        "min": lambda: F.min("_v"),
        "max": lambda: F.max("_v"),
        "std": lambda: F.stddev_samp("_v"),
        "var": lambda: F.var_samp("_v"),
        "nunique": lambda: F.count_distinct("_v"),
        "first": lambda: F.min_by("_v", F.when(present, F.col("_o"))),
        "last": lambda: F.max_by("_v", F.when(present, F.col("_o"))),
    }[func]()


def distinct_counts(
    df: DataFrame, columns: list[str] | None = None, approximate: bool = False
) -> DataFrame:
    """Distinct non-null values per column: (ordinal, column, distinct_count).

    Exact counts read all whole-number columns in one scan and the columns of each other
    type in one; ``approximate`` uses sketches, one scan for all.
    """
    columns = columns or df.columns
    fields = [
        F.struct(
            F.lit(i).alias("ordinal"),
            F.lit(c).alias("column"),
            (F.approx_count_distinct(name_of(c)) if approximate else F.lit(0).cast("bigint")).alias("distinct_count"),
        )
        for i, c in enumerate(columns)
    ]
    if approximate:
        return df.agg(F.array(*fields).alias("f")).select(F.inline("f"))
    # Columns without a value are in none of the counts.
    listed = df.sparkSession.range(1, numPartitions=1).select(F.inline(F.array(*fields)))
    found = listed.select("ordinal", "distinct_count").unionByName(distinct_values(df, columns))
    names = F.array(*[F.lit(c) for c in columns])
    totals = found.groupBy("ordinal").agg(F.sum("distinct_count").alias("distinct_count"))
    return totals.select("ordinal", F.get(names, F.col("ordinal")).alias("column"), "distinct_count")


def _many(rows: str | None) -> Column:
    """How many rows a row stands for: itself, or what the column ``rows`` says."""
    return F.lit(1) if rows is None else name_of(rows)


def drill_time(df: DataFrame, date_col: str, measure: str, rows: str | None = None) -> DataFrame:
    """Totals at the levels all, year, quarter and month: (level, year, quarter, month, total, rows).

    The column ``rows`` says how many rows each row of a table of totals stands for.  The months are totalled first, so the rollup expands calendar rows only.
    """
    months = (
        df.select(
            F.trunc(moment(df, date_col).cast("date"), "month").alias("m"),
            number(df, measure).alias("v"),
            _many(rows).alias("n"),
        )
        .na.drop()
        .groupBy("m")
        .agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
        .select(
            F.year("m").alias("year"),
            F.quarter("m").alias("quarter"),
            F.month("m").alias("month"),
            "v",
            "n",
        )
    )
    return (
        months.rollup("year", "quarter", "month")
        .agg(
            F.grouping_id().alias("g"),
            F.sum("v").alias("total"),
            F.sum("n").alias("rows"),
        )
        .select(
            F.when(F.col("g") == 7, "all")
            .when(F.col("g") == 3, "year")
            .when(F.col("g") == 1, "quarter")
            .otherwise("month")
            .alias("level"),
            "year",
            "quarter",
            "month",
            "total",
            "rows",
        )
    )


def drill_geo(
    df: DataFrame, geo_columns: list[str], measure: str, max_levels: int = 4, rows: str | None = None
) -> DataFrame:
    """Totals along two to four place columns: (depth, place columns..., total, rows); ``rows`` as above."""
    levels = geo_columns[:max_levels]
    if len(levels) < 2:
        raise ValueError("a place drill-down needs at least two columns")
    finest = (
        df.select(*[name_of(c).alias(c) for c in levels], number(df, measure).alias("_v"), _many(rows).alias("_n"))
        .where(F.col("_v").isNotNull())
        .groupBy(*[name_of(c) for c in levels])
        .agg(F.sum("_v").alias("_v"), F.sum("_n").alias("_n"))
    )
    depth = sum((1 - F.grouping(name_of(c)).cast("int") for c in levels), F.lit(0))
    return (
        finest.rollup(*[name_of(c) for c in levels])
        .agg(depth.alias("depth"), F.sum("_v").alias("total"), F.sum("_n").alias("rows"))
        .select("depth", *[name_of(c) for c in levels], "total", "rows")
    )
