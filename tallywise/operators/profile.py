"""Column typing, roles, statistics and the choice of primary columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vocabulary as V
from ..functions.coerce import is_numeric, is_temporal, is_text, name_of, number, text_to_timestamp
from .cleaning import date_orders
from .distinct import distinct_values
from .quantiles import exact_quantiles

FEATURES = ("Year", "Quarter", "Month", "MonthName", "Week", "Weekday", "YearMonth")


def _found(column: Column, pattern: str) -> Column:
    return F.lower(column).rlike(pattern)


def _family(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if is_temporal(dtype):
        return "temporal"
    return "numeric" if is_numeric(dtype) else "other"


def _countable(df: DataFrame, column: str) -> Column:
    """The column in a form distinct counting accepts, NaN as null."""
    dtype, value = df.schema[column].dataType, name_of(column)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(value), value)
    if isinstance(dtype, T.MapType):
        return F.to_json(value)
    return value


def column_counts(
    df: DataFrame, engineered: tuple[str, ...] | list[str] = (), approximate: bool = False
) -> DataFrame:
    """Row per column: ordinal, column, dtype, family, row_count, non_null, unique_count, valid_dates.

    ``valid_dates`` is counted only for text columns whose name speaks of a
    date.  All but the distinct values come from one scan; exact distinct
    counts take one more for all whole-number columns and one for each other
    type.  ``approximate`` uses sketches in the same single scan.
    """
    fields = []
    for i, field in enumerate(df.schema.fields):
        value = _countable(df, field.name)
        named_date = is_text(field.dataType) and any(
            w in field.name.lower() for w in V.DATE_NAME.split("|")
        )
        distinct = F.approx_count_distinct(value) if approximate else F.lit(0).cast("bigint")
        fields.append(
            F.struct(
                F.lit(i).alias("ordinal"),
                F.lit(field.name).alias("column"),
                F.lit(field.dataType.simpleString()).alias("dtype"),
                F.lit(_family(field.dataType)).alias("family"),
                F.lit(field.name in engineered).alias("engineered"),
                F.count(F.lit(1)).alias("row_count"),
                F.count(value).alias("non_null"),
                distinct.alias("unique_count"),
                (F.count(text_to_timestamp(value)) if named_date else F.lit(None).cast("bigint")).alias(
                    "valid_dates"
                ),
            )
        )
    counts = df.agg(F.array(*fields).alias("f")).select(F.inline("f"))
    if approximate:
        return counts
    found = distinct_values(df, df.columns)
    # One row per column on either side.
    return counts.join(F.broadcast(found), "ordinal", "left").select(
        *[c for c in counts.columns if c not in ("unique_count", "valid_dates")],
        F.coalesce("distinct_count", F.lit(0).cast("bigint")).alias("unique_count"),
        "valid_dates",
    )


def semantic_type() -> Column:
    """The business type of a ``column_counts`` row; the first rule that fits decides.

    A name that speaks of a date makes a date only where dates are found:
    numbers are never read as dates.
    """
    name, family = F.col("column"), F.col("family")
    is_date = (family == "temporal") | (_found(name, V.DATE_NAME) & (F.col("valid_dates") > 0))
    unique = F.col("unique_count") == F.col("non_null")
    ratio = F.try_divide(F.col("unique_count"), F.col("non_null"))
    numeric = (
        F.when(_found(name, V.ID_NAME) & unique, "id")
        .when(_found(name, V.PERCENT_NAME), "percentage")
        .when(_found(name, V.CURRENCY_NAME), "currency")
        .otherwise("numeric")
    )
    grouping = (F.col("non_null") > 0) & (
        (ratio < V.CATEGORY_DISTINCT_SHARE) | _found(name, V.CATEGORY_NAME)
    )
    return (
        F.when(family == "boolean", "boolean")
        .when(is_date, "date")
        .when(family == "numeric", numeric)
        .when(_found(name, V.GEO_NAME), "geo")
        .when(_found(name, V.ID_NAME), "id")
        .when(grouping, "category")
        .otherwise("text")
    )


def column_role() -> Column:
    """measure, dimension, date, id, or null for a typed row."""
    kind, distinct = F.col("semantic_type"), F.col("unique_count")
    measure = kind.isin("currency", "percentage", "numeric")
    period = F.lower("column").isin(*V.PERIOD_NAMES) & (distinct <= V.PERIOD_MAX_DISTINCT)
    limit = F.greatest(
        F.lit(V.DIMENSION_MIN_DISTINCT).cast("bigint"),
        F.floor(F.col("row_count") * V.DIMENSION_ROW_SHARE),
    )
    grouping = kind.isin("category", "geo", "boolean", "text") & (distinct <= limit)
    return (
        F.when(F.col("engineered"), None)
        .when(measure & period, "dimension")
        .when(measure, "measure")
        .when(kind == "date", "date")
        .when(kind == "id", "id")
        .when(grouping, "dimension")
    )


def column_profile(
    df: DataFrame, engineered: tuple[str, ...] | list[str] = (), approximate: bool = False
) -> DataFrame:
    """Metadata, semantic type and role: one row per column."""
    counts = column_counts(df, engineered, approximate)
    null_count = F.col("row_count") - F.col("non_null")
    return (
        counts.withColumn("semantic_type", semantic_type())
        .withColumn("role", column_role())
        .select(
            "ordinal",
            "column",
            "dtype",
            "semantic_type",
            "role",
            "engineered",
            "row_count",
            null_count.alias("null_count"),
            (null_count > 0).alias("nullable"),
            "unique_count",
        )
    )


def add_date_features(df: DataFrame, date_cols: list[str]) -> tuple[DataFrame, list[str]]:
    """Seven calendar columns per date column; names that exist are left alone.

    Columns without a single date get none: one aggregation looks for a value in each, and
    another one finds out how text columns are written.
    """
    date_cols = [c for c in dict.fromkeys(date_cols) if c in df.columns]
    orders = date_orders(df, [c for c in date_cols if is_text(df.schema[c].dataType)], 0.0)
    values = {
        c: text_to_timestamp(name_of(c), orders.get(c, False)) if is_text(df.schema[c].dataType) else name_of(c)
        for c in date_cols
    }
    filled = df.agg(*[F.max(v.isNotNull()).alias(f"f{i}") for i, v in enumerate(values.values())]).first() if values else ()
    made: list[str] = []
    columns: list[Column] = []
    for (column, value), any_date in zip(values.items(), filled):
        if not any_date:
            continue
        day = value.cast("date")
        calendar = (
            F.year(day),
            F.quarter(day),
            F.month(day),
            F.date_format(day, "MMM"),
            F.weekofyear(day),
            F.date_format(day, "EEEE"),
            F.date_format(day, "yyyy-MM"),
        )
        for feature, expression in zip(FEATURES, calendar):
            name = f"{column}__{feature}"
            if name not in df.columns and name not in made:
                made.append(name)
                columns.append(expression.alias(name))
    return df.select("*", *columns), made


def column_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """min, max, mean, median, sample deviation and sum per column with at least one value."""
    values = df.select(*[number(df, c).alias(f"v{i}") for i, c in enumerate(columns)])
    span = range(len(columns))
    wide = values.agg(
        *[
            F.struct(
                F.lit(i).alias("ordinal"),
                F.lit(c).alias("column"),
                F.count(f"v{i}").alias("count"),
                F.min(f"v{i}").alias("min"),
                F.max(f"v{i}").alias("max"),
                F.avg(f"v{i}").alias("mean"),
                F.stddev_samp(f"v{i}").alias("std"),
                F.sum(f"v{i}").alias("sum"),
            ).alias(f"s{i}")
            for i, c in enumerate(columns)
        ]
    )
    stats = wide.select(F.inline(F.array(*[f"s{i}" for i in span]))).where(F.col("count") > 0)
    median = column_quantiles(df, columns, [0.5])
    return stats.join(
        F.broadcast(median.select("ordinal", F.col("quantiles")[0].alias("median"))), "ordinal"
    ).select("ordinal", "column", "count", "min", "max", "mean", "median", "std", "sum")


def column_quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> DataFrame:
    """Exact quantiles of several columns: (ordinal, n, quantiles)."""
    long = df.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(i).alias("ordinal"), number(df, c).alias("value"))
                    for i, c in enumerate(columns)
                ]
            )
        )
    )
    return exact_quantiles(long, ["ordinal"], "value", probs, bounded_keys=True)


def sample_values(
    df: DataFrame,
    order_key: str | list[str],
    columns: list[str] | None = None,
    count: int = V.SAMPLE_VALUES,
) -> DataFrame:
    """The first non-null values of each column in ``order_key`` order: (ordinal, column, values).

    Each column is a top-k over two or three columns, so no row is sorted.
    """
    keys = [order_key] if isinstance(order_key, str) else list(order_key)
    parts = None
    for i, column in enumerate(columns or df.columns):
        first = (
            df.where(name_of(column).isNotNull())
            .select(*[name_of(k).alias(f"_o{j}") for j, k in enumerate(keys)],
                    name_of(column).cast("string").alias("value"))
            .orderBy(*[f"_o{j}" for j in range(len(keys))], "value")
            .limit(count)
            .groupBy()
            .agg(F.array_sort(F.collect_list(F.struct(*[f"_o{j}" for j in range(len(keys))], "value"))).alias("v"))
            .select(
                F.lit(i).alias("ordinal"),
                F.lit(column).alias("column"),
                F.transform("v", lambda s: s["value"]).alias("values"),
            )
        )
        parts = first if parts is None else parts.unionByName(first)
    return parts


def preview(df: DataFrame, order_key: str | list[str], rows: int = V.PREVIEW_ROWS) -> DataFrame:
    """The first rows in ``order_key`` order."""
    keys = [order_key] if isinstance(order_key, str) else list(order_key)
    return df.orderBy(*[name_of(k) for k in keys]).limit(rows)


def domain_scores(tables: DataFrame) -> DataFrame:
    """Keyword hits per business domain for frames of (table_name, names).

    ``names`` holds the column names of a table.  A keyword counts once,
    wherever it occurs in the joined names.  Domains without a hit are left out.
    """
    keywords = F.array(
        *[
            F.struct(F.lit(order).alias("order"), F.lit(domain).alias("domain"), F.lit(k).alias("keyword"))
            for order, (domain, words) in enumerate(V.DOMAIN_KEYWORDS.items())
            for k in words
        ]
    )
    text = F.lower(F.concat_ws(" ", "names"))
    return (
        tables.select("table_name", text.alias("text"), F.inline(keywords))
        .where(F.contains("text", "keyword"))
        .groupBy("table_name", "order", "domain")
        .agg(F.count(F.lit(1)).alias("score"))
    )


def infer_domain(tables: DataFrame) -> DataFrame:
    """Best domain per table: (table_name, domain, confidence); ``general`` without a hit."""
    best = F.row_number().over(
        Window.partitionBy("table_name").orderBy(F.col("score").desc(), "order")
    )
    top = domain_scores(tables).withColumn("_r", best).where("_r = 1")
    return tables.select("table_name").join(top, "table_name", "left").select(
        "table_name",
        F.coalesce("domain", F.lit("general")).alias("domain"),
        F.least(F.lit(1.0), F.coalesce("score", F.lit(0)) / V.DOMAIN_FULL_SCORE).alias("confidence"),
    )


def table_summaries(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table: (ordinal, table_name, row_count, column_count, names)."""
    parts = None
    for i, (name, df) in enumerate(tables.items()):
        row = df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(i).alias("ordinal"),
            F.lit(name).alias("table_name"),
            "row_count",
            F.lit(len(df.columns)).alias("column_count"),
            F.array(*[F.lit(c) for c in df.columns]).alias("names"),
        )
        parts = row if parts is None else parts.unionByName(row)
    return parts


def workbook_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """Tables, rows over all of them, and the largest one (the first on a tie)."""
    return table_summaries(tables).agg(
        F.count(F.lit(1)).alias("sheet_count"),
        F.sum("row_count").alias("total_rows"),
        F.max_by("table_name", F.struct("row_count", -F.col("ordinal"))).alias("primary_sheet"),
    )


def _priority(words: tuple[str, ...]) -> Column:
    rank = F.lit(len(words))
    for place in reversed(range(len(words))):
        rank = F.when(F.lower("column").contains(words[place]), F.lit(place)).otherwise(rank)
    return rank


def primary_columns(
    profile: DataFrame, exclude: list[str] | tuple[str, ...] = (), by: tuple[str, ...] = ()
) -> DataFrame:
    """Default measure, date and dimension of a column profile (per ``by`` columns, if given)."""

    def first(role: str, order: Column, extra: Column | None = None) -> Column:
        fits = F.col("role") == role
        if extra is not None:
            fits = fits & extra
        return F.min_by("column", F.when(fits, F.struct(order, "ordinal")))

    kept = ~F.col("column").isin(*exclude) if exclude else None
    return profile.groupBy(*by).agg(
        first("measure", _priority(V.MEASURE_PRIORITY)).alias("measure"),
        first("date", F.lit(0)).alias("date_column"),
        first("dimension", _priority(V.DIMENSION_PRIORITY), kept).alias("dimension"),
    )


@dataclass(frozen=True)
class Roles:
    """Column choice for a table, read from its profile (one short row per column)."""

    columns: tuple[str, ...]
    measures: tuple[str, ...]
    dimensions: tuple[str, ...]
    dates: tuple[str, ...]
    ids: tuple[str, ...]
    geo: tuple[str, ...]
    types: dict
    measure: str | None
    dimension: str | None
    date: str | None


def pick(names: tuple[str, ...], priority: tuple[str, ...]) -> str | None:
    """The first name that holds the earliest priority word, else the first name."""
    for word in priority:
        for name in names:
            if word in name.lower():
                return name
    return names[0] if names else None


def roles_of(profile: DataFrame) -> Roles:
    """Collect a column profile; its size is the width of the table, not its length."""
    rows = sorted(
        profile.select("ordinal", "column", "semantic_type", "role").collect(),
        key=lambda r: r["ordinal"],
    )

    def with_role(role: str) -> tuple[str, ...]:
        return tuple(r["column"] for r in rows if r["role"] == role)

    measures, dimensions, dates = with_role("measure"), with_role("dimension"), with_role("date")
    return Roles(
        columns=tuple(r["column"] for r in rows),
        measures=measures,
        dimensions=dimensions,
        dates=dates,
        ids=with_role("id"),
        geo=tuple(r["column"] for r in rows if r["semantic_type"] == "geo"),
        types={r["column"]: r["semantic_type"] for r in rows},
        measure=pick(measures, V.MEASURE_PRIORITY),
        dimension=pick(dimensions, V.DIMENSION_PRIORITY),
        date=dates[0] if dates else None,
    )
