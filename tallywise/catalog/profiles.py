"""Queries on typing, roles, statistics and data quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..operators import aggregate, profile, quality
from ..operators import profile_state as states
from ..session import scratch_path
from .registry import TABLES, load, query, quoted, rounded, union_all

PROFILED = ("orders", "lineitem", "events", "customer", "supplier", "part", "nation", "region",
            "labels", "conversations")


def _counts_sql(tables) -> str:
    return union_all(
        [
            f"""SELECT {quoted(t)} AS table_name, {i}::INTEGER AS ordinal, {quoted(c)} AS "column",
            {quoted(kind)} AS dtype, {quoted(family)} AS family, count(*) AS row_count,
            count("{c}") AS non_null, count(DISTINCT "{c}") AS unique_count FROM {t}"""
            for t in tables
            for i, (c, kind, family) in enumerate(TABLES[t])
        ]
    )


def _typed_sql(tables) -> str:
    """Typing and roles written out over the counted columns."""
    def held(pattern):
        return f"regexp_matches(lower(\"column\"), {quoted(pattern)})"

    return f"""counted AS ({_counts_sql(tables)}),
    typed AS (SELECT *, CASE
        WHEN family = 'temporal' THEN 'date'
        WHEN family = 'numeric' AND {held(V.ID_NAME)} AND unique_count = non_null THEN 'id'
        WHEN family = 'numeric' AND {held(V.PERCENT_NAME)} THEN 'percentage'
        WHEN family = 'numeric' AND {held(V.CURRENCY_NAME)} THEN 'currency'
        WHEN family = 'numeric' THEN 'numeric'
        WHEN {held(V.GEO_NAME)} THEN 'geo'
        WHEN {held(V.ID_NAME)} THEN 'id'
        WHEN non_null > 0 AND (unique_count / non_null < 0.5 OR {held(V.CATEGORY_NAME)}) THEN 'category'
        ELSE 'text' END AS semantic_type FROM counted),
    roled AS (SELECT *, CASE
        WHEN semantic_type IN ('currency', 'percentage', 'numeric') THEN 'measure'
        WHEN semantic_type = 'date' THEN 'date'
        WHEN semantic_type = 'id' THEN 'id'
        WHEN unique_count <= greatest(50, floor(row_count * 0.1)) THEN 'dimension' END AS role
        FROM typed)"""


def _profiles(spark, sf, tables) -> DataFrame:
    parts = [
        profile.column_profile(load(spark, sf, t)).withColumn("table_name", F.lit(t)) for t in tables
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "semantic_types",
    f"""WITH {_typed_sql(PROFILED)} SELECT table_name, ordinal, "column", semantic_type FROM typed""",
)
def semantic_types(spark, sf):
    return _profiles(spark, sf, PROFILED).select("table_name", "ordinal", "column", "semantic_type")


@query(
    "column_roles",
    f"""WITH {_typed_sql(PROFILED)} SELECT table_name, ordinal, "column", role FROM roled""",
)
def column_roles(spark, sf):
    return _profiles(spark, sf, PROFILED).select("table_name", "ordinal", "column", "role")


@query(
    "column_profile",
    f"""WITH {_typed_sql(("lineitem", "events"))}
    SELECT table_name, ordinal, "column", dtype, semantic_type, role, false AS engineered, row_count,
           row_count - non_null AS null_count, row_count > non_null AS nullable, unique_count
    FROM roled""",
)
def column_profile(spark, sf):
    return _profiles(spark, sf, ("lineitem", "events"))


def _priority_sql(words) -> str:
    return "CASE " + " ".join(
        f"WHEN contains(lower(\"column\"), {quoted(w)}) THEN {i}" for i, w in enumerate(words)
    ) + f" ELSE {len(words)} END"


@query(
    "primary_columns",
    f"""WITH {_typed_sql(PROFILED)}
    SELECT table_name,
        arg_min("column", {_priority_sql(V.MEASURE_PRIORITY)} * 1000 + ordinal)
            FILTER (role = 'measure') AS measure,
        arg_min("column", ordinal) FILTER (role = 'date') AS date_column,
        arg_min("column", {_priority_sql(V.DIMENSION_PRIORITY)} * 1000 + ordinal)
            FILTER (role = 'dimension') AS dimension
    FROM roled GROUP BY table_name""",
)
def primary_columns(spark, sf):
    return profile.primary_columns(_profiles(spark, sf, PROFILED), by=("table_name",))


@query(
    "date_features",
    """SELECT event_id, ts, year(ts)::INTEGER AS ts__Year, quarter(ts)::INTEGER AS ts__Quarter,
        month(ts)::INTEGER AS ts__Month, strftime(ts, '%b') AS ts__MonthName,
        week(ts)::INTEGER AS ts__Week, dayname(ts) AS ts__Weekday,
        strftime(ts, '%Y-%m') AS ts__YearMonth FROM events""",
)
def date_features(spark, sf):
    events = load(spark, sf, "events").select("event_id", "ts")
    return profile.add_date_features(events, ["ts"])[0]


@query(
    "date_features_text",
    """SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS ordered, NULL::TIMESTAMP AS shipped, 'soon' AS due,
        year(o_orderdate)::INTEGER AS ordered__Year, quarter(o_orderdate)::INTEGER AS ordered__Quarter,
        month(o_orderdate)::INTEGER AS ordered__Month, strftime(o_orderdate, '%b') AS ordered__MonthName,
        week(o_orderdate)::INTEGER AS ordered__Week, dayname(o_orderdate) AS ordered__Weekday,
        strftime(o_orderdate, '%Y-%m') AS ordered__YearMonth FROM orders""",
)
def date_features_text(spark, sf):
    """Day-first text gets its columns; a column without dates, empty or not, gets none."""
    rows = load(spark, sf, "orders").select(
        "o_orderkey",
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("ordered"),
        F.lit(None).cast("timestamp_ntz").alias("shipped"),
        F.lit("soon").alias("due"),
    )
    return profile.add_date_features(rows, ["ordered", "shipped", "due"])[0]


STATED = ("l_orderkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate")


@query(
    "profile_state",
    union_all(
        [
            f"""SELECT {i}::INTEGER AS ordinal, {quoted(c)} AS "column", count(*) AS row_count, count(v) AS non_null,
            count(*) - count(v) AS null_count, round(min(n), 4) AS min, round(max(n), 4) AS max, round(sum(n), 2) AS sum,
            round(avg(n), 4) AS mean, round(stddev_samp(n), 4) AS std
            FROM (SELECT {v} AS v, {f"{v}::DOUBLE" if kind in ("bigint", "double") else "NULL::DOUBLE"} AS n FROM lineitem)"""
            for i, (c, kind) in enumerate((c, k) for c in STATED for n, k, _ in TABLES["lineitem"] if n == c)
            for v in (f"CASE WHEN l_linenumber <> 3 THEN {c} END" if c == "l_quantity" else c,)
        ]
    ),
)
def profile_state(spark, sf):
    """A table that grows in three steps; each step reads its own files only."""
    lines = load(spark, sf, "lineitem")
    lines = lines.withColumn("l_quantity", F.when(F.col("l_linenumber") != 3, F.col("l_quantity")))
    source, state = scratch_path(spark, "growing"), scratch_path(spark, "growing-state")
    for part in range(3):
        lines.where(F.col("l_orderkey") % 3 == part).select(*STATED).write.mode("append").parquet(source)
        states.update(spark, source, state)
    found = states.merged(spark, source, state)
    exact = ("row_count", "non_null", "null_count", "min", "max", "sum", "mean", "std")
    return rounded(found.select("ordinal", "column", *exact), 4).withColumn("sum", F.round("sum", 2))


MEASURED = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")


@query(
    "column_stats",
    union_all(
        [
            f"""SELECT {i}::INTEGER AS ordinal, {quoted(c)} AS "column", count({c}) AS count,
            round(min({c})::DOUBLE, 6) AS min, round(max({c})::DOUBLE, 6) AS max,
            round(avg({c}), 6) AS mean, round(quantile_cont({c}::DOUBLE, 0.5), 6) AS median,
            round(stddev_samp({c}), 6) AS std, round(sum({c})::DOUBLE, 2) AS sum FROM lineitem"""
            for i, c in enumerate(MEASURED)
        ]
    ),
)
def column_stats(spark, sf):
    stats = profile.column_stats(load(spark, sf, "lineitem"), list(MEASURED))
    return rounded(stats, 6).withColumn("sum", F.round("sum", 2))


@query(
    "sample_values",
    union_all(
        [
            f"""SELECT {i}::INTEGER AS ordinal, {quoted(c)} AS "column",
            array_to_string((SELECT list({c}::VARCHAR ORDER BY c_custkey) FROM
              (SELECT c_custkey, {c} FROM customer WHERE {c} IS NOT NULL ORDER BY c_custkey LIMIT 5)), '|')
              AS "values" """
            for i, (c, _, _) in enumerate(TABLES["customer"])
        ]
    ),
)
def sample_values(spark, sf):
    return profile.sample_values(load(spark, sf, "customer"), "c_custkey").withColumn(
        "values", F.concat_ws("|", "values")
    )


@query(
    "distinct_counts",
    union_all(
        [
            f"""SELECT {i}::INTEGER AS ordinal, {quoted(c)} AS "column",
            count(DISTINCT {c}) AS distinct_count FROM orders"""
            for i, (c, _, _) in enumerate(TABLES["orders"])
        ]
    ),
)
def distinct_counts(spark, sf):
    return aggregate.distinct_counts(load(spark, sf, "orders"))


# --- quality ------------------------------------------------------------------

HOLED_SQL = """(SELECT o_orderkey, o_custkey,
    CASE WHEN o_orderkey % 10 >= 4 THEN o_orderstatus END AS o_orderstatus,
    CASE WHEN o_orderkey % 10 >= 1 THEN o_totalprice END AS o_totalprice,
    o_orderdate, CASE WHEN o_orderkey % 2 = 1 THEN o_orderpriority END AS o_orderpriority
    FROM orders)"""
ORDERS = [c for c, _, _ in TABLES["orders"]]


def _holed(spark, sf):
    """Orders with nulls by a rule on the key; prices are NaN where they are missing."""
    key = F.col("o_orderkey")
    return load(spark, sf, "orders").select(
        "o_orderkey",
        "o_custkey",
        F.when(key % 10 >= 4, F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(key % 10 >= 1, F.col("o_totalprice")).otherwise(float("nan")).alias("o_totalprice"),
        "o_orderdate",
        F.when(key % 2 == 1, F.col("o_orderpriority")).alias("o_orderpriority"),
    )


def _null_report_sql() -> str:
    return union_all(
        [
            f"""SELECT {i}::INTEGER AS ordinal, {quoted(c)} AS "column", count(*) AS total_rows,
            count(*) - count({c}) AS null_count,
            round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS null_pct FROM {HOLED_SQL}"""
            for i, c in enumerate(ORDERS)
        ]
    )


@query("null_report", _null_report_sql())
def null_report(spark, sf):
    return quality.null_report(_holed(spark, sf))


@query(
    "missing_ranking",
    f"""SELECT "column", null_pct FROM ({_null_report_sql()}) WHERE null_pct > 0
    ORDER BY null_pct DESC, ordinal LIMIT 20""",
)
def missing_ranking(spark, sf):
    return quality.missing_ranking(_holed(spark, sf))


def _duplicates_sql(columns, source) -> str:
    return f"""SELECT sum(n)::BIGINT AS total_rows, (sum(n) - count(*))::BIGINT AS duplicate_rows
    FROM (SELECT count(*) AS n FROM {source} GROUP BY {columns})"""


@query("duplicate_rows", _duplicates_sql("l_partkey, l_quantity, l_linenumber", "lineitem"))
def duplicate_rows(spark, sf):
    return quality.duplicate_rows(
        load(spark, sf, "lineitem"), ["l_partkey", "l_quantity", "l_linenumber"]
    )


@query(
    "duplicate_rows_wide",
    _duplicates_sql(
        ", ".join(c for c, _, _ in TABLES["lineitem"]),
        "(SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_linenumber = 1)",
    ),
)
def duplicate_rows_wide(spark, sf):
    lines = load(spark, sf, "lineitem")
    return quality.duplicate_rows(lines.unionByName(lines.where("l_linenumber = 1")))


def _fences_sql(table, columns) -> str:
    return union_all(
        [
            f"""SELECT {i}::INTEGER AS ordinal, {quoted(c)} AS "column", non_null,
            round(lo, 6) AS lower, round(hi, 6) AS upper,
            (SELECT count(*) FROM {table} WHERE {c} < lo OR {c} > hi) AS outliers
            FROM (SELECT non_null, q[1] - 1.5 * (q[2] - q[1]) AS lo, q[2] + 1.5 * (q[2] - q[1]) AS hi
                  FROM (SELECT count({c}) AS non_null,
                        quantile_cont({c}::DOUBLE, [0.25, 0.75]) AS q FROM {table}))"""
            for i, c in enumerate(columns)
        ]
    )


@query("iqr_outliers", _fences_sql("events", ("value", "user_id")))
def iqr_outliers(spark, sf):
    return rounded(quality.iqr_outliers(load(spark, sf, "events"), ["value", "user_id"]), 6)


def _score_sql(source, columns, group) -> str:
    nulls = " + ".join(f"(count(*) - count({c}))" for c in columns)
    return f"""WITH s AS (SELECT * FROM {source}),
    a AS (SELECT count(*) AS total_rows, {len(columns)}::BIGINT AS total_columns,
          ({nulls})::BIGINT AS null_cells FROM s),
    d AS (SELECT (sum(n) - count(*))::BIGINT AS duplicate_rows
          FROM (SELECT count(*) AS n FROM s GROUP BY {group}))
    SELECT total_rows, total_columns, null_cells, duplicate_rows,
        greatest(0.0::DOUBLE, round(100 - null_cells / (total_rows * total_columns) * 40
            - duplicate_rows / total_rows * 30, 1)) AS quality_score FROM a, d"""


SLIM_SQL = f"(SELECT o_orderstatus, o_orderpriority FROM {HOLED_SQL})"


@query(
    "quality_score",
    _score_sql(SLIM_SQL, ["o_orderstatus", "o_orderpriority"], "o_orderstatus, o_orderpriority"),
)
def quality_score(spark, sf):
    return quality.quality_score(_holed(spark, sf).select("o_orderstatus", "o_orderpriority"))


@query("quality_score_full", _score_sql(HOLED_SQL, ORDERS, ", ".join(ORDERS)))
def quality_score_full(spark, sf):
    return quality.quality_score(_holed(spark, sf))


HEAVY_SQL = """(SELECT event_type, CASE WHEN event_id % 3 <> 0 THEN user_id END AS user_id,
    CASE WHEN event_id % 5 = 0 THEN value * 100 ELSE value END AS value FROM events)"""


@query(
    "quality_issues",
    f"""WITH s AS (SELECT * FROM {HEAVY_SQL}),
    d AS (SELECT (sum(n) - count(*))::BIGINT AS copies
          FROM (SELECT count(*) AS n FROM s GROUP BY event_type, user_id, value)),
    n AS (SELECT * FROM (VALUES (0, 'event_type'), (1, 'user_id'), (2, 'value')) v(i, c)),
    high AS (SELECT i, c FROM n, (SELECT count(*) AS total, count(event_type) AS n0, count(user_id) AS n1,
             count(value) AS n2 FROM s)
             WHERE (total - CASE i WHEN 0 THEN n0 WHEN 1 THEN n1 ELSE n2 END) / total > 0.3),
    heavy AS (SELECT 0 AS i, "column" AS c FROM ({_fences_sql('s', ('value',))})
              WHERE outliers / (SELECT count(*) FROM s) > 0.1)
    SELECT 1::INTEGER AS rank, 'duplicates' AS kind, copies AS metric, '' AS columns FROM d WHERE copies > 0
    UNION ALL SELECT 2, 'high_null', count(*), string_agg(c, ',' ORDER BY i) FROM high HAVING count(*) > 0
    UNION ALL SELECT 3, 'heavy_outliers', count(*), string_agg(c, ',' ORDER BY i) FROM heavy
    HAVING count(*) > 0""",
)
def quality_issues(spark, sf):
    key = F.col("event_id")
    heavy = load(spark, sf, "events").select(
        "event_type",
        F.when(key % 3 != 0, F.col("user_id")).alias("user_id"),
        F.when(key % 5 == 0, F.col("value") * 100).otherwise(F.col("value")).alias("value"),
    )
    return quality.quality_issues(heavy, ["value"]).withColumn("columns", F.concat_ws(",", "columns"))
