"""Queries on reading, writing and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.coerce import text_to_timestamp
from ..operators import cleaning
from ..operators.profile import (
    domain_scores,
    infer_domain,
    preview,
    table_summaries,
    workbook_summary,
)
from ..operators.series import resample_sum
from ..session import scratch_path
from ..sources import sinks, tables
from .registry import TABLES, columns_of, load, query, quoted, rounded, union_all

ORDER_CSV = (
    "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string"
)


@query("csv_scan", "SELECT * FROM customer")
def csv_scan(spark, sf):
    path = sinks.export_csv(load(spark, sf, "customer"), scratch_path(spark, "customer") + ".csv")
    read = tables.read_csv(spark, path)
    return read.select(
        F.col("c_custkey").cast("bigint"), "c_name", F.col("c_nationkey").cast("int"),
        F.col("c_acctbal").cast("double"), "c_mktsegment",
    )


@query("csv_export", "SELECT * FROM orders")
def csv_export(spark, sf):
    path = sinks.export_csv(load(spark, sf, "orders"), scratch_path(spark, "orders") + ".csv")
    return tables.read_csv(spark, path, schema=ORDER_CSV)


WORKBOOK = ("region", "nation", "customer", "supplier", "part")


@query(
    "workbook_tables",
    union_all(
        [
            f"SELECT {quoted(t)} AS table_name, count(*) AS row_count, "
            f"{len(TABLES[t])}::INTEGER AS column_count FROM {t}"
            for t in WORKBOOK
        ]
    ),
)
def workbook_tables(spark, sf):
    book = tables.read_tables(spark, {t: f"{sf}/{t}.parquet" for t in WORKBOOK})
    return table_summaries(book).select("table_name", "row_count", "column_count")


@query(
    "workbook_summary",
    "WITH t AS ("
    + union_all(
        [
            f"SELECT {i} AS i, {quoted(t)} AS name, count(*) AS n FROM {t}"
            for i, t in enumerate(TABLES)
        ]
    )
    + """)
    SELECT count(*) AS sheet_count, sum(n)::BIGINT AS total_rows,
           (SELECT name FROM t ORDER BY n DESC, i LIMIT 1) AS primary_sheet
    FROM t""",
)
def workbook(spark, sf):
    return workbook_summary({t: load(spark, sf, t) for t in TABLES})


@query("table_sample", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5000")
def table_sample(spark, sf):
    return tables.sample_table(load(spark, sf, "orders"), order_key="o_orderkey")


LISTED = ("customer", "supplier", "part", "orders", "events")


@query(
    "schema_listing",
    union_all(
        [
            f"""SELECT {quoted(t)} AS table_name, {i}::INTEGER AS ordinal, {quoted(c)} AS "column",
            {quoted(kind)} AS type, count({c}) < count(*) AS nullable,
            count(*) > 0 AND count({c}) = count(*) AND count(DISTINCT {c}) = count(*) AS inferred_key
            FROM {t}"""
            for t in LISTED
            for i, (c, kind, _) in enumerate(TABLES[t])
        ]
    ),
)
def schema_listing(spark, sf):
    return tables.schema_listing({t: load(spark, sf, t) for t in LISTED}, keys=True)


SELECT_TEXT = (
    "SELECT o_orderstatus, count(*) AS orders, round(sum(o_totalprice), 2) AS total "
    "FROM orders GROUP BY o_orderstatus ORDER BY o_orderstatus"
)


@query("guarded_select", SELECT_TEXT + " LIMIT 1000")
def guarded_select(spark, sf):
    load(spark, sf, "orders").createOrReplaceTempView("orders")
    return tables.guarded_select(spark, SELECT_TEXT + ";")


WITH_TEXT = (
    "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 400000) "
    "SELECT o_orderkey, o_totalprice FROM big ORDER BY o_totalprice DESC, o_orderkey"
)


@query("guarded_select_with", WITH_TEXT + " LIMIT 50")
def guarded_select_with(spark, sf):
    load(spark, sf, "orders").createOrReplaceTempView("orders")
    return tables.guarded_select(spark, WITH_TEXT, limit=50)


NESTED_TEXT = """WITH ranked AS (
    SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place
    FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE upper(c_mktsegment) = 'BUILDING'))
    SELECT o_custkey, count(*) AS orders, max(CASE WHEN place = 1 THEN o_totalprice END) AS best
    FROM ranked GROUP BY o_custkey HAVING count(*) > 1 ORDER BY o_custkey"""


@query("guarded_select_nested", NESTED_TEXT + " LIMIT 10000")
def guarded_select_nested(spark, sf):
    for name in ("orders", "customer"):
        load(spark, sf, name).createOrReplaceTempView(name)
    return tables.guarded_select(spark, NESTED_TEXT, limit=10_000, tables=["orders", "customer"])


@query(
    "json_rows",
    """SELECT '{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus
        || '","o_totalprice":' || coalesce(CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice END::VARCHAR, 'null')
        || ',"o_orderdate":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '"}' AS json
    FROM orders""",
)
def json_rows(spark, sf):
    # Every tenth price is NaN, which JSON cannot hold.
    orders = load(spark, sf, "orders").withColumn(
        "o_totalprice",
        F.when(F.col("o_orderkey") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice")),
    )
    return sinks.json_rows(orders, ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate"])


@query("json_export", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def json_export(spark, sf):
    path = scratch_path(spark, "customer") + ".json"
    sinks.export_json(load(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), path)
    return spark.read.schema("c_custkey bigint, c_name string, c_acctbal double").json(path)


@query("clean_headers", "SELECT * FROM part")
def clean_headers(spark, sf):
    part = load(spark, sf, "part")
    return cleaning.clean_headers(part.toDF(*[" " * (i % 3) + c + "\t" * (i % 2) for i, c in enumerate(part.columns)]))


@query(
    "drop_all_null",
    """SELECT o_custkey, o_orderstatus, o_totalprice FROM (
        SELECT CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS o_custkey,
               CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS o_orderstatus,
               CASE WHEN o_orderkey % 14 <> 0 THEN o_totalprice END AS o_totalprice FROM orders)
    WHERE NOT (o_custkey IS NULL AND o_orderstatus IS NULL AND o_totalprice IS NULL)""",
)
def drop_all_null(spark, sf):
    key = F.col("o_orderkey")
    holed = load(spark, sf, "orders").select(
        F.when(key % 7 != 0, F.col("o_custkey")).alias("o_custkey"),
        F.when(key % 7 != 0, F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(key % 14 != 0, F.col("o_totalprice")).alias("o_totalprice"),
    )
    return cleaning.drop_empty_rows(holed)


@query(
    "parse_dates",
    """SELECT o_orderkey,
        CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END AS mostly,
        CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'n/a' END AS seldom
    FROM orders""",
)
def parse_dates(spark, sf):
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    text = load(spark, sf, "orders").select(
        "o_orderkey",
        F.when(key % 5 == 0, "bad")
        .when(key % 5 == 1, F.date_format(day, "yyyy-MM-dd"))
        .when(key % 5 == 2, F.date_format(day, "MM/dd/yyyy"))
        .when(key % 5 == 3, F.date_format(day, "d MMM yyyy"))
        .otherwise(F.date_format(day, "yyyy-MM-dd HH:mm:ss"))
        .alias("mostly"),
        F.when(key % 2 == 0, F.date_format(day, "yyyy-MM-dd")).otherwise("n/a").alias("seldom"),
    )
    return cleaning.parse_dates(text)


# Pattern to write a day with, and what is left of the day when it is read again.
WRITTEN = (
    ("yyyy-MM-dd'T'HH:mm:ss'Z'", "o_orderdate"),
    ("yyyy-MM-dd HH:mm:ss'+00:00'", "o_orderdate"),
    ("MMMM d, yyyy", "o_orderdate"),
    ("d MMMM yyyy", "o_orderdate"),
    ("MM-dd-yyyy", "o_orderdate"),
    ("yyyy.MM.dd", "o_orderdate"),
    ("M/d/yyyy h:mm a", "o_orderdate"),
    ("MMM yyyy", "date_trunc('month', o_orderdate)"),
    ("yyyy-MM", "date_trunc('month', o_orderdate)"),
)


@query(
    "parse_dates_forms",
    "SELECT o_orderkey, (CASE o_orderkey % " + str(len(WRITTEN)) + " "
    + " ".join(f"WHEN {i} THEN date_trunc('day', {kept})" for i, (_, kept) in enumerate(WRITTEN))
    + " END)::TIMESTAMP AS day FROM orders",
)
def parse_dates_forms(spark, sf):
    key, day = F.col("o_orderkey"), F.date_trunc("day", "o_orderdate")
    written = F.coalesce(
        *[F.when(key % len(WRITTEN) == i, F.date_format(day, p)) for i, (p, _) in enumerate(WRITTEN)]
    )
    return load(spark, sf, "orders").select("o_orderkey", text_to_timestamp(written).alias("day"))


# How three columns are written: day first; two in three day first, the others month first;
# with days up to the 12th only, so that nothing tells the two apart.
_DAY_FIRST = """SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS european,
    CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%m-%d-%Y') ELSE strftime(o_orderdate, '%d-%m-%Y') END AS mixed,
    CASE WHEN day(o_orderdate) <= 12 THEN strftime(o_orderdate, '%d.%m.%Y') END AS ambiguous,
    CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%d/%m/%y') ELSE 'open' END AS seldom
    FROM orders"""


def _written_dates(spark, sf):
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    return load(spark, sf, "orders").select(
        "o_orderkey",
        F.date_format(day, "dd/MM/yyyy").alias("european"),
        F.when(key % 3 == 0, F.date_format(day, "MM-dd-yyyy")).otherwise(F.date_format(day, "dd-MM-yyyy")).alias("mixed"),
        F.when(F.dayofmonth(day) <= 12, F.date_format(day, "dd.MM.yyyy")).alias("ambiguous"),
        F.when(key % 2 == 0, F.date_format(day, "dd/MM/yy")).otherwise("open").alias("seldom"),
    )


@query(
    "parse_dates_day_first",
    f"""SELECT o_orderkey, try_strptime(european, '%d/%m/%Y') AS european, try_strptime(mixed, '%d-%m-%Y') AS mixed,
        try_strptime(ambiguous, '%m.%d.%Y') AS ambiguous, seldom FROM ({_DAY_FIRST})""",
)
def parse_dates_day_first(spark, sf):
    return cleaning.parse_dates(_written_dates(spark, sf))


@query(
    "date_formats",
    "WITH written AS (" + _DAY_FIRST + "), counted AS ("
    + union_all(
        [
            f"""SELECT {i}::INTEGER AS ordinal, '{c}' AS "column", count({c}) AS non_null,
            count(try_strptime({c}, '%m{sep}%d{sep}%{y}')) AS month_first, count(try_strptime({c}, '%d{sep}%m{sep}%{y}')) AS day_first
            FROM written"""
            for i, c, sep, y in ((1, "european", "/", "Y"), (2, "mixed", "-", "Y"), (3, "ambiguous", ".", "Y"), (4, "seldom", "/", "y"))
        ]
    )
    + """) SELECT *, CASE WHEN day_first > month_first THEN 'day first' ELSE 'month first' END AS format,
    round(greatest(day_first, month_first) / non_null, 6) AS share FROM counted""",
)
def date_formats(spark, sf):
    return rounded(cleaning.date_formats(_written_dates(spark, sf)), 6)


@query(
    "trend_day_first",
    """SELECT date_trunc('month', try_strptime(strftime(o_orderdate, '%d/%m/%Y'), '%d/%m/%Y'))::DATE AS x,
        round(sum(o_totalprice), 2) AS y FROM orders GROUP BY 1""",
)
def trend_day_first(spark, sf):
    written = load(spark, sf, "orders").select(F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"), "o_totalprice")
    points = resample_sum(cleaning.parse_dates(written, ["day"]), "day", "o_totalprice", "MS")
    return points.select("x", F.round("y", 2).alias("y"))


@query(
    "numeric_coerce",
    """SELECT o_orderkey, try_cast(t AS DOUBLE) AS price FROM (
        SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'n/a' WHEN 1 THEN ''
               ELSE o_totalprice::VARCHAR END AS t FROM orders)""",
)
def numeric_coerce(spark, sf):
    key = F.col("o_orderkey")
    text = load(spark, sf, "orders").select(
        "o_orderkey",
        F.when(key % 4 == 0, "n/a")
        .when(key % 4 == 1, "")
        .otherwise(F.col("o_totalprice").cast("string"))
        .alias("price"),
    )
    return cleaning.coerce_numbers(text, ["price"])


@query("preview", "SELECT * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice LIMIT 100")
def preview_rows(spark, sf):
    return preview(
        load(spark, sf, "lineitem"),
        ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"],
    )


def _domain_sql() -> str:
    from ..functions.vocabulary import DOMAIN_KEYWORDS

    words = ", ".join(
        f"({i}, {quoted(d)}, {quoted(k)})"
        for i, (d, ks) in enumerate(DOMAIN_KEYWORDS.items())
        for k in ks
    )
    named = union_all(
        [
            f"SELECT {quoted(t)} AS table_name, {quoted(' '.join(columns_of(t)))} AS names, "
            f"count(*) AS row_count FROM {t}"
            for t in TABLES
        ]
    )
    return f"""WITH k(i, domain, keyword) AS (VALUES {words}), t AS ({named}),
    s AS (SELECT table_name, i, domain, count(*) AS score FROM t JOIN k ON contains(names, keyword)
          GROUP BY ALL),
    best AS (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY score DESC, i) AS r FROM s)
    """


DOMAIN_SQL = _domain_sql()


@query(
    "domain_scores",
    DOMAIN_SQL + """SELECT table_name, row_count, domain, score FROM t JOIN s USING (table_name)""",
)
def domain_hits(spark, sf):
    summaries = table_summaries({t: load(spark, sf, t) for t in TABLES})
    hits = domain_scores(summaries).select("table_name", "domain", "score")
    return summaries.select("table_name", "row_count").join(hits, "table_name")


@query(
    "domain_primary",
    DOMAIN_SQL
    + """SELECT t.table_name, t.row_count, coalesce(domain, 'general') AS domain,
           least(1.0, coalesce(score, 0) / 4.0)::DOUBLE AS confidence
    FROM t LEFT JOIN best ON t.table_name = best.table_name AND r = 1""",
)
def domains(spark, sf):
    summaries = table_summaries({t: load(spark, sf, t) for t in TABLES})
    return rounded(
        summaries.select("table_name", "row_count").join(infer_domain(summaries), "table_name")
    )
