"""Queries on findings, the overview and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..operators import profile
from ..operators.cube import moment_cube
from ..plans import answers, findings
from ..session import scratch_path
from ..sources.sinks import export_blocks
from . import series
from .registry import ORACLES, load, query, quoted, rounded, union_all

# Line items with a derived measure and a tax that is missing in four rows of ten.
SALES_SQL = """(SELECT l_returnflag, l_shipdate, l_quantity, l_extendedprice,
    l_extendedprice * (1 - l_discount) AS net, CASE WHEN l_orderkey % 10 >= 4 THEN l_tax END AS l_tax
    FROM lineitem)"""
SALES = ("l_quantity", "l_extendedprice", "net", "l_tax")


def _sales(spark, sf):
    return load(spark, sf, "lineitem").select(
        "l_returnflag",
        "l_shipdate",
        "l_quantity",
        "l_extendedprice",
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
        F.when(F.col("l_orderkey") % 10 >= 4, F.col("l_tax")).alias("l_tax"),
    )


def _few_sql(source: str, key: str, value: str) -> str:
    return f"""(SELECT count(*) FILTER (c <= 80) AS few FROM (
        SELECT sum(v) OVER (ORDER BY v DESC, k ROWS UNBOUNDED PRECEDING) / sum(v) OVER () * 100 AS c
        FROM (SELECT {key} AS k, sum({value}) AS v FROM {source} GROUP BY 1)))"""


def _pairs_sql(source: str, measures) -> str:
    complete = " AND ".join(f"{m} IS NOT NULL" for m in measures)
    return (
        "(SELECT *, row_number() OVER (ORDER BY abs(r) DESC, i, j) AS place FROM ("
        + union_all(
            [
                f"SELECT {i} AS i, {j} AS j, {quoted(a)} AS a, {quoted(b)} AS b, "
                f"round(covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})), 3) AS r "
                f"FROM {source} WHERE {complete}"
                for i, a in enumerate(measures)
                for j, b in enumerate(measures)
                if i < j
            ]
        )
        + ") WHERE abs(r) >= 0.6)"
    )


def _months_sql(source: str, ts: str, measures) -> str:
    """Per measure the last two months: c(ordinal, name, c)."""
    return "(" + union_all(
        [
            f"""SELECT {i} AS ordinal, {quoted(m)} AS name, round(CASE WHEN p <> 0 THEN (y - p) / abs(p) * 100 END, 2) AS c
            FROM (SELECT coalesce(y, 0) AS y, lag(coalesce(y, 0)) OVER (ORDER BY x) AS p,
                  row_number() OVER (ORDER BY x DESC) AS back FROM
                (SELECT unnest(generate_series(min(date_trunc('month', {ts})),
                        max(date_trunc('month', {ts})), INTERVAL 1 MONTH))::DATE AS x FROM {source})
                LEFT JOIN (SELECT date_trunc('month', {ts})::DATE AS x, sum({m}) AS y
                           FROM {source} GROUP BY 1) USING (x)) WHERE back = 1"""
            for i, m in enumerate(measures[: V.KPI_MEASURES])
        ]
    ) + ")"


def _out_sql(source: str, measure: str) -> str:
    return f"""(SELECT count(*) AS n FROM {source},
        (SELECT avg({measure}) AS m, stddev_samp({measure}) AS s FROM {source})
        WHERE abs(({measure} - m) / s) > 3)"""


def _insights_sql(source, columns, measures, measure, dimension, ts, limit=8) -> str:
    first_empty = union_all(
        [
            f"SELECT {i} AS i, {quoted(c)} AS c, round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS p "
            f"FROM {source}"
            for i, c in enumerate(columns)
        ]
    )
    return f"""SELECT rank::INTEGER AS rank, kind, subject, metric, message FROM (
    SELECT 1 AS rank, 'duplicates' AS kind, 'rows' AS subject, d::DOUBLE AS metric,
        printf('%d duplicate rows found; remove them before reporting.', d) AS message
    FROM (SELECT (sum(n) - count(*))::BIGINT AS d
          FROM (SELECT count(*) AS n FROM {source} GROUP BY {', '.join(columns)})) WHERE d > 0
    UNION ALL
    SELECT 2, 'missing', c, p, printf('%s is missing in %.2f%% of the rows.', c, p)
    FROM (SELECT * FROM ({first_empty}) WHERE p > 30 ORDER BY i LIMIT 1)
    UNION ALL
    SELECT 10 + ordinal, 'kpi_change', name, c, printf('%s %s by %.2f%% against the month before.', name,
        CASE WHEN c > 0 THEN 'increased' ELSE 'decreased' END, abs(c))
    FROM {_months_sql(source, ts, measures)} WHERE c IS NOT NULL
    UNION ALL
    SELECT 20, 'vital_few', '{dimension}', few, printf('%d values of {dimension} make up 80%% of {measure}.', few)
    FROM {_few_sql(source, dimension, measure)} WHERE few > 0
    UNION ALL
    SELECT 29 + place, 'strong_pair', a || ',' || b, r, printf('%s and %s %s (r=%.3f).', a, b,
        CASE WHEN r > 0 THEN 'rise together' ELSE 'move against each other' END, r)
    FROM {_pairs_sql(source, measures)} WHERE place <= 2
    UNION ALL
    SELECT 40, 'anomalies', '{measure}', n, printf('%d values of {measure} lie more than 3 deviations out.', n)
    FROM {_out_sql(source, measure)} WHERE n > 0) ORDER BY rank LIMIT {limit}"""


SALES_COLUMNS = ("l_returnflag", "l_shipdate", "l_quantity", "l_extendedprice", "net", "l_tax")


@query(
    "insights",
    _insights_sql(SALES_SQL, SALES_COLUMNS, SALES, "net", "l_returnflag", "l_shipdate"),
)
def insights(spark, sf):
    return rounded(
        findings.insights(_sales(spark, sf), list(SALES), "net", "l_returnflag", "l_shipdate")
    )


def _recommendations_sql(source, measures, measure, dimension, ts, domain) -> str:
    advice = findings.DOMAIN_ADVICE.get(domain)
    told = (
        f"UNION ALL SELECT 20, 'domain', {quoted(domain)}, NULL, {quoted(advice)}" if advice else ""
    )
    return f"""SELECT * FROM (
    SELECT 1::INTEGER AS rank, 'vital_few' AS kind, '{dimension}' AS subject, few::DOUBLE AS metric,
        printf('Look after the first %d values of {dimension}: they carry most of {measure}.', few) AS message
    FROM {_few_sql(source, dimension, measure)} WHERE few > 0
    UNION ALL
    SELECT 10 + ordinal, 'decline', name, c, printf('Find out why %s fell (%.2f%%): price, channel or campaign.',
        name, c) FROM {_months_sql(source, ts, measures)} WHERE c < -5 {told}) ORDER BY rank LIMIT 6"""


@query(
    "recommendations",
    _recommendations_sql(SALES_SQL, SALES, "net", "l_returnflag", "l_shipdate", "finance"),
)
def recommendations(spark, sf):
    return rounded(
        findings.recommendations(
            _sales(spark, sf), list(SALES), "net", "l_returnflag", "l_shipdate", "finance"
        )
    )


# --- orders, with the columns its profile suggests ---------------------------------

ORDER_MEASURES = ("o_orderkey", "o_custkey", "o_totalprice")
ORDER_SOURCE = "orders"


def _roles(spark, sf) -> profile.Roles:
    return profile.roles_of(profile.column_profile(load(spark, sf, "orders")))


def _answer(spark, sf, op, **asked):
    return answers.answer(
        load(spark, sf, "orders"), _roles(spark, sf), op, row_key="o_orderkey", **asked
    )


BY_PRIORITY = """SELECT o_orderpriority, round(sum(o_totalprice), 2) AS o_totalprice FROM orders
    GROUP BY o_orderpriority"""


@query("answer_top", BY_PRIORITY + " ORDER BY sum(o_totalprice) DESC, o_orderpriority LIMIT 3")
def answer_top(spark, sf):
    blocks = _answer(spark, sf, "top", measure="o_totalprice", dimension="o_orderpriority", n=3)
    return rounded(blocks["top"], 2)


@query(
    "answer_bottom",
    """SELECT o_orderpriority, round(sum(o_totalprice), 2) AS o_totalprice FROM orders
    WHERE o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1998-01-01' AND o_orderstatus = 'F'
    GROUP BY o_orderpriority ORDER BY sum(o_totalprice), o_orderpriority LIMIT 2""",
)
def answer_bottom(spark, sf):
    blocks = _answer(
        spark, sf, "top", dimension="o_orderpriority", n=2, ascending=True,
        active_filters=[
            {"column": "o_orderdate", "op": "year_eq", "value": 1997},
            {"column": "o_orderstatus", "op": "eq", "value": "f"},
        ],
    )
    return rounded(blocks["top"], 2)


@query(
    "answer_nth",
    f"""SELECT 2::BIGINT AS position, o_orderpriority, o_totalprice FROM (
    {BY_PRIORITY} ORDER BY sum(o_totalprice) DESC, o_orderpriority LIMIT 1 OFFSET 1)""",
)
def answer_nth(spark, sf):
    return rounded(_answer(spark, sf, "nth", dimension="o_orderpriority", nth_index=2)["nth"], 2)


@query("answer_trend", f"WITH {series.ORDERS_SPINE} {series.TREND_SQL}")
def answer_trend(spark, sf):
    result = rounded(_answer(spark, sf, "trend")["trend"])
    return result.withColumn("y", F.round("y", 2))


ALL_ORDERS_SQL = series.FULL_SQL.replace("o_orderpriority AS k", "'all' AS k")


@query(
    "answer_forecast",
    f"""{ALL_ORDERS_SQL} SELECT 'history' AS kind, x, round(y, 2) AS y, model AS method
    FROM pts JOIN chosen ON pts.k = chosen.k
    UNION ALL
    SELECT 'forecast', (last_x + to_months(h::INTEGER))::DATE, round(a.y, 2), c.model
    FROM ahead a JOIN chosen c ON a.k = c.k AND a.model = c.model JOIN ser ON ser.k = a.k
    WHERE part = 'full'""",
)
def answer_forecast(spark, sf):
    return rounded(_answer(spark, sf, "forecast", periods=series.HORIZON)["forecast"], 2)


@query("answer_yoy", ORACLES["yoy_compare"])
def answer_yoy(spark, sf):
    compare = [{"column": "o_orderdate", "op": "compare_yoy", "value": None}]
    return rounded(_answer(spark, sf, "summary", measure="o_totalprice", active_filters=compare)["yoy"], 2)


@query(
    "answer_anomaly",
    """WITH s AS (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders)
    SELECT 'o_totalprice' AS measure, round(m, 2) AS mean, round(s, 2) AS std, 3.0::DOUBLE AS threshold_z,
        (SELECT count(*) FROM orders WHERE abs((o_totalprice - m) / s) > 3) AS count FROM s""",
)
def answer_anomaly(spark, sf):
    return _answer(spark, sf, "anomaly")["anomaly_summary"]


@query(
    "answer_correlation",
    union_all(
        [
            f"SELECT {i}::INTEGER AS \"row\", {j}::INTEGER AS col, {quoted(a)} AS a, {quoted(b)} AS b, "
            f"round(covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})), 3) AS r FROM orders"
            for i, a in enumerate(ORDER_MEASURES)
            for j, b in enumerate(ORDER_MEASURES)
        ]
    ),
)
def answer_correlation(spark, sf):
    return _answer(spark, sf, "correlation")["correlation"]


@query(
    "answer_fallback",
    """SELECT o_orderstatus, round(sum(o_totalprice), 2) AS o_totalprice FROM orders
    GROUP BY o_orderstatus ORDER BY sum(o_totalprice) DESC, o_orderstatus LIMIT 10""",
)
def answer_fallback(spark, sf):
    return rounded(_answer(spark, sf, "summary")["top"], 2)


ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
ORDER_INSIGHTS = _insights_sql(
    "orders", ORDER_COLUMNS, ORDER_MEASURES, "o_totalprice", "o_orderstatus", "o_orderdate"
)
ORDER_ADVICE = _recommendations_sql(
    "orders", ORDER_MEASURES, "o_totalprice", "o_orderstatus", "o_orderdate", "sales"
)


@query("answer_insights", ORDER_INSIGHTS)
def answer_insights(spark, sf):
    return rounded(_answer(spark, sf, "insights")["insights"])


@query(
    "overview_blocks",
    f"""WITH months AS (SELECT (date_diff('month', min(o_orderdate), max(o_orderdate)) + 1)::BIGINT AS n FROM orders)
    SELECT 'kpis' AS block, 3::BIGINT AS rows
    UNION ALL SELECT 'trend', n FROM months
    UNION ALL SELECT 'top', least(10, count(DISTINCT o_orderstatus)) FROM orders
    UNION ALL SELECT 'pareto', least(50, count(DISTINCT o_orderstatus)) FROM orders
    UNION ALL SELECT 'correlation', 9
    UNION ALL SELECT 'strong_pairs', count(*) FROM {_pairs_sql('orders', ORDER_MEASURES)}
    UNION ALL SELECT 'histogram', 20
    UNION ALL SELECT 'anomalies', least(50, n) FROM {_out_sql('orders', 'o_totalprice')}
    UNION ALL SELECT 'anomaly_summary', 1
    UNION ALL SELECT 'missing', 0
    UNION ALL SELECT 'quality', 1
    UNION ALL SELECT 'slicers', least(50, count(DISTINCT o_orderstatus))
        + least(50, count(DISTINCT o_orderpriority)) FROM orders
    UNION ALL SELECT 'slicer_dates', 1
    UNION ALL SELECT 'drill_time', count(*) FROM (SELECT 1 FROM (SELECT year(o_orderdate) AS y,
        quarter(o_orderdate) AS q, month(o_orderdate) AS m FROM orders) GROUP BY ROLLUP (y, q, m))
    UNION ALL SELECT 'insights', count(*) FROM ({ORDER_INSIGHTS})
    UNION ALL SELECT 'recommendations', count(*) FROM ({ORDER_ADVICE})""",
)
def overview_blocks(spark, sf):
    orders = load(spark, sf, "orders")
    blocks = answers.overview(orders, _roles(spark, sf), "o_orderkey", domain="sales")
    return answers.overview_blocks(blocks)


@query(
    "overview_cells",
    """SELECT grouping(x, s, p) AS grain, x, s AS status, p AS priority, min(day) AS lo, max(day) AS hi,
        count(*) AS n, round(sum(price), 2) AS price, count(price) AS prices, sum(customer) AS customer
    FROM (SELECT date_trunc('month', o_orderdate)::DATE AS x, o_orderdate::DATE AS day, o_orderstatus AS s,
        o_orderpriority AS p, CASE WHEN o_orderkey % 10 < 7 THEN o_totalprice END AS price,
        o_custkey::DOUBLE AS customer FROM orders)
    GROUP BY GROUPING SETS ((x, s), (s), (p))""",
)
def overview_cells(spark, sf):
    priced = F.when(F.col("o_orderkey") % 10 < 7, F.col("o_totalprice"))
    orders = load(spark, sf, "orders").withColumn("o_totalprice", priced)
    slicers = ["o_orderstatus", "o_orderpriority"]
    cells = moment_cube(orders, ["o_totalprice", "o_custkey"], slicers[0], "o_orderdate", slicers).cells
    names = {"k0": "status", "k1": "priority", "s0": "price", "c0": "prices", "s1": "customer"}
    return rounded(cells.drop("c1").withColumnsRenamed(names), 2)


@query(
    "overview_export",
    f"""WITH {series.ORDERS_SPINE} {series.TREND_SQL}""",
)
def overview_export(spark, sf):
    orders = load(spark, sf, "orders")
    blocks = answers.overview(
        orders, _roles(spark, sf), "o_orderkey", only=("kpis", "trend", "top")
    )
    paths = export_blocks(blocks, scratch_path(spark, "overview"))
    trend = spark.read.schema("x date, y double, moving_avg double").json(paths["trend"])
    return rounded(trend).withColumn("y", F.round("y", 2))


@query(
    "table_profile",
    """SELECT 'orders' AS name, count(*) AS row_count, 13::INTEGER AS column_count, 'sales' AS domain,
        0.25::DOUBLE AS confidence, 100.0::DOUBLE AS quality_score, 'o_totalprice' AS measure,
        'o_orderstatus' AS dimension, 'o_orderdate' AS date_column FROM orders""",
)
def table_profile(spark, sf):
    found = answers.profile_table(load(spark, sf, "orders"), "orders")
    return (
        found.table.agg(F.count(F.lit(1)).alias("row_count"))
        .select(
            F.lit(found.name).alias("name"),
            "row_count",
            F.lit(len(found.table.columns)).alias("column_count"),
            F.lit(found.roles.measure).alias("measure"),
            F.lit(found.roles.dimension).alias("dimension"),
            F.lit(found.roles.date).alias("date_column"),
            found.quality().select("quality_score").scalar().alias("quality_score"),
        )
        .join(found.domain, F.col("name") == F.col("table_name"))
        .drop("table_name")
    )


# --- findings on one answer -----------------------------------------------------------


@query(
    "query_insights",
    """WITH t AS (SELECT o_custkey, sum(o_totalprice) AS v FROM orders GROUP BY o_custkey
               ORDER BY v DESC, o_custkey LIMIT 10),
    r AS (SELECT *, row_number() OVER (ORDER BY v DESC, o_custkey) AS place FROM t)
    SELECT 1::INTEGER AS rank, 'leader' AS kind, o_custkey::VARCHAR AS subject, round(v, 2) AS metric,
        printf('%s has the highest o_totalprice (%.2f).', o_custkey::VARCHAR, v) AS message
    FROM r WHERE place = 1
    UNION ALL
    SELECT 2, 'top3_share', 'o_custkey', round(s, 2),
        printf('The first three make up %.1f%% of the total shown.', s)
    FROM (SELECT sum(v) FILTER (place <= 3) / sum(v) * 100 AS s FROM r)""",
)
def query_insights(spark, sf):
    orders = load(spark, sf, "orders")
    shown = answers.answer(
        orders, _roles(spark, sf), "top", measure="o_totalprice", dimension="o_custkey"
    )["top"]
    found = findings.query_insights(
        orders, "top", shown, list(ORDER_MEASURES), "o_totalprice", "o_custkey", "o_orderdate"
    )
    return rounded(found, 2)


@query(
    "query_insights_trend",
    f"""WITH {series.ORDERS_SPINE}, {series.CHANGE_SQL},
    c AS (SELECT *, (last_y - first_y) / abs(first_y) * 100 AS c FROM e)
    SELECT 1::INTEGER AS rank, 'series_change' AS kind, 'o_totalprice' AS subject, round(c, 2) AS metric,
        printf('o_totalprice changed by %+.1f%% from %s to %s.', c, first_x::VARCHAR, last_x::VARCHAR) AS message
    FROM c""",
)
def query_insights_trend(spark, sf):
    orders = load(spark, sf, "orders")
    shown = _answer(spark, sf, "trend")["trend"]
    found = findings.query_insights(
        orders, "trend", shown, list(ORDER_MEASURES), "o_totalprice", "o_orderstatus", "o_orderdate"
    )
    return rounded(found, 2)


@query(
    "query_insights_anomaly",
    f"""SELECT 1::INTEGER AS rank, 'anomalies' AS kind, 'value' AS subject, n::DOUBLE AS metric,
        CASE WHEN n > 0 THEN printf('%d values of value lie more than 3 deviations out.', n)
             ELSE 'No value of value lies more than 3 deviations out.' END AS message
    FROM {_out_sql('events', 'value')}""",
)
def query_insights_anomaly(spark, sf):
    events = load(spark, sf, "events")
    return findings.query_insights(
        events, "anomaly", events, ["user_id", "value"], "value", "event_type", "ts"
    )


@query(
    "query_insights_correlation",
    f"""SELECT 1::INTEGER AS rank, 'strong_pair' AS kind, a || ',' || b AS subject, r AS metric,
        printf('The clearest pair: %s and %s %s (r=%.3f).', a, b,
            CASE WHEN r > 0 THEN 'rise together' ELSE 'move against each other' END, r) AS message
    FROM {_pairs_sql(SALES_SQL, SALES)} WHERE place = 1""",
)
def query_insights_correlation(spark, sf):
    sales = _sales(spark, sf)
    return findings.query_insights(
        sales, "correlation", sales, list(SALES), "net", "l_returnflag", "l_shipdate"
    )


@query(
    "query_insights_forecast",
    f"""{ALL_ORDERS_SQL}, f AS (SELECT a.h, a.y FROM ahead a JOIN chosen c ON a.k = c.k AND a.model = c.model
        WHERE part = 'full'),
    c AS (SELECT (arg_max(y, h) - arg_min(y, h)) / abs(arg_min(y, h)) * 100 AS c FROM f)
    SELECT 1::INTEGER AS rank, 'forecast_change' AS kind, 'o_totalprice' AS subject, round(c, 2) AS metric,
        printf('o_totalprice is set to %s by about %.1f%%.', CASE WHEN c > 0 THEN 'grow' ELSE 'decline' END,
            abs(c)) AS message FROM c""",
)
def query_insights_forecast(spark, sf):
    orders = load(spark, sf, "orders")
    shown = _answer(spark, sf, "forecast", periods=series.HORIZON)["forecast"]
    found = findings.query_insights(
        orders, "forecast", shown, list(ORDER_MEASURES), "o_totalprice", "o_orderstatus", "o_orderdate"
    )
    return rounded(found, 2)
