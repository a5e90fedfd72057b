"""Queries on filters, aggregates, rankings and contribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate, contribution, distribution, filters, kpi, ranking, value_index
from ..session import scratch_path
from .registry import load, query, quoted, rounded, union_all

# --- filters and slicers --------------------------------------------------------


@query("filter_year", "SELECT * FROM orders WHERE year(o_orderdate) = 1997")
def filter_year(spark, sf):
    orders = load(spark, sf, "orders")
    return orders.where(filters.year_equals(orders, "o_orderdate", 1997))


@query("filter_eq", "SELECT * FROM customer WHERE lower(c_mktsegment) = 'building'")
def filter_eq(spark, sf):
    return load(spark, sf, "customer").where(filters.text_equals("c_mktsegment", "Building"))


@query(
    "filter_neq",
    """SELECT c_custkey, segment FROM (SELECT c_custkey,
        CASE WHEN c_custkey % 6 <> 0 THEN c_mktsegment END AS segment FROM customer)
    WHERE segment IS NULL OR lower(segment) <> 'building'""",
)
def filter_neq(spark, sf):
    customers = load(spark, sf, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 6 != 0, F.col("c_mktsegment")).alias("segment")
    )
    return customers.where(filters.text_differs("segment", "BUILDING"))


@query(
    "filter_chain",
    """SELECT * FROM orders WHERE year(o_orderdate) = 1998 AND lower(o_orderstatus) = 'f'
    AND lower(o_orderpriority) <> '5-low'""",
)
def filter_chain(spark, sf):
    return filters.apply_filters(
        load(spark, sf, "orders"),
        [
            {"column": "o_orderdate", "op": "year_eq", "value": 1998},
            {"column": "o_orderstatus", "op": "eq", "value": "f"},
            {"column": "no_such_column", "op": "eq", "value": "x"},
            {"column": "o_orderpriority", "op": "neq", "value": "5-LOW"},
            {"column": "o_orderdate", "op": "compare_yoy", "value": None},
        ],
    )


@query(
    "filter_contains",
    "SELECT * FROM part WHERE regexp_matches(lower(p_name), 'red|blue') "
    "AND regexp_matches(lower(p_brand), '#1')",
)
def filter_contains(spark, sf):
    return filters.filter_contains(
        load(spark, sf, "part"), {"p_name": "RED|Blue", "p_brand": "#1", "gone": "x"}
    )


@query("filter_contains_literal", "SELECT * FROM orders WHERE contains(lower(o_orderpriority), '4-not')")
def filter_contains_literal(spark, sf):
    return filters.filter_contains(
        load(spark, sf, "orders"), {"o_orderpriority": "4-NOT"}, literal=True
    )


LOOKUP_SQL = """WITH l AS (SELECT DISTINCT p_type AS literal FROM part UNION SELECT DISTINCT lower(p_brand) FROM part
               UNION SELECT DISTINCT p_name FROM part UNION SELECT c_mktsegment FROM customer),
    v AS (SELECT 0 AS i, 'p_name' AS c, lower(p_name) AS v FROM part
          UNION ALL SELECT 1, 'p_brand', lower(p_brand) FROM part
          UNION ALL SELECT 2, 'p_type', lower(p_type) FROM part)
    SELECT literal, arg_min(c, i) AS "column" FROM l JOIN v ON lower(literal) = v GROUP BY literal"""


def _asked(spark, sf):
    return (
        load(spark, sf, "part").select(F.inline(F.array(*[F.struct(c.alias("literal")) for c in (
            F.col("p_type"), F.lower("p_brand"), F.col("p_name"))])))
        .unionByName(load(spark, sf, "customer").select(F.col("c_mktsegment").alias("literal")))
    )


@query("literal_lookup", LOOKUP_SQL)
def literal_lookup(spark, sf):
    return filters.literal_lookup(load(spark, sf, "part"), ["p_name", "p_brand", "p_type"], _asked(spark, sf))


@query("value_dictionary", LOOKUP_SQL)
def value_dictionary(spark, sf):
    """The same look-up through a stored dictionary, built in two steps: a column that comes later is added."""
    source, index = f"{sf}/part.parquet", scratch_path(spark, "value-index")
    for dimensions in (["p_brand", "p_type"], ["p_name", "p_brand", "p_type"]):
        value_index.update(spark, source, index, dimensions)
    return value_index.lookup(spark, source, index, ["p_name", "p_brand", "p_type"], _asked(spark, sf))


@query(
    "slicer_values",
    """SELECT ordinal, "column", place::INTEGER AS place, value, rows FROM (
        SELECT *, row_number() OVER (PARTITION BY ordinal ORDER BY rows DESC, value) AS place FROM ("""
    + union_all(
        [
            f"SELECT {i}::INTEGER AS ordinal, {quoted(c)} AS \"column\", {c} AS value, count(*) AS rows "
            f"FROM events WHERE {c} IS NOT NULL GROUP BY {c}"
            for i, c in enumerate(("event_type", "props"))
        ]
    )
    + ")) WHERE place <= 50",
)
def slicer_values(spark, sf):
    return filters.slicer_values(load(spark, sf, "events"), ["event_type", "props"])


@query(
    "slicer_dates",
    "SELECT 'ts' AS \"column\", min(ts)::DATE AS min, max(ts)::DATE AS max FROM events",
)
def slicer_dates(spark, sf):
    return filters.slicer_dates(load(spark, sf, "events"), "ts")


# --- group-by -------------------------------------------------------------------

GROUPED = {
    "sum": "round(sum(o_totalprice), 2)",
    "mean": "round(avg(o_totalprice), 6)",
    "count": "count(o_totalprice)",
    "min": "min(o_totalprice)",
    "max": "max(o_totalprice)",
    "median": "round(quantile_cont(o_totalprice, 0.5), 6)",
    "std": "round(stddev_samp(o_totalprice), 4)",
    "var": "round(var_samp(o_totalprice), 0)",
    "nunique": "count(DISTINCT o_totalprice)",
    "first": "arg_min(o_totalprice, o_orderkey)",
    "last": "arg_max(o_totalprice, o_orderkey)",
}
DIGITS = {"sum": 2, "std": 4, "var": 0}


def _register_group(func: str, expression: str) -> None:
    sql = f"""SELECT o_custkey, {expression} AS {func}_o_totalprice FROM (
        SELECT o_orderkey, CASE WHEN o_custkey % 50 <> 0 THEN o_custkey END AS o_custkey,
               CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice END AS o_totalprice FROM orders)
    WHERE o_custkey IS NOT NULL GROUP BY o_custkey"""
    if func == "sum":
        sql = sql.replace("sum(o_totalprice)", "coalesce(sum(o_totalprice), 0)")

    @query(f"group_{func}", sql)
    def grouped(spark, sf):
        orders = load(spark, sf, "orders").select(
            "o_orderkey",
            F.when(F.col("o_custkey") % 50 != 0, F.col("o_custkey")).alias("o_custkey"),
            F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice")).alias("o_totalprice"),
        )
        result = aggregate.aggregate_by(orders, "o_custkey", "o_totalprice", func, "o_orderkey")
        return rounded(result, DIGITS.get(func, 6))


for _func, _expression in GROUPED.items():
    _register_group(_func, _expression)


# --- KPI ------------------------------------------------------------------------

KPI = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    "kpi_totals",
    union_all(
        [
            f"SELECT {i}::INTEGER AS ordinal, {quoted(m)} AS name, round(sum({m}), 2) AS value, "
            f"round(sum({m}) / count({m}), 2) AS avg, count({m}) AS count FROM lineitem"
            for i, m in enumerate(KPI)
        ]
    ),
)
def kpi_totals(spark, sf):
    return kpi.kpi_totals(load(spark, sf, "lineitem"), list(KPI))


ALL_NUMBERS = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
)


@query(
    "kpi_all_measures",
    union_all(
        [
            f"SELECT {i}::INTEGER AS ordinal, {quoted(m)} AS name, round(sum({m}::DOUBLE), 2) AS value, "
            f"round(sum({m}::DOUBLE) / count({m}), 2) AS avg, count({m}) AS count FROM lineitem"
            for i, m in enumerate(ALL_NUMBERS)
        ]
    ),
)
def kpi_all_measures(spark, sf):
    return kpi.kpi_totals(load(spark, sf, "lineitem"), list(ALL_NUMBERS))


def _months_sql(measures) -> str:
    return "months AS (" + union_all(
        [
            f"""SELECT {i}::INTEGER AS ordinal, {quoted(m)} AS name, x, coalesce(y, 0) AS y FROM
            (SELECT unnest(generate_series(min(date_trunc('month', l_shipdate)),
                    max(date_trunc('month', l_shipdate)), INTERVAL 1 MONTH))::DATE AS x FROM lineitem)
            LEFT JOIN (SELECT date_trunc('month', l_shipdate)::DATE AS x, sum({m}) AS y
                       FROM lineitem GROUP BY 1) USING (x)"""
            for i, m in enumerate(measures)
        ]
    ) + "), ranked AS (SELECT *, row_number() OVER (PARTITION BY ordinal ORDER BY x DESC) AS back FROM months)"


CHANGE_SQL = """changed AS (SELECT ordinal, name, max(y) FILTER (back = 1) AS current,
    max(y) FILTER (back = 2) AS previous FROM ranked GROUP BY ordinal, name),
    pct AS (SELECT *, CASE WHEN previous <> 0 THEN (current - previous) / abs(previous) * 100 END AS c
            FROM changed)"""
TREND_SQL = "CASE WHEN c > 1 THEN 'up' WHEN c < -1 THEN 'down' ELSE 'stable' END"


@query(
    "kpi_change",
    f"""WITH {_months_sql(KPI)}, {CHANGE_SQL}
    SELECT ordinal, name, round(current, 2) AS current, round(previous, 2) AS previous,
           round(c, 2) AS change_pct, {TREND_SQL} AS trend FROM pct""",
)
def kpi_change(spark, sf):
    return rounded(kpi.kpi_change(load(spark, sf, "lineitem"), list(KPI), "l_shipdate"), 2)


@query(
    "kpi_sparkline",
    f"WITH {_months_sql(KPI)} SELECT ordinal, name, x, round(y, 2) AS y FROM ranked WHERE back <= 12",
)
def kpi_sparkline(spark, sf):
    return rounded(kpi.kpi_sparkline(load(spark, sf, "lineitem"), list(KPI), "l_shipdate"), 2)


@query(
    "kpi_summary",
    f"""WITH {_months_sql(KPI)}, {CHANGE_SQL}, totals AS ({{totals}})
    SELECT ordinal, t.name, value, avg, count, round(c, 2) AS change_pct, {TREND_SQL} AS trend,
        (SELECT string_agg(strftime(x, '%Y-%m-%d') || '=' || round(y, 0)::BIGINT, ' ' ORDER BY x)
         FROM ranked r WHERE r.ordinal = t.ordinal AND back <= 12) AS sparkline
    FROM totals t JOIN pct USING (ordinal)""".replace(
        "{totals}",
        union_all(
            [
                f"SELECT {i}::INTEGER AS ordinal, {quoted(m)} AS name, round(sum({m}), 2) AS value, "
                f"round(sum({m}) / count({m}), 2) AS avg, count({m}) AS count FROM lineitem"
                for i, m in enumerate(KPI)
            ]
        ),
    ),
)
def kpi_summary(spark, sf):
    cards = kpi.kpi_summary(load(spark, sf, "lineitem"), list(KPI), "l_shipdate")
    points = F.transform(
        "sparkline",
        lambda p: F.concat(
            p["x"].cast("string"), F.lit("="), F.round(p["y"], 0).cast("bigint").cast("string")
        ),
    )
    return cards.withColumn("sparkline", F.array_join(points, " "))


# --- ranking --------------------------------------------------------------------

RANKED_SQL = """SELECT o_custkey, round(sum(o_totalprice), 2) AS o_totalprice
    FROM orders GROUP BY o_custkey"""


@query("top_n", RANKED_SQL + " ORDER BY sum(o_totalprice) DESC, o_custkey LIMIT 10")
def top_n(spark, sf):
    return rounded(ranking.top_n(load(spark, sf, "orders"), "o_custkey", "o_totalprice"), 2)


@query("bottom_n", RANKED_SQL + " ORDER BY sum(o_totalprice), o_custkey LIMIT 10")
def bottom_n(spark, sf):
    return rounded(ranking.bottom_n(load(spark, sf, "orders"), "o_custkey", "o_totalprice"), 2)


@query(
    "nth_ranked",
    f"""SELECT 5::BIGINT AS position, o_custkey, o_totalprice FROM (
    {RANKED_SQL} ORDER BY sum(o_totalprice) DESC, o_custkey LIMIT 1 OFFSET 4)""",
)
def nth_ranked(spark, sf):
    return rounded(ranking.nth_ranked(load(spark, sf, "orders"), "o_custkey", "o_totalprice", 5), 2)


@query(
    "nth_out_of_range",
    """SELECT 20::BIGINT AS requested, count(DISTINCT event_type) AS available,
        20 <= count(DISTINCT event_type) AS found FROM events""",
)
def nth_out_of_range(spark, sf):
    return ranking.rank_availability(load(spark, sf, "events"), "event_type", "value", 20)


@query(
    "top3_share",
    """WITH t AS (SELECT o_custkey, sum(o_totalprice) AS v FROM orders GROUP BY o_custkey
               ORDER BY v DESC, o_custkey LIMIT 10),
    r AS (SELECT *, row_number() OVER (ORDER BY v DESC, o_custkey) AS place FROM t)
    SELECT max(o_custkey::VARCHAR) FILTER (place = 1) AS leader, round(max(v), 4) AS leader_value,
        round(sum(v) FILTER (place <= 3) / sum(v) * 100, 4) AS top3_share, count(*) AS shown FROM r""",
)
def top3_share(spark, sf):
    return rounded(ranking.top3_share(load(spark, sf, "orders"), "o_custkey", "o_totalprice"))


# --- contribution -----------------------------------------------------------------

PARETO_SQL = """g AS (SELECT o_custkey, sum(o_totalprice) AS v FROM orders GROUP BY o_custkey),
    r AS (SELECT row_number() OVER w AS position, o_custkey, v,
          sum(v) OVER (w ROWS UNBOUNDED PRECEDING) / sum(v) OVER () * 100 AS cum_pct,
          sum(v) OVER () AS total FROM g WINDOW w AS (ORDER BY v DESC, o_custkey)),
    p AS (SELECT *, CASE WHEN cum_pct <= 70 THEN 'A' WHEN cum_pct <= 90 THEN 'B' ELSE 'C' END AS abc FROM r)"""


def _pareto(spark, sf):
    return contribution.pareto(load(spark, sf, "orders"), "o_custkey", "o_totalprice")


@query(
    "pareto",
    f"""WITH {PARETO_SQL} SELECT position, o_custkey, round(v, 2) AS o_totalprice,
    round(total, 2) AS total, round(cum_pct, 6) AS cum_pct, abc FROM p""",
)
def pareto(spark, sf):
    result = rounded(_pareto(spark, sf), 6)
    return result.withColumn("o_totalprice", F.round("o_totalprice", 2)).withColumn(
        "total", F.round("total", 2)
    )


@query(
    "pareto_ranges",
    """WITH g AS (SELECT l_partkey, sum(l_quantity) AS v FROM lineitem GROUP BY l_partkey),
    r AS (SELECT row_number() OVER w AS position, l_partkey, v, sum(v) OVER () AS total,
          sum(v) OVER (w ROWS UNBOUNDED PRECEDING) / sum(v) OVER () * 100 AS cum_pct
          FROM g WINDOW w AS (ORDER BY v DESC, l_partkey))
    SELECT position, l_partkey, v AS l_quantity, total, round(cum_pct, 6) AS cum_pct,
        CASE WHEN cum_pct <= 70 THEN 'A' WHEN cum_pct <= 90 THEN 'B' ELSE 'C' END AS abc FROM r""",
)
def pareto_ranges(spark, sf):
    return rounded(contribution.pareto(load(spark, sf, "lineitem"), "l_partkey", "l_quantity"), 6)


@query(
    "abc_class",
    f"WITH {PARETO_SQL} SELECT abc, count(*) AS groups, round(sum(v), 2) AS class_value FROM p GROUP BY abc",
)
def abc_class(spark, sf):
    return rounded(contribution.abc_classes(_pareto(spark, sf)), 2)


@query(
    "vital_few",
    f"""WITH {PARETO_SQL} SELECT count(*) AS groups, round(max(total), 2) AS total,
    count(*) FILTER (cum_pct <= 80) AS top_80pct_count,
    min(position) FILTER (cum_pct > 80) AS crossing FROM p""",
)
def vital_few(spark, sf):
    return rounded(contribution.vital_few(_pareto(spark, sf)), 2)


# --- distribution -----------------------------------------------------------------


def _histogram_sql(source: str, bins: int = 20) -> str:
    return f"""WITH v AS (SELECT v FROM {source} WHERE v IS NOT NULL),
    r AS (SELECT CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo,
                 CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi FROM v),
    b AS (SELECT i AS bin, lo + i * ((hi - lo) / {bins}) AS lower,
          CASE WHEN i = {bins - 1} THEN hi ELSE lo + (i + 1) * ((hi - lo) / {bins}) END AS upper
          FROM r, range({bins}) t(i))
    SELECT bin, round(lower, 6) AS lower, round(upper, 6) AS upper,
        (SELECT count(*) FROM v WHERE v >= lower AND (v < upper OR (bin = {bins - 1} AND v = upper)))
            AS count FROM b"""


@query("histogram", _histogram_sql("(SELECT value AS v FROM events)"))
def histogram(spark, sf):
    return rounded(distribution.histogram(load(spark, sf, "events"), "value"), 6)


@query("histogram_constant", _histogram_sql("(SELECT 7.0::DOUBLE AS v FROM labels)"))
def histogram_constant(spark, sf):
    same = load(spark, sf, "labels").select((F.col("doc_id") * 0 + 7.0).alias("same"))
    return rounded(distribution.histogram(same, "same"), 6)


CORRELATED = ("l_quantity", "l_extendedprice", "net", "l_tax", "fixed")
CORRELATED_SQL = """(SELECT l_quantity, CASE WHEN l_orderkey % 11 <> 0 THEN l_extendedprice END AS l_extendedprice,
    l_extendedprice * (1 - l_discount) AS net, l_tax, 1.0::DOUBLE AS fixed FROM lineitem)"""


def _pairs_sql() -> str:
    complete = " AND ".join(f"{c} IS NOT NULL" for c in CORRELATED)
    return f"complete AS (SELECT * FROM {CORRELATED_SQL} WHERE {complete}), pairs AS (" + union_all(
        [
            f"""SELECT {i}::INTEGER AS i, {j}::INTEGER AS j, {quoted(a)} AS a, {quoted(b)} AS b,
            CASE WHEN stddev_pop({a}) > 0 AND stddev_pop({b}) > 0 THEN
                {'1.0' if i == j else f'round(covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})), 3)'}
            END::DOUBLE AS r FROM complete"""
            for i, a in enumerate(CORRELATED)
            for j, b in enumerate(CORRELATED)
        ]
    ) + ")"


def _correlated(spark, sf):
    return load(spark, sf, "lineitem").select(
        "l_quantity",
        F.when(F.col("l_orderkey") % 11 != 0, F.col("l_extendedprice")).alias("l_extendedprice"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
        "l_tax",
        F.lit(1.0).alias("fixed"),
    )


@query("correlation_matrix", f'WITH {_pairs_sql()} SELECT i AS "row", j AS col, a, b, r FROM pairs')
def correlation_matrix(spark, sf):
    return distribution.correlation_matrix(_correlated(spark, sf), list(CORRELATED))


@query(
    "strong_pairs",
    f"WITH {_pairs_sql()} SELECT i, j, a, b, r FROM pairs WHERE i < j AND abs(r) >= 0.6",
)
def strong_pairs(spark, sf):
    return distribution.strong_pairs(_correlated(spark, sf), list(CORRELATED))


ANOMALY_SQL = """WITH s AS (SELECT avg(value) AS mean, stddev_samp(value) AS std, count(value) AS n FROM events)"""


@query(
    "anomalies",
    ANOMALY_SQL
    + """ SELECT event_id, value, ts AS date, round((value - mean) / std, 2) AS z FROM events, s
    WHERE n >= 5 AND std > 0 AND abs((value - mean) / std) > 3""",
)
def anomalies(spark, sf):
    return distribution.anomalies(load(spark, sf, "events"), "value", "event_id", "ts")


@query(
    "anomaly_summary",
    ANOMALY_SQL
    + """ SELECT 'value' AS measure, round(mean, 2) AS mean, round(std, 2) AS std,
    3.0::DOUBLE AS threshold_z, (SELECT count(*) FROM events WHERE abs((value - mean) / std) > 3) AS count
    FROM s""",
)
def anomaly_summary(spark, sf):
    return distribution.anomaly_summary(load(spark, sf, "events"), "value")


# --- drill-down -------------------------------------------------------------------


@query(
    "drill_time",
    """WITH m AS (SELECT year(o_orderdate)::INTEGER AS y, quarter(o_orderdate)::INTEGER AS q,
        month(o_orderdate)::INTEGER AS m, o_totalprice AS v FROM orders)
    SELECT CASE grouping(y, q, m) WHEN 7 THEN 'all' WHEN 3 THEN 'year' WHEN 1 THEN 'quarter' ELSE 'month' END
        AS level, y AS year, q AS quarter, m AS month, round(sum(v), 2) AS total, count(*) AS rows
    FROM m GROUP BY ROLLUP (y, q, m)""",
)
def drill_time(spark, sf):
    return rounded(aggregate.drill_time(load(spark, sf, "orders"), "o_orderdate", "o_totalprice"), 2)


@query(
    "drill_geo",
    """SELECT (3 - grouping(region) - grouping(country) - grouping(zone))::INTEGER AS depth,
        region, country, zone, round(sum(v), 2) AS total, count(*) AS rows FROM (
        SELECT r_name AS region, n_name AS country, c_mktsegment AS zone, c_acctbal AS v
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
    GROUP BY ROLLUP (region, country, zone)""",
)
def drill_geo(spark, sf):
    # nation and region have a fixed number of rows.
    places = load(spark, sf, "nation").join(
        F.broadcast(load(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey")
    )
    placed = (
        load(spark, sf, "customer")
        .join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("r_name").alias("region"),
            F.col("n_name").alias("country"),
            F.col("c_mktsegment").alias("zone"),
            "c_acctbal",
        )
    )
    return rounded(aggregate.drill_geo(placed, ["region", "country", "zone"], "c_acctbal"), 2)
