"""Queries on calendar series and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forecast, series
from ..operators.forecast import HOLT_GRID, HOLT_STEPS, SEASONAL_GRID, SEASONAL_STEPS, SES_GRID, SES_STEPS
from .registry import load, query, rounded


def _spine_sql(table: str, ts: str, value: str, unit: str, step: str, shift: int = 0) -> str:
    """Gap-free totals s(x, y) written with a calendar join."""
    label = f"date_trunc('{unit}', {ts})::DATE" + (f" + {shift}" if shift else "")
    return f"""b AS (SELECT {label} AS x, sum({value}) AS y FROM {table} WHERE {ts} IS NOT NULL
          AND {value} IS NOT NULL GROUP BY 1),
    s AS (SELECT x, coalesce(y, 0) AS y FROM
          (SELECT unnest(generate_series(min(x), max(x), INTERVAL {step}))::DATE AS x FROM b)
          LEFT JOIN b USING (x))"""


ORDERS_SPINE = _spine_sql("orders", "o_orderdate", "o_totalprice", "month", "1 MONTH")
RESAMPLED = {
    "month": ("orders", "o_orderdate", "o_totalprice", "MS", "1 MONTH", 0),
    "day": ("events", "ts", "value", "D", "1 DAY", 0),
    "week": ("events", "ts", "value", "W", "7 DAY", 6),
    "quarter": ("orders", "o_orderdate", "o_totalprice", "QS", "3 MONTH", 0),
    "year": ("orders", "o_orderdate", "o_totalprice", "YS", "1 YEAR", 0),
}


def _register_resample(unit: str) -> None:
    table, ts, value, freq, step, shift = RESAMPLED[unit]

    @query(
        f"resample_{unit}",
        f"WITH {_spine_sql(table, ts, value, unit, step, shift)} SELECT x, round(y, 2) AS y FROM s",
    )
    def resample(spark, sf):
        return rounded(series.resample_sum(load(spark, sf, table), ts, value, freq), 2)


for _unit in RESAMPLED:
    _register_resample(_unit)

GAPPED_SQL = "(SELECT * FROM orders WHERE month(o_orderdate) NOT IN (3, 4))"


@query(
    "resample_gaps",
    f"""WITH {_spine_sql(GAPPED_SQL, "o_orderdate", "o_totalprice", "month", "1 MONTH")}
    SELECT x, round(y, 2) AS y FROM s""",
)
def resample_gaps(spark, sf):
    # A rule on the month leaves holes in the calendar, which are part of the input here.
    orders = load(spark, sf, "orders").where(
        "month(o_orderdate) NOT IN (3, 4)"
    )
    return rounded(series.resample_sum(orders, "o_orderdate", "o_totalprice"), 2)


TREND_SQL = """SELECT x, round(y, 2) AS y,
    round(avg(y) OVER (ORDER BY x ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving_avg FROM s"""


@query("trend", f"WITH {ORDERS_SPINE} {TREND_SQL}")
def trend(spark, sf):
    result = series.trend(load(spark, sf, "orders"), "o_orderdate", "o_totalprice")
    return rounded(result).withColumn("y", F.round("y", 2))


@query(
    "trend_day",
    f"WITH {_spine_sql('lineitem', 'l_shipdate', 'l_extendedprice', 'day', '1 DAY')} {TREND_SQL}",
)
def trend_day(spark, sf):
    result = series.trend(load(spark, sf, "lineitem"), "l_shipdate", "l_extendedprice", "D")
    return rounded(result).withColumn("y", F.round("y", 2))


@query(
    "mean_step",
    f"""WITH {ORDERS_SPINE}, d AS (SELECT y - lag(y) OVER (ORDER BY x) AS d FROM s)
    SELECT count(d) AS steps, round(avg(d), 4) AS mean_step FROM d""",
)
def mean_step(spark, sf):
    totals = series.resample_sum(load(spark, sf, "orders"), "o_orderdate", "o_totalprice")
    return rounded(series.mean_step(totals))


CHANGE_SQL = """e AS (SELECT min(x) AS first_x, max(x) AS last_x, arg_min(y, x) AS first_y,
    arg_max(y, x) AS last_y FROM s)"""


@query(
    "series_change",
    f"""WITH {ORDERS_SPINE}, {CHANGE_SQL} SELECT first_x, last_x, round(first_y, 4) AS first_y,
    round(last_y, 4) AS last_y, round((last_y - first_y) / abs(first_y) * 100, 4) AS change_pct FROM e""",
)
def series_change(spark, sf):
    totals = series.resample_sum(load(spark, sf, "orders"), "o_orderdate", "o_totalprice")
    return rounded(series.series_change(totals))


@query(
    "yoy_compare",
    f"""WITH {ORDERS_SPINE}, p AS (SELECT x, y, lag(y, 12) OVER (ORDER BY x) AS y_prior FROM s)
    SELECT x, round(y, 2) AS y, round(y_prior, 2) AS y_prior, round(y - y_prior, 2) AS delta,
        round(CASE WHEN y_prior <> 0 THEN (y - y_prior) / abs(y_prior) * 100 END, 2) AS change_pct FROM p""",
)
def yoy_compare(spark, sf):
    return rounded(series.yoy_compare(load(spark, sf, "orders"), "o_orderdate", "o_totalprice"), 2)


# --- forecasts: one series per order priority ------------------------------------

KEYS = ["o_orderpriority"]
HORIZON = 6

BASE_SQL = f"""b AS (SELECT o_orderpriority AS k, date_trunc('month', o_orderdate)::DATE AS x,
        sum(o_totalprice) AS y, count(*) AS c FROM orders GROUP BY 1, 2),
    span AS (SELECT k, unnest(generate_series(min(x), max(x), INTERVAL 1 MONTH))::DATE AS x
             FROM b GROUP BY k),
    pts AS (SELECT k, x, coalesce(y, 0) AS y, row_number() OVER (PARTITION BY k ORDER BY x) AS i
            FROM span LEFT JOIN b USING (k, x)),
    ser AS (SELECT k, count(*) AS n, list(y ORDER BY x) AS ys, max(x) AS last_x,
            greatest(count(*) - greatest(1, count(*) // 5), 3) AS c
            FROM pts GROUP BY k HAVING count(*) >= 4),
    tasks AS (SELECT k, 'train' AS part, ys[1:c] AS ys, n - c AS steps, c >= 24 AS seasonal FROM ser
              UNION ALL SELECT k, 'full', ys, {HORIZON}, c >= 24 FROM ser)"""


def _axis(values) -> str:
    return "(SELECT unnest([" + ", ".join(f"{v}::DOUBLE" for v in values) + "]))"


def _points(axes: str, values) -> str:
    """tasks with every combination of ``values`` on the axes."""
    grids = ", ".join(f"{_axis(values)} g{x}({x})" for x in axes)
    return f"SELECT k, part, {', '.join(axes)} FROM tasks, {grids}"


def _near(axes: str, steps, fitted: str) -> str:
    """The same around the winner of the first search."""
    moved = ", ".join(f"w.{x} + d{x}.v AS {x}" for x in axes)
    grids = ", ".join(f"{_axis(steps)} d{x}(v)" for x in axes)
    return f"SELECT k, part, {moved} FROM ({_winner(axes, fitted)}) w, {grids}"


def _winner(axes: str, fitted: str) -> str:
    return f"""SELECT {fitted}.* FROM {fitted} JOIN tasks USING (k, part) WHERE i = len(ys)
        QUALIFY row_number() OVER (PARTITION BY k, part ORDER BY sse, {', '.join(axes)}) = 1"""


def _ses_sql(name: str, points: str) -> str:
    return f"""{name} AS (
        SELECT k, part, a, 1::BIGINT AS i, ys[1] AS l, 0::DOUBLE AS sse FROM ({points}) JOIN tasks USING (k, part)
        UNION ALL
        SELECT k, part, a, i + 1, a * ys[i + 1] + (1 - a) * l, sse + (ys[i + 1] - l) ** 2
        FROM {name} JOIN tasks USING (k, part) WHERE i < len(ys))"""


def _holt_sql(name: str, points: str) -> str:
    return f"""{name} AS (
        SELECT k, part, a, b, 2::BIGINT AS i, ys[2] AS l, ys[2] - ys[1] AS t, 0::DOUBLE AS sse
        FROM ({points}) JOIN tasks USING (k, part)
        UNION ALL
        SELECT k, part, a, b, i + 1, a * ys[i + 1] + (1 - a) * (l + t),
            b * (a * ys[i + 1] + (1 - a) * (l + t) - l) + (1 - b) * t, sse + (ys[i + 1] - l - t) ** 2
        FROM {name} JOIN tasks USING (k, part) WHERE i < len(ys))"""


def _hw_sql(name: str, points: str) -> str:
    return f"""{name} AS (
        SELECT k, part, a, b, g, 12::BIGINT AS i, m + t * 5.5 AS l, t,
            [ys[j] - m - (j - 6.5) * t for j in range(1, 13)] AS r, 0::DOUBLE AS sse
        FROM started JOIN tasks USING (k, part) JOIN ({points}) USING (k, part)
        UNION ALL
        SELECT k, part, a, b, g, i + 1, nl, b * (nl - l) + (1 - b) * t,
            r[2:12] || [g * (y - l - t - a * (y - l - t - r[1])) + (1 - g) * r[1]],
            sse + (y - l - t - r[1]) ** 2
        FROM (SELECT {name}.*, ys[i + 1] AS y, a * (ys[i + 1] - r[1]) + (1 - a) * (l + t) AS nl
              FROM {name} JOIN tasks USING (k, part) WHERE i < len(ys)))"""


STARTED_SQL = """started AS (SELECT k, part, list_avg(ys[1:12]) AS m,
        (list_avg(ys[13:24]) - list_avg(ys[1:12])) / 12 AS t FROM tasks WHERE seasonal)"""

FIRST_SQL = f"""{_ses_sql('ses1', _points('a', SES_GRID))},
    {_ses_sql('ses', _near('a', SES_STEPS, 'ses1'))},
    {_holt_sql('holt1', _points('ab', HOLT_GRID))},
    {_holt_sql('holt', _near('ab', HOLT_STEPS, 'holt1'))},
    {STARTED_SQL},
    {_hw_sql('hw1', _points('abg', SEASONAL_GRID))},
    {_hw_sql('hw', _near('abg', SEASONAL_STEPS, 'hw1'))}"""

CHOICE_SQL = f"""best AS (
        SELECT k, part, 'simple-exp-smoothing' AS model, l, 0::DOUBLE AS t, NULL::DOUBLE[] AS r
        FROM ({_winner('a', 'ses')})
        UNION ALL
        SELECT k, part, 'holt-winters-add', l, t, NULL FROM ({_winner('ab', 'holt')})
        UNION ALL
        SELECT k, part, 'holt-winters-add-add', l, t, r FROM ({_winner('abg', 'hw')})),
    filled AS (SELECT * FROM best UNION ALL
        SELECT k, part, 'holt-winters-add-add', l, t, r FROM best JOIN tasks USING (k, part)
        WHERE NOT seasonal AND model = 'holt-winters-add'),
    ahead AS (
        SELECT k, part, model, h, l + h * t + CASE WHEN r IS NULL THEN 0 ELSE r[(h - 1) % 12 + 1] END AS y
        FROM (SELECT f.*, unnest(range(1, steps + 1)) AS h FROM filled f JOIN tasks USING (k, part))
        UNION ALL
        SELECT k, part, 'seasonal-naive', h, ys[len(ys) - p + (h - 1) % p + 1]
        FROM (SELECT k, part, ys, CASE WHEN seasonal THEN 12 ELSE 1 END AS p,
              unnest(range(1, steps + 1)) AS h FROM tasks)
        UNION ALL
        SELECT k, part, 'naive-linear', h, ys[len(ys)] + h * (ys[len(ys)] - ys[1]) / (len(ys) - 1)
        FROM (SELECT k, part, ys, unnest(range(1, steps + 1)) AS h FROM tasks)),
    names(place, model) AS (VALUES (0, 'holt-winters-add-add'), (1, 'holt-winters-add'),
        (2, 'simple-exp-smoothing'), (3, 'seasonal-naive')),
    errors AS (SELECT a.k, a.model, avg(abs(p.y - a.y)) AS mae,
            avg(abs((p.y - a.y) / p.y)) FILTER (p.y <> 0) * 100 AS mape
        FROM ahead a JOIN ser ON a.k = ser.k JOIN pts p ON p.k = a.k AND p.i = ser.c + a.h
        WHERE part = 'train' GROUP BY a.k, a.model),
    variance AS (SELECT k, var_samp(y) AS v, greatest(1e-6, var_samp(y) * 1e-4) AS tol FROM pts GROUP BY k),
    flat AS (SELECT a.k, a.model, coalesce(var_samp(a.y) < any_value(tol)
            AND any_value(v) > any_value(tol), false) AS is_flat
        FROM ahead a JOIN variance USING (k) WHERE part = 'full' GROUP BY a.k, a.model),
    scored AS (SELECT e.k, place::INTEGER AS place, e.model, mae, mape, is_flat
        FROM errors e JOIN flat f ON e.k = f.k AND e.model = f.model JOIN names n ON n.model = e.model),
    chosen AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY k
        ORDER BY is_flat, mae, CASE WHEN contains(model, 'holt') THEN 0 ELSE 1 END, place) = 1),
    rated AS (SELECT k, model, mae, mape, coalesce(mape, abs(mae / nullif(m, 0)) * 100) AS e
        FROM chosen JOIN (SELECT k, avg(y) AS m FROM pts GROUP BY k) USING (k))"""

FULL_SQL = f"WITH RECURSIVE {BASE_SQL}, {FIRST_SQL}, {CHOICE_SQL}"


def _series(spark, sf):
    return forecast.series_frame(
        load(spark, sf, "orders"), "o_orderdate", "o_totalprice", keys=KEYS
    )


@query(
    "forecast_guard",
    """WITH b AS (SELECT event_type AS k, date_trunc('month', ts)::DATE AS x FROM events
        UNION ALL SELECT o_orderpriority, date_trunc('month', o_orderdate)::DATE FROM orders),
    g AS (SELECT k, count(*) AS rows, (date_diff('month', min(x), max(x)) + 1)::INTEGER AS periods
          FROM b GROUP BY k)
    SELECT k AS "key", rows, periods, rows >= 4 AND periods >= 4 AS accepted,
        CASE WHEN rows < 4 THEN 'not enough data points' WHEN periods < 4 THEN 'not enough periods' END AS note
    FROM g""",
)
def forecast_guard(spark, sf):
    events = load(spark, sf, "events").select(
        F.col("event_type").alias("key"), F.col("ts").alias("at"), F.col("value").alias("v")
    )
    orders = load(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("key"),
        F.col("o_orderdate").alias("at"),
        F.col("o_totalprice").alias("v"),
    )
    return forecast.forecast_guard(events.unionByName(orders), "at", "v", keys=["key"])


@query(
    "backtest_split",
    f"""WITH {BASE_SQL} SELECT pts.k AS o_orderpriority, x, round(y, 2) AS y,
    CASE WHEN i <= c THEN 'train' ELSE 'test' END AS part FROM pts JOIN ser ON pts.k = ser.k""",
)
def backtest_split(spark, sf):
    return rounded(forecast.backtest_split(_series(spark, sf), KEYS), 2)


def _register_model(name: str, model: str) -> None:
    @query(
        name,
        f"""{FULL_SQL} SELECT a.k AS o_orderpriority, (last_x + to_months(h::INTEGER))::DATE AS x,
        round(y, 2) AS y FROM ahead a JOIN ser ON a.k = ser.k WHERE part = 'full' AND model = '{model}'""",
    )
    def run(spark, sf):
        points = forecast.model_points(_series(spark, sf), model, HORIZON, keys=KEYS)
        return rounded(points, 2)


for _name, _model in (
    ("forecast_seasonal_naive", "seasonal-naive"),
    ("forecast_ses", "simple-exp-smoothing"),
    ("forecast_holt", "holt-winters-add"),
    ("forecast_holt_winters", "holt-winters-add-add"),
    ("forecast_linear", "naive-linear"),
):
    _register_model(_name, _model)


@query(
    "backtest_errors",
    f"""{FULL_SQL} SELECT k AS o_orderpriority, place, model, round(mae, 2) AS mae, round(mape, 2) AS mape,
    is_flat FROM scored""",
)
def backtest_errors(spark, sf):
    return rounded(forecast.backtest_errors(_series(spark, sf), KEYS, HORIZON), 2)


@query(
    "forecast_select",
    f"""{FULL_SQL} SELECT k AS o_orderpriority, model AS method, round(mae, 2) AS mae,
    round(mape, 2) AS mape FROM chosen""",
)
def forecast_select(spark, sf):
    chosen = forecast.forecast_select(_series(spark, sf), KEYS, HORIZON)
    return rounded(chosen.select(*KEYS, "method", "mae", "mape"), 2)


@query(
    "forecast_accuracy",
    f"""{FULL_SQL} SELECT k AS o_orderpriority, model AS method, round(mae, 2) AS mae,
    round(mape, 2) AS mape_pct, CASE WHEN e IS NULL THEN 'unknown' WHEN e < 10 THEN 'excellent'
    WHEN e < 20 THEN 'good' WHEN e < 50 THEN 'acceptable' ELSE 'poor' END AS rating FROM rated""",
)
def forecast_accuracy(spark, sf):
    chosen = forecast.forecast_select(_series(spark, sf), KEYS, HORIZON)
    return forecast.forecast_accuracy(chosen, KEYS)


@query(
    "forecast",
    f"""{FULL_SQL} SELECT pts.k AS o_orderpriority, 'history' AS kind, x, round(y, 2) AS y, model AS method
    FROM pts JOIN chosen ON pts.k = chosen.k
    UNION ALL
    SELECT a.k, 'forecast', (last_x + to_months(h::INTEGER))::DATE, round(a.y, 2), c.model
    FROM ahead a JOIN chosen c ON a.k = c.k AND a.model = c.model JOIN ser ON ser.k = a.k
    WHERE part = 'full'""",
)
def forecast_all(spark, sf):
    orders = load(spark, sf, "orders")
    return rounded(forecast.forecast(orders, "o_orderdate", "o_totalprice", HORIZON, keys=KEYS), 2)
