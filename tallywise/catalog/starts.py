"""Queries on forecasts whose start values are estimated."""

from __future__ import annotations

from ..operators import forecast
from ..operators.forecast import HOLT_GRID, HOLT_STEPS, SEASONAL_GRID, SEASONAL_STEPS, SES_GRID, SES_STEPS
from .registry import load, query, rounded
from .series import BASE_SQL, CHOICE_SQL, HORIZON, KEYS, STARTED_SQL, _axis, _hw_sql, _near, _points, _series, _winner


def _ses_sql(name: str, points: str) -> str:
    return f"""{name}_run AS (
        SELECT k, part, a, 0::BIGINT AS i, ys[1] AS l, 1::DOUBLE AS c, 0::DOUBLE AS ee, 0::DOUBLE AS ec, 0::DOUBLE AS cc
        FROM ({points}) JOIN tasks USING (k, part)
        UNION ALL
        SELECT k, part, a, i + 1, l + a * (y - l), c * (1 - a), ee + (y - l) ** 2, ec + (y - l) * c, cc + c * c
        FROM (SELECT r.*, ys[i + 1] AS y FROM {name}_run r JOIN tasks USING (k, part) WHERE i < len(ys))),
    {name} AS (SELECT k, part, a, i, l + ec / cc * c AS l, greatest(ee - ec * ec / cc, 0) AS sse
        FROM {name}_run JOIN tasks USING (k, part) WHERE i = len(ys))"""


def _holt_sql(name: str, points: str) -> str:
    sums = [(i, j) for i in range(3) for j in range(i, 3)]
    return f"""{name}_run AS (
        SELECT k, part, a, b, 0::BIGINT AS i, 2 * ys[1] - ys[2] AS l0, ys[2] - ys[1] AS t0, 1::DOUBLE AS l1, 0::DOUBLE AS t1,
            0::DOUBLE AS l2, 1::DOUBLE AS t2, {", ".join(f"0::DOUBLE AS s{i}{j}" for i, j in sums)}
        FROM ({points}) JOIN tasks USING (k, part)
        UNION ALL
        SELECT k, part, a, b, i + 1, {", ".join(f"l{i} + t{i} + a * e{i}, t{i} + a * b * e{i}" for i in range(3))},
            {", ".join(f"s{i}{j} + e{i} * e{j}" for i, j in sums)}
        FROM (SELECT r.*, ys[i + 1] - l0 - t0 AS e0, -l1 - t1 AS e1, -l2 - t2 AS e2
              FROM {name}_run r JOIN tasks USING (k, part) WHERE i < len(ys))),
    {name} AS (SELECT k, part, a, b, i, l0 + d1 * l1 + d2 * l2 AS l, t0 + d1 * t1 + d2 * t2 AS t,
            greatest(s00 + d1 * s01 + d2 * s02, 0) AS sse
        FROM (SELECT r.*, (s12 * s02 - s22 * s01) / (s11 * s22 - s12 * s12) AS d1,
                  (s12 * s01 - s11 * s02) / (s11 * s22 - s12 * s12) AS d2
              FROM {name}_run r JOIN tasks USING (k, part) WHERE i = len(ys)))"""


def _unit(test: str) -> str:
    return f"[CASE WHEN {test} THEN 1 ELSE 0 END::DOUBLE for j in range(1, 14)]"


def _round_sql(old: str, new: str) -> str:
    """From the winners ``old`` (k, part, a, b, g, l, t, r, sse) to the better winners ``new``."""
    ring = ", ".join(f"[CASE WHEN j = {q + 2} THEN 1 ELSE 0 END::DOUBLE for j in range(1, 14)]" for q in range(1, 12))
    return f"""{new}_eq AS (
        SELECT k, part, a, b, g, 0::BIGINT AS i, begun.l, begun.t, begun.r, {_unit("j = 1")} AS ul, {_unit("j = 2")} AS ut,
            [{ring}, [CASE WHEN j > 2 THEN -1 ELSE 0 END::DOUBLE for j in range(1, 14)]] AS ur,
            [[0::DOUBLE for j in range(1, 15)] for q in range(1, 14)] AS sums
        FROM {old} JOIN begun USING (k, part)
        UNION ALL
        SELECT k, part, a, b, g, i + 1, l + t + a * miss, t + a * b * miss, r[2:12] || [r[1] + g * (1 - a) * miss],
            [ul[j] + ut[j] - a * unit[j] for j in range(1, 14)], [ut[j] - a * b * unit[j] for j in range(1, 14)],
            ur[2:12] || [[ur[1][j] - g * (1 - a) * unit[j] for j in range(1, 14)]],
            [[sums[q][j] + unit[q] * (unit || [miss])[j] for j in range(1, 15)] for q in range(1, 14)]
        FROM (SELECT e.*, ys[i + 1] - l - t - r[1] AS miss, [ul[j] + ut[j] + ur[1][j] for j in range(1, 14)] AS unit
              FROM {new}_eq e JOIN tasks USING (k, part) WHERE i < len(ys))),
    {new}_gauss AS (
        SELECT k, part, 0::BIGINT AS p, sums AS m FROM {new}_eq JOIN tasks USING (k, part) WHERE i = len(ys)
        UNION ALL
        SELECT k, part, p, [CASE WHEN q = p THEN top ELSE [m[q][j] - m[q][p] * top[j] for j in range(1, 15)] END for q in range(1, 14)]
        FROM (SELECT k, part, p + 1 AS p, m, [CASE WHEN m[p + 1][p + 1] > 1e-9 THEN m[p + 1][j] / m[p + 1][p + 1] ELSE 0 END for j in range(1, 15)] AS top
              FROM {new}_gauss WHERE p < 13)),
    {new}_start AS (
        SELECT k, part, l + d[1] AS l, t + d[2] AS t,
            [r[j] + CASE WHEN j < 12 THEN d[j + 2] ELSE -list_sum(d[3:13]) END for j in range(1, 13)] AS r
        FROM (SELECT k, part, [m[q][14] for q in range(1, 14)] AS d FROM {new}_gauss WHERE p = 13) JOIN begun USING (k, part)),
    {new}_run AS (
        SELECT k, part, a, b, g, 0::BIGINT AS i, l, t, r, 0::DOUBLE AS sse
        FROM (SELECT k, part, {", ".join(f"least(greatest(w.{x} + d{x}.v, 0), 1) AS {x}" for x in "abg")}
              FROM {old} w, {", ".join(f"{_axis(SEASONAL_STEPS)} d{x}(v)" for x in "abg")}) JOIN {new}_start USING (k, part)
        UNION ALL
        SELECT k, part, a, b, g, i + 1, l + t + a * miss, t + a * b * miss, r[2:12] || [r[1] + g * (1 - a) * miss], sse + miss ** 2
        FROM (SELECT n.*, ys[i + 1] - l - t - r[1] AS miss FROM {new}_run n JOIN tasks USING (k, part) WHERE i < len(ys))),
    {new} AS (
        SELECT k, part, a, b, g, i, l, t, r, sse FROM (
            SELECT k, part, a, b, g, i, l, t, r, sse FROM {old}
            UNION ALL SELECT k, part, a, b, g, i, l, t, r, sse FROM {new}_run JOIN tasks USING (k, part) WHERE i = len(ys))
        QUALIFY row_number() OVER (PARTITION BY k, part ORDER BY sse, a, b, g) = 1)"""


ESTIMATED_SQL = f"""{_ses_sql('ses1', _points('a', SES_GRID))},
    {_ses_sql('ses', _near('a', SES_STEPS, 'ses1'))},
    {_holt_sql('holt1', _points('ab', HOLT_GRID))},
    {_holt_sql('holt', _near('ab', HOLT_STEPS, 'holt1'))},
    {STARTED_SQL},
    {_hw_sql('hw1', _points('abg', SEASONAL_GRID))},
    {_hw_sql('hw0', _near('abg', SEASONAL_STEPS, 'hw1'))},
    begun AS (SELECT k, part, m - t * 6.5 AS l, t, [ys[j] - m - (j - 6.5) * t for j in range(1, 13)] AS r
        FROM started JOIN tasks USING (k, part)),
    won0 AS ({_winner('abg', 'hw0')}),
    {_round_sql('won0', 'won1')},
    {_round_sql('won1', 'hw')}"""

FULL_SQL = f"WITH RECURSIVE {BASE_SQL}, {ESTIMATED_SQL}, {CHOICE_SQL}"


def _register_model(name: str, model: str) -> None:
    @query(
        name,
        f"""{FULL_SQL} SELECT a.k AS o_orderpriority, (last_x + to_months(h::INTEGER))::DATE AS x,
        round(y, 2) AS y FROM ahead a JOIN ser ON a.k = ser.k WHERE part = 'full' AND model = '{model}'""",
    )
    def run(spark, sf):
        points = forecast.model_points(_series(spark, sf), model, HORIZON, keys=KEYS, start="estimated")
        return rounded(points, 2)


for _name, _model in (
    ("forecast_ses_estimated", "simple-exp-smoothing"),
    ("forecast_holt_estimated", "holt-winters-add"),
    ("forecast_holt_winters_estimated", "holt-winters-add-add"),
):
    _register_model(_name, _model)


@query(
    "forecast_select_estimated",
    f"""{FULL_SQL} SELECT k AS o_orderpriority, model AS method, round(mae, 2) AS mae,
    round(mape, 2) AS mape FROM chosen""",
)
def forecast_select_estimated(spark, sf):
    chosen = forecast.forecast_select(_series(spark, sf), KEYS, HORIZON, start="estimated")
    return rounded(chosen.select(*KEYS, "method", "mae", "mape"), 2)


@query(
    "forecast_estimated",
    f"""{FULL_SQL} SELECT pts.k AS o_orderpriority, 'history' AS kind, x, round(y, 2) AS y, model AS method
    FROM pts JOIN chosen ON pts.k = chosen.k
    UNION ALL
    SELECT a.k, 'forecast', (last_x + to_months(h::INTEGER))::DATE, round(a.y, 2), c.model
    FROM ahead a JOIN chosen c ON a.k = c.k AND a.model = c.model JOIN ser ON ser.k = a.k
    WHERE part = 'full'""",
)
def forecast_estimated(spark, sf):
    orders = load(spark, sf, "orders")
    made = forecast.forecast(orders, "o_orderdate", "o_totalprice", HORIZON, keys=KEYS, start="estimated")
    return rounded(made, 2)
