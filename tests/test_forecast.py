"""Forecast models on series with known answers."""

import datetime as dt
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywise.operators import forecast


def months(count, start=2020):
    return [dt.date(start + i // 12, i % 12 + 1, 1) for i in range(count)]


def frame(spark, ys, key="a"):
    return spark.createDataFrame([(key, d, float(y)) for d, y in zip(months(len(ys)), ys)], "k string, d date, v double")


def series(spark, ys):
    return forecast.series_frame(frame(spark, ys), "d", "v")


def points(spark, ys, model, periods=4):
    df = forecast.model_points(series(spark, ys), model, periods).orderBy("x")
    return [(r["x"], r["y"]) for r in df.collect()]


SEASON = [3, -1, 4, -2, 5, -9, 2, -6, 5, -3, 5, -3]


def test_too_short_series_give_nothing(spark):
    df = frame(spark, [1, 2, 3])
    assert forecast.forecast(df, "d", "v").count() == 0
    assert forecast.forecast(df.limit(0), "d", "v").count() == 0
    note = forecast.forecast_guard(df, "d", "v").first()
    assert (note["accepted"], note["note"]) == (False, "not enough data points")
    one_month = spark.createDataFrame([(dt.date(2024, 1, i), 1.0) for i in range(1, 9)], "d date, v double")
    assert forecast.forecast_guard(one_month, "d", "v").first()["note"] == "not enough periods"


@pytest.mark.parametrize("n, train", [(4, 3), (5, 4), (10, 8), (36, 29)])
def test_split(spark, n, train):
    rows = forecast.backtest_split(series(spark, range(n))).where("part = 'train'")
    assert rows.count() == train


@pytest.mark.parametrize("model", ["holt-winters-add", "naive-linear", "holt-winters-add-add"])
def test_a_line_goes_on(spark, model):
    got = points(spark, [10 + 3 * i for i in range(36)], model)
    assert [x for x, _ in got] == [dt.date(2023, m, 1) for m in (1, 2, 3, 4)]
    assert [y for _, y in got] == pytest.approx([10 + 3 * i for i in range(36, 40)])


def test_line_and_season_go_on(spark):
    ys = [50 + 2 * i + SEASON[i % 12] for i in range(48)]
    got = [y for _, y in points(spark, ys, "holt-winters-add-add", 14)]
    assert got == pytest.approx([50 + 2 * i + SEASON[i % 12] for i in range(48, 62)])


def test_naive_repeats_the_season_or_the_last_value(spark):
    long = list(range(40))
    assert [y for _, y in points(spark, long, "seasonal-naive", 13)] == [float(y) for y in long[-12:] + long[-12:-11]]
    assert [y for _, y in points(spark, [1, 5, 2, 7], "seasonal-naive")] == [7.0] * 4


def ses_run(ys, a):
    level, sse = ys[0], 0.0
    for y in ys[1:]:
        sse += (y - level) ** 2
        level = a * y + (1 - a) * level
    return sse, a, level


def holt_run(ys, a, b):
    level, slope, sse = ys[1], ys[1] - ys[0], 0.0
    for y in ys[2:]:
        sse += (y - level - slope) ** 2
        new = a * y + (1 - a) * (level + slope)
        level, slope = new, b * (new - level) + (1 - b) * slope
    return sse, a, b, level, slope


def brute_ses(ys):
    first = min(ses_run(ys, a) for a in forecast.SES_GRID)
    return min(ses_run(ys, first[1] + d) for d in forecast.SES_STEPS)


def brute_holt(ys):
    first = min(holt_run(ys, *p) for p in itertools.product(forecast.HOLT_GRID, repeat=2))
    near = itertools.product(forecast.HOLT_STEPS, repeat=2)
    return min(holt_run(ys, first[1] + d, first[2] + e) for d, e in near)


def test_grid_search_equals_a_plain_loop(spark):
    ys = [float((i * 37) % 23 + i) for i in range(30)]
    assert points(spark, ys, "simple-exp-smoothing", 1)[0][1] == pytest.approx(brute_ses(ys)[2])
    *_, level, slope = brute_holt(ys)
    assert [y for _, y in points(spark, ys, "holt-winters-add", 2)] == pytest.approx([level + slope, level + 2 * slope])


def test_the_second_search_never_fits_worse(spark):
    rng = random.Random(5)
    made = [[rng.gauss(0, 5) + k * i for i in range(30)] for k in range(4)] + [[100 - 3.0 * i for i in range(30)]]
    for ys in made:
        row = spark.createDataFrame([(ys,)], "ys array<double>")
        ses, holt = row.select(forecast.fit_ses(F.col("ys"))["sse"], forecast.fit_holt(F.col("ys"))["sse"]).first()
        assert ses <= min(ses_run(ys, a)[0] for a in forecast.SES_GRID) * (1 + 1e-9) + 1e-9
        assert holt <= min(holt_run(ys, *p)[0] for p in itertools.product(forecast.HOLT_GRID, repeat=2)) * (1 + 1e-9) + 1e-9
    falling = [2.0**-i for i in range(20)]  # the best weight is 1, an end of the range
    assert spark.createDataFrame([(falling,)], "ys array<double>").select(forecast.fit_ses(F.col("ys"))["a"]).first()[0] == 1.0


def errors_from(ys, a, b, g, x, season=0):
    """One-step errors and the last state of the smoothing that begins at the state x."""
    level, slope, errors = x[0], x[1], []
    ring = [*x[2:], -sum(x[2:])] if season else [0.0]
    for y in ys:
        miss = y - level - slope - ring[0]
        errors.append(miss)
        level, slope = level + slope + a * miss, slope + a * b * miss
        ring = [*ring[1:], ring[0] + g * (1 - a) * miss]
    return np.array(errors), level, slope, ring


def least(ys, a, b, g, unknowns, season=0):
    """Least squared error over all start states, and the last state from the best one."""
    none = errors_from(ys, a, b, g, np.zeros(max(unknowns, 2)), season)[0]
    units = np.eye(max(unknowns, 2))[:unknowns]
    effect = np.stack([none - errors_from(ys, a, b, g, u, season)[0] for u in units], axis=1)
    x = np.zeros(max(unknowns, 2))
    x[:unknowns] = np.linalg.lstsq(effect, none, rcond=None)[0]
    errors, level, slope, _ = errors_from(ys, a, b, g, x, season)
    return float((errors**2).sum()), a, b, level, slope


def made_series():
    rng = random.Random(11)
    seasonal = [[rng.gauss(0, 4) + k * i + 3 * SEASON[i % 12] for i in range(26 + 7 * k)] for k in range(3)]
    return seasonal + [[50 + 2.0 * i + SEASON[i % 12] for i in range(36)], [1e9 + 3.0 * i for i in range(30)], [7.0] * 25]


def test_estimated_starts_are_the_least_squares_ones(spark):
    for ys in made_series():
        row = spark.createDataFrame([(ys,)], "ys array<double>")
        ses, holt = row.select(forecast.fit_ses(F.col("ys"), "estimated"), forecast.fit_holt(F.col("ys"), "estimated")).first()
        first = min(least(ys, a, 0.0, 0.0, 1) for a in forecast.SES_GRID)
        assert ses["sse"] <= first[0] * (1 + 1e-6) + 1e-6
        want = least(ys, ses["a"], 0.0, 0.0, 1)
        assert (ses["sse"], ses["level"]) == (pytest.approx(want[0], rel=1e-6, abs=1e-4), pytest.approx(want[3]))
        first = min(least(ys, *p, 0.0, 2) for p in itertools.product(forecast.HOLT_GRID, repeat=2))
        assert holt["sse"] <= first[0] * (1 + 1e-6) + 1e-4
        want = least(ys, holt["a"], holt["b"], 0.0, 2)
        assert holt["sse"] == pytest.approx(want[0], rel=1e-6, abs=1e-3)
        assert (holt["level"], holt["trend"]) == (pytest.approx(want[3]), pytest.approx(want[4], abs=1e-6))


def test_estimated_starts_never_fit_worse(spark):
    rows = [(i, ys) for i, ys in enumerate(made_series())]
    df = spark.createDataFrame(rows, "i int, ys array<double>")
    for fit in (forecast.fit_ses, forecast.fit_holt, forecast.fit_holt_winters):
        fitted = df.select("i", fit(F.col("ys")).alias("first"), fit(F.col("ys"), start="estimated").alias("estimated")).collect()
        assert all(r["estimated"]["sse"] <= r["first"]["sse"] * (1 + 1e-9) + 1e-9 for r in fitted)
        if fit is not forecast.fit_holt_winters:
            continue
        for r in fitted:
            s, ys = r["estimated"], rows[r["i"]][1]
            assert all(0 <= s[x] <= 1 for x in "abg")
            # Two rounds leave little between the start found and the best one for the parameters.
            assert s["sse"] <= least(ys, s["a"], s["b"], s["g"], 13, 12)[0] * 1.02 + 1e-6
        assert any(r["estimated"]["sse"] < 0.8 * r["first"]["sse"] for r in fitted)


def test_estimated_starts_of_short_and_unknown(spark):
    assert [y for _, y in points(spark, [10 + 3 * i for i in range(4)], "holt-winters-add")] == pytest.approx([22, 25, 28, 31])
    short = forecast.model_points(series(spark, [10 + 3 * i for i in range(4)]), "holt-winters-add-add", 2, start="estimated")
    assert sorted(r["y"] for r in short.collect()) == pytest.approx([22, 25])
    with pytest.raises(ValueError):
        forecast.fit_ses(F.col("ys"), "guessed")


def test_short_season_model_is_the_trend_model(spark):
    ys = [float((i * 37) % 23 + i) for i in range(20)]
    assert points(spark, ys, "holt-winters-add-add") == points(spark, ys, "holt-winters-add")


def test_flat_models_lose_unless_the_series_is_flat(spark):
    errors = {r["model"]: r for r in forecast.backtest_errors(series(spark, [(i * 7) % 5 for i in range(20)])).collect()}
    assert errors["simple-exp-smoothing"]["is_flat"] and errors["seasonal-naive"]["is_flat"]
    assert not errors["holt-winters-add"]["is_flat"]
    constant = forecast.backtest_errors(series(spark, [5] * 20)).collect()
    assert not any(r["is_flat"] for r in constant)
    one_step = forecast.backtest_errors(series(spark, [(i * 7) % 5 for i in range(20)]), periods=1).collect()
    assert not any(r["is_flat"] for r in one_step)


def test_a_tie_prefers_the_first_holt_model(spark):
    picked = forecast.forecast_select(series(spark, [10 + 3 * i for i in range(12)])).first()
    assert picked["method"] == "holt-winters-add-add"
    assert picked["ahead"] == pytest.approx([10 + 3 * i for i in range(12, 18)])


def test_mape_skips_zero_and_rating_falls_back(spark):
    selected = forecast.forecast_select(series(spark, [0.0] * 12))
    row = forecast.forecast_accuracy(selected).first()
    assert (row["mae"], row["mape_pct"], row["rating"]) == (0.0, None, "unknown")
    table = spark.createDataFrame(
        [(5.0, 1.0, 1.0), (15.0, 1.0, 1.0), (49.0, 1.0, 1.0), (50.0, 1.0, 1.0), (None, 1.0, 20.0), (None, 1.0, 0.0)],
        "mape double, mae double, mean double",
    )
    rating = forecast.accuracy_rating(F.col("mape"), F.col("mae"), F.col("mean"))
    assert [r[0] for r in table.select(rating).collect()] == [
        "excellent", "good", "acceptable", "poor", "excellent", "unknown"]


def test_many_series_at_once(spark):
    both = frame(spark, [10 + 3 * i for i in range(12)], "line").unionByName(frame(spark, [1, 2], "short"))
    rows = forecast.forecast(both, "d", "v", periods=2, keys=["k"]).orderBy("x").collect()
    assert {r["k"] for r in rows} == {"line"}
    assert [r["kind"] for r in rows] == ["history"] * 12 + ["forecast"] * 2
    assert [r["y"] for r in rows[-2:]] == pytest.approx([46.0, 49.0])
