"""Edge cases on literal frames."""

import datetime as dt
import math
import random
import re
import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tallywise.functions.coerce import text_to_number, text_to_timestamp
from tallywise.functions.calendar import period
from tallywise.operators import (
    distinct,
    aggregate,
    cleaning,
    contribution,
    distribution,
    filters,
    kpi,
    prefix,
    profile,
    quality,
    quantiles,
    ranking,
    series,
)
from tallywise.operators.prefix import running_total
from tallywise.sources import sinks, tables

QUICK = settings(
    max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
NAN = float("nan")


def day(text):
    return dt.date.fromisoformat(text)


def dated(spark, rows):
    return spark.createDataFrame([(day(d), v) for d, v in rows], "d date, v double")


def values(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


# --- cleaning ---------------------------------------------------------------------


def test_headers_are_stripped_and_must_stay_distinct(spark):
    assert cleaning.clean_headers(spark.range(1).toDF(" a ")).columns == ["a"]
    with pytest.raises(ValueError):
        cleaning.clean_headers(spark.range(1).select(F.lit(1).alias("a"), F.lit(2).alias("a ")))


def test_empty_rows_are_dropped_with_nan_as_null(spark):
    df = spark.createDataFrame([(None, NAN), ("x", NAN), (None, 1.0)], "s string, v double")
    assert cleaning.clean(df).count() == 2


@pytest.mark.parametrize("good, parsed", [(7, True), (6, False)])
def test_dates_need_seventy_percent(spark, good, parsed):
    rows = [("2024-01-05",)] * good + [("junk",)] * (10 - good) + [(None,)]
    kind = cleaning.parse_dates(spark.createDataFrame(rows, "s string")).dtypes[0][1]
    assert (kind == "timestamp_ntz") is parsed


def test_date_formats(spark):
    texts = ["2024-01-05", "2024-1-5", "2024-01-05 10:11:12", "2024-01-05T10:11:12.5", "2024/01/05",
             "01/05/2024", "5 Jan 2024", "05-Jan-2024", "Jan 5, 2024", "20240105", "2024", "2024-13-45", ""]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    days = [r[0].date() if r[0] else None for r in df.select(text_to_timestamp(F.col("s"))).collect()]
    assert days == [day("2024-01-05")] * 10 + [None] * 3


@pytest.mark.parametrize("texts, order, days", [
    (["13/01/2024", "02/01/2024", "01/13/2024", "14.2.24"], "day first", ["2024-01-13", "2024-01-02", None, "2024-02-14"]),
    (["01/13/2024", "02-01-24 10:30 PM", "13.01.2024", "1.20.2024"], "month first", ["2024-01-13", "2024-02-01", None, "2024-01-20"]),
    (["01/02/2024", "2024-03-04", "junk"], "month first", ["2024-01-02", "2024-03-04", None]),
    (["13/13/2024", "30-02-2024", None, "2024-03-04"], "month first", [None, None, None, "2024-03-04"]),
    (["13/01/2024 08:15", "5 Jan 2024", "1/2/2024 11:00 am"], "day first", ["2024-01-13", "2024-01-05", "2024-02-01"]),
])
def test_a_column_is_read_in_one_order(spark, texts, order, days):
    df = spark.createDataFrame([(i, t, t) for i, t in enumerate(texts)], "i int, s string, `t.t` string")
    found = cleaning.date_formats(df).orderBy("ordinal").collect()
    assert [(r["column"], r["format"]) for r in found] == [("s", order), ("t.t", order)]
    assert found[0]["share"] == sum(d is not None for d in days) / len([t for t in texts if t is not None])
    made = cleaning.parse_dates(df, ["s", "t.t"]).orderBy("i").collect()
    for column in (1, 2):
        assert [r[column].date() if r[column] else None for r in made] == [d and day(d) for d in days]


def test_placed_dates_meet_no_parser(spark):
    texts = ["13/01/2024", "29.02.2023", "29-2-24", "31/4/2024", "1/2/24", "1/2/2024\n", "00/1/2024"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    for made in (cleaning.date_formats(df), df.select(text_to_timestamp(F.col("s"), True))):
        assert not re.search("M/d/yy|d/M/yy", made._jdf.queryExecution().toString())
    found = cleaning.date_formats(df).first()
    assert (found["month_first"], found["day_first"]) == (1, 3)
    days = [r[0].date() if r[0] else None for r in df.select(text_to_timestamp(F.col("s"), True)).collect()]
    assert days == [day("2024-01-13"), None, day("2024-02-29"), None, day("2024-02-01"), None, None]


def test_a_day_with_no_time_of_day_is_no_date_in_either_order(spark):
    df = spark.createDataFrame([("13/01/2024 25:00",), ("13/1/2024 7:00 pm",)], "s string")
    found = cleaning.date_formats(df).first()
    assert (found["month_first"], found["day_first"]) == (0, 1)


def test_formats_take_one_scan_and_stay_in_the_engine(spark, data):
    orders = spark.read.parquet(f"{data}/orders.parquet")
    plan = cleaning.date_formats(orders)._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("FileScan") == 1 and "Python" not in plan
    assert cleaning.date_formats(orders.select("o_orderkey")).count() == 0
    assert cleaning.date_formats(orders.limit(0)).where("non_null > 0 or share is not null").count() == 0


def test_no_date_no_calendar_columns(spark):
    df = spark.createDataFrame([(None, "x", "31/12/2024", None)], "d date, t string, u string, v string")
    out, made = profile.add_date_features(df, ["d", "t", "u", "v", "u"])
    assert [m for m in made if not m.startswith("u__")] == [] and len(made) == 7
    assert out.first()["u__Month"] == 12


def test_number_text(spark):
    df = spark.createDataFrame(
        [(t,) for t in ("1.5", " 2 ", "-3e2", "x", "", "NaN", "1d", "2.5f", None)], "s string"
    )
    assert [r[0] for r in df.select(text_to_number(F.col("s"))).collect()] == [
        1.5, 2.0, -300.0, None, None, None, None, None, None]


# --- series -----------------------------------------------------------------------


def test_gap_months_are_zero(spark):
    df = dated(spark, [("2024-01-10", 1.0), ("2024-01-20", 2.0), ("2024-04-01", 4.0), ("2024-05-01", None)])
    assert [y for (y,) in values(series.resample_sum(df, "d", "v").orderBy("x"), "y")] == [3.0, 0.0, 0.0, 4.0]
    rows = values(series.trend(df, "d", "v").orderBy("x"), "moving_avg")
    assert [round(m, 6) for (m,) in rows] == [3.0, 1.5, 1.0, round(4 / 3, 6)]


def test_null_measure_rows_stretch_the_kpi_calendar_only(spark):
    df = dated(spark, [("2024-01-10", 1.0), ("2024-03-01", None)])
    assert series.resample_sum(df, "d", "v").count() == 1
    assert series.resample_sum(df, "d", "v", keep_null_measure=True).count() == 3
    assert kpi.kpi_series(df, ["v"], "d").count() == 3


def test_week_label_is_the_closing_sunday(spark):
    df = dated(spark, [("2024-01-01", 1.0), ("2024-01-07", 1.0), ("2024-01-08", 1.0)])
    got = [r[0] for r in df.select(period(F.col("d"), "W")).collect()]
    assert got == [day("2024-01-07"), day("2024-01-07"), day("2024-01-14")]


@QUICK
@given(st.lists(st.tuples(st.integers(0, 900), st.integers(-50, 50)), min_size=1, max_size=30))
def test_spine_has_no_gaps_and_keeps_the_total(spark, points):
    start = day("2020-01-01")
    df = spark.createDataFrame(
        [(start + dt.timedelta(days=o), float(v)) for o, v in points], "d date, v double"
    )
    rows = values(series.resample_sum(df, "d", "v").orderBy("x"), "x", "y")
    months = [x.year * 12 + x.month for x, _ in rows]
    assert months == list(range(months[0], months[-1] + 1))
    assert sum(y for _, y in rows) == sum(v for _, v in points)


def test_series_change_and_steps(spark):
    s = spark.createDataFrame([(day("2024-01-01"), 2.0), (day("2024-02-01"), 5.0)], "x date, y double")
    assert values(series.series_change(s), "change_pct") == [(150.0,)]
    assert values(series.mean_step(s), "steps", "mean_step") == [(1, 3.0)]
    zero = spark.createDataFrame([(day("2024-01-01"), 0.0)], "x date, y double")
    assert values(series.series_change(zero), "change_pct") == [(None,)]


# --- KPI --------------------------------------------------------------------------


def test_kpi_without_previous_value(spark):
    df = dated(spark, [("2024-01-10", 0.0), ("2024-02-01", 5.0)])
    assert values(kpi.kpi_change(df, ["v"], "d"), "change_pct", "trend") == [(None, "stable")]


def test_kpi_direction_and_missing_measures(spark):
    df = spark.createDataFrame(
        [(day("2024-01-01"), 100.0, None), (day("2024-02-01"), 90.0, None)], "d date, v double, e double"
    )
    cards = kpi.kpi_summary(df, ["v", "e"], "d").collect()
    assert [(c["name"], c["change_pct"], c["trend"], len(c["sparkline"])) for c in cards] == [
        ("v", -10.0, "down", 2)]
    assert kpi.kpi_summary(df, ["v"]).first()["trend"] == "stable"
    whole = kpi.kpi_change(df, ["v"], "d", complete_only=True).first()
    assert whole["current"] == 100.0 and whole["change_pct"] is None


# --- ranking and contribution -----------------------------------------------------


def test_ties_are_ordered_by_name(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 2.0), (None, 9.0), ("d", None)], "k string, v double")
    assert values(ranking.top_n(df, "k", "v"), "k") == [("c",), ("a",), ("b",)]
    assert values(ranking.bottom_n(df, "k", "v", 2), "k") == [("a",), ("b",)]
    assert values(ranking.nth_ranked(df, "k", "v", 2), "k") == [("a",)]
    assert ranking.nth_ranked(df, "k", "v", 4).count() == 0
    assert ranking.nth_ranked(df, "k", "v", 0).count() == 0
    assert values(ranking.rank_availability(df, "k", "v", 4), "available", "found") == [(3, False)]


def test_share_needs_three_rows(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "k string, v double")
    assert values(ranking.top3_share(df, "k", "v"), "leader", "top3_share") == [("b", None)]


def test_groups_of_equal_total_are_ties_in_whatever_order_they_are_added(spark):
    # 0.1 + 0.2 + 0.3 and 0.3 + 0.2 + 0.1 differ as doubles; the larger one is the later key.
    rows = [(k, v) for k in range(6) for v in ([0.1, 0.2, 0.3] if k % 2 else [0.3, 0.2, 0.1])]
    df = spark.createDataFrame(rows, "k int, v double").coalesce(1)
    assert values(contribution.pareto(df, "k", "v").orderBy("position"), "k") == [(k,) for k in range(6)]
    assert values(ranking.top_n(df, "k", "v", 6), "k", "v") == [(k, 0.6) for k in range(6)]
    assert values(ranking.nth_ranked(df, "k", "v", 1), "k") == [(0,)]


def test_sums_out_of_the_range_of_decimals_are_plain(spark):
    rows = [("a", 1e30), ("a", 3e30), ("b", 1e-30), ("b", 3e-30), ("c", float("inf")), ("c", 1.0), ("d", 0.0), ("e", 9e19), ("e", 9e19)]
    rows += [("f", 1 / 3), ("f", 1e-19), ("g", 0.1), ("g", 1e25)]
    df = spark.createDataFrame(rows, "k string, v double")
    found = dict(values(ranking.group_totals(df, "k", "v"), "k", "v"))
    assert found == {"a": 4e30, "b": 4e-30, "c": float("inf"), "d": 0.0, "e": 1.8e20, "f": 1 / 3, "g": 1e25}


def test_pareto_without_positive_total_is_empty(spark):
    df = spark.createDataFrame([("a", -1.0), ("b", 1.0)], "k string, v double")
    assert contribution.pareto(df, "k", "v").count() == 0


def test_pareto_with_negative_groups(spark):
    df = spark.createDataFrame([("a", 10.0), ("b", 2.0), ("c", -4.0)], "k string, v double")
    rows = values(contribution.pareto(df, "k", "v").orderBy("position"), "k", "cum_pct", "abc")
    assert rows == [("a", 125.0, "C"), ("b", 150.0, "C"), ("c", 100.0, "C")]


def test_vital_few_counts_groups_within_eighty_percent(spark):
    df = spark.createDataFrame([("a", 90.0), ("b", 10.0)], "k string, v double")
    few = contribution.vital_few(contribution.pareto(df, "k", "v")).first()
    assert (few["top_80pct_count"], few["crossing"]) == (0, 1)


@QUICK
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 9)), min_size=1, max_size=120))
def test_pareto_equals_a_plain_loop(spark, rows):
    df = spark.createDataFrame([(k, float(v)) for k, v in rows], "k int, v double")
    found = values(contribution.pareto(df, "k", "v").orderBy("position"), "position", "k", "cum_pct")
    totals = {}
    for k, v in rows:
        totals[k] = totals.get(k, 0) + v
    upto = 0
    for place, (k, v) in enumerate(sorted(totals.items(), key=lambda r: (-r[1], r[0]))):
        upto += v
        assert found[place][:2] == (place + 1, k)
        assert abs(found[place][2] - upto / sum(totals.values()) * 100) < 1e-9
    assert len(found) == len(totals)


def test_one_value_shared_by_most_rows_is_split_over_ranges(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(1).alias("v"))
    out = running_total(df, [-F.col("v"), F.col("id")], "v", ranges=8)
    expected, total = {}, 0
    for key, v in sorted(((i, i if i % 3 == 0 else 1) for i in range(4000)), key=lambda r: (-r[1], r[0])):
        total += v
        expected[key] = total
    assert {r["id"]: r["running"] for r in out.collect()} == expected
    assert sorted(r["position"] for r in out.collect()) == list(range(1, 4001))


# --- quantiles and distribution ----------------------------------------------------


def linear_quantile(data, p):
    ordered = sorted(data)
    place = p * (len(ordered) - 1)
    low = int(place)
    high = min(low + 1, len(ordered) - 1)
    return ordered[low] + (ordered[high] - ordered[low]) * (place - low)


@pytest.mark.parametrize("shape", ["spread", "ties", "tail"])
@pytest.mark.parametrize("ordered_rows,bounded", [(10**9, False), (500, False), (500, True)])
def test_quantiles_are_exact(spark, shape, ordered_rows, bounded, monkeypatch):
    # Small limits send even this fixture through all three looks.
    monkeypatch.setattr(quantiles, "ORDERED_ROWS", ordered_rows)
    monkeypatch.setattr(quantiles, "ACCURACY", 100)
    rng = random.Random(3)
    draw = {
        "spread": lambda: rng.uniform(-5, 5),
        "ties": lambda: float(rng.choice([0, 0, 0, 1, 2, 7])),
        "tail": lambda: rng.paretovariate(0.5),
    }[shape]
    data = {k: [draw() for _ in range(n)] for k, n in (("hot", 6000), ("cold", 9), ("one", 1))}
    rows = [(k, v) for k, vs in data.items() for v in vs] + [("none", None), ("cold", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = [0.0, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = quantiles.exact_quantiles(df, ["k"], "v", probs, bounded)
    found = {r["k"]: r for r in got.collect()}
    for k, vs in data.items():
        assert found[k]["n"] == len(vs)
        assert found[k]["quantiles"] == pytest.approx([linear_quantile(vs, p) for p in probs], rel=1e-12)
    assert found["none"]["n"] == 0 and found["none"]["quantiles"] is None


def test_rows_of_a_hot_key_are_spread_by_salt(spark):
    df = spark.range(100).select((F.col("id") % 7).alias("k"), F.col("id").alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = quantiles.exact_quantiles(df, ["k"], "v", [0.5])
        plan = found._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert re.search(r"hashpartitioning\(k#\d+L, _salt#\d+", plan)


@QUICK
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=60))
def test_histogram_counts_every_value(spark, data):
    rows = distribution.histogram(spark.createDataFrame([(v,) for v in data], "v double"), "v").collect()
    assert len(rows) == 20
    assert sum(r["count"] for r in rows) == len(data)


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in range(11)], "v double")
    rows = distribution.histogram(df, "v", bins=10).orderBy("bin").collect()
    assert [r["count"] for r in rows] == [1] * 9 + [2]
    empty = spark.createDataFrame([(None,)], "v double")
    assert distribution.histogram(empty, "v").count() == 0


def test_correlation_degenerate(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (None, 9.0, 5.0)], "a double, b double, c double")
    cells = {(r["a"], r["b"]): r["r"] for r in distribution.correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert cells[("a", "b")] == 1.0 and cells[("a", "c")] is None and cells[("c", "c")] is None
    assert len(cells) == 9
    assert distribution.correlation_matrix(df, ["a"]).count() == 0
    assert distribution.correlation_matrix(df.limit(0), ["a", "b"]).count() == 0
    assert values(distribution.strong_pairs(df, ["a", "b", "c"]), "a", "b", "r") == [("a", "b", 1.0)]


def test_correlation_of_many_columns_by_blocks(spark):
    rng = random.Random(3)
    names = [f"c{i}" for i in range(21)]
    base = [[rng.gauss(0, 1) for _ in range(60)] for _ in range(4)]
    cols = [[1e6 + b + rng.gauss(0, 0.1 * (i + 1)) for b in base[i % 4]] for i in range(20)] + [[2.5] * 60]
    df = spark.createDataFrame(list(zip(*cols)), ", ".join(f"{n} double" for n in names))
    got = {(r["row"], r["col"]): r["r"] for r in distribution.correlation_matrix(df, names).collect()}
    assert len(got) == 21 * 21
    for i in range(21):
        for j in range(21):
            if 20 in (i, j):
                assert got[i, j] is None
            else:
                assert math.isclose(got[i, j], statistics.correlation(cols[i], cols[j]), abs_tol=6e-4)


def test_correlation_of_two_hundred_columns(spark):
    """One scan, one group a block; nothing as wide as the square of the columns."""
    names = [f"c{i}" for i in range(200)]
    df = spark.range(300).select(*[((F.col("id") * (2 * i + 3)) % 101).cast("double").alias(n) for i, n in enumerate(names)])
    pairs = distribution.correlations(df, names)
    found = {(r["a"], r["b"]): r["r"] for r in pairs.collect()}
    assert len(found) == 200 * 201 // 2
    assert found["c3", "c49"] is None  # constant
    rows = df.select("c3", "c151", "c199").collect()
    for a, b in (("c3", "c151"), ("c151", "c199")):
        assert math.isclose(found[a, b], statistics.correlation([r[a] for r in rows], [r[b] for r in rows]), abs_tol=6e-4)


def test_anomalies_need_five_values_and_some_spread(spark):
    few = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 1, 1, 99])], "id int, v double")
    flat = spark.createDataFrame([(i, 1.0) for i in range(9)], "id int, v double")
    assert distribution.anomalies(few, "v", "id").count() == 0
    assert distribution.anomalies(flat, "v", "id").count() == 0
    assert distribution.anomaly_summary(flat, "v").first()["count"] == 0
    odd = spark.createDataFrame([(i, 1000.0 if i == 7 else 1.0) for i in range(50)], "id int, v double")
    assert values(distribution.anomalies(odd, "v", "id"), "id") == [(7,)]
    assert distribution.anomaly_summary(odd, "v").first()["count"] == 1


# --- aggregation -------------------------------------------------------------------


def test_aggregate_all_null_group(spark):
    df = spark.createDataFrame([("a", None, 1), ("b", 2.0, 2), (None, 5.0, 3)], "k string, v double, o int")
    assert values(aggregate.aggregate_by(df, "k", "v", "sum"), "k", "sum_v") == [("b", 2.0), ("a", 0.0)]
    assert values(aggregate.aggregate_by(df, "k", "v", "median"), "k", "median_v") == [("b", 2.0), ("a", None)]
    assert values(aggregate.aggregate_by(df, "k", "v", "first", "o"), "first_v") == [(2.0,), (None,)]
    with pytest.raises(ValueError):
        aggregate.aggregate_by(df, "k", "v", "mode")
    with pytest.raises(ValueError):
        aggregate.aggregate_by(df, "k", "v", "last")


def test_running_total_over_thousands_of_ranges(spark):
    df = spark.range(20_000).select(F.pmod(F.xxhash64("id"), F.lit(3001)).cast("double").alias("v"), "id")
    order = [-F.col("v"), F.col("id")]
    out = running_total(df, order, "v", ranges=3000)
    rows = sorted(values(df, "v", "id"), key=lambda r: (-r[0], r[1]))
    past, want = 0.0, []
    for place, (v, i) in enumerate(rows, 1):
        past += v
        want.append((place, v, i, past))
    assert sorted(values(out, "position", "v", "id", "running")) == want
    assert set(values(out, "total")) == {(past,)}
    placed = prefix.with_range(df, order, prefix.cut_points(df, order, 3000))
    assert placed.agg(F.count_distinct("_range")).first()[0] > 2500
    # No window over all rows or all ranges: each is split by a range or a part, but for the dozen totals of parts.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Window [" in line and "_part" not in line and "_range#" not in line.split("],", 1)[-1] for line in plan.splitlines()) <= 1
    assert running_total(df.limit(0), order, "v", ranges=3000).count() == 0


@pytest.mark.parametrize("ranges", [1, 2, 7, 256, 300])
def test_ranges_count_the_cuts_at_or_before_a_row(spark, ranges):
    df = spark.range(500).selectExpr("id % 50 as k", "id")
    order = [F.col("k"), F.col("id")]
    cuts = prefix.cut_points(df, order, ranges)
    flat = [tuple(c) for run in cuts.first()["cuts"] or [] for c in run]
    assert flat == sorted(flat) and len(flat) <= ranges
    for k, i, found in values(prefix.with_range(df, order, cuts), "k", "id", "_range"):
        assert found == sum(c <= (k, i) for c in flat)


def test_distinct_counts_of_all_kinds(spark):
    rng = random.Random(4)
    rows = []
    for i in range(3000):
        rows.append((
            rng.choice([None, -(2**63), 2**63 - 1, -1, 0, 63, 64, rng.randrange(-500, 500)]), rng.randrange(200) - 100,
            rng.random() < 0.5, dt.date(1969, 12, 1) + dt.timedelta(days=rng.randrange(90)), rng.choice([NAN, 0.0, -0.0, 1.5, None]),
            rng.choice("abcdé") * rng.randrange(3), None, dt.datetime(2024, 3, 31, rng.randrange(4), 30), {"k": i % 7}, [i % 5],
        ))
    df = spark.createDataFrame(rows, "a long, b short, c boolean, d date, e double, f string, g int, h timestamp_ntz, i map<string,int>, `j.j` array<int>")
    got = dict(values(aggregate.distinct_counts(df), "column", "distinct_count"))
    plain = lambda v: None if v is None or v != v else str(v) if isinstance(v, (dict, list)) else v + 0.0 if isinstance(v, float) else v
    want = {c: len({plain(r[k]) for r in rows} - {None}) for k, c in enumerate(df.columns)}
    assert got == want
    counted = {r["column"]: r["unique_count"] for r in profile.column_counts(df).collect()}
    assert counted == want
    assert set(values(aggregate.distinct_counts(df.limit(0)), "distinct_count")) == {(0,)}
    some = values(aggregate.distinct_counts(df, ["f", "a"]), "ordinal", "column")
    assert sorted(some) == [(0, "f"), (1, "a")]


def test_whole_columns_take_one_scan_and_words_can_be_joined(spark, data):
    lines = spark.read.parquet(f"{data}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    found = distinct.distinct_values(lines, lines.columns)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "SortAggregate" not in plan and "Python" not in plan
    columns = distinct.whole_columns(lines, lines.columns)
    parts = [distinct.words(lines.where(F.col("l_orderkey") % 3 == k), columns) for k in range(3)]
    assert sorted(distinct.counted_words(distinct.joined_words(parts)).collect()) == sorted(found.collect())
    keys = spark.range(1_000_000).select("id")
    assert distinct.words(keys, distinct.whole_columns(keys, ["id"])).count() == 15_625


def test_approximate_counts_have_the_same_shape(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a")], "i int, s string")
    assert sorted(values(aggregate.distinct_counts(df, approximate=True), "column", "distinct_count")) == [
        ("i", 2), ("s", 1)]
    exact, rough = profile.column_profile(df), profile.column_profile(df, approximate=True)
    assert exact.schema.names == rough.schema.names
    assert sorted(exact.collect()) == sorted(rough.collect())


# --- profile -----------------------------------------------------------------------


def test_typing_rules(spark):
    df = spark.createDataFrame(
        [(i, f"u{i}", i % 2 == 0, "x" if i % 3 else "y", 2020 + i % 3, 1.0 * i, 0.5, f"t{i}", "Rome", "later")
         for i in range(120)],
        "order_id int, invoice_no string, active boolean, color string, Year int, lifetime_value double, "
        "tax_rate double, remark string, city string, due_date string",
    )
    rows = {r["column"]: (r["semantic_type"], r["role"]) for r in profile.column_profile(df).collect()}
    assert rows == {
        "order_id": ("id", "id"),
        "invoice_no": ("id", "id"),
        "active": ("boolean", "dimension"),
        "color": ("category", "dimension"),
        "Year": ("numeric", "dimension"),
        "lifetime_value": ("numeric", "measure"),
        "tax_rate": ("percentage", "measure"),
        "remark": ("text", None),
        "city": ("geo", "dimension"),
        "due_date": ("category", "dimension"),
    }


def test_primary_columns_follow_the_priority_words(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0, "a", "b", day("2024-01-01"))] * 3,
        "units double, total_sales double, colour string, sales_region string, day date",
    )
    found = profile.column_profile(df)
    assert values(profile.primary_columns(found), "measure", "date_column", "dimension") == [
        ("total_sales", "day", "sales_region")]
    assert values(profile.primary_columns(found, exclude=["sales_region"]), "dimension") == [("colour",)]
    roles = profile.roles_of(found)
    assert (roles.measure, roles.date, roles.dimension) == ("total_sales", "day", "sales_region")


def test_date_features_leave_existing_names(spark):
    df = spark.createDataFrame([(day("2024-12-30"), 5)], "d date, d__Year int")
    out, made = profile.add_date_features(df, ["d", "gone"])
    row = out.first()
    assert "d__Year" not in made and len(made) == 6
    assert (row["d__Year"], row["d__Week"], row["d__Weekday"], row["d__MonthName"]) == (5, 1, "Monday", "Dec")


def test_column_stats_skip_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None), (4.0, NAN)], "a double, b double")
    rows = values(profile.column_stats(df, ["a", "b"]), "column", "median", "sum")
    assert rows == [("a", 2.5, 5.0)]


# --- quality -----------------------------------------------------------------------


def test_duplicates_count_copies_with_nulls_equal(spark):
    rows = [(1, None, "a", 0.5, True)] * 3 + [(1, None, "b", NAN, True)] * 2 + [(None, 1, "a", 0.5, True)]
    df = spark.createDataFrame(rows, "a int, b int, c string, d double, e boolean")
    assert values(quality.duplicate_rows(df), "total_rows", "duplicate_rows") == [(6, 3)]
    assert values(quality.duplicate_rows(df, ["a"]), "duplicate_rows") == [(4,)]


def test_iqr_needs_four_values(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (900.0,)], "v double")
    assert values(quality.iqr_outliers(df, ["v"]), "lower", "outliers") == [(None, 0)]


def test_empty_table_scores_full_marks(spark):
    df = spark.createDataFrame([], "a int, b string")
    assert quality.quality_score(df).first()["quality_score"] == 100.0
    assert values(quality.null_report(df), "null_pct") == [(0.0,), (0.0,)]


# --- filters -----------------------------------------------------------------------


def test_filters(spark):
    df = spark.createDataFrame([("East",), ("west",), (None,)], "r string")
    assert values(filters.apply_filters(df, [{"column": "r", "op": "eq", "value": "EAST"}]), "r") == [("East",)]
    assert df.where(filters.text_differs("r", "east")).count() == 2
    assert filters.apply_filters(df, [{"column": "r", "op": "year_eq", "value": "x"}]).count() == 3
    assert filters.filter_contains(df, {"r": "E.?S"}).count() == 2
    assert filters.filter_contains(df, {"r": "E.?S"}, literal=True).count() == 0


def test_new_filters_replace_those_on_the_same_column():
    old = [{"column": "a", "op": "eq", "value": 1}, {"column": "b", "op": "eq", "value": 2}]
    new = [{"column": "a", "op": "neq", "value": 3}]
    assert filters.merge_filters(old, new) == [old[1], new[0]]


def test_year_filter_reaches_the_scan(spark, data):
    orders = spark.read.parquet(f"{data}/orders.parquet")
    found = orders.where(filters.year_equals(orders, "o_orderdate", 1997)).select("o_orderkey")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan


# --- sources and sinks ----------------------------------------------------------------


@pytest.mark.parametrize(
    "config, url",
    [
        ({"type": "mysql", "host": "h", "database": "d"}, "jdbc:mysql://h:3306/d"),
        ({"type": "PostgreSQL", "database": "d"}, "jdbc:postgresql://localhost:5432/d"),
        ({"type": "sqlite", "database": "/x/y.db"}, "jdbc:sqlite:/x/y.db"),
        ({"type": "sqlserver", "host": "h", "port": 7, "database": "d"}, "jdbc:sqlserver://h:7;databaseName=d"),
    ],
)
def test_database_urls(config, url):
    assert tables.jdbc_url(config) == url


def test_refusals(spark):
    with pytest.raises(ValueError):
        tables.jdbc_url({"type": "oracle"})
    with pytest.raises(ValueError):
        tables.read_table(spark, "/x/book.xlsx")
    with pytest.raises(ValueError):
        tables.check_table_name("a; drop table b")
    with pytest.raises(ValueError):
        tables.sample_table(spark.range(5), rows=5)
    for text in ("DELETE FROM t", "selection", "", "DROP TABLE t"):
        with pytest.raises(ValueError):
            tables.guarded_select(spark, text)
    with pytest.raises(AnalysisException):
        tables.guarded_select(spark, "SELECT 1; DROP TABLE t")


def test_guarded_select_is_capped(spark):
    spark.range(50).createOrReplaceTempView("fifty")
    assert tables.guarded_select(spark, "SELECT id, 'LIMIT' AS t FROM fifty;", limit=7).count() == 7
    assert tables.guarded_select(spark, "WITH a AS (SELECT id FROM fifty) SELECT * FROM a").count() == 50


@pytest.mark.parametrize("text", [
    "SELECT java_method('java.lang.System', 'getProperty', 'user.home')",
    "SELECT id FROM fifty WHERE reflect('java.lang.System', 'getProperty', 'user.home') <> ''",
    "SELECT (SELECT max(try_reflect('java.lang.System', 'getProperty', 'a')) FROM fifty) FROM fifty",
    "SELECT * FROM text.`/etc/hostname`",
    "SELECT * FROM (SELECT * FROM parquet.`/tmp/x`) t JOIN fifty",
    "WITH a AS (SELECT * FROM csv.`/etc/passwd`) SELECT * FROM a",
    "SELECT input_file_name() FROM fifty",
    "SELECT TRANSFORM(id) USING 'cat' AS (x) FROM fifty",
    "SELECT * FROM not_there",
    "SELECT * FROM IDENTIFIER('text.`/etc/hostname`')",
    "SELECT '${spark.app.name}'",
    "SELECT own_function(id) FROM fifty",
    "WITH a AS (SELECT 1 AS id) INSERT INTO fifty SELECT * FROM a",
    "SELECT * FROM read_files('/etc')",
])
def test_guard_refuses_what_leaves_the_rows(spark, text):
    spark.range(50).createOrReplaceTempView("fifty")
    spark.udf.register("own_function", lambda x: x)
    with pytest.raises(ValueError):
        tables.guarded_select(spark, text)


def test_guard_lets_queries_pass(spark):
    spark.range(50).createOrReplaceTempView("fifty")
    for text in (
        "SELECT f.id, explode(sequence(1, 2)) AS n FROM fifty f LATERAL VIEW explode(array(1)) e AS x",
        "SELECT transform(collect_list(id), x -> x + 1) AS v FROM (VALUES (1), (2)) AS t(id)",
        "WITH A AS (SELECT id FROM fifty) (SELECT id FROM a UNION SELECT id FROM range(9)) EXCEPT SELECT 3",
        "SELECT sum(id) OVER (ORDER BY id) FROM fifty",
        "SELECT * FROM (SELECT id, id % 2 AS k FROM fifty) PIVOT (sum(id) FOR k IN (0, 1))",
    ):
        tables.guarded_select(spark, text).collect()
    with pytest.raises(ValueError):
        tables.guarded_select(spark, "SELECT * FROM fifty", tables=["other"])
    spark.udf.register("own_function", lambda x: x)
    assert tables.guarded_select(spark, "SELECT own_function(id) FROM fifty", tables=["FIFTY"], functions=["own_function"]).count() == 50


def test_json_keeps_nulls(spark):
    df = spark.createDataFrame([(1, NAN, dt.datetime(2024, 1, 2, 3, 4, 5))], "a int, b double, c timestamp_ntz")
    assert sinks.json_rows(df).first()["json"] == '{"a":1,"b":null,"c":"2024-01-02T03:04:05"}'


def test_export_blocks(spark, tmp_path):
    paths = sinks.export_blocks({"one": spark.range(3), "two": spark.range(1)}, str(tmp_path))
    assert {name: spark.read.json(path).count() for name, path in paths.items()} == {"one": 3, "two": 1}


def test_schema_listing_without_keys_reads_nothing(spark):
    df = spark.createDataFrame([(1, "a")], "k int, `a b` string").withColumn("c", F.raise_error(F.lit("read")))
    rows = tables.schema_listing({"t": df}).collect()
    assert [(r["table_name"], r["ordinal"], r["column"]) for r in rows] == [("t", 0, "k"), ("t", 1, "a b"), ("t", 2, "c")]
    assert {r["inferred_key"] for r in rows} == {None}
