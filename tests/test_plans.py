"""Profile, overview and answers end to end, and the shape of some plans."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tallywise.operators import aggregate, contribution, kpi, profile, ranking, series
from tallywise.operators import questions as ops
from tallywise.plans import answers, findings
from tallywise.sources.sinks import export_blocks, json_rows


@pytest.fixture(scope="module")
def sales(spark):
    """365 daily rows of the shape the smoke test uses."""
    rng = random.Random(7)
    rows = []
    for i in range(365):
        revenue = round(max(0.0, rng.gauss(820, 190)) + 310 * i / 364, 2)
        rows.append((
            dt.datetime(2024, 1, 1) + dt.timedelta(days=i),
            rng.choice(["Harbour", "Valley", "Ridge", "Plain"]),
            rng.choice(["Tools", "Paper", "Seeds", "Lamps"]),
            revenue,
            round(revenue * rng.uniform(0.15, 0.35), 2),
            rng.randint(1, 49),
        ))
    return spark.createDataFrame(
        rows, "OrderDate timestamp_ntz, Region string, Category string, Revenue double, Profit double, Units bigint"
    ).cache()


@pytest.fixture(scope="module")
def profiled(sales):
    return answers.profile_table(sales, "orders")


def test_profile(profiled):
    assert profiled.table.count() == 365
    assert "OrderDate__Year" in profiled.table.columns and len(profiled.engineered) == 7
    roles = profiled.roles
    assert roles.measures == ("Revenue", "Profit", "Units")
    assert roles.dimensions == ("Region", "Category")
    assert roles.dates == ("OrderDate",)
    assert (roles.measure, roles.dimension, roles.date) == ("Revenue", "Category", "OrderDate")
    assert profiled.domain.first()["domain"] in {"sales", "retail"}
    assert profiled.quality().first()["quality_score"] == 100.0
    assert profiled.stats().count() == 3


def test_workbook(spark, sales):
    book = answers.profile_workbook({"a": sales.limit(5), "b": sales})
    assert list(book) == ["a", "b"]
    summary = profile.workbook_summary({n: p.source for n, p in book.items()}).first()
    assert (summary["sheet_count"], summary["total_rows"], summary["primary_sheet"]) == (2, 370, "b")


def test_overview(spark, profiled, tmp_path):
    blocks = answers.overview(profiled.source, profiled.roles, "OrderDate", profiled.domain)
    sizes = {r["block"]: r["rows"] for r in answers.overview_blocks(blocks).collect()}
    assert sizes["kpis"] == 3 and sizes["trend"] == 12 and sizes["histogram"] == 20
    assert sizes["correlation"] == 9 and sizes["top"] == 4 and sizes["insights"] > 0
    assert "drill_geo" not in sizes
    some = {n: blocks[n] for n in ("trend", "kpis")}
    paths = export_blocks(some, str(tmp_path))
    assert spark.read.json(paths["trend"]).count() == 12
    assert all(r["json"].startswith("{") for r in json_rows(blocks["kpis"]).collect())


def test_smoke_question(spark, profiled):
    asked = spark.createDataFrame([(1, "Show me top 5 regions by revenue")], "id int, q string")
    intent = ops.tag_questions(asked, "id", "q", profiled.roles).first()
    assert intent["op"] == "top"
    blocks = answers.answer(
        profiled.source, profiled.roles, intent["op"], intent["measure"], intent["dimension"], n=intent["n"]
    )
    totals = [r["Revenue"] for r in blocks["top"].collect()]
    assert len(totals) == 4 and totals == sorted(totals, reverse=True)


def test_answers_fall_back_to_what_is_there(profiled):
    source, roles = profiled.source, profiled.roles
    assert answers.answer(source, roles, "greeting") == {}
    assert set(answers.answer(source, roles, "summary")) == {"top"}
    no_dimension = profile.Roles(**{**roles.__dict__, "dimensions": (), "dimension": None})
    assert set(answers.answer(source, no_dimension, "summary")) == {"trend"}
    only_measure = profile.Roles(**{**no_dimension.__dict__, "dates": (), "date": None})
    assert set(answers.answer(source, only_measure, "forecast")) == {"kpis", "histogram"}
    nothing = profile.Roles(**{**only_measure.__dict__, "measures": (), "measure": None})
    assert answers.answer(source, nothing, "anomaly") == {}
    east = answers.answer(source, roles, "top", dimension="Region",
                          active_filters=[{"column": "Region", "op": "eq", "value": "valley"}])
    assert [r["Region"] for r in east["top"].collect()] == ["Valley"]
    nth = answers.answer(source, roles, "nth", dimension="Region", nth_index=9)
    assert nth["nth"].count() == 0 and nth["availability"].first()["available"] == 4


def test_findings_without_content(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(6)], "id int, v double")
    assert findings.insights(df, ["v"], "v").count() == 0
    general = findings.recommendations(df, ["v"], "v").collect()
    assert [r["kind"] for r in general] == ["general"]
    told = findings.query_insights(df, "correlation", df, ["id", "v"], "v", None, None).first()
    assert told["kind"] == "no_pair"


def test_advice_per_answer(spark):
    asked = spark.createDataFrame(
        [("top", False), ("top", True), ("trend", False), ("summary", False)], "op string, ascending boolean"
    )
    rows = {(r["op"], r["ascending"]): r["message"] for r in findings.query_recommendations(asked).collect()}
    assert rows[("top", False)] != rows[("top", True)]
    assert rows[("summary", False)] == findings.GENERAL_ADVICE


# --- plans -------------------------------------------------------------------------------


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_stay_in_the_jvm_and_read_few_columns(spark, data):
    orders = spark.read.parquet(f"{data}/orders.parquet")
    lines = spark.read.parquet(f"{data}/lineitem.parquet")
    plans = {
        "trend": plan_of(series.trend(orders, "o_orderdate", "o_totalprice")),
        "top": plan_of(ranking.top_n(orders, "o_custkey", "o_totalprice")),
        "kpi": plan_of(kpi.kpi_totals(lines, ["l_quantity", "l_tax"])),
        "drill": plan_of(aggregate.drill_time(orders, "o_orderdate", "o_totalprice")),
    }
    for text in plans.values():
        assert "Python" not in text and "CartesianProduct" not in text and "NestedLoop" not in text
        assert "partial_sum" in text
    assert "ReadSchema: struct<o_totalprice:double,o_orderdate:timestamp_ntz>" in plans["trend"]
    assert "ReadSchema: struct<o_custkey:bigint,o_totalprice:double>" in plans["top"]
    assert "TakeOrderedAndProject" in plans["top"]
    assert plans["kpi"].count("FileScan") == 1


def test_large_pareto_has_no_window_over_all_groups(spark, data):
    lines = spark.read.parquet(f"{data}/lineitem.parquet")
    text = plan_of(contribution.pareto(lines, "l_partkey", "l_quantity"))
    windows = [line for line in text.splitlines() if "Window [" in line and "l_partkey" in line]
    assert windows and all("[_range#" in line for line in windows)


def test_values_agree_with_a_plain_loop(spark, data):
    orders = spark.read.parquet(f"{data}/orders.parquet").where(F.col("o_custkey") < 20)
    rows = [(r["o_custkey"], r["o_totalprice"]) for r in orders.collect()]
    totals = {}
    for key, value in rows:
        totals[key] = totals.get(key, 0.0) + value
    expected = sorted(totals.items(), key=lambda kv: (-kv[1], kv[0]))[:3]
    got = [(r["o_custkey"], r["o_totalprice"]) for r in ranking.top_n(orders, "o_custkey", "o_totalprice", 3).collect()]
    assert [k for k, _ in got] == [k for k, _ in expected]
    assert all(math.isclose(a, b) for (_, a), (_, b) in zip(got, expected))


@pytest.mark.parametrize("text,blocks", [
    ("top 2 regions by revenue", {"top"}),
    ("revenue trend", {"trend"}),
    ("forecast revenue for 3 months", {"forecast"}),
    ("the second region by revenue", {"nth", "availability"}),
    ("find anomalies in profit", {"anomalies", "anomaly_summary"}),
    ("correlation between revenue and profit", {"correlation", "strong_pairs"}),
    ("hello", set()),
])
def test_tagged_questions_are_answered(spark, profiled, text, blocks):
    asked = spark.createDataFrame([(1, text)], "id int, q string")
    intent = ops.tag_questions(asked, "id", "q", profiled.roles).first()
    made = answers.answer_question(profiled.source, profiled.roles, intent, row_key="OrderDate")
    assert set(made) == blocks
    compare = [{"column": "OrderDate", "op": "compare_yoy", "value": None}]
    again = answers.answer_question(profiled.source, profiled.roles, intent, compare, "OrderDate")
    assert set(again) == (blocks | {"yoy"} if blocks else set())
