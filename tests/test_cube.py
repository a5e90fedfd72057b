"""Blocks of the overview from the shared cube against the operators on the table itself."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tallywise.operators import distribution, filters, kpi, ranking, series
from tallywise.operators.aggregate import drill_geo, drill_time
from tallywise.operators.contribution import pareto
from tallywise.operators.cube import moment_cube
from tallywise.operators.profile import Roles, column_profile, roles_of
from tallywise.plans import answers, findings

SCHEMA = "id long, day timestamp_ntz, region string, city string, code long, amount double, rows double, units long"


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rng = random.Random(4)
    regions = ["north", "south", "", None, "hot", "hot", "hot"]
    rows = []
    for i in range(900):
        day = dt.datetime(2022, 11, 3) + dt.timedelta(days=rng.randrange(800)) if rng.random() > 0.05 else None
        amount = rng.choice([None, math.nan, -3.5, 0.0, rng.gauss(50, 20), rng.gauss(50, 20)])
        rows.append((i, day, rng.choice(regions), rng.choice(["a", "b", None]), rng.choice([1, 2, None]), amount,
                     rng.uniform(0, 9), rng.choice([None, rng.randrange(90)])))
    path = str(tmp_path_factory.mktemp("cube") / "sales")
    spark.createDataFrame(rows, SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def roles(table):
    found = roles_of(column_profile(table))
    return Roles(**{
        **found.__dict__, "measures": ("amount", "rows", "units"), "measure": "amount", "dates": ("day",), "date": "day",
        "dimensions": ("region", "city", "code"), "dimension": "region", "geo": ("region", "city"),
    })


def same(got, wanted):
    assert got.dtypes == wanted.dtypes
    near = lambda v: round(v, 6) if isinstance(v, float) else [near(x) for x in v] if isinstance(v, (list, tuple)) else v
    assert sorted(map(repr, map(near, got.collect()))) == sorted(map(repr, map(near, wanted.collect())))


def direct(df, roles):
    measures, m, d, date = list(roles.measures), roles.measure, roles.dimension, roles.date
    return {
        "kpis": kpi.kpi_summary(df, measures, date, 6),
        "trend": series.trend(df, date, m),
        "top": ranking.top_n(df, d, m),
        "pareto": pareto(df, d, m).orderBy("position").limit(50),
        "correlation": distribution.correlation_matrix(df, measures),
        "strong_pairs": distribution.strong_pairs(df, measures),
        "slicers": filters.slicer_values(df, list(roles.dimensions)),
        "slicer_dates": filters.slicer_dates(df, date),
        "drill_time": drill_time(df, date, m),
        "drill_geo": drill_geo(df, list(roles.geo), m),
        "insights": findings.insights(df, measures, m, d, date),
        "recommendations": findings.recommendations(df, measures, m, d, date),
    }


def test_blocks_are_those_of_the_table(table, roles):
    wanted = direct(table, roles)
    blocks = answers.overview(table, roles, "id", only=tuple(wanted))
    assert set(blocks) == set(wanted)
    for name in wanted:
        same(blocks[name], wanted[name])
    empty = table.limit(0)
    blocks, wanted = answers.overview(empty, roles, "id", only=tuple(wanted)), direct(empty, roles)
    for name in wanted:
        same(blocks[name], wanted[name])


def test_without_dates_dimension_or_measures(table, roles):
    bare = Roles(**{**roles.__dict__, "dates": (), "date": None, "geo": ()})
    blocks = answers.overview(table, bare, "id", only=("kpis", "top", "slicers"))
    same(blocks["kpis"], kpi.kpi_summary(table, list(bare.measures), None, 6))
    same(blocks["top"], ranking.top_n(table, "region", "amount"))
    bare = Roles(**{**roles.__dict__, "dimension": None, "dimensions": (), "geo": ()})
    blocks = answers.overview(table, bare, "id", only=("trend", "drill_time"))
    same(blocks["trend"], series.trend(table, "day", "amount"))
    same(blocks["drill_time"], drill_time(table, "day", "amount"))
    bare = Roles(**{**roles.__dict__, "measures": (), "measure": None})
    blocks = answers.overview(table, bare, "id", only=("slicers", "slicer_dates"))
    same(blocks["slicers"], filters.slicer_values(table, list(bare.dimensions)))
    same(blocks["slicer_dates"], filters.slicer_dates(table, "day"))


def test_ten_blocks_read_the_table_twice(table, roles):
    names = [n for n in direct(table, roles) if n not in ("insights", "recommendations")]
    blocks = answers.overview(table, roles, "id", only=tuple(names))
    own = set(table.inputFiles())
    assert own and not any(own & set(blocks[n].inputFiles()) for n in names)


def test_cells_of_all_grains_hold_every_row(table):
    taken = moment_cube(table, ["amount", "units"], "region", "day", ["region", "city"], ["region", "city"])
    assert taken.cells.select(F.sum("n")).first()[0] == 4 * table.count()
    assert len(taken.cells.select("grain").distinct().collect()) == 4
    assert taken.cells.count() < table.count()
