"""The stored dictionary of values against a look-up in the table itself."""

import shutil

from tallywise.operators import filters, value_index
from tallywise.operators import questions as ops

DIMENSIONS = ["region", "kind"]


def write(spark, rows, folder, schema="region string, kind string, n int"):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def pairs(df):
    return sorted(tuple(r) for r in df.select("literal", "column").collect())


def test_equals_the_look_up_in_the_table_as_it_grows(spark, tmp_path):
    source, index = str(tmp_path / "table"), str(tmp_path / "index")
    asked = spark.createDataFrame([(v,) for v in ("east", "EAST", "Bike", "west", "both", "none", "", None)], "literal string")
    steps = [
        [("East", "bike", 1), ("north", None, 2), (None, "Both", 3)],
        [("West", "east", 1), ("both", "car", 2)],
        [("", "bike", 1)] * 50,
    ]
    for rows in steps:
        write(spark, rows, source)
        assert value_index.update(spark, source, index, DIMENSIONS) == 1
        assert value_index.update(spark, source, index, DIMENSIONS) == 0
        found = value_index.lookup(spark, source, index, DIMENSIONS, asked)
        assert pairs(found) == pairs(filters.literal_lookup(spark.read.parquet(source), DIMENSIONS, asked))
    # The order of the dimensions is the asker's.
    other = value_index.lookup(spark, source, index, DIMENSIONS[::-1], asked)
    assert ("both", "kind") in pairs(other) and ("both", "region") in pairs(found)


def test_look_up_opens_no_file_of_the_source(spark, tmp_path):
    source, index = str(tmp_path / "table"), str(tmp_path / "index")
    write(spark, [("East", "bike", 1)], source + "/day=1")
    write(spark, [("West", "car", 1)], source + "/day=2")
    assert value_index.update(spark, source, index, DIMENSIONS) == 2
    asked = spark.createDataFrame([("west",), ("car",)], "literal string")
    found = value_index.lookup(spark, source, index, DIMENSIONS, asked)
    plan = found._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "Scan parquet" in line]
    assert len(scans) == 1 and "folded" in scans[0] and "PartitionFilters" in scans[0] and "Python" not in plan
    assert "content" not in plan
    assert pairs(found) == [("car", "kind"), ("west", "region")]
    # A file that is gone holds nothing; a dimension that is new is read once.
    shutil.rmtree(source + "/day=2")
    assert pairs(value_index.lookup(spark, source, index, DIMENSIONS, asked)) == []
    assert value_index.update(spark, source, index, [*DIMENSIONS, "n"]) == 1
    number = spark.createDataFrame([("1",)], "literal string")
    assert pairs(value_index.lookup(spark, source, index, [*DIMENSIONS, "n"], number)) == [("1", "n")]


def test_filters_of_questions_through_the_dictionary(spark, tmp_path):
    source, index = str(tmp_path / "table"), str(tmp_path / "index")
    write(spark, [("East", "bike", 1), ("West", "car", 2)], source)
    value_index.update(spark, source, index, DIMENSIONS)
    log = spark.createDataFrame([(1, "sales for 'west' in 2024"), (2, "only 'Bike'"), (3, "excluding east"), (4, None)], "id int, q string")
    data = spark.read.parquet(source)
    plain = ops.question_filters(log, "id", "q", data, DIMENSIONS, "day")
    stored = ops.question_filters(
        log, "id", "q", None, DIMENSIONS, "day", lookup=lambda asked: value_index.lookup(spark, source, index, DIMENSIONS, asked)
    )
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(map(key, stored.collect())) == sorted(map(key, plain.collect())) != []
