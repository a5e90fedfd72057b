"""Look-up of named values in a stored dictionary instead of the table itself.

The dictionary holds the distinct values of the dimension columns, one row per file, column
and value, in folders by a hash of the value.  Each file is read once; one that has changed is
read again, and the values of one that is gone are no longer found.  A look-up reads the
dictionary and the list of files; it opens none of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coerce import name_of
from .profile_state import _listing, _plain

BUCKETS = 32  # folders of a dictionary, fixed for its lifetime

FILE = "file string, size bigint, changed timestamp"
VALUES = f"{FILE}, column string, folded string, bucket int"
NOTES = f"{FILE}, column string"
SAME = ["file", "size", "changed"]


def _bucket(folded: Column) -> Column:
    return F.pmod(F.xxhash64(folded), F.lit(BUCKETS)).cast("int")


def _present(spark: SparkSession, source: str) -> DataFrame:
    return _listing(spark, source).withColumn("file", _plain(F.col("file")))


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as error:  # nothing stored yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def update(spark: SparkSession, source: str, index: str, dimensions: list[str]) -> int:
    """Add the values of files, or of dimensions, that ``index`` does not know; returns the number of files read.

    Columns that a file lacks, and nulls, add nothing.  An update that was broken off is
    repeated by the next one: files are noted as known after their values are stored.
    """
    columns = F.explode(F.array(*[F.lit(d) for d in dict.fromkeys(dimensions)]))
    asked = _listing(spark, source).withColumn("path", F.col("file")).withColumn("file", _plain(F.col("file"))).withColumn("column", columns)
    new = asked.join(_read(spark, f"{index}/files", NOTES), [*SAME, "column"], "left_anti").collect()
    if not new:
        return 0
    paths = sorted({r["path"] for r in new})
    rows = spark.read.option("mergeSchema", True).parquet(*paths)
    held = [d for d in dict.fromkeys(r["column"] for r in new) if d in rows.columns]
    if held:
        file = F.col("_metadata")
        cells = [F.struct(F.lit(d).alias("column"), F.lower(name_of(d).cast("string")).alias("folded")) for d in held]
        long = rows.select(
            _plain(file["file_path"]).alias("file"),
            file["file_size"].alias("size"),
            file["file_modification_time"].alias("changed"),
            F.inline(F.array(*cells)),
        )
        values = long.where("folded is not null").distinct().withColumn("bucket", _bucket(F.col("folded")))
        values.repartition("bucket", "folded").write.mode("append").partitionBy("bucket").parquet(f"{index}/values")
    notes = [(r["file"], r["size"], r["changed"], r["column"]) for r in new]
    spark.createDataFrame(notes, NOTES).coalesce(1).write.mode("append").parquet(f"{index}/files")
    return len(paths)


def lookup(spark: SparkSession, source: str, index: str, dimensions: list[str], literals: DataFrame) -> DataFrame:
    """The first dimension that holds each literal, whatever the case: (literal, column).

    The answer is that of ``filters.literal_lookup`` on the files as of the last update;
    no file of ``source`` is opened.
    """
    asked = literals.select("literal").distinct().withColumn("folded", F.lower("literal")).withColumn("bucket", _bucket(F.col("folded")))
    place = F.array_position(F.array(*[F.lit(d) for d in dimensions]), F.col("column"))
    held = (
        _read(spark, f"{index}/values", VALUES)
        .withColumn("place", place)
        .where("place > 0")
        .join(asked.select("bucket", "folded").distinct(), ["bucket", "folded"], "left_semi")
        .join(_present(spark, source), SAME, "left_semi")
        .groupBy("folded")
        .agg(F.min_by("column", "place").alias("column"))
    )
    return asked.join(held, "folded").select("literal", "column")
