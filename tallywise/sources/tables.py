"""Files, databases and catalog tables as DataFrames."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coerce import name_of
from ..operators.cleaning import clean_headers
from ..operators.profile import column_counts
from . import guard

# Databases, their default ports and the URL each driver expects.
DATABASES = {
    "mysql": (3306, "jdbc:mysql://{host}:{port}/{database}"),
    "postgresql": (5432, "jdbc:postgresql://{host}:{port}/{database}"),
    "sqlite": (None, "jdbc:sqlite:{database}"),
    "sqlserver": (1433, "jdbc:sqlserver://{host}:{port};databaseName={database}"),
}
SAMPLE_ROWS, SAMPLE_MIN, SAMPLE_MAX = 5_000, 10, 200_000
RESULT_ROWS, RESULT_MAX = 1_000, 10_000
TABLE_NAME = re.compile(r"[A-Za-z0-9_.]+")
FORMATS = {".csv": "csv", ".parquet": "parquet", ".json": "json", ".orc": "orc"}


def read_csv(spark: SparkSession, path: str, schema: str | None = None, **options) -> DataFrame:
    """CSV with a header row and stripped names.

    Without ``schema`` the types are inferred, which reads the file twice.
    """
    reader = spark.read.option("header", True).options(**options)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return clean_headers(reader.csv(path))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """One file or folder, its format told by the extension."""
    extension = os.path.splitext(path.rstrip("/"))[1].lower()
    if extension not in FORMATS:
        raise ValueError(f"unsupported file extension: {extension or path}")
    if extension == ".csv":
        return read_csv(spark, path)
    return clean_headers(spark.read.format(FORMATS[extension]).load(path))


def read_tables(spark: SparkSession, paths: dict[str, str] | str) -> dict[str, DataFrame]:
    """A workbook: table name to DataFrame.  A single path is a table named Sheet1."""
    named = {"Sheet1": paths} if isinstance(paths, str) else paths
    return {name: read_table(spark, path) for name, path in named.items()}


def jdbc_url(config: dict) -> str:
    """JDBC URL for a database record with type, host, port and database."""
    kind = str(config.get("type", "")).lower()
    if kind not in DATABASES:
        raise ValueError(f"unsupported database type: {kind}")
    default_port, pattern = DATABASES[kind]
    return pattern.format(
        host=config.get("host") or "localhost",
        port=config.get("port") or default_port,
        database=config.get("database", ""),
    )


def check_table_name(table: str) -> str:
    if not TABLE_NAME.fullmatch(table):
        raise ValueError(f"invalid table name: {table!r}")
    return table


def read_database(
    spark: SparkSession,
    config: dict,
    table: str,
    partition_column: str | None = None,
    bounds: tuple[str, str] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """A database table; with a partition column it is read by that many tasks."""
    reader = (
        spark.read.format("jdbc")
        .option("url", config.get("url") or jdbc_url(config))
        .option("dbtable", check_table_name(table))
    )
    for field in ("user", "password", "driver", "fetchsize"):
        if config.get(field):
            reader = reader.option(field, config[field])
    if partition_column:
        if not bounds or not partitions:
            raise ValueError("a partition column needs bounds and a number of partitions")
        reader = (
            reader.option("partitionColumn", partition_column)
            .option("lowerBound", bounds[0])
            .option("upperBound", bounds[1])
            .option("numPartitions", partitions)
        )
    return clean_headers(reader.load())


def sample_table(
    source: SparkSession | DataFrame,
    table: str | None = None,
    rows: int = SAMPLE_ROWS,
    order_key: str | None = None,
) -> DataFrame:
    """The first rows of a table (10 to 200 000), in ``order_key`` order if one is given."""
    if not SAMPLE_MIN <= rows <= SAMPLE_MAX:
        raise ValueError(f"rows must be between {SAMPLE_MIN} and {SAMPLE_MAX}")
    df = source if isinstance(source, DataFrame) else source.table(check_table_name(table))
    return df.orderBy(name_of(order_key)).limit(rows) if order_key else df.limit(rows)


def schema_listing(tables: dict[str, DataFrame], keys: bool = False) -> DataFrame:
    """Columns of every table: (table_name, ordinal, column, type, nullable, inferred_key).

    Files carry no key constraints.  With ``keys`` the data are read:
    ``inferred_key`` marks columns that are unique and complete, ``nullable``
    tells whether nulls occur.  Without, ``nullable`` is what the schema says,
    ``inferred_key`` is null and nothing is read.
    """
    parts = None
    for name, df in tables.items():
        if not keys:
            listed = [
                (name, i, f.name, f.dataType.simpleString(), f.nullable, None)
                for i, f in enumerate(df.schema.fields)
            ]
            part = df.sparkSession.createDataFrame(
                listed,
                "table_name string, ordinal int, column string, type string, nullable boolean, inferred_key boolean",
            )
            parts = part if parts is None else parts.unionByName(part)
            continue
        part = column_counts(df).select(
            F.lit(name).alias("table_name"),
            "ordinal",
            "column",
            F.col("dtype").alias("type"),
            (F.col("non_null") < F.col("row_count")).alias("nullable"),
            (
                (F.col("row_count") > 0)
                & (F.col("non_null") == F.col("row_count"))
                & (F.col("unique_count") == F.col("row_count"))
            ).alias("inferred_key"),
        )
        parts = part if parts is None else parts.unionByName(part)
    return parts


def guarded_select(
    spark: SparkSession, sql: str, limit: int = RESULT_ROWS, tables: list[str] | None = None, functions: list[str] = ()
) -> DataFrame:
    """Run one SELECT (or WITH) over the session's views, always capped.

    Anything else is refused, as are a second statement, files named by their path,
    functions that reach outside the rows and unknown ones.  ``tables`` narrows what may be
    read, ``functions`` adds functions of the session.
    """
    if not 1 <= limit <= RESULT_MAX:
        raise ValueError(f"limit must be between 1 and {RESULT_MAX}")
    text = sql.strip().rstrip(";").strip()
    if not re.match(r"(?i)(select|with)\b", text):
        raise ValueError("only SELECT queries are allowed")
    # Spark also writes from a statement that opens with WITH; a view cannot.
    guard.check(spark, text, tables, functions)
    df = spark.sql(f"SELECT * FROM (\n{text}\n)")
    return df.limit(limit)
