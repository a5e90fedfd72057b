"""Registration of named queries with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Columns of the given tables: (name, Spark type, family).
TABLES = {
    "region": [("r_regionkey", "int", "numeric"), ("r_name", "string", "other")],
    "nation": [
        ("n_nationkey", "int", "numeric"),
        ("n_name", "string", "other"),
        ("n_regionkey", "int", "numeric"),
    ],
    "customer": [
        ("c_custkey", "bigint", "numeric"),
        ("c_name", "string", "other"),
        ("c_nationkey", "int", "numeric"),
        ("c_acctbal", "double", "numeric"),
        ("c_mktsegment", "string", "other"),
    ],
    "supplier": [
        ("s_suppkey", "bigint", "numeric"),
        ("s_name", "string", "other"),
        ("s_nationkey", "int", "numeric"),
        ("s_acctbal", "double", "numeric"),
    ],
    "part": [
        ("p_partkey", "bigint", "numeric"),
        ("p_name", "string", "other"),
        ("p_brand", "string", "other"),
        ("p_type", "string", "other"),
        ("p_size", "int", "numeric"),
        ("p_retailprice", "double", "numeric"),
    ],
    "orders": [
        ("o_orderkey", "bigint", "numeric"),
        ("o_custkey", "bigint", "numeric"),
        ("o_orderstatus", "string", "other"),
        ("o_totalprice", "double", "numeric"),
        ("o_orderdate", "timestamp_ntz", "temporal"),
        ("o_orderpriority", "string", "other"),
    ],
    "lineitem": [
        ("l_orderkey", "bigint", "numeric"),
        ("l_partkey", "bigint", "numeric"),
        ("l_suppkey", "bigint", "numeric"),
        ("l_linenumber", "int", "numeric"),
        ("l_quantity", "double", "numeric"),
        ("l_extendedprice", "double", "numeric"),
        ("l_discount", "double", "numeric"),
        ("l_tax", "double", "numeric"),
        ("l_returnflag", "string", "other"),
        ("l_linestatus", "string", "other"),
        ("l_shipdate", "timestamp_ntz", "temporal"),
    ],
    "events": [
        ("event_id", "bigint", "numeric"),
        ("ts", "timestamp_ntz", "temporal"),
        ("user_id", "bigint", "numeric"),
        ("event_type", "string", "other"),
        ("value", "double", "numeric"),
        ("props", "string", "other"),
    ],
    "documents": [
        ("doc_id", "bigint", "numeric"),
        ("text", "string", "other"),
        ("lang", "string", "other"),
        ("source", "string", "other"),
        ("n_chars", "bigint", "numeric"),
    ],
    "labels": [
        ("doc_id", "bigint", "numeric"),
        ("quality", "int", "numeric"),
        ("toxic", "int", "numeric"),
    ],
    "conversations": [
        ("conv_id", "bigint", "numeric"),
        ("turn", "bigint", "numeric"),
        ("role", "string", "other"),
        ("text", "string", "other"),
    ],
    "pages": [
        ("page_id", "bigint", "numeric"),
        ("url", "string", "other"),
        ("html", "string", "other"),
    ],
    "benchmark": [("item_id", "bigint", "numeric"), ("text", "string", "other")],
}


def columns_of(table: str) -> list[str]:
    return [name for name, _, _ in TABLES[table]]


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the same result in DuckDB."""

    def register(function):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """All doubles rounded, so that the order of summation does not show."""
    return df.select(
        *[
            F.round(F.col(f.name), digits).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def union_all(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)
