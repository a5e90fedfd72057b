"""Results and tables as files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import json_row


def export_csv(df: DataFrame, path: str, single_file: bool = False) -> str:
    """Write a table as CSV with a header, one file per partition unless asked otherwise."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("header", True).csv(path)
    return path


def json_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One JSON text per row: (json)."""
    return df.select(json_row(df, columns).alias("json"))


def export_json(df: DataFrame, path: str) -> str:
    """Write a table as JSON lines, nulls kept."""
    json_rows(df).write.mode("overwrite").text(path)
    return path


def export_blocks(blocks: dict[str, DataFrame], path: str) -> dict[str, str]:
    """Write every block of a result as its own JSON dataset: block name to path."""
    return {name: export_json(df, os.path.join(path, name)) for name, df in blocks.items()}


def block_sizes(blocks: dict[str, DataFrame]) -> DataFrame:
    """Rows per block: (block, rows)."""
    parts = None
    for name, df in blocks.items():
        part = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("block"), "rows")
        parts = part if parts is None else parts.unionByName(part)
    return parts
