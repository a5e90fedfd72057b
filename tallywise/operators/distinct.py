"""Exact distinct counts of many columns in few passes.

Whole numbers are held as sets of bits: 64 neighbouring values make one word, keyed by the
column and the value's upper bits, and words are joined by ``bit_or`` before and after the
shuffle.  Dense keys travel as a sixty-fourth of their values, sparse ones as one word each,
never as more rows than there are distinct values, and words of two tables can be joined
again.  Other columns are counted by value, all columns of one type together.  Either way a
row is copied inside its task only, as pairs of column number and value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import name_of

WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType, T.DateType)


def _long(dtype: T.DataType, value: Column) -> Column:
    if isinstance(dtype, T.DateType):
        return F.unix_date(value).cast("bigint")
    if isinstance(dtype, T.BooleanType):
        return value.cast("int").cast("bigint")
    return value.cast("bigint")


def _value(dtype: T.DataType, value: Column) -> Column:
    """The value in a form that can be grouped by; NaN counts as missing."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(value), value)
    return F.to_json(value) if isinstance(dtype, T.MapType) else value


def _pairs(df: DataFrame, columns: dict[int, Column]) -> DataFrame:
    """(ordinal, v) for every non-null value of the columns."""
    each = [F.struct(F.lit(i).alias("ordinal"), v.alias("v")) for i, v in columns.items()]
    return df.select(F.inline(F.array(*each))).where(F.col("v").isNotNull())


def words(df: DataFrame, columns: dict[int, Column]) -> DataFrame:
    """Distinct whole numbers as (ordinal, place, word): bit b of word ``place`` is the value 64 * place + b."""
    bit = F.expr("shiftleft(1L, cast(v & 63 as int))")
    return (
        _pairs(df, columns)
        .groupBy("ordinal", F.shiftright("v", 6).alias("place"))
        .agg(F.bit_or(bit).alias("word"))
    )


def joined_words(parts: list[DataFrame]) -> DataFrame:
    """The words of several tables as those of their union."""
    return reduce(DataFrame.unionByName, parts).groupBy("ordinal", "place").agg(F.bit_or("word").alias("word"))


def counted_words(found: DataFrame) -> DataFrame:
    return found.groupBy("ordinal").agg(F.sum(F.bit_count("word")).cast("bigint").alias("distinct_count"))


def whole_columns(df: DataFrame, columns: list[str]) -> dict[int, Column]:
    """Numbered whole-number columns as 64-bit integers."""
    return {
        i: _long(df.schema[c].dataType, name_of(c))
        for i, c in enumerate(columns)
        if isinstance(df.schema[c].dataType, WHOLE)
    }


def distinct_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(ordinal, distinct_count) of the columns that hold a value; ``ordinal`` is the place in ``columns``.

    One scan for all whole-number columns, one for each other type.
    """
    parts, kinds = [], {}
    whole = whole_columns(df, columns)
    if whole:
        parts.append(counted_words(words(df, whole)))
    for i, c in enumerate(columns):
        if i not in whole:
            dtype = df.schema[c].dataType
            kind = "map" if isinstance(dtype, T.MapType) else dtype.simpleString()
            kinds.setdefault(kind, {})[i] = _value(dtype, name_of(c))
    for same in kinds.values():
        values = _pairs(df, same).groupBy("ordinal", "v").agg(F.count(F.lit(1)).alias("rows"))
        parts.append(values.groupBy("ordinal").agg(F.count(F.lit(1)).alias("distinct_count")))
    return reduce(DataFrame.unionByName, parts)
