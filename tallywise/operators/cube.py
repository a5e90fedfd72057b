"""One stored frame of mergeable sums from which the blocks of an overview are derived.

A single scan totals the table at a few grains at once: month by dimension, every slicer
column by itself, and the place columns together.  A cell holds its rows, its first and last
day, and the sum and count of every measure.  The frames below stand in for the table:
totals of totals are the totals.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import period
from ..functions.coerce import moment, name_of, number
from ..session import scratch_path


@dataclass(frozen=True)
class Cube:
    cells: DataFrame  # grain, x, lo, hi, n, k0.. (grain columns), s0, c0.. (measures)
    measures: tuple[str, ...]
    keys: tuple[str, ...]
    dimension: str | None
    date: str | None

    def _grain(self, keys: Sequence[str], dated: bool) -> DataFrame:
        return self.cells.where(F.col("grain") == _number(self.keys, keys, dated))

    def _key(self, column: str) -> Column:
        return F.col(f"k{self.keys.index(column)}").alias(column)

    def _value(self, measure: str) -> Column:
        at = self.measures.index(measure)
        return F.when(F.col(f"c{at}") > 0, F.col(f"s{at}")).alias(measure)

    def _main(self) -> DataFrame:
        return self._grain([self.dimension] if self.dimension else [], True)

    def monthly(self) -> DataFrame:
        """Sums and counts of all measures per month, as KPIs take them: (x, s0.., c0..); null month = no date."""
        span = range(len(self.measures))
        return self._main().groupBy("x").agg(
            *[F.coalesce(F.sum(f"s{i}"), F.lit(0.0)).alias(f"s{i}") for i in span],
            *[F.sum(f"c{i}").alias(f"c{i}") for i in span],
        )

    def _many(self, measure: str, weight: str | None) -> list[Column]:
        return [F.col(f"c{self.measures.index(measure)}").alias(weight)] if weight else []

    def rows(self, measure: str, by: str, weight: str | None = None) -> DataFrame:
        """The table as one row per cell, with a value for the date or the dimension and the measure.

        ``weight`` names a column for the rows with a value that a cell stands for.
        """
        key = F.col("x").alias(by) if by == self.date else self._key(by)
        return self._main().select(key, self._value(measure), *self._many(measure, weight))

    def places(self, columns: Sequence[str], measure: str, weight: str | None = None) -> DataFrame:
        """The same for the place columns."""
        own = [self._key(c) for c in columns]
        return self._grain(columns, False).select(*own, self._value(measure), *self._many(measure, weight))

    def days(self) -> DataFrame:
        """First and last day of every cell, in one column named as the date."""
        return self._main().select(F.explode(F.array("lo", "hi")).alias(self.date))

    def values(self, columns: Sequence[str]) -> DataFrame:
        """Rows of every value of some columns: (ordinal, column, value, rows)."""
        numbers = F.create_map(*[F.lit(x) for i, c in enumerate(columns) for x in (_number(self.keys, [c], False), i)])
        own = F.array(*[F.col(f"k{self.keys.index(c)}").cast("string") for c in columns])
        return (
            self.cells.select(numbers[F.col("grain")].alias("ordinal"), own.alias("own"), F.col("n").alias("rows"))
            .where("ordinal is not null")
            .select("ordinal", F.get(F.array(*[F.lit(c) for c in columns]), "ordinal").alias("column"), F.get("own", "ordinal").alias("value"), "rows")
            .where("value is not null")
            .groupBy("ordinal", "column", "value")  # values that differ by type only
            .agg(F.sum("rows").alias("rows"))
        )


def _number(keys: Sequence[str], grain: Sequence[str], dated: bool) -> int:
    """The grouping id of a grain: a bit for each column left out, the month's first."""
    out = "0" if dated else "1"
    return int(out + "".join("0" if k in grain else "1" for k in keys), 2)


def moment_cube(
    df: DataFrame,
    measures: Sequence[str],
    dimension: str | None = None,
    date_col: str | None = None,
    slicers: Sequence[str] = (),
    places: Sequence[str] = (),
) -> Cube:
    """Total ``df`` at all grains in one scan and store the cells below the shared folder.

    Partial sums are combined before the shuffle, whose rows are cells, not table rows: the
    dimension's values times the months, and the distinct values of slicers and places.  Null
    keys and dates are cells of their own; an empty table has none.
    """
    keys = tuple(dict.fromkeys([*([dimension] if dimension else []), *slicers, *places]))
    names = [f"k{i}" for i in range(len(keys))]
    at = dict(zip(keys, names, strict=True))
    grains = [["x", at[dimension]] if dimension else ["x"], *([at[c]] for c in slicers)]
    if places:
        grains.append([at[c] for c in places])
    grains = [list(g) for g in dict.fromkeys(tuple(g) for g in grains)]
    when = moment(df, date_col) if date_col else F.lit(None).cast("timestamp_ntz")
    rows = df.select(
        period(when, "MS").alias("x"),
        when.cast("date").alias("day"),
        *[name_of(c).alias(n) for c, n in at.items()],
        *[number(df, m).alias(f"m{i}") for i, m in enumerate(measures)],
    )
    span = range(len(measures))
    cells = rows.groupingSets([[F.col(c) for c in g] for g in grains], "x", *names).agg(
        F.grouping_id().cast("long").alias("grain"),
        F.min("day").alias("lo"),
        F.max("day").alias("hi"),
        F.count(F.lit(1)).alias("n"),
        *[F.sum(f"m{i}").alias(f"s{i}") for i in span],
        *[F.count(f"m{i}").alias(f"c{i}") for i in span],
    )
    path = scratch_path(df.sparkSession, "cube")
    cells.write.parquet(path)
    stored = df.sparkSession.read.schema(cells.schema).parquet(path)
    return Cube(stored, tuple(measures), keys, dimension, date_col)
