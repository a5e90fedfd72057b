"""Exact quantiles that no task has to hold a whole column for.

The built-in exact percentile keeps every distinct value of a group in the
memory of one task.  Here keys with few rows are ordered as they are.  For the
others a sketch brackets each requested rank, a second sketch narrows the
bracket, and only the values left between the two bounds are counted and
ordered.  Their rows are met by key and salt, so one key that holds a large
part of all rows is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows up to which the values of one key are simply ordered.
ORDERED_ROWS = 20_000
# Sketch accuracy: the rank error is at most rows / ACCURACY.
ACCURACY = 10_000
# Cut points laid through a bracket by the second sketch.
CUTS = 500
# Tasks that share the rows of one key with many rows.
SALTS = 64


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: list[float], bounded_keys: bool = False
) -> DataFrame:
    """Linearly interpolated quantiles per key: (keys..., n, quantiles array<double>).

    Null values are ignored; a key with nulls only has ``n`` 0 and null
    quantiles.  Rows with a null key are left out.

    ``bounded_keys`` says that the number of key values is fixed by the schema
    (column names, say), so frames of one row per key are broadcast.
    """
    if not keys:
        raise ValueError("at least one key column is needed")
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).dropna(subset=keys)
    if bounded_keys:
        return _bracketed(rows, lambda side: rows.join(F.broadcast(side), keys), keys, probs)
    large = rows.groupBy(*keys).agg(F.count("_v").alias("_n")).where(F.col("_n") > ORDERED_ROWS)
    # The partition a row is read in spreads equal values too.
    rows = rows.withColumn("_salt", F.spark_partition_id() % SALTS)

    def meet(side: DataFrame, how: str = "inner") -> DataFrame:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        return rows.join(side.withColumn("_salt", salts), [*keys, "_salt"], how)

    large = large.select(*keys)
    few = _ranked(meet(large, "left_anti"), keys, probs)
    return few.unionByName(_bracketed(meet(large), meet, keys, probs))


def _ranked(rows: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """Count equal values, order them per key and pick the ranks."""
    valid = F.when(F.col("_v").isNotNull(), F.col("_rows")).otherwise(0)
    ordered = Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_last())
    counted = rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_rows"))
    placed = counted.select(
        *keys,
        "_v",
        valid.alias("_rows"),
        F.sum(valid).over(ordered.rowsBetween(Window.unboundedPreceding, 0)).alias("_upto"),
        F.sum(valid).over(Window.partitionBy(*keys)).alias("n"),
    )

    def at(rank: Column) -> Column:
        return F.max(F.when(_holds(rank), F.col("_v")))

    picks = []
    for i, p in enumerate(probs):
        position = F.lit(p) * (F.col("n") - 1)
        picks += [at(F.floor(position)).alias(f"_a{i}"), at(F.ceil(position)).alias(f"_b{i}")]
    found = placed.groupBy(*keys).agg(F.max("n").alias("n"), *picks)
    values = []
    for i, p in enumerate(probs):
        position = F.lit(p) * (F.col("n") - 1)
        part = position - F.floor(position)
        values.append(F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * part)
    return found.select(*keys, "n", F.when(F.col("n") > 0, F.array(*values)).alias("quantiles"))


def _holds(rank: Column) -> Column:
    """Whether a counted value covers a 0-based rank."""
    return (F.col("_upto") > rank) & (F.col("_upto") - F.col("_rows") <= rank)


def _bracketed(
    rows: DataFrame, meet: Callable[[DataFrame], DataFrame], keys: list[str], probs: list[float]
) -> DataFrame:
    """Quantiles of ``rows`` by three looks; ``meet`` joins them with a frame of one row per key."""
    slots = range(len(probs))
    margin = 2.0 / ACCURACY
    asked = [x for p in probs for x in (max(p - margin, 0.0), min(p + margin, 1.0))]
    first = rows.groupBy(*keys).agg(
        F.count("_v").alias("n"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
        F.percentile_approx("_v", asked, ACCURACY).alias("_q"),
    )
    whole = F.col("n") <= ORDERED_ROWS
    targets = []
    for i, p in enumerate(probs):
        position = F.lit(p) * (F.col("n") - 1)
        targets.append(
            F.struct(
                F.lit(i).alias("slot"),
                F.when(whole | F.lit(p <= margin), F.col("_min")).otherwise(F.col("_q")[2 * i]).alias("low"),
                F.when(whole | F.lit(p + margin >= 1), F.col("_max")).otherwise(F.col("_q")[2 * i + 1]).alias("high"),
                F.floor(position).alias("first"),
                F.ceil(position).alias("last"),
                (position - F.floor(position)).alias("part"),
            )
        )
    brackets = first.select(*keys, "n", F.array(*targets).alias("_t"))

    # Second look: rows below and inside each bracket, and cut points through it.
    near = meet(brackets).where(F.col("_v").isNotNull())
    inside = [F.col("_v").between(F.col("_t")[i]["low"], F.col("_t")[i]["high"]) for i in slots]
    grid = [j / CUTS for j in range(CUTS + 1)]
    second = near.groupBy(*keys).agg(
        F.first("n").alias("n"),
        F.first("_t").alias("_t"),
        *[F.count_if(F.col("_v") < F.col("_t")[i]["low"]).alias(f"_below{i}") for i in slots],
        *[F.count_if(inside[i]).alias(f"_in{i}") for i in slots],
        *[
            F.percentile_approx(F.when(inside[i], F.col("_v")), grid, ACCURACY).alias(f"_c{i}")
            for i in slots
        ],
    )
    narrowed = second.select(*keys, "n", F.array(*[_narrow(i) for i in slots]).alias("_t"))

    # Third look: count the values left, everything smaller as one null value.
    spread = meet(narrowed).where(F.col("_v").isNotNull())
    spread = spread.select(*keys, "n", F.explode("_t").alias("t"), "_v")
    counted = (
        spread.where(F.col("_v") <= F.col("t.high"))
        .withColumn("_v", F.when(F.col("_v") >= F.col("t.low"), F.col("_v")))
        .groupBy(*keys, "n", "t", "_v")
        .agg(F.count(F.lit(1)).alias("_rows"))
    )
    ordered = Window.partitionBy(*keys, "t.slot").orderBy(F.col("_v").asc_nulls_first())
    ranked = counted.withColumn(
        "_upto", F.sum("_rows").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    )
    at_first = F.max(F.when(_holds(F.col("t.first")), F.col("_v")))
    at_last = F.max(F.when(_holds(F.col("t.last")), F.col("_v")))
    picked = (
        ranked.groupBy(*keys, "n", "t")
        .agg(at_first.alias("a"), at_last.alias("b"))
        .select(
            *keys,
            "n",
            F.col("t.slot").alias("slot"),
            F.when(
                F.col("a").isNull() | F.col("b").isNull(),
                F.raise_error(F.lit("quantile bracket missed its rank")).cast("double"),
            )
            .otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("t.part"))
            .alias("q"),
        )
    )
    found = picked.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("slot", "q"))), lambda s: s["q"]).alias(
            "quantiles"
        )
    )
    return brackets.select(*keys, "n").join(found, keys, "left")


def _narrow(i: int) -> Column:
    """Tighter bounds for target ``i``, one cut point beyond the rank on either side."""
    t, rows = F.col("_t")[i], F.col(f"_in{i}")
    cuts = F.col(f"_c{i}")
    low_cut = F.floor((t["first"] - F.col(f"_below{i}")) / rows * CUTS) - 1
    high_cut = F.ceil((t["last"] - F.col(f"_below{i}")) / rows * CUTS) + 1
    few = rows <= ORDERED_ROWS
    return F.struct(
        t["slot"].alias("slot"),
        F.when(few | (low_cut <= 0), t["low"])
        .otherwise(F.get(cuts, low_cut.cast("int")))
        .alias("low"),
        F.when(few | (high_cut >= CUTS), t["high"])
        .otherwise(F.get(cuts, high_cut.cast("int")))
        .alias("high"),
        t["first"].alias("first"),
        t["last"].alias("last"),
        t["part"].alias("part"),
    )
