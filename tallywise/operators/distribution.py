"""Histogram, correlation and z-score anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.coerce import moment, name_of, number

# Columns of the correlation matrix that one aggregation holds, each way.
BLOCK = 8


def _range(values: DataFrame) -> Column:
    """Scalar subquery: the histogram range, widened by 0.5 each way when it is a point."""
    low, high = F.min("v"), F.max("v")
    point = low == high
    return values.agg(
        F.struct(
            F.when(point, low - 0.5).otherwise(low).alias("lo"),
            F.when(point, high + 0.5).otherwise(high).alias("hi"),
        ).alias("r")
    ).scalar()


def histogram(df: DataFrame, measure: str, bins: int = V.HISTOGRAM_BINS) -> DataFrame:
    """Equal-width bins, the last one closed: (bin, lower, upper, count), empty bins as 0."""
    values = df.select(number(df, measure).alias("v")).where(F.col("v").isNotNull())
    bounds = _range(values)

    def edge(i: Column) -> Column:
        width = (bounds["hi"] - bounds["lo"]) / bins
        return F.when(i == bins, bounds["hi"]).otherwise(bounds["lo"] + i * width)

    guess = F.floor((F.col("v") - bounds["lo"]) / (bounds["hi"] - bounds["lo"]) * bins)
    placed = values.select("v", F.least(guess, F.lit(bins - 1)).alias("g")).select(
        # Rounding may put a value that sits on an edge one bin off.
        (
            F.col("g")
            - (F.col("v") < edge(F.col("g"))).cast("int")
            + ((F.col("v") >= edge(F.col("g") + 1)) & (F.col("g") < bins - 1)).cast("int")
        ).alias("bin")
    )
    counts = placed.groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    frame = df.sparkSession.range(0, bins, 1, 1).select(
        F.col("id").alias("bin"), edge(F.col("id")).alias("lower"), edge(F.col("id") + 1).alias("upper")
    )
    # Both sides have at most ``bins`` rows.
    return (
        frame.join(F.broadcast(counts), "bin", "left")
        .where(F.col("lower").isNotNull())
        .select("bin", "lower", "upper", F.coalesce("count", F.lit(0)).alias("count"))
    )


def correlations(df: DataFrame, measures: list[str]) -> DataFrame:
    """Pearson r of every pair a <= b over rows where all measures are present.

    The matrix is cut into blocks of ``BLOCK`` columns each way, one group and one result row
    a block, in one scan: no row, aggregate or generated method grows with the square of the
    number of measures.  r is null for a constant measure.
    """
    many = len(measures)
    if many < 2:
        return df.sparkSession.createDataFrame([], "i int, j int, a string, b string, r double")
    width = min(BLOCK, many)
    starts = range(0, many, width)
    blocks = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p in starts for q in starts if p <= q])
    # Rows with a missing value meet no block.  A filter on them would make the optimizer derive
    # one of every set of columns.
    complete = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x))
    rows = df.select(F.array(*[number(df, m) for m in measures]).alias("v"))
    met = rows.select("v", F.explode_outer(F.when(complete, blocks)).alias("at")).where("at is not null")
    # The last block is filled up with nulls, which no aggregate counts.
    met = met.select(
        "at",
        *[F.get("v", F.col("at.p") + k).alias(f"x{k}") for k in range(width)],
        *[F.get("v", F.col("at.q") + k).alias(f"y{k}") for k in range(width)],
    )
    inside = [(k, n) for k in range(width) for n in range(width) if k <= n or many > width]
    moments = met.groupBy("at").agg(
        *[F.stddev_pop(f"{side}{k}").alias(f"s{side}{k}") for side in "xy" for k in range(width)],
        *[F.covar_pop(f"x{k}", f"y{n}").alias(f"c{k}_{n}") for k, n in inside],
    )
    names = F.array(*[F.lit(m) for m in measures])
    cells = F.array(
        *[
            F.struct(
                (F.col("at.p") + k).alias("i"),
                (F.col("at.q") + n).alias("j"),
                (F.col(f"sx{k}") * F.col(f"sy{n}")).alias("spread"),
                F.col(f"c{k}_{n}").alias("cov"),
            )
            for k, n in inside
        ]
    )
    r = F.greatest(F.least(F.try_divide("cov", "spread"), F.lit(1.0)), F.lit(-1.0))
    return (
        moments.select(F.inline(cells))
        .where((F.col("i") <= F.col("j")) & (F.col("j") < many))
        .select(
            "i",
            "j",
            F.get(names, "i").alias("a"),
            F.get(names, "j").alias("b"),
            F.when(F.col("spread") > 0, F.when(F.col("i") == F.col("j"), 1.0).otherwise(F.round(r, 3))).alias("r"),
        )
    )


def correlation_matrix(df: DataFrame, measures: list[str], upper: DataFrame | None = None) -> DataFrame:
    """The full square matrix in long form: (row, col, a, b, r).

    ``upper``, here and below, is the result of ``correlations``, if it is at hand.
    """
    upper = correlations(df, measures) if upper is None else upper
    return upper.select(
        F.inline(
            F.when(
                F.col("i") < F.col("j"),
                F.array(
                    F.struct(F.col("i").alias("row"), F.col("j").alias("col"), "a", "b", "r"),
                    F.struct(
                        F.col("j").alias("row"),
                        F.col("i").alias("col"),
                        F.col("b").alias("a"),
                        F.col("a").alias("b"),
                        "r",
                    ),
                ),
            ).otherwise(
                F.array(F.struct(F.col("i").alias("row"), F.col("j").alias("col"), "a", "b", "r"))
            )
        )
    )


def strong_pairs(
    df: DataFrame, measures: list[str], threshold: float = V.STRONG_CORRELATION, upper: DataFrame | None = None
) -> DataFrame:
    """Pairs with abs(r) at or above the threshold, strongest first: (i, j, a, b, r)."""
    return (
        (correlations(df, measures) if upper is None else upper)
        .where((F.col("i") < F.col("j")) & (F.abs("r") >= threshold))
        .orderBy(F.abs("r").desc(), "i", "j")
    )


def _moments(df: DataFrame, measure: str) -> DataFrame:
    return df.select(number(df, measure).alias("v")).agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std")
    )


def anomalies(
    df: DataFrame,
    measure: str,
    key: str | list[str],
    date_col: str | None = None,
    threshold: float = V.ANOMALY_Z,
) -> DataFrame:
    """All rows further than ``threshold`` sample deviations from the mean.

    ``key`` names the column(s) that identify a row.  Nothing is flagged with
    fewer than five values or zero deviation.
    """
    keys = [key] if isinstance(key, str) else list(key)
    stats = _moments(df, measure).select(
        F.struct(
            "mean", F.when((F.col("n") >= 5) & (F.col("std") > 0), F.col("std")).alias("std")
        ).alias("s")
    ).scalar()
    z = (F.col("value") - stats["mean"]) / stats["std"]
    columns = [name_of(k).alias(k) for k in keys] + [number(df, measure).alias("value")]
    if date_col:
        columns.append(moment(df, date_col).alias("date"))
    return (
        df.select(*columns)
        .where(F.abs(z) > threshold)
        .withColumn("z", F.round(z, 2))
    )


def anomaly_summary(
    df: DataFrame, measure: str, threshold: float = V.ANOMALY_Z
) -> DataFrame:
    """Mean, deviation and number of flagged rows: (measure, mean, std, threshold_z, count)."""
    stats = _moments(df, measure)
    scalar = stats.select(F.struct("n", "mean", "std").alias("s")).scalar()
    z = F.when(
        (scalar["n"] >= 5) & (scalar["std"] > 0),
        (F.col("v") - scalar["mean"]) / F.nullif(scalar["std"], F.lit(0.0)),
    )
    counted = df.select(number(df, measure).alias("v")).agg(
        F.count_if(F.abs(z) > threshold).alias("count")
    )
    return counted.select(
        F.lit(measure).alias("measure"),
        F.round(scalar["mean"], 2).alias("mean"),
        F.round(scalar["std"], 2).alias("std"),
        F.lit(float(threshold)).alias("threshold_z"),
        "count",
    )
