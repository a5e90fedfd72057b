"""Back-tested forecasts for one series or many, as column expressions.

Every series is one row holding the array of its period totals, whose length
is bounded by the calendar.  Smoothing parameters come from a fixed grid: for
each grid point the recurrence runs over the array, and the point with the
lowest squared one-step error wins; a finer grid around it, which holds the
point itself and the ends 0 and 1, is searched next.  Nothing is shuffled after
the totals.

Start values come from the first values or seasons, or are estimated: for fixed
parameters the one-step errors are linear in the start state, so the recurrence
is run on the start values and on unit vectors beside them, and the normal
equations of their errors are solved.
"""

from __future__ import annotations

from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.calendar import add_periods, period, step
from ..functions.coerce import let, moment, name_of, number, word_list
from .series import resample_sum

STARTS = ("first", "estimated")
# Smoothing grids and the shortest series that is forecast.
SES_GRID = tuple(i / 10 for i in range(1, 10))
HOLT_GRID = tuple(i / 10 for i in range(1, 10))
SEASONAL_GRID = (0.1, 0.3, 0.5, 0.7, 0.9)
# Steps of the second search around the winner of the first.
SES_STEPS = tuple(i / 50 for i in range(-5, 6))
HOLT_STEPS = (-0.1, -0.05, 0.0, 0.05, 0.1)
SEASONAL_STEPS = (-0.1, 0.0, 0.1)
MIN_PERIODS = 4


def series_frame(
    df: DataFrame,
    date_col: str,
    measure: str,
    freq: str = "MS",
    keys: list[str] = (),
    min_periods: int = MIN_PERIODS,
) -> DataFrame:
    """One row per series: (keys..., xs, ys, n).  Series that are too short are left out."""
    keys = list(keys)
    points = resample_sum(df, date_col, measure, freq, keys)
    packed = points.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("p"))
    return packed.select(
        *keys,
        F.transform("p", lambda s: s["x"]).alias("xs"),
        F.transform("p", lambda s: s["y"]).alias("ys"),
        F.size("p").alias("n"),
    ).where(F.col("n") >= min_periods)


def forecast_guard(
    df: DataFrame, date_col: str, measure: str, freq: str = "MS", keys: list[str] = ()
) -> DataFrame:
    """Which series are long enough: (keys..., rows, periods, accepted, note)."""
    keys = list(keys)
    valid = df.select(
        *[name_of(k).alias(k) for k in keys],
        period(moment(df, date_col), freq).alias("x"),
        number(df, measure).alias("y"),
    ).na.drop(subset=["x", "y"])
    bounds = valid.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.min("x").alias("lo"), F.max("x").alias("hi")
    )
    periods = F.when(
        F.col("rows") > 0, F.size(F.sequence("lo", "hi", F.expr(step(freq))))
    ).otherwise(0)
    few_rows, few_periods = F.col("rows") < 4, F.col("periods") < MIN_PERIODS
    return bounds.withColumn("periods", periods).select(
        *keys,
        "rows",
        "periods",
        (~(few_rows | few_periods)).alias("accepted"),
        F.when(few_rows, "not enough data points")
        .when(few_periods, "not enough periods")
        .alias("note"),
    )


def train_size(n: Column) -> Column:
    """Periods kept for training: about four fifths, at least one left out, at least three kept."""
    return F.greatest(n - F.greatest(F.lit(1), F.floor(n / 5).cast("int")), F.lit(3))


def backtest_split(series: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Each period marked as train or test: (keys..., x, y, part)."""
    cut = train_size(F.col("n"))
    return series.select(
        *keys, cut.alias("_cut"), F.posexplode(F.arrays_zip("xs", "ys")).alias("_i", "_p")
    ).select(
        *keys,
        F.col("_p.xs").alias("x"),
        F.col("_p.ys").alias("y"),
        F.when(F.col("_i") < F.col("_cut"), "train").otherwise("test").alias("part"),
    )


# --- the models: array of totals -> fitted state ----------------------------


def _state(sse, a, b, g, level, trend, season=None) -> Column:
    none = F.array().cast("array<double>")
    return F.struct(
        sse.alias("sse"),
        a.alias("a"),
        b.alias("b"),
        g.alias("g"),
        level.alias("level"),
        trend.alias("trend"),
        (none if season is None else season).alias("season"),
    )


def _rest(ys: Column, start: int) -> Column:
    """The values from 0-based position ``start`` on (an empty array when there are none)."""
    return F.slice(ys, start + 1, F.greatest(F.size(ys) - start, F.lit(0)))


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, y: s + y) / F.size(values)


def _grid(**axes: tuple[float, ...]) -> Column:
    """All combinations of the axes as an array of structs, the last axis running fastest."""
    size = prod(len(values) for values in axes.values())

    def point(i: Column) -> Column:
        fields, stride = [], size
        for name, values in axes.items():
            stride //= len(values)
            place = F.pmod(F.floor(i / stride), F.lit(len(values))).cast("int")
            fields.append(F.get(word_list(map(str, values)).cast("array<double>"), place).alias(name))
        return F.struct(*fields)

    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), point)


def _searched(axes: dict[str, tuple], steps: tuple[float, ...], run) -> Column:
    """The best state ``run`` gives on the grid, or on a finer one around the grid's winner."""

    def near(best: Column) -> Column:
        moves = _grid(**dict.fromkeys(axes, steps))
        points = F.transform(moves, lambda d: F.struct(*[(best[x] + d[x]).alias(x) for x in axes]))
        return F.array_min(F.transform(points, run))

    return let(F.array_min(F.transform(_grid(**axes), run)), near)


def _check_start(start: str) -> bool:
    if start not in STARTS:
        raise ValueError(f"start must be one of {', '.join(STARTS)}, not {start!r}")
    return start == "estimated"


def fit_ses(ys: Column, start: str = "first") -> Column:
    """Level smoothing, started at the first value or at the level that leaves the least squared error."""
    if _check_start(start):
        return _fit_ses_estimated(ys)
    zero = F.lit(0.0)

    def advance(s: Column, y: Column, a: Column) -> Column:
        miss = y - s["l"]
        return F.struct(
            (s["l"] + a * miss).alias("l"), (s["sse"] + miss * miss).alias("sse")
        )

    def run(p: Column, start: Column, rest: Column) -> Column:
        return F.aggregate(
            rest,
            F.struct(start.alias("l"), zero.alias("sse")),
            lambda s, y: advance(s, y, p["a"]),
            lambda s: _state(s["sse"], p["a"], zero, zero, s["l"], zero),
        )

    inputs = F.struct(F.get(ys, F.lit(0)).alias("start"), _rest(ys, 1).alias("rest"))
    return let(
        inputs,
        lambda i: _searched({"a": SES_GRID}, SES_STEPS, lambda p: run(p, i["start"], i["rest"])),
    )


def _fit_ses_estimated(ys: Column) -> Column:
    """The start level is the first value plus what least squares adds to it, at every grid point."""
    zero = F.lit(0.0)

    def advance(s: Column, y: Column, a: Column) -> Column:
        miss = y - s["l"]
        return F.struct(
            (s["l"] + a * miss).alias("l"),
            (s["c"] * (1 - a)).alias("c"),  # what a unit of the start level still counts for
            (s["ee"] + miss * miss).alias("ee"),
            (s["ec"] + miss * s["c"]).alias("ec"),
            (s["cc"] + s["c"] * s["c"]).alias("cc"),
        )

    def finish(s: Column, a: Column) -> Column:
        more = s["ec"] / s["cc"]
        sse = F.greatest(s["ee"] - more * s["ec"], zero)
        return _state(sse, a, zero, zero, s["l"] + more * s["c"], zero)

    def run(p: Column, first: Column) -> Column:
        start = F.struct(
            first.alias("l"), F.lit(1.0).alias("c"), zero.alias("ee"), zero.alias("ec"), zero.alias("cc")
        )
        return F.aggregate(
            ys, start, lambda s, y: advance(s, y, p["a"]), lambda s: finish(s, p["a"])
        )

    return let(
        F.get(ys, F.lit(0)),
        lambda first: _searched({"a": SES_GRID}, SES_STEPS, lambda p: run(p, first)),
    )


def fit_holt(ys: Column, start: str = "first") -> Column:
    """Level and trend, started at the second value and the first difference, or estimated."""
    if _check_start(start):
        return _fit_holt_estimated(ys)
    zero = F.lit(0.0)

    def advance(s: Column, y: Column, p: Column) -> Column:
        # In error form: with e = y - level - trend, the level gains a*e over
        # the line and the trend gains a*b*e.
        miss = y - s["l"] - s["t"]
        return F.struct(
            (s["l"] + s["t"] + p["a"] * miss).alias("l"),
            (s["t"] + p["a"] * p["b"] * miss).alias("t"),
            (s["sse"] + miss * miss).alias("sse"),
        )

    def run(p: Column, i: Column) -> Column:
        return F.aggregate(
            i["rest"],
            F.struct(i["l"].alias("l"), i["t"].alias("t"), zero.alias("sse")),
            lambda s, y: advance(s, y, p),
            lambda s: _state(s["sse"], p["a"], p["b"], zero, s["l"], s["t"]),
        )

    second = F.get(ys, F.lit(1))
    inputs = F.struct(
        second.alias("l"), (second - F.get(ys, F.lit(0))).alias("t"), _rest(ys, 2).alias("rest")
    )
    axes = {"a": HOLT_GRID, "b": HOLT_GRID}
    return let(inputs, lambda i: _searched(axes, HOLT_STEPS, lambda p: run(p, i)))


def _fit_holt_estimated(ys: Column) -> Column:
    """The line through the first two values, moved by least squares at every grid point."""
    zero, one = F.lit(0.0), F.lit(1.0)

    def advance(s: Column, y: Column, p: Column) -> Column:
        def moved(v: Column) -> Column:
            fields = []
            # The series itself (0), a unit of level (1) and of trend (2); e is what each leaves unexplained.
            for i in range(3):
                level, trend, miss = s[f"l{i}"], s[f"t{i}"], v[f"e{i}"]
                fields += [
                    (level + trend + p["a"] * miss).alias(f"l{i}"),
                    (trend + p["a"] * p["b"] * miss).alias(f"t{i}"),
                ]
            for i in range(3):
                fields += [(s[f"s{i}{j}"] + v[f"e{i}"] * v[f"e{j}"]).alias(f"s{i}{j}") for j in range(i, 3)]
            return F.struct(*fields)

        misses = [y - s["l0"] - s["t0"], -s["l1"] - s["t1"], -s["l2"] - s["t2"]]
        return let(F.struct(*[m.alias(f"e{i}") for i, m in enumerate(misses)]), moved)

    def finish(s: Column, p: Column) -> Column:
        # The errors of a moved start are e0 + d1 * e1 + d2 * e2.
        det = s["s11"] * s["s22"] - s["s12"] * s["s12"]
        d1 = (s["s12"] * s["s02"] - s["s22"] * s["s01"]) / det
        d2 = (s["s12"] * s["s01"] - s["s11"] * s["s02"]) / det

        def state(d: Column) -> Column:
            sse = F.greatest(s["s00"] + d["d1"] * s["s01"] + d["d2"] * s["s02"], zero)
            level = s["l0"] + d["d1"] * s["l1"] + d["d2"] * s["l2"]
            return _state(sse, p["a"], p["b"], zero, level, s["t0"] + d["d1"] * s["t1"] + d["d2"] * s["t2"])

        return let(F.struct(d1.alias("d1"), d2.alias("d2")), state)

    def run(p: Column, i: Column) -> Column:
        units = ((i["l"], i["t"]), (one, zero), (zero, one))
        fields = []
        for k, (level, trend) in enumerate(units):
            fields += [level.alias(f"l{k}"), trend.alias(f"t{k}")]
        fields += [zero.alias(f"s{a}{b}") for a in range(3) for b in range(a, 3)]
        return F.aggregate(
            ys, F.struct(*fields), lambda s, y: advance(s, y, p), lambda s: finish(s, p)
        )

    step = F.get(ys, F.lit(1)) - F.get(ys, F.lit(0))
    inputs = F.struct((F.get(ys, F.lit(0)) - step).alias("l"), step.alias("t"))
    axes = {"a": HOLT_GRID, "b": HOLT_GRID}
    return let(inputs, lambda i: _searched(axes, HOLT_STEPS, lambda p: run(p, i)))


def fit_holt_winters(ys: Column, season: int = V.SEASON, start: str = "first") -> Column:
    """Level, trend and additive season; started from the first two seasons, or estimated.

    The slope is the difference of the two season means, the seasonal values
    are what the first season leaves over that line.  ``ys`` must hold at least
    two seasons.  The season array is a ring: its head is the next period.

    Estimated, that start is moved by least squares for the parameters found and the
    parameters are searched around them from the new start, both twice; the error
    never rises.
    """
    if _check_start(start):
        return _fit_holt_winters_estimated(ys, season)
    half = (season - 1) / 2

    def advance(s: Column, y: Column, p: Column) -> Column:
        head = F.get(s["r"], F.lit(0))
        miss = y - s["l"] - s["t"] - head
        # Error form again; what the level does not take (1 - a), the season may.
        return F.struct(
            (s["l"] + s["t"] + p["a"] * miss).alias("l"),
            (s["t"] + p["a"] * p["b"] * miss).alias("t"),
            F.concat(
                F.slice(s["r"], 2, season - 1),
                F.array(head + p["g"] * (1 - p["a"]) * miss),
            ).alias("r"),
            (s["sse"] + miss * miss).alias("sse"),
        )

    def run(p: Column, i: Column) -> Column:
        return F.aggregate(
            i["rest"],
            F.struct(i["l"].alias("l"), i["t"].alias("t"), i["r"].alias("r"), F.lit(0.0).alias("sse")),
            lambda s, y: advance(s, y, p),
            lambda s: _state(s["sse"], p["a"], p["b"], p["g"], s["l"], s["t"], s["r"]),
        )

    def inputs(m: Column) -> Column:
        slope = (m["second"] - m["first"]) / season
        ring = F.transform(
            F.slice(ys, 1, season), lambda y, k: y - m["first"] - (k - F.lit(half)) * slope
        )
        return F.struct(
            (m["first"] + slope * half).alias("l"),
            slope.alias("t"),
            ring.alias("r"),
            _rest(ys, season).alias("rest"),
        )

    means = F.struct(
        _mean(F.slice(ys, 1, season)).alias("first"),
        _mean(F.slice(ys, season + 1, season)).alias("second"),
    )
    axes = {"a": SEASONAL_GRID, "b": SEASONAL_GRID, "g": SEASONAL_GRID}
    return let(
        let(means, inputs), lambda i: _searched(axes, SEASONAL_STEPS, lambda p: run(p, i))
    )


def _fit_holt_winters_estimated(ys: Column, season: int) -> Column:
    unknowns = season + 1  # level, trend and all seasonal values but the last, which makes their sum zero
    half = (season - 1) / 2

    def first_start(m: Column) -> Column:
        slope = (m["second"] - m["first"]) / season
        ring = F.transform(
            F.slice(ys, 1, season), lambda y, k: y - m["first"] - (k - F.lit(half)) * slope
        )
        # Before the first period; the first season is met without error.
        return F.struct((m["first"] - slope * (half + 1)).alias("l"), slope.alias("t"), ring.alias("r"))

    def run(p: Column, start: Column) -> Column:
        def advance(s: Column, y: Column) -> Column:
            def moved(v: Column) -> Column:
                return F.struct(
                    (s["l"] + s["t"] + p["a"] * v["miss"]).alias("l"),
                    (s["t"] + p["a"] * p["b"] * v["miss"]).alias("t"),
                    F.concat(
                        F.slice(s["r"], 2, season - 1),
                        F.array(v["head"] + p["g"] * (1 - p["a"]) * v["miss"]),
                    ).alias("r"),
                    (s["sse"] + v["miss"] * v["miss"]).alias("sse"),
                )

            head = F.get(s["r"], F.lit(0))
            return let(F.struct((y - s["l"] - s["t"] - head).alias("miss"), head.alias("head")), moved)

        return F.aggregate(
            ys,
            F.struct(start["l"].alias("l"), start["t"].alias("t"), start["r"].alias("r"), F.lit(0.0).alias("sse")),
            advance,
            lambda s: _state(s["sse"], p["a"], p["b"], p["g"], s["l"], s["t"], s["r"]),
        )

    def numbers(make) -> Column:
        return F.array(*[F.lit(float(make(j))) for j in range(unknowns)])

    def equations(p: Column, start: Column) -> Column:
        """The normal equations, a row for each unknown with its right side at the end."""

        def advance(s: Column, y: Column) -> Column:
            def moved(v: Column) -> Column:
                unit = v["unit"]
                both = F.concat(unit, F.array(v["miss"]))
                return F.struct(
                    (s["l"] + s["t"] + p["a"] * v["miss"]).alias("l"),
                    (s["t"] + p["a"] * p["b"] * v["miss"]).alias("t"),
                    F.concat(
                        F.slice(s["r"], 2, season - 1),
                        F.array(F.get(s["r"], F.lit(0)) + p["g"] * (1 - p["a"]) * v["miss"]),
                    ).alias("r"),
                    F.zip_with(
                        F.zip_with(s["ul"], s["ut"], lambda x, z: x + z), unit, lambda x, u: x - p["a"] * u
                    ).alias("ul"),
                    F.zip_with(s["ut"], unit, lambda x, u: x - p["a"] * p["b"] * u).alias("ut"),
                    F.concat(
                        F.slice(s["ur"], 2, season - 1),
                        F.array(
                            F.zip_with(F.get(s["ur"], F.lit(0)), unit, lambda x, u: x - p["g"] * (1 - p["a"]) * u)
                        ),
                    ).alias("ur"),
                    F.zip_with(
                        s["sums"], unit, lambda row, u: F.zip_with(row, both, lambda x, o: x + u * o)
                    ).alias("sums"),
                )

            # What a unit of each unknown adds to this period's prediction, and the error left.
            unit = F.zip_with(
                F.zip_with(s["ul"], s["ut"], lambda x, z: x + z), F.get(s["ur"], F.lit(0)), lambda x, z: x + z
            )
            miss = y - s["l"] - s["t"] - F.get(s["r"], F.lit(0))
            return let(F.struct(unit.alias("unit"), miss.alias("miss")), moved)

        ring = [numbers(lambda j, k=k: j == k + 2 or (k == season - 1 and j >= 2) * -1) for k in range(season)]
        begin = F.struct(
            start["l"].alias("l"),
            start["t"].alias("t"),
            start["r"].alias("r"),
            numbers(lambda j: j == 0).alias("ul"),
            numbers(lambda j: j == 1).alias("ut"),
            F.array(*ring).alias("ur"),
            F.array_repeat(F.array_repeat(F.lit(0.0), unknowns + 1), unknowns).alias("sums"),
        )
        return F.aggregate(ys, begin, advance, lambda s: s["sums"])

    def solved(rows: Column) -> Column:
        """Gauss and Jordan's elimination; an unknown that the errors do not show stays zero."""

        def eliminate(m: Column, k: Column) -> Column:
            def cleared(top: Column) -> Column:
                return F.transform(
                    m,
                    lambda row, i: F.when(i == k, top).otherwise(
                        F.zip_with(row, top, lambda x, z: x - F.get(row, k) * z)
                    ),
                )

            row = F.get(m, k)
            pivot = F.get(row, k)
            return let(F.transform(row, lambda x: F.when(pivot > 1e-9, x / pivot).otherwise(0.0)), cleared)

        done = F.aggregate(F.sequence(F.lit(0), F.lit(unknowns - 1)), rows, eliminate)
        return F.transform(done, lambda row: F.element_at(row, -1))

    def started(start: Column, more: Column) -> Column:
        rest = F.slice(more, 3, season - 1)
        last = F.aggregate(rest, F.lit(0.0), lambda s, x: s - x)
        return F.struct(
            (start["l"] + F.get(more, F.lit(0))).alias("l"),
            (start["t"] + F.get(more, F.lit(1))).alias("t"),
            F.zip_with(start["r"], F.concat(rest, F.array(last)), lambda x, d: x + d).alias("r"),
        )

    def near(best: Column, start: Column) -> Column:
        moves = _grid(**dict.fromkeys(("a", "b", "g"), SEASONAL_STEPS))
        points = F.transform(
            moves,
            lambda d: F.struct(
                *[F.least(F.greatest(best[x] + d[x], F.lit(0.0)), F.lit(1.0)).alias(x) for x in ("a", "b", "g")]
            ),
        )
        return F.array_min(F.concat(F.array(best), F.transform(points, lambda p: run(p, start))))

    def improved(best: Column, start: Column) -> Column:
        more = let(equations(best, start), solved)
        return let(let(more, lambda d: started(start, d)), lambda moved: near(best, moved))

    means = F.struct(
        _mean(F.slice(ys, 1, season)).alias("first"),
        _mean(F.slice(ys, season + 1, season)).alias("second"),
    )
    return let(
        let(means, first_start),
        lambda start: let(
            let(fit_holt_winters(ys, season), lambda best: improved(best, start)),
            lambda best: improved(best, start),
        ),
    )


def _project(state: Column, steps: Column) -> Column:
    """The values a fitted state gives for the next ``steps`` periods."""

    def at(s: Column, h: Column) -> Column:
        width = F.size(s["season"])
        turn = F.get(s["season"], F.pmod(h - 1, F.greatest(width, F.lit(1))))
        return s["level"] + h * s["trend"] + F.when(width > 0, turn).otherwise(0.0)

    return let(state, lambda s: F.transform(F.sequence(F.lit(1), steps), lambda h: at(s, h)))


def _naive(ys: Column, season: Column, steps: Column) -> Column:
    """The last ``season`` values, repeated."""
    start = F.size(ys) - season
    return F.transform(
        F.sequence(F.lit(1), steps), lambda h: F.get(ys, start + F.pmod(h - 1, season))
    )


def _line(ys: Column, steps: Column) -> Column:
    """The last value moved on by the mean step."""
    last = F.get(ys, F.size(ys) - 1)
    mean_step = (last - F.get(ys, F.lit(0))) / F.greatest(F.size(ys) - 1, F.lit(1))
    return F.transform(F.sequence(F.lit(1), steps), lambda h: last + mean_step * h)


def _model(model: str, ys: Column, seasonal: Column, steps: Column, holt: Column, start: str) -> Column:
    """Array of ``steps`` forecasts of one model; ``holt`` stands in for a short season."""
    if model == "seasonal-naive":
        return _naive(ys, F.when(seasonal, V.SEASON).otherwise(1), steps)
    if model == "naive-linear":
        return _line(ys, steps)
    if model == "simple-exp-smoothing":
        return _project(fit_ses(ys, start), steps)
    if model == "holt-winters-add":
        return holt
    if model == "holt-winters-add-add":
        return F.when(seasonal, _project(fit_holt_winters(ys, start=start), steps)).otherwise(holt)
    raise ValueError(f"unknown model {model!r}")


def _runs(prepared: DataFrame, tasks: Column, models, start: str) -> tuple[DataFrame, list[str]]:
    """Add one column per model: an array with the forecast for each (ys, steps) task."""
    frame = prepared.withColumn("_tasks", tasks)
    trended = any(m.startswith("holt") for m in models)
    if trended:
        frame = frame.withColumn(
            "_holt", F.transform("_tasks", lambda t: _project(fit_holt(t["ys"], start), t["steps"]))
        )
    names = [f"_m{i}" for i in range(len(models))]
    seasonal = F.col("seasonal")

    def run(model: str) -> Column:
        return F.transform(
            "_tasks",
            lambda t, i: _model(
                model, t["ys"], seasonal, t["steps"], F.get("_holt", i) if trended else None, start
            ),
        )

    return frame.withColumns({n: run(m) for n, m in zip(names, models)}), names


def _task(ys: Column, steps: Column) -> Column:
    return F.struct(ys.alias("ys"), steps.alias("steps"))


def _candidates(series: DataFrame, keys: list[str], periods: int, models, start: str) -> DataFrame:
    """Back-test and full-length forecasts per series and model."""
    cut = train_size(F.col("n"))
    test = F.slice("ys", cut + 1, F.col("n") - cut)
    prepared = series.select(
        *keys, "xs", "ys", "n", test.alias("test"), (cut >= 2 * V.SEASON).alias("seasonal")
    )
    tasks = F.array(
        _task(F.slice("ys", F.lit(1), cut), F.col("n") - cut), _task(F.col("ys"), F.lit(periods))
    )
    frame, names = _runs(prepared, tasks, models, start)
    results = F.array(
        *[
            F.struct(
                F.lit(place).alias("place"),
                F.lit(model).alias("model"),
                F.get(name, F.lit(0)).alias("tested"),
                F.get(name, F.lit(1)).alias("ahead"),
            )
            for place, (model, name) in enumerate(zip(models, names))
        ]
    )
    return frame.select(*keys, "xs", "ys", "n", "test", F.inline(results))


def _sample_variance(values: Column) -> Column:
    """Sample variance of an array, null with fewer than two values."""
    squares = let(
        _mean(values),
        lambda m: F.aggregate(values, F.lit(0.0), lambda s, y: s + (y - m) * (y - m)),
    )
    return F.when(F.size(values) > 1, squares / F.greatest(F.size(values) - 1, F.lit(1)))


def _scored(series: DataFrame, keys: list[str], periods: int, models, start: str) -> DataFrame:
    pairs = F.arrays_zip(F.col("test").alias("t"), F.col("tested").alias("f"))
    errors = F.transform(pairs, lambda p: F.abs(p["t"] - p["f"]))
    relative = F.transform(
        F.filter(pairs, lambda p: p["t"] != 0), lambda p: F.abs((p["t"] - p["f"]) / p["t"])
    )
    variance = F.coalesce(_sample_variance(F.col("ys")), F.lit(0.0))
    tolerance = F.greatest(F.lit(1e-6), variance * 1e-4)
    flat = (_sample_variance(F.col("ahead")) < tolerance) & (variance > tolerance)
    return _candidates(series, keys, periods, models, start).select(
        *keys,
        "xs",
        "ys",
        "n",
        "place",
        "model",
        "ahead",
        _mean(errors).alias("mae"),
        F.when(F.size(relative) > 0, _mean(relative) * 100).alias("mape"),
        F.coalesce(flat, F.lit(False)).alias("is_flat"),
    )


def backtest_errors(
    series: DataFrame,
    keys: list[str] = (),
    periods: int = V.DEFAULT_HORIZON,
    models=V.MODELS,
    start: str = "first",
) -> DataFrame:
    """Hold-out errors per series and model: (keys..., model, mae, mape, is_flat)."""
    return _scored(series, list(keys), periods, models, start).select(
        *keys, "place", "model", "mae", "mape", "is_flat"
    )


def model_points(
    series: DataFrame, model: str, periods: int, freq: str = "MS", keys: list[str] = (), start: str = "first"
) -> DataFrame:
    """Forecast points of one model: (keys..., x, y)."""
    prepared = series.withColumn("seasonal", train_size(F.col("n")) >= 2 * V.SEASON)
    frame, (name,) = _runs(prepared, F.array(_task(F.col("ys"), F.lit(periods))), [model], start)
    return _points(frame.withColumn("ahead", F.get(name, F.lit(0))), list(keys), freq)


def _points(frame: DataFrame, keys: list[str], freq: str) -> DataFrame:
    last = F.element_at("xs", -1)
    return frame.select(*keys, last.alias("_last"), F.posexplode("ahead").alias("_h", "y")).select(
        *keys, add_periods(F.col("_last"), F.col("_h") + 1, freq).alias("x"), "y"
    )


def accuracy_rating(mape: Column, mae: Column, series_mean: Column) -> Column:
    """Verdict by percent error, or by error over the mean where that is undefined."""
    relative = F.when(series_mean != 0, F.abs(mae / F.nullif(series_mean, F.lit(0.0))) * 100)
    measured = F.coalesce(mape, relative)
    verdict = F.when(measured.isNull(), "unknown")
    for limit, name in V.RATING_LIMITS:
        verdict = verdict.when(measured < limit, name)
    return verdict.otherwise("poor")


def forecast_select(
    series: DataFrame,
    keys: list[str] = (),
    periods: int = V.DEFAULT_HORIZON,
    models=V.MODELS,
    start: str = "first",
) -> DataFrame:
    """The winning model per series.

    Lowest mean absolute error among the models whose forecast is not flat, or
    among all when every one is; a tie goes to a Holt model, then to the
    earlier one.  A line through the mean step stands in when none can be scored.
    """
    keys = list(keys)
    usable = F.col("mae").isNotNull() & ~F.isnan("mae")
    order = F.struct(
        F.col("is_flat").cast("int"),
        F.col("mae"),
        F.when(F.col("model").contains("holt"), 0).otherwise(1),
        F.col("place"),
    )
    chosen = F.struct("model", "mae", "mape", "ahead")
    winners = (
        _scored(series, keys, periods, models, start)
        .groupBy(*keys)
        .agg(
            F.first("xs").alias("xs"),
            F.first("ys").alias("ys"),
            F.first("n").alias("n"),
            F.min_by(chosen, F.when(usable, order)).alias("w"),
        )
        .where(F.col("n").isNotNull())
    )
    missing = F.col("w").isNull()
    return winners.select(
        *keys,
        "xs",
        "ys",
        "n",
        F.coalesce("w.model", F.lit("naive-linear")).alias("method"),
        F.col("w.mae").alias("mae"),
        F.col("w.mape").alias("mape"),
        F.when(missing, _line(F.col("ys"), F.lit(periods))).otherwise(F.col("w.ahead")).alias("ahead"),
    )


def forecast_accuracy(selected: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Rounded errors and the verdict of the winning model."""
    rating = accuracy_rating(F.col("mape"), F.col("mae"), _mean(F.col("ys")))
    return selected.select(
        *keys,
        "method",
        F.round("mae", 2).alias("mae"),
        F.round("mape", 2).alias("mape_pct"),
        rating.alias("rating"),
    )


def forecast(
    df: DataFrame,
    date_col: str,
    measure: str,
    periods: int = V.DEFAULT_HORIZON,
    freq: str = "MS",
    keys: list[str] = (),
    start: str = "first",
) -> DataFrame:
    """History and forecast on one calendar: (keys..., kind, x, y, method).

    ``start`` tells where smoothing begins: at the ``first`` values or at ``estimated`` ones.
    Empty for a series with fewer than four rows or periods.
    """
    keys = list(keys)
    selected = forecast_select(series_frame(df, date_col, measure, freq, keys), keys, periods, start=start)
    last = F.element_at("xs", -1)
    past = F.transform(
        F.arrays_zip("xs", "ys"),
        lambda p: F.struct(F.lit("history").alias("kind"), p["xs"].alias("x"), p["ys"].alias("y")),
    )
    future = F.transform(
        "ahead",
        lambda y, h: F.struct(
            F.lit("forecast").alias("kind"),
            add_periods(last, h + 1, freq).alias("x"),
            y.alias("y"),
        ),
    )
    return selected.select(*keys, "method", F.inline(F.concat(past, future))).select(
        *keys, "kind", "x", "y", "method"
    )
