"""The table profile, the overview and the answer to one question."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

from pyspark.sql import DataFrame, Row

from ..functions import vocabulary as V
from ..operators import distribution, filters, forecast, kpi, quality, ranking, series
from ..operators.aggregate import drill_geo, drill_time
from ..operators.cleaning import clean
from ..operators.contribution import pareto
from ..operators.cube import Cube, moment_cube
from ..operators.profile import (
    Roles,
    add_date_features,
    column_profile,
    column_stats,
    infer_domain,
    roles_of,
    table_summaries,
)
from ..session import cut_lineage
from ..sources.sinks import block_sizes
from . import findings


INSIGHT_BLOCKS = ("kpis", "trend", "insights", "recommendations")


@dataclass(frozen=True)
class Profile:
    """A cleaned table with its calendar columns, and what is known about it."""

    name: str
    table: DataFrame
    source: DataFrame
    columns: DataFrame
    roles: Roles
    engineered: tuple[str, ...]
    domain: DataFrame

    def stats(self) -> DataFrame:
        return column_stats(self.source, list(self.roles.measures))

    def quality(self, with_features: bool = False) -> DataFrame:
        return quality.quality_score(self.table if with_features else self.source)


def profile_table(df: DataFrame, name: str = "Sheet1", approximate: bool = False) -> Profile:
    """Clean a table, type its columns, assign roles and add calendar columns.

    One row per column comes to the driver; everything else stays lazy.
    """
    source = clean(df)
    columns = column_profile(source, approximate=approximate)
    roles = roles_of(columns)
    table, made = add_date_features(source, list(roles.dates))
    summary = table_summaries({name: table})
    return Profile(name, table, source, columns, roles, tuple(made), infer_domain(summary))


def profile_workbook(tables: dict[str, DataFrame]) -> dict[str, Profile]:
    """Profile of every table of a workbook."""
    return {name: profile_table(df, name) for name, df in tables.items()}


def overview(
    df: DataFrame,
    roles: Roles,
    row_key: str | list[str],
    domain: str | DataFrame = "general",
    only: tuple[str, ...] | None = None,
) -> dict[str, DataFrame]:
    """The blocks of the executive overview, each one a DataFrame.

    A block is there only if the columns it needs are; ``only`` names the ones
    to build.  KPIs, trend, ranking, Pareto, slicers, drill-downs and the findings that rest on
    them come from one stored cube (``operators.cube``), the pairs from one stored matrix; each
    takes one scan.  Histogram, anomalies and quality read the rows themselves.
    """
    measures, measure = list(roles.measures), roles.measure
    dimension, date = roles.dimension, roles.date
    keys = [row_key] if isinstance(row_key, str) else list(row_key)
    makers: dict[str, Callable[[], DataFrame]] = {}

    slicers, geo = list(roles.dimensions)[: V.SLICER_COLUMNS], list(roles.geo[: V.GEO_LEVELS])

    @cache
    def cube() -> Cube:
        return moment_cube(df, measures, dimension, date, slicers, geo if len(geo) >= 2 else ())

    @cache
    def upper() -> DataFrame | None:
        return cut_lineage(distribution.correlations(df, measures)) if len(measures) >= 2 else None

    @cache
    def ranked() -> DataFrame | None:
        return pareto(cube().rows(measure, dimension), dimension, measure) if measure and dimension else None

    @cache
    def monthly() -> DataFrame | None:
        return cube().monthly() if measures else None

    if measures:
        makers["kpis"] = lambda: kpi.kpi_summary(df, measures, date, V.KPI_MEASURES, monthly())
    if measure and date:
        makers["trend"] = lambda: series.trend(cube().rows(measure, date), date, measure)
    if measure and dimension:
        makers["top"] = lambda: ranking.top_n(cube().rows(measure, dimension), dimension, measure)
        makers["pareto"] = lambda: ranked().orderBy("position").limit(V.PARETO_ROWS)
    if len(measures) >= 2:
        makers["correlation"] = lambda: distribution.correlation_matrix(df, measures, upper())
        makers["strong_pairs"] = lambda: distribution.strong_pairs(df, measures, upper=upper())
    if measure:
        makers["histogram"] = lambda: distribution.histogram(df, measure)
        makers["anomalies"] = lambda: (
            distribution.anomalies(df, measure, keys, date).orderBy(*keys).limit(V.ANOMALY_ROWS)
        )
        makers["anomaly_summary"] = lambda: distribution.anomaly_summary(df, measure)
    makers["missing"] = lambda: quality.missing_ranking(df)
    makers["quality"] = lambda: quality.quality_score(df)
    if roles.dimensions:
        makers["slicers"] = lambda: filters.most_frequent(cube().values(slicers))
    if date:
        makers["slicer_dates"] = lambda: filters.slicer_dates(cube().days(), date)
    if date and measure:
        makers["drill_time"] = lambda: drill_time(cube().rows(measure, date, "_rows"), date, measure, "_rows")
    if measure and len(geo) >= 2:
        makers["drill_geo"] = lambda: drill_geo(cube().places(geo, measure, "_rows"), geo, measure, rows="_rows")
    makers["insights"] = lambda: findings.insights(
        df, measures, measure, dimension, date, ranked=ranked(), monthly=monthly(), upper=upper()
    )
    makers["recommendations"] = lambda: findings.recommendations(
        df, measures, measure, dimension, date, domain, ranked=ranked(), monthly=monthly()
    )
    return {name: make() for name, make in makers.items() if only is None or name in only}


def overview_blocks(blocks: dict[str, DataFrame]) -> DataFrame:
    """Rows per block of an overview."""
    return block_sizes(blocks)


def answer(
    df: DataFrame,
    roles: Roles,
    op: str,
    measure: str | None = None,
    dimension: str | None = None,
    date_col: str | None = None,
    n: int | None = None,
    periods: int | None = None,
    nth_index: int | None = None,
    ascending: bool = False,
    row_key: str | list[str] = (),
    active_filters: list[dict] = (),
) -> dict[str, DataFrame]:
    """The blocks that answer one question.

    Columns the question does not name are taken from the profile.  An
    operation whose columns are missing falls back to what is there: a ranking,
    a trend, or the KPI with its histogram.  A record ``compare_yoy`` filters
    nothing; it adds the block ``yoy``.
    """
    if op in ("greeting", "unknown"):
        return {}
    if active_filters:
        df = filters.apply_filters(df, list(active_filters))
    measure = measure or roles.measure
    dimension = dimension or roles.dimension
    date_col = date_col or roles.date
    blocks = _blocks(df, roles, op, measure, dimension, date_col, n, periods, nth_index, ascending, row_key)
    compared = [f["column"] for f in active_filters if f.get("op") == "compare_yoy"]
    if measure and compared and compared[0] in df.columns:
        blocks["yoy"] = series.yoy_compare(df, compared[0], measure)
    return blocks


def answer_question(
    df: DataFrame,
    roles: Roles,
    intent: Row | dict,
    active_filters: list[dict] = (),
    row_key: str | list[str] = (),
) -> dict[str, DataFrame]:
    """The blocks that answer one row of tagged questions under the filters in force.

    ``intent`` is a row of ``tag_questions`` or ``follow_ups``, ``active_filters``
    that question's rows of ``session_filters`` (or ``question_filters``).
    """
    asked = intent.asDict() if isinstance(intent, Row) else dict(intent)
    taken = ("measure", "dimension", "date_col", "n", "periods", "nth_index")
    return answer(
        df,
        roles,
        asked["op"],
        **{k: asked.get(k) for k in taken},
        ascending=bool(asked.get("ascending")),
        row_key=row_key,
        active_filters=[f.asDict() if isinstance(f, Row) else f for f in active_filters],
    )


def _blocks(
    df: DataFrame,
    roles: Roles,
    op: str,
    measure: str | None,
    dimension: str | None,
    date_col: str | None,
    n: int | None,
    periods: int | None,
    nth_index: int | None,
    ascending: bool,
    row_key: str | list[str],
) -> dict[str, DataFrame]:
    measures = list(roles.measures)
    if op == "overview":
        return overview(df, roles, row_key)
    if op in ("insights", "explain"):
        return overview(df, roles, row_key, only=INSIGHT_BLOCKS)
    if op == "trend" and measure and date_col:
        return {"trend": series.trend(df, date_col, measure)}
    if op == "forecast" and measure and date_col:
        return {"forecast": forecast.forecast(df, date_col, measure, periods or V.DEFAULT_HORIZON)}
    if op == "top" and measure and dimension:
        return {"top": ranking.top_n(df, dimension, measure, n or V.DEFAULT_TOP_N, ascending)}
    if op == "nth" and measure and dimension:
        place = nth_index or 1
        return {
            "nth": ranking.nth_ranked(df, dimension, measure, place, ascending),
            "availability": ranking.rank_availability(df, dimension, measure, place),
        }
    if op == "anomaly":
        if not measure:
            return {}
        keys = [row_key] if isinstance(row_key, str) else list(row_key)
        return {
            "anomalies": distribution.anomalies(df, measure, keys, date_col),
            "anomaly_summary": distribution.anomaly_summary(df, measure),
        }
    if op == "correlation":
        return {
            "correlation": distribution.correlation_matrix(df, measures),
            "strong_pairs": distribution.strong_pairs(df, measures),
        }
    if measure and dimension:
        return {"top": ranking.top_n(df, dimension, measure, ascending=ascending)}
    if measure and date_col:
        return {"trend": series.trend(df, date_col, measure)}
    if measure:
        return {
            "kpis": kpi.kpi_summary(df, [measure], date_col),
            "histogram": distribution.histogram(df, measure),
        }
    return {}

