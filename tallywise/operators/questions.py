"""A log of questions turned into structured intents, as a batch job."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import questions as Q
from ..functions import vocabulary as V
from ..functions.coerce import name_of
from ..session import cut_lineage
from .filters import literal_lookup
from .prefix import cut_points, with_range
from .profile import Roles

ROLES = ("measure", "dimension", "date_col")


def _candidates(roles: Roles) -> Column:
    offered = zip(ROLES, (roles.measures, roles.dimensions, roles.dates))
    return F.array(
        *[
            F.struct(
                F.lit(role).alias("role"),
                F.lit(i).alias("place"),
                F.lit(name).alias("column"),
                F.lit(name.lower()).alias("folded"),
            )
            for role, names in offered
            for i, name in enumerate(names)
        ]
    )


def token_scores(words: DataFrame, roles: Roles, similarity: str = "edit") -> DataFrame:
    """Score of each distinct word against each column: (token, role, place, column, score).

    The number of columns is fixed by the profile, so each word grows into a
    bounded number of rows.  ``similarity`` is ``edit`` (edit distance) or
    ``sequence`` (matching blocks, which cost more).
    """
    pairs = (
        words.select("token", F.explode(Q.synonyms(F.col("token"))).alias("word"))
        .select("token", "word", F.inline(_candidates(roles)))
        .withColumn("rule", Q.exact_match_score(F.col("word"), F.col("folded")))
    )
    if similarity == "edit":
        scored = pairs.withColumn(
            "score", F.coalesce("rule", Q.similarity_score(F.col("word"), F.col("folded")))
        )
    elif similarity == "sequence":
        parts = F.filter(F.split("folded", r"[_\s\-]+"), lambda w: w != "")
        compared = F.concat(
            F.array(F.struct(F.col("word").alias("a"), F.col("folded").alias("b"))),
            F.flatten(
                F.transform(
                    parts,
                    lambda w: F.array(
                        F.struct(F.col("word").alias("a"), w.alias("b")),
                        F.struct(Q.stem(F.col("word")).alias("a"), Q.stem(w).alias("b")),
                    ),
                )
            ),
        )
        settled = pairs.where(F.col("rule").isNotNull()).withColumn("score", F.col("rule"))
        open_pairs = pairs.where(F.col("rule").isNull()).select("*", F.inline(compared))
        guessed = open_pairs.withColumn("score", Q.sequence_ratio(F.col("a"), F.col("b"))).drop("a", "b")
        scored = settled.unionByName(guessed)
    else:
        raise ValueError(f"unknown similarity {similarity!r}")
    return scored.groupBy("token", "role", "place", "column").agg(F.max("score").alias("score"))


def _matched(
    questions: DataFrame, id_col: str, text_col: str, roles: Roles, similarity: str
) -> DataFrame:
    """(_id, <role> struct(score, n, column)...) for the questions that name a column.

    Words are scored once, however many questions use them.  Only words that
    reach the acceptance limit for some column go back to the questions, at
    most one row per question and word.
    """
    used = questions.select(
        name_of(id_col).alias("_id"),
        F.explode(F.array_distinct(Q.tokens(name_of(text_col)))).alias("token"),
    ).where(F.length("token") >= 2)
    scores = token_scores(used.select("token").distinct(), roles, similarity)

    def best(role: str) -> Column:
        rank = F.struct("score", (-F.col("place")).alias("n"), "column")
        return F.max(F.when(F.col("role") == role, rank))

    per_token = (
        scores.where(F.col("score") >= V.COLUMN_MATCH_MIN)
        .groupBy("token")
        .agg(*[best(r).alias(f"_{r}") for r in ROLES])
    )
    return (
        used.join(per_token, "token")
        .groupBy("_id")
        .agg(*[F.max(f"_{r}").alias(f"_{r}") for r in ROLES])
    )


def _with_columns(
    questions: DataFrame, source: DataFrame, id_col: str, text_col: str, roles: Roles, similarity: str
) -> DataFrame:
    """``questions`` with the best column and score per role, matched on the texts of ``source``."""
    if roles.measures or roles.dimensions or roles.dates:
        found = _matched(source, id_col, text_col, roles, similarity)
        joined = questions.join(found, name_of(id_col) == F.col("_id"), "left")
        return joined.select(
            *[name_of(c) for c in questions.columns],
            *[F.col(f"_{r}.column").alias(r) for r in ROLES],
            *[F.coalesce(F.col(f"_{r}.score"), F.lit(0.0)).alias(f"{r}_score") for r in ROLES],
        )
    return questions.select(
        "*",
        *[F.lit(None).cast("string").alias(r) for r in ROLES],
        *[F.lit(0.0).alias(f"{r}_score") for r in ROLES],
    )


def match_columns(
    questions: DataFrame, id_col: str, text_col: str, roles: Roles, similarity: str = "edit"
) -> DataFrame:
    """Best column per role and question: id plus <role> and <role>_score."""
    ids = questions.select(name_of(id_col))
    return _with_columns(ids, questions, id_col, text_col, roles, similarity)


def classify(questions: DataFrame, text_col: str, substring: bool = False) -> DataFrame:
    """Add op, ascending, n, periods, nth_index, greeting and flags; no shuffle."""
    question, text, rule = name_of(text_col), F.col("_text"), F.col("_rule")
    op = F.col("op")
    return (
        questions.withColumn("_text", Q.normalise(question))
        .withColumns({"_rule": Q.op_rule(text, substring), "_words": Q.tokens_in(text)})
        .withColumns({"op": Q.op_of(rule), "op_confidence": Q.confidence_of(rule)})
        .withColumns(
            {
                "n": F.when(op == "top", Q.top_count(text)),
                "periods": F.when(op == "forecast", Q.horizon(text)),
                "nth_index": F.when(op == "nth", Q.ordinal(text)),
                "ascending": Q.direction(text, Q.ascending_of(rule), substring),
                "names_direction": Q.names_direction(text, substring),
                "greeting_confidence": Q.greeting_in(text, F.col("_words")),
                "is_refinement": Q.is_refinement(question),
                "is_reset": Q.is_reset(question),
            }
        )
        .drop("_text", "_rule", "_words")
    )


def combined_confidence(measures_exist: bool) -> tuple[Column, Column]:
    """(op, confidence) from op_confidence, greeting_confidence and the column scores."""
    matched = (
        F.col("measure").isNotNull() | F.col("dimension").isNotNull() | F.col("date_col").isNotNull()
    )
    columns = F.when(matched, F.greatest(*[f"{r}_score" for r in ROLES])).otherwise(0.0)
    blended = F.round(F.least(F.lit(1.0), F.col("op_confidence") * 0.6 + columns * 0.4), 2)
    if measures_exist:
        unmapped = ~matched & (F.col("op_confidence") > 0.5)
        blended = F.when(unmapped, F.least(blended, F.lit(0.5))).otherwise(blended)
    unknown = (F.col("op_confidence") <= 0.4) & (columns < 0.7)
    hello = F.col("greeting_confidence").isNotNull()
    op = F.when(hello, "greeting").when(unknown, "unknown").otherwise(F.col("op"))
    confidence = (
        F.when(hello, F.col("greeting_confidence")).when(unknown, F.lit(0.3)).otherwise(blended)
    )
    return op, confidence


def tag_questions(
    questions: DataFrame,
    id_col: str,
    text_col: str,
    roles: Roles,
    substring: bool = False,
    similarity: str = "edit",
) -> DataFrame:
    """The intent of every question: op, columns, numbers, direction, confidence."""
    classified = classify(questions, text_col, substring)
    op, confidence = combined_confidence(bool(roles.measures))
    hello = F.col("op") == "greeting"

    def unless_greeting(column: str) -> Column:
        return F.when(~hello, F.col(column)).alias(column)

    return (
        _with_columns(classified, questions, id_col, text_col, roles, similarity)
        .withColumn("confidence", confidence)
        .withColumn("op", op)
        .select(
            *[name_of(c) for c in questions.columns if c != text_col],
            "op",
            *[unless_greeting(r) for r in ROLES],
            unless_greeting("n"),
            unless_greeting("periods"),
            unless_greeting("nth_index"),
            (F.col("ascending") & ~hello).alias("ascending"),
            "confidence",
            "is_refinement",
            "is_reset",
            "names_direction",
        )
    )


def carry_last(
    df: DataFrame,
    session: str,
    turn: str,
    upto: dict[str, Column] | None = None,
    before: dict[str, Column] | None = None,
    ranges: int | None = None,
    cuts: DataFrame | None = None,
) -> DataFrame:
    """Add, per name, the latest non-null value seen so far in the session.

    ``upto`` counts the row itself, ``before`` only earlier rows.  The log is cut
    into ranges of similar row counts by session and turn; a window runs inside a
    session's part of a range, and only the last values of each part travel on,
    so one endless session does not end in one task, however its turns are numbered.
    ``cuts`` are cut points found before, for logs carried over more than once.
    """
    upto, before = upto or {}, before or {}
    values = {**upto, **before}
    order = [name_of(session), name_of(turn)]
    cuts = cut_points(df, order, ranges) if cuts is None else cuts
    # Window and block ends read the same exchange.
    marked = (
        with_range(df, order, cuts)
        .withColumnRenamed("_range", "_block")
        .withColumns({f"_v_{n}": v for n, v in values.items()})
        .repartition(session, "_block")
    )
    inside = Window.partitionBy(session, "_block").orderBy(turn)
    seen = marked.withColumns(
        {
            f"_in_{n}": F.last(f"_v_{n}", ignorenulls=True).over(
                inside.rowsBetween(Window.unboundedPreceding, 0 if n in upto else -1)
            )
            for n in values
        }
    )
    ends = marked.groupBy(session, "_block").agg(
        *[
            F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), name_of(turn))).alias(f"_e_{n}")
            for n in values
        ]
    )
    earlier = Window.partitionBy(session).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    handed = ends.select(
        session,
        "_block",
        *[F.last(f"_e_{n}", ignorenulls=True).over(earlier).alias(f"_b_{n}") for n in values],
    )
    # Sessions that fit one range have nothing to join.
    held = reduce(lambda a, b: a | b, [F.col(f"_b_{n}").isNotNull() for n in values])
    joined = seen.join(handed.where(held), [session, "_block"], "left")
    return joined.select(
        *[name_of(c) for c in df.columns],
        *[F.coalesce(f"_in_{n}", f"_b_{n}").alias(n) for n in values],
    )


def follow_ups(intents: DataFrame, session: str, turn: str) -> DataFrame:
    """Let refinements without an operation of their own continue the question before.

    ``intents`` is the output of :func:`tag_questions` with a session and a turn
    column.  A refinement takes the operation of the last remembered intent and
    every column and number it does not name itself; the direction too, unless
    it names one.  Greetings and unknown questions are not remembered, a reset
    forgets.
    """
    # Read several times below; tagging is worth storing on the shared folder.
    intents = cut_lineage(intents)
    cuts = cut_points(intents, [name_of(session), name_of(turn)])
    remembered = ~F.col("op").isin("greeting", "unknown")
    when = name_of(turn)
    history = carry_last(
        intents,
        session,
        turn,
        upto={"_reset_at": F.when(F.col("is_reset"), when)},
        before={"_set_at": F.when(remembered, when)},
        cuts=cuts,
    )
    known = F.col("_set_at").isNotNull() & (
        F.col("_reset_at").isNull() | (F.col("_set_at") >= F.col("_reset_at"))
    )
    marked = history.withColumn(
        "follow_up",
        F.col("is_refinement") & F.col("op").isin("summary", "unknown") & known,
    )
    carried = ("measure", "dimension", "date_col", "n", "periods", "nth_index")
    starts = remembered & ~F.col("follow_up")
    part = remembered | F.col("follow_up")
    values = {"_start": F.when(starts, F.struct(when.alias("at"), "op"))}
    for name in carried:
        values[f"_c_{name}"] = F.when(
            part & F.col(name).isNotNull(), F.struct(when.alias("at"), F.col(name).alias("v"))
        )
    values["_c_ascending"] = F.when(
        starts | (F.col("follow_up") & F.col("names_direction")),
        F.struct(when.alias("at"), F.col("ascending").alias("v")),
    )
    full = carry_last(marked, session, turn, upto=values, cuts=cuts)

    def taken(name: str) -> Column:
        kept = F.col(f"_c_{name}")
        current = kept["at"] >= F.col("_start.at")
        return (
            F.when(F.col("follow_up"), F.when(current, kept["v"])).otherwise(F.col(name)).alias(name)
        )

    return full.select(
        *[
            name_of(c)
            for c in intents.columns
            if c not in carried + ("op", "ascending", "confidence")
        ],
        F.when(F.col("follow_up"), F.col("_start.op")).otherwise(F.col("op")).alias("op"),
        *[taken(c) for c in carried],
        taken("ascending"),
        F.when(F.col("follow_up"), F.greatest("confidence", F.lit(0.7)))
        .otherwise(F.col("confidence"))
        .alias("confidence"),
        "follow_up",
    )


def question_filters(
    questions: DataFrame,
    id_col: str,
    text_col: str,
    data: DataFrame | None,
    dimensions: list[str],
    date_col: str | None,
    lookup: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Filter records the questions ask for: (id, column, op, value).

    A named value is looked up in the dimension columns, the first that holds
    it wins, and values no column holds make no record.  ``lookup`` answers
    (literal) with (literal, column) in place of a scan of ``data``, such as
    a stored dictionary (``value_index``).
    """
    question = name_of(text_col)
    base = questions.select(
        name_of(id_col).alias(id_col),
        Q.year_named(question).alias("year"),
        Q.year_compared(question).alias("yoy"),
        F.concat(
            F.transform(
                F.array_distinct(Q.literals(question)),
                lambda s: F.struct(F.lit("eq").alias("op"), s.alias("literal")),
            ),
            F.when(
                Q.excluded(question).isNotNull(),
                F.array(F.struct(F.lit("neq").alias("op"), Q.excluded(question).alias("literal"))),
            ).otherwise(F.array().cast("array<struct<op:string,literal:string>>")),
        ).alias("named"),
    )
    asked = base.select(id_col, F.inline("named"))
    places = lookup(asked) if lookup else literal_lookup(data, dimensions, asked)
    records = asked.join(places, "literal").select(
        id_col, "column", "op", F.col("literal").alias("value")
    )
    if date_col is None:
        return records
    dated = base.select(
        id_col,
        F.inline(
            F.array_compact(
                F.array(
                    F.when(
                        F.col("year").isNotNull(),
                        F.struct(
                            F.lit(date_col).alias("column"),
                            F.lit("year_eq").alias("op"),
                            F.col("year").cast("string").alias("value"),
                        ),
                    ),
                    F.when(
                        F.col("yoy"),
                        F.struct(
                            F.lit(date_col).alias("column"),
                            F.lit("compare_yoy").alias("op"),
                            F.lit(None).cast("string").alias("value"),
                        ),
                    ),
                )
            )
        ),
    )
    return records.unionByName(dated)


def session_filters(
    questions: DataFrame,
    records: DataFrame,
    id_col: str,
    session: str,
    turn: str,
    text_col: str,
    columns: list[str],
) -> DataFrame:
    """Filters in force after each question: (id, session, column, op, value).

    ``records`` is the output of :func:`question_filters`.  Refinements add theirs
    to the session's; those on a column replace all earlier ones on it, and a reset
    drops everything before it.  ``columns`` are the columns filters may name.
    """
    question = name_of(text_col)
    named = records.groupBy(id_col).agg(
        *[
            F.sort_array(
                F.collect_list(F.when(F.col("column") == c, F.struct("op", "value")))
            ).alias(f"_f{i}")
            for i, c in enumerate(columns)
        ]
    )
    turns = questions.select(
        *dict.fromkeys([id_col, session, turn]),
        Q.is_refinement(question).alias("_adds"),
        Q.is_reset(question).alias("_drops"),
    )
    when = name_of(turn)
    values = {"_reset_at": F.when(F.col("_drops"), when)}
    for i in range(len(columns)):
        values[f"_a{i}"] = F.when(
            F.col("_adds") & (F.size(f"_f{i}") > 0),
            F.struct(when.alias("at"), F.col(f"_f{i}").alias("records")),
        )
    cuts = cut_points(questions, [name_of(session), when])
    carried = carry_last(
        turns.join(named, id_col, "left"), session, turn, upto=values, cuts=cuts
    )

    def in_force(i: int, column: str) -> Column:
        kept = F.col(f"_a{i}")
        current = F.col("_reset_at").isNull() | (kept["at"] >= F.col("_reset_at"))
        told = F.transform(
            kept["records"],
            lambda r: F.struct(F.lit(column).alias("column"), r["op"].alias("op"), r["value"].alias("value")),
        )
        return F.when(current, told)

    every = F.flatten(F.array_compact(F.array(*[in_force(i, c) for i, c in enumerate(columns)])))
    return carried.select(*dict.fromkeys([id_col, session]), F.inline(every))
