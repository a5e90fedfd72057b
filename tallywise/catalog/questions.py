"""Queries on a log of questions, derived from the events and conversations tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import questions as Q
from ..functions import vocabulary as V
from ..operators import questions as ops
from ..operators.profile import Roles
from ..plans import findings
from .registry import load, query, quoted

# The question asked with each event; the text is the same expression in both engines.
TEMPLATES = (
    "'Show me top ' || CAST(user_id % 20 + 1 AS STRING) || ' regions by revenue'",
    "'Bottom five categories by profit'",
    "'Forecast revenue for the next ' || CAST(user_id % 18 + 1 AS STRING) || ' months'",
    "'Predict units for two quarters'",
    "'forecast ' || CAST(user_id AS STRING) || ' days of sales'",
    "'Only ' || upper(event_type)",
    "'Exclude ' || event_type",
    "'Compare with last year'",
    "'Now show ' || CAST(1995 + user_id % 30 AS STRING)",
    "'Find anomalies in Profit'",
    "'What is the correlation between units and net sales?'",
    "'Which region is performing worst'",
    "'Who is winning?'",
    "'How are we doing?'",
    "'Anything interesting in ' || event_type || '?'",
    "'Explain this chart'",
    "'Show the ' || CAST(user_id % 9 + 4 AS STRING) || 'th order by discount'",
    "'third best customer'",
    "'the third client please'",
    "'Hello there'",
    "'thanks'",
    "'good morning'",
    "'Trend of turnover by month, ascending'",
    "'Describe the administration costs'",
    "'rgeion revenu'",
    "'list the channels high to low'",
    "'reset'",
    "'Show me only \"' || event_type || '\" and ' || upper(event_type) || ' in 2024'",
    "'asdf qwer'",
    "'monthly evolution of unit prices'",
)
CASES = " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(TEMPLATES))
TEXT = f"CASE event_id % {len(TEMPLATES)} {CASES} END"
ASKED_SQL = f"asked AS (SELECT event_id, user_id, {TEXT} AS q FROM events)"
SAID_SQL = "asked AS (SELECT conv_id, turn, text AS q FROM conversations)"


def _asked(spark, sf):
    return load(spark, sf, "events").select("event_id", "user_id", F.expr(TEXT).alias("q"))


# Columns of the table the questions are about.
ROLES = Roles(
    columns=("Net_Sales", "Profit", "Units", "Unit_Price", "Region", "Category", "Channel",
             "Order_Date"),
    measures=("Net_Sales", "Profit", "Units", "Unit_Price"),
    dimensions=("Region", "Category", "Channel"),
    dates=("Order_Date",),
    ids=(),
    geo=("Region",),
    types={},
    measure="Net_Sales",
    dimension="Category",
    date="Order_Date",
)


def norm_sql(text: str) -> str:
    return f"trim(regexp_replace(lower({text}), '[^a-z0-9 ]+', ' ', 'g'))"


def tokens_sql(text: str) -> str:
    stop = ", ".join(quoted(w) for w in V.STOP_WORDS)
    return (
        f"list_filter(regexp_split_to_array({norm_sql(text)}, ' +'), "
        f"lambda w: w <> '' AND NOT list_contains([{stop}], w))"
    )


def stem_sql(w: str) -> str:
    return f"""CASE WHEN length({w}) > 4 AND {w} LIKE '%ies' THEN left({w}, length({w}) - 3) || 'y'
        WHEN length({w}) > 4 AND {w} LIKE '%es' AND NOT regexp_matches({w}, '(ses|zes|xes)$')
            THEN left({w}, length({w}) - 2)
        WHEN length({w}) > 3 AND {w} LIKE '%s' AND {w} NOT LIKE '%ss' THEN left({w}, length({w}) - 1)
        ELSE {w} END"""


@query("q_normalise", f"SELECT conv_id, turn, {norm_sql('text')} AS normalised FROM conversations")
def q_normalise(spark, sf):
    return load(spark, sf, "conversations").select(
        "conv_id", "turn", Q.normalise(F.col("text")).alias("normalised")
    )


@query(
    "q_tokens",
    f"SELECT conv_id, turn, array_to_string({tokens_sql('text')}, ' ') AS tokens FROM conversations",
)
def q_tokens(spark, sf):
    return load(spark, sf, "conversations").select(
        "conv_id", "turn", F.array_join(Q.tokens(F.col("text")), " ").alias("tokens")
    )


@query(
    "q_stem",
    f"""WITH {ASKED_SQL}, w AS (SELECT unnest({tokens_sql('text')}) AS word FROM conversations
        UNION SELECT unnest({tokens_sql('q')}) FROM asked)
    SELECT word, {stem_sql('word')} AS stem FROM w""",
)
def q_stem(spark, sf):
    texts = load(spark, sf, "conversations").select(F.col("text").alias("q"))
    texts = texts.unionByName(_asked(spark, sf).select("q"))
    words = texts.select(F.explode(Q.tokens(F.col("q"))).alias("word")).distinct()
    return words.withColumn("stem", Q.stem(F.col("word")))


def _any(patterns) -> str:
    return quoted("|".join(f"(?:{p})" for p in patterns))


def _said(words, substring=False) -> str:
    if substring:
        return "(" + " OR ".join(f"contains(t, {quoted(w)})" for w in words) + ")"
    return "(" + " OR ".join(f"regexp_matches(t, {quoted(chr(92) + 'b' + w + 's?' + chr(92) + 'b')})" for w in words) + ")"


ORDINAL_SQL = (
    r"coalesce(try_cast(nullif(regexp_extract(t, '\b(\d+)(st|nd|rd|th)\b', 1), '') AS BIGINT), CASE "
    + " ".join(rf"WHEN regexp_matches(t, '\b{w}\b') THEN {n}" for w, n in V.ORDINAL_WORDS.items())
    + " END)"
)


def rule_sql(substring: bool = False) -> str:
    """Number of the first rule that fits a normalised question t."""
    said = [
        _said(w, substring)
        for w in (V.FORECAST_WORDS, V.ANOMALY_WORDS, V.CORRELATION_WORDS, V.BOTTOM_WORDS,
                  V.TOP_WORDS, V.TREND_WORDS)
    ]
    phrases = [
        f"regexp_matches(t, {_any(p)})"
        for p in (V.OVERVIEW_PHRASES, V.INSIGHT_PHRASES, V.EXPLAIN_PHRASES, V.BEST_PHRASES,
                  V.WORST_PHRASES)
    ]
    rules = phrases + said + [f"{ORDINAL_SQL} IS NOT NULL"]
    return "CASE " + " ".join(f"WHEN {r} THEN {i}" for i, r in enumerate(rules)) + " ELSE 12 END"


def classed_sql(substring: bool = False, asked: str = ASKED_SQL) -> str:
    """classed(keys of ``asked``, q, t, rule, op, base, conf)."""
    names = "['overview', 'insights', 'explain', 'top', 'top', 'forecast', 'anomaly', 'correlation', " \
            "'top', 'top', 'trend', 'nth', 'summary']"
    return f"""{asked}, texts AS (SELECT *, {norm_sql('q')} AS t FROM asked),
    ruled AS (SELECT *, {rule_sql(substring)} AS rule FROM texts),
    classed AS (SELECT *, {names}[rule + 1] AS op, rule IN (4, 8) AS base,
        CASE WHEN rule <= 4 THEN 0.9 WHEN rule <= 10 THEN 0.85 WHEN rule = 11 THEN 0.8 ELSE 0.4 END::DOUBLE
            AS conf FROM ruled)"""


def _classified(spark, sf, substring=False):
    return ops.classify(_asked(spark, sf), "q", substring)


OP_SQL = "SELECT event_id, q, op, base AS ascending, conf AS op_confidence FROM classed"


def _op(spark, sf, substring):
    rule = F.col("rule")
    return (
        _asked(spark, sf)
        .withColumn("rule", Q.op_rule(Q.normalise(F.col("q")), substring))
        .select(
            "event_id",
            "q",
            Q.op_of(rule).alias("op"),
            Q.ascending_of(rule).alias("ascending"),
            Q.confidence_of(rule).alias("op_confidence"),
        )
    )


@query("q_op", f"WITH {classed_sql()} {OP_SQL}")
def q_op(spark, sf):
    return _op(spark, sf, False)


@query("q_op_substring", f"WITH {classed_sql(True)} {OP_SQL}")
def q_op_substring(spark, sf):
    return _op(spark, sf, True)


def _number_sql(x: str) -> str:
    cases = " ".join(f"WHEN {quoted(w)} THEN {n}" for w, n in V.NUMBER_WORDS.items())
    return f"coalesce(try_cast(nullif({x}, '') AS BIGINT), CASE {x} {cases} END)"


_ANCHORS = "|".join(V.TOP_WORDS + V.BOTTOM_WORDS)
_NUMBERS = "|".join(V.NUMBER_WORDS)
_FOUND = rf"regexp_extract(t, '\b({_ANCHORS})\s+(\d+|{_NUMBERS})\b', 2)"
TOP_SQL = f"coalesce({_number_sql(_FOUND)}, 10)::BIGINT"
_LEAD = r"(?:next|forecast|predict|for)\s+"
_DIGITS = rf"'{_LEAD}(\d+)\s+(month|year|quarter|week|day)'"
_WORDS = rf"'{_LEAD}([a-z]+)\s+(month|year|quarter)'"
_COUNT = f"try_cast(nullif(regexp_extract(t, {_DIGITS}, 1), '') AS BIGINT)"
_WORD_COUNT = _number_sql(f"regexp_extract(t, {_WORDS}, 1)")
HORIZON_SQL = f"""coalesce(
    CASE regexp_extract(t, {_DIGITS}, 2) WHEN 'year' THEN {_COUNT} * 12 WHEN 'quarter' THEN {_COUNT} * 3
        WHEN 'week' THEN greatest(1, {_COUNT} // 4) WHEN 'day' THEN greatest(1, {_COUNT} // 30)
        WHEN 'month' THEN {_COUNT} END,
    CASE regexp_extract(t, {_WORDS}, 2) WHEN 'year' THEN {_WORD_COUNT} * 12
        WHEN 'quarter' THEN {_WORD_COUNT} * 3 WHEN 'month' THEN {_WORD_COUNT} END, 6)::BIGINT"""


@query(
    "q_top_n",
    f"WITH {classed_sql()} SELECT event_id, CASE WHEN op = 'top' THEN {TOP_SQL} END AS n FROM classed",
)
def q_top_n(spark, sf):
    return _classified(spark, sf).select("event_id", "n")


@query("q_ordinal", f"WITH {classed_sql()} SELECT event_id, {ORDINAL_SQL}::BIGINT AS ordinal FROM classed")
def q_ordinal(spark, sf):
    return _asked(spark, sf).select(
        "event_id", Q.ordinal(Q.normalise(F.col("q"))).alias("ordinal")
    )


@query(
    "q_horizon",
    f"WITH {classed_sql()} SELECT event_id, CASE WHEN op = 'forecast' THEN {HORIZON_SQL} END AS periods "
    "FROM classed",
)
def q_horizon(spark, sf):
    return _classified(spark, sf).select("event_id", "periods")


DIRECTION_SQL = (
    f"CASE WHEN {_said(V.DESCENDING_WORDS)} THEN false WHEN {_said(V.ASCENDING_WORDS)} THEN true "
    "ELSE base END"
)


@query("q_direction", f"WITH {classed_sql()} SELECT event_id, {DIRECTION_SQL} AS ascending FROM classed")
def q_direction(spark, sf):
    return _classified(spark, sf).select("event_id", "ascending")


@query(
    "q_conversation_intents",
    f"""WITH {classed_sql(asked=SAID_SQL)} SELECT conv_id, turn, op, conf AS op_confidence,
        {DIRECTION_SQL} AS ascending, CASE WHEN op = 'top' THEN {TOP_SQL} END AS n,
        CASE WHEN op = 'forecast' THEN {HORIZON_SQL} END AS periods,
        CASE WHEN op = 'nth' THEN {ORDINAL_SQL} END::BIGINT AS nth_index FROM classed""",
)
def q_conversation_intents(spark, sf):
    turns = load(spark, sf, "conversations").select("conv_id", "turn", "text")
    return ops.classify(turns, "text").select(
        "conv_id", "turn", "op", "op_confidence", "ascending", "n", "periods", "nth_index"
    )


_PHRASES = sorted({" ".join(g.replace("'", " ").split()) for g in V.GREETINGS})
GREETING_SQL = f"""CASE WHEN regexp_replace(t, ' +', ' ', 'g') IN ({', '.join(map(quoted, _PHRASES))}) THEN 0.99
    WHEN len({tokens_sql('q')}) <= 3 AND list_has_any({tokens_sql('q')},
        [{', '.join(quoted(g) for g in _PHRASES if ' ' not in g)}]) THEN 0.95 END::DOUBLE"""


@query(
    "q_greeting",
    f"WITH {classed_sql()} SELECT event_id, {GREETING_SQL} AS greeting_confidence FROM classed",
)
def q_greeting(spark, sf):
    return _asked(spark, sf).select(
        "event_id", Q.greeting(F.col("q")).alias("greeting_confidence")
    )


REFINE_SQL = f"regexp_matches(lower(trim(q)), {_any(V.REFINEMENT_PHRASES)})"
RESET_SQL = f"regexp_matches(lower(trim(q)), {_any(V.RESET_PHRASES)})"


@query(
    "q_refinement",
    f"WITH {ASKED_SQL} SELECT event_id, {REFINE_SQL} AS is_refinement, {RESET_SQL} AS is_reset FROM asked",
)
def q_refinement(spark, sf):
    return _asked(spark, sf).select(
        "event_id",
        Q.is_refinement(F.col("q")).alias("is_refinement"),
        Q.is_reset(F.col("q")).alias("is_reset"),
    )


_STOP = ", ".join(quoted(w) for w in V.STOP_WORDS)
NAMED_SQL = f"""named AS (SELECT event_id, q,
        try_cast(nullif(regexp_extract(q, {quoted(Q.YEAR)}, 1), '') AS INTEGER) AS year,
        regexp_matches(lower(q), {quoted(Q.YEAR_COMPARE)}) AS yoy,
        nullif(trim(regexp_extract(q, {quoted(Q.EXCLUDED)}, 1)), '') AS excluded,
        regexp_extract_all(regexp_replace(q, {quoted(Q.COMMAND)}, ''), {quoted(Q.LITERAL)}, 0) AS found
    FROM asked),
    kept AS (SELECT *, list_filter(list_transform(found, lambda s: trim(s, '"')), lambda s: length(s) > 1
        AND NOT list_contains([{_STOP}], lower(s)) AND lower(s) <> lower(coalesce(excluded, ''))) AS literals
    FROM named)"""


@query(
    "q_filters",
    f"""WITH {ASKED_SQL}, {NAMED_SQL} SELECT event_id, year, yoy, excluded,
    array_to_string(literals, '|') AS literals FROM kept""",
)
def q_filters(spark, sf):
    question = F.col("q")
    return _asked(spark, sf).select(
        "event_id",
        Q.year_named(question).alias("year"),
        Q.year_compared(question).alias("yoy"),
        Q.excluded(question).alias("excluded"),
        F.array_join(Q.literals(question), "|").alias("literals"),
    )


RECORDS_SQL = f"""{ASKED_SQL}, {NAMED_SQL},
    l AS (SELECT event_id, 'eq' AS op, unnest(list_distinct(literals)) AS value FROM kept
          UNION ALL SELECT event_id, 'neq', excluded FROM kept WHERE excluded IS NOT NULL),
    v AS (SELECT min(i) AS i, v FROM (SELECT 0 AS i, lower(event_type) AS v FROM events
          UNION ALL SELECT 1, lower(props) FROM events) GROUP BY v),
    records AS (
    SELECT event_id, ['event_type', 'props'][i + 1] AS "column", op, value FROM l JOIN v ON lower(value) = v
    UNION ALL SELECT event_id, 'ts', 'year_eq', year::VARCHAR FROM kept WHERE year IS NOT NULL
    UNION ALL SELECT event_id, 'ts', 'compare_yoy', NULL FROM kept WHERE yoy)"""


@query("q_filter_records", f"WITH {RECORDS_SQL} SELECT * FROM records")
def q_filter_records(spark, sf):
    events = load(spark, sf, "events")
    return ops.question_filters(
        _asked(spark, sf), "event_id", "q", events, ["event_type", "props"], "ts"
    )


# A session is a user, as for follow-ups.
@query(
    "q_session_filters",
    f"""WITH {RECORDS_SQL},
    e AS (SELECT event_id, user_id, {REFINE_SQL} AS adds,
        sum(({RESET_SQL})::INTEGER) OVER (PARTITION BY user_id ORDER BY event_id) AS epoch FROM asked),
    s AS (SELECT DISTINCT user_id, epoch, event_id AS at, "column" FROM e JOIN records USING (event_id) WHERE adds),
    f AS (SELECT e.event_id, e.user_id, s."column", max(s.at) AS at FROM e JOIN s
        ON e.user_id = s.user_id AND e.epoch = s.epoch AND s.at <= e.event_id GROUP BY ALL)
    SELECT f.event_id, f.user_id, f."column", r.op, r.value
    FROM f JOIN records r ON r.event_id = f.at AND f."column" = r."column" """,
)
def q_session_filters(spark, sf):
    return ops.session_filters(
        _asked(spark, sf), q_filter_records(spark, sf), "event_id", "user_id", "event_id", "q",
        ["event_type", "props", "ts"],
    )


def _columns_sql() -> str:
    """best(event_id, measure, measure_score, ...): columns matched by the score ladder."""
    families = ", ".join(
        f"({quoted(a)}, {quoted(b)})" for family in V.SYNONYMS for a in family for b in family
    )
    offered = ", ".join(
        f"({quoted(role)}, {i}, {quoted(name)}, {quoted(name.lower())})"
        for role, names in zip(ops.ROLES, (ROLES.measures, ROLES.dimensions, ROLES.dates))
        for i, name in enumerate(names)
    )

    def near(a, b):
        return f"1 - levenshtein({a}, {b}) / greatest(length({a}), length({b}), 1)"

    picked = ", ".join(
        f"""arg_max(col, score * 1000 - place) FILTER (role = '{r}' AND score >= 0.55) AS {r},
        coalesce(max(score) FILTER (role = '{r}' AND score >= 0.55), 0)::DOUBLE AS {r}_score"""
        for r in ops.ROLES
    )
    return f"""families(member, other) AS (VALUES {families}),
    offered(role, place, col, folded) AS (VALUES {offered}),
    used AS (SELECT DISTINCT event_id, unnest({tokens_sql('q')}) AS token FROM asked),
    toks AS (SELECT DISTINCT token, {stem_sql('token')} AS st FROM used WHERE length(token) >= 2),
    variants AS (SELECT token, token AS word FROM toks UNION SELECT token, st FROM toks
        UNION SELECT token, other FROM toks JOIN families ON member = token OR member = st),
    vs AS (SELECT token, word, {stem_sql('word')} AS ws FROM variants),
    parts AS (SELECT folded, p, {stem_sql('p')} AS ps FROM
        (SELECT DISTINCT folded, unnest(regexp_split_to_array(folded, '[_\\s-]+')) AS p FROM offered)
        WHERE p <> ''),
    compared AS (SELECT token, word, ws, folded, bool_or(word = p OR ws = ps) AS is_part,
            bool_or(contains(ps, ws) OR contains(ws, ps)) AS holds,
            max(greatest({near('word', 'p')}, {near('ws', 'ps')})) AS part_ratio
        FROM vs, parts GROUP BY ALL),
    scored AS (SELECT token, role, place, col, max(CASE
            WHEN word = folded THEN 1.0::DOUBLE
            WHEN ws = ({stem_sql('folded')}) THEN 0.97
            WHEN is_part THEN 0.95
            WHEN length(word) >= 3 AND (contains(folded, word) OR contains(word, folded)) THEN 0.88
            WHEN length(ws) >= 3 AND holds THEN 0.82
            ELSE greatest({near('word', 'folded')}, part_ratio) END) AS score
        FROM compared JOIN offered USING (folded) GROUP BY ALL),
    matched AS (SELECT event_id, {picked} FROM used JOIN scored USING (token) GROUP BY event_id),
    best AS (SELECT event_id, measure, coalesce(measure_score, 0) AS measure_score, dimension,
            coalesce(dimension_score, 0) AS dimension_score, date_col,
            coalesce(date_col_score, 0) AS date_col_score
        FROM asked LEFT JOIN matched USING (event_id))"""


@query(
    "q_columns",
    f"""WITH {ASKED_SQL}, {_columns_sql()} SELECT event_id, measure, round(measure_score, 6) AS measure_score,
    dimension, round(dimension_score, 6) AS dimension_score, date_col,
    round(date_col_score, 6) AS date_col_score FROM best""",
)
def q_columns(spark, sf):
    found = ops.match_columns(_asked(spark, sf), "event_id", "q", ROLES)
    return found.select(
        "event_id",
        *ops.ROLES,
        *[F.round(f"{r}_score", 6).alias(f"{r}_score") for r in ops.ROLES],
    )


# Words of the tables against names of columns, pair by pair.
COMPARED = ("o_totalprice", "orderdate", "segment", "supplier", "brand name")
_WORDS = (("nation", "n_name"), ("part", "p_name"), ("part", "p_type"), ("customer", "c_mktsegment"),
          ("supplier", "s_name"), ("orders", "o_orderpriority"), ("events", "event_type"))


@query(
    "word_similarity",
    f"""WITH RECURSIVE said AS ({" UNION ALL ".join(f"SELECT {c} AS t FROM {t}" for t, c in _WORDS)}),
    words AS (SELECT DISTINCT w FROM (SELECT unnest(string_split(lower(t), ' ')) AS w FROM said) WHERE w <> ''),
    pairs AS (SELECT w, c FROM words, (SELECT unnest([{", ".join(f"'{c}'" for c in COMPARED)}]) AS c)),
    blocks AS (
        SELECT w, c, w AS a, c AS b, 0::BIGINT AS same FROM pairs
        UNION ALL
        SELECT w, c, CASE WHEN side = 0 THEN substr(a, 1, p - 1) ELSE substr(a, p + size) END,
            CASE WHEN side = 0 THEN substr(b, 1, in_b - 1) ELSE substr(b, in_b + size) END, CASE WHEN side = 0 THEN size ELSE 0 END
        FROM (SELECT *, instr(b, substr(a, p, size)) AS in_b FROM (
            SELECT *, best // 1000 AS size, 999 - best % 1000 AS p FROM (
                SELECT *, list_max(flatten([[CASE WHEN contains(b, substr(a, i, n)) THEN n * 1000 + 999 - i ELSE 0 END
                    for n in range(1, length(a) - i + 2)] for i in range(1, length(a) + 1)])) AS best
                FROM blocks WHERE a <> '' AND b <> '') WHERE best > 0)), (VALUES (0), (1)) s(side))
    SELECT w AS word, c AS "column", round(2.0 * sum(same) / any_value(length(w) + length(c)), 6)::DOUBLE AS ratio
    FROM blocks GROUP BY w, c""",
)
def word_similarity(spark, sf):
    said = None
    for table, column in _WORDS:
        words = load(spark, sf, table).select(F.explode(F.split(F.lower(column), " ")).alias("word"))
        said = words if said is None else said.unionByName(words)
    pairs = said.where("word <> ''").distinct().select("word", F.explode(F.array(*[F.lit(c) for c in COMPARED])).alias("column"))
    ratio = Q.sequence_ratio(F.col("word"), F.col("column"))
    return pairs.select("word", "column", F.round(ratio, 6).alias("ratio"))


INTENT_SQL = f"""{classed_sql()}, {_columns_sql()},
    blended AS (SELECT classed.*, best.* EXCLUDE (event_id), {GREETING_SQL} AS hello,
        {DIRECTION_SQL} AS up, {TOP_SQL} AS top_n, {HORIZON_SQL} AS horizon, {ORDINAL_SQL} AS nth,
        {REFINE_SQL} AS is_refinement, {RESET_SQL} AS is_reset,
        {_said(V.TOP_WORDS + V.BOTTOM_WORDS + V.ASCENDING_WORDS + V.DESCENDING_WORDS)} AS names_direction,
        measure IS NOT NULL OR dimension IS NOT NULL OR date_col IS NOT NULL AS mapped,
        greatest(measure_score, dimension_score, date_col_score) AS cs
        FROM classed JOIN best USING (event_id)),
    tagged AS (SELECT event_id, user_id,
        CASE WHEN hello IS NOT NULL THEN 'greeting' WHEN conf <= 0.4 AND cs < 0.7 THEN 'unknown' ELSE op END AS op,
        CASE WHEN hello IS NULL THEN measure END AS measure,
        CASE WHEN hello IS NULL THEN dimension END AS dimension,
        CASE WHEN hello IS NULL THEN date_col END AS date_col,
        CASE WHEN hello IS NULL AND op = 'top' THEN top_n END AS n,
        CASE WHEN hello IS NULL AND op = 'forecast' THEN horizon END AS periods,
        CASE WHEN hello IS NULL AND op = 'nth' THEN nth END::BIGINT AS nth_index,
        up AND hello IS NULL AS ascending,
        CASE WHEN hello IS NOT NULL THEN hello WHEN conf <= 0.4 AND cs < 0.7 THEN 0.3
            WHEN NOT mapped AND conf > 0.5 THEN least(0.5, round(least(1.0, conf * 0.6 + cs * 0.4), 2))
            ELSE round(least(1.0, conf * 0.6 + cs * 0.4), 2) END::DOUBLE AS confidence,
        is_refinement, is_reset, names_direction FROM blended)"""


def _intents(spark, sf):
    return ops.tag_questions(_asked(spark, sf), "event_id", "q", ROLES)


@query("q_confidence", f"WITH {INTENT_SQL} SELECT event_id, op, confidence FROM tagged")
def q_confidence(spark, sf):
    return _intents(spark, sf).select("event_id", "op", "confidence")


@query("q_intents", f"WITH {INTENT_SQL} SELECT * FROM tagged")
def q_intents(spark, sf):
    return _intents(spark, sf)


# A session is a user; turns follow the event number.  Segments between resets,
# and within them from one remembered question to the next.
FOLLOW_SQL = f"""{INTENT_SQL},
    epochs AS (SELECT *, op NOT IN ('greeting', 'unknown') AS sets,
        sum(is_reset::INTEGER) OVER (PARTITION BY user_id ORDER BY event_id) AS epoch FROM tagged),
    flagged AS (SELECT *, is_refinement AND op IN ('summary', 'unknown') AND coalesce(bool_or(sets) OVER (
        PARTITION BY user_id, epoch ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)
        AS follow_up FROM epochs),
    segments AS (SELECT *, sum((sets AND NOT follow_up)::INTEGER) OVER (
        PARTITION BY user_id ORDER BY event_id) AS segment FROM flagged)"""


def _carried_sql(name: str) -> str:
    return (
        f"CASE WHEN follow_up THEN last_value(CASE WHEN sets OR follow_up THEN {name} END IGNORE NULLS) "
        "OVER (PARTITION BY user_id, segment ORDER BY event_id ROWS UNBOUNDED PRECEDING) "
        f"ELSE {name} END AS {name}"
    )


@query(
    "q_followup",
    f"""WITH {FOLLOW_SQL} SELECT event_id, user_id, follow_up, is_refinement, is_reset, names_direction,
    CASE WHEN follow_up THEN first_value(op) OVER (PARTITION BY user_id, segment ORDER BY event_id) ELSE op END
        AS op,
    {', '.join(_carried_sql(c) for c in ('measure', 'dimension', 'date_col', 'n', 'periods', 'nth_index'))},
    CASE WHEN follow_up THEN last_value(CASE WHEN (sets AND NOT follow_up) OR names_direction AND follow_up
            THEN ascending END IGNORE NULLS)
        OVER (PARTITION BY user_id, segment ORDER BY event_id ROWS UNBOUNDED PRECEDING)
        ELSE ascending END AS ascending,
    CASE WHEN follow_up THEN greatest(confidence, 0.7) ELSE confidence END AS confidence FROM segments""",
)
def q_followup(spark, sf):
    return ops.follow_ups(_intents(spark, sf), "user_id", "event_id")


@query(
    "q_followup_turns",
    f"""WITH t AS (SELECT conv_id, turn, role, {norm_sql('text')} AS t FROM conversations)
    SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (
        PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_user_turn
    FROM t""",
)
def q_followup_turns(spark, sf):
    turns = load(spark, sf, "conversations")
    asked = F.when(F.col("role") == "user", F.col("turn"))
    return ops.carry_last(
        turns, "conv_id", "turn", before={"last_user_turn": asked}
    ).select("conv_id", "turn", "last_user_turn")


def _advice_sql() -> str:
    cases = " ".join(
        f"WHEN op = {quoted(op)} AND {'true' if up is None else f'ascending = {up}'} THEN {quoted(text)}"
        for op, up, text in findings.OP_ADVICE
    )
    return f"CASE {cases} ELSE {quoted(findings.GENERAL_ADVICE)} END"


@query(
    "query_recommendations",
    f"WITH {classed_sql()}, a AS (SELECT event_id, op, {DIRECTION_SQL} AS ascending FROM classed) "
    f"SELECT event_id, op, ascending, {_advice_sql()} AS message FROM a",
)
def query_recommendations(spark, sf):
    asked = _classified(spark, sf).select("event_id", "op", "ascending")
    return findings.query_recommendations(asked)
