"""Question tagging on literal questions."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tallywise.functions import questions as Q
from tallywise.operators import questions as ops
from tallywise.operators.prefix import cut_points, with_range
from tallywise.operators.profile import Roles

ROLES = Roles(
    columns=("OrderDate", "Region", "Category", "Revenue", "Profit", "Units"),
    measures=("Revenue", "Profit", "Units"),
    dimensions=("Region", "Category"),
    dates=("OrderDate",),
    ids=(), geo=("Region",), types={},
    measure="Revenue", dimension="Category", date="OrderDate",
)


def ask(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, q string")


def each(spark, texts, expression):
    df = ask(spark, texts).select("id", expression.alias("r")).orderBy("id")
    return [r["r"] for r in df.collect()]


def tagged(spark, texts, **options):
    rows = ops.tag_questions(ask(spark, texts), "id", "q", ROLES, **options).orderBy("id").collect()
    return [r.asDict() for r in rows]


def test_words(spark):
    q = F.col("q")
    assert each(spark, ["  What's UP?! ", "Été 2024"], Q.normalise(q)) == ["what s up", "t  2024"]
    assert each(spark, ["Show me the top, top regions", ""], Q.tokens(q)) == [["top", "top", "regions"], []]
    words = ["categories", "regions", "sales", "boxes", "taxes", "class", "gas", "trees", "is", "lies", "series"]
    assert each(spark, words, Q.stem(q)) == [
        "category", "region", "sal", "boxe", "taxe", "class", "gas", "tre", "is", "lie", "sery"]


OPS = [
    ("How are we doing?", "overview"),
    ("give me a summary", "overview"),
    ("any insights?", "insights"),
    ("Explain the dashboard", "explain"),
    ("which region is performing best", "top"),
    ("where are we weakest", "top"),
    ("Forecast revenue", "forecast"),
    ("find outliers", "anomaly"),
    ("drivers of profit", "correlation"),
    ("lowest revenue", "top"),
    ("highest revenue", "top"),
    ("revenue over time", "trend"),
    ("show the 5th region", "nth"),
    ("revenue", "summary"),
]


def test_operations(spark):
    rule = Q.op_rule(Q.normalise(F.col("q")))
    assert each(spark, [q for q, _ in OPS], Q.op_of(rule)) == [op for _, op in OPS]
    assert each(spark, ["where are we weakest", "lowest", "highest"], Q.ascending_of(rule)) == [True, True, False]


def test_inflected_operations(spark):
    asked = {
        "sales prediction": "forecast", "forecasting revenue": "forecast", "predicted profit": "forecast",
        "forecasts by region": "forecast", "predictive view": "forecast", "trending products": "trend",
        "changed profit by region": "trend", "changing prices": "trend", "spiked orders": "anomaly",
        "administration costs": "summary", "describe revenue": "summary",
    }
    rule = Q.op_rule(Q.normalise(F.col("q")))
    assert each(spark, list(asked), Q.op_of(rule)) == list(asked.values())


def test_whole_words_or_substrings(spark):
    texts = ["administration costs", "stop it", "describe revenue"]
    text = Q.normalise(F.col("q"))
    assert each(spark, texts, Q.op_of(Q.op_rule(text))) == ["summary"] * 3
    assert each(spark, texts[:2], Q.op_of(Q.op_rule(text, substring=True))) == ["top", "top"]
    assert each(spark, ["describe"], Q.names_direction(text)) == [False]
    assert each(spark, ["describe"], Q.names_direction(text, substring=True)) == [True]


def test_numbers(spark):
    text = Q.normalise(F.col("q"))
    assert each(spark, ["top 5", "bottom twelve", "top regions", "best of top 7"], Q.top_count(text)) == [5, 12, 10, 7]
    assert each(spark, ["21st", "the third one", "second or first", "none"], Q.ordinal(text)) == [21, 3, 1, None]
    asked = ["next 6 months", "predict 2 years", "for 3 quarters", "next 9 weeks", "next 2 weeks",
             "forecast 90 days", "next 5 days", "next two years", "forecast six quarters", "forecast sales"]
    assert each(spark, asked, Q.horizon(text)) == [6, 24, 9, 2, 1, 3, 1, 24, 18, 6]


def test_greetings_and_flags(spark):
    q = F.col("q")
    assert each(spark, ["Hi!", "what's up", "hello my friend", "hello show revenue by region now please sir",
                        "revenue"], Q.greeting(q)) == [0.99, 0.99, 0.95, None, None]
    assert each(spark, ["Only East", " exclude East", "east only", "drill down"], Q.is_refinement(q)) == [
        True, True, False, True]
    assert each(spark, ["reset", "Start over", "show me all data", "show east"], Q.is_reset(q)) == [
        True, True, True, False]


def test_filter_words(spark):
    q = F.col("q")
    texts = ["Only Electronics", 'show "north sea" in 2024', "Exclude East", "compare with last year", "revenue"]
    assert each(spark, texts, Q.literals(q)) == [["Electronics"], ["north sea"], [], [], []]
    assert each(spark, texts, Q.year_named(q)) == [None, 2024, None, None, None]
    assert each(spark, texts, Q.excluded(q)) == [None, None, "East", None, None]
    assert each(spark, texts, Q.year_compared(q)) == [False, False, False, True, False]


def test_filter_records(spark):
    data = spark.createDataFrame([("East", "Electronics"), ("West", "East")], "region string, category string")
    texts = ["Only Electronics", "exclude East", "Only Mars", "Only West in 1999", "Compare with last year"]
    rows = ops.question_filters(ask(spark, texts), "id", "q", data, ["region", "category"], "day").collect()
    assert sorted((r["id"], r["column"], r["op"], r["value"]) for r in rows if r["value"]) == [
        (0, "category", "eq", "Electronics"),
        (1, "region", "neq", "East"),
        (3, "day", "year_eq", "1999"),
        (3, "region", "eq", "West"),
    ]
    assert [(r["id"], r["op"]) for r in rows if r["value"] is None] == [(4, "compare_yoy")]


def test_smoke_question(spark):
    (row,) = tagged(spark, ["Show me top 5 regions by revenue"])
    assert (row["op"], row["n"], row["measure"], row["dimension"], row["ascending"]) == (
        "top", 5, "Revenue", "Region", False)
    assert row["confidence"] == 0.91


def test_intents(spark):
    rows = tagged(spark, ["hello", "qqq zzz", "forecast turnover for next 2 quarters", "top xyzzy qqqq", "profit",
                          "rgeion by highest reveune"])
    assert [r["op"] for r in rows] == ["greeting", "unknown", "forecast", "top", "summary", "top"]
    assert rows[0]["measure"] is None and rows[0]["confidence"] == 0.99
    assert rows[1]["confidence"] == 0.3
    assert (rows[2]["measure"], rows[2]["periods"]) == ("Revenue", 6)
    assert rows[3]["confidence"] <= 0.5
    assert rows[4]["measure"] == "Profit" and rows[4]["confidence"] == 0.64
    assert (rows[5]["measure"], rows[5]["dimension"]) == ("Revenue", "Region")


def brute_score(token, column, roles=ROLES):
    """The rules once more in plain Python, with the matching-blocks ratio."""
    def stem(w):
        if len(w) > 4 and w.endswith("ies"):
            return w[:-3] + "y"
        if len(w) > 4 and w.endswith("es") and w[-3] not in "szx":
            return w[:-2]
        return w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith("ss") else w

    column = column.lower()
    parts = [p for p in column.replace("-", "_").replace(" ", "_").split("_") if p]
    if token == column:
        return 1.0
    if stem(token) == stem(column):
        return 0.97
    if token in parts or stem(token) in [stem(p) for p in parts]:
        return 0.95
    if len(token) >= 3 and (token in column or column in token):
        return 0.88
    if len(stem(token)) >= 3 and any(stem(token) in stem(p) or stem(p) in stem(token) for p in parts):
        return 0.82
    pairs = [(token, column)] + [x for p in parts for x in ((token, p), (stem(token), stem(p)))]
    return max(SequenceMatcher(None, a, b).ratio() for a, b in pairs)


def test_sequence_similarity_equals_a_plain_loop(spark):
    words = ["rgeion", "reveune", "catgory", "unit", "proft", "xyzzy", "orderdates"]
    tokens = spark.createDataFrame([(w,) for w in words], "token string")
    scores = ops.token_scores(tokens, ROLES, similarity="sequence").collect()
    assert len(scores) == len(words) * 6
    for row in scores:
        expected = max(
            brute_score(v, row["column"]) for v in each(spark, [row["token"]], Q.synonyms(F.col("q")))[0]
        ) if row["column"] == "Region" else None
        if expected is not None:
            assert row["score"] == pytest.approx(expected)
    (fixed,) = tagged(spark, ["highest reveune by rgeion"], similarity="sequence")
    assert (fixed["measure"], fixed["dimension"]) == ("Revenue", "Region")
    with pytest.raises(ValueError):
        ops.token_scores(tokens, ROLES, similarity="sound")


def follow(spark, texts, session=1):
    asked = spark.createDataFrame([(session, i, t) for i, t in enumerate(texts)], "s int, id int, q string")
    intents = ops.tag_questions(asked, "id", "q", ROLES)
    return [r.asDict() for r in ops.follow_ups(intents, "s", "id").orderBy("id").collect()]


def test_follow_ups(spark):
    rows = follow(spark, ["only 2024", "bottom 3 regions by profit", "hello", "Only East", "exclude units",
                          "qqq", "reset", "Only West", "revenue trend", "just 1999"])
    assert [r["follow_up"] for r in rows] == [
        False, False, False, True, True, False, False, False, False, True]
    third = rows[3]
    assert (third["op"], third["measure"], third["dimension"], third["n"], third["ascending"]) == (
        "top", "Profit", "Region", 3, True)
    assert third["confidence"] == 0.7
    # A column named on the way replaces the remembered one.
    assert (rows[4]["op"], rows[4]["measure"], rows[4]["dimension"]) == ("top", "Units", "Region")
    assert rows[7]["op"] == "unknown"
    assert (rows[9]["op"], rows[9]["measure"], rows[9]["n"]) == ("trend", "Revenue", None)


@pytest.mark.parametrize("ranges", [1, 3, 1000])
def test_values_are_carried_across_ranges(spark, ranges):
    seen = [None, 5, None, None, None, 7, None, None, 1, None]
    df = spark.createDataFrame(
        [(s, i, v if s else None) for s in (0, 1) for i, v in enumerate(seen)], "s int, t int, v int"
    )
    out = ops.carry_last(df, "s", "t", upto={"now": F.col("v")}, before={"past": F.col("v")}, ranges=ranges)
    rows = {(r["s"], r["t"]): (r["now"], r["past"]) for r in out.collect()}
    last = None
    for i, v in enumerate(seen):
        before, last = last, v if v is not None else last
        assert rows[(1, i)] == (last, before)
        assert rows[(0, i)] == (None, None)


def test_one_session_with_sparse_turns_is_spread(spark):
    # A third of all turns in one session, numbered far apart.
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("s"),
        (F.col("id") * 1_000_003).alias("t"),
        F.when(F.col("id") % 300 == 0, F.col("id")).alias("v"),
    )
    order = [F.col("s"), F.col("t")]
    placed = with_range(df, order, cut_points(df, order, 12)).where("s = 0")
    assert placed.agg(F.count_distinct("_range")).first()[0] >= 3
    out = ops.carry_last(df, "s", "t", upto={"now": F.col("v")}, ranges=12).where("s = 0")
    assert all(r["now"] == r["t"] // 1_000_003 // 300 * 300 for r in out.collect())


def test_session_filters_add_replace_and_reset(spark):
    said = ["Only East", "just 2024", "Only West", "revenue in 2020", "reset", "exclude East", "hello"]
    asked = spark.createDataFrame([(i, 1, q) for i, q in enumerate(said)] + [(90, 2, "Only East")],
                                  "id int, s int, q string")
    data = spark.createDataFrame([("East",), ("West",)], "Region string")
    records = ops.question_filters(asked, "id", "q", data, ["Region"], "OrderDate")
    out = ops.session_filters(asked, records, "id", "s", "id", "q", ["Region", "OrderDate"])
    found = {}
    for r in out.collect():
        found.setdefault(r["id"], set()).add((r["column"], r["op"], r["value"]))
    east, west, year = ("Region", "eq", "East"), ("Region", "eq", "West"), ("OrderDate", "year_eq", "2024")
    # A question that refines nothing leaves the filters alone.
    assert found == {0: {east}, 1: {east, year}, 2: {west, year}, 3: {west, year},
                     5: {("Region", "neq", "East")}, 6: {("Region", "neq", "East")}, 90: {east}}
    none = ops.session_filters(asked.limit(0), records.limit(0), "id", "s", "id", "q", ["Region"])
    assert none.count() == 0


def test_sequence_ratio_is_that_of_the_plain_recursion(spark):
    rng = random.Random(12)
    pairs = [("".join(rng.choice(kinds) for _ in range(rng.randrange(0, 14))), "".join(rng.choice(kinds) for _ in range(rng.randrange(0, 14))))
             for kinds in ("ab", "abc", "abcdefgh", "aé日_ ") for _ in range(250)]
    pairs += [("", ""), ("", "a"), ("reveune", "revenue"), ("rgeion", "region"), ("%_", "_%"), ("private", "derivative" * 5)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = df.select("i", Q.sequence_ratio(F.col("a"), F.col("b"))).collect()
    for i, ratio in got:
        assert ratio == pytest.approx(SequenceMatcher(None, *pairs[i]).ratio(), abs=1e-12), pairs[i]
