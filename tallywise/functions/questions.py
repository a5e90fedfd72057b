"""Plain-English questions as column expressions: one question per row."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V
from .coerce import digits_to_long, let, word_list


def normalise(question: Column) -> Column:
    """Lower case, letters a-z and digits only, trimmed."""
    return F.trim(F.regexp_replace(F.lower(question), "[^a-z0-9 ]+", " "))


def tokens(question: Column) -> Column:
    """Words of the normalised question without stop words; repeats stay."""
    return tokens_in(normalise(question))


def tokens_in(text: Column) -> Column:
    """The same from the normalised question."""
    stop = word_list(V.STOP_WORDS)
    words = F.split(text, " +")
    return F.filter(words, lambda w: (w != "") & ~F.array_contains(stop, w))


def stem(word: Column) -> Column:
    """Crude singular of a lower-case word."""
    size = F.length(word)
    return (
        F.when((size > 4) & word.endswith("ies"), F.concat(F.left(word, size - 3), F.lit("y")))
        .when((size > 4) & word.rlike("es$") & ~word.rlike("[szx]es$"), F.left(word, size - 2))
        .when((size > 3) & word.rlike("s$") & ~word.rlike("ss$"), F.left(word, size - 1))
        .otherwise(word)
    )


def any_of(patterns: tuple[str, ...]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def words_pattern(words: tuple[str, ...], substring: bool = False) -> str:
    """Regular expression that finds one of the words, whole (or plural) unless ``substring``."""
    choice = "|".join(words)
    return choice if substring else rf"\b(?:{choice})s?\b"


def inflected(words: tuple[str, ...], substring: bool = False) -> str:
    """As ``words_pattern``, with the endings of verbs: forecasting, predicted, prediction, changes, trending."""
    if substring:
        return words_pattern(words, True)
    forms = [
        rf"{w[:-1]}(?:e|es|ed|ing)" if w.endswith("e") else rf"{w}(?:s|ed|ing|ions?|ive)?" for w in words
    ]
    return rf"\b(?:{'|'.join(forms)})\b"


ANY_ORDINAL = rf"\b(?:\d+(?:st|nd|rd|th)|{'|'.join(V.ORDINAL_WORDS)})\b"


def ordinal(text: Column) -> Column:
    """Position asked for in a normalised question, such as ``5th`` or ``third``; else null."""
    digits = F.regexp_extract(text, r"\b(\d+)(?:st|nd|rd|th)\b", 1)
    found = F.when(digits != "", digits_to_long(digits))
    for word, value in V.ORDINAL_WORDS.items():
        found = found.when(text.rlike(rf"\b{word}\b"), F.lit(value).cast("bigint"))
    return found


# Rule number -> (operation, ascending, confidence), in the order
# the rules are tried.
OP_RULES = (
    ("overview", False, 0.9),
    ("insights", False, 0.9),
    ("explain", False, 0.9),
    ("top", False, 0.9),
    ("top", True, 0.9),
    ("forecast", False, 0.85),
    ("anomaly", False, 0.85),
    ("correlation", False, 0.85),
    ("top", True, 0.85),
    ("top", False, 0.85),
    ("trend", False, 0.85),
    ("nth", False, 0.8),
    ("summary", False, 0.4),
)


def op_rule(text: Column, substring: bool = False) -> Column:
    """Number of the first rule a normalised question meets (see ``OP_RULES``).

    ``substring`` finds the words inside longer words too.
    """
    phrases = [
        any_of(p)
        for p in (
            V.OVERVIEW_PHRASES,
            V.INSIGHT_PHRASES,
            V.EXPLAIN_PHRASES,
            V.BEST_PHRASES,
            V.WORST_PHRASES,
        )
    ]
    words = [
        pattern(w, substring)
        for w, pattern in (
            (V.FORECAST_WORDS, inflected),
            (V.ANOMALY_WORDS, inflected),
            (V.CORRELATION_WORDS, words_pattern),
            (V.BOTTOM_WORDS, words_pattern),
            (V.TOP_WORDS, words_pattern),
            (V.TREND_WORDS, inflected),
        )
    ]
    rule = F.when(text.rlike(phrases[0]), 0)
    for place, pattern in enumerate(phrases[1:] + words, start=1):
        rule = rule.when(text.rlike(pattern), place)
    return rule.when(text.rlike(ANY_ORDINAL), len(OP_RULES) - 2).otherwise(len(OP_RULES) - 1)


def op_of(rule: Column) -> Column:
    return F.get(word_list(op for op, _, _ in OP_RULES), rule)


def ascending_of(rule: Column) -> Column:
    return rule.isin(*[i for i, (_, up, _) in enumerate(OP_RULES) if up])


def confidence_of(rule: Column) -> Column:
    return F.get(word_list(str(c) for _, _, c in OP_RULES).cast("array<double>"), rule)


def direction(text: Column, ascending: Column, substring: bool = False) -> Column:
    """Ascending or not, after explicit direction words; descending words win."""
    return (
        F.when(text.rlike(words_pattern(V.DESCENDING_WORDS, substring)), F.lit(False))
        .when(text.rlike(words_pattern(V.ASCENDING_WORDS, substring)), F.lit(True))
        .otherwise(ascending)
    )


def names_direction(text: Column, substring: bool = False) -> Column:
    """Whether a question says top, bottom, or a sort direction at all."""
    return text.rlike(
        words_pattern(V.TOP_WORDS + V.BOTTOM_WORDS + V.ASCENDING_WORDS + V.DESCENDING_WORDS, substring)
    )


def _number(text: Column) -> Column:
    """Digits or a number word as a number, else null."""
    words = F.str_to_map(F.lit(",".join(f"{w}:{n}" for w, n in V.NUMBER_WORDS.items())))
    return let(
        text,
        lambda t: F.coalesce(digits_to_long(t), F.try_element_at(words, t).cast("bigint")),
    )


def top_count(text: Column) -> Column:
    """The number right after a top or bottom word (the leftmost one), else 10."""
    anchors = "|".join(V.TOP_WORDS + V.BOTTOM_WORDS)
    numbers = "|".join(V.NUMBER_WORDS)
    found = F.regexp_extract(text, rf"\b(?:{anchors})\s+(\d+|{numbers})\b", 1)
    return F.coalesce(_number(found), F.lit(V.DEFAULT_TOP_N).cast("bigint"))


def horizon(text: Column) -> Column:
    """Months to forecast, from ``next 2 years`` and the like, else 6."""
    lead = r"(?:next|forecast|predict|for)\s+"
    digits = lead + r"(\d+)\s+(month|year|quarter|week|day)"
    words = lead + r"([a-z]+)\s+(month|year|quarter)"

    def amount(pattern: str) -> Column:
        return F.struct(
            _number(F.regexp_extract(text, pattern, 1)).alias("count"),
            F.regexp_extract(text, pattern, 2).alias("unit"),
        )

    def months(found: Column) -> Column:
        count, unit = found["count"], found["unit"]
        return (
            F.when(unit == "year", count * 12)
            .when(unit == "quarter", count * 3)
            .when(unit == "week", F.greatest(F.lit(1), F.floor(count / 4)))
            .when(unit == "day", F.greatest(F.lit(1), F.floor(count / 30)))
            .when(unit == "month", count)
        )

    return F.coalesce(
        let(amount(digits), months),
        let(amount(words), months),
        F.lit(V.DEFAULT_HORIZON).cast("bigint"),
    )


def greeting(question: Column) -> Column:
    """Confidence that a question is a greeting: 0.99, 0.95 or null."""
    return greeting_in(normalise(question), tokens(question))


def greeting_in(text: Column, words: Column) -> Column:
    """The same from the normalised question and its tokens."""
    phrases = sorted({" ".join(_plain(g).split()) for g in V.GREETINGS})
    single = word_list(g for g in phrases if " " not in g)
    return F.when(F.regexp_replace(text, " +", " ").isin(*phrases), F.lit(0.99)).otherwise(
        let(
            words,
            lambda w: F.when((F.size(w) <= 3) & F.arrays_overlap(w, single), F.lit(0.95)),
        )
    )


def _plain(text: str) -> str:
    return "".join(c if c.isascii() and (c.isalnum() or c == " ") else " " for c in text.lower())


def _lowered(question: Column) -> Column:
    return F.lower(F.regexp_replace(question, r"^\s+|\s+$", ""))


def is_refinement(question: Column) -> Column:
    """Whether the question narrows the previous one."""
    return _lowered(question).rlike(any_of(V.REFINEMENT_PHRASES))


def is_reset(question: Column) -> Column:
    """Whether the question drops all filters and the previous intent."""
    return _lowered(question).rlike(any_of(V.RESET_PHRASES))


# How filters are worded.
YEAR = r"\b(20\d{2}|19\d{2})\b"
YEAR_COMPARE = r"compare (?:with|to|against) (?:last|previous|prior) year"
EXCLUDED = r"(?i)(?:exclude|without|remove)\s+([A-Za-z0-9 ]+)"
LITERAL = r'"([^"]+)"|\b([A-Z][A-Za-z0-9_]+(?:\s+[A-Z][A-Za-z0-9_]+)?)\b'
COMMAND = (
    r"(?i)^\s*(?:only|just|now show|show me only|show only|show me|show|filter (?:by|on|to)|"
    r"limit (?:to|on)|for (?:just|only)|compare (?:with|to|against)|"
    r"also (?:include|show|add)|add|remove|exclude|without|drill (?:in|into|down))\b"
)


def year_named(question: Column) -> Column:
    return digits_to_long(F.regexp_extract(question, YEAR, 1)).cast("int")


def year_compared(question: Column) -> Column:
    return F.lower(question).rlike(YEAR_COMPARE)


def excluded(question: Column) -> Column:
    """The text after exclude, without or remove; null when there is none."""
    found = F.trim(F.regexp_extract(question, EXCLUDED, 1))
    return F.when(found != "", found)


def literals(question: Column) -> Column:
    """Quoted or capitalised values a question names, its command words and exclusions left out."""
    body = F.regexp_replace(question, COMMAND, "")
    found = F.transform(
        F.regexp_extract_all(body, F.lit(LITERAL), F.lit(0)),
        lambda s: F.regexp_replace(s, '^"|"$', ""),
    )
    stop = word_list(V.STOP_WORDS)
    return let(
        F.lower(F.coalesce(excluded(question), F.lit(""))),
        lambda out: F.filter(
            found,
            lambda s: (F.length(s) > 1)
            & ~F.array_contains(stop, F.lower(s))
            & (F.lower(s) != out),
        ),
    )


def synonyms(word: Column) -> Column:
    """The word, its stem, and every member of the families either belongs to."""
    families: dict[str, list[str]] = {}
    for family in V.SYNONYMS:
        for member in family:
            known = families.setdefault(member, [])
            known.extend(w for w in family if w not in known)
    lookup = F.from_json(F.lit(json.dumps(families)), "map<string,array<string>>")
    none = F.array().cast("array<string>")
    return F.array_distinct(
        F.concat(
            F.array(word, stem(word)),
            F.coalesce(F.try_element_at(lookup, word), none),
            F.coalesce(F.try_element_at(lookup, stem(word)), none),
        )
    )


def edit_similarity(a: Column, b: Column) -> Column:
    """1 for equal words, 0 for words with nothing in place in common."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def exact_match_score(word: Column, column: Column) -> Column:
    """Score of the rules before similarity (1 to 0.82), null when none applies."""
    words = F.filter(F.split(column, r"[_\s\-]+"), lambda w: w != "")
    word_stem = stem(word)
    stems = F.transform(words, stem)
    return (
        F.when(word == column, 1.0)
        .when(word_stem == stem(column), 0.97)
        .when(F.array_contains(words, word) | F.array_contains(stems, word_stem), 0.95)
        .when((F.length(word) >= 3) & (F.contains(column, word) | F.contains(word, column)), 0.88)
        .when(
            (F.length(word_stem) >= 3)
            & F.exists(stems, lambda w: F.contains(w, word_stem) | F.contains(word_stem, w)),
            0.82,
        )
    )


def similarity_score(word: Column, column: Column) -> Column:
    """Best edit similarity with the whole name and with each of its words."""
    words = F.filter(F.split(column, r"[_\s\-]+"), lambda w: w != "")
    word_stem = stem(word)
    best = F.array_max(
        F.transform(
            words,
            lambda w: F.greatest(edit_similarity(word, w), edit_similarity(word_stem, stem(w))),
        )
    )
    return F.greatest(edit_similarity(word, column), best)


def _longest_shared(a: Column, b: Column) -> Column:
    """The longest text that stands in both, the first of ``a`` among equals: struct (size, back, part).

    ``back`` is minus its place in ``a``; null if there is none.
    """

    def parts(i: Column) -> Column:
        # All texts of ``a`` that begin at ``i``.
        sizes = F.sequence(F.lit(1), F.length(a) - i + 1)
        return F.transform(sizes, lambda n: F.struct(n.alias("size"), (-i).alias("back"), F.substr(a, i, n).alias("part")))

    every = F.flatten(F.transform(F.sequence(F.lit(1), F.length(a)), parts))
    return F.array_max(F.filter(every, lambda p: F.contains(b, p["part"])))


def sequence_ratio(a: Column, b: Column) -> Column:
    """Twice the characters in matching blocks over those of both texts; 1 for two empty texts.

    The longest shared block is taken first (the first in ``a``, then in ``b``, among equals),
    then the same is done left of it and right of it.  Meant for words: the work grows with
    the square of their length.  From 200 characters on, a common variant that ignores
    frequent characters differs.
    """

    def split(state: Column) -> Column:
        head = F.get(state["open"], F.lit(0))
        rest = F.slice(state["open"], 2, F.greatest(F.size(state["open"]) - 1, F.lit(0)))

        def cut(x: Column) -> Column:
            best, left, right = x["best"], x["a"], x["b"]
            at, in_b = -best["back"], F.instr(right, best["part"])
            pieces = F.array(
                F.struct(F.substr(left, F.lit(1), at - 1).alias("a"), F.substr(right, F.lit(1), in_b - 1).alias("b")),
                F.struct(F.substr(left, at + best["size"]).alias("a"), F.substr(right, in_b + best["size"]).alias("b")),
            )
            more = F.filter(pieces, lambda p: (p["a"] != "") & (p["b"] != ""))
            return F.when(best.isNull(), F.struct(rest.alias("open"), state["same"].alias("same"))).otherwise(
                F.struct(F.concat(more, rest).alias("open"), (state["same"] + best["size"]).alias("same"))
            )

        found = F.struct(_longest_shared(head["a"], head["b"]).alias("best"), head["a"].alias("a"), head["b"].alias("b"))
        return F.when(F.size(state["open"]) == 0, state).otherwise(let(found, cut))

    both = F.struct(a.alias("a"), b.alias("b"))
    start = F.struct(F.filter(F.array(both), lambda p: (p["a"] != "") & (p["b"] != "")).alias("open"), F.lit(0).alias("same"))
    # Every step but the last ones of a branch finds a character, so these are enough.
    steps = F.sequence(F.lit(0), 2 * F.least(F.length(a), F.length(b)))
    same = F.aggregate(steps, start, lambda s, _: split(s), lambda s: s["same"])
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(same * 2.0 / F.greatest(total, F.lit(1)))
