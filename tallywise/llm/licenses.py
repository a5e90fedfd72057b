"""License scan: templates with optional and replaceable regions as automata over words.

A template is wording with two kinds of markup:

    [[ ... ]]    optional: the words may be left out, together
    {{n}}        replaceable: any words, n at most, none allowed

Everything else is mandatory and must match word for word.  Each template is compiled to an
automaton whose edges are words; all its states are followed at once, from every place of
the text, so overlapping and nested regions need no backtracking.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

# Phrases whose every place counts, with their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Wording of public licences and notices, with markup.
TEMPLATES = (
    ("mit", "[[this {{3}} is]] [[released]] [[licensed]] [[distributed]] under the [[terms of the]] mit license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
        " documentation files the {{4}} to deal in the {{4}} without restriction including without limitation the rights to"
        " use copy modify merge publish distribute sublicense and or sell copies of the {{4}} and to permit persons to whom"
        " the {{4}} is furnished to do so [[subject to the following conditions the above copyright notice and this"
        " permission notice shall be included in all copies or substantial portions of the {{4}}]]",
    ),
    ("apache-2", "licensed under the apache license version 2 0 [[the license you may not use this file except in compliance with the license]]"),
    ("cc-by-nc", "[[this {{3}} is]] licensed under [[a]] [[the]] cc by nc {{2}}"),
    ("cc-by-nc", "licensed under [[a]] [[the]] creative commons attribution noncommercial [[{{3}} international license]]"),
    ("cc-by-sa", "[[this {{3}} is]] licensed under [[a]] [[the]] cc by sa {{2}}"),
    ("gpl", "[[this {{3}} is]] licensed under the gnu general public license [[version {{1}}]]"),
    (
        "gpl",
        "is free software you can redistribute it and or modify it under the terms of the gnu general public license as"
        " published by the free software foundation",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the"
        " following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of"
        " conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice"
        " this list of conditions and the following disclaimer in the documentation and or other materials provided with the"
        " distribution [[3]] [[neither the name of {{8}} nor the names of its contributors may be used to endorse or promote"
        " products derived from this software without specific prior written permission]]",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"
        " provided that the above copyright notice and this permission notice appear in all copies",
    ),
)


@dataclass
class Automaton:
    """``words[s]`` is the word that leads from state ``s`` to ``s + 1`` (None: any word);
    ``skips[s]`` are the states reached from ``s`` without a word.  The last state accepts."""

    label: str
    words: list[str | None]
    skips: list[list[int]]
    needed: str  # the longest run of mandatory words, which any accepted text holds

    def closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def matches(self, words: list[str]) -> list[tuple[int, int]]:
        """(start, end) of the places accepted, the longest of each start, end exclusive."""
        final = len(self.words)
        begin = self.closure({0})
        firsts = {self.words[s] for s in begin if s < final}
        found = {}
        live: list[tuple[int, set[int]]] = []  # places begun and their states
        for i, word in enumerate([*words, None]):
            if word is not None and (word in firsts or None in firsts):
                live.append((i, set(begin)))
            still = []
            for start, states in live:
                moved = {s + 1 for s in states if s < final and word is not None and self.words[s] in (word, None)}
                moved = self.closure(moved)
                if final in moved:
                    found[start] = i + 1
                if moved - {final}:
                    still.append((start, moved))
            live = still
        return sorted(found.items())


_MARK = re.compile(r"\[\[|\]\]|\{\{[0-9]+\}\}|[^\s\[\]{}]+")


def compile_template(label: str, template: str) -> Automaton:
    words: list[str | None] = []
    skips: list[list[int]] = [[]]
    opened: list[int] = []
    runs: list[list[str]] = [[]]

    def step(word: str | None) -> None:
        words.append(word)
        skips.append([])

    for mark in _MARK.findall(template):
        if mark == "[[":
            opened.append(len(words))
            runs.append([])
        elif mark == "]]":
            skips[opened.pop()].append(len(words))
            runs.append([])
        elif mark.startswith("{{"):
            for _ in range(int(mark[2:-2])):
                skips[len(words)].append(len(words) + 1)
                step(None)
            runs.append([])
        else:
            step(mark)
            if not opened:
                runs[-1].append(mark)
    if opened:
        raise ValueError(f"an optional region of {label} is not closed")
    return Automaton(label, words, skips, " ".join(max(runs, key=len)))


# Letters A-Z become small; bytes that are no part of a word become blanks.
_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def scan(text: str, automata: list[Automaton]) -> dict:
    """All findings in one text."""
    words = text.encode().translate(_TABLE).split()
    line = b" " + b" ".join(words) + b" "
    starts, base = [], set()
    for phrase, label in PHRASES:
        wanted = f" {phrase} ".encode()
        at, seen, word = line.find(wanted), 0, 0
        while at >= 0:
            word += line.count(b" ", seen, at)  # blanks since the last place
            starts.append(word)
            base.add(label)
            at, seen = line.find(wanted, at + 1), at
    found, covered, plain = [], 0, None
    for a in automata:
        if f" {a.needed} ".encode() in line:
            plain = plain or [w.decode() for w in words]
            for s, e in a.matches(plain):
                found.append({"label": a.label, "start": s, "end": e})
                covered = max(covered, e - s)
    labels = base | {f["label"] for f in found}
    return {
        "n_words": len(words),
        "base_starts": sorted(starts),
        "base_labels": ",".join(sorted(base)),
        "labels": ",".join(sorted(labels)),
        "matches": found,
        "score": 1.0 if found else 0.5 if base else 0.0,
    }


RESULT = (
    "n_words long, base_starts array<long>, base_labels string, labels string,"
    " matches array<struct<label:string,start:long,end:long>>, score double"
)


def find(docs: DataFrame, text: str = "text", out: str = "licenses", templates=TEMPLATES) -> DataFrame:
    """``docs`` with ``out``: words, places of the fixed phrases, template matches and labels.

    The score is 1 with a template matched, 0.5 with a fixed phrase alone, else 0.  Null and
    empty texts have no words and no labels.  Rows are independent, repeated rows get equal
    answers, other columns stay, an empty table stays empty.  There is no shuffle.
    """
    small_batches(docs.sparkSession)

    def look(column: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automata = [compile_template(*t) for t in templates]
        names = [part.strip().split(" ")[0] for part in RESULT.split(", ")]
        for texts in column:
            yield pd.DataFrame([scan(t, automata) for t in texts], columns=names)

    return docs.withColumn(out, F.pandas_udf(look, RESULT)(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
