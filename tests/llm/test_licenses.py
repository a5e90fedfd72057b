import re

import pytest

from tallywise.llm import licenses, queries


def plain(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    starts, labels = [], set()
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_documents(spark, data, texts):
    rows = queries.QUERIES["op9_licenses"](spark, data).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))


def test_notices(spark):
    rows = [
        (1, "This work is licensed under the GNU General Public License, version 3."),
        (2, "Released under the MIT License."),
        (3, "Licensed under the Apache License, Version 2.0."),
        (4, "Licensed under CC BY-NC 4.0."),
        (5, "no license at all"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.licenses.labels, r.licenses.score) for r in licenses.find(df).collect()}
    assert got == {1: ("gpl", 1.0), 2: ("mit", 1.0), 3: ("apache-2", 1.0), 4: ("cc-by-nc", 1.0), 5: ("", 0.0)}


@pytest.mark.parametrize(
    ("template", "text", "spans"),
    [
        ("a [[b c]] d", "a d x a b c d a b d", [(0, 2), (3, 7)]),
        ("a {{2}} d", "a d a x d a x y d a x y z d", [(0, 2), (2, 5), (5, 9)]),
        ("a [[b {{1}} c]] d", "a b c d a b q c d a b q q c d", [(0, 4), (4, 9)]),
        ("a [[b [[c]] d]] e", "a e a b d e a b c d e a c e", [(0, 2), (2, 6), (6, 11)]),
    ],
)
def test_regions(template, text, spans):
    found = licenses.compile_template("x", template).matches(text.split())
    wanted = {}
    for s, e in spans:
        wanted[s] = max(e, wanted.get(s, 0))
    assert dict(found) == wanted


def test_templates_hold_their_own_wording():
    for label, template in licenses.TEMPLATES:
        bare = re.sub(r"\[\[|\]\]", " ", re.sub(r"\{\{[0-9]+\}\}", " ", template))
        assert label in licenses.scan(bare, [licenses.compile_template(label, template)])["labels"].split(",")
    with pytest.raises(ValueError):
        licenses.compile_template("x", "a [[ b")


def test_odd_rows(odd_docs, no_docs):
    for r in licenses.find(odd_docs.withColumnRenamed("source", "licenses")).collect():
        assert (r.licenses.n_words, len(r.licenses.base_starts)) == plain(r.text)[:2]
        assert 0 <= r.licenses.score <= 1
    assert licenses.find(no_docs).count() == 0
