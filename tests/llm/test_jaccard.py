import random
from collections import Counter, defaultdict

import pytest

from tallywise.llm import components, jaccard


def sets_of(text):
    words = (text or "").lower().encode().split()
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(rows):
    """class_id and n_links of each row number, by all pairs that share a shingle."""
    sets = [sets_of(t) for _, t in rows]
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            where[g].append(i)
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    links = Counter()
    for i, s in enumerate(sets):
        for j, k in Counter(j for g in s for j in where[g] if j != i).items():
            if k >= 0.8 * (len(s) + len(sets[j]) - k) - 1e-9:
                links[i] += 1
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return Counter((d, least.get(top(i)) if sets[i] else d, links[i]) for i, (d, _) in enumerate(rows))


def found(df):
    return Counter((r.doc_id, r.class_id, r.n_links) for r in df.collect())


def test_documents(documents, texts):
    assert found(jaccard.near_duplicates(documents)) == brute(sorted(texts.items()))


def test_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert found(jaccard.near_duplicates(odd_docs.withColumnRenamed("source", "node"))) == brute(rows)
    assert jaccard.near_duplicates(no_docs).count() == 0
    kept = jaccard.first_of_groups(odd_docs)
    assert kept.columns == odd_docs.columns
    assert kept.count() == len(rows) - 1
    assert jaccard.first_of_groups(no_docs).count() == 0


def test_large_group_in_blocks(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        words = list(base)
        words[rng.randrange(120)] = f"x{rng.randrange(4)}"
        rows.append((i, " ".join(words)))
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(jaccard.near_duplicates(df)) == brute(rows)
    assert jaccard.first_of_groups(df).count() == 1


def test_pruning_keeps_pairs_at_the_threshold():
    needed = jaccard.least_matches()
    assert len(needed) == jaccard.HASHES // jaccard.STEP
    assert all(0 <= k < 0.8 * n for k, n in zip(needed, range(8, 65, 8), strict=True))
    assert needed == sorted(needed)


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100, k) for k in range(101, 140)]
    root = {x: x for e in edges for x in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: top(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}
