import random

from tallywise.llm import decontaminate as d


def but_one(item, text):
    """Whether a run of the text is the short item but for one word."""
    w, t = d.plain(item).split(), d.plain(text).split()
    runs = (t[i : i + len(w)] for i in range(len(t) - len(w) + 1))
    return len(w) in range(15, 29) and any(sum(a != b for a, b in zip(w, r, strict=True)) <= 1 for r in runs)


def grams(text):
    w = d.plain(text).split()
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def brute(texts, items):
    out = set()
    for k, text in texts:
        own = set(grams(text or ""))
        for i, item in items:
            g = [x in own for x in grams(item)]
            if g and sum(g) / len(g) >= 0.8:
                cut = max(1, round(len(g) * 2 / 3))
                q, a = sum(g[:cut]) / cut, (sum(g[cut:]) / (len(g) - cut) if len(g) > cut else 1)
                if q >= 0.5 and a >= 0.5:
                    out.add((k, i))
            if but_one(item, text or ""):
                out.add((k, i))
    return out


def pairs(df):
    return {(r.doc_id, x.item_id) for r in df.collect() for x in r.leaks}


def test_documents(spark, data, documents, texts, monkeypatch):
    items = spark.read.parquet(f"{data}/benchmark.parquet")
    wanted = brute(texts.items(), [tuple(r) for r in items.select("item_id", "text").collect()])
    assert wanted and pairs(d.find(documents, items)) == wanted
    kept = {r.doc_id for r in d.clean(documents, items).collect()}
    assert kept == set(texts) - {k for k, _ in wanted}
    monkeypatch.setattr(d, "INDEX_BYTES", 2000)
    assert pairs(d.find(documents, items)) == wanted


def test_items_at_every_place_and_changed(spark):
    item = " ".join(f"term{i}" for i in range(50))
    rows = [(k, " ".join([f"pad{j}" for j in range(k)] + [item] + ["end"] * 40)) for k in range(0, 70, 7)]
    changed = item.replace("term20", "other")
    half = " ".join(item.split()[:30])
    rows += [(200, f"before {changed} after"), (201, half), (202, " ".join(reversed(item.split()))), (203, item.upper().replace(" ", ", "))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, item), (2, "too short"), (3, None), (None, item)], "item_id long, text string")
    found = pairs(d.find(docs, items))
    assert found == brute(rows, [(1, item)]) and (203, 1) in found and (201, 1) not in found


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog")] * 2, "item_id long, text string")
    found = d.find(odd_docs.withColumnRenamed("source", "leaks"), items)
    assert sum(len(r.leaks) for r in found.collect()) == 2
    assert d.clean(odd_docs, items).count() == odd_docs.count() - 2
    assert d.clean(odd_docs, items.limit(0)).count() == odd_docs.count()
    assert d.find(no_docs, items).count() == 0


def test_changed_edges_and_scores_with_one_and_many_indexes(spark, monkeypatch):
    rng = random.Random(3)
    common = [f"common{i}" for i in range(13)]
    items = [(1, " ".join(["first", *common, "last"]))]
    items += [(i, " ".join([f"own{i}", *rng.sample(common, 13), f"mine{i}"])) for i in range(2, 300)]
    changed = [(k, " ".join(["pad"] * k + ["other", *t.split()[1:-1], "another"] + ["end"] * 9)) for k, t in items[:40]]
    words = items[50][1].split()
    grams_apart = " ".join(" ".join(["gap", *words[i : i + 5]] + [f"x{j}" for j in range(70)]) for i in range(len(words) - 4))
    rows = [*changed, (400, grams_apart), (401, items[60][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    wanted = brute(rows, items)
    assert {(k, k) for k, _ in changed} | {(400, 51), (401, 61)} <= wanted

    def scored():
        return sorted((r.doc_id, x.item_id, x.score, x.question, x.answer) for r in d.find(docs, table).collect() for x in r.leaks)

    one = scored()
    assert {r[:2] for r in one} == wanted and min(r[2] for r in one) < 0.6
    monkeypatch.setattr(d, "INDEX_BYTES", 9000)
    assert scored() == one


def test_clean_drops_what_holds_an_item_without_an_id(spark):
    item = " ".join(f"term{i}" for i in range(20))
    docs = spark.createDataFrame([(1, f"so {item} it ends"), (2, "nothing of the kind stands in here")], "doc_id long, text string")
    items = spark.createDataFrame([(None, item), (0, "some other item of seven words here")], "item_id long, text string")
    assert [r.doc_id for r in d.clean(docs, items).collect()] == [2]
    assert pairs(d.find(docs, items)) == set()


def random_items(rng, many):
    names = [f"w{i}" for i in range(60)]
    return [(i, " ".join(rng.choices(names, k=rng.choice([5, 9, 15, 20, 28, 29, 45, 120])))) for i in range(many)]


def test_short_items_with_one_word_changed_anywhere(spark):
    rng = random.Random(5)
    items = [(m, " ".join(f"t{m}x{i}" for i in range(m))) for m in range(12, 31)]
    rows = []
    for m, text in items:
        for p in range(m):
            w = text.split()
            w[p] = "changed"
            rows.append((100 * m + p, " ".join(["pad"] * rng.randrange(80) + w + ["end"] * rng.randrange(80))))
        w = text.split()
        w[m // 2] = w[m // 3] = "changed"
        rows.append((100 * m + 99, " ".join(w)))
    wanted = brute(rows, items)
    assert {(100 * m + p, m) for m in range(15, 29) for p in range(m)} <= wanted
    found = pairs(d.find(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert found == wanted


def test_retrieval_is_a_full_scan_and_decides(spark, monkeypatch):
    rng = random.Random(11)
    items = random_items(rng, 120)
    shared = "a phrase that stands in many items"
    items = [(i, f"{shared} {t}" if i % 3 else t) for i, t in items]
    rows = [(-1, shared), (-2, None), (-3, "")]
    for k in range(200):
        w = rng.choice(items)[1].split()
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(60)}"
        cut = rng.randrange(len(w) + 1)
        rows.append((k, " ".join([*w[:cut], *["gap"] * rng.choice([0, 0, 3, 90]), *w[max(0, cut - 4) :], rng.choice(items)[1]])))
    index = d.build(items)
    for block in (1, 3, 16):
        monkeypatch.setattr(d, "BLOCK", block)
        for _ in range(300):
            terms = sorted(rng.sample(range(len(index.terms)), rng.randrange(1, 60)))
            full = {}
            for t in terms:
                for p in range(index.first[t], index.first[t + 1]):
                    full[int(index.item[p])] = full.get(int(index.item[p]), 0.0) + float(index.weight[p])
            assert set(d.retrieve(index, terms)) == {i for i, x in full.items() if x >= 1 - d.SLACK}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    wanted = brute(rows, items)
    assert len(wanted) > 100 and pairs(d.find(docs, table)) == wanted
    texts = [t for _, t in rows]
    assert {(rows[k][0], x["item_id"]) for k, found in enumerate(d.leaks(index, texts)) for x in found} == wanted
    monkeypatch.setattr(d, "retrieve", lambda *_: {})
    assert not any(d.leaks(index, texts))


def test_long_texts_of_one_word_and_of_an_item(spark):
    item = " ".join(f"term{i}" for i in range(20))
    rows = [(1, "same " * 200_000), (2, f"{item} " * 10_000), (3, " ".join(f"n{i}" for i in range(100_000)) + " " + item)]
    items = spark.createDataFrame([(1, item), (2, "same " * 20)], "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert pairs(d.find(docs, items)) == {(1, 2), (2, 1), (3, 1)}
