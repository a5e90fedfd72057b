import hashlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from tallywise.llm import bpe, language, pii

from .test_decontaminate import brute as leaked
from .test_jaccard import sets_of


def test_run_is_the_plain_version(spark, data, documents):
    rows = documents.collect()
    net, kept = language.fit(documents), []
    for r in rows:
        if r.text is not None and any(map(str.isalpha, r.text)):
            kept.append(r)
    assert net is not None
    # One of each group of near duplicates, by comparing all pairs that share a shingle.
    sets = {r.doc_id: sets_of(r.text) for r in kept}
    where = {}
    root = {d: d for d in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for d, s in sorted(sets.items()):
        seen = {}
        for g in s:
            for e in where.setdefault(g, []):
                seen[e] = seen.get(e, 0) + 1
            where[g].append(d)
        for e, k in seen.items():
            if k >= 0.8 * (len(s) + len(sets[e]) - k) - 1e-9:
                a, b = top(d), top(e)
                root[max(a, b)] = min(a, b)
    kept = [r for r in kept if top(r.doc_id) == r.doc_id]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    gone = {k for k, _ in leaked([(r.doc_id, r.text) for r in kept], items)}
    kept = [r for r in kept if r.doc_id not in gone]
    # Only the fitted model is shared with the stage; its base spans are tested by themselves.
    left = spark.createDataFrame([(r.doc_id, r.text) for r in kept], "doc_id long, text string")
    model = pii.fit(left)
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    wanted = set()
    for r in kept:
        text = pii.redacted(r.text, pii.spans_of([r.text], model)[0])
        ids = np.array(plain.encode_ordinary(text), "<u4").tobytes()
        wanted.add((r.doc_id, r.lang, r.source, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert {tuple(r) for r in corpus_pipeline.run(spark, data).collect()} == wanted


def test_stages(spark, odd_docs, no_docs, data):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "personal_data", "token_ids"]
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            made = stage(spark, docs, data)
            if name != "token_ids":
                assert made.dtypes == docs.dtypes
            assert made.count() <= docs.count()


def test_no_labels_lose_no_text(spark, odd_docs):
    bare = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.language_id(spark, bare, "")
    wanted = [r.text for r in odd_docs.collect() if r.text is not None and any(map(str.isalpha, r.text))]
    assert sorted(r.text for r in kept.collect()) == sorted(wanted)
    assert {r.lang_pred for r in language.identify(bare, None, unfitted="unlabelled").collect()} == {"und", "unlabelled"}


def test_the_prediction_names_the_language_where_none_is_given(spark, documents):
    given = {r.doc_id: r.lang for r in documents.collect()}
    hidden = documents.withColumn("lang", F.when(F.col("doc_id") % 3 != 0, F.col("lang")))
    made = {r.doc_id: r.lang for r in corpus_pipeline.language_id(spark, hidden, "").collect()}
    assert all(made[d] == given[d] for d in made if d % 3)
    asked = [d for d in made if d % 3 == 0]
    assert len({made[d] for d in asked}) > 2
    assert sum(made[d] == given[d] for d in asked) >= 0.95 * len(asked)
