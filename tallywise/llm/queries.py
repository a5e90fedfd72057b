"""The registered queries of this subpackage: one thin query for each operator."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, jaccard, language, licenses, lmscore, pii, prefixtrie, repair, sql, substrings, tokenfiles, topk, toxicity
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {"op11_prefixtrie": sql.PREFIXTRIE, "op13_repair": sql.REPAIR}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    net = language.fit(docs.where(third != 1))
    held_out = F.coalesce(third == 1, F.lit(False))
    return language.identify(docs.select("doc_id", "text"), net).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score"
    )


@query
def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.near_duplicates(docs).select("doc_id", "class_id", "n_links")


@query
def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = table(spark, sf_dir, "embeddings").where(x.isNotNull() & finite)
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * 1024).cast("long"))
    return topk.search(rows.select("vec_id", whole.alias("vector")), F.col("vec_id") % 100 == 0)


@query
def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    texts = substrings.dedupe_texts(docs).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
    return substrings.by_document(docs, texts).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return bpe.decode(docs.select("doc_id", "token_ids"), path).select(
        "doc_id",
        F.expr("octet_length(token_ids) div 4").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op6_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    return lmscore.score(docs, good)


@query
def op7_tokenfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = tokenfiles.new_folder(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = tokenfiles.write(docs, folder, public_tokenizers.path("byte_bpe_50k.json"))
    return tokenfiles.read(tokenfiles.with_starts(index), folder).select(
        "doc_id", "start", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


@query
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.fit(docs)).select("doc_id", "pii")
    base = F.filter("pii", lambda s: s.base)

    def count(kind: str):
        return F.size(F.filter(base, lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    return found.select(
        "doc_id",
        *(count(k) for k in ("email", "ip", "card", "phone")),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("pii")).alias("spans"),
    )


@query
def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    starts = F.col("licenses.base_starts")
    return licenses.find(docs).select(
        "doc_id",
        "licenses.n_words",
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        "licenses.base_labels",
        "licenses.labels",
        "licenses.score",
    )


@query
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


@query
def op11_prefixtrie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, ids = prefixtrie.with_shared_heads(prefixtrie.numbered(table(spark, sf_dir, "conversations")))
    return prefixtrie.trie(turns, ids).drop("node", "parent")


@query
def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    fifth = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs.where(fifth != 0), table(spark, sf_dir, "labels").where(fifth != 0))
    held_out = F.coalesce(fifth == 0, F.lit(False))
    return toxicity.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query
def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repair.repair(conversations, repair.damaged(conversations))
