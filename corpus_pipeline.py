"""The text pipeline: five operators one after another, from ``documents`` to token ids.

Each stage is written as Parquet below the shared folder and read again as the next one's
input.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywise.llm import bpe, common, decontaminate, jaccard, language, pii

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts in no language (null, or without a letter); the others without a language get the predicted one.

    A given language stays, and no prediction or score rejects a text.  With no labelled row to
    learn from the same texts go and languages stay null.  Repeated rows get equal answers; an
    empty table stays empty; columns beyond those of ``documents`` go.
    """
    found = language.identify(docs, language.fit(docs), unfitted=language.UNLABELLED)
    guess = F.when(F.col("lang_pred") != language.UNLABELLED, F.col("lang_pred"))
    return found.where(F.col("lang_pred") != language.UNKNOWN).withColumn("lang", F.coalesce("lang", guess)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of texts that share four fifths of their word shingles."""
    return jaccard.first_of_groups(docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item's question and answer."""
    items = common.table(spark, sf_dir, "benchmark")
    return decontaminate.clean(docs, items).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind."""
    made = pii.redact(docs, pii.fit(docs))
    return made.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode, decode again and return digests of both."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = bpe.encode(docs.select("doc_id", "lang", "source", "text"), path).drop("text")
    return bpe.decode(ids, path).select(
        "doc_id",
        "lang",
        "source",
        F.expr("octet_length(token_ids) div 4").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("token_ids", token_ids),
]

#: The stages train models and search by hashes, which SQL cannot express; tests/llm holds
#: the plain version that the result is compared with.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
