"""From raw documents to packed training sequences, in stages that each apply one operator to all rows.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows as Parquet
and hands what it rereads to the next. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import language, neardup, packing, quality, surrogates
from spanloom.llm.queries import packed_digest, surrogate_key, tokenizer
from spanloom.llm.shared import free, scratch, stash, table

#: Rows of an Arrow batch: documents are long, and a batch is held by the executor and by its Python worker.
BATCH_ROWS = 1000
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """A stage's rows are computed when they are written, after its function has returned, so the setting stays; ``run`` puts the session's own back."""
    spark.conf.set(BATCH_SETTING, BATCH_ROWS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects, the rules ordered by what they reject for their cost."""
    small_batches(spark)
    return quality.judge(docs, quality.plan(docs))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is certain enough, ``lang`` set to it."""
    small_batches(spark)
    return language.keep_identified(docs, declared="lang", host="source", write_to="lang")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of least id."""
    small_batches(spark)
    return neardup.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by surrogates."""
    small_batches(spark)
    return surrogates.pseudonymise(docs, surrogate_key(spark))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of mixed sources."""
    small_batches(spark)
    return packed_digest(packing.pack(docs, tokenizer("word_bpe_49k.json")))


STAGES = [
    ("quality", quality_rules),
    ("language", language_id),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", pack),
]

#: The surrogates, trigram posteriors and tokens have no SQL; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage writes on its way is freed with it, and its rows once the next has read them."""
    docs, before, own = table(spark, sf_dir, "documents"), None, spark.conf.get(BATCH_SETTING)
    try:
        for name, stage in STAGES:
            with scratch():
                made = stash(stage(spark, docs, sf_dir), name, keep=True)
            if before is not None:
                free(before)
            docs = before = made
        return docs
    finally:
        spark.conf.set(BATCH_SETTING, own)
