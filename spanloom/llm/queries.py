"""Registered queries of the text operators; each runs over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, language, licences, linkgraph, neardup, neighbours, packing, quality, sharding, sql, surrogates
from .shared import table


def tokenizer(name: str) -> str:
    """The place of a public tokenizer file on every machine of the cluster."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: A key for queries over test tables, where the session names no secret of its own.
QUERY_KEY = b"spanloom query key"
#: The session's setting for the secret that surrogates are drawn with.
KEY_SETTING = "spanloom.surrogates.key"


def surrogate_key(spark: SparkSession) -> bytes:
    found = spark.conf.get(KEY_SETTING, None)
    return found.encode() if found else QUERY_KEY


def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.pseudonymise(docs, surrogate_key(spark), count="n_replaced")


#: Eight shards: two regions of two racks of two.
TREE = sharding.balanced(2, 2, 2)


def op2_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), TREE)


def op3_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkgraph.judge(table(spark, sf_dir, "pages"))


def op4_segment_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), digests=True)


def op5_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.profile(docs, quality.plan(docs))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))
    return packed_digest(pieces)


def packed_digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.dedupe(table(spark, sf_dir, "documents"))


def op8_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, with ``lang`` as the declared language and ``source`` as the host."""
    docs = table(spark, sf_dir, "documents")
    out = language.identify(docs, keep=["doc_id", "lang", "source"])
    return out.select("doc_id", F.col("lang").alias("declared"), F.col("source").alias("host"), "language", F.round("posterior", 6).alias("posterior"), "kept")


def language_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator over ``pages``, with markup, address suffix and host as evidence."""
    pages = language.page_evidence(table(spark, sf_dir, "pages"))
    out = language.identify(pages, "__plain", "__declared", "__suffix", "__address_host", keep=["page_id", "__declared", "__suffix", "__address_host"])
    return out.select("page_id", F.col("__declared").alias("declared"), F.col("__suffix").alias("suffix"), F.col("__address_host").alias("host"), "language", F.round("posterior", 6).alias("posterior"), "kept")


def op9_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_licence_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = licences.scan(docs, licences.train(docs))
    return found.withColumns({"probability": F.round("probability", 6), "similarity": F.round("similarity", 6)})


def queries() -> dict:
    return {
        "op1_surrogates": op1_surrogates,
        "op2_hash_tree": op2_hash_tree,
        "op3_link_graph": op3_link_graph,
        "op4_segment_tree_bpe": op4_segment_tree_bpe,
        "op5_quality_cascade": op5_quality_cascade,
        "op6_packing": op6_packing,
        "op7_near_duplicates": op7_near_duplicates,
        "op8_language_fusion": op8_language_fusion,
        "op9_adaptive_scan": op9_adaptive_scan,
        "op10_licence_classifier": op10_licence_classifier,
        "language_pages": language_pages,
    }


def oracle_sql() -> dict[str, str]:
    """The others rest on a tokenizer, a fitted model or keyed draws; tests/llm compares them with plain versions."""
    return {
        "op2_hash_tree": sql.shard_sql(TREE),
        "op3_link_graph": sql.link_sql(),
        "op5_quality_cascade": sql.quality_sql(),
        "op7_near_duplicates": sql.neardup_sql(),
    }
