"""Registered queries of the training-data operators, and their DuckDB oracles."""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import (
    bpe,
    decontaminate,
    embedding_dedup,
    language_id,
    periodic_runs,
    prefix_trie,
    quality_classifier,
    quality_rules,
    sharding,
    simhash,
    token_counts,
    toxicity,
    warc,
)
from shelfwise.llm.common import in_fold, read_table

VOCABULARY = "byte_bpe_50k.json"
TOXIC_AT, GOOD_AT = 0.5, 0.3


def vocabulary() -> str:
    return public_tokenizers.path(VOCABULARY)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), vocabulary())


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(read_table(spark, sf_dir, "documents")).drop("rejected_by")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read_table(spark, sf_dir, "documents"), vocabulary())


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive_pages(read_table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.train(docs))
    held_out = in_fold("doc_id", language_id.FOLDS, language_id.HELD_OUT)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def _scored(found: DataFrame, module, at: float, *more: str) -> DataFrame:
    held_out = in_fold("doc_id", module.FOLDS, module.HELD_OUT)
    return found.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= at).cast("int").alias("predicted"), *more
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    return _scored(toxicity.score_documents(docs, model), toxicity, TOXIC_AT, "offending")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = quality_classifier.train(docs, read_table(spark, sf_dir, "labels"))
    return _scored(quality_classifier.score_documents(docs, model), quality_classifier, GOOD_AT)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation c begins with the first turns, crc32(c) % 6 of them, of c - c % 100."""
    conv = F.col("conv")
    head = F.crc32(conv.cast("string")) % 6
    return prefix_trie.prefix_trie(read_table(spark, sf_dir, "conversations"), base=conv - conv % 100, head=head)


def with_planted_run(doc_id: int | None, text: bytes | None) -> list[bytes]:
    """Words of a text; those of about every tenth document repeat a stretch from some word on."""
    words = periodic_runs.split_words(doc_id, text)
    n, h = len(words), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(read_table(spark, sf_dir, "documents"), words_of=with_planted_run)
    return periodic_runs.with_digests(found)


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicate_vectors(read_table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_quality_rules,
        op3_bpe,
        op4_simhash,
        op5_sharding,
        op6_warc,
        op7_language_id,
        op8_decontamination,
        op9_toxicity,
        op10_quality,
        op11_prefix_trie,
        op12_periodic_runs,
        op13_embedding_dedup,
    )
}

ORACLES = {"op2_quality_rules": quality_rules.ORACLE, "op6_warc": warc.ORACLE}
