"""The registered queries: each operator over its whole table, with production settings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.llm import (
    bm25, exact_dedup, jaccard, licenses, mixing, packing, quality, repair, token_files, toxicity, url_rules, warc, whitening,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def exact_dedup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    queries = docs.where(F.col("doc_id") % 20 == 0).select(F.col("doc_id").alias("query_id"), "text")
    return bm25.top_k(docs, queries)


def ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def packed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return token_files.read_tokens(manifest)


def url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = url_rules.site_rules(spark, url_rules.SITE_RULES).union(url_rules.token_rules(spark, url_rules.TOKEN_PATTERNS))
    return url_rules.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules)


def weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages")), payloads=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_examples(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damage(table(spark, sf_dir, "conversations")), copies="copies")


def embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components_of(whitening.whiten(table(spark, sf_dir, "embeddings")))


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": mix_sources,
    "op2_exact_dedup": exact_dedup_groups,
    "op3_bm25_search": bm25_search,
    "op4_ngram_join": ngram_join,
    "op5_pu_quality": pu_quality,
    "op6_packed_tokens": packed_tokens,
    "op7_url_rules": url_verdicts,
    "op8_weak_toxicity": weak_toxicity,
    "op9_warc": warc_records,
    "op10_vector_packing": vector_packing,
    "op11_conversation_repair": conversation_repair,
    "op12_embedding_whitening": embedding_whitening,
    "op13_license_scan": license_scan,
    "pipeline": pipeline,
}
