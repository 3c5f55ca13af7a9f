"""The queries of this subpackage by name, and their DuckDB texts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.llm import bit_packing, bit_sliced, blob_ledger, bpe_prefix, circulant, cross_entropy, digest_cache, filter_audit, line_rules, mixing, \
    periodic_runs, suffix_dedup, wrappers
from firnline.llm.texts import table


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.judge(table(spark, sf_dir, "documents")).drop("text")


def op3_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats_removed(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("starts").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"), "n_passage_words")


def op4_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blob_ledger.counts(table(spark, sf_dir, "documents"))


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what bpe_prefix.decode returns."""
    return encoded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents")
    return digests(bpe_prefix.decode(bpe_prefix.encode(docs, path, public_tokenizers.PATTERN), path))


def op6_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0")
    return cross_entropy.score_words(table(spark, sf_dir, "documents"), good.select("doc_id"))


def op7_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return circulant.near_groups(table(spark, sf_dir, "documents"))


def op8_bit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op9_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_texts(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op10_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return bit_sliced.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_digest_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_cache.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), plant=True)


QUERIES = {
    "op1_pareto_mix": op1_pareto_mix,
    "op2_line_rules": op2_line_rules,
    "op3_suffix_array": op3_suffix_array,
    "op4_blob_ledger": op4_blob_ledger,
    "op5_prefix_bpe": op5_prefix_bpe,
    "op6_cross_entropy": op6_cross_entropy,
    "op7_circulant_minhash": op7_circulant_minhash,
    "op8_bit_packing": op8_bit_packing,
    "op9_wrappers": op9_wrappers,
    "op10_bit_sliced_top_k": op10_bit_sliced_top_k,
    "op11_filter_audit": op11_filter_audit,
    "op12_digest_cache": op12_digest_cache,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE = {
    "op1_pareto_mix": mixing.oracle(),
    "op2_line_rules": line_rules.oracle(),
    "op4_blob_ledger": blob_ledger.oracle(),
    "op10_bit_sliced_top_k": bit_sliced.oracle(),
    "op11_filter_audit": filter_audit.oracle(),
}
