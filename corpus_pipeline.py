"""A corpus from raw documents to token ids, in five stages.

Each stage is written as Parquet to the shared folder and read again as the next one's documents, so a
lost executor costs tasks, never stages that are done.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.llm import blob_ledger, bpe_prefix, circulant, line_rules, mixing
from firnline.llm.texts import table
from firnline.session import stored


#: Words of a shingle of the second stage; the thin query op7 has its own length.
SHINGLE = 5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without their failing lines."""
    return line_rules.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near copies."""
    return circulant.kept_documents(docs, SHINGLE)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    return blob_ledger.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian 32-bit integers) and digests of ids and decoded bytes, one row per copy."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe_prefix.decode(bpe_prefix.encode(docs, path, public_tokenizers.PATTERN), path)
    return coded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality rules", quality), ("MinHash near-dedup", near_duplicates), ("secret scans", secrets),
          ("mixing to target weights", mix), ("byte-level BPE", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.split()[0].lower()}")
    return docs


#: Components of near copies and byte-pair merges are beyond SQL; tests/llm holds a brute-force version.
ORACLE_SQL = None
