"""Documents to packed training bins: quality, cross-site lines, near duplicates, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm.common import free_name, small_batches, table, written
from fathom.llm.lines import remove_boilerplate
from fathom.llm.minhash import BROADCAST_IDS, near_duplicates
from fathom.llm.packing import pack, token_lengths
from fathom.llm.quality import fit, score_quality


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts: those with a score of 0.5 or more.

    Null, empty and one-byte texts score 0 and go; without a labelled row all other texts score 0.5 and stay. Repeated rows share
    their score.
    """
    model = fit(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "score")
    with small_batches(spark):
        return written(score_quality(docs, model, score=score).where(F.col(score) >= 0.5).select(docs.columns), "accepted")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less boilerplate lines; one that had nothing else goes, as the lines' first places keep them.

    Null and empty texts lose nothing and stay; n_chars is set anew where lines went.
    """
    cleaned = remove_boilerplate(docs)
    removed = F.col(cleaned.columns[-1])  # the operator's last column, whatever name was free
    left = cleaned.where((removed == 0) | (F.trim("text") != ""))
    return left.withColumn("n_chars", F.when(removed > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the least doc_id. Null and wordless texts, and rows without doc_id, are in no group and stay; rows of one doc_id stay or go together."""
    gone = written(near_duplicates(docs, n=5, percent=80).where("not kept").select("doc_id").distinct(), "gone")
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti").select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of 2,048 tokens. Null and empty texts lie in no bin (bin and start null); rows with equal texts never share one."""
    counted = token_lengths(docs.select("doc_id", "source", "text", F.xxhash64("text").alias("cluster")), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return pack(counted, F.col("n_tokens"), F.col("cluster"))


STAGES = [("quality", quality_stage), ("line_dedup", line_stage), ("near_duplicates", near_duplicate_stage), ("packing", packing_stage)]

#: Quality scores, signatures and packing are beyond SQL; tests/llm holds each stage's rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
