"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

NAMES = (
    "knn_cosine", "knn_batch", "knn_graph", "pairwise_similarity", "maxsim_rerank", "bm25_search", "weighted_jaccard", "weighted_rrf", "semantic_fusion", "pipeline_three_stage",
    "recency_multiscale", "temporal_boost", "session_windows", "conversation_window", "causal_gate", "typed_edges", "bfs_depth", "graph_expansion", "silhouette", "cluster_features",
    "topic_agreement", "merge_union", "consolidation_similarity", "hash_chain", "content_hash_dedup", "chunk_words", "extract_keywords", "ndcg_at_k", "nt_modulated_weight", "int8_quantize",
)


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from fathom.plans.catalog import QUERIES

    spark.read.parquet(f"{folder}/documents.parquet").count()  # the first job starts the engine
    took = {}
    for name in NAMES:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": folder.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
