"""Reading and writing: Parquet tables by name, texts, JSON lines, ORC, CSV, binary files; append-only stores with tombstones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Chunks of a corpus as JSON lines.
CHUNK_SCHEMA = "id string, doc_id string, title string, chunk_idx int, text string, word_count int, start_word int, end_word int, topic_hint string, source_dataset string"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def chunks_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Corpus chunks; lines that don't parse are left out, missing fields are null."""
    return spark.read.schema(CHUNK_SCHEMA).option("mode", "DROPMALFORMED").json(path)


def text_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, text, modified) of whole files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.decode("content", "UTF-8").alias("text"), F.col("modificationTime").alias("modified"))


def read(spark: SparkSession, path: str, kind: str, schema: str | None = None) -> DataFrame:
    if kind not in ("parquet", "orc", "csv", "json", "text"):
        raise ValueError(f"no reader for {kind}")
    reader = spark.read.option("header", "true") if kind == "csv" else spark.read
    return (reader.schema(schema) if schema else reader).format(kind).load(path)


def append(df: DataFrame, path: str, partition: list[str] | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


class MemoryStore:
    """Memories, tombstones and audit as append-only Parquet tables under one folder; a read joins what was written."""

    MEMORY = "id long, content string, embedding array<float>, importance double, created_at timestamp, session_id string, source_type string, content_hash string"
    TOMBSTONE = "id long, deleted_at timestamp, reason string"
    AUDIT = "target_id long, operation string, operator string, parameters string, ts timestamp, day date"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        """A table of the store, empty where nothing was written yet; reading writes nothing."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def store(self, df: DataFrame, operator: str = "system") -> None:
        """Appends memories (content, importance, ids and times given) with their content's hash, and an audit row each."""
        rows = df.withColumn("content_hash", F.sha2("content", 256))
        fields = [f.split() for f in self.MEMORY.split(", ")]
        rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c) for c, kind in fields]).write.mode("append").parquet(f"{self.root}/memories")
        self.audit(rows.select(F.col("id").alias("target_id"), F.col("created_at").alias("ts")), "store", operator)

    def audit(self, targets: DataFrame, operation: str, operator: str) -> None:
        rows = targets.select("target_id", F.lit(operation).alias("operation"), F.lit(operator).alias("operator"), F.lit("{}").alias("parameters"), "ts", F.to_date("ts").alias("day"))
        rows.write.mode("append").partitionBy("day").parquet(f"{self.root}/audit")

    def forget(self, ids: DataFrame, at: str, reason: str = "") -> None:
        """Soft delete: a tombstone for each id."""
        rows = ids.select("id", F.to_timestamp(F.lit(at)).alias("deleted_at"), F.lit(reason).alias("reason"))
        rows.write.mode("append").parquet(f"{self.root}/tombstones")

    def memories(self) -> DataFrame:
        """The latest version of each memory that isn't deleted."""
        rows = self._read("memories", self.MEMORY)
        last = rows.groupBy("id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "id"]), "created_at").alias("r")).select("id", "r.*")
        return last.join(self._read("tombstones", self.TOMBSTONE).select("id").distinct(), "id", "left_anti")

    def trail(self, target: int | None = None, start: str | None = None, end: str | None = None, limit: int = 50) -> DataFrame:
        """Audit rows, newest first; a time range prunes days."""
        rows = self._read("audit", self.AUDIT)
        if target is not None:
            rows = rows.where(F.col("target_id") == target)
        if start is not None:
            rows = rows.where((F.col("ts") >= F.to_timestamp(F.lit(start))) & (F.col("day") >= F.to_date(F.lit(start[:10]))))
        if end is not None:
            rows = rows.where((F.col("ts") < F.to_timestamp(F.lit(end))) & (F.col("day") <= F.to_date(F.lit(end[:10]))))
        return rows.orderBy(F.desc("ts"), "target_id").limit(limit)

    def checkpoint(self, path: str) -> None:
        """A copy of all tables as they are now: memories at their latest version, tombstones and audit."""
        self.memories().write.parquet(f"{path}/memories")
        self._read("tombstones", self.TOMBSTONE).write.parquet(f"{path}/tombstones")
        self._read("audit", self.AUDIT).write.partitionBy("day").parquet(f"{path}/audit")

    def restore(self, path: str) -> MemoryStore:
        """A store over a checkpoint's copy, at this store's root, which must be empty."""
        if not self._read("memories", self.MEMORY).isEmpty():
            raise ValueError("restore into an empty store")
        for name, schema, days in (("memories", self.MEMORY, False), ("tombstones", self.TOMBSTONE, False), ("audit", self.AUDIT, True)):
            rows = self.spark.read.schema(schema).parquet(f"{path}/{name}")
            (rows.write.mode("append").partitionBy("day") if days else rows.write.mode("append")).parquet(f"{self.root}/{name}")
        return self

    def compact(self, path: str) -> MemoryStore:
        """A new store with the latest version of each live memory and no tombstones; audit goes along."""
        new = MemoryStore(self.spark, path)
        self.memories().write.parquet(f"{new.root}/memories")
        self._read("audit", self.AUDIT).write.partitionBy("day").parquet(f"{new.root}/audit")
        return new


class EdgeStore:
    """Edges (a, b, kind, weight) as an append-only table; the last row of an edge counts, and a null weight deletes it."""

    EDGE = "a long, b long, kind string, weight double, at timestamp"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def put(self, edges: DataFrame) -> None:
        """Appends a batch of edges with their times."""
        edges.selectExpr("a", "b", "kind", "cast(weight as double) as weight", "at").write.mode("append").parquet(f"{self.root}/edges")

    def delete(self, edges: DataFrame) -> None:
        """Appends deletions (a, b, kind, at)."""
        self.put(edges.withColumn("weight", F.lit(None).cast("double")))

    def edges(self) -> DataFrame:
        rows = MemoryStore._read(self, "edges", self.EDGE)
        return rows.groupBy("a", "b", "kind").agg(F.max_by(F.struct("weight"), "at").alias("w")).select("a", "b", "kind", F.col("w.weight").alias("weight")).where("weight is not null")

    def outgoing(self, node: int) -> DataFrame:
        return self.edges().where(F.col("a") == node)

    def incoming(self, node: int) -> DataFrame:
        return self.edges().where(F.col("b") == node)

    def of_kind(self, kind: str) -> DataFrame:
        return self.edges().where(F.col("kind") == kind)
