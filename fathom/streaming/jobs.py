"""Structured Streaming upkeep of derived tables: upserts by content hash, windows, sessions, churn state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def changed_files(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """File events whose content is new within the delay: (path, text, hash, ts)."""
    hashed = stream.withColumn("hash", F.sha2("text", 256))
    return hashed.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["path", "hash"])


def upsert(stream: DataFrame, path: str, checkpoint: str, key: str = "id") -> StreamingQuery:
    """Micro-batches appended under their batch number, so a repeated batch replaces itself; read back by latest()."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("version", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, value) by tumbling or sliding windows; rows later than `late` are dropped by the watermark."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n) of sessions that a gap ends."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def churn(snapshots: DataFrame) -> DataFrame:
    """(scope, ts, churn) from (scope, ts, topics): share of topics that came or went since the scope's snapshot before, kept as state for a day."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = set(state.get[0]) if state.exists else None
        out = []
        for row in pd.concat(batches).sort_values("ts").itertuples():
            now = set(row.topics)
            if before is not None:
                out.append((key[0], row.ts, len(now ^ before) / len(now | before) if now | before else 0.0))
            before = now
        state.update((sorted(before or ()),))
        state.setTimeoutDuration(24 * 3600 * 1000)
        yield pd.DataFrame(out, columns=["scope", "ts", "churn"])

    return snapshots.groupBy("scope").applyInPandasWithState(step, "scope string, ts timestamp, churn double", "topics array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def running_features(vectors: DataFrame, by: str = "label", vector: str = "embedding") -> DataFrame:
    """Count and sums of each dimension, kept up over a stream: the mergeable part of a clustering feature."""
    parts = vectors.select(by, F.posexplode(F.col(vector).cast("array<double>")).alias("pos", "x"))
    return parts.groupBy(by, "pos").agg(F.count("*").alias("n"), F.sum("x").alias("ls"), F.sum(F.col("x") * F.col("x")).alias("ss"))


def maintain(stream: DataFrame, checkpoint: str, work, every: str | None = None) -> StreamingQuery:
    """Calls work(batch, number) on each micro-batch: index upkeep, edge building, garbage collection. every: a period such as "60 seconds"; without it, what is there is worked off once."""
    writer = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def _kept(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder's rows; none where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


class _Upkeep:
    """Batches are counted in the folder, not in the driver: what waited before a restart still waits after it, and a batch that is repeated replaces itself."""

    def __init__(self, path: str, least: int):
        self.path, self.least = path, least

    def _waiting(self, spark: SparkSession, number: int, rows: int) -> int | None:
        """Notes a batch's rows and gives the last batch that was worked off before it, or -1; None while too few rows wait."""
        spark.createDataFrame([(rows,)], "n long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/counts/batch={number}")
        done = _kept(spark, f"{self.path}/done", "n long, batch long").where(F.col("batch") < number).agg(F.max("batch")).first()[0]
        done = -1 if done is None else done
        held = _kept(spark, f"{self.path}/counts", "n long, batch long").where((F.col("batch") > done) & (F.col("batch") <= number)).agg(F.sum("n")).first()[0] or 0
        return done if held >= self.least else None

    def _done(self, spark: SparkSession, number: int) -> None:
        spark.createDataFrame([(1,)], "n long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/done/batch={number}")


class EdgeBuilder(_Upkeep):
    """Batches of new memories, kept until there are `least` of them, then linked to the nearest of all memories; for maintain()."""

    def __init__(self, memories, build, path: str, least: int = 10):
        """memories() gives all memories so far; build(new, all) gives edges (a, b, ...); edges are written under their batch's number."""
        super().__init__(path, least)
        self.memories, self.build = memories, build

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark, schema = batch.sparkSession, batch.schema
        batch.write.mode("overwrite").parquet(f"{self.path}/new/batch={number}")
        new = spark.read.schema(schema).parquet(f"{self.path}/new/batch={number}")
        done = self._waiting(spark, number, new.count())
        if done is not None:
            every = spark.read.schema(f"{schema.toDDL()}, batch long").parquet(f"{self.path}/new")
            waited = every.where((F.col("batch") > done) & (F.col("batch") <= number)).drop("batch")
            self.build(waited, self.memories()).write.mode("overwrite").parquet(f"{self.path}/edges/batch={number}")
            self._done(spark, number)


class Reclusterer(_Upkeep):
    """Counts memories by micro-batch and clusters anew after every `every` of them; for maintain()."""

    def __init__(self, cluster, path: str, every: int = 100):
        super().__init__(path, every)
        self.cluster = cluster

    def __call__(self, batch: DataFrame, number: int) -> None:
        if self._waiting(batch.sparkSession, number, batch.count()) is not None:
            self.cluster().write.mode("overwrite").parquet(f"{self.path}/clusters/batch={number}")
            self._done(batch.sparkSession, number)


class CodeWatcher:
    """Chunks of files kept up to date, for maintain() over rows (path, text): a file whose content is new replaces its chunks, a null text takes them away.

    Each batch writes its chunks, and the paths it settled, under its number; a repeated batch replaces itself. chunks() reads a path's last batch.
    """

    def __init__(self, path: str):
        self.path = path

    def __call__(self, batch: DataFrame, number: int) -> None:
        from fathom.operators.code import code_chunks

        hashed = batch.groupBy("path").agg(F.max_by("text", "ts").alias("text")).select("path", "text", F.sha2("text", 256).alias("hash"))
        known = self.files(batch.sparkSession, number).select("path", F.col("hash").alias("had"))
        new = hashed.join(known, "path", "left").where(~F.col("hash").eqNullSafe(F.col("had"))).drop("had")
        new.write.mode("overwrite").parquet(f"{self.path}/files/batch={number}")
        own = batch.sparkSession.read.schema(new.schema).parquet(f"{self.path}/files/batch={number}").withColumn("id", F.xxhash64("path"))
        cut = code_chunks(own, "id", "text").join(own, "id")
        cut.select("path", "chunk", "kind", "name", "parent", "signature", F.expr("substring(text, start + 1, stop - start)").alias("code"), "first_line", "last_line").write.mode("overwrite").parquet(f"{self.path}/chunks/batch={number}")

    def files(self, spark: SparkSession, before: int = 1 << 62) -> DataFrame:
        """(path, hash, batch) of each path's last batch before a number."""
        rows = _kept(spark, f"{self.path}/files", "path string, text string, hash string, batch long").where(F.col("batch") < before)
        return rows.groupBy("path").agg(F.max_by("hash", "batch").alias("hash"), F.max("batch").alias("batch"))

    def chunks(self, spark: SparkSession) -> DataFrame:
        rows = _kept(spark, f"{self.path}/chunks", "path string, chunk int, kind string, name string, parent string, signature string, code string, first_line int, last_line int, batch long")
        return rows.join(self.files(spark).select("path", "batch"), ["path", "batch"])
