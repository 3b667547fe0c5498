"""Sharding by a two-pass external shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.llm.common import free_name, utf8_bytes, written

#: Bytes that a bucket should hold, and so the memory that a shuffling task needs.
BUCKET_BYTES = 16 << 20
#: Buckets up to which their places are broadcast (20 bytes each), and buckets whose counts are summed as one number for the driver.
BROADCAST_BUCKETS, RUN = 200_000, 8192


def _mixed(df: DataFrame, seed: int) -> Column:
    """A seeded hash of all columns that can be hashed; nulls count as a value of their own."""
    own = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType | T.VariantType)]
    quoted = [F.col(f"`{c}`") for c in own]
    return F.xxhash64(F.lit(seed), *quoted, *[c.isNull() for c in quoted])


def _spread_copies(rows: DataFrame, columns: list[str], mixed: str, size: str, most: int, whole: int) -> DataFrame:
    """rows, of which those that are equal in all columns and together over `most` bytes get a hash of their own each, by the copy's number.

    Only hashes are counted to find them. Each input task then counts its copies of a hot row, tasks get ranges of numbers one after
    another, and each range is dealt out where it was counted, so no task handles more copies than an input task has.
    Rows over a BROADCAST_BUCKETS-th of all bytes are that many at most and are broadcast; smaller ones too, if they are few.
    """
    hot = written(rows.groupBy(mixed).agg(F.sum(size).alias("b"), F.count("*").alias("n")).where((F.col("b") > most) & (F.col("n") > 1)).select(mixed, "b"), "hot")
    if hot.isEmpty():
        return rows
    parts = [F.broadcast(hot.select(mixed))] if hot.count() <= BROADCAST_BUCKETS else [F.broadcast(hot.where(F.col("b") > whole / BROADCAST_BUCKETS).select(mixed)), hot.where(F.col("b") <= whole / BROADCAST_BUCKETS).select(mixed)]
    copy, task = free_name(rows, "copy__"), free_name(rows, "task__")
    names = [F.col(f"`{c}`") for c in columns]
    rest, out = rows, None
    for part in parts:
        counted = rows.join(part, mixed, "left_semi").groupBy(*names, size, mixed, F.spark_partition_id().alias(task)).agg(F.count("*").alias(copy))
        counted = written(counted, "copies")  # once, as a task that is run again may get other rows
        before = F.coalesce(F.sum(copy).over(Window.partitionBy(mixed).orderBy(task, *names).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranges = counted.select(*names, size, mixed, task, copy, before.alias(first := free_name(rows, "first__")))
        # ranges are dealt out by hot row and task, not by hot row
        ranges = ranges.repartition(F.col(mixed), F.col(task))
        dealt = ranges.withColumn(copy, F.explode(F.sequence(F.col(first) + 1, F.col(first) + F.col(copy)))).withColumn(mixed, F.xxhash64(mixed, copy)).drop(copy, task, first)
        out = dealt if out is None else out.unionByName(dealt)
        rest = rest.join(part, mixed, "left_anti")
    return rest.select(out.columns).unionByName(out)


def external_shuffle(df: DataFrame, n_shards: int, seed: int = 17, key: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """df with size (UTF-8 bytes of the text, 0 for null, plus 8), shard (0 to n_shards - 1) and slot (from 0, gapless in each shard).

    First pass: seeded hashes of whole rows scatter them to as many buckets as their summed bytes fill at two thirds (a multiple of
    the shuffle partitions, so that tasks hold equally many). Second pass: each bucket is sorted by hash and Fisher-Yates shuffled with
    a generator seeded by the bucket. Buckets follow one another in one global order; the row at place p goes to
    shard p mod n_shards and slot p div n_shards, so counts differ by one at most. The result depends on rows, seed, parameters
    and the number of shuffle partitions only, not on how rows are dealt or retried. Null keys and texts hash like a value of their own. Equal texts spread by
    their key; rows equal in all columns by their number, once their copies exceed an eighth of a bucket (rows with
    map columns, which can't be grouped, excepted). Taken names get leading underscores. An empty table stays empty.
    """
    spark = df.sparkSession
    size, shard, slot = (free_name(df, c) for c in ("size", "shard", "slot"))
    base, mixed, bucket = (free_name(df, c) for c in ("base__", "mixed__", "bucket__"))
    rows = df.withColumns({size: utf8_bytes(text) + 8, mixed: _mixed(df, seed)})
    whole = rows.agg(F.sum(size)).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = parts * max(1, -(-int(whole) * 3 // (2 * bucket_bytes * parts)))
    if not any(isinstance(f.dataType, T.MapType | T.VariantType) for f in df.schema.fields):
        rows = _spread_copies(rows, df.columns, mixed, size, bucket_bytes // 8, int(whole))
    rows = rows.withColumn(bucket, F.pmod(F.col(mixed), F.lit(buckets)).cast("int"))
    # the first place of each bucket: sums of RUN buckets come to the driver, the rest is summed within a run
    counts = written(rows.groupBy(bucket).agg(F.count("*").alias("n")), "counts")
    run = F.floor(F.col(bucket) / RUN)
    starts, at = [], 0
    for r, n in sorted(tuple(x) for x in counts.groupBy(run.alias("r")).agg(F.sum("n").alias("n")).collect()):
        starts.append((r, at))
        at += n
    before = F.coalesce(F.sum("n").over(Window.partitionBy("r").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = counts.withColumn("r", run).withColumn("before", before).join(F.broadcast(spark.createDataFrame(starts, "r long, start long")), "r").select(bucket, (F.col("start") + F.col("before")).alias(base))
    if buckets <= BROADCAST_BUCKETS:
        # tasks get every parts-th bucket, so none gets more than another
        placed = rows.join(F.broadcast(places), bucket).repartitionById(parts, F.col(bucket))
    else:
        placed = rows.join(places, bucket)
    schema = T.StructType([f for f in placed.schema.fields if f.name not in (mixed, base, bucket)] + [T.StructField(shard, T.IntegerType()), T.StructField(slot, T.LongType())])

    def shuffled(group: pa.Table) -> pa.Table:
        order = pc.sort_indices(group, sort_keys=[(mixed, "ascending"), (size, "ascending")]).to_pylist()
        rng = np.random.default_rng([seed, group.column(bucket)[0].as_py()])
        draws = rng.integers(0, np.arange(len(order), 1, -1)).tolist()
        for i, j in zip(range(len(order) - 1, 0, -1), draws, strict=True):  # Fisher-Yates
            order[i], order[j] = order[j], order[i]
        group = group.take(pa.array(order, pa.int64()))
        place = group.column(base)[0].as_py() + np.arange(len(order))
        out = group.drop_columns([mixed, base, bucket])
        return out.append_column(shard, pa.array((place % n_shards).astype(np.int32))).append_column(slot, pa.array(place // n_shards))

    return placed.groupBy(bucket).applyInArrow(shuffled, schema)


def write_shards(shuffled: DataFrame, path: str, shard: str = "shard", slot: str = "slot") -> None:
    """Parquet folders shard=0, shard=1, ...: a file for each task and shard, its rows in the order of their slots. Nothing is shuffled for it.

    An empty table writes no shard; null and repeated rows are rows like others.
    """
    shuffled.sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
