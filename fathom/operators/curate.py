"""Merging, consolidation, deletion, importance, audit and provenance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions import dense


def merged_vectors(df: DataFrame, by: str, vector: str, how: str = "union", weight: Column | None = None, floor: float = 0.01) -> DataFrame:
    """(by, pos, value) of each group's merged vector, before normalisation.

    union: mean of each dimension. intersection: that mean where every member has |x| >= floor, else 0. weighted: mean by weight.
    """
    rows = df.select(by, (weight if weight is not None else F.lit(1.0)).alias("w"), F.posexplode(dense.vec(vector)).alias("pos", "x"))
    mean = {"union": F.avg("x"), "intersection": F.when(F.min(F.abs("x")) >= floor, F.avg("x")).otherwise(0.0), "weighted": F.sum(F.col("w") * F.col("x")) / F.sum("w")}[how]
    return rows.groupBy(by, "pos").agg(mean.alias("value"))


def merged_sparse(post: DataFrame, by: str, how: str = "union") -> DataFrame:
    """(by, term, weight) from (by, id, term, tf): union divides sums by the group's size, intersection keeps terms that all have."""
    sizes = post.groupBy(by).agg(F.count_distinct("id").alias("n"))
    each = post.groupBy(by, "term").agg(F.sum("tf").alias("s"), F.count_distinct("id").alias("have")).join(sizes, by)
    kept = each.where("have = n") if how == "intersection" else each
    return kept.select(by, "term", (F.col("s") / F.col("n")).alias("weight"))


def close_in_time(df: DataFrame, key: str, ts: str, by: list[str], hours: float = 24.0) -> DataFrame:
    """(a, b, seconds): pairs of one group less than so many hours apart. Rows meet in their own bucket of that width and the one before, never all with all."""
    width = hours * 3600
    rows = df.select(*by, F.col(key).alias("id"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"))
    bucket = F.floor(F.col("t") / (width * 1e6))
    x = rows.select(*by, F.col("id").alias("a"), F.col("t").alias("ta"), F.explode(F.array(bucket, bucket - 1)).alias("bucket"))
    y = rows.select(*by, F.col("id").alias("b"), F.col("t").alias("tb"), bucket.alias("bucket"))
    gap = (F.col("ta") - F.col("tb")) / 1e6
    same = x.join(y, [*by, "bucket"]).where((gap < width) & ((gap > 0) | ((gap == 0) & (F.col("a") > F.col("b")))))
    return same.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.abs(gap).alias("seconds"))


def importance(old: Column, delta: Column) -> Column:
    return dense.clamp(old + delta)


def latest(history: DataFrame, key: str, version: str) -> DataFrame:
    """The last row of each key; a hash aggregate, so no group is sorted."""
    rest = [c for c in history.columns if c != key]
    return history.groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("r")).select(key, "r.*")


def alive(df: DataFrame, tombstones: DataFrame, key: str) -> DataFrame:
    return df.join(tombstones.select(key), key, "left_anti")


def expired(tombstones: DataFrame, ts: str, as_of: str, days: float = 7.0) -> DataFrame:
    """Tombstones past their retention, which a collection may remove for good."""
    return tombstones.where(F.unix_micros(F.to_timestamp(F.lit(as_of))) - F.unix_micros(F.col(ts).cast("timestamp")) > days * 86400 * 1e6)


def hash_chain(entries: DataFrame, doc: str, order: str, payload: list[str]) -> DataFrame:
    """entries with their hash and parent_hash: the hash covers the payload, and the parent is the entry before in the same document."""
    own = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in payload]), 256)
    w = Window.partitionBy(doc).orderBy(order)
    return entries.withColumn("hash", own).withColumn("parent_hash", F.lag("hash").over(w))


def verify_chain(chain: DataFrame, doc: str, order: str, payload: list[str]) -> DataFrame:
    """(doc, entries, broken): entries whose hash or parent is not what it should be."""
    w = Window.partitionBy(doc).orderBy(order)
    own = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in payload]), 256)
    bad = (F.col("hash") != own) | ~F.col("parent_hash").eqNullSafe(F.lag("hash").over(w))
    return chain.withColumn("bad", bad.cast("long")).groupBy(doc).agg(F.count("*").alias("entries"), F.sum("bad").alias("broken"))


def reversal_hash(ids: Column) -> Column:
    return F.sha2(F.concat_ws(",", F.array_sort(ids).cast("array<string>")), 256)


def lineage(parents: DataFrame, start: int, depth: int) -> DataFrame:
    """(id, depth): what an id derives from, up to so many steps, from (id, parent)."""
    from fathom.operators.graph import bfs

    return bfs(parents.select(F.col("id").alias("a"), F.col("parent").alias("b")), parents.sparkSession.createDataFrame([(start,)], "id long"), depth).select("id", "depth")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def last_state(events: DataFrame, key: str, status: str, order: list[str]) -> DataFrame:
    """The status and order columns of each key's last row."""
    return events.groupBy(key).agg(F.max_by(F.struct(status, *order), F.struct(*order)).alias("r")).select(key, "r.*")


def units_by_prefix(units: DataFrame, name: str, prefixes: list[str]) -> DataFrame:
    """Code units whose name begins with one of the prefixes; the filter reaches the scan."""
    keep = F.lit(False)
    for p in prefixes:
        keep = keep | F.col(name).startswith(p)
    return units.where(keep)


def unit_fingerprint(name: Column, signature: Column) -> Column:
    return F.sha2(F.concat(F.lower(name), F.lit("|"), signature), 256)


def within_intervals(spans: DataFrame, points: DataFrame, by: list[str], low: str, high: str, at: str, hours: float) -> DataFrame:
    """Points within [low, high) of spans of one group, spans being `hours` long at most. Both meet in buckets of that width, a span in those it touches, so no group meets as a whole."""
    width = hours * 3600 * 1e6
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / width)
    x = spans.withColumn("bucket", F.explode(F.sequence(bucket(low), bucket(high))))
    y = points.withColumn("bucket", bucket(at))
    return x.join(y, [*by, "bucket"]).where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("bucket")
