"""What both vector searches share: rows that take part, blocks of them, the meeting of query and candidate blocks, and the exact end."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.llm.common import small_batches, written

#: Rows of a block of candidates and of one of queries at most; small tables have smaller ones, so that all cores get some.
CANDIDATES, QUERIES = 1 << 16, 1 << 13
#: Candidates and queries whose scores are held at once.
STEP, PART = 4096, 256
#: Rows fetched by key up to which they are broadcast (some tens of bytes each).
BROADCAST_ROWS = 200_000


def usable(df: DataFrame, key: str, vector: str, nonzero: bool = False) -> DataFrame:
    """(id, vec as doubles) of rows whose id and vector are not null and whose components are all finite; nonzero: and not all 0."""
    vec = F.col(vector).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    out = df.select(F.col(key).cast("long").alias("id"), vec.alias("vec")).where("id is not null and vec is not null and size(vec) > 0").where(~F.exists("vec", bad))
    return out.where(F.exists("vec", lambda x: x != 0)) if nonzero else out


def keyed(df: DataFrame, name: str) -> DataFrame:
    """df with a number of its own for each row (key), written: repeated ids stay apart, and a lost task changes no number."""
    return written(df.withColumn("key", F.monotonically_increasing_id()), name)


def matrices(batch: pa.RecordBatch, vec: str = "vec", most: int = STEP) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix for each length of vector in a batch, `most` rows at most."""
    lists = batch.column(vec)
    offsets = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        for at in range(0, len(rows), most):
            part = rows[at : at + most]
            yield part, values[offsets[part][:, None] + np.arange(n)]


def arrays(blob: bytes, kind: type, *shape: int) -> np.ndarray:
    return np.frombuffer(blob, kind).reshape(shape)


def in_blocks(rows: DataFrame, most: int, pack: Callable[[np.ndarray], bytes]) -> DataFrame:
    """(dims, keys, ids, data): blocks of `most` rows at most of one length of vector, from (key, id, vec), written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def block(d: int) -> pa.RecordBatch:
            keys, ids, x = (np.concatenate(c) for c in zip(*held.pop(d), strict=True))
            return pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), *[pa.array([b], pa.binary()) for b in (keys.tobytes(), ids.tobytes(), pack(x))]], names=["dims", "keys", "ids", "data"])

        for batch in batches:
            keys, ids = batch.column("key").to_numpy(), batch.column("id").to_numpy()
            for at, x in matrices(batch, most=most):
                d = x.shape[1]
                if d in held and sum(len(k) for k, *_ in held[d]) + len(at) > most:
                    yield block(d)
                held.setdefault(d, []).append((keys[at], ids[at], x))
        for d in list(held):
            yield block(d)

    with small_batches(rows.sparkSession):
        return written(rows.select("key", "id", "vec").mapInArrow(run, "dims int, keys binary, ids binary, data binary"), "blocks")


def meet(queries: DataFrame, candidates: DataFrame, start: Callable, schema: str, name: str) -> DataFrame:
    """What start's object emits for each block of queries after it has met all blocks of candidates of its length, written.

    start(query keys, ids, matrix) gives an object with see(keys, ids, data) and done(). Query blocks are rows h; candidates go once to
    each. Few query blocks meet the candidates in stripes, so that all cores work: what is emitted is bounded by query blocks
    times stripes, not by blocks of candidates. A task holds one block of either side at a time. The driver holds none.
    """
    spark = queries.sparkSession
    numbered = queries.withColumn("h", F.monotonically_increasing_id())
    numbered = written(numbered, "queries")
    places = numbered.groupBy("dims").agg(F.sort_array(F.collect_list("h")).alias("hs"))  # a number for each query block
    n = numbered.count()
    stripes = max(1, -(-2 * spark.sparkContext.defaultParallelism // max(1, n)))
    q = numbered.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1)))).select("h", "s", F.lit(0).alias("kind"), "dims", "keys", "ids", "data")
    c = candidates.join(F.broadcast(places), "dims") if n <= BROADCAST_ROWS else candidates.join(places, "dims")
    c = c.withColumn("s", F.pmod(F.xxhash64("keys"), F.lit(stripes)).cast("int")).withColumn("h", F.explode("hs")).select("h", "s", F.lit(1).alias("kind"), "dims", "keys", "ids", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            for i in range(batch.num_rows):
                kind, d = batch.column("kind")[i].as_py(), batch.column("dims")[i].as_py()
                keys, ids, data = (batch.column(c)[i].as_buffer() for c in ("keys", "ids", "data"))
                keys, ids = np.frombuffer(keys, np.int64), np.frombuffer(ids, np.int64)
                if not kind:
                    if own is not None:
                        yield from own.done()
                    own = start(keys, ids, np.frombuffer(data, np.float64).reshape(-1, d))
                else:
                    own.see(keys, ids, data)
        if own is not None:
            yield from own.done()

    dealt = q.unionByName(c).repartition(min(10_000, max(1, n * stripes)), "h", "s").sortWithinPartitions("h", "s", "kind")
    with small_batches(spark):
        return written(dealt.mapInArrow(run, schema), name)


def fetched(found: DataFrame, rows: DataFrame, queries: DataFrame) -> DataFrame:
    """found (qkey, key, ...) with the vectors of both sides: q, vec, id and query_id. Only rows that were found are read from the exact file."""
    few = found.count() <= BROADCAST_ROWS
    own = rows.select("key", "id", "vec")
    met = own.join(F.broadcast(found), "key") if few else own.join(found.drop("id") if "id" in found.columns else found, "key")
    met = met.select("qkey", "key", own["id"], "vec", *[c for c in found.columns if c not in ("qkey", "key", "id")])
    return met.join(queries.select(F.col("key").alias("qkey"), F.col("id").alias("query_id"), F.col("vec").alias("q")), "qkey")


def product(x: str, y: str) -> Column:
    """Inner product in doubles, summed from the first component to the last."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)


def ranked(scored: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest scores of each query, then smaller ids, from (qkey, query_id, id, key, score)."""
    w = Window.partitionBy("qkey").orderBy(F.desc("score"), "id", "key")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def block_rows(rows: DataFrame, most: int) -> int:
    """Rows of a block: a sixteenth of the table, 1,024 at least, `most` at most."""
    return min(most, max(1024, rows.count() // 16))
