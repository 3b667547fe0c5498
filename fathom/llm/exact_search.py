"""Exact top-k by inner product over integers: a vector-approximation file."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.llm.common import written
from fathom.llm.vectors import BROADCAST_ROWS, CANDIDATES, PART, QUERIES, STEP, block_rows, fetched, in_blocks, keyed, meet, product, ranked, usable

#: Cells of each dimension, a byte each in the file.
CELLS = 256
#: Exact vectors read first for each of the k results that are wanted.
FIRST = 4
#: Bounds that a task may hold beyond the last pruning.
HELD = 1 << 18
#: Ids of no row: a class of several ids has none of its own, and neither has a query that stands for several.
NO_ROW, NO_QUERY = -(1 << 63), 1 - (1 << 63)


def integers(df: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, vec): each component as floor(scale * x), x as double, still held as doubles, which are exact to 2**53."""
    return usable(df, key, vector).select("id", F.transform("vec", lambda x: F.floor(x * F.lit(float(scale))).cast("double")).alias("vec"))


def approximation(x: np.ndarray, cells: int = CELLS) -> bytes:
    """A block of the file: the least and greatest value of each dimension's cells, then the cell numbers of all vectors, a byte each. Cells hold about equally many."""
    d = x.shape[1]
    edges = np.quantile(x, np.linspace(0, 1, cells + 1)[1:-1], axis=0, method="lower")
    code, low, high = np.zeros(x.shape, np.uint8), np.zeros((cells, d)), np.zeros((cells, d))
    for j in range(d):
        code[:, j] = np.searchsorted(edges[:, j], x[:, j], side="left")
        least, most = np.full(cells, np.inf), np.full(cells, -np.inf)
        np.minimum.at(least, code[:, j], x[:, j])
        np.maximum.at(most, code[:, j], x[:, j])
        low[:, j], high[:, j] = np.where(np.isfinite(least), least, 0), np.where(np.isfinite(most), most, 0)
    return low.tobytes() + high.tobytes() + code.tobytes()


class Bounds:
    """Queries of a block and, of all candidates seen, those whose upper bound reaches the k-th greatest lower bound."""

    def __init__(self, k: int, keys: np.ndarray, ids: np.ndarray, q: np.ndarray):
        self.k, self.keys, self.ids, self.held = k, keys, ids, HELD
        self.plus, self.minus = np.maximum(q, 0).T, np.minimum(q, 0).T
        self.floor = np.full((len(q), k), -np.inf)  # the k greatest lower bounds
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def see(self, keys: np.ndarray, ids: np.ndarray, data) -> None:
        d = len(self.plus)
        low, high = np.frombuffer(data, np.float64, 2 * CELLS * d).reshape(2, CELLS, d)
        code, dims = np.frombuffer(data, np.uint8, offset=16 * CELLS * d).reshape(-1, d), np.arange(d)
        for at in range(0, len(code), STEP):
            least, most = low[code[at : at + STEP], dims], high[code[at : at + STEP], dims]
            own = ids[at : at + STEP]
            for j in range(0, len(self.ids), PART):
                part = slice(j, j + PART)
                upper = most @ self.plus[:, part] + least @ self.minus[:, part]
                lower = least @ self.plus[:, part] + most @ self.minus[:, part]
                self_hit = own[:, None] == self.ids[None, part]
                upper[self_hit] = lower[self_hit] = -np.inf
                both = np.concatenate([self.floor[part], lower.T], axis=1)
                self.floor[part] = np.partition(both, both.shape[1] - self.k, axis=1)[:, -self.k :]
                row, query = np.nonzero((upper >= self.floor[part].min(1)) & (upper > -np.inf))
                self.found.append((query + j, keys[at + row], upper[row, query]))
            if sum(len(x) for x, *_ in self.found) > self.held:
                self.prune()

    def prune(self) -> None:
        """Drops what risen floors no longer let in."""
        query, key, upper = (np.concatenate(c) for c in zip(*self.found, strict=True))
        keep = upper >= self.floor.min(1)[query]
        self.found = [(query[keep], key[keep], upper[keep])]
        self.held = 2 * int(keep.sum()) + HELD

    def done(self) -> Iterator[pa.RecordBatch]:
        if self.found:
            self.prune()
            query, key, upper = self.found[0]
            yield pa.RecordBatch.from_arrays([pa.array(self.keys[query]), pa.array(key), pa.array(upper)], names=["qkey", "key", "upper"])


def _hashed(rows: DataFrame) -> DataFrame:
    """rows with c1 and c2: two hashes of the vector, which name its class."""
    return rows.withColumns({"c1": F.xxhash64("vec"), "c2": F.xxhash64(F.lit(1), "vec")})


def _few(df: DataFrame) -> DataFrame:
    """A written table, broadcast if it has few rows; more are joined by shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def vector_classes(rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of rows (id, vec): one row for each class of equal vectors (key, id, vec, c1, c2), where id is the class's only id or NO_ROW; the k + 1 least ids of each class (c1, c2, id, n) with their numbers of rows; and (c1, c2, id) of the ids of larger classes that lie in no other class.

    Only hashes and ids are shuffled for it, copies being counted first and limited before a class meets; vectors stay where they are, but
    for one of each class of several rows.
    """
    own = _hashed(rows)
    members = written(own.groupBy("c1", "c2", "id").agg(F.count("*").alias("n")), "members")
    groups = members.groupBy("c1", "c2").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.sum("n").alias("rows")).where("rows > 1")
    groups = _few(written(groups.select("c1", "c2", "least", F.when(F.col("least") == F.col("most"), F.col("least")).otherwise(F.lit(NO_ROW)).alias("sole")), "groups"))
    met = own.join(groups, ["c1", "c2"], "left")
    one = met.where("least is null").select("id", "vec", "c1", "c2")
    first = met.where("id = least").select(F.col("sole").alias("id"), "vec", "c1", "c2").dropDuplicates(["c1", "c2"])
    place = F.row_number().over(Window.partitionBy("c1", "c2").orderBy("id"))
    ids = written(members.withColumn("place", place).where(F.col("place") <= k + 1).drop("place"), "ids")
    several = members.groupBy("id").agg(F.count("*").alias("classes")).where("classes > 1").select("id")
    shared = members.join(groups.where(F.col("sole") == NO_ROW).select("c1", "c2"), ["c1", "c2"], "left_semi").join(several, "id", "left_anti").select("c1", "c2", "id")
    return keyed(one.unionByName(first), "classes"), ids, written(shared, "shared")


def exact_top_k(df: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = 256, block: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k rows of df with the largest integer inner product for each row of queries.

    The approximation file holds a byte for each component and each block's cell limits; its scan bounds each inner product (a
    positive component of the query meets its cell's greatest value, a negative one the least) and keeps what may be among the
    k best. Exact vectors are then read from the largest upper bound down: FIRST * k for each query, and after those only rows whose
    bound is not below the k-th exact score; equal bounds are read too, for ties go to the smaller id.

    Rows with equal integer vectors are one class in the file, and queries with equal vectors are asked once; only the k least ids of a
    found class come back for each query, so neither a vector on a third of all rows nor its queries multiply rows.
    A query's own id is no candidate for it. Rows of df with equal id and vector are candidates each, and so are repeated rows of queries
    queries each. Vectors that are null, empty, or hold null, NaN or infinite components take no part on either side;
    vectors of another length than the query's are no candidates for it. Fewer than k candidates: all of them. Scores are
    exact up to 2**53.
    """
    cand, ids, shared = vector_classes(integers(df, key, vector, scale), k)
    asked = _hashed(integers(queries, key, vector, scale))
    # a query stands for others if its vector's class has them too and its id lies in no other class, which it would have to leave out
    alone = asked.join(_few(shared.withColumn("with", F.lit(True))), ["c1", "c2", "id"], "left").withColumn("asks", F.when(F.col("with"), F.lit(NO_QUERY)).otherwise(F.col("id")))
    alone = keyed(alone.select(F.col("id").alias("query_id"), "asks", "c1", "c2", "vec").withColumnRenamed("vec", "v"), "asked").withColumnRenamed("key", "row")
    own = keyed(alone.dropDuplicates(["c1", "c2", "asks"]).select(F.col("asks").alias("id"), "c1", "c2", F.col("v").alias("vec")), "queries")
    file = in_blocks(cand, block or block_rows(cand, CANDIDATES), approximation)
    blocks = in_blocks(own, block or QUERIES, lambda x: x.astype(np.float64).tobytes())
    bounds = meet(blocks, file, lambda keys, ids, q: Bounds(k, keys, ids, q), "qkey long, key long, upper double", "bounds")
    order = Window.partitionBy("qkey").orderBy(F.desc("upper"), "key")
    placed = written(bounds.withColumn("place", F.row_number().over(order)), "order")
    columns = ["qkey", "key", "score"]
    first = written(fetched(placed.where(F.col("place") <= FIRST * k), cand, own).withColumn("score", product("q", "vec")).select(columns), "first")
    kth = first.withColumn("n", F.row_number().over(Window.partitionBy("qkey").orderBy(F.desc("score")))).where(F.col("n") == k).select("qkey", F.col("score").alias("kth"))
    rest = placed.where(F.col("place") > FIRST * k).join(kth, "qkey").where("upper >= kth").select("qkey", "key")
    scored = first.unionByName(fetched(written(rest, "rest"), cand, own).withColumn("score", product("q", "vec")).select(columns))
    # each class has a row for the query, so the best k rows lie in classes that fewer than k beat
    best = scored.withColumn("place", F.rank().over(Window.partitionBy("qkey").orderBy(F.desc("score")))).where(F.col("place") <= k)
    held = best.join(cand.select("key", "c1", "c2"), "key").join(ids, ["c1", "c2"]).select("qkey", "id", "n", "score")
    held = held.join(own.select(F.col("key").alias("qkey"), F.col("id").alias("asks"), F.col("c1").alias("q1"), F.col("c2").alias("q2")), "qkey").where("id != asks")
    least = Window.partitionBy("qkey").orderBy(F.desc("score"), "id")
    held = written(held.withColumn("place", F.row_number().over(least)).where(F.col("place") <= k + 1), "held")
    back = alone.select("row", "query_id", "asks", F.col("c1").alias("q1"), F.col("c2").alias("q2")).join(_few(held.drop("place")), ["q1", "q2", "asks"]).where("id != query_id")
    each = back.select(F.col("row").alias("qkey"), "query_id", "id", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("n"), F.lit(k)))).alias("key"), "score")
    return ranked(each, k).withColumn("score", F.col("score").cast("long"))
