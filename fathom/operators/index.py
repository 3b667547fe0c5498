"""An inverted-file index for dense search: coarse centroids, lists, probes; and an approximate k-NN graph over it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions import dense
from fathom.operators import retrieve
from fathom.operators.tables import written

#: Vectors that centroids are fitted on at most, lists at most, and vectors of a list for which one more list is made.
FIT_ROWS, MOST_LISTS, LIST_ROWS = 16_384, 4096, 1024


def centroids_of(x: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """k-means of unit vectors by cosine, from evenly spaced starts; empty lists keep their centroid."""
    own = x[np.linspace(0, len(x) - 1, lists).astype(int)].copy()
    for _ in range(rounds):
        near = (x @ own.T).argmax(1)
        sums = np.zeros_like(own)
        np.add.at(sums, near, x)
        norm = np.sqrt((sums * sums).sum(1))
        own[norm > 0] = sums[norm > 0] / norm[norm > 0, None]
    return own


class ListIndex:
    """Rows (id, v, list) of vectors under their nearest centroids by cosine, written by list so that a search reads the lists it probes."""

    def __init__(self, rows: DataFrame, centroids: np.ndarray):
        self.rows, self.centroids = rows, centroids

    @classmethod
    def build(cls, df: DataFrame, key: str, vector: str, spill: int = 1, lists: int | None = None) -> ListIndex:
        """Centroids are fitted on at most FIT_ROWS vectors, taken by hash; every vector with a norm is indexed, under its `spill` nearest centroids."""
        rows = df.select(F.col(key).cast("long").alias("id"), dense.vec(vector).alias("v")).where("id is not null and v is not null").where(dense.norm("v") > 0)
        n = rows.count()
        if not n:
            return cls(rows.withColumn("list", F.lit(0)), np.zeros((0, 0)))
        sample = np.array([r.v for r in rows.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).collect()])
        sample /= np.sqrt((sample * sample).sum(1))[:, None]
        own = centroids_of(sample, min(lists or max(1, min(MOST_LISTS, n // LIST_ROWS)), len(sample)))
        shared = df.sparkSession.sparkContext.broadcast(own)  # MOST_LISTS vectors at most

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = shared.value
            for batch in batches:
                if batch.num_rows:
                    x = np.array(batch.column("v").to_pylist())
                    k = min(spill, len(c))
                    near = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :k]
                    part = batch.take(pa.array(np.repeat(np.arange(len(x)), k)))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(near.ravel().astype(np.int32))], names=["id", "v", "list"])

        return cls(written(rows.mapInArrow(assign, "id long, v array<double>, list int"), "lists"), own)

    def probes(self, query: list[float], n: int) -> list[int]:
        q = np.array(query)
        return [int(i) for i in np.argsort(-(self.centroids @ q), kind="stable")[:n]] if len(self.centroids) else []

    def search(self, query: list[float], k: int, probe: int = 8, score: Column | None = None) -> DataFrame:
        """(id, score, rank): the k nearest by cosine within the `probe` nearest lists. All lists make it exact."""
        q = F.lit([float(x) for x in query]).cast("array<double>")
        near = self.rows.where(F.col("list").isin(self.probes(query, probe))).dropDuplicates(["id"])
        return retrieve.knn(near, dense.cos01("v", q) if score is None else score, k, "id")

    def knn_graph(self, k: int, block: int = 4096) -> DataFrame:
        """(a, b, score, rank): each vector's k nearest among those it shares a list with. Lists of more than `block` rows are dealt to blocks that meet pairwise."""
        sizes = written(self.rows.groupBy("list").agg(F.ceil(F.count("*") / block).cast("int").alias("of")), "sizes")
        dealt = self.rows.join(F.broadcast(sizes), "list").withColumn("g", F.pmod(F.xxhash64("id"), F.col("of")).cast("int"))  # MOST_LISTS rows
        every = F.explode(F.sequence(F.lit(0), F.col("of") - 1))
        left = dealt.withColumn("h", every).select("list", "g", "h", F.lit(0).alias("part"), "id", "v")
        right = dealt.withColumn("h", every).select("list", F.col("h").alias("g"), F.col("g").alias("h"), F.lit(1).alias("part"), "id", "v")

        def nearest(own: pa.Table) -> pa.Table:
            part = own.column("part").to_numpy()
            ids, x = own.column("id").to_numpy(), np.array(own.column("v").to_pylist())
            a, b = ids[part == 0], ids[part == 1]
            if not len(a) or not len(b):
                return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
            return pa.table(dict(zip(("a", "b", "score"), retrieve.best_of(a, b, retrieve.matrix_cosine(x[part == 0], x[part == 1]), k), strict=True)))

        pairs = left.unionByName(right).groupBy("list", "g", "h").applyInArrow(nearest, "a long, b long, score double").groupBy("a", "b").agg(F.max("score").alias("score"))
        w = Window.partitionBy("a").orderBy(F.desc("score"), "b")
        return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
