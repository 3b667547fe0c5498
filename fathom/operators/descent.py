"""A k-NN graph by NN-descent: leaves of random trees to begin with, then neighbours of neighbours until few change."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions import dense
from fathom.operators.retrieve import best_of
from fathom.operators.tables import written

#: Vectors that trees are grown on at most, by hash; vectors of a leaf, and of the sample for each leaf at least.
FIT_ROWS, LEAF, LEAF_SAMPLE = 16_384, 1024, 16
#: Trees, rounds at most, neighbours that a node's list holds at least, and of those the share sampled in each direction a round.
TREES, ROUNDS, WIDTH, SAMPLE = 3, 8, 16, 0.4
#: Share of all list places that changed in a round below which it ends (fixed value).
LEAST_UPDATES = 0.001


class Trees:
    """Random trees over a sample: each inner node parts its vectors at the median along the line between two of them. Nodes are numbered level by level."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        d, self.depth = sample.shape[1], depth
        self.normals, self.cuts = np.zeros((trees, 2**depth - 1, d)), np.zeros((trees, 2**depth - 1))
        for t in range(trees):
            node = np.zeros(len(sample), np.int64)
            for level in range(depth):
                first = 2**level - 1
                for at in range(first, 2 * first + 1):
                    own = np.flatnonzero(node == at)
                    if len(own) > 1:
                        i, j = rng.choice(own, 2, replace=False)
                        self.normals[t, at] = sample[i] - sample[j]
                        self.cuts[t, at] = np.median(sample[own] @ self.normals[t, at])
                node = self._step(t, node, sample)

    def _step(self, t: int, node: np.ndarray, x: np.ndarray) -> np.ndarray:
        return 2 * node + 1 + (np.einsum("ij,ij->i", x, self.normals[t, node]) > self.cuts[t, node])

    def leaves(self, t: int, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            node = self._step(t, node, x)
        return node


def unit_rows(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of rows with an id and a vector of finite components that are not all 0; v of length 1."""
    rows = df.select(F.col(key).cast("long").alias("id"), dense.vec(vector).alias("w")).where("id is not null and w is not null")
    sound = rows.where(~F.exists("w", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).withColumn("norm", dense.norm("w")).where("norm > 0")
    return sound.select("id", F.transform("w", lambda x: x / F.col("norm")).alias("v"))


def matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _first_lists(rows: DataFrame, width: int, trees: int, leaf: int) -> DataFrame:
    """(a, b, score) of the nearest in each vector's leaf of each tree, and in a part of all vectors by hash. A leaf of more than `leaf` vectors is dealt to parts by hash, so products are rows times leaf times trees and one at most."""
    n = rows.count()
    sample = np.array([r.v for r in rows.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).collect()])
    depth = max(0, min(int(np.ceil(np.log2(max(1, n / leaf)))), int(np.log2(max(1, len(sample) / LEAF_SAMPLE)))))
    forest = rows.sparkSession.sparkContext.broadcast(Trees(sample, trees if depth else 1, depth))  # at most FIT_ROWS / LEAF_SAMPLE vectors a tree

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = forest.value
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("v"))
                for t in range(len(own.normals)):
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(x), t, np.int32)), pa.array(own.leaves(t, x))], names=["id", "v", "tree", "leaf"])
                if own.depth:  # one more deal, by hash alone, ties leaves together
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(x), -1, np.int32)), pa.array(np.zeros(len(x), np.int64))], names=["id", "v", "tree", "leaf"])

    placed = written(rows.mapInArrow(place, "id long, v array<double>, tree int, leaf long"), "leaves")
    sizes = placed.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / leaf).cast("int").alias("of"))  # a row for each leaf of a bounded forest
    dealt = placed.join(F.broadcast(sizes), ["tree", "leaf"]).withColumn("part", F.pmod(F.xxhash64("id", "tree"), F.col("of")))

    def nearest(own: pa.Table) -> pa.Table:
        ids, x = own.column("id").to_numpy(), matrix(own.column("v"))
        return pa.table(dict(zip(("a", "b", "score"), best_of(ids, ids, x @ x.T, width), strict=True)))

    return dealt.groupBy("tree", "leaf", "part").applyInArrow(nearest, "a long, b long, score double")


def _kept(pairs: DataFrame, width: int) -> DataFrame:
    """The `width` best of each list; pairs of fewer than all are left out before lists meet."""
    w = Window.partitionBy("a").orderBy(F.desc("score"), "b")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= width)


def _local_joins(rows: DataFrame, width: int) -> DataFrame:
    """(a, b, score): of each node u's list (u, x, fresh, v, floor) the pairs with a fresh one that are nearer than a's worst neighbour. Lists of many nodes are compared as one stack of matrices."""

    def joined(held: pa.Table) -> pa.RecordBatch:
        u, ids, fresh, floor = (held.column(c).to_numpy() for c in ("u", "x", "fresh", "floor"))
        x = matrix(held.column("v"))
        starts = np.flatnonzero(np.append(True, u[1:] != u[:-1]))
        sizes = np.diff(np.append(starts, len(u)))
        out = []
        for at in range(0, len(starts), 512):
            n, longest = len(starts[at : at + 512]), int(sizes[at : at + 512].max())
            slot = np.arange(longest)
            real = slot < sizes[at : at + 512, None]
            place = np.where(real, starts[at : at + 512, None] + slot, 0)
            score = np.round(x[place] @ x[place].transpose(0, 2, 1), 6)
            hit = real[:, :, None] & real[:, None, :] & (fresh[place][:, :, None] | fresh[place][:, None, :]) & (ids[place][:, :, None] != ids[place][:, None, :]) & (score > floor[place][:, :, None])
            g, i, j = np.nonzero(hit)
            out.append((ids[place[g, i]], ids[place[g, j]], score[g, i, j].astype(np.float64)))
        a, b, score = (np.concatenate(c) for c in zip(*out, strict=True))
        # a pair met at several nodes of this part goes on once
        order = np.lexsort((b, a))
        a, b, score = a[order], b[order], score[order]
        one = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(a) else np.zeros(0, bool)
        return pa.RecordBatch.from_arrays([pa.array(c[one]) for c in (a, b, score)], names=["a", "b", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            u = held.column("u").to_numpy()
            cut = int(np.searchsorted(u, u[-1])) if len(u) else 0  # the last list may go on
            if cut:
                yield joined(held.slice(0, cut))
            rest = held.slice(cut)
        if rest is not None and rest.num_rows:
            yield joined(rest)

    return rows.repartition("u").sortWithinPartitions("u").mapInArrow(run, "a long, b long, score double")


def nn_descent(df: DataFrame, key: str, vector: str, k: int = 10, width: int | None = None, rounds: int = ROUNDS, trees: int = TREES, leaf: int = LEAF, sample: float = SAMPLE, least_updates: float = LEAST_UPDATES) -> DataFrame:
    """(a, b, score, rank): for each vector nearly its k nearest by cosine, ties to lesser ids. Work grows with rows, not with pairs.

    Lists of `width` neighbours begin with the exact nearest in the leaves of random trees. A round takes, for each node, a sample of
    its fresh and old neighbours in both directions, so a hub's reverse list is bounded too, and compares fresh ones with all
    (local join); what is nearer than a list's worst goes in. Pairs are compared as fresh once. It ends after `rounds`, or when
    fewer than least_updates of all places change. Up to `leaf` vectors are one leaf, and the graph is exact.

    Rows without an id or a norm, and those with null, NaN or infinite components, are in no list. Ids are unique. Fewer than k
    others: all of them. theta_pairs(best=k) is the exact way.
    """
    width = max(k, WIDTH) if width is None else width
    rows = written(unit_rows(df, key, vector), "unit")
    n = rows.count()
    if not n:
        return df.sparkSession.createDataFrame([], "a long, b long, score double, rank int")
    first = _first_lists(rows, width, trees, leaf).groupBy("a", "b").agg(F.max("score").alias("score"))
    graph = written(_kept(first, width).select("a", "b", "score", F.lit(True).alias("fresh")), "graph")
    most = max(1, round(width * sample))
    for number in range(rounds if n > leaf else 0):
        chance = F.xxhash64("a", "b", F.lit(number))
        pick = lambda node: F.row_number().over(Window.partitionBy(node, "fresh").orderBy(chance, "a", "b")) <= most  # noqa: E731, B023
        marked = written(graph.withColumn("picked", pick("a")), "marked")
        there = marked.where("picked").select(F.col("a").alias("u"), F.col("b").alias("x"), "fresh")
        back = graph.withColumn("picked", pick("b")).where("picked").select(F.col("b").alias("u"), F.col("a").alias("x"), "fresh")
        lists = there.unionByName(back).groupBy("u", "x").agg(F.max("fresh").alias("fresh"))
        floors = marked.groupBy("a").agg(F.min("score").alias("low"), F.count("*").alias("has")).select(F.col("a").alias("id"), F.when(F.col("has") >= width, F.col("low")).otherwise(-2.0).alias("floor"))
        side = rows.join(floors, "id", "left").select(F.col("id").alias("x"), F.col("v").cast("array<float>").alias("v"), F.coalesce("floor", F.lit(-2.0)).alias("floor"))
        found = _local_joins(lists.join(side, "x").select("u", "x", "fresh", "v", "floor"), width)
        had = marked.select("a", "b", "score", (F.col("fresh") & ~F.col("picked")).alias("fresh"), F.lit(True).alias("had"))
        both = had.unionByName(found.select("a", "b", "score", F.lit(True).alias("fresh"), F.lit(False).alias("had")))
        merged = both.groupBy("a", "b").agg(F.max("score").alias("score"), F.min("fresh").alias("fresh"), F.max("had").alias("had"))
        graph = written(_kept(merged, width).select("a", "b", "score", "fresh", "had"), "graph")
        changed = graph.where(~F.col("had")).count()
        graph = graph.drop("had")
        if changed <= least_updates * n * width:
            break
    return _kept(graph, k).select("a", "b", "score", "rank")
