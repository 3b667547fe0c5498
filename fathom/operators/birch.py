"""Clustering features in a height-balanced tree: (n, ls, ss) of close vectors, one tree a task, whose leaves merge."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.functions import dense
from fathom.operators.descent import matrix
from fathom.operators.tables import written

#: Radius that a leaf's entry may have, entries of a node, leaf entries of a tree beyond which its radius grows, and by how much; trees whose leaves meet in one task.
RADIUS, BRANCHES, ENTRIES, GROWTH, MEETING = 0.3, 32, 4096, 1.25, 8
SCHEMA = "n long, ls array<double>, ss double, threshold double"


class Node:
    """Up to BRANCHES features side by side, each with a node below it, or none in a leaf."""

    __slots__ = ("below", "ls", "n", "size", "ss")

    def __init__(self, branches: int, dims: int, leaf: bool):
        self.n, self.ls, self.ss = np.zeros(branches + 1), np.zeros((branches + 1, dims)), np.zeros(branches + 1)
        self.size, self.below = 0, None if leaf else []

    def put(self, n: float, ls: np.ndarray, ss: float, below: Node | None = None) -> None:
        self.n[self.size], self.ls[self.size], self.ss[self.size] = n, ls, ss
        self.size += 1
        if below is not None:
            self.below.append(below)

    def nearest(self, center: np.ndarray) -> int:
        gap = self.ls[: self.size] / self.n[: self.size, None] - center
        return int(np.einsum("ij,ij->i", gap, gap).argmin())

    def total(self) -> tuple[float, np.ndarray, float]:
        return self.n[: self.size].sum(), self.ls[: self.size].sum(0), self.ss[: self.size].sum()


class Tree:
    def __init__(self, dims: int, threshold: float, branches: int, entries: int):
        self.dims, self.threshold, self.branches, self.most = dims, threshold, branches, entries
        self.root, self.entries = Node(branches, dims, True), 0

    def add(self, n: float, ls: np.ndarray, ss: float) -> None:
        parted = self._add(self.root, n, ls, ss)
        if parted:
            self.root = Node(self.branches, self.dims, False)
            for part in parted:
                self.root.put(*part.total(), part)
        if self.entries > self.most:
            self._rebuild()

    def _add(self, node: Node, n: float, ls: np.ndarray, ss: float) -> tuple[Node, Node] | None:
        """Puts a feature below a node; the two halves of a node that got too full."""
        if node.below is None:
            at = node.nearest(ls / n) if node.size else -1
            if at >= 0 and radius(node.n[at] + n, node.ls[at] + ls, node.ss[at] + ss) <= self.threshold:
                node.n[at], node.ss[at] = node.n[at] + n, node.ss[at] + ss
                node.ls[at] += ls
                return None
            node.put(n, ls, ss)
            self.entries += 1
        else:
            at = node.nearest(ls / n)
            parted = self._add(node.below[at], n, ls, ss)
            if parted is None:
                node.n[at], node.ss[at] = node.n[at] + n, node.ss[at] + ss
                node.ls[at] += ls
                return None
            node.below[at] = parted[0]
            node.n[at], node.ls[at], node.ss[at] = parted[0].total()
            node.put(*parted[1].total(), parted[1])
        return self._split(node) if node.size > self.branches else None

    def _split(self, node: Node) -> tuple[Node, Node]:
        """By the two entries that are farthest apart; the rest go to the nearer one."""
        x = node.ls[: node.size] / node.n[: node.size, None]
        sq = (x * x).sum(1)
        gap = sq[:, None] + sq[None, :] - 2 * x @ x.T
        i, j = np.unravel_index(gap.argmax(), gap.shape)
        if i == j:
            j = (i + 1) % node.size
        parts = Node(self.branches, self.dims, node.below is None), Node(self.branches, self.dims, node.below is None)
        for k in range(node.size):
            to = 0 if k == i else 1 if k == j else int(gap[k, j] < gap[k, i])
            if parts[to].size == self.branches:
                to = 1 - to
            parts[to].put(node.n[k], node.ls[k], node.ss[k], None if node.below is None else node.below[k])
        return parts

    def leaves(self) -> Iterator[tuple[float, np.ndarray, float]]:
        nodes = [self.root]
        while nodes:
            node = nodes.pop()
            if node.below is None:
                yield from zip(node.n[: node.size], node.ls[: node.size], node.ss[: node.size], strict=True)
            else:
                nodes += node.below

    def _rebuild(self) -> None:
        """Entries go into a new tree of a larger radius until they are few enough."""
        while self.entries > self.most:
            held = [(n, ls.copy(), ss) for n, ls, ss in self.leaves()]
            self.threshold *= GROWTH
            self.root, self.entries = Node(self.branches, self.dims, True), 0
            most, self.most = self.most, 1 << 62
            for x in held:
                self.add(*x)
            self.most = most


def radius(n: float, ls: np.ndarray, ss: float) -> float:
    """Root of the mean squared distance to the mean."""
    return float(np.sqrt(max(0.0, ss / n - ls @ ls / (n * n))))


def _trees(rows: DataFrame, threshold: float, branches: int, entries: int) -> DataFrame:
    """The leaves of one tree for each task, over features (n, ls, ss, threshold)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[int, Tree] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            dims = pc.list_value_length(batch.column("ls")).to_numpy()
            for d in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == d))
                own = trees.setdefault(d, Tree(d, threshold, branches, entries))
                # what was merged under a larger radius is kept whole, so that radius holds from here on
                own.threshold = max(own.threshold, float(part.column("threshold").to_numpy().max()))
                for n, ls, ss in zip(part.column("n").to_numpy(), matrix(part.column("ls")), part.column("ss").to_numpy(), strict=True):
                    own.add(float(n), ls, float(ss))
        for own in trees.values():
            leaves = list(own.leaves())
            yield pa.RecordBatch.from_arrays([pa.array([int(n) for n, *_ in leaves], pa.int64()), pa.array([ls.tolist() for _, ls, _ in leaves], pa.list_(pa.float64())), pa.array([ss for *_, ss in leaves], pa.float64()), pa.array([own.threshold] * len(leaves), pa.float64())], names=["n", "ls", "ss", "threshold"])

    return rows.mapInArrow(run, SCHEMA)


def cf_tree(df: DataFrame, vector: str, threshold: float = RADIUS, branches: int = BRANCHES, entries: int = ENTRIES) -> DataFrame:
    """(cluster, n, ls, ss, radius, threshold): features of close vectors; n, ls and ss add up to the table's, and no radius is over its threshold.

    Each task grows a tree over its rows; eight trees' leaves meet in one, in rounds, until one is left. A tree with more than `entries`
    leaf entries is built anew with a larger radius, so a task holds a bounded tree. Null and empty vectors, and those with null, NaN or
    infinite components, are left out; vectors of other lengths have trees of their own. No rows, no features. Which vectors
    share a feature depends on the order that they come in, the bounds don't.
    """
    v = dense.vec(vector)
    rows = df.where(F.col(vector).isNotNull()).select(v.alias("ls")).where((F.size("ls") > 0) & ~F.exists("ls", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    found = written(_trees(rows.select(F.lit(1).cast("long").alias("n"), "ls", dense.dot("ls", "ls").alias("ss"), F.lit(0.0).alias("threshold")), threshold, branches, entries), "leaves")
    parts = found.select(F.spark_partition_id().alias("p")).distinct().count()
    while True:
        parts = -(-parts // MEETING)
        found = written(_trees(found.repartition(max(1, parts)), threshold, branches, entries), "leaves")
        if parts <= 1:
            break
    radii = F.sqrt(F.greatest(F.lit(0.0), F.col("ss") / F.col("n") - dense.dot("ls", "ls") / (F.col("n") * F.col("n"))))
    return found.select(F.monotonically_increasing_id().alias("cluster"), "n", "ls", "ss", radii.alias("radius"), "threshold")
