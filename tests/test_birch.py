"""Trees of clustering features keep their sums and bounds in any order."""

import random

import numpy as np
import pytest

from fathom.operators.birch import Tree, cf_tree, radius


def heights(node):
    return {0} if node.below is None else {1 + h for b in node.below for h in heights(b)}


def check(node, branches):
    assert node.size <= branches
    if node.below is not None:
        assert len(node.below) == node.size
        for i, below in enumerate(node.below):
            n, ls, ss = below.total()
            assert n == node.n[i] and np.allclose(ls, node.ls[i]) and ss == pytest.approx(node.ss[i])
            check(below, branches)


@pytest.mark.parametrize("order", ["given", "sorted", "random"])
def test_tree_is_balanced_and_bounded(order):
    x = np.random.default_rng(0).normal(size=(1500, 3))
    x = x[np.lexsort(x.T)] if order == "sorted" else x[np.random.default_rng(1).permutation(1500)] if order == "random" else x
    own = Tree(3, 0.2, 5, 10**6)
    for row in x:
        own.add(1.0, row, row @ row)
    leaves = list(own.leaves())
    assert len(heights(own.root)) == 1 and own.entries == len(leaves) < 1500
    check(own.root, 5)
    assert sum(n for n, *_ in leaves) == 1500 and np.allclose(sum(ls for _, ls, _ in leaves), x.sum(0)) and all(radius(*f) <= 0.2 + 1e-9 for f in leaves)


def test_rebuild_bounds_the_entries():
    x = np.random.default_rng(2).normal(size=(800, 4))
    own = Tree(4, 0.01, 4, 60)
    for row in x:
        own.add(1.0, row, row @ row)
        assert own.entries <= 60
    leaves = list(own.leaves())
    assert len(leaves) == own.entries and sum(n for n, *_ in leaves) == 800 and own.threshold > 0.01 and all(radius(*f) <= own.threshold + 1e-9 for f in leaves)
    check(own.root, 4)


def test_equal_vectors_are_one_entry():
    own = Tree(2, 0.1, 3, 10)
    for _ in range(50):
        own.add(1.0, np.array([3.0, 4.0]), 25.0)
    assert own.entries == 1 and next(own.leaves())[0] == 50


def test_leaves_of_tasks_merge(spark):
    rng = random.Random(3)
    centers = [(0.0, 0.0), (5.0, 5.0), (9.0, 0.0)]
    rows = [(i, [c + rng.gauss(0, 0.05) for c in centers[i % 3]]) for i in range(600)] + [(900, None), (901, [float("nan"), 1.0]), (902, [None, 1.0]), (903, [7.0]), (904, [])]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(12)
    out = [r for r in cf_tree(df, "v", threshold=0.3).collect() if len(r.ls) == 2]
    assert sum(r.n for r in out) == 600 and all(r.radius <= r.threshold + 1e-9 for r in out)
    for k, (x, y) in enumerate(centers):
        near = [r for r in out if abs(r.ls[0] / r.n - x) < 1 and abs(r.ls[1] / r.n - y) < 1]
        assert sum(r.n for r in near) == 200
    total = np.sum([v for _, v in rows[:600]], axis=0)
    assert np.allclose(np.sum([r.ls for r in out], axis=0), total)
    few = [r for r in cf_tree(df, "v", threshold=0.001, branches=4, entries=20).collect() if len(r.ls) == 2]
    assert len(few) <= 20 and sum(r.n for r in few) == 600 and all(r.radius <= r.threshold + 1e-9 for r in few)
    assert cf_tree(df.limit(0), "v").count() == 0
