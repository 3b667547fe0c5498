"""Tucker factors against numpy, informed paths against relaxation, scopes of written tables."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.operators import graph
from fathom.operators.tables import scope, written
from fathom.operators.tucker import core_similarity, tucker_core, tucker_factors


def test_tucker_equals_numpy(spark):
    rng = np.random.default_rng(0)
    x = np.einsum("nab,ia,jb->nij", rng.normal(size=(60, 2, 3)), rng.normal(size=(5, 2)), rng.normal(size=(8, 3))) + 0.1 * rng.normal(size=(60, 5, 8))
    rows = [(i, m.ravel().tolist()) for i, m in enumerate(x)] + [(90, None), (91, [1.0]), (92, [float("nan")] * 40)]
    df = spark.createDataFrame(rows, "id long, x array<double>").repartition(3)
    u, v = tucker_factors(df, "x", (5, 8), (2, 3))
    # the same iteration over the whole tensor in memory
    lead = lambda g, r: np.linalg.eigh(g)[1][:, ::-1][:, :r]
    q = lead(np.einsum("nij,nik->jk", x, x), 3)
    for _ in range(5):
        p = lead(np.einsum("nij,nkj->ik", x @ q, x @ q), 2)
        q = lead(np.einsum("nij,nik->jk", p.T @ x, p.T @ x), 3)
    error = lambda a, b: np.linalg.norm(x - a @ (a.T @ x @ b) @ b.T)
    assert error(u, v) == pytest.approx(error(p, q), rel=1e-9) and error(u, v) < 0.25 * np.linalg.norm(x)
    assert np.allclose(u.T @ u, np.eye(2)) and np.allclose(v.T @ v, np.eye(3))
    got = df.where("id < 3").select("id", tucker_core("x", (5, 8), u, v).alias("c")).orderBy("id").collect()
    for r in got:
        assert np.allclose(r.c, (u.T @ x[r.id] @ v).ravel())
    a, b = tucker_factors(df, "x", (5, 8), (5, 8), rounds=1)
    whole = df.where("id < 2").select("id", "x", tucker_core("x", (5, 8), a, b).alias("c"))
    pair = whole.alias("p").join(whole.alias("q"), F.col("p.id") < F.col("q.id")).select(core_similarity("p.c", "q.c").alias("s")).first().s
    assert pair == pytest.approx(float(x[0].ravel() @ x[1].ravel() / np.linalg.norm(x[0]) / np.linalg.norm(x[1])))


def grid_graph(side, seed):
    rng = random.Random(seed)
    at = lambda i, j: i * side + j
    points = {at(i, j): [0.8 * (i / side - 0.5), 0.8 * (j / side - 0.5)] for i in range(side) for j in range(side)}

    def far(p, q):
        x, y = np.array(p), np.array(q)
        return float(np.arccosh(1 + 2 * ((x - y) @ (x - y)) / ((1 - x @ x) * (1 - y @ y))))

    edges = []
    for i in range(side):
        for j in range(side):
            for a, b in ((i + 1, j), (i, j + 1)):
                if a < side and b < side and rng.random() < 0.95:
                    w = 1 / (far(points[at(i, j)], points[at(a, b)]) * rng.uniform(1, 1.3)) - 0.001
                    edges += [(at(i, j), at(a, b), w), (at(a, b), at(i, j), w)]
    return points, edges


def test_informed_paths_cost_what_relaxation_finds(spark):
    points, rows = grid_graph(9, 2)
    edges = spark.createDataFrame(rows, "a long, b long, weight double")
    nodes = spark.createDataFrame(list(points.items()), "id long, point array<double>")
    want = {r.id: r.cost for r in graph.cheapest(edges, 0, 40).collect()}
    one, n = graph.informed_path(edges, nodes, 0, 40, ahead=0.05)
    assert one == pytest.approx(want[40]) and n < 0.8 * len(want)
    two, _ = graph.informed_path(edges, nodes, 0, 40, two_sided=True, ahead=0.3)
    assert two == pytest.approx(want[40])
    blind, m = graph.informed_path(edges, nodes.where("id < 0"), 0, 40, ahead=0.05)
    assert blind == pytest.approx(want[40]) and m > n
    assert graph.informed_path(edges.where("a != 0"), nodes, 0, 40)[0] is None and graph.informed_path(edges, nodes, 3, 3)[0] == 0.0


def test_scopes_delete_their_tables(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    with scope(spark) as folder:
        assert written(spark.range(5), "x").count() == 5 and os.path.isdir(folder) and folder.startswith(root)
        with scope(spark) as inner:
            written(spark.range(1), "y")
            assert inner.startswith(folder)
        assert not os.path.exists(inner) and os.path.isdir(folder)
    assert not os.path.exists(folder)
    kept = written(spark.range(2), "z")
    assert kept.count() == 2
