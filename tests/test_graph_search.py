"""Nearest-neighbour graphs and linear plans against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.operators import cluster, descent, learn, metrics, retrieve
from fathom.operators.descent import Trees, nn_descent


def table_of(spark, x, schema="id long, v array<double>"):
    return spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)], schema)


def low_rank(n, d=24, rank=6, seed=0):
    rng = np.random.default_rng(seed)
    return np.tanh(rng.normal(size=(n, rank)) @ rng.normal(size=(rank, d))) + 0.05 * rng.normal(size=(n, d))


def recall_of(rows, x, k, ask):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = {}
    for r in rows:
        found.setdefault(r.a, set()).add(r.b)
    hits = 0
    for i in ask:
        s = u @ u[i]
        s[i] = -2
        hits += len(found.get(i, set()) & set(np.argsort(-s)[:k].tolist()))
    return hits / (k * len(ask))


def test_nn_descent_recall(spark):
    """Leaves alone find some; rounds find nearly all. What is compared grows with rows."""
    x = low_rank(6000)
    df = table_of(spark, x).repartition(4)
    ask = list(range(0, 6000, 40))
    start = recall_of(nn_descent(df, "id", "v", 10, leaf=128, trees=1, rounds=0).collect(), x, 10, ask)
    rows = nn_descent(df, "id", "v", 10, leaf=128, trees=1, rounds=5).collect()
    assert start < 0.8 < 0.95 <= recall_of(rows, x, 10, ask)
    assert len(rows) == 60_000 and {r["rank"] for r in rows} == set(range(1, 11)) and all(r.a != r.b for r in rows)


def test_nn_descent_is_exact_on_a_leaf_and_takes_odd_rows(spark):
    x = low_rank(60)
    x[7] = x[8] = x[9]
    odd = [(100, None), (101, [0.0] * 24), (102, [float("nan")] * 24), (None, [1.0] * 24), (103, [None] * 24)]
    df = table_of(spark, x).unionByName(spark.createDataFrame(odd, "id long, v array<double>"))
    got = {(r.a, r["rank"]): (r.b, r.score) for r in nn_descent(df, "id", "v", 4).collect()}
    want = {(r.a, r["rank"]): (r.b, r.score) for r in retrieve.theta_pairs(df.where("id < 60"), "id", "v", retrieve.matrix_cosine, best=4).collect()}
    assert got == want
    assert nn_descent(df.limit(0), "id", "v").count() == 0 and nn_descent(df.where("id = 3"), "id", "v").count() == 0
    assert nn_descent(df.where("id in (3, 4)"), "id", "v").count() == 2


def test_copies_do_not_fill_a_task(spark):
    """A third of the vectors are equal: a leaf that all of them fall in is dealt to parts."""
    x = low_rank(3000)
    x[::3] = x[0]
    df = table_of(spark, x)
    rows = nn_descent(df, "id", "v", 5, leaf=128, rounds=3).collect()
    assert len(rows) == 15_000 and min(r.score for r in rows if r.a % 3 == 0) > 0.999999
    assert recall_of(rows, x, 5, [i for i in range(0, 3000, 50) if i % 3]) > 0.8


def test_trees_part_at_medians():
    x = np.random.default_rng(1).normal(size=(1024, 5))
    own = Trees(x, 2, 4)
    for t in range(2):
        _, n = np.unique(own.leaves(t, x), return_counts=True)
        assert len(n) == 16 and n.max() <= 1.5 * 64


def test_local_joins_carry_lists_over_batches(spark):
    x = low_rank(40)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(u, i, bool(i % 2), [float(c) for c in x[i]], 0.1) for u in range(30) for i in range(u % 9, 40, 9)]
    df = spark.createDataFrame(rows, "u long, x long, fresh boolean, v array<float>, floor double")
    want = set()
    for u in range(30):
        own = range(u % 9, 40, 9)
        want |= {(i, j) for i in own for j in own if i != j and (i % 2 or j % 2) and x[i] @ x[j] > 0.1}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    got = {(r.a, r.b) for r in descent._local_joins(df, 9).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == want


def test_space_best_equals_each_space(spark):
    x = low_rank(70)
    df = table_of(spark, x)
    spaces = {"p": (1, 8), "q": (9, 16)}
    got = {(r.space, r.a, r["rank"]): (r.b, r.score) for r in retrieve.space_best(df, "id", "v", spaces, 3, block=20).collect()}
    for s, (lo, n) in spaces.items():
        own = retrieve.theta_pairs(df.withColumn("v", F.slice("v", lo, n)), "id", "v", retrieve.matrix_cos01, best=3)
        assert {(s, r.a, r["rank"]): (r.b, r.score) for r in own.collect()} == {k: v for k, v in got.items() if k[0] == s}


# linear plans


def signs_by_hand(x, y):
    return sum(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i in range(len(x)) for j in range(i))


@pytest.mark.parametrize("values", [3, 50, 10**6])
def test_order_signs(values):
    rng = random.Random(values)
    x, y, n = ([rng.randrange(values) for _ in range(300)], [rng.randrange(values) for _ in range(300)], [rng.choice([1, 1, 3]) for _ in range(300)])
    points = {}
    for a, b, c in zip(x, y, n):
        points[a, b] = points.get((a, b), 0) + c
    px, py = np.array(list(points), float).T
    counts = np.array(list(points.values()))
    rows = [p for p, c in points.items() for _ in range(c)]
    assert metrics.order_signs(px, py, counts) == signs_by_hand([p[0] for p in rows], [p[1] for p in rows])


def test_kendall_by_ranges(spark):
    """Hot values, ties, nulls; ranges of a few points."""
    rng = random.Random(1)
    rows = [(5.0 if rng.random() < 0.4 else rng.gauss(0, 9), 1.0 if rng.random() < 0.2 else float(rng.randrange(30))) for _ in range(400)]
    df = spark.createDataFrame([*rows, (None, 1.0), (1.0, float("nan"))], "x double, y double")
    want = signs_by_hand(*zip(*rows)) / (400 * 399 / 2)
    assert [metrics.kendall(df, "x", "y", block=b).first().tau for b in (10**6, 90, 13)] == pytest.approx([want] * 3)
    assert metrics.kendall(df.limit(0), "x", "y").first().tau == 1.0


def test_auc_by_ranges(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(40) * 1.0, rng.randrange(2)) for _ in range(300)]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert metrics.auc(spark.createDataFrame(rows, "s double, y int"), "s", "y").first().auc == pytest.approx(want)


def test_silhouette_equals_pairs(spark):
    x = low_rank(80)
    x[3] = 0
    own = [i % 4 if i != 9 else 7 for i in range(80)]
    own[11] = -1
    df = table_of(spark, x)
    got = {r.id: r.silhouette for r in cluster.silhouette(df, spark.createDataFrame(list(enumerate(own)), "id long, cluster long")).collect()}
    norm = np.linalg.norm(x, axis=1)
    d = 1 - np.divide(x @ x.T, np.outer(norm, norm), out=np.zeros((80, 80)), where=np.outer(norm, norm) > 0)
    for i in range(80):
        if own[i] == -1:
            assert i not in got
            continue
        means = {c: np.mean([d[i, j] for j in range(80) if j != i and own[j] == c]) for c in set(own) - {-1} if any(j != i and own[j] == c for j in range(80))}
        mine, rest = means.pop(own[i], None), min(means.values())
        assert got[i] == pytest.approx(0 if mine is None else (rest - mine) / max(rest, mine))
    one = cluster.silhouette(df, df.select("id", F.lit(1).cast("long").alias("cluster"))).collect()
    assert len(one) == 80 and all(r.silhouette == 0 for r in one)


def test_bounded_sums_of_a_hot_user(spark):
    """Steps that meet the bounds, over runs in many tasks."""
    rng = random.Random(3)
    rows = [("hot", i, rng.choice([0.4, -0.3, 0.2, None])) for i in range(900)] + [(f"u{i % 9}", i, rng.choice([0.5, -0.5])) for i in range(100)] + [(None, 1, 0.25)]
    df = spark.createDataFrame(rows, "g string, i long, s double").orderBy(F.xxhash64("i", "g"))
    got = {r.g: (r.value, r.n) for r in learn.bounded_sums(df, "g", ["i"], F.col("s")).collect()}
    for g in {r[0] for r in rows}:
        x, own = 0.0, sorted(((i, s) for h, i, s in rows if h == g), key=lambda r: r[0])
        for _, s in own:
            x = min(1.0, max(-1.0, x + (s or 0.0)))
        assert got[g] == (pytest.approx(x), len(own))


# density trees and topics


def components_of(n, edges):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    return [root(i) for i in range(n)]


def tree_by_hand(d, k=2):
    n = len(d)
    d = np.round(d, 6)
    own = np.where(np.eye(n) > 0, np.inf, d)
    core = np.sort(own, axis=1)[:, k - 1]
    m = np.maximum(np.maximum(d, core[:, None]), core[None, :])
    out, up = [], list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for w, i, j in sorted((m[i, j], i, j) for i in range(n) for j in range(i)):
        if root(i) != root(j):
            up[root(i)] = root(j)
            out.append(w)
    return out, m


@pytest.mark.parametrize("block", [1024, 17])
def test_exact_tree_over_all_pairs(spark, block, monkeypatch):
    """Far groups are tied together, too, whatever the nearest are; one block and many, forests that meet in rounds."""
    monkeypatch.setattr(cluster, "MEETING", 2)
    x = np.concatenate([low_rank(40, seed=1), low_rank(40, seed=2) + 9])
    df = table_of(spark, x)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want, m = tree_by_hand(1 - np.round(u @ u.T, 6))
    got = cluster.exact_tree(df, cluster.vector_distance, block=block).collect()
    assert sorted(r.d for r in got) == pytest.approx(sorted(want), abs=2e-6) and len(got) == 79
    cut = sorted(want)[60]
    i, j = np.nonzero(m <= cut + 1e-9)
    assert components_of(80, [(r.a, r.b) for r in got if r.d <= cut + 1e-9]) == components_of(80, zip(i.tolist(), j.tolist()))
    assert cluster.exact_tree(df.where("id = 1"), cluster.vector_distance).count() == 0


def test_fingerprints_with_missing_spaces(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(30, 5)), rng.normal(size=(30, 3))
    rows = [(i, [float(c) for c in x[i]] if i % 7 else None, [float(c) for c in y[i]] if i % 5 else None) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, E1 array<double>, E7 array<double>")
    w = {"E1": 0.7, "E7": 0.3}
    d = np.ones((30, 30))
    for i in range(30):
        for j in range(30):
            parts = [(w[s], (np.dot(v[i], v[j]) / np.linalg.norm(v[i]) / np.linalg.norm(v[j]) + 1) / 2) for s, v, k in (("E1", x, 7), ("E7", y, 5)) if i % k and j % k]
            if parts:
                d[i, j] = 1 - sum(a * b for a, b in parts) / sum(a for a, _ in parts)
    want, _ = tree_by_hand(d)
    for block in (1024, 8):
        assert sorted(r.d for r in cluster.exact_tree(df, cluster.fingerprint_distance(w), block=block).collect()) == pytest.approx(sorted(want), abs=2e-6)


def test_mates_by_keys_equal_all_pairs(spark):
    rng = random.Random(4)
    weights = {"E1": 1.0, "E5": 1.0, "E7": 1.0, "E8": 0.5, "E11": 0.5, "E2": 0.0}
    rows = [(i, s, rng.choice([-1, 0, 0, 1, 2])) for i in range(60) for s in weights if rng.random() < 0.9] + [(i, "E10", 4) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, space string, cluster long")
    own = {}
    for i, s, c in rows:
        if c >= 0 and s != "E10":
            own.setdefault(i, {})[s] = c
    want = {}
    for i in range(60):
        for j in range(i + 1, 60):
            w = sum(weights[s] for s in own.get(i, {}) if own.get(j, {}).get(s) == own[i][s])
            if w >= 2.5:
                want[i, j] = w
    for block in (4096, 5):
        assert {(r.a, r.b): r.agreement for r in cluster.topic_mates(df, block=block).collect()} == want
    links = [(r.a, r.b) for r in cluster.topic_links(df).collect()]
    assert components_of(60, links) == components_of(60, want) and set(links) <= set(want)


def test_least_sets():
    assert cluster.least_sets({"a": 1.0, "b": 1.0, "c": 0.5, "d": 0.0}, 2.0) == [["a", "b"]]
    assert cluster.least_sets({"a": 1.0, "b": 1.0, "c": 0.5}, 2.5) == [["a", "b", "c"]] and cluster.least_sets({"a": 1.0}, 2.5) == []


def test_a_chained_component_is_parted(spark):
    """All memories chain into one component; one space parts it, its noise leaves, and other topics stay."""
    rows = []
    for i in range(20):
        rows += [(i, "E1", i // 2), (i, "E5", (i + 1) // 2), (i, "E7", 0 if i < 30 else 1)]
    rows += [(i, s, 99) for i in (30, 31) for s in ("E1", "E5", "E7")]
    df = spark.createDataFrame(rows, "id long, space string, cluster long")
    asked = []

    def recluster(ids, space):
        asked.append(space)
        parts = {"E1": F.lit(0), "E5": F.when(F.col("id") < 9, 0).when(F.col("id") < 18, 1).otherwise(-1), "E7": F.lit(0)}
        return ids.select("id", parts[space].cast("long").alias("cluster"))

    got = {r.id: r.topic for r in cluster.synthesized_topics(df, recluster, least=2.0).collect()}
    assert got == {i: 0 for i in range(9)} | {i: 9 for i in range(9, 18)} | {30: 30, 31: 30}
    # of 22 memories, nine are over 2/5 (8): the parts are tried again in every space, in vain
    assert set(asked) == {"E1", "E5", "E7"}
    whole = {r.id: r.topic for r in cluster.synthesized_topics(df, lambda ids, s: ids.select("id", F.lit(-1).alias("cluster")), least=2.0).collect()}
    assert whole == {i: 0 for i in range(20)} | {30: 30, 31: 30}
