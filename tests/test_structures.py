"""What has no SQL, against brute force: indexes, trees, hypervectors, walks, components, merged topics, stores."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.functions import encode
from fathom.operators import cluster, context, encoders, graph, metrics, sparse, text
from fathom.operators.index import ListIndex
from fathom.sources.tables import EdgeStore, MemoryStore
from fathom.streaming import jobs

T0 = dt.datetime(2024, 1, 1)


def vectors(spark, n, d=8, seed=0, groups=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * (0.2 if groups else 1) + (rng.normal(size=(groups, d))[np.arange(n) % groups] * 2 if groups else 0)
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>"), x


def test_index_recall_and_exactness(spark):
    df, x = vectors(spark, 3000, 16, groups=20)
    index = ListIndex.build(df, "id", "v", lists=30)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hits = 0
    for i in range(0, 3000, 300):
        want = np.lexsort((np.arange(3000), -np.round((u @ u[i] + 1) / 2, 6)))[:10]
        assert [r.id for r in index.search(x[i].tolist(), 10, probe=30).orderBy("rank").collect()] == want.tolist()
        hits += len({r.id for r in index.search(x[i].tolist(), 10, probe=6).collect()} & set(want.tolist()))
    assert hits / 100 >= 0.9
    assert ListIndex.build(df.limit(0), "id", "v").search([1.0] * 16, 3).count() == 0


def test_index_graph_recall(spark):
    df, x = vectors(spark, 2000, 16, groups=20)
    got: dict[int, set[int]] = {}
    for r in ListIndex.build(df, "id", "v", spill=3, lists=20).knn_graph(5, block=300).collect():
        got.setdefault(r.a, set()).add(r.b)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = np.argsort(-s, axis=1)[:, :5]
    assert sum(len(got[i] & set(want[i].tolist())) for i in range(2000)) / 10_000 >= 0.9


@pytest.mark.parametrize("few", [True, False])
def test_spanning_forest_and_gap(spark, few, monkeypatch):
    monkeypatch.setattr(cluster, "ONE_TASK_NODES", 1_000_000 if few else 0)
    rng = random.Random(3)
    edges = [(i, j, round(rng.random(), 2)) for i in range(25) for j in range(i + 1, 25) if rng.random() < 0.25 and (i < 15) == (j < 15)]
    up = list(range(25))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    want = []
    for a, b, d in sorted(edges, key=lambda e: (e[2], e[0], e[1])):
        if root(a) != root(b):
            up[root(a)] = root(b)
            want.append((a, b, d))
    tree = cluster.spanning_tree(spark.createDataFrame(edges, "a long, b long, d double").repartition(5))
    assert sorted((r.a, r.b, r.d) for r in tree.collect()) == sorted(want)
    ds = sorted(d for *_, d in want)
    gap, at = max((round(y - x, 12), -x) for x, y in zip(ds, ds[1:]))
    assert cluster.gap_threshold(tree) == pytest.approx(max(0.03, -at if gap >= 0.02 else np.percentile(ds, 75)))


def test_density_clusters_find_groups(spark):
    df, x = vectors(spark, 120, 8, seed=5, groups=4)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    d = 1 - u @ u.T
    np.fill_diagonal(d, 9)
    rows = [(i, int(j), float(d[i, j]), k + 1) for i in range(120) for k, j in enumerate(np.argsort(d[i])[:15])]
    near = spark.createDataFrame(rows, "a long, b long, d double, rank int")
    tree = cluster.spanning_tree(cluster.mutual_reachability(near, cluster.core_distances(near)))
    got = {r.id: r.cluster for r in cluster.cut_clusters(df, tree, 0.3).collect()}
    assert len({got[i] for i in range(120)} - {-1}) == 4 and all(got[i] == got[i % 4] for i in range(120) if got[i] != -1)


def test_topic_mates_of_large_clusters(spark):
    rows = [(i, s, i % 2) for i in range(90) for s in ("E1", "E5", "E7")]
    df = spark.createDataFrame(rows, "id long, space string, cluster long")
    whole, dealt = (sorted(tuple(r) for r in cluster.topic_mates(df, block=b).collect()) for b in (4096, 7))
    assert whole == dealt == sorted((i, j, 3.0) for i in range(90) for j in range(i + 1, 90) if i % 2 == j % 2)


def test_merged_topics(spark):
    profiles = spark.createDataFrame([(1, "E1", 1.0), (2, "E1", 0.9), (2, "E5", 0.1), (3, "E7", 1.0)], "topic long, space string, strength double")
    sizes = spark.createDataFrame([(1, 5), (2, 9), (3, 2)], "topic long, n long")
    assert {r.topic: r.into for r in cluster.merged_topics(profiles, sizes).collect()} == {1: 2, 2: 2, 3: 3}


def bits_by_hand(text, n=3):
    """Plain loops over the published steps, with whole numbers."""
    def char(c):
        state, out = (0xDEADBEEFCAFEBABE + ord(c)) % 2**64, []
        for _ in range(10_000):
            state = (state * 6364136223846793005 + 1) % 2**64
            out.append(state >> 63)
        return out

    if not text:
        return [0] * 10_000
    n = min(n, len(text))
    grams = []
    for i in range(len(text) - n + 1):
        own = char(text[i])
        for k in range(1, n):
            c = char(text[i + k])
            own = [x ^ c[(j + k) % 10_000] for j, x in enumerate(own)]
        grams.append(own)
    half = len(grams) // 2
    return grams[0] if len(grams) == 1 else [int((s := sum(g[j] for g in grams)) > half or (s == half and grams[0][j])) for j in range(10_000)]


def test_hypervectors_equal_plain_loops(spark):
    texts = ["", "a", "ab", "abc", "abcd", "banana", "über ü", "a typo here"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "id long, t string")
    rows = {r.id: r for r in encoders.hypervectors(docs, "id", "t").collect()}
    for i, t in enumerate(texts):
        want = bits_by_hand(t)
        assert rows[i].ones == sum(want) and np.unpackbits(np.frombuffer(rows[i].code, np.uint8), bitorder="little")[:10_000].tolist() == want
        v = np.array([2 * np.mean(want[k * 10_000 // 1024 : (k + 1) * 10_000 // 1024]) - 1 for k in range(1024)])
        assert np.allclose(rows[i].vector, v / np.linalg.norm(v))
    assert rows[len(texts)].ones == 0


def test_depth_first_order(spark):
    rng = random.Random(4)
    edges = sorted({(rng.randrange(12), rng.randrange(12)) for _ in range(40)})
    after = {a: [y for x, y in edges if x == a] for a in range(12)}
    order, seen, stack = [], set(), [(0, 0)]
    while stack:
        at, depth = stack.pop()
        if at not in seen:
            seen.add(at)
            order.append((at, depth))
            stack += [(b, depth + 1) for b in reversed(after[at])] if depth < 4 else []
    df = spark.createDataFrame(edges, "a long, b long")
    assert [(r.id, r.depth) for r in graph.depth_first(df, 0, 4).orderBy("place").collect()] == order
    assert graph.depth_first(df, 99, 4).count() == 1
    with pytest.raises(ValueError):
        graph.depth_first(df, 0, 4, most=1)


def test_components_of_a_random_graph(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    label = list(range(60))
    for _ in range(60):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.id: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: label[i] for i in {x for a, b in edges if a != b for x in (a, b)}}


def test_kendall_by_blocks(spark):
    rng = np.random.default_rng(8)
    x, y = rng.integers(0, 20, 70), rng.integers(0, 20, 70)
    df = spark.createDataFrame([(i, float(x[i]), float(y[i])) for i in range(70)], "id long, x double, y double")
    want = sum(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i in range(70) for j in range(i)) / (70 * 69 / 2)
    assert [metrics.kendall(df, "x", "y", "id", block=b).first().tau for b in (4096, 9)] == pytest.approx([want] * 2)


def test_budget_by_category(spark):
    rows = [(1, i, t, c) for i, (t, c) in enumerate([(250, "divergence"), (290, "single"), (20, "single"), (500, "cluster"), (190, "session"), (20, "session"), (100, "divergence")])]
    df = spark.createDataFrame(rows, "g int, id long, t long, c string")
    assert sorted(r.id for r in context.budget(df, "g", [F.col("id")], "t", category="c").collect()) == [0, 1, 3, 5, 6]
    assert context.budgets(600)["single"] == 150


def test_text_rules(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(text.intent(F.lit("It is not due to what you think"))) == "unknown" and one(text.intent(F.lit("diagnose the root cause"))) == "cause"
    assert one(text.keywords(F.lit("Über the e-mail of A_b, e-mail x"))) == ["über", "e-mail", "a_b"]
    assert one(text.code_language(F.lit("SELECT * FROM users WHERE id = 1 JOIN orders"))) == "sql" and one(text.code_language(F.lit("hello world"))) is None
    assert one(text.expanded(F.lit("what happens"), F.lit("effect"))) == "what happens" and one(text.expanded(F.lit("broken"), F.lit("cause"))) == "broken cause reason root source"
    assert one(text.graph_intent(F.lit("what imports this"))) == "source" and one(text.domain(F.lit("fn x() impl y"))) == "code"
    assert one(text.lexical_boost(F.lit("std::vec in v1.2 of HTTP server"))) == pytest.approx(2.0)


def test_inverted_index(spark):
    post = spark.createDataFrame([(1, "a", 3.0), (1, "b", 4.0), (2, "a", 1.0)], "id long, term string, w double")
    index = sparse.InvertedIndex(post)
    idf = np.log((2 - 2 + 0.5) / (2 + 0.5) + 1)
    assert {r.id: r.score for r in index.search({"a": 2.0}).collect()} == pytest.approx({1: 2 * 0.6 * idf, 2: 2 * idf})
    assert [r.id for r in index.remove(spark.createDataFrame([(1,)], "id long")).search({"a": 2.0}).collect()] == [2]
    assert {(r.a, r.b): r.dot for r in sparse.pair_dots(post, post).collect()} == {(1, 2): 3.0, (2, 1): 3.0}
    with pytest.raises(ValueError):
        index.add(spark.createDataFrame([(9, "z", 0.0)], "id long, term string, w double"))


def test_stored_spaces(spark):
    df = spark.createDataFrame([([0.5, -1.0, 0.25, 0.1],)], "v array<double>")
    assert df.select(encode.stored("E9", "v").alias("x")).first().x == [1.0, 0.0, 1.0, 1.0] and df.select(encode.stored("E6", "v").alias("x")).first().x == [0.5, -1.0, 0.25, 0.1]
    assert df.select(encode.stored("E12", "v", 2).alias("x")).first().x == [0.5, -1.0] and df.select(encode.stored("E1", "v").alias("x")).first().x[1] == -127.0


def test_stores(spark, tmp_path):
    import os

    store = MemoryStore(spark, str(tmp_path / "m"))
    assert store.memories().count() == 0 and not os.path.exists(tmp_path / "m")  # reading writes nothing
    store.store(spark.createDataFrame([(1, "a", 0.5, T0), (1, "b", 0.5, T0 + dt.timedelta(days=1)), (2, "c", 0.5, T0)], "id long, content string, importance double, created_at timestamp"))
    store.forget(spark.createDataFrame([(2,)], "id long"), "2024-01-05 00:00:00")
    store.checkpoint(str(tmp_path / "cp"))
    again = MemoryStore(spark, str(tmp_path / "n")).restore(str(tmp_path / "cp"))
    assert [r.content for r in again.memories().collect()] == ["b"] and again.trail().count() == 3
    assert [r.content for r in store.compact(str(tmp_path / "c")).memories().collect()] == ["b"]
    with pytest.raises(ValueError):
        again.restore(str(tmp_path / "cp"))
    edges = EdgeStore(spark, str(tmp_path / "e"))
    assert edges.edges().count() == 0
    edges.put(spark.createDataFrame([(1, 2, "x", 0.5, T0), (1, 3, "y", 0.6, T0)], "a long, b long, kind string, weight double, at timestamp"))
    edges.put(spark.createDataFrame([(1, 2, "x", 0.9, T0 + dt.timedelta(hours=1))], "a long, b long, kind string, weight double, at timestamp"))
    edges.delete(spark.createDataFrame([(1, 3, "y", T0 + dt.timedelta(hours=2))], "a long, b long, kind string, at timestamp"))
    assert [(r.b, r.weight) for r in edges.outgoing(1).collect()] == [(2, 0.9)] and edges.incoming(2).count() == 1 and edges.of_kind("y").count() == 0


def test_background_builders(spark, tmp_path):
    rows = spark.createDataFrame([(i,) for i in range(12)], "id long")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    build = jobs.EdgeBuilder(lambda: rows, lambda new, every: new.select(F.col("id").alias("a")).crossJoin(every.select(F.col("id").alias("b"))).where("a < b"), str(tmp_path / "out"))
    jobs.maintain(stream, str(tmp_path / "cp1"), build).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out/edges")).count() == 66
    jobs.maintain(stream, str(tmp_path / "cp2"), jobs.Reclusterer(lambda: rows, str(tmp_path / "cl"), every=10)).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "cl/clusters")).count() == 12
