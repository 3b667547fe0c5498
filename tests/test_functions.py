"""Hand-computed cases of expressions and operators."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.functions import dense, encode, sets, temporal
from fathom.functions.profiles import PROFILES, SPACES, resolve, validate
from fathom.operators import cluster, context, curate, fuse, graph, metrics, retrieve, text


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()[0]


def arr(*x):
    return F.array(*[F.lit(float(v)) for v in x])


def test_cos01_cases(spark):
    assert one(spark, dense.cos01(arr(1, 2), arr(1, 2))) == pytest.approx(1)
    assert one(spark, dense.cos01(arr(1, 0), arr(0, 1))) == pytest.approx(0.5)
    assert one(spark, dense.cos01(arr(1, 0), arr(-1, 0))) == pytest.approx(0)
    assert one(spark, dense.cos01(arr(0, 0), arr(1, 0))) == 0
    assert one(spark, dense.cos01(arr(1), arr(1, 0))) == 0


def test_checked_cosine_raises(spark):
    with pytest.raises(Exception, match="norm zero"):
        one(spark, dense.checked_cosine(arr(0, 0), arr(1, 0)))


def test_transe_and_hamming(spark):
    assert one(spark, dense.transe_similarity(arr(1, 1), arr(1, 1))) == 1
    assert one(spark, dense.transe_similarity(arr(0), arr(1))) == 0.5
    assert one(spark, dense.transe_score(arr(1), arr(2), arr(3))) == 0
    assert one(spark, dense.hamming_similarity(F.array(F.lit(1), F.lit(0)), F.array(F.lit(1), F.lit(1)))) == 0.5


def test_distances(spark):
    assert one(spark, dense.similarity_of(dense.distance(arr(1, 0), arr(1, 0), "cosine"), "cosine")) == 1
    assert one(spark, dense.similarity_of(dense.distance(arr(0), arr(1), "dot"), "dot")) == 0.5
    with pytest.raises(ValueError):
        dense.distance(arr(1), arr(1), "maxsim")


def test_maxsim(spark):
    q, d = dense.tokens(arr(1, 0, 0, 1), 2), dense.tokens(arr(1, 0, 1, 0), 2)
    assert one(spark, dense.maxsim(q, d)) == pytest.approx(0.75)
    assert one(spark, dense.maxsim(q, d, shifted=False)) == pytest.approx(0.5)
    assert one(spark, dense.maxsim_symmetric(q, d)) == pytest.approx((0.75 + 1.0) / 2)


def test_hyperbolic_round_trip(spark):
    assert np.allclose(one(spark, dense.log_map(dense.exp_map(arr(0.3, -0.2)))), [0.3, -0.2])
    assert one(spark, dense.poincare_distance(arr(0, 0), arr(0.5, 0))) == pytest.approx(2 * math.atanh(0.5))
    assert np.allclose(one(spark, dense.mobius_add(arr(0.1, 0.2), arr(0, 0))), [0.1, 0.2])


def test_recency(spark):
    age = F.lit(3600.0)
    assert one(spark, temporal.multi_scale(age)) == pytest.approx(0.4 * 0.5 + 0.35 * 2 ** (-1 / 24) + 0.25 * 2 ** (-1 / 168))
    for seconds, value in ((300, 1.0), (3600, 0.8), (86400, 0.5), (604800, 0.3), (604801, 0.1)):
        assert one(spark, temporal.step(F.lit(float(seconds)))) == value


def test_periodic(spark):
    at = F.lit(dt.datetime(2024, 1, 1, 1))
    assert one(spark, temporal.periodic(at, 23)) == pytest.approx(1 - 2 / 12)
    assert one(spark, temporal.periodic(at)) == 0.5


def test_rrf_terms(spark):
    ranked = spark.createDataFrame([("E1", 1, 0.9, 1), ("E1", 2, 0.5, 10)], "space string, id long, score double, rank int")
    got = {r.id: r.score for r in fuse.rrf(ranked, {"E1": 1.0}).collect()}
    assert got[1] == pytest.approx(1 / 61) and got[2] == pytest.approx(1 / 70)


def test_profiles():
    for name in PROFILES:
        assert sum(resolve(name).values()) == pytest.approx(1)
    assert "E11" not in resolve("fact_checking", without_e11=True)
    with pytest.raises(ValueError):
        resolve(custom={"E1": 0.0})
    with pytest.raises(ValueError):
        validate(dict.fromkeys(SPACES, 0.5))


def test_blind_spot_slots(spark):
    main = spark.createDataFrame([(i, 1 - i / 100, i + 1) for i in range(20)], "id long, score double, rank int")
    other = spark.createDataFrame([(100 + i, 0.5) for i in range(5)], "id long, score double")
    for k, slots in ((10, 2), (3, 1), (1, 1)):
        rows = fuse.blind_spots(main, other, k).collect()
        assert len(rows) == k and sum(r.origin == "discovery" for r in rows) == slots


def test_typed_edge_weight(spark):
    pairs = spark.createDataFrame([("E1", 1, 2, 0.9), ("E5", 2, 1, 0.9), ("E8", 1, 2, 0.9), ("E1", 1, 3, 0.9)], "space string, a long, b long, score double")
    rows = graph.typed_edges(pairs).collect()
    assert [(r.a, r.b, r.agreement, r.edge_type, r["mask"]) for r in rows] == [(1, 2, 2.5, "causal_chain", 1 + 16 + 128)]
    assert rows[0].weight == pytest.approx(2.5 / 8.5)


def test_graph_walks(spark):
    edges = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.8), (1, 3, 0.5), (4, 5, 1.0)], "a long, b long, weight double")
    start = spark.createDataFrame([(1,)], "id long")
    assert {(r.id, r.depth) for r in graph.bfs(edges, start, 3).collect()} == {(1, 0), (2, 1), (3, 1)}
    assert graph.shortest_path(edges, 1, 3, 5) == [1, 3] and graph.shortest_path(edges, 1, 5, 5) == []
    assert {r.id: round(r["product"], 6) for r in graph.best_products(edges, 1, 3).collect()} == {1: 1.0, 2: 0.9, 3: 0.72}
    assert {r.id: r.label for r in graph.components(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}


def test_components_of_a_long_path(spark):
    edges = spark.range(60).selectExpr("id as a", "id + 1 as b")
    assert {r.label for r in graph.components(edges).collect()} == {0}


def test_spanning_tree_and_cut(spark):
    points = {0: 0.0, 1: 0.1, 2: 0.2, 3: 5.0, 4: 5.1, 5: 5.2, 6: 20.0}
    rows = [(a, b, abs(points[a] - points[b])) for a in points for b in points if a < b]
    tree = cluster.spanning_tree(spark.createDataFrame(rows, "a long, b long, d double"))
    assert tree.count() == 6
    nodes = spark.createDataFrame([(k,) for k in points], "id long")
    got = {r.id: r.cluster for r in cluster.cut_clusters(nodes, tree, 1.0).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 6: -1}


def test_churn_and_entropy(spark):
    s = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, cluster.churn(s("a", "b", "c"), s("b", "c", "d"))) == 0.5
    assert cluster.entropy(spark.createDataFrame([(2,), (2,)], "n long")).first()[0] == 1.0
    assert cluster.entropy(spark.createDataFrame([(2,)], "n long")).first()[0] is None


def test_hash_chain_breaks(spark):
    rows = spark.createDataFrame([("d", i, f"x{i}") for i in range(4)], "doc string, seq int, body string")
    chain = curate.hash_chain(rows, "doc", "seq", ["body"])
    assert curate.verify_chain(chain, "doc", "seq", ["body"]).first().broken == 0
    bad = chain.withColumn("body", F.when(F.col("seq") == 2, "changed").otherwise(F.col("body")))
    assert curate.verify_chain(bad, "doc", "seq", ["body"]).first().broken == 1


def test_close_in_time_equals_all_pairs(spark):
    base = dt.datetime(2024, 1, 1)
    rng = np.random.default_rng(0)
    times = [base + dt.timedelta(hours=float(h)) for h in rng.uniform(0, 200, 60)]
    rows = spark.createDataFrame([(i, "g", t) for i, t in enumerate(times)], "id long, g string, ts timestamp")
    got = {(r.a, r.b) for r in curate.close_in_time(rows, "id", "ts", ["g"]).collect()}
    assert got == {(i, j) for i in range(60) for j in range(i + 1, 60) if abs((times[i] - times[j]).total_seconds()) < 86400}


def test_chunks(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(460))), (2, ""), (3, None)], "doc_id long, text string")
    assert [(r.start_word, r.end_word) for r in text.chunks(docs).orderBy("chunk").collect()] == [(0, 200), (150, 350), (300, 460)]
    words = [f"w{i}" + ("." if i == 180 else "") for i in range(300)]
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    assert [(r.start_word, r.end_word) for r in text.sentence_chunks(docs).orderBy("chunk").collect()] == [(0, 181), (131, 300)]


def test_intent(spark):
    assert one(spark, text.intent(F.lit("why did it fail"))) == "cause"
    assert one(spark, text.intent(F.lit("what is the impact of it"))) == "effect"
    assert one(spark, text.intent(F.lit("not because"))) == "unknown"


def test_token_estimate_and_budget(spark):
    assert one(spark, context.token_estimate(F.lit("a b c d e f g h i j"))) == 13
    rows = spark.createDataFrame([("g", 1, 700), ("g", 2, 600), ("g", 3, 400)], "g string, id long, t long")
    assert {r.id for r in context.budget(rows, "g", [F.col("id")], "t").collect()} == {1, 3}


def test_metrics(spark):
    ranked = spark.createDataFrame([(0, 1, 1), (0, 2, 0), (0, 3, 1)], "query_id int, rank int, relevant int")
    row = metrics.at_k(ranked, spark.createDataFrame([(0, 2)], "query_id int, n_relevant long"), 3).first()
    assert row.precision == pytest.approx(2 / 3) and row.recall == 1 and row.rr == 1
    assert row.ndcg == pytest.approx((1 + 0.5) / (1 + 1 / math.log2(3))) and row.ap == pytest.approx((1 + 2 / 3) / 2)


def test_float8_grid(spark):
    assert one(spark, encode.float8(arr(0, 1, 1.06, 500, -0.3))) == [0.0, 1.0, 1.0, 448.0, -0.3125]


def test_trigrams_and_sets(spark):
    assert sorted(one(spark, sets.trigrams(F.lit("abcab")))) == ["abc", "bca", "cab"]
    assert one(spark, sets.jaccard(F.array(), F.array())) == 0


def test_theta_pairs_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 6))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    got = {(r.a, r.b) for r in retrieve.theta_pairs(df, "id", "v", retrieve.matrix_cosine, lambda s: s > 0.5, block=16).collect()}
    c = retrieve.matrix_cosine(x, x)
    assert got == {(i, j) for i in range(50) for j in range(i + 1, 50) if c[i, j] > 0.5}
    best = {(r.a, r["rank"]): r.b for r in retrieve.theta_pairs(df, "id", "v", retrieve.matrix_cosine, best=3, block=16).collect()}
    np.fill_diagonal(c, -9)
    assert all(best[i, k + 1] == np.argsort(-c[i])[k] for i in range(50) for k in range(3))
