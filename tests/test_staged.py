"""Search in stages, batch search in blocks, late interaction in detail, profiles, alignments and directions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.functions import dense, temporal
from fathom.operators import fuse, retrieve, staged, text


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_nearest_of_equals_brute_force(spark):
    x = np.random.default_rng(3).normal(size=(300, 6))
    x[10] = x[20] = x[30]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (None, [1.0] * 6)], "id long, v array<double>")
    found = {(r.a, r["rank"]): r.b for r in retrieve.nearest_of(df.where("id % 10 = 0"), df, "id", "v", retrieve.matrix_cos01, 4, block=64).collect()}
    s = np.round(retrieve.matrix_cos01(x, x), 6)
    for a in range(0, 300, 10):
        own = [b for b in sorted(range(300), key=lambda b: (-s[a, b], b)) if b != a][:4]
        assert [found[a, n] for n in range(1, 5)] == own
    assert len(found) == 120
    assert retrieve.nearest_of(df.where("id < 0"), df, "id", "v", retrieve.matrix_cos01, 4).count() == 0
    assert retrieve.nearest_of(df.where("id = 10"), df.where("id = 10"), "id", "v", retrieve.matrix_cos01, 4).count() == 0


def test_late_interaction_in_detail(spark):
    q, d = (F.lit(m).cast("array<array<double>>") for m in ([[1.0, 0.0], [0.0, 1.0]], [[1.0, 1.0], [0.0, 2.0], [0.0, 3.0]]))
    none = F.array().cast("array<array<double>>")
    assert [(a.query_token, a.doc_token, round(a.similarity, 6)) for a in one(spark, dense.token_alignments(q, d))] == [(0, 0, 0.707107), (1, 1, 1.0)]
    assert one(spark, dense.token_alignments(q, none)) == [] and one(spark, dense.token_alignments(none, d)) == []
    assert one(spark, dense.maxsim_early(q, d, 0.7)) == pytest.approx(0.5**0.5)  # the first token is near enough to both
    assert one(spark, dense.maxsim_early(q, d, 2.0)) == pytest.approx(one(spark, dense.maxsim(q, d, shifted=False)))
    assert one(spark, dense.maxsim_early(q, none, 0.5)) == 0


def test_profile_match(spark):
    best = lambda s: tuple(one(spark, text.profile_match(F.lit(s).cast("string"))))
    assert best("Debug the Rust code") == ("code_implementation", pytest.approx(0.6))
    assert best("why and how: a study of the cause, explain and research it") == ("research_analysis", 1.0)
    assert best("a poem") == ("creative_writing", pytest.approx(0.2))
    assert best("") == best(None) == ("code_implementation", pytest.approx(0.1))


def test_alignments(spark):
    a = [0.3] * 3 + [0.0] * 3 + [0.6] * 3 + [0.6] * 4
    f = one(spark, fuse.alignment_fusion(F.lit(a)))
    assert f.groups == pytest.approx([0.3, 0.0, 0.6, 0.6]) and f.active == 10
    assert f.confidence == pytest.approx((0.5 * sum(a) / 13 + 0.5 * 1.5 / 4) * 10 / 13)
    with pytest.raises(Exception, match="13 alignments"):
        one(spark, fuse.alignment_fusion(F.lit([0.5] * 12)))
    with pytest.raises(Exception, match="13 alignments"):
        one(spark, fuse.alignment_fusion(F.lit([1.5] + [0.5] * 12)))
    parts = {"E1": F.lit([1.0, 0.0]), "E2": F.lit([1.0, 1.0]), "E3": F.lit([0.001, 1.0])}
    got = {(r.space_a, r.space_b): r.value for r in one(spark, fuse.cross_correlations(parts, {("E1", "E2"): 0.5}))}
    assert got[("E1", "E2")] == pytest.approx(0.5 * 0.5**0.5) and got[("E1", "E3")] == 0 and got[("E2", "E3")] == pytest.approx(0.7078, abs=1e-4)


def test_directions(spark):
    of = lambda own, ms, way, anchor=5: one(spark, temporal.directed(F.lit(0.7), F.lit(own).cast("long"), F.lit(anchor).cast("long"), F.lit(ms), F.lit(100), way))
    assert of(4, 900, "before") == 0.7 and of(6, 1, "before") == 0 and of(6, 1, "after") == 0.7 and of(5, 1, "before") == of(5, 1, "after") == 0
    assert of(None, 99, "before") == 0.7 and of(None, 101, "after") == 0 and of(None, 102, "after") == 0.7 and of(4, 99, "before", None) == 0.7
    assert of(None, 100, "both") == 0.7


def test_staged_search(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 4))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    recalled = spark.createDataFrame([(i, float(i % 3)) for i in range(40)] + [(999, 9.0)], "id long, score double")
    edges = spark.createDataFrame([(i, (i + 7) % 60, 0.3 + (i % 5) / 10) for i in range(60)], "a long, b long, weight double")
    q = x[0]
    cos = lambda u: np.round((u @ q[: u.shape[1]] / np.sqrt((u * u).sum(1) * (q[: u.shape[1]] ** 2).sum()) + 1) / 2, 6)
    prefix, whole = cos(x[:, :2]), cos(x)
    lit = F.lit([float(c) for c in q])
    late = F.col("v")[3]
    got = [r.id for r in staged.staged_search(recalled, rows, dense.cos01(F.slice("v", 1, 2), F.slice(lit, 1, 2)), dense.cos01("v", lit), late, edges, k=5, kept=(30, 12, 6)).collect()]
    terms = sorted(range(40), key=lambda i: (-(i % 3), i))[:30]
    near = sorted(terms, key=lambda i: (-prefix[i], i))[:12]
    fused = {i: round(1 / (61 + terms.index(i)) + 1 / (61 + near.index(i)) + 1 / (61 + sorted(near, key=lambda j: (-whole[j], j)).index(i)), 10) for i in near}
    best = sorted(near, key=lambda i: (-fused[i], i))[:6]
    pool = set(best) | {(i + 7) % 60 for i in best if 0.3 + (i % 5) / 10 >= 0.4}
    # a rank by terms counts among all that terms recalled
    assert got == sorted(pool, key=lambda i: (-round(x[i, 3], 6), i))[:5]
    assert staged.staged_search(recalled.limit(0), rows, dense.cos01("v", lit), dense.cos01("v", lit), late, edges).count() == 0
