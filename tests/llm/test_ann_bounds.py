"""The nearest vectors are found whole on rows that the codebooks fit badly."""

import numpy as np

from fathom.llm.ann import ann_search


def nearest(x, at, k):
    s = np.zeros(len(x))
    for j in range(x.shape[1]):
        s += x[at, j] * x[:, j]
    s[at] = -np.inf
    return [(int(i), float(s[i])) for i in np.lexsort((np.arange(len(x)), -s))[:k]]


def check(spark, x, step, block=None):
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    rows = sorted(ann_search(df, df.where(f"vec_id % {step} = 0"), block=block).collect(), key=lambda r: (r.query_id, r["rank"]))
    for at in range(0, len(x), step):
        assert [(r.vec_id, r.score) for r in rows if r.query_id == at] == nearest(x.astype(np.float64), at, 20)
    assert len(rows) == 20 * len(range(0, len(x), step))


def test_ann_misses_none_of_many_directions(spark):
    """Vectors of many independent components, for which codes say little."""
    check(spark, np.random.default_rng(11).normal(size=(3000, 256)).astype(np.float32), 100, block=700)


def test_ann_misses_none_among_near_copies_and_lengths_far_apart(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(60, 24))[rng.integers(0, 60, 9000)] + 1e-5 * rng.normal(size=(9000, 24))
    check(spark, (x * 10.0 ** rng.integers(-3, 4, (9000, 1))).astype(np.float32), 300)
    check(spark, (1e30 * rng.normal(size=(400, 8))).astype(np.float32), 50)
