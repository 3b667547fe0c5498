"""Gradients against finite differences, and losses that fall."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.operators.train import info_nce_gradient, logistic_gradient, projected_weight, train_edge_weights, train_projections


def differences(f, w, h=1e-6):
    out = np.zeros_like(w)
    for at in np.ndindex(w.shape):
        lo, hi = w.copy(), w.copy()
        lo[at] -= h
        hi[at] += h
        out[at] = (f(hi) - f(lo)) / (2 * h)
    return out


@pytest.mark.parametrize("n", [1, 2, 7])
def test_contrastive_gradient(n):
    rng = np.random.default_rng(n)
    p, q, x, y = rng.normal(size=(4, 3)), rng.normal(size=(4, 3)), rng.normal(size=(n, 4)), rng.normal(size=(n, 4))
    _, dp, dq = info_nce_gradient(p, q, x, y, temperature=0.5)
    assert np.allclose(dp, differences(lambda w: info_nce_gradient(w, q, x, y, temperature=0.5)[0], p), atol=1e-6)
    assert np.allclose(dq, differences(lambda w: info_nce_gradient(p, w, x, y, temperature=0.5)[0], q), atol=1e-6)


def test_logistic_gradient():
    rng = np.random.default_rng(3)
    w, x, y = rng.normal(size=5), rng.normal(size=(20, 4)), rng.integers(0, 2, 20).astype(float)
    assert np.allclose(logistic_gradient(w, x, y)[1], differences(lambda v: logistic_gradient(v, x, y)[0], w), atol=1e-7)


def test_projections_learn_a_rotation(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(240, 6))
    turn = np.linalg.qr(rng.normal(size=(6, 6)))[0]
    y = x @ turn
    rows = [(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))] + [(900, None, [1.0]), (901, [1.0], [1.0])]
    df = spark.createDataFrame(rows, "id long, c array<double>, e array<double>")
    p, q, losses = train_projections(df, "c", "e", batch=80, rate=0.1, epochs=12)
    assert losses[-1] < 0.5 * losses[0]
    u, v = x @ p, y @ q
    u, v = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (u, v))
    before = ((x / np.linalg.norm(x, axis=1, keepdims=True)) @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T).argmax(1)
    assert ((u @ v.T).argmax(1) == np.arange(240)).mean() > 3 * (before == np.arange(240)).mean()
    assert train_projections(df.limit(0), "c", "e")[2] == []


def test_edge_weights(spark):
    rng = np.random.default_rng(2)
    rows = [(float(a), float(b), int(a + 0.2 * rng.normal() > 0.5)) for a, b in rng.random((300, 2))] + [(None, 0.5, None)]
    df = spark.createDataFrame(rows, "E1 double, E5 double, y int")
    weights, bias, losses = train_edge_weights(df, ["E1", "E5"], "y", rate=2.0, epochs=15, batch=100)
    assert weights["E1"] > 1 and abs(weights["E5"]) < 0.5 * weights["E1"] and losses[-1] < losses[0] == pytest.approx(np.log(2))
    near, far = (df.where(F.col("y") == k).agg(F.avg(projected_weight(weights, bias))).first()[0] for k in (1, 0))
    assert near > far
