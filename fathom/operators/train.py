"""Training by epochs: gradients of losses by batch, summed over executors, and parameters broadcast step by step."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.functions import dense
from fathom.operators.descent import matrix
from fathom.operators.learn import MARGIN, TEMPERATURE
from fathom.operators.tables import written

#: Step, share of the last step's change that is kept, epochs at most, epochs without a better loss until training ends, and what counts as better (fixed values).
RATE, MOMENTUM, EPOCHS, PATIENCE, BETTER = 0.05, 0.9, 50, 5, 1e-4


def info_nce_gradient(p: np.ndarray, q: np.ndarray, x: np.ndarray, y: np.ndarray, temperature: float = TEMPERATURE, margin: float = MARGIN, weight: float = 0.5) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss of a batch of causes x and effects y under projections p and q, and its gradients: cross entropy of each cause's own effect among the batch's,
    plus `weight` times the mean of what the own product lacks of being `margin` over the mean of the others. Projected vectors are scaled to length 1."""
    n = len(x)
    a, b = x @ p, y @ q
    na, nb = (np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-12) for v in (a, b))
    u, v = a / na, b / nb
    s = u @ v.T
    t = s / temperature
    e = np.exp(t - t.max(1, keepdims=True))
    share = e / e.sum(1, keepdims=True)
    own = np.arange(n)
    loss = -np.log(np.maximum(share[own, own], 1e-300)).mean()
    ds = share / (n * temperature)
    ds[own, own] -= 1 / (n * temperature)
    if n > 1:
        gap = s[own, own] - (s.sum(1) - s[own, own]) / (n - 1)
        lacks = margin - gap > 0
        loss += weight * np.maximum(0.0, margin - gap).mean()
        push = np.where(lacks, weight / n, 0.0)
        more = np.repeat((push / (n - 1))[:, None], n, 1)
        more[own, own] = -push
        ds = ds + more
    du, dv = ds @ v, ds.T @ u
    da, db = (du - (du * u).sum(1, keepdims=True) * u) / na, (dv - (dv * v).sum(1, keepdims=True) * v) / nb
    return float(loss), x.T @ da, y.T @ db


def logistic_gradient(w: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean cross entropy of labels y under the last weight plus x times the others, and its gradient."""
    z = x @ w[:-1] + w[-1]
    p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    loss = float((np.logaddexp(0, z) - y * z).mean())
    return loss, np.append(x.T @ (p - y), (p - y).sum()) / len(x)


def _epochs(rows: DataFrame, by: str, start: np.ndarray, part: Callable[[pa.Table, np.ndarray], tuple[float, np.ndarray]], rate: float, epochs: int) -> tuple[np.ndarray, list[float]]:
    """Parameters with the least loss, and each epoch's loss. One step an epoch, against the mean gradient of all batches, weighted by their rows."""
    spark, now = rows.sparkSession, start.copy()
    best, change, losses, worse = (np.inf, start), np.zeros_like(start), [], 0

    def step(shared) -> Callable[[pa.Table], pa.Table]:
        def gradient(own: pa.Table) -> pa.Table:
            loss, g = part(own, shared.value)
            n = float(own.num_rows)
            return pa.table({"at": np.arange(-2, g.size), "x": np.concatenate([[n, n * loss], n * g.ravel()])})

        return gradient

    for _ in range(epochs):
        shared = spark.sparkContext.broadcast(now)
        sums = rows.groupBy(by).applyInArrow(step(shared), "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).toArrow()  # as many numbers as parameters
        if not sums.num_rows:
            return start, []
        order = np.argsort(sums.column("at").to_numpy())
        x = sums.column("x").to_numpy()[order]
        losses.append(float(x[1] / x[0]))
        shared.destroy()
        worse = 0 if losses[-1] < best[0] - BETTER else worse + 1
        if losses[-1] < best[0]:
            best = (losses[-1], now)
        if worse >= PATIENCE:
            break
        change = MOMENTUM * change - rate * (x[2:] / x[0]).reshape(now.shape)
        now = now + change
    return best[1], losses


def train_projections(pairs: DataFrame, cause: str, effect: str, batch: int = 256, width: int | None = None, rate: float = RATE, epochs: int = EPOCHS, seed: int = 5) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(projection of causes, of effects, losses by epoch) from pairs (id, cause, effect): each cause's own effect comes nearest among its batch.

    Pairs are dealt to batches of about `batch` by hash, and stay in them. Batches' gradients are taken where the batches are and summed; the driver
    holds parameters alone. Training ends after PATIENCE epochs without a better loss. Pairs with a null or a vector of another length
    than the first's are left out; without pairs the start is given back.
    """
    sound = pairs.where(F.col("id").isNotNull()).select("id", dense.vec(cause).alias("x"), dense.vec(effect).alias("y")).where("x is not null and y is not null and size(x) > 0")
    first = sound.select(F.size("x").alias("n")).first()
    d = first.n if first else 1
    rows = sound.where((F.size("x") == d) & (F.size("y") == d))
    n = max(1, -(-rows.count() // batch))
    rows = written(rows.withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(n))), "pairs")
    rng = np.random.default_rng(seed)
    k = width or d
    start = np.stack([np.eye(d, k) + 0.01 * rng.normal(size=(d, k)) for _ in range(2)])

    def part(own: pa.Table, w: np.ndarray) -> tuple[float, np.ndarray]:
        loss, dp, dq = info_nce_gradient(w[0], w[1], matrix(own.column("x")), matrix(own.column("y")))
        return loss, np.stack([dp, dq])

    best, losses = _epochs(rows, "batch", start, part, rate, epochs)
    return best[0], best[1], losses


def train_edge_weights(edges: DataFrame, spaces: list[str], label: str, rate: float = 1.0, epochs: int = EPOCHS, batch: int = 8192) -> tuple[dict[str, float], float, list[float]]:
    """(weight of each space, bias, losses): how far each space's similarity speaks for an edge, by logistic regression on edges (a column for each space, label 0/1). Null similarities count as 0; rows without a label are left out."""
    x = F.array(*[F.coalesce(F.col(s).cast("double"), F.lit(0.0)) for s in spaces])
    rows = edges.where(F.col(label).isNotNull()).select(x.alias("x"), F.col(label).cast("double").alias("y"))
    n = max(1, -(-rows.count() // batch))
    rows = written(rows.withColumn("batch", F.pmod(F.monotonically_increasing_id(), F.lit(n))), "edges")
    best, losses = _epochs(rows, "batch", np.zeros(len(spaces) + 1), lambda own, w: logistic_gradient(w, matrix(own.column("x")), own.column("y").to_numpy()), rate, epochs)
    return dict(zip(spaces, best[:-1].tolist(), strict=True)), float(best[-1]), losses


def projected_weight(weights: dict[str, float], bias: float):
    """An edge's weight as the chance that the regression gives it."""
    z = F.lit(bias)
    for s, w in weights.items():
        z = z + w * F.coalesce(F.col(s).cast("double"), F.lit(0.0))
    return 1 / (1 + F.exp(-z))
