"""Tucker decomposition of rows that are matrices (spaces by dimensions): two shared factors, and a small core for each row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions import dense
from fathom.operators.descent import matrix


def _summed(df: DataFrame, column: str, shape: tuple[int, int], width: int, part) -> np.ndarray:
    """Sum over all rows of part(stack of matrices), a square of `width`: summed in tasks, width**2 numbers each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                total += part(matrix(batch.column(0)).reshape(-1, *shape))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], names=["at", "x"])

    rows = df.select(column).mapInArrow(run, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).toArrow()
    out = np.zeros(width * width)
    out[rows.column("at").to_numpy()] = rows.column("x").to_numpy()
    return out.reshape(width, width)


def _leading(gram: np.ndarray, rank: int) -> np.ndarray:
    """The leading eigenvectors, largest first, each with its largest component positive."""
    _, v = np.linalg.eigh(gram)
    v = v[:, ::-1][:, :rank]
    return v * np.sign(v[np.abs(v).argmax(0), np.arange(rank)])


def tucker_factors(df: DataFrame, column: str, shape: tuple[int, int], ranks: tuple[int, int], rounds: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(U, V): orthonormal factors (shape[0] x ranks[0], shape[1] x ranks[1]) that keep most of all rows' matrices X, as U'XV.

    Gram matrices of both modes are summed on executors; after a start from those of the rows as they are, each round takes one mode's from the rows
    projected by the other's factor (orthogonal iteration). Rows are arrays of shape[0] * shape[1] numbers, row by row; nulls and other lengths are left out.
    """
    rows = df.where(F.col(column).isNotNull()).select(dense.vec(column).alias("x")).where((F.size("x") == shape[0] * shape[1]) & ~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    left, right = min(ranks[0], shape[0]), min(ranks[1], shape[1])
    v = _leading(_summed(rows, "x", shape, shape[1], lambda x: np.einsum("nij,nik->jk", x, x)), right)
    u = np.eye(shape[0])[:, :left]
    for _ in range(rounds):
        u = _leading(_summed(rows, "x", shape, shape[0], lambda x, v=v: np.einsum("nij,nkj->ik", y := x @ v, y)), left)
        v = _leading(_summed(rows, "x", shape, shape[1], lambda x, u=u: np.einsum("nij,nik->jk", y := u.T @ x, y)), right)
    return u, v


def tucker_core(column: Column | str, shape: tuple[int, int], u: np.ndarray, v: np.ndarray) -> Column:
    """U'XV of a row, row by row: one product with a literal matrix of the core's size times the row's."""
    both = np.einsum("ia,jb->abij", u, v).reshape(u.shape[1] * v.shape[1], shape[0] * shape[1])
    return F.transform(F.lit(both.tolist()).cast("array<array<double>>"), lambda row: dense.dot(row, dense.vec(column)))


def core_similarity(a: Column | str, b: Column | str) -> Column:
    """Cosine of two cores; the rows' own where the factors keep all."""
    return dense.cosine(a, b)
