"""Candidate retrieval: k nearest in a space, rankings of several spaces in long form, sparse recall, late interaction."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions import dense
from fathom.operators.tables import written


def one_vector(df: DataFrame, where: Column | str, vector: str = "embedding") -> Column:
    """The vector of the first row that meets a condition, as a literal: one row comes to the driver. LookupError without such a row."""
    row = df.where(where).select(F.col(vector).cast("array<double>")).first()
    if row is None or row[0] is None:
        raise LookupError("no such vector")
    return F.lit([float(x) for x in row[0]]).cast("array<double>")


def knn(df: DataFrame, score: Column, k: int, key: str, least: float | None = None, digits: int = 6) -> DataFrame:
    """(id, score, rank): the k best rows by score, then id. Each task keeps k rows, so nothing but those is shuffled."""
    rows = df.select(F.col(key).alias("id"), F.round(score, digits).alias("score")).where("id is not null and score is not null")
    if least is not None:
        rows = rows.where(F.col("score") >= least)
    top = rows.orderBy(F.desc("score"), "id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def rankings(df: DataFrame, scores: dict[str, Column], k: int, key: str, least: float | None = None) -> DataFrame:
    """(space, id, score, rank): the k best of each space. What fusion, agreement and anomalies work on; spaces * k rows."""
    parts = [knn(df, score, k, key, least).select(F.lit(space).alias("space"), "id", "score", "rank") for space, score in scores.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def slices_of(vector: str | Column, spaces: dict[str, tuple[int, int]]) -> dict[str, Column]:
    """Parts of a vector as spaces: start (from 1) and width."""
    return {s: F.slice(dense.vec(vector), lo, width) for s, (lo, width) in spaces.items()}


def domain_adjusted(score: Column, match: Column, net: float) -> Column:
    """score * (1 + net + 0.1 for the query's own domain), within 0..1."""
    return dense.clamp(score * (1 + net + F.when(match, 0.1).otherwise(0.0)))


def grid(rows: DataFrame, block: int, half: bool) -> tuple[DataFrame, int]:
    """rows (id and more) dealt to a square of cells, with part (0 or 1: first or second of a pair) and cell, and the square's side.

    Each row goes once to every cell of its row and its column, by hash; half: only to cells of a lesser or equal with a greater block, where
    each unordered pair is met once. A cell holds two blocks of about `block` rows.
    """
    side = max(1, -(-rows.count() // block))
    dealt = rows.withColumn("g", F.pmod(F.xxhash64("id"), F.lit(side)).cast("int"))
    last = F.lit(side - 1)
    left = dealt.withColumn("h", F.explode(F.sequence(F.col("g") if half else F.lit(0), last))).withColumn("part", F.lit(0)).withColumn("cell", F.col("g") * side + F.col("h"))
    right = dealt.withColumn("h", F.explode(F.sequence(F.lit(0), F.col("g") if half else last))).withColumn("part", F.lit(1)).withColumn("cell", F.col("h") * side + F.col("g"))
    return left.unionByName(right).drop("g", "h"), side


def best_of(a: np.ndarray, b: np.ndarray, found: np.ndarray, k: int, digits: int = 6, loops: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, score) of each a's k largest scores, by score, then b; its own id left out, unless loops (a and b are ids of different things)."""
    found = np.round(found, digits)
    if not loops:
        found = np.where(a[:, None] == b[None, :], -np.inf, found)
    n = min(k, len(b))
    order = np.lexsort((np.broadcast_to(b, found.shape), -found), axis=1)[:, :n]
    i, j = np.repeat(np.arange(len(a)), n), order.ravel()
    real = np.isfinite(found[i, j])
    i, j = i[real], j[real]
    return a[i], b[j], found[i, j]


def nearest_of(queries: DataFrame, df: DataFrame, key: str, vector: str, compare: Callable[[np.ndarray, np.ndarray], np.ndarray], k: int, block: int = 4096, digits: int = 6, loops: bool = False) -> DataFrame:
    """(a, b, score, rank): for each row of queries (a) the k best rows of df (b), its own id left out (unless loops), by score, then id.

    Both sides are dealt by hash to blocks of about `block` rows. Each pair of blocks meets in one task as one matrix product and
    leaves k rows for each of its queries; neither side is broadcast, whatever its size.
    """
    own = lambda t: t.select(F.col(key).cast("long").alias("id"), dense.vec(vector).alias("vec")).where("id is not null and vec is not null")
    q, rows = own(queries), own(df)
    nq, nr = (max(1, -(-t.count() // block)) for t in (q, rows))
    cell = lambda t, n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = q.withColumn("g", cell(q, nq)).withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(nr - 1)))).withColumn("part", F.lit(0))
    right = rows.withColumn("h", cell(rows, nr)).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(nq - 1)))).withColumn("part", F.lit(1))

    def meet(held: pa.Table) -> pa.Table:
        part, ids = held.column("part").to_numpy(), held.column("id").to_numpy()
        if part.all() or not part.any():
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        x = np.stack(held.column("vec").to_pandas().to_numpy())
        found = best_of(ids[part == 0], ids[part == 1], compare(x[part == 0], x[part == 1]), k, digits, loops)
        return pa.table(dict(zip(("a", "b", "score"), found, strict=True)))

    pairs = left.unionByName(right).groupBy("g", "h").applyInArrow(meet, "a long, b long, score double")
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b"))).where(F.col("rank") <= k)


def theta_pairs(df: DataFrame, key: str, vector: str, compare: Callable[[np.ndarray, np.ndarray], np.ndarray], keep: Callable[[np.ndarray], np.ndarray] | None = None, best: int = 0, block: int = 2048, target: str | None = None) -> DataFrame:
    """(a, b, score) for pairs of rows: those that `keep` accepts, with a < b, or the `best` of each a (both directions).

    Rows are dealt to a square grid of blocks by hash, each row once to every cell of its row and its column: a task holds two
    blocks of about `block` vectors, whatever the input, and scores them with one matrix product. Only kept pairs leave it. Without
    `best` a block meets only those of its number or a greater one, and rows go to half of the cells. target: another vector for the second of a pair.
    """
    rows = df.select(F.col(key).alias("id"), dense.vec(vector).alias("vec"), dense.vec(target or vector).alias("other")).where("id is not null and vec is not null and other is not null")
    both, side = grid(rows, block, half=not best)

    def scored(own: pd.DataFrame) -> pd.DataFrame:
        left, right = own[own["part"] == 0], own[own["part"] == 1]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": [], "score": []})
        x, y = np.stack(left["vec"].to_numpy()), np.stack(right["other"].to_numpy())
        a, b = left["id"].to_numpy(), right["id"].to_numpy()
        found = compare(x, y)
        if best:
            return pd.DataFrame(dict(zip(("a", "b", "score"), best_of(a, b, found, best), strict=True)))
        inside = int(own["cell"].iloc[0]) // side == int(own["cell"].iloc[0]) % side
        i, j = np.nonzero(keep(found) & ((a[:, None] < b[None, :]) if inside else (a[:, None] != b[None, :])))
        return pd.DataFrame({"a": np.minimum(a[i], b[j]), "b": np.maximum(a[i], b[j]), "score": found[i, j]})

    pairs = both.groupBy("cell").applyInPandas(scored, "a long, b long, score double")
    if not best:
        return pairs
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b")))
    return ranked.where(F.col("rank") <= best)


def space_best(df: DataFrame, key: str, vector: str, spaces: dict[str, tuple[int, int]], best: int, block: int = 2048) -> DataFrame:
    """(space, a, b, score, rank): the `best` of each row in each space, a part of the vector (start from 1, width), by (cosine + 1) / 2.

    One grid serves all spaces: a cell holds two blocks of vectors and leaves `best` rows for each of its rows and spaces.
    """
    rows = df.select(F.col(key).alias("id"), dense.vec(vector).alias("vec")).where("id is not null and vec is not null")
    cells, _ = grid(rows, block, half=False)

    def scored(own: pa.Table) -> pa.Table:
        part, ids = own.column("part").to_numpy(), own.column("id").to_numpy()
        out = []
        if part.any() and not part.all():
            x = np.stack(own.column("vec").to_pandas().to_numpy())
            for space, (lo, n) in spaces.items():
                y = x[:, lo - 1 : lo - 1 + n]
                a, b, score = best_of(ids[part == 0], ids[part == 1], matrix_cos01(y[part == 0], y[part == 1]), best)
                out.append(pa.table({"space": pa.array([space] * len(a), pa.string()), "a": a, "b": b, "score": score}))
        return pa.concat_tables(out) if out else pa.table({"space": pa.array([], pa.string()), "a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    pairs = cells.groupBy("cell").applyInArrow(scored, "space string, a long, b long, score double")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("space", "a").orderBy(F.desc("score"), "b")))
    return ranked.where(F.col("rank") <= best)


def matrix_cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    nx, ny = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
    n = nx[:, None] * ny[None, :]
    return np.divide(x @ y.T, n, out=np.zeros((len(x), len(y))), where=n > 0)


def matrix_cos01(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (matrix_cosine(x, y) + 1) / 2


# Sparse recall


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text", pattern: str = "[^a-z]+", least: int = 1) -> DataFrame:
    """(id, term, tf) from lower-cased text split at the pattern; counted before the shuffle."""
    terms = docs.select(F.col(key).alias("id"), F.explode(F.split(F.lower(text), pattern)).alias("term")).where(F.length("term") >= least)
    return terms.groupBy("id", "term").agg(F.count("*").alias("tf"))


def term_counts(docs: DataFrame, terms: list[str], key: str = "doc_id", text: str = "text", letters: str = "a-z") -> DataFrame:
    """(id, len, t0, t1, ...): words (runs of these letters in lower-cased text) of each document that has any, and how often it has each term. One scan; no word is shuffled. Written, as corpus statistics and scores both read it."""
    # words between two spaces each, so that counting a word is replacing it
    bare = F.trim(F.regexp_replace(F.lower(text), f"[^{letters}]+", "  "))
    rows = docs.select(F.col(key).alias("id"), F.concat(F.lit(" "), bare, F.lit(" ")).alias("t")).where("t != '  '")
    count = lambda w: ((F.octet_length("t") - F.octet_length(F.replace("t", F.lit(w), F.lit("")))) / len(w.encode())).cast("long")
    return written(rows.select("id", (count("  ") + 1).alias("len"), *[count(f" {w} ").alias(f"t{i}") for i, w in enumerate(terms)]), "counts")


def _statistics(counts: DataFrame, n: int) -> list:
    """Mean length and in how many documents each term is: one row to the driver, as long as the query."""
    return list(counts.agg(F.avg("len"), *[F.count_if(F.col(f"t{i}") > 0) for i in range(n)]).first())


def _added(parts: list[Column]) -> Column:
    out = F.lit(0.0)
    for p in parts:
        out = out + p
    return out


def bm25(counts: DataFrame, terms: list[str], n_docs: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) of documents with a term: Okapi with idf ln((N - df + 0.5)/(df + 0.5) + 1), from term_counts."""
    import math

    mean, *df = _statistics(counts, len(terms))
    parts, some = [], F.lit(False)
    for i, d in enumerate(df):
        tf = F.col(f"t{i}")
        idf = math.log((n_docs - d + 0.5) / (d + 0.5) + 1)
        parts.append(F.when(tf > 0, idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / (mean or 1.0)))).otherwise(0.0))
        some = some | (tf > 0)
    return counts.where(some).select("id", _added(parts).alias("score"))


def idf_recall(counts: DataFrame, terms: list[str], n_docs: int) -> DataFrame:
    """(id, score): sum of idf ln((N+1)/(df+1))+1 over the query's terms present; no term frequency."""
    import math

    _, *df = _statistics(counts, len(terms))
    score = _added([F.when(F.col(f"t{i}") > 0, math.log((n_docs + 1) / (d + 1)) + 1).otherwise(0.0) for i, d in enumerate(df)])
    return counts.select("id", score.alias("score")).where("score > 0")


def overlap_recall(counts: DataFrame, terms: list[str]) -> DataFrame:
    """(id, shared): how many of the query's terms a document has."""
    shared = sum(((F.col(f"t{i}") > 0).cast("long") for i in range(len(terms))), F.lit(0).cast("long"))
    return counts.select("id", shared.alias("shared")).where("shared > 0")


def weighted_jaccard(counts: DataFrame, query: dict[str, float]) -> DataFrame:
    """(id, score, matches): sum of least weights over sum of greatest, of documents that share a term with the query."""
    tf = [F.col(f"t{i}") for i in range(len(query))]
    low = _added([F.least(c.cast("double"), F.lit(float(w))) for c, w in zip(tf, query.values(), strict=True)])
    matches = sum(((c > 0).cast("long") for c in tf), F.lit(0).cast("long"))
    # sum of greatest = both sums less the sum of least
    return counts.select("id", (low / (F.col("len") + sum(query.values()) - low)).alias("score"), matches.alias("matches")).where("matches > 0")
