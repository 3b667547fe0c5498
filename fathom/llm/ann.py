"""Nearest neighbours: additive quantisation with beam search, lookup tables with bounds of their error, and exact products of what the bounds let through."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.vectors import CANDIDATES, PART, QUERIES, STEP, block_rows, in_blocks, keyed, meet, ranked, usable

#: Full-dimensional codebooks, codewords of each, and partial sums kept by the encoder.
BOOKS, WORDS, BEAM = 24, 256, 4
#: Vectors that codebooks are fitted on at most; all vectors are indexed.
FIT_ROWS = 8192
#: Candidates a query, of those scored at once, beyond which their k-th largest product cuts before sums are taken in order.
SHORTLIST = 300
#: Rows of a block of the index at most; they carry their vectors.
INDEXED = CANDIDATES // 4
#: Candidates whose estimates are summed at once.
LOOKED_UP = 512


def fitted(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 6, seed: int = 7) -> np.ndarray:
    """Codebooks (books, words, dims): k-means on what the books before leave over."""
    rng = np.random.default_rng(seed)
    left, out = x.astype(np.float32), np.zeros((books, words, x.shape[1]), np.float32)
    for m in range(books):
        own = left[rng.permutation(len(left))[:words]]
        own = np.concatenate([own, np.zeros((words - len(own), x.shape[1]), np.float32)]) if len(own) < words else own.copy()
        for _ in range(rounds):
            near = ((own**2).sum(1) - 2 * left @ own.T).argmin(1)
            sums, counts = np.zeros_like(own), np.bincount(near, minlength=words)
            np.add.at(sums, near, left)
            own[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
        left = left - own[((own**2).sum(1) - 2 * left @ own.T).argmin(1)]
        out[m] = own
    return out


def encoded(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes (rows, books) by beam search over sums of one codeword of each book."""
    n, d = x.shape
    left, codes, rows = x.astype(np.float32)[:, None, :], np.zeros((n, 1, 0), np.uint8), np.arange(n)
    for own in books:
        width = left.shape[1]
        # |left - word|^2
        cost = (left.reshape(-1, d) @ (-2 * own.T)).reshape(n, width, -1)
        cost += np.einsum("nwd,nwd->nw", left, left)[:, :, None]
        cost += (own**2).sum(1)
        cost = cost.reshape(n, -1)
        at = np.empty((n, min(beam, cost.shape[1])), np.int64)
        for j in range(at.shape[1]):  # a few passes for the least cost each; of equal ones the first
            at[:, j] = cost.argmin(1)
            cost[rows, at[:, j]] = np.inf
        src, word = at // len(own), at % len(own)
        left = np.take_along_axis(left, src[:, :, None], 1) - own[word]
        codes = np.concatenate([np.take_along_axis(codes, src[:, :, None], 1), word[:, :, None].astype(np.uint8)], axis=2)
    return codes[:, 0]


def norms(x: np.ndarray) -> np.ndarray:
    """Lengths of rows that are not all 0; squares neither overflow nor vanish."""
    most = np.abs(x).max(1)
    return most * np.sqrt(((x / most[:, None]) ** 2).sum(1))


def quantised(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, factors and reaches of rows: for any query of length 1, the product with the row is within `reach` of `factor` times its sum of table entries.

    The factor puts the sum of codewords nearest to the row; the reach is the length of what is left over, and all that single-precision
    tables and their sums may err by.
    """
    d, size = x.shape[1], norms(x)
    unit = x / size[:, None]
    codes, total = encoded(unit, books), np.zeros(x.shape)
    for m, own in enumerate(books):
        total += own[codes[:, m]]
    square = (total**2).sum(1)
    factor = np.where(square > 0, (unit * total).sum(1) / np.where(square > 0, square, 1), 0)
    left = np.sqrt(((unit - factor[:, None] * total) ** 2).sum(1))
    err = np.finfo(np.float32).eps * 2 * (d + len(books) + 4) * np.sqrt((books.astype(np.float64) ** 2).sum(2)).max(1).sum()
    return codes, factor * size, (left + err * np.abs(factor) + _rounding(d)) * size


def _rounding(d: int) -> float:
    """What a sum of d products in double precision may err by, in any order, relative to both lengths; doubled."""
    return 4 * (d + 4) * np.finfo(np.float64).eps


def build_index(df: DataFrame, key: str = "vec_id", vector: str = "embedding", fit_rows: int = FIT_ROWS, books: int = BOOKS, block: int | None = None) -> tuple[DataFrame, DataFrame, dict[int, np.ndarray]]:
    """The vectors that take part (key, id, vec), the index in blocks, and its codebooks by length of vector.

    A block of the index holds each row's factor, reach and codes (see `quantised`), and then its vector, in single precision where the block loses nothing by it. Codebooks are
    fitted on at most fit_rows vectors, chosen by hash; each row that takes part is indexed. Only the most frequent length in
    that sample has codebooks; blocks of other lengths have no codes.
    """
    rows = keyed(usable(df, key, vector, nonzero=True), "vectors")
    sample = [r[0] for r in rows.select("vec", F.xxhash64(F.lit(11), "id", "vec").alias("h")).orderBy("h").limit(fit_rows).select("vec").collect()]
    lengths = [len(v) for v in sample]
    own: dict[int, np.ndarray] = {}
    if lengths:
        d = max(sorted(set(lengths)), key=lengths.count)
        x = np.array([v for v in sample if len(v) == d])
        # of directions, so that norms stay out of the codes
        own[d] = fitted(x / norms(x)[:, None], books)
    shared = rows.sparkSession.sparkContext.broadcast(own)

    def pack(x: np.ndarray) -> bytes:
        d = x.shape[1]
        if d in shared.value:
            codes, factor, reach = (np.concatenate(c) for c in zip(*(quantised(x[at : at + STEP], shared.value[d]) for at in range(0, len(x), STEP)), strict=True))
        else:
            codes, factor, reach = np.zeros((len(x), 0), np.uint8), np.ones(len(x)), _rounding(d) * norms(x)
        with np.errstate(over="ignore"):
            single = x.astype(np.float32)
        return factor.tobytes() + reach.tobytes() + (single if (single == x).all() else x).tobytes() + codes.tobytes()

    return rows, in_blocks(rows, block or block_rows(rows, INDEXED), pack), own


class Nearest:
    """Queries of a block and, of all candidates seen, each query's k largest inner products; of equal ones the smaller ids.

    A candidate whose estimate and reach stay under the k-th largest product so far is left out; vectors of the others are multiplied. Products that
    may be among the k largest are then summed in double precision from the first component to the last.
    """

    def __init__(self, k: int, shortlist: int, books: dict[int, np.ndarray], keys: np.ndarray, ids: np.ndarray, q: np.ndarray):
        self.k, self.shortlist, self.keys, self.ids, self.q, self.own = k, shortlist, keys, ids, q, books.get(q.shape[1])
        self.norm = norms(q)
        self.unit = q / self.norm[:, None]
        self.floor = np.full(len(q), -np.inf)  # the k-th largest product
        self.best = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(0, len(q), PART)]
        self.multiplied = 0

    def see(self, keys: np.ndarray, ids: np.ndarray, data) -> None:
        n, d, m = len(ids), self.q.shape[1], 0 if self.own is None else len(self.own)
        factor, reach = np.frombuffer(data, np.float64, 2 * n).reshape(2, n)
        kind = np.float32 if len(data) == n * (16 + 4 * d + m) else np.float64
        exact = np.frombuffer(data, kind, n * d, offset=16 * n).reshape(n, d)
        codes = np.frombuffer(data, np.uint8, offset=len(data) - n * m).reshape(n, m)
        for p, j in enumerate(range(0, len(self.q), PART)):
            part = slice(j, j + PART)
            tables = None if self.own is None else np.einsum("mwd,qd->mwq", self.own, self.unit[part].astype(np.float32), optimize=True)
            for at in range(0, n, STEP):
                step = slice(at, at + STEP)
                x = exact[step].astype(np.float64)
                est = x @ self.unit[part].T if tables is None else self._sums(tables, codes[step])
                let = est * factor[step, None] + reach[step, None] >= self.floor[part] / self.norm[part]
                let &= ids[step, None] != self.ids[None, part]
                self._merge(p, *self._scored(part, x, let, _rounding(d) * norms(x)), keys[step], ids[step])

    def _sums(self, tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
        est = np.zeros((len(codes), tables.shape[2]), np.float32)
        for near in range(0, len(codes), LOOKED_UP):  # sums that stay in the cache
            for m in range(len(tables)):
                est[near : near + LOOKED_UP] += tables[m].take(codes[near : near + LOOKED_UP, m], axis=0)
        return est

    def _scored(self, part: slice, x: np.ndarray, let: np.ndarray, err: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, query and product of the pairs let through that may be among the k largest."""
        some = np.flatnonzero(let.any(1))
        self.multiplied += int(let.sum())
        q, norm, let = self.q[part], self.norm[part], let[some]
        most = x[some] @ q.T + err[some, None] * norm  # at least the product summed in order
        most[~let] = -np.inf
        floor = self.floor[part]
        keep = let & (most >= floor)
        crowded = np.flatnonzero(keep.sum(0) > max(self.shortlist, self.k))
        if len(crowded):
            least = np.where(let[:, crowded], most[:, crowded] - 2 * err[some, None] * norm[crowded], -np.inf)
            keep[:, crowded] &= most[:, crowded] >= np.partition(least, len(some) - self.k, axis=0)[len(some) - self.k]
        row, query = np.nonzero(keep)
        score, xt, qt = np.zeros(len(row)), np.ascontiguousarray(x[some].T), np.ascontiguousarray(q.T)
        for a, b in zip(xt, qt, strict=True):
            score += b[query] * a[row]
        return some[row], query, score

    def _merge(self, p: int, row: np.ndarray, query: np.ndarray, score: np.ndarray, keys: np.ndarray, ids: np.ndarray) -> None:
        new = score >= self.floor[p * PART + query]
        if not new.any():
            return
        query, score, i, k = (np.concatenate(c) for c in zip(self.best[p], (query[new], score[new], ids[row[new]], keys[row[new]]), strict=True))
        order = np.lexsort((k, i, -score, query))
        place = np.arange(len(order)) - np.searchsorted(query[order], query[order], side="left")
        order, place = order[place < self.k], place[place < self.k]
        self.best[p] = query[order], score[order], i[order], k[order]
        last = order[place == self.k - 1]
        self.floor[p * PART + query[last]] = score[last]

    def done(self) -> Iterator[pa.RecordBatch]:
        for j, (query, score, ids, keys) in zip(range(0, len(self.q), PART), self.best, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(self.keys[j + query]), pa.array(keys), pa.array(ids), pa.array(score)], names=["qkey", "key", "id", "score"])


def ann_search(df: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding", shortlist: int = SHORTLIST, block: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: for each row of queries the k rows of df with the largest inner product.

    Lookup tables estimate every inner product from codes, and the length of what the codes leave over bounds how far off an estimate is. All candidates
    that the bound lets through are multiplied, so none of the k largest is missed, whatever the codebooks are worth for these rows; how many are let through
    depends on them. A query's own id is no candidate. Ties go to the
    smaller vec_id; rows with equal vectors are candidates each, and repeated rows of queries are queries each. Vectors that are null, empty, zero, or hold null, NaN or
    infinite components take no part on either side; those of another length than the query's are no candidates. Fewer
    than k candidates: all of them. Scores are inner products of the original vectors in double precision, summed from the first component to the last.
    """
    _, index, books = build_index(df, key, vector, block=block)
    own = keyed(usable(queries, key, vector, nonzero=True), "queries")
    asked = in_blocks(own, block or QUERIES, lambda x: x.astype(np.float64).tobytes())
    shared = df.sparkSession.sparkContext.broadcast(books)
    found = meet(asked, index, lambda keys, ids, q: Nearest(k, shortlist, shared.value, keys, ids, q), "qkey long, key long, id long, score double", "nearest")
    scored = found.join(own.select(F.col("key").alias("qkey"), F.col("id").alias("query_id")), "qkey")
    return ranked(scored.select("qkey", "query_id", "id", "key", "score"), k)
