"""Quality by nearest-neighbour voting among labelled latent-semantic vectors."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.llm.common import free_name, slices, small_batches

#: Buckets of hashed byte pairs and of hashed words, and pseudo-terms for how varied the pairs of a text are and how often a word follows itself.
PAIRS, WORDS, VARIETY, REPEATS = 2048, 2048, 16, 8
TERMS = PAIRS + WORDS + VARIETY + REPEATS
#: Latent dimensions, labelled rows that the model is fitted on at most, and neighbours that vote.
DIMS, FIT_ROWS, NEIGHBOURS = 64, 4096, 15
#: Scales of pseudo-terms that fitting chooses among, and labelled rows that it compares them on at most.
SCALES, SCALE_ROWS = (0.0, 1.0, 2.0, 4.0, 8.0, 16.0), 1024
#: Labelled rows whose weights the driver holds at once.
FIT_BLOCK = 256
#: Bytes of text whose terms and cosine products are held at once, and bytes of a long text whose terms are.
BLOCK_BYTES, WINDOW = 1 << 20, 1 << 18
_GOLDEN = 0x9E3779B97F4A7C15
_POWERS = np.array([pow(0x100000001B3, i, 1 << 64) for i in range(1, 65)], np.uint64)
_WORD_BYTE = np.ones(256, bool)
_WORD_BYTE[[9, 10, 11, 12, 13, 32]] = False


class Model(NamedTuple):
    """What scoring needs, of fixed size, as plain arrays: weights of terms, their latent projection, labelled vectors and labels."""

    idf: np.ndarray
    project: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray


def raw_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each hashed byte pair and each hashed word by text, and (words, words that repeat the one before) by text. Texts are joined by spaces for it."""
    n = len(texts)
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    ends = np.cumsum(np.fromiter((len(x) + 1 for x in texts), np.int64, n)) - 1  # the space after each text
    counts, words = np.zeros((n, PAIRS + WORDS), np.float32), np.zeros((n, 2), np.int64)
    if len(data) <= n:
        return counts, words
    width = PAIRS + WORDS
    wide = data.astype(np.int32)
    cells = (wide[:-1] * 263 + wide[1:]) * 40503 >> 4 & (PAIRS - 1)
    inside = np.ones(len(cells), bool)
    inside[ends[ends < len(cells)]] = inside[ends[ends > 0] - 1] = False
    owner = np.repeat(np.arange(n), np.diff(ends, prepend=-1))
    flat = [(cells + owner[:-1] * width)[inside]]
    word = _WORD_BYTE[data]
    starts = np.flatnonzero(word & ~np.concatenate([[False], word[:-1]]))
    if len(starts):
        begun = np.repeat(starts, np.diff(starts, append=len(data)))
        place = np.arange(starts[0], len(data)) - begun
        parts = np.where(word[starts[0] :], (data[starts[0] :].astype(np.uint64) + np.uint64(1)) * _POWERS[place & 63], np.uint64(0))
        hashes = np.add.reduceat(parts, starts - starts[0])
        own = owner[starts]
        flat.append(PAIRS + (hashes * np.uint64(_GOLDEN) >> np.uint64(53)).astype(np.int64) + own * width)
        words[:, 0] = np.bincount(own, minlength=n)
        again = (hashes[1:] == hashes[:-1]) & (own[1:] == own[:-1])
        words[:, 1] = np.bincount(own[1:][again], minlength=n)
    return np.bincount(np.concatenate(flat), minlength=n * width).reshape(n, width).astype(np.float32), words


def windows(text: bytes) -> Iterator[bytes]:
    """Parts of a long text of WINDOW bytes at most, which overlap in one byte, white space if there is any."""
    at = 0
    while True:
        part = text[at : at + WINDOW]
        if at + WINDOW < len(text):
            end = max(part.rfind(b" "), part.rfind(b"\n"), part.rfind(b"\t"))
            part = part[: end + 1] if end > 0 else part
        yield part
        at += len(part)
        if at >= len(text):
            return
        at -= 1


def term_counts(texts: list[bytes]) -> np.ndarray:
    """Rows of terms: ln(1 + count) of each hashed pair of neighbouring bytes and of each hashed word; 1 at how varied those pairs are for the length, and at the share of words that repeat the word before.

    A text over WINDOW bytes is counted window by window; a word longer than that is counted in parts.
    """
    counts, words = raw_counts([x if len(x) <= WINDOW else b"" for x in texts])
    for i, x in enumerate(texts):
        if len(x) > WINDOW:
            for part in windows(x):
                c, w = raw_counts([part])
                counts[i] += c[0]
                words[i] += w[0]
    out = np.zeros((len(texts), TERMS), np.float32)
    np.log1p(counts, out=out[:, : PAIRS + WORDS])
    total, kinds = counts[:, :PAIRS].sum(1), (counts[:, :PAIRS] > 0).sum(1)
    # distinct pairs against the square root of the length
    level = np.clip((kinds / np.sqrt(np.maximum(total, 1)) * 1.5).astype(int), 0, VARIETY - 1)
    some = total > 0
    out[np.flatnonzero(some), PAIRS + WORDS + level[some]] = 1.0
    share = words[:, 1] * REPEATS // np.maximum(1, words[:, 0])
    out[np.flatnonzero(some), PAIRS + WORDS + VARIETY + share[some]] = 1.0
    return out


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def latent(counts: np.ndarray, idf: np.ndarray, project: np.ndarray) -> np.ndarray:
    return unit(unit(counts * idf) @ project)


def as_bytes(column: pa.Array) -> list[bytes]:
    return [(x or "").encode() for x in column.to_pylist()]


def held_out(key: str) -> Column:
    """Rows that no model may learn from: crc32 of the key as text, mod 3, is 1. Null keys are not among them."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def document_frequencies(docs: DataFrame, text: str) -> tuple[int, np.ndarray]:
    """Texts that are not empty, and for each term in how many of them it is; over all rows. The result has TERMS numbers, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TERMS + 1, np.int64)
        for batch in batches:
            for part in slices(batch, "text", BLOCK_BYTES):
                found = term_counts(as_bytes(part.column("text"))) > 0
                total[:TERMS] += found.sum(0)
                total[TERMS] += found.any(1).sum()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["term", "n"])

    with small_batches(docs.sparkSession):
        rows = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(TERMS + 1, np.int64)
    for term, n in rows:
        out[term] = n
    return int(out[TERMS]), out[:TERMS]


def projection(counts: np.ndarray, idf: np.ndarray, dims: int) -> np.ndarray:
    """The leading right singular vectors of the weighted rows of length 1, by subspace iteration from a fixed start. FIT_BLOCK rows are held as such at a time."""
    k = min(dims, *counts.shape)
    parts = [slice(at, at + FIT_BLOCK) for at in range(0, len(counts), FIT_BLOCK)]
    rows = lambda part: unit(counts[part].astype(np.float32) * idf)
    out = lambda x: np.concatenate([rows(p) @ x for p in parts])
    back = lambda y: sum(rows(p).T @ y[p] for p in parts)
    start = np.random.default_rng(13).normal(size=(counts.shape[1], min(k + 16, *counts.shape))).astype(np.float32)
    q = np.linalg.qr(out(start))[0]
    for _ in range(4):
        q = np.linalg.qr(out(np.linalg.qr(back(q))[0]))[0]
    return np.ascontiguousarray(np.linalg.svd(back(q).T, full_matrices=False)[2][:k].T)


def learned_scales(counts: np.ndarray, labels: np.ndarray, idf: np.ndarray, dims: int, neighbours: int = NEIGHBOURS) -> tuple[float, float]:
    """Scales of the two kinds of pseudo-terms, one after the other: those with the least squared error when each labelled row is scored by the others."""
    counts, labels = counts[:SCALE_ROWS].astype(np.float32), labels[:SCALE_ROWS]
    best = [1.0, 1.0]
    if len(labels) < 3 or labels.min() == labels.max():
        return 1.0, 1.0

    def error(scales: list[float]) -> float:
        own = weights(idf, *scales)
        x = latent(counts, own, projection(counts, own, dims))
        products = x @ x.T
        np.fill_diagonal(products, -1)
        scores = vote_products(products, labels, neighbours)
        side = labels >= 0.5
        return float(((scores - labels)[side] ** 2).mean() + ((scores - labels)[~side] ** 2).mean())

    for kind in (0, 1):
        tried = {scale: error([*best[:kind], scale, *best[kind + 1 :]]) for scale in SCALES}
        best[kind] = min(tried, key=lambda v: (round(tried[v], 6), v))
    return best[0], best[1]


def weights(idf: np.ndarray, variety: float, repeats: float) -> np.ndarray:
    """Weights of all terms: idf of pairs and words; of the two kinds of pseudo-terms idf less 1, so that what all texts have is nothing, times the given scale."""
    out = idf.copy()
    for at, end, scale in ((PAIRS + WORDS, PAIRS + WORDS + VARIETY, variety), (PAIRS + WORDS + VARIETY, TERMS, repeats)):
        out[at:end] = scale * (idf[at:end] - 1)
    return out


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", fit_rows: int = FIT_ROWS, dims: int = DIMS) -> Model:
    """A model from document frequencies over all of docs and at most fit_rows labelled rows, taken by hash of the key.

    Rows that are held out (see held_out), without key or label, and texts under two bytes are passed over; of several labels of
    a key the least holds. The sample comes to the driver as term vectors of fixed size, fit_rows at most also where keys repeat.
    """
    n, df = document_frequencies(docs, text)
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + 1
    own = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key)).groupBy(F.col(key).alias("k")).agg(F.min(label).cast("double").alias("label"))
    known = docs.where(F.octet_length(text) > 1).select(F.col(key).alias("k")).distinct()
    chosen = own.join(known, "k", "left_semi").orderBy(F.xxhash64(F.lit(5), "k"), "k").limit(fit_rows)
    # fit_rows keys at most are broadcast, so no text is shuffled
    chosen = docs.where(F.octet_length(text) > 1).select(F.col(key).alias("k"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "k").select(F.xxhash64(F.lit(5), "k").alias("h"), F.xxhash64("text").alias("t"), "text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BLOCK_BYTES):
                counts = term_counts(as_bytes(part.column("text"))).astype(np.float16)
                packed = [np.flatnonzero(c).astype(np.uint16).tobytes() + c[c != 0].tobytes() for c in counts]  # two bytes a place, two a value
                yield pa.RecordBatch.from_arrays([part.column("h"), part.column("t"), pa.array(packed, pa.binary()), part.column("label")], names=["h", "t", "counts", "label"])

    with small_batches(docs.sparkSession):
        rows = chosen.mapInArrow(run, "h long, t long, counts binary, label double").orderBy("h", "t", "label").limit(fit_rows).collect()
    if not rows:
        return Model(idf, np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0, np.float32))
    counts, known = np.zeros((len(rows), TERMS), np.float16), np.array([r.label for r in rows], np.float32)
    for i, r in enumerate(rows):
        half = len(r.counts) // 4
        counts[i, np.frombuffer(r.counts, np.uint16, half)] = np.frombuffer(r.counts, np.float16, half, 2 * half)
    del rows
    idf = weights(idf, *learned_scales(counts, known, idf, dims))
    project = projection(counts, idf, dims)
    vectors = np.concatenate([latent(counts[at : at + FIT_BLOCK].astype(np.float32), idf, project) for at in range(0, len(counts), FIT_BLOCK)])
    return Model(idf, project, vectors, known)


def vote_products(products: np.ndarray, labels: np.ndarray, neighbours: int) -> np.ndarray:
    """Scores from cosines to labelled rows: the nearest ones' labels, weighted by a power of the similarity. Cosines count to six digits; all that equal the last one's vote."""
    products = np.round(products, 6)
    k = min(neighbours, len(labels))
    least = np.partition(products, products.shape[1] - k, axis=1)[:, products.shape[1] - k]
    weight = np.where(products >= np.maximum(least, 0)[:, None], products, 0)
    for _ in range(3):
        weight *= weight
    total = weight.sum(1, dtype=np.float64)
    return np.divide((weight @ labels).astype(np.float64), total, out=np.zeros(len(products)), where=total > 0)


def vote(x: np.ndarray, model: Model, neighbours: int) -> np.ndarray:
    """Scores of latent vectors by the labelled vectors nearest by exact cosine."""
    if not len(model.labels):
        return np.full(len(x), 0.5)
    return vote_products(x @ model.vectors.T, model.labels, neighbours)


def score_quality(docs: DataFrame, model: Model, text: str = "text", score: str = "score", neighbours: int = NEIGHBOURS, keep: list[str] | None = None) -> DataFrame:
    """keep's columns of docs (all if None) with score, 0 to 1: the share of label 1 among the nearest labelled vectors, weighted by similarity.

    Only the text is looked at, whole. Null, empty and one-byte texts have no pair of bytes and so no neighbours: they score 0.
    With no labelled row at all every other text scores 0.5. Equal texts score alike. A taken name gets an underscore.
    Run it under small_batches: whole Arrow batches are in a worker's memory.
    """
    src = docs.select(*(docs.columns if keep is None else keep), docs[text].alias(inner := free_name(docs, "text__")))
    score = free_name(src, score)
    schema = T.StructType([*src.drop(inner).schema.fields, T.StructField(score, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))  # plain arrays, which workers without this package can read: at most FIT_ROWS * DIMS + TERMS * (DIMS + 1) numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            for part in slices(batch, inner, BLOCK_BYTES):
                texts = as_bytes(part.column(inner))
                scores = vote(latent(term_counts(texts), own.idf, own.project), own, neighbours)
                scores[np.fromiter((len(x) < 2 for x in texts), bool, len(texts))] = 0
                arrays = [part.column(i) for i, c in enumerate(part.schema.names) if c != inner]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(np.clip(scores, 0, 1))], names=schema.names)

    return src.mapInArrow(run, schema)
