"""Encoders that need Python: hypervectors of character trigrams, product quantisation."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.functions import dense

#: N-grams whose vectors are added up at once.
GRAMS = 512
#: Bits of a hypervector, dimensions of its projection, characters of an n-gram, seed and steps of the generator (fixed values).
BITS, WIDTH, NGRAM = 10_000, 1024, 3
SEED, MULTIPLIER, INCREMENT = 0xDEADBEEFCAFEBABE, 6364136223846793005, 1


def _generator() -> tuple[np.ndarray, np.ndarray]:
    """What a state is multiplied by and gets added after 1 to BITS steps of the linear congruential generator."""
    factors, offsets, f, o = np.empty(BITS, np.uint64), np.empty(BITS, np.uint64), 1, 0
    for i in range(BITS):
        f, o = f * MULTIPLIER % (1 << 64), (o * MULTIPLIER + INCREMENT) % (1 << 64)
        factors[i], offsets[i] = f, o
    return factors, offsets


class Hypervectors:
    """Bits of texts; vectors of characters are made once."""

    def __init__(self, seed: int = SEED, ngram: int = NGRAM):
        self.seed, self.ngram, self.steps, self.characters = seed, ngram, _generator(), {}

    def character(self, c: str) -> np.ndarray:
        """The top bits of the generator's states, from the seed plus the character's number."""
        if c not in self.characters:
            start = np.uint64((self.seed + ord(c)) % (1 << 64))
            self.characters[c] = (self.steps[0] * start + self.steps[1]) >> np.uint64(63) == 1
        return self.characters[c]

    def gram(self, gram: str) -> np.ndarray:
        """The exclusive or of its characters' vectors, each turned to the front by its place."""
        out = self.character(gram[0])
        for i, c in enumerate(gram[1:], 1):
            out = out ^ np.roll(self.character(c), -i)
        return out

    def text(self, text: str) -> np.ndarray:
        """Majority of all n-grams' vectors; at a tie by half of them, rounded down, the first n-gram's. Shorter texts are one n-gram, an empty one has no bit."""
        if not text:
            return np.zeros(BITS, bool)
        size = min(self.ngram, len(text))
        n = len(text) - size + 1
        first = self.gram(text[:size])
        if n == 1:
            return first
        total = np.zeros(BITS, np.int64)
        for i in range(n):
            total += self.gram(text[i : i + size])
        return (total > n // 2) | ((total == n // 2) & first)

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        """As text for each; the n-grams of long ones are counted and their vectors added up by one product for GRAMS of them."""
        long = [i for i, x in enumerate(texts) if len(x) > self.ngram]
        counts = {i: Counter(texts[i][k : k + self.ngram] for k in range(len(texts[i]) - self.ngram + 1)) for i in long}
        grams = list({g for c in counts.values() for g in c})
        place = {g: k for k, g in enumerate(grams)}
        totals = np.zeros((len(long), BITS), np.float32)
        for at in range(0, len(grams), GRAMS):
            part = grams[at : at + GRAMS]
            share = np.zeros((len(long), len(part)), np.float32)
            for row, i in enumerate(long):
                for g, k in counts[i].items():
                    if at <= place[g] < at + GRAMS:
                        share[row, place[g] - at] = k
            totals += share @ np.stack([self.gram(g) for g in part]).astype(np.float32)
        out = [self.text(x) if len(x) <= self.ngram else np.zeros(0, bool) for x in texts]
        for row, i in enumerate(long):
            half = (len(texts[i]) - self.ngram + 1) // 2
            out[i] = (totals[row] > half) | ((totals[row] == half) & self.gram(texts[i][: self.ngram]))
        return out


def projected(bits: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Shares of set bits in `width` runs, as -1 to 1, brought to norm 1."""
    ends = np.arange(width + 1) * len(bits) // width
    ones = np.add.reduceat(bits.astype(np.float64), ends[:-1])
    out = 2 * ones / np.diff(ends) - 1
    norm = np.sqrt((out * out).sum())
    return out / norm if norm > 1e-7 else out


def hypervectors(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, ones, code, vector): set bits, the bits packed, and their projection. Null and empty texts have none set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Hypervectors()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                bits = own.texts([x or "" for x in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([int(b.sum()) for b in bits], pa.int32()), pa.array([np.packbits(b, bitorder="little").tobytes() for b in bits], pa.binary()), pa.array([projected(b) for b in bits], pa.list_(pa.float64()))], names=["id", "ones", "code", "vector"])

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, ones int, code binary, vector array<double>")


def product_codes(df: DataFrame, key: str, vector: str, parts: int = 8, words: int = 256, fit_rows: int = 4096) -> DataFrame:
    """(id, codes, error): nearest word of each part's codebook and the squared error. Codebooks are fitted on at most fit_rows vectors, taken by hash."""
    rows = df.select(F.col(key).cast("long").alias("id"), dense.vec(vector).alias("v")).where("v is not null")
    sample = np.array([r[0] for r in rows.orderBy(F.xxhash64("id"), "id").limit(fit_rows).select("v").collect()], np.float64)
    if not len(sample):
        return df.sparkSession.createDataFrame([], "id long, codes binary, error double")
    ends = np.arange(parts + 1) * sample.shape[1] // parts  # parts may differ by one in width
    books = []
    for p in range(parts):
        x = sample[:, ends[p] : ends[p + 1]]
        own = x[: min(words, len(x))].copy()
        for _ in range(8):
            near = ((x[:, None] - own[None]) ** 2).sum(2).argmin(1)
            for w in np.unique(near):
                own[w] = x[near == w].mean(0)
        books.append(own)
    shared = df.sparkSession.sparkContext.broadcast(books)  # parts * words short vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column("v").to_pylist())
            codes, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x))
            for p, own in enumerate(shared.value):
                gap = ((x[:, None, ends[p] : ends[p + 1]] - own[None]) ** 2).sum(2)
                codes[:, p], error = gap.argmin(1), error + gap.min(1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)], names=["id", "codes", "error"])

    return rows.mapInArrow(run, "id long, codes binary, error double")
