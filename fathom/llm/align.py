"""Two tokenizers side by side: groups between common cuts, links of overlapping tokens, and how often the corpus has each pair."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.llm.common import free_name, slices, small_batches, worker_cache, written
from fathom.llm.counts import BESIDE_SPACE, byte_alphabet
from fathom.llm.pieces import MARK

#: Distinct chunks, and links of them, that a worker keeps; a full table is emptied, which costs time and changes no result.
TABLE_ENTRIES, TABLE_LINKS = 400_000, 8_000_000
#: Chunks longer than this (characters) are aligned but not kept.
LONG_CHUNK = 256
#: Pairs that a counting task holds before it hands on what it has.
HELD_PAIRS = 2_000_000
#: Parts that a pair's counts are dealt to before they meet.
SALTS = 16
#: Pairs with more than 1/FREQUENT of all counts are at most so many, and are broadcast (17 bytes each); rarer ones are joined by shuffle.
FREQUENT = 1_000_000


def aligned(bytes_a: np.ndarray, bytes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Common cuts, the group of each A and of each B token, and links as two arrays of places, from the tokens' lengths over the same bytes.

    A cut is a byte offset where tokens of both end. A token's group is the first cut that is not before its end; links are all pairs of
    tokens whose byte ranges overlap, ordered by A's place, then B's.
    """
    ends_a, ends_b = np.cumsum(bytes_a), np.cumsum(bytes_b)
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    first = np.searchsorted(ends_b, ends_a - bytes_a, side="right")
    last = np.searchsorted(ends_b - bytes_b, ends_a, side="left")
    n = last - first
    link_a = np.repeat(np.arange(len(ends_a)), n)
    link_b = np.arange(len(link_a)) + np.repeat(first - np.cumsum(n) + n, n)
    return cuts, np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b), link_a, link_b


class Aligner:
    """Alignments of distinct chunks. A chunk is what stands between single spaces; both tokenizers cut there, so chunks are aligned alone."""

    def __init__(self, path_a: str, path_b: str):
        import os

        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        back = byte_alphabet()
        size_a, size_b = self.a.get_vocab_size(with_added_tokens=True), self.b.vocab_size()
        self.bytes_a = [bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t in (self.a.id_to_token(i) or "" for i in range(size_a))]
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(size_b)))]
        self.len_a, self.len_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))
        pieces = (self.b.id_to_piece(i) for i in range(size_b))
        # pieces with a mark after another character, or a library that drops spaces, cross chunks
        self.separable = not any(MARK in p.lstrip(MARK) for p in pieces) and self.b.encode("a b") == [*self.b.encode("a"), *self.b.encode("b")]
        self.alone = [self.b.piece_to_id(MARK)]  # a mark with nothing behind it
        self.signs = [f"{i}{c}" for i in range(size_a) for c in ",|"] + [f"{i}{c}" for i in range(size_b) for c in ",;"]
        self.sign_len = np.fromiter(map(len, self.signs), np.int64, len(self.signs))
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, tuple] = {}
        self.links = 0

    def chunks(self, text: str) -> list[str]:
        """Parts of a text that are aligned alone: between single spaces that stand between other characters, else the whole text."""
        return [text] if not self.separable or BESIDE_SPACE.search(text) else text.split(" ")

    def _joined(self, chunks: list[str], coded: list[list[int]], table: list[bytes], lengths: np.ndarray) -> np.ndarray:
        """Whether each chunk's tokens give back its bytes with a space before them. Mostly all do, which one comparison tells."""
        flat = [t for ids in coded for t in ids]
        ends = np.cumsum([len(ids) for ids in coded])
        whole = [f" {c}".encode() for c in chunks]
        sizes = np.fromiter(map(len, whole), np.int64, len(whole))
        at = np.concatenate([[0], np.cumsum(lengths[np.asarray(flat, np.int64)])])
        if np.array_equal(at[ends], np.cumsum(sizes)) and b"".join(map(table.__getitem__, flat)) == b"".join(whole):
            return np.ones(len(chunks), bool)
        return np.fromiter((b"".join(map(table.__getitem__, ids)) == c for ids, c in zip(coded, whole, strict=True)), bool, len(chunks))

    def align(self, chunks: list[str]) -> list[tuple | None]:
        """(A tokens, B tokens, groups, links as id pairs, groups as text) of each chunk with a space before it; None where a tokenizer's bytes are not the chunk's. All chunks are aligned in one go."""
        coded_a = [x.ids for x in self.a.encode_batch_fast([f" {c}" for c in chunks], add_special_tokens=False)]
        coded_b = [y if c else self.alone for c, y in zip(chunks, self.b.encode(chunks, num_threads=1), strict=True)]
        same = self._joined(chunks, coded_a, self.bytes_a, self.len_a) & self._joined(chunks, coded_b, self.bytes_b, self.len_b)
        out: list[tuple | None] = [None] * len(chunks)
        own = np.flatnonzero(same).tolist()
        if not own:
            return out
        ids_a, ids_b = (np.asarray([t for i in own for t in coded[i]], np.int64) for coded in (coded_a, coded_b))
        cuts, group_a, group_b, link_a, link_b = aligned(self.len_a[ids_a], self.len_b[ids_b])
        keys = ids_a[link_a] * len(self.bytes_b) + ids_b[link_b]
        # the groups' text: tokens by group, A's before B's, each with the sign that follows it
        last = lambda g: np.append(g[1:] != g[:-1], True)
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        signs = np.concatenate([2 * ids_a + last(group_a), 2 * (len(self.bytes_a) + ids_b) + last(group_b)])[order]
        text = "".join(map(self.signs.__getitem__, signs.tolist()))
        letters = np.cumsum(self.sign_len[signs])
        n_a, n_b = (np.fromiter((len(coded[i]) for i in own), np.int64, len(own)) for coded in (coded_a, coded_b))
        ends = np.cumsum(n_a)
        groups, links, places = group_a[ends - 1] + 1, np.searchsorted(link_a, ends), letters[ends + np.cumsum(n_b) - 1]
        g = k = p = 0
        for i, a, b, to_g, to_k, to_p in zip(own, n_a.tolist(), n_b.tolist(), groups.tolist(), links.tolist(), places.tolist(), strict=True):
            out[i] = (a, b, to_g - g, keys[k:to_k].copy(), text[p : to_p - 1])
            g, k, p = to_g, to_k, to_p
        return out

    def texts(self, texts: list[str]) -> Iterator[tuple | None]:
        """For each text what align gives for a chunk, or None."""
        worded = [self.chunks(x) if x and MARK not in x else [] for x in texts]
        new = list({c for own in worded for c in own}.difference(self.index))
        if len(self.index) + len(new) > TABLE_ENTRIES or self.links > TABLE_LINKS:
            self.clear()
            new = list({c for own in worded for c in own})
        held = dict(zip(new, self.align(new), strict=True)) if new else {}
        kept = {c: x for c, x in held.items() if len(c) <= LONG_CHUNK}
        self.index.update(kept)
        self.links += sum(len(x[3]) for x in kept.values() if x)
        for own in worded:
            found = [self.index[c] if c in self.index else held[c] for c in own]
            if not own or None in found:
                yield None
            else:
                n_a, n_b, n_groups, keys, groups = zip(*found, strict=True)
                yield sum(n_a), sum(n_b), sum(n_groups), np.concatenate(keys), ";".join(groups)


def _lists(parts: list[np.ndarray], kind) -> pa.ListArray:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(x) for x in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else [], kind))


def _alignments(src: DataFrame, inner: str, names: dict[str, str], path_a: str, path_b: str) -> DataFrame:
    kinds = {"n_a": T.LongType(), "n_b": T.LongType(), "n_groups": T.LongType(), "n_links": T.LongType(), "groups_sha256": T.StringType(), "pairs": T.ArrayType(T.LongType(), False), "times": T.ArrayType(T.LongType(), False)}
    schema = T.StructType([*src.drop(inner).schema.fields, *[T.StructField(names[c], t) for c, t in kinds.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = worker_cache(f"align {path_a} {path_b}", lambda: Aligner(path_a, path_b))
        for batch in batches:
            for part in slices(batch, inner):
                numbers, digests, pairs, times = [], [], [], []
                for x in own.texts([x or "" for x in part.column(inner).to_pylist()]):
                    if x is None:
                        numbers.append((0, 0, 0, 0)), digests.append(""), pairs.append(np.zeros(0, np.int64)), times.append(np.zeros(0, np.int64))
                        continue
                    key, n = np.unique(x[3], return_counts=True)
                    numbers.append((*x[:3], len(x[3]))), digests.append(hashlib.sha256(x[4].encode()).hexdigest()), pairs.append(key), times.append(n)
                arrays = [part.column(i) for i, c in enumerate(part.schema.names) if c != inner]
                arrays += [pa.array(c, pa.int64()) for c in zip(*numbers, strict=True)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(digests, pa.string()), _lists(pairs, pa.int64()), _lists(times, pa.int64())], names=schema.names)

    return src.mapInArrow(run, schema)


def pair_counts(pairs: DataFrame, column: str) -> DataFrame:
    """(pair, n): in how many rows each value of an array column of distinct values is.

    Tasks count what they hold first; counts then meet in two stages, by pair and salt, then by pair.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            key, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return key, np.bincount(at, weights=np.concatenate([n for _, n in held])).astype(np.int64)

        waiting = 0
        for number, batch in enumerate(batches):
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            held.append(np.unique(flat, return_counts=True))
            waiting += len(held[-1][0])
            if waiting > HELD_PAIRS:
                held = [merged()]
                waiting = len(held[0][0])
                if waiting > HELD_PAIRS // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0][0]), pa.array(held[0][0] * 0 + number % SALTS, pa.int32()), pa.array(held[0][1])], names=["pair", "salt", "n"])
                    held, waiting = [], 0
        if held:
            key, n = merged()
            salt = int(key[:1].sum() + len(key)) % SALTS  # what the task holds decides, so a task that is run again salts alike
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(key), salt), pa.int32()), pa.array(n)], names=["pair", "salt", "n"])

    salted = pairs.select(column).mapInArrow(run, "pair long, salt int, n long")
    return salted.groupBy("pair", "salt").agg(F.sum("n").alias("n")).groupBy("pair").agg(F.sum("n").alias("n"))


def _scored(rows: DataFrame, frequent: tuple[np.ndarray, np.ndarray, np.ndarray], names: dict[str, str]) -> DataFrame:
    """rows with n_best and count_sum over the links whose pairs are frequent."""
    held = rows.sparkSession.sparkContext.broadcast(frequent)
    gone = {names["pairs"], names["times"]}
    schema = T.StructType([*[f for f in rows.schema.fields if f.name not in gone], T.StructField(names["n_best"], T.LongType()), T.StructField(names["count_sum"], T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, best = held.value
        for batch in batches:
            pairs, times = (batch.column(batch.schema.get_field_index(names[c])) for c in ("pairs", "times"))
            flat, often = pairs.flatten().to_numpy(zero_copy_only=False), times.flatten().to_numpy(zero_copy_only=False)
            at = np.searchsorted(key, flat)
            hit = (at < len(key)) & (key[np.minimum(at, len(key) - 1)] == flat) if len(key) else np.zeros(len(flat), bool)
            at = np.where(hit, at, 0)
            zero = np.zeros(1, np.int64)
            sums = np.concatenate([zero, np.cumsum(np.where(hit, n[at] * often, 0))]) if len(key) else np.zeros(len(flat) + 1, np.int64)
            bests = np.concatenate([zero, np.cumsum(np.where(hit & best[at], often, 0))]) if len(key) else np.zeros(len(flat) + 1, np.int64)
            ends = np.concatenate([zero, np.cumsum(pa.compute.list_value_length(pairs).to_numpy(zero_copy_only=False))])
            arrays = [batch.column(i) for i, c in enumerate(batch.schema.names) if c not in gone]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(np.diff(bests[ends])), pa.array(np.diff(sums[ends]))], names=schema.names)

    return rows.mapInArrow(run, schema)


def align_tokenizers(df: DataFrame, path_a: str, path_b: str, text: str = "text", keep: list[str] | None = None, frequent: int = FREQUENT) -> tuple[DataFrame, DataFrame]:
    """keep's columns (all but text if None) with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256; and the pairs (a, b, n, best).

    A is a byte-level vocabulary that gets a space and the text, B one of pieces that puts the space before it itself. Byte offsets where
    tokens of both end cut them into groups; links are all pairs of token occurrences whose byte ranges overlap. n counts the rows that
    hold a pair linked, best marks the pairs with the highest n of their A id, ties included; n_best counts links with such a pair, count_sum
    adds n over links.

    Null and empty texts, and texts that either tokenizer's bytes do not give back (such as those with U+2581), have no tokens: zeros, and
    '' for the hash. Texts are encoded whole. Repeated rows are rows like others. Taken names get leading underscores. An empty table
    gives none. Counts go back to rows from a broadcast of the frequent pairs, at most `frequent` by their share in all counts, and
    by a shuffle join of the rest.
    """
    spark = df.sparkSession
    keep = [c for c in df.columns if c != text] if keep is None else keep
    src = df.select(*[F.col(f"`{c}`") for c in keep], df[text].alias(inner := free_name(df.select(*keep), "text_")))
    names = {c: free_name(src, c) for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times", "n_best", "count_sum")}
    with small_batches(spark):
        rows = written(_alignments(src, inner, names, path_a, path_b), "alignments")
    width = _vocabulary(path_b)
    counts = written(pair_counts(rows, names["pairs"]), "counts")
    most = counts.groupBy(F.expr(f"pair div {width}").alias("a")).agg(F.max("n").alias("most"))  # a row for each A id at most
    pairs = written(counts.withColumn("a", F.expr(f"pair div {width}")).join(F.broadcast(most), "a").select("pair", "a", (F.col("pair") % width).alias("b"), "n", (F.col("n") == F.col("most")).alias("best")), "pairs")
    size, whole = pairs.agg(F.count("*"), F.sum("n")).first()
    limit = 0 if size <= frequent else whole // frequent
    held = pairs.where(F.col("n") > limit).select("pair", "n", "best").toArrow()
    order = np.argsort(held.column("pair").to_numpy())
    arrays = tuple(held.column(c).to_numpy()[order] for c in ("pair", "n", "best"))
    if not limit:
        return _scored(rows, arrays, names).select(*keep, *[names[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")]), pairs.drop("pair")
    number = free_name(rows, "row__")
    rows = written(rows.withColumn(number, F.monotonically_increasing_id()), "numbered")
    links = rows.select(number, F.explode(F.arrays_zip(F.col(names["pairs"]).alias("p"), F.col(names["times"]).alias("t"))).alias("x")).select(number, F.col("x.p").alias("pair"), F.col("x.t").alias("t"))
    rare = links.join(pairs.where(F.col("n") <= limit).select("pair", "n", "best"), "pair").groupBy(number).agg(F.sum(F.when(F.col("best"), F.col("t")).otherwise(0)).alias("best__"), F.sum(F.col("n") * F.col("t")).alias("sum__"))
    scored = _scored(rows, arrays, names).join(rare, number, "left")
    both = {"n_best": F.col(names["n_best"]) + F.coalesce("best__", F.lit(0)), "count_sum": F.col(names["count_sum"]) + F.coalesce("sum__", F.lit(0))}
    return scored.select(*keep, *[both[c].alias(names[c]) if c in both else F.col(names[c]) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")]), pairs.drop("pair")


def _vocabulary(path_b: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path_b).vocab_size()
