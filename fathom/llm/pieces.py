"""SentencePiece encoding and decoding through a table of distinct chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fathom.llm.common import free_name, slices, worker_cache

MARK = "▁"
#: Entries of a worker's chunk table and ids that they hold; a full table is emptied, which costs time and changes no result.
TABLE_ENTRIES, TABLE_IDS = 400_000, 4_000_000
#: Chunks longer than this (characters) are segmented but not kept.
LONG_CHUNK = 256


class Grown:
    """An array that grows by doubling, so that adding to it costs what is added."""

    def __init__(self, kind: type):
        self.data, self.n = np.zeros(1024, kind), 0

    def extend(self, values: np.ndarray) -> None:
        need = self.n + len(values)
        if need > len(self.data):
            self.data = np.concatenate([self.data[: self.n], np.zeros(max(need, 2 * len(self.data)) - self.n, self.data.dtype)])
        self.data[self.n : need] = values
        self.n = need


class ChunkTable:
    """Distinct marked words and their ids, flat: ids[starts[k]:starts[k] + lengths[k]] belong to chunk k."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.vocab_size()))
        # A chunk is a run of marks and what follows it. Merges stay inside chunks if no piece has a mark after another character.
        self.separable = not any(MARK in p.lstrip(MARK) for p in pieces) and self.model.encode("a b") == [*self.model.encode("a"), *self.model.encode("b")]
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.starts, self.lengths = Grown(np.int32), Grown(np.int64), Grown(np.int64)

    def segmented(self, chunks: list[str]) -> list[list[int]]:
        alone = [self.model.piece_to_id(MARK)]  # a mark with nothing behind it
        return [x if c else alone for c, x in zip(chunks, self.model.encode(chunks, num_threads=1), strict=True)]

    def add(self, chunks: list[str]) -> None:
        coded = self.segmented(chunks)
        lengths = np.fromiter(map(len, coded), np.int64, len(coded))
        at = self.starts.n
        self.starts.extend(self.ids.n + np.cumsum(lengths) - lengths)
        self.lengths.extend(lengths)
        self.ids.extend(np.fromiter((i for x in coded for i in x), np.int32, int(lengths.sum())))
        self.index.update(zip(chunks, range(at, at + len(chunks)), strict=True))

    def joined(self, own: list[str]) -> np.ndarray:
        """Ids of chunks that are in the table."""
        at = np.fromiter(map(self.index.__getitem__, own), np.int64, len(own))
        lengths = self.lengths.data[at]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids.data[np.repeat(self.starts.data[at] - ends + lengths, lengths) + np.arange(total)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text: its chunks are looked up, unknown ones segmented once, and ids joined back by position. Long chunks are segmented beside the table, and forgotten with the call."""
        if not self.separable:
            return [np.asarray(x, np.int32) for x in self.model.encode(texts, num_threads=1)]
        words = [chunks_of(x) for x in texts]
        new = {w for own in words for w in own}.difference(self.index)
        beside = [w for w in new if len(w) > LONG_CHUNK]
        new.difference_update(beside)
        if len(self.index) + len(new) > TABLE_ENTRIES or self.ids.n > TABLE_IDS:
            self.clear()
            new = {w for own in words for w in own}.difference(beside)
        if new:
            self.add(list(new))
        if not beside:
            return [self.joined(own) for own in words]
        long = {w: np.asarray(x, np.int32) for w, x in zip(beside, self.segmented(beside), strict=True)}
        out = []
        for own in words:
            parts, start = [], 0
            for i in (i for i, w in enumerate(own) if w in long):
                parts += [self.joined(own[start:i]), long[own[i]]]
                start = i + 1
            out.append(np.concatenate([*parts, self.joined(own[start:])]))
        return out


def chunks_of(text: str) -> list[str]:
    """Inputs for the library, one for each chunk: it puts a mark before each itself. An empty text has none."""
    if not text:
        return []
    text = text.replace(MARK, " ")
    words = text.split(" ")
    if "" not in words:
        return words
    # a run of k marks and what follows is one chunk; the library adds the first mark
    return [x[1:] for x in re.findall(r" +[^ ]*", f" {text}")]


def encode_pieces(df: DataFrame, model_path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """keep's columns (all but text if None) with the ids of the whole text and what they decode to.

    A null text counts as empty: no ids, empty decoded text. No begin or end ids. Texts of any length are encoded whole;
    repeated rows are encoded like any others. Where the model's pieces can cross whitespace marks, whole texts go to the
    library instead of chunks. New columns get leading underscores where their names are taken.
    """
    keep = [c for c in df.columns if c != text] if keep is None else keep
    src = df.select(*keep, df[text].alias(inner := free_name(df.select(*keep), "text_")))
    ids, decoded = free_name(src, ids), free_name(src, decoded)
    schema = T.StructType([*src.drop(inner).schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False)), T.StructField(decoded, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = worker_cache(f"pieces {model_path}", lambda: ChunkTable(model_path))
        for batch in batches:
            for part in slices(batch, inner):
                texts = [x or "" for x in part.column(inner).to_pylist()]
                coded = own.encode(texts)
                offsets = np.zeros(len(coded) + 1, np.int32)
                np.cumsum([len(x) for x in coded], out=offsets[1:])
                back = [own.model.decode(x.tolist()) if len(x) else "" for x in coded]
                arrays = [part.column(i) for i, c in enumerate(part.schema.names) if c != inner]
                flat = np.concatenate(coded) if coded else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(back, pa.string())], names=schema.names)

    return src.mapInArrow(run, schema)
