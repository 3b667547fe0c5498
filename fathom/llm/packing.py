"""Best-fit packing into bins of fixed capacity, with conflicts of source and duplicate cluster."""

from __future__ import annotations

from bisect import insort
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.llm.common import free_name, slices, small_batches, worker_cache, written

#: Tokens of a bin, and pieces that are packed together (by hash; what one task holds).
CAPACITY, GROUP = 2048, 2048


class Bins:
    """Bins in order of their residual. Each carries a bitmap of sources and one of clusters; a piece that shares a bit does not fit."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_residual: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.present = 0  # bit r: some bin has residual r
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.used: list[int] = []

    def place(self, length: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, start): the compatible bin with the least residual that is enough, the earliest of those; else a new one."""
        ahead = self.present >> length << length
        while ahead:
            residual = (ahead & -ahead).bit_length() - 1
            for at, b in enumerate(self.by_residual[residual]):
                if not (self.sources[b] & source or self.clusters[b] & cluster):
                    self._move(at, b, residual, length)
                    self.sources[b] |= source
                    self.clusters[b] |= cluster
                    self.used[b] += length
                    return b, self.used[b] - length
            ahead &= ahead - 1  # the successor
        b = len(self.used)
        self.sources.append(source), self.clusters.append(cluster), self.used.append(length)
        self._add(b, self.capacity - length)
        return b, 0

    def _add(self, b: int, residual: int) -> None:
        insort(self.by_residual[residual], b)
        self.present |= 1 << residual

    def _move(self, at: int, b: int, residual: int, length: int) -> None:
        self.by_residual[residual].pop(at)
        if not self.by_residual[residual]:
            self.present &= ~(1 << residual)
        self._add(b, residual - length)


def pack_group(pieces: list[tuple], capacity: int) -> list[tuple[int, int]]:
    """(bin, start) of each piece (length, source, cluster), taken in the order given, at the tightest compatible bin."""
    bins, source_bits, cluster_bits, out = Bins(capacity), {}, {}, []
    repeated = {c for c, n in Counter(p[2] for p in pieces).items() if n > 1 and c is not None}
    for length, source, cluster in pieces:
        s = 0 if source is None else source_bits.setdefault(source, 1 << len(source_bits))
        c = cluster_bits.setdefault(cluster, 1 << len(cluster_bits)) if cluster in repeated else 0
        out.append(bins.place(length, s, c))
    return out


#: How text is split before merges, as the ranks were made for (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def token_lengths(docs: DataFrame, ranks_path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep's columns (all but text if None) with n_tokens of the whole text by a vocabulary of ranks, special strings being ordinary text; 0 for null. A taken name gets an underscore.

    For lengths alone the library's encoder is faster than prefix tables; the counts are the same.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    src = docs.select(*keep, docs[text].alias(inner := free_name(docs.select(*keep), "text_")))
    name = free_name(src, "n_tokens")
    schema = T.StructType([*src.drop(inner).schema.fields, T.StructField(name, T.LongType())])

    def encoder():
        import base64

        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        return tiktoken.Encoding("lengths", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = worker_cache(f"lengths {ranks_path}", encoder)
        for batch in batches:
            for part in slices(batch, inner):
                n = [len(own.encode_ordinary(x)) if x else 0 for x in part.column(inner).to_pylist()]
                arrays = [part.column(i) for i, c in enumerate(part.schema.names) if c != inner]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(n, pa.int64())], names=schema.names)

    return src.mapInArrow(run, schema)


def same_words(text: str = "text") -> Column:
    """A cluster of texts that are equal but for case and white space; null where there is nothing else."""
    own = F.lower(F.col(text))
    for c in " \n\r\t":
        own = F.replace(own, F.lit(c), F.lit(""))
    return F.when(own != "", F.xxhash64(own))


def pack(docs: DataFrame, length: Column, cluster: Column, capacity: int = CAPACITY, group: int = GROUP, key: str = "doc_id", source: str = "source") -> DataFrame:
    """doc_id, piece, length, bin and start of every piece of every row of docs.

    A row longer than capacity is cut into full pieces and a rest. No bin holds two pieces of one source or of one cluster
    (null: no conflict). Lengths and clusters are written first, so they are found once. Pieces are dealt by hash of key, cluster and piece to groups of about `group`, which are packed
    on their own: bins are numbered group * 2**32 + number in the group, and a group depends on its pieces alone. Rows of
    no length lie in no bin (bin and start null, piece 0). Pieces that are equal in all respects get a bin each.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), cluster.cast("long").alias("cluster"), F.coalesce(length.cast("long"), F.lit(0)).alias("whole"))
    with small_batches(docs.sparkSession):
        rows = written(rows, "lengths")
    pieces = rows.where("whole > 0").select("*", F.explode(F.sequence(F.lit(0), ((F.col("whole") - 1) / capacity).cast("int"))).alias("piece"))
    pieces = pieces.select("doc_id", "source", "cluster", "piece", F.least(F.lit(capacity), F.col("whole") - F.col("piece").cast("long") * capacity).alias("length"))
    total = rows.where("whole > 0").agg(F.sum(F.ceil(F.col("whole") / capacity))).first()[0] or 0
    groups = max(1, -(-int(total) // group))
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "cluster", "piece"), F.lit(groups)))

    def packed(own: pa.Table) -> pa.Table:
        """Longest first, then by key, piece and cluster; null keys first."""
        order = [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("cluster", "ascending")]
        own = own.take(pc.sort_indices(own, sort_keys=order, null_placement="at_start"))
        placed = pack_group(list(zip(*(own.column(c).to_pylist() for c in ("length", "source", "cluster")), strict=True)), capacity)
        first = own.column("group")[0].as_py() << 32
        columns = [own.column("doc_id"), own.column("piece"), own.column("length"), pa.array([first + b for b, _ in placed], pa.int64()), pa.array([s for _, s in placed], pa.int64())]
        return pa.table(columns, names=["doc_id", "piece", "length", "bin", "start"])

    placed = dealt.groupBy("group").applyInArrow(packed, "doc_id long, piece int, length long, bin long, start long")
    none = rows.where("whole <= 0").select("doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("length"), F.lit(None).cast("long").alias("bin"), F.lit(None).cast("long").alias("start"))
    return placed.unionByName(none)
