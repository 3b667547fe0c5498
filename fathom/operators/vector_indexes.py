"""Two approximate indexes that are saved, loaded and added to: product codes of residuals in lists, and layered neighbour graphs of shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.operators.descent import matrix, unit_rows
from fathom.operators.index import FIT_ROWS, LIST_ROWS, MOST_LISTS, centroids_of
from fathom.operators.tables import written

#: Parts of a vector with a code of one byte each, code words of a part, and rows that are reranked for each result.
PARTS, WORDS, RERANK = 8, 256, 20
#: Codes that meet a list's queries in one task.
BLOCK = 1 << 16
#: Rows of a shard, neighbours of a node in upper layers (twice as many in the lowest), and the beam's width.
SHARD, LINKS, BEAM = 8192, 16, 100


def best_rows(found: DataFrame, k: int) -> DataFrame:
    """(a, b, score, rank): the k best b of each a, ties to the lesser."""
    w = Window.partitionBy("a").orderBy(F.desc("score"), "b")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def code_books(x: np.ndarray, parts: int, words: int, rounds: int = 8) -> list[np.ndarray]:
    """For each of `parts` even parts of the dimensions, words by k-means from evenly spaced rows."""
    books = []
    for lo, hi in zip(*(lambda e: (e[:-1], e[1:]))(np.arange(parts + 1) * x.shape[1] // parts), strict=True):
        own = x[:, lo:hi]
        book = own[np.linspace(0, len(own) - 1, min(words, len(own))).astype(int)].copy()
        for _ in range(rounds):
            near = ((own * own).sum(1)[:, None] - 2 * own @ book.T + (book * book).sum(1)).argmin(1)
            sums, n = np.zeros_like(book), np.bincount(near, minlength=len(book))
            np.add.at(sums, near, own)
            book[n > 0] = sums[n > 0] / n[n > 0, None]
        books.append(book)
    return books


class CodedIndex:
    """Rows (id, list, code, v): unit vectors under their nearest centroid, with a byte for each part of what the centroid leaves.

    A search reads codes of the lists it probes: a query's product with a vector is that with the centroid plus a sum over parts of
    entries of the query's tables. The best by estimate are ranked by exact products, for which alone vectors are read. All lists
    and a rerank of all rows make it exact.
    """

    def __init__(self, rows: DataFrame, centroids: np.ndarray, books: list[np.ndarray]):
        self.rows, self.centroids, self.books = rows, centroids, books

    @classmethod
    def build(cls, df: DataFrame, key: str, vector: str, lists: int | None = None, parts: int = PARTS, words: int = WORDS) -> CodedIndex:
        """Centroids and words are fitted on at most FIT_ROWS vectors, taken by hash; every row with an id and a sound vector is indexed. ValueError without any."""
        rows = unit_rows(df, key, vector)
        sample = np.array([r.v for r in rows.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).collect()])
        if not len(sample):
            raise ValueError("no vectors to build an index on")
        own = centroids_of(sample, min(lists or max(1, min(MOST_LISTS, rows.count() // LIST_ROWS)), len(sample)))
        rest = sample - own[(sample @ own.T).argmax(1)]
        index = cls(rows, own, code_books(rest, min(parts, sample.shape[1]), words))
        index.rows = written(index._coded(rows), "coded")
        return index

    def _coded(self, rows: DataFrame) -> DataFrame:
        model = rows.sparkSession.sparkContext.broadcast((self.centroids, self.books))  # at most MOST_LISTS vectors, and words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centroids, books = model.value
            ends = np.cumsum([0, *[b.shape[1] for b in books]])
            for batch in batches:
                if batch.num_rows:
                    x = matrix(batch.column("v"))
                    near = (x @ centroids.T).argmax(1)
                    rest = x - centroids[near]
                    codes = np.stack([((b * b).sum(1) - 2 * rest[:, ends[p] : ends[p + 1]] @ b.T).argmin(1) for p, b in enumerate(books)], 1).astype(np.uint8)
                    yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(near.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column("v")], names=["id", "list", "code", "v"])

        return rows.mapInArrow(run, "id long, list int, code binary, v array<double>")

    def add(self, df: DataFrame, key: str, vector: str) -> CodedIndex:
        """The index with more rows, under the centroids and words it has; nothing that is there is touched."""
        more = written(self._coded(unit_rows(df, key, vector)), "coded")
        return CodedIndex(self.rows.unionByName(more), self.centroids, self.books)

    def save(self, path: str) -> None:
        """Rows by list, so that a search of some lists reads those files only, and the model as one row."""
        self.rows.repartition("list").write.partitionBy("list").parquet(f"{path}/rows")
        model = [(self.centroids.shape[1], self.centroids.tobytes(), [b.tobytes() for b in self.books], [b.shape[1] for b in self.books])]
        self.rows.sparkSession.createDataFrame(model, "dims int, centroids binary, books array<binary>, widths array<int>").coalesce(1).write.parquet(f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CodedIndex:
        m = spark.read.parquet(f"{path}/model").first()
        books = [np.frombuffer(b, np.float64).reshape(-1, w) for b, w in zip(m.books, m.widths, strict=True)]
        rows = spark.read.parquet(f"{path}/rows").select("id", F.col("list").cast("int").alias("list"), "code", "v")
        return cls(rows, np.frombuffer(m.centroids, np.float64).reshape(-1, m.dims), books)

    def search(self, queries: DataFrame, key: str, vector: str, k: int, probe: int = 8, rerank: int = RERANK) -> DataFrame:
        """(a, b, score, rank): for each query (a) the k rows (b) found nearest by cosine, its own id left out; rerank * k estimates are looked at exactly."""
        spark = queries.sparkSession
        model = spark.sparkContext.broadcast((self.centroids, self.books))
        asked = written(unit_rows(queries, key, vector), "asked")

        def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centroids, _ = model.value
            for batch in batches:
                if batch.num_rows:
                    base = matrix(batch.column("v")) @ centroids.T
                    near = np.argsort(-base, axis=1, kind="stable")[:, :probe]
                    part = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1])))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(near.ravel().astype(np.int32)), pa.array(np.take_along_axis(base, near, 1).ravel())], names=["id", "v", "list", "base"])

        sizes = self.rows.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("of"))  # MOST_LISTS rows
        left = asked.mapInArrow(probes, "id long, v array<double>, list int, base double").join(F.broadcast(sizes), "list").withColumn("g", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
        right = self.rows.select("id", "list", "code").join(F.broadcast(sizes), "list").withColumn("g", F.pmod(F.xxhash64("id"), F.col("of")).cast("int"))
        most = rerank * k

        def estimates(asks: pa.Table, codes: pa.Table) -> pa.Table:
            a, b = asks.column("id").to_numpy(), codes.column("id").to_numpy()
            out = {"a": [], "b": [], "score": []}
            if len(a) and len(b):
                _, books = model.value
                ends = np.cumsum([0, *[x.shape[1] for x in books]])
                q, base = matrix(asks.column("v")), asks.column("base").to_numpy()
                code = np.frombuffer(b"".join(codes.column("code").to_pylist()), np.uint8).reshape(len(b), -1)
                for i in range(len(a)):
                    score = np.full(len(b), base[i])
                    for p, book in enumerate(books):
                        score += (book @ q[i, ends[p] : ends[p + 1]])[code[:, p]]
                    score[b == a[i]] = -np.inf
                    top = np.argpartition(-score, most)[:most] if len(b) > most else np.arange(len(b))
                    top = top[np.isfinite(score[top])]
                    out["a"].append(np.full(len(top), a[i])), out["b"].append(b[top]), out["score"].append(score[top])
            kinds = {"a": np.int64, "b": np.int64, "score": np.float64}
            return pa.table({c: np.concatenate(x) if x else np.zeros(0, kinds[c]) for c, x in out.items()})

        found = left.drop("of").groupBy("list", "g").cogroup(right.drop("of").groupBy("list", "g")).applyInArrow(estimates, "a long, b long, score double")
        few = written(best_rows(found, most).select("a", "b"), "shortlist")
        exact = few.join(self.rows.select(F.col("id").alias("b"), F.col("v").alias("y")), "b").join(asked.select(F.col("id").alias("a"), F.col("v").alias("x")), "a")
        product = F.aggregate(F.zip_with("x", "y", lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
        return best_rows(exact.select("a", "b", F.round(product, 6).alias("score")), k)


def layers_of(ids: np.ndarray, x: np.ndarray, links: int) -> tuple[np.ndarray, list[list[list[int]]]]:
    """Each node's top layer, and for each node and layer up to its top its neighbours there.

    A node reaches layer l with chance links**-l, by its id. In a layer it is tied to its nearest, and they to it; of more than twice as many
    ties the nearest stay.
    """
    chance = np.array([np.random.default_rng(abs(int(i))).random() for i in ids])
    top = np.minimum((-np.log(np.maximum(chance, 1e-12)) / np.log(links)).astype(int), 8)
    out: list[list[list[int]]] = [[[] for _ in range(t + 1)] for t in top]
    for layer in range(int(top.max(initial=0)) + 1):
        own = np.flatnonzero(top >= layer)
        most = links * (2 if layer == 0 else 1)
        n = min(most, len(own) - 1)
        if n < 1:
            continue
        ties: list[set[int]] = [set() for _ in own]
        for at in range(0, len(own), 1024):
            s = x[own[at : at + 1024]] @ x[own].T
            s[np.arange(len(s)), at + np.arange(len(s))] = -np.inf
            for i, near in enumerate(np.argpartition(-s, n - 1, axis=1)[:, :n]):
                ties[at + i].update(near.tolist())
        back: list[list[int]] = [[] for _ in own]
        for i, t in enumerate(ties):
            for j in t:
                back[j].append(i)
        for i, t in enumerate(ties):
            every = np.array(sorted(t.union(back[i])))
            if len(every) > 2 * n:
                every = every[np.argsort(-(x[own[every]] @ x[own[i]]), kind="stable")[: 2 * n]]
            out[own[i]][layer] = own[every].tolist()
    return top, out


def walk(q: np.ndarray, x: np.ndarray, top: np.ndarray, links: list, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and products of the ef nearest that a beam finds: greedily down the layers, then over the lowest until the beam's worst is nearer than what is left."""
    import heapq

    at = int(top.argmax())
    for layer in range(int(top[at]), 0, -1):
        while links[at][layer]:
            near = np.array(links[at][layer])
            s = x[near] @ q
            if s.max() <= x[at] @ q:
                break
            at = int(near[s.argmax()])
    seen = np.zeros(len(x), bool)
    seen[at] = True
    first = float(x[at] @ q)
    waiting, best = [(-first, at)], [(first, at)]
    while waiting:
        s, node = heapq.heappop(waiting)
        if len(best) >= ef and -s < best[0][0]:
            break
        near = np.array(links[node][0], int)
        near = near[~seen[near]]
        seen[near] = True
        for v, i in zip((x[near] @ q).tolist(), near.tolist(), strict=True):
            if len(best) < ef or v > best[0][0]:
                heapq.heappush(waiting, (-v, i))
                heapq.heappush(best, (v, i))
                if len(best) > ef:
                    heapq.heappop(best)
    return np.array([i for _, i in best]), np.array([v for v, _ in best])


class LayeredIndex:
    """Rows (shard, node, id, top, links, v): shards of unit vectors, each a layered graph of its own; a search walks every shard and merges what it finds.

    Shards are dealt by hash and hold about SHARD rows. Rows that are added make shards of their own, so nothing is rebuilt; compact()
    puts shards that are under half full together.
    """

    SCHEMA = "shard int, node int, id long, top int, links array<array<int>>, v array<double>"

    def __init__(self, rows: DataFrame, links: int = LINKS, shard: int = SHARD):
        self.rows, self.links, self.shard = rows, links, shard

    @classmethod
    def build(cls, df: DataFrame, key: str, vector: str, links: int = LINKS, shard: int = SHARD) -> LayeredIndex:
        index = cls(df, links, shard)
        index.rows = index._sharded(unit_rows(df, key, vector), 0)
        return index

    def _sharded(self, rows: DataFrame, first: int) -> DataFrame:
        links = self.links
        rows = written(rows, "vectors")
        n = max(1, -(-rows.count() // self.shard))

        def layered(own: pa.Table) -> pa.Table:
            ids, x = own.column("id").to_numpy(), matrix(own.column("v"))
            top, near = layers_of(ids, x, links)
            return pa.table({"shard": own.column("shard"), "node": pa.array(np.arange(len(ids), dtype=np.int32)), "id": ids, "top": pa.array(top.astype(np.int32)), "links": pa.array(near, pa.list_(pa.list_(pa.int32()))), "v": own.column("v")})

        dealt = rows.select((F.pmod(F.xxhash64("id"), F.lit(n)) + first).cast("int").alias("shard"), "id", "v")
        return written(dealt.groupBy("shard").applyInArrow(layered, self.SCHEMA), "layers")

    def add(self, df: DataFrame, key: str, vector: str) -> LayeredIndex:
        """The index with more rows, in shards after the ones it has."""
        last = self.rows.agg(F.max("shard")).first()[0]
        more = self._sharded(unit_rows(df, key, vector), 0 if last is None else last + 1)
        return LayeredIndex(self.rows.unionByName(more), self.links, self.shard)

    def compact(self) -> LayeredIndex:
        """The index with its shards under half full dealt anew to full ones."""
        sizes = written(self.rows.groupBy("shard").agg(F.count("*").alias("n")), "sizes")
        small = sizes.where(F.col("n") * 2 < self.shard).select("shard")
        if small.count() < 2:
            return self
        last = self.rows.agg(F.max("shard")).first()[0]
        anew = self._sharded(self.rows.join(F.broadcast(small), "shard").select("id", "v"), last + 1)  # a row a shard
        return LayeredIndex(self.rows.join(F.broadcast(small), "shard", "left_anti").select(anew.columns).unionByName(anew), self.links, self.shard)

    def save(self, path: str) -> None:
        self.rows.withColumns({"links_": F.lit(self.links), "rows_": F.lit(self.shard)}).write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LayeredIndex:
        """ValueError where nothing was saved."""
        rows = spark.read.parquet(path)
        first = rows.select("links_", "rows_").first()
        if first is None:
            raise ValueError("an empty index")
        return cls(rows.drop("links_", "rows_"), first.links_, first.rows_)

    def search(self, queries: DataFrame, key: str, vector: str, k: int, ef: int = BEAM, block: int = 1024) -> DataFrame:
        """(a, b, score, rank): for each query (a) the k rows (b) found nearest by cosine, its own id left out. ef: the beam's width in each shard, k + 1 at least.

        A task holds one shard and one block of queries; each leaves k rows for each of its queries.
        """
        asked = written(unit_rows(queries, key, vector), "asked")
        n = max(1, -(-asked.count() // block))
        shards = sorted(r.shard for r in self.rows.select("shard").distinct().collect())  # a number a shard
        left = asked.withColumn("g", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn("shard", F.explode(F.lit(shards)))
        right = self.rows.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        width = max(ef, k + 1)

        def walked(asks: pa.Table, own: pa.Table) -> pa.Table:
            out = {"a": [], "b": [], "score": []}
            if asks.num_rows and own.num_rows:
                own = own.sort_by("node")
                ids, x, top, links = own.column("id").to_numpy(), matrix(own.column("v")), own.column("top").to_numpy(), own.column("links").to_pylist()
                for a, q in zip(asks.column("id").to_pylist(), matrix(asks.column("v")), strict=True):
                    nodes, s = walk(q, x, top, links, width)
                    order = np.lexsort((ids[nodes], -np.round(s, 6)))
                    order = order[ids[nodes][order] != a][:k]
                    out["a"].append(np.full(len(order), a)), out["b"].append(ids[nodes][order]), out["score"].append(np.round(s[order], 6))
            kinds = {"a": np.int64, "b": np.int64, "score": np.float64}
            return pa.table({c: np.concatenate(v) if v else np.zeros(0, kinds[c]) for c, v in out.items()})

        found = left.groupBy("shard", "g").cogroup(right.groupBy("shard", "g")).applyInArrow(walked, "a long, b long, score double")
        return best_rows(found, k)
