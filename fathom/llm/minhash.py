"""Near-duplicate documents: many universal hash minima, banding, signature and set verification, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import slices, small_batches, written
from fathom.llm.components import connected_components
from fathom.llm.shingles import shingle_hashes, shingle_set

#: Bands of so many minima. A pair at 0.8 shares no band with probability (1 - 0.8**4)**32, below 5e-8.
BANDS, ROWS = 32, 4
MINIMA = BANDS * ROWS
#: Of each minimum two bits are kept as the sketch. Pairs at 0.8 agree in 109 of 128 minima there, with a deviation of 4; those that differ in more than this go no further.
SKETCH_MOST = 41
#: Cells that count in how many sets a shingle is, for an order with the rare ones first; any order is exact.
CELLS = 1 << 18
#: Sets that share a prefix shingle beyond which they are dealt to blocks.
MANY = 2048
#: Pairs of one document that a task verifies one after another; the pairs of a document with more are dealt to several.
HUB = 128
#: Rows up to which ids and pairs are broadcast (16 bytes each at most); beyond it they are joined by shuffle.
BROADCAST_IDS = 200_000
_SEED = 20240


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(_SEED)
    return rng.integers(0, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, MINIMA, dtype=np.uint64)


def minima(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least value of each universal hash (multiply, add, upper half) over the set."""
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(hashes), 2048):
        np.minimum(out, ((a[:, None] * hashes[None, at : at + 2048] + b[:, None]) >> np.uint64(32)).astype(np.uint32).min(1), out=out)
    return out


def signatures(docs: DataFrame, n: int, key: str, text: str) -> DataFrame:
    """(id, n_shingles, digest, bands, sketch) of each row: set size, the set's 128-bit hash, one hash of each band, two bits of each minimum; null for empty sets.

    The sketch is four longs: the lowest bits of minima 0 to 63 and 64 to 127, then the next ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _multipliers()
        for batch in batches:
            for part in slices(batch, "text"):
                sizes, digests, bands, sketches = [], [], [], []
                for x in part.column("text").to_pylist():
                    hashes = shingle_hashes(x, n)
                    sizes.append(len(hashes))
                    if not len(hashes):
                        digests.append(None), bands.append(None), sketches.append(None)
                        continue
                    low = minima(hashes, a, b)
                    digests.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                    bands.append([xxhash.xxh3_64_intdigest(low[k * ROWS : (k + 1) * ROWS].tobytes(), seed=k) - (1 << 63) for k in range(BANDS)])
                    planes = np.concatenate([low & np.uint32(1), low >> np.uint32(1) & np.uint32(1)]).astype(np.uint8)
                    sketches.append(np.packbits(planes).view(np.int64).tolist())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))], names=["id", "n_shingles", "digest", "bands", "sketch"])

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, n_shingles long, digest binary, bands array<long>, sketch array<long>")


def _alike(x: str, y: str, percent: int):
    small, large = F.least(x, y), F.greatest(x, y)
    return small * 100 >= large * percent


def _apart(x: str, y: str) -> Column:
    """Minima in which two sketches differ."""
    p, q = F.col(x), F.col(y)
    differ = lambda i: F.bit_count(p[i].bitwiseXOR(q[i]).bitwiseOR(p[i + 2].bitwiseXOR(q[i + 2])))
    return differ(0) + differ(1)


def _near(x: str, y: str) -> Column:
    """Whether two sketches differ in few enough minima."""
    return _apart(x, y) <= SKETCH_MOST


def _hub_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Each bucket's members with its least id: distinct (a, b), a < b, that sizes and sketches allow."""
    hubs = members.groupBy("bucket").agg(F.min(F.struct("id", "n", "sketch")).alias("hub")).select("bucket", F.col("hub.id").alias("h"), F.col("hub.n").alias("nh"), F.col("hub.sketch").alias("kh"))
    x, y = members.alias("x"), hubs.alias("y")
    met = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("id") != F.col("h")) & _alike("n", "nh", percent) & _near("sketch", "kh"))
    return met.select(F.col("h").alias("a"), F.col("id").alias("b")).distinct()


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, label) of the classes in buckets that hold several components: members outside a bucket's largest component, and all classes of those components."""
    marked = members.select("bucket", "id").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    each = marked.groupBy("bucket", "label").agg(F.count("*").alias("c"))
    state = each.groupBy("bucket").agg(F.max(F.struct("c", "label")).alias("most"), F.count("*").alias("k")).where("k > 1").select("bucket", F.col("most.label").alias("main"))
    outside = written(marked.join(state, "bucket").where("label != main").select("id", "label", "main").distinct(), "outside")
    mains = outside.select(F.col("main").alias("label")).distinct()
    inside = labels.join(mains, "label").select("id", "label").unionByName(mains.select(F.col("label").alias("id"), "label"))
    return outside.select("id", "label").unionByName(inside).distinct()


def _texts(docs: DataFrame, ids: DataFrame, key: str, text: str) -> DataFrame:
    """ids with the text of the documents that have them. Ids up to BROADCAST_IDS are broadcast, more are joined by shuffle."""
    ids = written(ids, "ids")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    own = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where("id is not null and text is not null")
    return own.join(ids, "id")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All hashes of a column of sets, and where each set begins in them (one more than sets)."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.uint64) if offsets[-1] > offsets[0] else np.zeros(0, np.uint64)
    return data, (offsets - offsets[0]) // 8


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(CELLS - 1)).astype(np.int64)


def frequencies(sets: DataFrame) -> np.ndarray:
    """In how many sets each of CELLS cells of hashes is met: CELLS numbers, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            total += np.bincount(_cells(_flat(batch.column("set"))[0]), minlength=CELLS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["cell", "n"])

    found = sets.select("set").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CELLS, np.int64)
    out[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return out


def _prefix(n: int, percent: int) -> int:
    """Shingles of a set of n, first in a global order, among which it meets each similar set: at least percent of it are in both, and of those one is within the rest and one."""
    return n - -(-percent * n // 100) + 1


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(token, id, n, label, sketch, place): of each set the shingles rarest among all these sets that _prefix asks for, with their place in that order."""
    rank = sets.sparkSession.sparkContext.broadcast(frequencies(sets))  # CELLS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, tokens, places = [], [], []
            flat, at = _flat(batch.column("set"))
            for i in range(batch.num_rows):
                own = flat[at[i] : at[i + 1]]
                first = np.lexsort((own, rank.value[_cells(own)]))[: _prefix(len(own), percent)]
                rows.append(np.full(len(first), i)), tokens.append(own[first].view(np.int64)), places.append(np.arange(len(first)))
            if rows:
                part = batch.select(["id", "n", "label", "sketch"]).take(pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), *part.columns, pa.array(np.concatenate(places))], names=["token", "id", "n", "label", "sketch", "place"])

    return sets.mapInArrow(run, "token long, id long, n long, label long, sketch array<long>, place long")


def _candidates(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b, la, lb, apart) of sets of different labels that share a prefix shingle and whose sizes, places and sketches allow it; a pair may come more than once.

    Similar sets have 100 * both >= percent * (|x| + |y| - both). All they share comes at or after the first shared shingle, so there
    must be that many from its place on in either; a set with more shingles of its own before it is passed over.
    Of a shingle's sets those with its most frequent label are the one side only: a family of near copies does not meet itself, and what is
    enumerated is within four times the pairs of different labels.
    Shingles of more than MANY sets are dealt to a square of blocks, so a task meets bounded parts of them.
    """
    labelled = rows.groupBy("token", "label").agg(F.count("*").alias("c")).groupBy("token").agg(F.sum("c").alias("c"), F.max(F.struct("c", "label")).alias("m"), F.count("*").alias("labels"))
    labelled = written(labelled.where("labels > 1").select("token", "c", F.col("m.label").alias("main")), "labelled")
    mixed = F.broadcast(labelled.select("token", "main")) if labelled.count() <= BROADCAST_IDS else labelled.select("token", "main")
    rows = rows.join(mixed, "token")
    busy = written(labelled.where(F.col("c") > MANY).select("token", F.ceil(F.col("c") / MANY).cast("int").alias("of")), "busy")
    busy = F.broadcast(busy) if busy.count() <= BROADCAST_IDS else busy
    dealt = rows.join(busy, "token", "left").withColumn("of", F.coalesce("of", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("id"), F.col("of")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("of") - 1))
    x = dealt.where("label != main").withColumn("other", others).select("token", F.col("own").alias("i"), F.col("other").alias("j"), "id", "n", "label", "sketch", "place", "main")
    y = dealt.withColumn("other", others).select("token", F.col("other").alias("i"), F.col("own").alias("j"), "id", "n", "label", "sketch", "place", "main")
    x, y = x.toDF("token", "i", "j", *[f"{c}_x" for c in x.columns[3:]]), y.toDF("token", "i", "j", *[f"{c}_y" for c in y.columns[3:]])
    left = F.expr(f"least(n_x - place_x, n_y - place_y) * {100 + percent} >= (n_x + n_y) * {percent}")
    # two sets beside the main label meet twice, and once is enough
    met = x.join(y, ["token", "i", "j"]).where("label_x != label_y and (label_y = main_y or id_x < id_y)").where(_alike("n_x", "n_y", percent) & left & _near("sketch_x", "sketch_y"))
    swap = F.col("label_x") > F.col("label_y")
    of = lambda c: (F.when(swap, F.col(f"{c}_y")).otherwise(F.col(f"{c}_x")), F.when(swap, F.col(f"{c}_x")).otherwise(F.col(f"{c}_y")))
    return met.select(of("id")[0].alias("a"), of("id")[1].alias("b"), of("label")[0].alias("la"), of("label")[1].alias("lb"), _apart("sketch_x", "sketch_y").alias("apart"))


def _rest_links(opened: DataFrame, reps: DataFrame, docs: DataFrame, n: int, percent: int, key: str, text: str) -> DataFrame:
    """Links between different components of opened, by an exact prefix filter over their whole sets.

    Of two components the pair with the nearest sketches is verified first, as one link joins them; only where it fails are
    their other pairs.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [shingle_hashes(x, n).tobytes() for x in part.column("text").to_pylist()]
                # an id may have other texts, of other classes
                mine = pa.array([xxhash.xxh3_128_digest(x) == d for x, d in zip(sets, part.column("digest").to_pylist(), strict=True)], pa.bool_())
                yield part.select(["id", "n", "label", "sketch"]).append_column("set", pa.array(sets, pa.binary())).filter(mine)

    own = _texts(docs, opened.join(reps.select("id", "n", "sketch", "digest"), "id"), key, text).select("id", "n", "label", "sketch", "digest", "text")
    sets = written(own.mapInArrow(hashed, "id long, n long, label long, sketch array<long>, set binary"), "sets")
    rows = written(_prefixes(sets, percent), "prefixes")
    met = _candidates(rows, percent)
    nearest = written(met.groupBy("la", "lb").agg(F.min(F.struct("apart", "a", "b")).alias("m")).select("la", "lb", "m.a", "m.b"), "nearest")
    links = written(_confirmed(nearest.select("a", "b"), docs, n, percent, key, text), "links")
    failed = written(nearest.join(links, ["a", "b"], "left_anti"), "failed")
    if failed.isEmpty():
        return links
    rest = met.join(failed.select("la", "lb"), ["la", "lb"], "left_semi").select("a", "b").distinct().join(failed.select("a", "b"), ["a", "b"], "left_anti")
    return links.unionByName(_confirmed(rest, docs, n, percent, key, text))


def _confirmed(pairs: DataFrame, docs: DataFrame, n: int, percent: int, key: str, text: str) -> DataFrame:
    """The pairs whose whole texts' exact shingle sets are similar enough. Only texts in some pair are moved.

    The pairs of a document `a` come to a task one after another, HUB of them about, and a's text before them, once for each such task.
    """
    pairs = written(pairs, "pairs")
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    own = written(_texts(docs, ids, key, text), "texts")
    few = pairs.count() <= BROADCAST_IDS
    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB).cast("int").alias("of"))
    hubs = written(counts.where("of > 1"), "hubs")
    of = F.broadcast(hubs) if hubs.count() <= BROADCAST_IDS else hubs
    dealt = pairs.join(of, "a", "left").withColumn("part", F.when(F.col("of").isNull(), 0).otherwise(F.pmod(F.xxhash64("b"), F.col("of"))).cast("int")).drop("of")
    second = own.toDF("b", "text").join(F.broadcast(dealt) if few else dealt, "b").select("a", "part", F.lit(1).alias("side"), "b", "text")
    first = own.toDF("a", "text").join(dealt.select("a", "part").distinct(), "a").select("a", "part", F.lit(0).alias("side"), F.lit(None).cast("long").alias("b"), "text")
    # as many tasks as the shuffles have, by the key that was dealt
    met = first.unionByName(second).repartition(F.col("a"), F.col("part")).sortWithinPartitions("a", "part", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        several: list[set] = []
        last = None
        for batch in batches:
            keep = []
            for at, side, x in zip(zip(batch.column("a").to_pylist(), batch.column("part").to_pylist(), strict=True), batch.column("side").to_pylist(), batch.column("text"), strict=True):
                own = shingle_set(x.as_py(), n)
                if at != last:
                    last, several = at, []
                if not side:  # an id may have several rows with texts of their own
                    several.append(own)
                    keep.append(False)
                    continue
                sizes = [(len(s & own), len(s)) for s in several]
                keep.append(any(both > 0 and 100 * both >= percent * (size + len(own) - both) for both, size in sizes))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return met.mapInArrow(run, "a long, b long")


def _labelled(docs: DataFrame, n: int, percent: int, key: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Written signatures, those that take part, classes of equal sets, and labels of classes that have links."""
    sig = written(signatures(docs, n, key, text), "signatures")
    live = sig.where("digest is not null and id is not null")
    classes = written(live.groupBy("digest").agg(F.min("id").alias("rep")), "classes")
    reps = written(live.join(classes, "digest").where("id = rep").select("id", F.col("n_shingles").alias("n"), "bands", "sketch", "digest"), "representatives")
    # an id with several sets ties their classes together
    several = live.groupBy("id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x != y").select("id")
    links = reps.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    if not several.isEmpty():
        twice = live.join(several, "id").join(classes, "digest").select("id", "rep")
        links = twice.groupBy("id").agg(F.min("rep").alias("a")).join(twice, "id").select("a", F.col("rep").alias("b")).where("a != b")
        links = written(links.unionByName(twice.select(F.col("id").alias("a"), F.col("rep").alias("b")).where("a != b")), "links")

    members = reps.select("id", "n", "sketch", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo != hi").select("bucket")
    members = written(members.join(shared, "bucket"), "members")
    links = written(links.unionByName(_confirmed(_hub_pairs(members, percent), docs, n, percent, key, text)), "links")
    labels = written(connected_components(links), "labels")
    opened = written(_open(members, labels), "open")
    if not opened.isEmpty():
        more = written(_rest_links(opened, reps, docs, n, percent, key, text), "links")
        if not more.isEmpty():
            labels = written(connected_components(links.unionByName(more)), "labels")
    return sig, live, classes, labels


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs.

    Two documents are linked when 100 * intersection >= percent * union of their sets of n-word shingles (fewer words: the whole
    sequence; A-Z lowered). component_id is the least id that links lead to; kept marks that document. Equal sets
    form one class, and only its least id goes on. First each member of a band's bucket meets the bucket's least id; next the
    components of buckets that hold several meet by an exact prefix filter over their sets' rarest shingles. No member is dropped.
    Candidates pass the sketch, then exact sets. Null or wordless texts are empty and linked with nothing. Rows with a
    null id are linked with nothing: component_id null, kept true. Rows with one id are one document, with
    all their sets. Other columns are not looked at.
    """
    with small_batches(docs.sparkSession):
        sig, live, classes, labels = _labelled(docs, n, percent, key, text)
    own = classes.join(labels.select(F.col("id").alias("rep"), "label"), "rep", "left").select("digest", F.coalesce("label", "rep").alias("component_id"))
    joined = live.select("id", "n_shingles", "digest").join(own, "digest").select("id", "n_shingles", "component_id")
    alone = sig.where("digest is null or id is null").select("id", "n_shingles", F.col("id").alias("component_id"))
    return joined.unionByName(alone).select(F.col("id").alias("doc_id"), "n_shingles", "component_id", (F.col("id").isNull() | (F.col("id") == F.col("component_id"))).alias("kept"))
