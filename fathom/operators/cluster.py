"""Density clustering, topics, stability and divergence."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions import dense
from fathom.functions.profiles import CATEGORY, MOST_AGREEMENT, TOPIC_AGREEMENT
from fathom.operators.graph import components
from fathom.operators.retrieve import grid, matrix_cosine, nearest_of
from fathom.operators.tables import written


#: Nodes up to which the last edges of a spanning forest meet in one task (some hundred bytes each); beyond it rounds of joins find it.
ONE_TASK_NODES = 1_000_000
#: Forests that meet in one task.
MEETING = 8


def core_distances(nearest: DataFrame, k: int = 2) -> DataFrame:
    """(id, core): distance to the k-th nearest, from (a, b, d, rank), each row's nearest ones."""
    return nearest.where(F.col("rank") == k).select(F.col("a").alias("id"), F.col("d").alias("core"))


def mutual_reachability(nearest: DataFrame, core: DataFrame) -> DataFrame:
    """(a, b, d), a < b, of the pairs in nearest (a, b, d), with d raised to either core distance."""
    pairs = nearest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "d").groupBy("a", "b").agg(F.min("d").alias("d"))
    one, two = core.toDF("a", "ca"), core.toDF("b", "cb")
    return pairs.join(one, "a").join(two, "b").select("a", "b", F.greatest("d", "ca", "cb").alias("d"))


def _forest(batches, more: tuple = ()):
    """Kruskal over the edges of one task, in the order (d, a, b): an edge that closes a circle is in no least forest, whatever other tasks hold."""
    parts = [(b.column("a").to_numpy(), b.column("b").to_numpy(), b.column("d").to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return
    a, b, d = (np.concatenate(c) for c in zip(*parts, strict=True))
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    keep = []
    for i in np.lexsort((b, a, d)).tolist():
        x, y = root(int(a[i])), root(int(b[i]))
        if x != y:
            up[x] = y
            keep.append(i)
    yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep]), pa.array(d[keep])], names=["a", "b", "d"])


def spanning_tree(edges: DataFrame) -> DataFrame:
    """(a, b, d) of the minimum spanning forest, edges ordered by (d, a, b).

    Each task first drops what closes circles among its own edges, and leaves fewer edges than nodes. Of few nodes, eight tasks' forests meet in one, in
    rounds, so no task holds more than eight times the nodes; of more, Borůvka rounds of joins find the tree: each component takes
    its least edge. The order makes the forest one and the same.
    """
    schema = "a long, b long, d double"
    edges = written(edges.select(F.col("a").cast("long"), F.col("b").cast("long"), F.col("d").cast("double")).mapInArrow(_forest, schema), "edges")
    nodes = edges.select("a").unionByName(edges.select(F.col("b").alias("a"))).distinct().count()
    if nodes <= ONE_TASK_NODES:
        parts = max(1, -(-edges.count() // max(1, MEETING * nodes)))
        while True:
            edges = written(edges.repartition(parts).mapInArrow(_forest, schema), "forest")
            if parts == 1:
                return edges
            parts = -(-parts // MEETING)
    tree: DataFrame | None = None
    labels: DataFrame | None = None
    while True:
        if labels is None:
            live = edges.withColumns({"la": F.col("a"), "lb": F.col("b")})
        else:
            live = edges.join(labels.toDF("a", "la"), "a").join(labels.toDF("b", "lb"), "b").where("la != lb")
        least = F.min(F.struct("d", "a", "b")).alias("e")
        chosen = live.groupBy(F.col("la").alias("l")).agg(least).unionByName(live.groupBy(F.col("lb").alias("l")).agg(least)).groupBy("l").agg(F.min("e").alias("e")).select("e.a", "e.b", "e.d").distinct()
        chosen = written(chosen, "chosen")
        if chosen.isEmpty():
            return tree if tree is not None else chosen
        tree = chosen if tree is None else written(tree.unionByName(chosen), "tree")
        labels = components(tree)


def _dense_tree(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of a least spanning tree's edges, by Prim over a matrix of distances; inf where there is no edge."""
    n = len(d)
    best, near = d[0].copy(), np.zeros(n, np.int64)
    out = np.zeros(n, bool)
    out[0] = True
    i, j = np.zeros(n - 1, np.int64), np.zeros(n - 1, np.int64)
    for step in range(n - 1):
        at = int(np.where(out, np.inf, best).argmin())
        i[step], j[step] = near[at], at
        out[at] = True
        closer = d[at] < best
        best[closer], near[closer] = d[at][closer], at
    return i, j


def _halves(own: pa.Table) -> tuple[pa.Table, pa.Table]:
    """First and second of the pairs that meet in a cell."""
    return tuple(own.filter(pc.equal(own.column("part"), i)) for i in (0, 1))


def core_by(rows: DataFrame, distance: Callable[[pa.Table, pa.Table], np.ndarray], k: int = 2, block: int = 1024) -> DataFrame:
    """(id, core): distance to the k-th nearest of all rows (id and what distance looks at), or to the farthest of fewer. Blocks meet in a grid and leave k numbers a row."""
    cells, _ = grid(rows, block, half=False)

    def least(own: pa.Table) -> pa.Table:
        p, q = _halves(own)
        if not p.num_rows or not q.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "d": pa.array([], pa.float64())})
        a, b = p.column("id").to_numpy(), q.column("id").to_numpy()
        d = np.where(a[:, None] == b[None, :], np.inf, np.round(distance(p, q), 6))
        few = np.sort(d, axis=1)[:, :k]
        real = np.isfinite(few)
        return pa.table({"id": np.repeat(a, few.shape[1])[real.ravel()], "d": few[real]})

    each = cells.groupBy("cell").applyInArrow(least, "id long, d double").withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("d"))).where(F.col("n") <= k)
    return each.groupBy("id").agg(F.max("d").alias("core"))


def exact_tree(rows: DataFrame, distance: Callable[[pa.Table, pa.Table], np.ndarray], k: int = 2, block: int = 1024) -> DataFrame:
    """(a, b, d): a least spanning tree of mutual reachability over all pairs of rows (id and what distance looks at).

    Rows are dealt to a grid of blocks, after core_by has left each row's distance to its k-th nearest. Each pair of blocks leaves the least
    tree of its own pairs, for an edge that isn't in it is in no least tree of all. What is left is linear in rows for each
    block. Distances are rounded to six digits. One row has no edges.
    """
    rows = written(rows, "rows")
    core = written(core_by(rows, distance, k, block), "core")
    half, side = grid(rows.join(core, "id"), block, half=True)

    def tree(own: pa.Table) -> pa.Table:
        p, q = _halves(own)
        empty = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "d": pa.array([], pa.float64())})
        if not p.num_rows or not q.num_rows:
            return empty
        x, y, ids = (p.column("id").to_numpy(), q.column("id").to_numpy(), p.column("id").to_numpy())
        d = np.maximum(np.maximum(np.round(distance(p, q), 6), p.column("core").to_numpy()[:, None]), q.column("core").to_numpy()[None, :])
        cell = own.column("cell")[0].as_py()
        if cell // side == cell % side:
            d = d[:, np.argsort(y)][np.argsort(x)]
            ids = np.sort(x)
            np.fill_diagonal(d, np.inf)
        else:  # rows of different blocks only
            ids = np.concatenate([x, y])
            whole = np.full((len(ids), len(ids)), np.inf)
            whole[: len(x), len(x) :], whole[len(x) :, : len(x)] = d, d.T
            d = whole
        if len(ids) < 2:
            return empty
        i, j = _dense_tree(d)
        return pa.table({"a": np.minimum(ids[i], ids[j]), "b": np.maximum(ids[i], ids[j]), "d": d[i, j]})

    return spanning_tree(half.groupBy("cell").applyInArrow(tree, "a long, b long, d double"))


def vector_distance(p: pa.Table, q: pa.Table) -> np.ndarray:
    """Cosine distance of the columns v."""
    x, y = (np.stack(t.column("v").to_pandas().to_numpy()) for t in (p, q))
    return 1 - np.round(matrix_cosine(x, y), 6)


def fingerprint_distance(weights: dict[str, float]) -> Callable[[pa.Table, pa.Table], np.ndarray]:
    """One less the weighted mean of (cosine + 1) / 2 over the spaces (columns) that both rows have; 1 where they have none in common. A null vector is a missing space."""

    def distance(p: pa.Table, q: pa.Table) -> np.ndarray:
        total, weight = np.zeros((p.num_rows, q.num_rows)), np.zeros((p.num_rows, q.num_rows))
        for space, w in weights.items():
            i, j = (np.flatnonzero(t.column(space).is_valid().to_numpy()) for t in (p, q))
            if len(i) and len(j):
                x, y = (np.stack(t.column(space).take(pa.array(at)).to_pandas().to_numpy()) for t, at in ((p, i), (q, j)))
                total[np.ix_(i, j)] += w * (matrix_cosine(x, y) + 1) / 2
                weight[np.ix_(i, j)] += w
        return 1 - np.divide(total, weight, out=np.zeros_like(total), where=weight > 0)

    return distance


def gap_threshold(tree: DataFrame, least_gap: float = 0.02, floor: float = 0.03) -> float:
    """Where to cut: below the largest jump between neighbouring edge lengths if that is least_gap or more, else the third quartile; floor at least. The lower of equal jumps counts.

    Lengths are dealt by range; jumps within a range are found there, those between ranges from their ends, two numbers a range.
    """
    parts = int(tree.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(tree.select("d").repartitionByRange(parts, "d").withColumn("p", F.spark_partition_id()), "lengths")
    w = Window.partitionBy("p").orderBy("d")
    inner = dealt.withColumn("before", F.lag("d").over(w)).where("before is not null").groupBy("p").agg(F.max(F.struct((F.col("d") - F.col("before")).alias("gap"), (-F.col("before")).alias("low"))).alias("m"))
    jumps = [(r.m.gap, r.m.low) for r in inner.collect()]
    ends = sorted((r.lo, r.hi) for r in dealt.groupBy("p").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).collect())
    jumps += [(nxt[0] - own[1], -own[1]) for own, nxt in zip(ends, ends[1:])]
    if not jumps:
        return floor
    gap, low = max(jumps)
    cut = -low if gap >= least_gap else dealt.agg(F.percentile("d", F.lit(0.75))).first()[0]
    return max(cut, floor)


def cut_clusters(nodes: DataFrame, tree: DataFrame, cut: float, least_size: int = 3) -> DataFrame:
    """(id, cluster): components of edges up to the cut; smaller ones than least_size are noise, -1."""
    labels = nodes.select("id").join(components(tree.where(F.col("d") <= cut)), "id", "left").select("id", F.coalesce("label", "id").alias("label"))
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"))
    return labels.join(sizes, "label").select("id", F.when(F.col("n") >= least_size, F.col("label")).otherwise(-1).alias("cluster"))


def silhouette(vectors: DataFrame, clusters: DataFrame) -> DataFrame:
    """(id, cluster, silhouette) by cosine distance of vectors (id, v): noise left out; members of one-member clusters have 0, and so do all if there is one cluster.

    A mean of cosine distances is one less the product with the mean of unit vectors, so clusters are summed once, and each row meets
    clusters, in blocks, instead of rows.
    """
    live = vectors.join(clusters.where("cluster >= 0"), "id").withColumn("norm", dense.norm("v"))
    live = written(live.select("id", "cluster", F.transform("v", lambda x: F.when(F.col("norm") > 0, x / F.col("norm")).otherwise(0.0)).alias("u")), "units")
    sums = written(features(live, "cluster", "u").select("cluster", "n", "ls"), "sums")
    own = live.join(sums, "cluster").select("id", "cluster", F.when(F.col("n") > 1, 1 - (dense.dot("u", "ls") - dense.dot("u", "u")) / (F.col("n") - 1)).alias("own"))
    means = sums.select(F.col("cluster").alias("id"), F.transform("ls", lambda x: x / F.col("n")).alias("u"))
    near = nearest_of(live.select("id", "u"), means, "id", "u", lambda x, y: x @ y.T, 2, digits=12, loops=True)
    rest = near.join(live.select(F.col("id").alias("a"), "cluster"), "a").where("b != cluster").groupBy("a").agg((1 - F.max("score")).alias("rest"))
    each = own.join(rest.withColumnRenamed("a", "id"), "id", "left")
    value = F.when(F.col("own").isNull() | F.col("rest").isNull(), 0.0).otherwise((F.col("rest") - F.col("own")) / F.greatest("own", "rest"))
    return each.select("id", "cluster", F.coalesce(value, F.lit(0.0)).alias("silhouette"))


def features(df: DataFrame, by: str, vector: str) -> DataFrame:
    """(cluster, n, ls, ss) for each value of by: count, sum of each dimension (array), sum of squares. Sums merge, so parts of any kind add up."""
    parts = df.select(F.col(by).alias("cluster"), F.posexplode(dense.vec(vector)).alias("pos", "x"))
    dims = parts.groupBy("cluster", "pos").agg(F.sum("x").alias("ls"), F.sum(F.col("x") * F.col("x")).alias("ss"), F.count("*").alias("n"))
    return dims.groupBy("cluster").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "ls"))), lambda s: s["ls"]).alias("ls"), F.sum("ss").alias("ss"))


def centroid(cf: DataFrame) -> DataFrame:
    return cf.select("cluster", "n", F.transform("ls", lambda x: x / F.col("n")).alias("centroid"))


def radius(cf: DataFrame) -> DataFrame:
    """Root of the mean squared distance to the centroid, from the sums alone."""
    return cf.select("cluster", "n", F.sqrt(F.greatest(F.lit(0.0), F.col("ss") / F.col("n") - dense.dot("ls", "ls") / (F.col("n") * F.col("n")))).alias("radius"))


def least_sets(weights: dict[str, float], least: float) -> list[list[str]]:
    """Sets of spaces that weigh `least` or more together, and less without any of them."""
    names = [s for s, w in weights.items() if w > 0]
    out = []
    for n in range(1, len(names) + 1):
        for own in combinations(names, n):
            weight = sum(weights[s] for s in own)
            if weight >= least - 1e-9 and weight - min(weights[s] for s in own) < least - 1e-9:
                out.append(list(own))
    return out


def voting_spaces(memberships: DataFrame) -> list[tuple[str, int]]:
    """Spaces with two clusters or more and how many, most first: 13 rows at most. The others tell nothing apart."""
    rows = memberships.where("cluster >= 0").groupBy("space").agg(F.countDistinct("cluster").alias("k")).where("k >= 2").collect()
    return sorted(((r.space, r.k) for r in rows if r.space in CATEGORY), key=lambda r: (-r[1], r[0]))


def agreement_keys(memberships: DataFrame, least: float = TOPIC_AGREEMENT) -> DataFrame:
    """(key, id, own) from (id, space, cluster): a row for each set of spaces that weighs `least` just so, with the memory's clusters there.

    Two memories share clusters of that weight exactly if they share a key. own is the memory's map of spaces to clusters.
    """
    spaces = [s for s, _ in voting_spaces(memberships)]
    sets = least_sets({s: w for s, w in CATEGORY.items() if s in spaces}, least)
    live = memberships.where((F.col("cluster") >= 0) & F.col("space").isin(spaces))
    each = live.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("space", F.col("cluster").cast("long").alias("cluster"))))).alias("own"))  # 13 entries at most
    if not sets:
        return each.select(F.array(F.struct(F.lit("").alias("s"), F.lit(0).cast("long").alias("c"))).alias("key"), "id", "own").limit(0)
    every = F.filter(F.lit(sets), lambda own: F.forall(own, lambda s: F.map_contains_key("own", s)))
    keys = F.transform(every, lambda own: F.transform(own, lambda s: F.struct(s.alias("s"), F.element_at("own", s).alias("c"))))
    return each.select(F.explode(keys).alias("key"), "id", "own")


def topic_links(memberships: DataFrame, least: float = TOPIC_AGREEMENT) -> DataFrame:
    """(a, b): each memory with the least id that shares a key with it; what ties all mates together, linear in memories."""
    keys = written(agreement_keys(memberships, least).select("key", "id"), "keys")
    hubs = keys.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a != z").drop("z")
    return keys.join(hubs, "key").where("a != id").select("a", F.col("id").alias("b")).distinct()


def topic_mates(memberships: DataFrame, least: float = TOPIC_AGREEMENT, block: int = 4096) -> DataFrame:
    """(a, b, agreement) of memories that share clusters of spaces of weight `least` together, from (id, space, cluster).

    Spaces with one cluster only don't vote. Only memories that share a key (see agreement_keys) meet, so each pair that is made is in
    the result. A key of more than `block` memories is dealt to blocks, which meet pairwise in cells of their own. For topics
    topic_links does, without pairs.
    """
    keys = written(agreement_keys(memberships, least), "keys")
    sizes = written(keys.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("of"), F.count("*").alias("n")).where("n > 1").drop("n"), "sizes")
    dealt = keys.join(sizes, "key").withColumn("g", F.pmod(F.xxhash64("id"), F.col("of")).cast("int"))
    x = dealt.withColumn("h", F.explode(F.sequence(F.col("g"), F.col("of") - 1))).select("key", "g", "h", F.col("id").alias("x"), F.col("own").alias("mx"))
    y = dealt.withColumn("h", F.explode(F.sequence(F.lit(0), F.col("g")))).select("key", F.col("h").alias("g"), F.col("g").alias("h"), F.col("id").alias("y"), F.col("own").alias("my"))
    met = x.join(y, ["key", "g", "h"]).where("(g = h and x < y) or (g < h and x != y)")
    agreement = F.lit(0.0)
    for s, w in CATEGORY.items():
        agreement = agreement + F.when(F.try_element_at("mx", F.lit(s)) == F.try_element_at("my", F.lit(s)), w).otherwise(0.0)
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), agreement.alias("agreement")).groupBy("a", "b").agg(F.first("agreement").alias("agreement"))


def synthesized_topics(memberships: DataFrame, recluster: Callable[[DataFrame, str], DataFrame], least: float = TOPIC_AGREEMENT, share: tuple[int, int] = (2, 5), rounds: int = 5) -> DataFrame:
    """(id, topic) of memories with mates, topic being the least id of it.

    Mates chain: a component of more than 2/5 of all memories (and five or more) is clustered anew by recluster(ids, space), in the voting space with
    most clusters first, until a space parts it in two or more; its noise leaves the topic. That goes on for `rounds` rounds at most, until no
    such component is left or none can be parted. At most two components are that large at a time.
    """
    n = memberships.select("id").distinct().count()
    spaces = [s for s, _ in voting_spaces(memberships)]
    topics = written(components(topic_links(memberships, least)).select("id", F.col("label").alias("topic")), "topics")
    firm: list[int] = []
    for _ in range(rounds):
        large = [r.topic for r in topics.groupBy("topic").agg(F.count("*").alias("n")).where((F.col("n") > n * share[0] // share[1]) & (F.col("n") >= 5)).collect() if r.topic not in firm]
        parted = False
        for topic in large:
            own = written(topics.where(F.col("topic") == topic).select("id"), "large")
            for space in spaces:
                found = written(recluster(own, space).where("cluster >= 0").select("id", "cluster"), "parts")
                if found.select("cluster").distinct().limit(2).count() == 2:
                    least_id = found.groupBy("cluster").agg(F.min("id").alias("topic"))
                    topics = written(topics.where(F.col("topic") != topic).unionByName(found.join(least_id, "cluster").select("id", "topic")), "topics")
                    parted = True
                    break
            else:
                firm.append(topic)
        if not parted:
            break
    sizes = topics.groupBy("topic").agg(F.count("*").alias("n")).where("n >= 2").select("topic")
    return topics.join(sizes, "topic").select("id", "topic")


def confidence(agreement: Column) -> Column:
    return dense.clamp(agreement / MOST_AGREEMENT)


def entropy(sizes: DataFrame, size: str = "n") -> DataFrame:
    """One row: Shannon entropy of sizes over its greatest value; null for fewer than two groups."""
    whole = sizes.agg(F.sum(size).alias("whole"), F.count("*").alias("groups"))
    p = F.col(size) / F.col("whole")
    joined = sizes.where(F.col(size) > 0).crossJoin(F.broadcast(whole))  # one row
    return joined.agg(F.sum(-p * F.log2(p)).alias("h"), F.max("groups").alias("groups")).select(F.when(F.col("groups") >= 2, F.col("h") / F.log2("groups")).alias("entropy"), F.coalesce("groups", F.lit(0)).alias("groups"))


def churn(now: Column, before: Column) -> Column:
    """Topics that came or went over all topics; 0 if there are none."""
    from fathom.functions.sets import symmetric_difference_share

    return symmetric_difference_share(now, before)


def severity(score: Column) -> Column:
    return F.when(score < 0.10, "high").when(score < 0.20, "medium").otherwise("low")


def divergence(scores: DataFrame, low: dict[str, float]) -> DataFrame:
    """(id, space, score, severity) of scores under the space's low threshold, from (id, space, score); spaces without one never diverge."""
    limit = F.coalesce(*[F.when(F.col("space") == s, F.lit(t)) for s, t in low.items()])
    return scores.where(F.col("score") < limit).select("id", "space", "score", severity(F.col("score")).alias("severity"))


def topic_profiles(topics: DataFrame, memberships: DataFrame) -> DataFrame:
    """(topic, space, strength) from (id, topic) and (id, space, cluster): the share of a topic's members in its greatest cluster of the space; 0 if it has one cluster there and over two members."""
    live = memberships.where("cluster >= 0").join(topics, "id")
    n = live.groupBy("topic", "space", "cluster").agg(F.count("*").alias("n"))
    members = topics.groupBy("topic").agg(F.count("*").alias("members"))
    each = n.groupBy("topic", "space").agg(F.max("n").alias("n"), F.count("*").alias("k")).join(members, "topic")
    return each.select("topic", "space", F.when((F.col("k") == 1) & (F.col("members") > 2), 0.0).otherwise(F.col("n") / F.col("members")).alias("strength"))


def merged_topics(profiles: DataFrame, sizes: DataFrame, least: float = 0.9) -> DataFrame:
    """(topic, into): topics by falling size, each taken in by the first larger one whose profile (topic, space, strength) has a cosine of `least` or more; kept ones map to themselves.

    Each step depends on the ones before, so one task goes over the profiles: thirteen numbers a topic, and topics have two members or more.
    """
    import pandas as pd

    spaces = [s for s in CATEGORY]
    wide = profiles.groupBy("topic").agg(*[F.coalesce(F.max(F.when(F.col("space") == s, F.col("strength"))), F.lit(0.0)).alias(s) for s in spaces]).join(sizes, "topic")

    def merged(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["n", "topic"], ascending=[False, True])
        x = own[spaces].to_numpy()
        norm = np.sqrt((x * x).sum(1))
        unit = np.divide(x, norm[:, None], out=np.zeros_like(x), where=norm[:, None] > 0)
        kept: list[int] = []
        into = []
        for i in range(len(x)):
            near = unit[kept] @ unit[i] if kept else np.zeros(0)
            hit = np.flatnonzero(near >= least - 1e-12)
            if len(hit):
                into.append(kept[int(hit[0])])
            else:
                kept.append(i)
                into.append(i)
        names = own["topic"].to_numpy()
        return pd.DataFrame({"topic": names, "into": names[into]})

    return wide.groupBy(F.lit(0).alias("one")).applyInPandas(merged, "topic long, into long")
