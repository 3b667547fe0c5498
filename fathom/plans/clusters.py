"""Clusters, topics, stability."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fathom.functions import dense, sets
from fathom.operators import cluster, retrieve
from fathom.operators.birch import cf_tree
from fathom.operators.tables import written
from fathom.plans.registry import SPACES, WEIGHTS, Registry, S, V
from fathom.plans.retrieval import long_scores, vectors
from fathom.sources.tables import table

query = Registry()
#: Nearest vectors that density clustering looks at.
NEAREST = 15
_D = f"{V}, dd as (select a.id as a, b.id as b, round(1 - round(list_cosine_similarity(a.v, b.v), 6), 6) as d from v a join v b on a.id <> b.id), nn as (select *, row_number() over (partition by a order by d, b) as n from dd), core as (select a as id, d as core from nn where n = 2)"


def nearest(spark, d, k: int = NEAREST):
    """(a, b, d, rank): each vector's nearest ones by cosine distance."""
    pairs = retrieve.theta_pairs(vectors(spark, d), "id", "v", retrieve.matrix_cosine, best=k)
    return pairs.select("a", "b", F.round(1 - F.col("score"), 6).alias("d"), "rank")


@query(f"with {_D} select id, core from core")
def core_distance(spark, d):
    return cluster.core_distances(nearest(spark, d, 2))


@query(f"with {_D}, e as (select least(a, b) as a, greatest(a, b) as b, min(d) as d from nn where n <= {NEAREST} group by 1, 2) select e.a, e.b, greatest(e.d, x.core, y.core) as d from e join core x on x.id = e.a join core y on y.id = e.b")
def mutual_reachability(spark, d):
    own = written(nearest(spark, d), "nearest")
    return cluster.mutual_reachability(own, cluster.core_distances(own))


@query()
def gap_threshold_clusters(spark, d):
    """Density clusters: the least spanning tree of mutual reachability over all pairs, cut at its largest gap."""
    tree = cluster.exact_tree(vectors(spark, d).select("id", "v"), cluster.vector_distance)
    return cluster.cut_clusters(vectors(spark, d).select("id"), tree, cluster.gap_threshold(tree))


def _fingerprints(spark, d):
    """Each vector's parts as spaces; those of one label lack E10."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")
    parts = {s: F.slice("v", lo, n) for s, (lo, n) in SPACES.items()}
    return rows.select("id", *[(F.when(F.col("label") != 3, c) if s == "E10" else c).alias(s) for s, c in parts.items()])


_FP = f"{V}, sp(space, lo, hi, w) as (values ('E1', 1, 16, 0.4), ('E5', 17, 32, 0.25), ('E7', 33, 48, 0.2), ('E10', 49, 64, 0.15)), f as (select a.id as a, b.id as b, sum(w * (list_cosine_similarity(a.v[lo:hi], b.v[lo:hi]) + 1) / 2) / sum(w) as s from v a join v b on a.id <> b.id, sp where space <> 'E10' or (a.label <> 3 and b.label <> 3) group by a.id, b.id)"


@query(f"with {_FP} select id, round(d, 6) as core from (select a as id, round(1 - s, 6) as d, row_number() over (partition by a order by round(1 - s, 6), b) as n from f) where n = 2")
def fingerprint_core(spark, d):
    """Distance to the second nearest over all spaces that two fingerprints have, by weight."""
    rows = _fingerprints(spark, d)
    return cluster.core_by(rows, cluster.fingerprint_distance(WEIGHTS))


@query()
def fingerprint_clusters(spark, d):
    """Density clusters over the distance of whole fingerprints."""
    rows = _fingerprints(spark, d)
    tree = cluster.exact_tree(rows, cluster.fingerprint_distance(WEIGHTS))
    return cluster.cut_clusters(rows, tree, cluster.gap_threshold(tree))


@query()
def detect_topics(spark, d):
    """Each vector's topic over three parts of the vectors as spaces, clustered by density; null without mates. Components over 2/5 of all are parted again."""
    rows = vectors(spark, d).select("id", "v")
    spaces = {"E1": (1, 22), "E5": (23, 21), "E7": (44, 21)}

    def clusters(ids, space):
        own = rows.join(ids, "id", "left_semi").select("id", F.slice("v", *spaces[space]).alias("v"))
        tree = cluster.exact_tree(own, cluster.vector_distance)
        return cluster.cut_clusters(own, tree, cluster.gap_threshold(tree))

    parts = None
    for space in spaces:
        own = clusters(rows.select("id"), space).select("id", F.lit(space).alias("space"), "cluster")
        parts = own if parts is None else parts.unionByName(own)
    topics = cluster.synthesized_topics(written(parts, "memberships"), clusters, least=2.0)
    return rows.select("id").join(topics, "id", "left")


@query(
    f"with {V}, dd as (select a.id as a, b.id as b, 1 - list_cosine_similarity(a.v, b.v) as d from v a join v b on a.id <> b.id), c as (select id, id % 3 as cluster from v), p as (select dd.a, ca.cluster as ca, cb.cluster as cb, avg(d) as m from dd join c ca on ca.id = dd.a join c cb on cb.id = dd.b group by 1, 2, 3), e as (select a, ca, max(m) filter (ca = cb) as own, min(m) filter (ca <> cb) as other from p group by a, ca) select a as id, ca as cluster, round(case when own is null or other is null then 0 else (other - own) / greatest(own, other) end, 5) as silhouette from e"
)
def silhouette(spark, d):
    v = vectors(spark, d)
    return cluster.silhouette(v.select("id", "v"), v.select("id", (F.col("id") % 3).alias("cluster"))).withColumn("silhouette", F.round("silhouette", 5))


@query(f"with {V}, t as (select label, generate_subscripts(v, 1) as pos, unnest(v) as x from v) select label as cluster, pos::int as pos, round(avg(x), 6) as value, count(*) as n from t group by 1, 2")
def centroid(spark, d):
    own = cluster.centroid(cluster.features(table(spark, d, "embeddings"), "label", "embedding"))
    return own.select("cluster", "n", F.posexplode("centroid").alias("pos", "value")).select("cluster", (F.col("pos") + 1).alias("pos"), F.round("value", 6).alias("value"), "n")


@query(f"with {V}, t as (select label, generate_subscripts(v, 1) as pos, unnest(v) as x from v), s as (select label, pos, sum(x) as ls, sum(x * x) as ss, count(*) as n from t group by 1, 2) select label as cluster, max(n) as n, round(sqrt(sum(ss) / max(n) - sum(ls * ls) / (max(n) * max(n))), 6) as radius from s group by label")
def cluster_features(spark, d):
    return cluster.radius(cluster.features(table(spark, d, "embeddings"), "label", "embedding")).withColumn("radius", F.round("radius", 6))


_MEM = f"{V}, m as (select id, 'E1' as space, id % 40 as cluster, 1.0 as w from v union all select id, 'E5', id // 10, 1.0 from v union all select id, 'E7', (id * 7) % 50, 1.0 from v)"


@query(f"with {_MEM}, t as (select a.id as a, b.id as b, sum(a.w)::double as agreement from m a join m b on a.space = b.space and a.cluster = b.cluster and a.id < b.id group by 1, 2) select a, b, agreement, round(agreement / 8.5, 6) as confidence from t where agreement >= 2")
def topic_agreement(spark, d):
    """Memberships made from ids, as in three spaces with clusters of their own."""
    ids = vectors(spark, d).select("id")
    of = lambda space, c: ids.select("id", F.lit(space).alias("space"), c.alias("cluster"))
    m = of("E1", F.col("id") % 40).unionByName(of("E5", F.floor(F.col("id") / 10))).unionByName(of("E7", (F.col("id") * 7) % 50))
    mates = cluster.topic_mates(m, least=2.0)
    return mates.select("a", "b", "agreement", F.round(cluster.confidence(F.col("agreement")), 6).alias("confidence"))


@query("with s as (select lang, count(*) as n from documents group by lang), t as (select sum(n) as whole, count(*) as k from s) select round(sum(-(n / whole) * log2(n / whole)) / log2(max(k)), 6) as entropy, max(k) as groups from s, t")
def topic_entropy(spark, d):
    sizes = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return cluster.entropy(sizes).select(F.round("entropy", 6).alias("entropy"), "groups")


_DAYS = "s as (select ts::date as day, list_sort(list(distinct user_id % 1000)) as topics from events group by 1), p as (select day, topics, lag(topics) over (order by day) as before from s)"
_CHURN = "round(1 - len(list_intersect(topics, before)) / len(list_distinct(list_concat(topics, before))), 6)"


def _snapshots(spark, d):
    rows = table(spark, d, "events")
    days = rows.groupBy(F.to_date("ts").alias("day")).agg(F.array_sort(F.collect_set(F.col("user_id") % 1000)).alias("topics"))
    w = Window.orderBy("day")
    return days.withColumn("before", F.lag("topics").over(w)).withColumn("churn", F.when(F.col("before").isNotNull(), F.round(cluster.churn(F.col("topics"), F.col("before")), 6)))


@query(f"with {_DAYS} select day, case when before is not null then {_CHURN} end as churn from p")
def churn(spark, d):
    """Daily snapshots of the topics (a thousand at most) that events touch, each against the day before. A window over days: 30 rows."""
    return _snapshots(spark, d).select("day", "churn")


@query(f"with {_DAYS}, c as (select day, case when before is not null then {_CHURN} end as churn from p) select day, round(avg(churn) over (order by day rows 6 preceding), 6) as average, coalesce(avg(churn) over (order by day rows 6 preceding) < 0.2, false) as stable from c")
def average_churn(spark, d):
    w = Window.orderBy("day").rowsBetween(-6, 0)
    mean = F.avg("churn").over(w)
    return _snapshots(spark, d).select("day", F.round(mean, 6).alias("average"), F.coalesce(mean < 0.2, F.lit(False)).alias("stable"))


@query(f"with {S} select id, space, score, case when score < 0.10 then 'high' when score < 0.20 then 'medium' else 'low' end as severity from s where score < case space when 'E1' then 0.30 when 'E7' then 0.35 when 'E10' then 0.30 end")
def divergence_alerts(spark, d):
    return cluster.divergence(long_scores(spark, d), {"E1": 0.30, "E7": 0.35, "E10": 0.30})


@query("with t as (select conv_id, list_distinct(list(role)) as r from conversations group by conv_id), n as (select conv_id, r, lead(r) over (order by conv_id) as nxt from t) select conv_id, round(len(list_intersect(r, nxt)) / len(list_distinct(list_concat(r, nxt))), 6) as overlap from n where nxt is not null")
def session_overlap(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("r"))
    nxt = rows.select((F.col("conv_id") - 1).alias("before"), F.col("r").alias("nxt"))
    return rows.join(nxt, F.col("conv_id") == F.col("before")).select("conv_id", F.round(sets.jaccard("r", "nxt"), 6).alias("overlap"))


@query(f"with {V}, c as (select label, generate_subscripts(v, 1) as pos, unnest(v) as x from v), m as (select label, pos, avg(x) as x from c group by 1, 2), l as (select label, list(x order by pos) as c from m group by label), t as (select v.id, l.label as topic, round((list_cosine_similarity(v.v, l.c) + 1) / 2, 6) as score from v, l) select id, topic, score from (select *, row_number() over (partition by id order by score desc, topic) as n from t) where n = 1")
def best_topic(spark, d):
    """Each vector's nearest label centroid; vectors and centroids meet in blocks."""
    centers = cluster.centroid(cluster.features(table(spark, d, "embeddings"), "label", "embedding")).select(F.col("cluster").alias("id"), F.col("centroid").alias("v"))
    near = retrieve.nearest_of(vectors(spark, d), centers, "id", "v", retrieve.matrix_cos01, 1, loops=True)
    return near.select(F.col("a").alias("id"), F.col("b").cast("int").alias("topic"), "score")


@query(f"with {V}, t as (select generate_subscripts(v, 1) as pos, unnest(v) as x from v) select pos::int as pos, count(*) as n, round(sum(x), 5) + 0.0 as total, true as bounded from t group by pos")
def birch_sums(spark, d):
    """A tree's leaves add up to the table in each dimension, and none is over its radius."""
    leaves = cf_tree(vectors(spark, d), "v")
    each = leaves.select("n", (F.col("radius") <= F.col("threshold") + 1e-9).alias("ok"), F.posexplode("ls").alias("pos", "x"))
    return each.groupBy((F.col("pos") + 1).alias("pos")).agg(F.sum("n").alias("n"), (F.round(F.sum("x"), 5) + 0.0).alias("total"), F.every("ok").alias("bounded"))
