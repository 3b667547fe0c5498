"""Sparse indexes, contexts, hierarchies, losses, relational layers, matrix presets: operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fathom.functions import dense, profiles
from fathom.operators import cluster, curate, fuse, graph, learn, retrieve, sparse
from fathom.operators.tables import written
from fathom.plans.graphs import _BEST, _KNN, knn_edges, space_pairs
from fathom.plans.registry import SPACES, Registry, S, V
from fathom.plans.retrieval import POSTINGS, long_scores, query_of, vectors
from fathom.sources.tables import table

query = Registry()
_Q = {"the": 3.0, "erth": 2.0, "ing": 1.0, "for": 0.5}
_QQ = "qq(term, qw) as (values " + ", ".join(f"('{t}', {w})" for t, w in _Q.items()) + ")"


def post(spark, d):
    return retrieve.postings(table(spark, d, "documents")).withColumnRenamed("tf", "w")


@query(f"with {POSTINGS}, {_QQ} select p.id, round(sum(tf * coalesce(qw, 0)), 6)::double as dot, round(sum(tf * coalesce(qw, 0)) / (sqrt(sum(tf * tf)) * sqrt({sum(w * w for w in _Q.values())})), 6) as cosine, round(sqrt(sum(tf * tf)), 6) as norm from p left join qq using (term) group by p.id")
def sparse_cosine(spark, d):
    out = sparse.similarity(post(spark, d), _Q)
    return out.select("id", *[F.round(c, 6).alias(c) for c in ("dot", "cosine", "norm")])


@query(f"with {POSTINGS}, {_QQ}, m as (select id, sqrt(sum(tf * tf)) as norm from p group by id), c as (select count(*) as c from m), df as (select term, count(*) as df from p where term in (select term from qq) group by term) select p.id, round(sum(qw * tf / norm * ln((c - df + 0.5) / (df + 0.5) + 1)), 6) as score from p join qq using (term) join df using (term) join m using (id), c group by p.id")
def splade_search(spark, d):
    return sparse.InvertedIndex(post(spark, d)).search(_Q).withColumn("score", F.round("score", 6))


_MAT = profiles.MATRICES
_CASES = "(values " + ", ".join(f"('{name}', '{i}', '{j}', {w})" for name, m in _MAT.items() for (i, j), w in m.items() if i in SPACES and j in SPACES) + ")"


@query(f"with {S}, m(preset, i, j, w) as {_CASES}, t as (select preset, x.id, case when i = j then x.score else sqrt(x.score * y.score) end * w as v, w from m join s x on x.space = i join s y on y.space = j and y.id = x.id) select preset, id, round(sum(v) / sum(w), 8) as score from t group by preset, id")
def matrix_presets(spark, d):
    """The scores of every vector under each named matrix of spaces."""
    ranked = written(long_scores(spark, d), "scores")
    out = None
    for name in _MAT:
        own = {k: w for k, w in _MAT[name].items() if k[0] in SPACES and k[1] in SPACES}
        if own:
            part = fuse.matrix_weighted(ranked, own).select(F.lit(name).alias("preset"), "id", F.round("score", 8).alias("score"))
            out = part if out is None else out.unionByName(part)
    return out


@query(f"with {V} select v.id, round(1 / (1 + exp(-(2 * (list_sum(list_transform(v.v[1:13], lambda x: x / 13.0))) * (list_sum(list_transform(v.v[14:26], lambda x: x / 13.0))) * 1.0 * cos(0.5)))), 6) as score from v")
def multi_utl(spark, d):
    s = fuse.multi_utl(F.slice("v", 1, 13), F.slice("v", 14, 13), phi=0.5)
    return vectors(spark, d).select("id", F.round(s, 6).alias("score"))


_AGE = "select event_id, [exp(-abs(event_id - 100) / 10.0), exp(-abs(event_id - 120) / 10.0), exp(-abs(event_id - 150) / 10.0)] as l from events"


@query(f"with a as ({_AGE}) select event_id, round(list_min(l), 6) as least, round(list_max(l), 6) as greatest, round(list_avg(l), 6) as mean from a")
def multi_anchor(spark, d):
    """Nearness to three anchors of a sequence, combined in three ways."""
    near = F.array(*[F.exp(-F.abs(F.col("event_id") - a) / 10.0) for a in (100, 120, 150)])
    from fathom.functions.temporal import anchored

    return table(spark, d, "events").select("event_id", *[F.round(anchored(near, how), 6).alias(name) for how, name in (("min", "least"), ("max", "greatest"), ("average", "mean"))])


_CTX = "select conv_id, list_distinct(list(role)) as r, list_distinct(list(turn % 3)) as m, max(turn) as n from conversations group by conv_id"


@query(
    f"with c as ({_CTX}), p as (select x.conv_id as a, y.conv_id as b, x.r as rx, y.r as ry, x.n = y.n as same, len(x.m) = len(y.m) as mech from c x join c y on y.conv_id = x.conv_id + 1), t as (select *, 0.5 * len(list_intersect(rx, ry)) / len(list_distinct(list_concat(rx, ry))) + 0.5 * len(list_intersect(rx, ry)) / least(len(rx), len(ry)) as mean from p) select a, b, round(least(1, greatest(0, 0.7 * mean + case when mean > 0.1 and same then 0.15 else 0 end + case when mean > 0.1 and mech then 0.15 else 0 end)), 6) as overlap from t"
)
def context_overlap(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("r"), F.count_distinct(F.col("turn") % 3).alias("m"), F.max("turn").alias("n"))
    y = c.select((F.col("conv_id") - 1).alias("conv_id"), F.col("conv_id").alias("b"), F.col("r").alias("ry"), F.col("m").alias("my"), F.col("n").alias("ny"))
    return c.join(y, "conv_id").select(F.col("conv_id").alias("a"), "b", F.round(graph.overlap(F.col("r"), F.col("ry"), F.col("n") == F.col("ny"), F.col("m") == F.col("my")), 6).alias("overlap"))


@query(f"with {V}, k as (select a.id as a, b.id as b, round(list_cosine_similarity(a.v[1:32], b.v[33:64]), 6) as score from v a join v b on a.id <> b.id) select a, b, score, rank::int as rank from (select *, row_number() over (partition by a order by score desc, b) as rank from k) where rank <= 5")
def asymmetric_knn(spark, d):
    """Directed edges: each vector's first half as a source, the nearest second halves as targets."""
    halves = vectors(spark, d).select("id", F.slice("v", 1, 32).alias("v"), F.slice("v", 33, 32).alias("target"))
    return retrieve.theta_pairs(halves, "id", "v", retrieve.matrix_cosine, best=5, target="target")


@query(
    f"with {_BEST}, g as (select a, b, count(*) as agreeing, avg(s) as mean, max(s) filter (space = 'E7') as e7, max(s) filter (space = 'E5') as e5, max(s) filter (space = 'E10') as e10, max(s) filter (space = 'E1') as e1 from e group by a, b) "
    "select a, b, agreeing, case when agreeing >= 3 then 'multi_agreement' when e7 is not null then 'code_related' when e5 is not null then 'causal_chain' when e10 is not null then 'paraphrase_aligned' else 'semantic_similar' end as edge_type, round(case when agreeing >= 3 then mean else coalesce(e7, e5, e10, e1) end, 6) as weight from g"
)
def edges_by_count(spark, d):
    return graph.edges_by_count(space_pairs(spark, d), dict.fromkeys(SPACES, 0.75)).withColumn("weight", F.round("weight", 6))


@query("select l_orderkey, l_linenumber, round(greatest(-1, least(1, l_discount * 20 - 1 + l_tax * 10)), 6) as steering, round((l_discount * 20 - 1) * 0.9, 6) as decayed from lineitem")
def steering(spark, d):
    old = F.col("l_discount") * 20 - 1
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(graph.steered(old, F.col("l_tax") * 10), 6).alias("steering"), F.round(old * 0.9, 6).alias("decayed"))


@query(f"with {_KNN} select 'effect' as role, b as id, score as weight from k where a = 0 union all select 'cause', a, score from k where b = 0")
def causes_and_effects(spark, d):
    edges = knn_edges(spark, d).select("a", "b", F.col("score").alias("weight"))
    edges = written(edges, "edges")
    return graph.effects(edges, 0).select(F.lit("effect").alias("role"), "id", "weight").unionByName(graph.causes(edges, 0).select(F.lit("cause").alias("role"), "id", "weight"))


_UP = "u as (select 1000 + c_custkey as child, 100 + c_nationkey as parent from customer union all select 100 + n_nationkey, n_regionkey from nation union all select r_regionkey, 99 from region), lv as (select 1000 + c_custkey as id, 3 as level from customer union all select 100 + n_nationkey, 2 from nation union all select r_regionkey, 1 from region union all select 99, 0)"


def hierarchy(spark, d):
    """(child, parent) of customers (1,000 up), nations (100 up), regions and their root 99, and each node's level."""
    part = lambda name, child, parent: table(spark, d, name).select(child.cast("long").alias("child"), parent.cast("long").alias("parent"))
    up = part("customer", 1000 + F.col("c_custkey"), 100 + F.col("c_nationkey")).unionByName(part("nation", 100 + F.col("n_nationkey"), F.col("n_regionkey"))).unionByName(part("region", F.col("r_regionkey"), F.lit(99)))
    level = F.when(F.col("child") >= 1000, 3).when(F.col("child") >= 100, 2).otherwise(1)
    return up, up.select(F.col("child").alias("id"), level.alias("level")).unionByName(spark.createDataFrame([(99, 0)], "id long, level int"))


@query(
    f"with recursive {_UP}, pr as (select 1000 + c_custkey as a, 1001 + c_custkey as b from customer where c_custkey + 1 in (select c_custkey from customer)), st as (select a as start from pr union select b from pr), an(start, id, depth) as (select start, start, 0 from st union all select an.start, u.parent, an.depth + 1 from an join u on u.child = an.id), m as (select a, b, x.id, x.depth as depth_a, y.depth as depth_b, level from pr join an x on x.start = a join an y on y.start = b and y.id = x.id join lv on lv.id = x.id) select a, b, id, depth_a::int as depth_a, depth_b::int as depth_b from (select *, row_number() over (partition by a, b order by level desc, id) as n from m) where n = 1"
)
def common_ancestor(spark, d):
    """Where the nations and regions of each customer and the next one meet."""
    up, levels = hierarchy(spark, d)
    keys = table(spark, d, "customer").select((1000 + F.col("c_custkey")).alias("a"))
    pairs = keys.join(keys.select((F.col("a") - 1).alias("a")), "a", "left_semi").select("a", (F.col("a") + 1).alias("b"))
    return graph.common_ancestors(pairs, up, levels, 3)


@query(
    f"with recursive {_KNN}, b(id, depth) as (select 0::bigint, 0 union select k.b, b.depth + 1 from b join k on k.a = b.id where b.depth < 3), r as (select id, min(depth)::int as depth from b where id <> 0 group by id), w as (select id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v)) * 0.5) as p from v), o as (select p as q from w where id = 0), t as (select r.id, r.depth, acos(greatest(-1, least(1, list_inner_product(list_transform(list_zip(p, q), lambda z: z[1] - z[2]), q) / (sqrt(list_sum(list_transform(list_zip(p, q), lambda z: (z[1] - z[2]) ** 2))) * sqrt(list_inner_product(q, q)))))) as angle from r join w using (id), o) select id, depth, round(case when angle <= 1.2 then 1 else exp(-2 * (angle - 1.2)) end, 6)::double as membership from t where case when angle <= 1.2 then 1 else exp(-2 * (angle - 1.2)) end >= 0.1"
)
def entailment_query(spark, d):
    """What vector 0's cone holds of the nodes within three hops of it."""
    nodes = vectors(spark, d).select("id", dense.ball("v").alias("point"))
    edges = written(knn_edges(spark, d).select("a", "b"), "edges")
    return graph.entailed(edges, nodes, 0, 1.2, 3, least=0.1).withColumn("membership", F.round("membership", 6))


@query()
def depth_first_order(spark, d):
    return graph.depth_first(written(knn_edges(spark, d).select("a", "b"), "edges"), 0, 3)


_MEMB = f"{V}, m as (select id, 'E1' as space, id % 40 as cluster from v union all select id, 'E5', id // 10 from v union all select id, 'E7', 0 from v), tp as (select id, label as topic from v)"


@query(f"with {_MEMB}, c as (select topic, space, cluster, count(*) as n from m join tp using (id) group by 1, 2, 3), s as (select topic, count(*) as members from tp group by topic) select topic, space, round(case when count(*) = 1 and max(members) > 2 then 0 else max(n) / max(members) end, 6)::double as strength from c join s using (topic) group by topic, space")
def topic_profile(spark, d):
    """How much of each topic its greatest cluster of a space has; a space that sees one cluster only says nothing."""
    v = vectors(spark, d)
    of = lambda space, c: v.select("id", F.lit(space).alias("space"), c.cast("long").alias("cluster"))
    m = of("E1", F.col("id") % 40).unionByName(of("E5", F.floor(F.col("id") / 10))).unionByName(of("E7", F.lit(0)))
    out = cluster.topic_profiles(v.select("id", F.col("label").alias("topic")), m)
    return out.withColumn("strength", F.round("strength", 6))


@query(f"with {V}, b as (select id, id // 25 as batch, v[1:32] as x, v[33:64] as y from v), s as (select p.batch, p.id as i, q.id as j, list_inner_product(p.x, q.y) / 0.05 as t from b p join b q on p.batch = q.batch), n as (select batch, i, max(t) as top, max(t) filter (i = j) as own from s group by 1, 2), l as (select batch, i, ln(sum(exp(t - top))) + max(top) - max(own) as loss from s join n using (batch, i) group by 1, 2) select batch, round(avg(loss), 5) as loss from l group by batch")
def info_nce_loss(spark, d):
    return learn.info_nce(_products(spark, d), "batch").withColumn("loss", F.round("loss", 5))


@query(f"with {V}, b as (select id, id // 25 as batch, v[1:32] as x, v[33:64] as y from v), s as (select p.batch, p.id as i, q.id as j, list_inner_product(p.x, q.y) as s from b p join b q on p.batch = q.batch), g as (select batch, i, sum(s) filter (i = j) - case when count(*) > 1 then sum(s) filter (i <> j) / (count(*) - 1) else 0 end as gap from s group by 1, 2) select batch, round(avg(greatest(0, 0.2 - gap)), 5) as loss from g group by batch")
def directional_margin_loss(spark, d):
    return learn.margin_loss(_products(spark, d), "batch").withColumn("loss", F.round("loss", 5))


@query(f"with {V} select id // 25 as batch, round(avg(list_cosine_similarity(v[1:32], v[33:64])), 6) as loss from v group by 1")
def separation_loss(spark, d):
    return learn.separation(_halves(spark, d), "batch", "x", "y").withColumn("loss", F.round("loss", 6))


def _halves(spark, d):
    return vectors(spark, d).select("id", F.floor(F.col("id") / 25).alias("batch"), F.slice("v", 1, 32).alias("x"), F.slice("v", 33, 32).alias("y"))


def _products(spark, d):
    return learn.batch_products(_halves(spark, d), "batch", "x", "y")


_W = {"near": [[0.5, 0.1], [0.0, 0.4]], "far": [[-0.2, 0.0], [0.3, 0.2]]}


@query(
    f"with {_KNN}, h as (select id, v[1] as x, v[2] as y from v), e as (select a, b, case when rank <= 2 then 'near' else 'far' end as kind from k), m as (select b as id, kind, avg(x) as x, avg(y) as y from e join h on h.id = e.a group by 1, 2), t as (select id, sum(case when kind = 'near' then 0.5 * x + 0.1 * y else -0.2 * x end) as sx, sum(case when kind = 'near' then 0.4 * y else 0.3 * x + 0.2 * y end) as sy from m group by id) select h.id, round(greatest(0, x + coalesce(sx, 0)), 6) + 0.0 as x, round(greatest(0, y + coalesce(sy, 0)), 6) + 0.0 as y from h left join t using (id)"
)
def relational_layer(spark, d):
    """A layer over two kinds of edges, near and far neighbours, on two components."""
    edges = knn_edges(spark, d).select("a", "b", F.when(F.col("rank") <= 2, "near").otherwise("far").alias("kind"))
    out = learn.relational_layer(vectors(spark, d).select("id", F.slice("v", 1, 2).alias("h")), edges, [[1.0, 0.0], [0.0, 1.0]], _W)
    return out.select("id", (F.round(F.col("h")[0], 6) + 0.0).alias("x"), (F.round(F.col("h")[1], 6) + 0.0).alias("y"))


_FB = "select user_id, event_id, case event_type when 'purchase' then 'positive' when 'error' then 'negative' else 'neutral' end as verdict from events"


@query(f"with f as ({_FB}), g as (select user_id, list(case verdict when 'positive' then 0.01 when 'negative' then -0.01 else 0 end::double order by event_id) as ds from f group by user_id) select user_id, round(list_reduce(list_prepend(0.0::double, ds), lambda a, x: greatest(-1.0, least(1.0, a + x))), 6) + 0.0 as weight, len(ds) as updates from g")
def feedback_weights(spark, d):
    verdict = F.when(F.col("event_type") == "purchase", "positive").when(F.col("event_type") == "error", "negative").otherwise("neutral")
    out = learn.learned_weights(table(spark, d, "events").withColumn("verdict", verdict), "user_id", ["event_id"], "verdict")
    return out.withColumn("weight", F.round("weight", 6) + 0.0)


@query("select user_id, status, changed_at from (select user_id, case event_type when 'signup' then 'started' when 'purchase' then 'ended' when 'error' then 'abandoned' else 'active' end as status, ts as changed_at, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n = 1")
def session_states(spark, d):
    """The state that each user's last event leaves: signup starts, purchase ends, an error abandons."""
    status = F.when(F.col("event_type") == "signup", "started").when(F.col("event_type") == "purchase", "ended").when(F.col("event_type") == "error", "abandoned").otherwise("active")
    return curate.last_state(table(spark, d, "events").withColumn("status", status), "user_id", "status", ["ts", "event_id"]).select("user_id", "status", F.col("ts").alias("changed_at"))


@query("select p_partkey, sha256(concat(lower(p_name), '|', p_type)) as fingerprint from part where p_name like 'a%' or p_name like 'b%'")
def code_lookup(spark, d):
    """Units by a prefix of their name, with the fingerprint of name and signature."""
    own = curate.units_by_prefix(table(spark, d, "part"), "p_name", ["a", "b"])
    return own.select("p_partkey", curate.unit_fingerprint(F.col("p_name"), F.col("p_type")).alias("fingerprint"))


@query("select p_brand as language, p_size // 10 as kind, count(*) as units, sum(length(p_name))::bigint as characters from part group by 1, 2")
def code_stats(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("language"), F.floor(F.col("p_size") / 10).cast("int").alias("kind")).agg(F.count("*").alias("units"), F.sum(F.length("p_name")).alias("characters"))


_IV = "iv as (select event_id as iv, user_id, ts as lo, ts + interval 6 hour as hi from events where event_type = 'signup')"


@query(f"with {_IV} select iv, e.event_id from iv join events e on e.user_id = iv.user_id and e.ts >= lo and e.ts < hi")
def interval_join(spark, d):
    """Events of a user within six hours of each of their signups."""
    e = table(spark, d, "events")
    spans = e.where("event_type = 'signup'").select(F.col("event_id").alias("iv"), "user_id", F.col("ts").alias("lo"), (F.col("ts") + F.expr("interval 6 hours")).alias("hi"))
    return curate.within_intervals(spans, e.select("event_id", "user_id", "ts"), ["user_id"], "lo", "hi", "ts", hours=6.0).select("iv", "event_id")


@query(f"with {S}, t as (select id, list(score order by space) as scores, round(avg(score), 6) as mean from s group by id) select id, scores, mean, rank::int as rank from (select *, row_number() over (order by mean desc, id) as rank from t) where rank <= 10")
def search_breakdown(spark, d):
    """The best by the mean of all spaces, with each space's share of it."""
    each = long_scores(spark, d).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("space", "score"))), lambda x: x["score"]).alias("scores"), F.round(F.avg("score"), 6).alias("mean"))
    top = each.orderBy(F.desc("mean"), "id").limit(10)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean"), "id")))


@query(f"with {_KNN}, p as (select conv_id as a, conv_id + 1 as b from conversations group by conv_id) select a, b, round(case when weight is null then 0 else weight end, 6)::double as confidence from (select p.a, p.b, k.score as weight from p left join k on k.a = p.a and k.b = p.b)")
def contradiction_check(spark, d):
    """Whether given pairs are marked: the weight of their edge, 0 without one."""
    marked = written(knn_edges(spark, d).select("a", "b", F.col("score").alias("weight")), "edges")
    pairs = table(spark, d, "conversations").select(F.col("conv_id").alias("a")).distinct().withColumn("b", F.col("a") + 1)
    return graph.checked_pairs(pairs, marked).select("a", "b", F.round("confidence", 6).alias("confidence"))
