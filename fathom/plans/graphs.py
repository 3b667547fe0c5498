"""Graph construction and traversal: k-NN edges of the vectors, and supplier to customer links of the orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.functions import dense
from fathom.operators import fuse, graph, retrieve
from fathom.plans.registry import WEIGHTS, Registry, V
from fathom.plans.retrieval import query_of, vectors
from fathom.sources.tables import table

query = Registry()
_SIM = "round(list_cosine_similarity(a.v, b.v), 6)"
_KNN = f"{V}, k as (select * from (select a.id as a, b.id as b, {_SIM} as score, row_number() over (partition by a.id order by {_SIM} desc, b.id) as rank from v a join v b on a.id <> b.id) where rank <= 5)"
_SPACED = "sp(space, lo, hi, t) as (values ('E1', 1, 16, 0.75), ('E5', 17, 32, 0.75), ('E7', 33, 48, 0.75), ('E10', 49, 64, 0.75))"


def knn_edges(spark, d, k: int = 5):
    """(a, b, score, rank): each vector's k nearest by raw cosine."""
    return retrieve.theta_pairs(vectors(spark, d), "id", "v", retrieve.matrix_cosine, best=k)


@query(f"with {_KNN} select a, b, score, rank::int as rank from k")
def knn_graph(spark, d):
    return knn_edges(spark, d)


#: Neighbours of a memory in each space that edges are made of (fixed value).
EDGE_NEIGHBOURS = 20
_BEST = f"{V}, {_SPACED}, s as (select space, t, a.id as a, b.id as b, round((list_cosine_similarity(a.v[lo:hi], b.v[lo:hi]) + 1) / 2, 6) as s from v a join v b on a.id <> b.id, sp), e as (select space, least(a, b) as a, greatest(a, b) as b, max(s) as s from (select *, row_number() over (partition by space, a order by s desc, b) as rank from s) where rank <= {EDGE_NEIGHBOURS} and s >= t group by 1, 2, 3)"


def space_pairs(spark, d):
    """(space, a, b, score), a < b, of each vector's nearest in each space, from one grid for all spaces."""
    from fathom.plans.registry import SPACES

    best = retrieve.space_best(vectors(spark, d), "id", "v", SPACES, EDGE_NEIGHBOURS)
    return best.groupBy("space", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("score").alias("score"))


@query(
    f"with {_BEST}, g as (select a, b, bool_or(space = 'E1') as e1, bool_or(space = 'E5') as e5, bool_or(space = 'E7') as e7, bool_or(space = 'E10') as e10 from e group by a, b) select a, b, (e1::int + e5::int + e7::int + e10::int)::double as agreement, round((e1::int + e5::int + e7::int + e10::int) / 8.5, 6) as weight, (e1::int + 16 * e5::int + 64 * e7::int + 512 * e10::int)::int as mask, case when e5 then 'causal_chain' when e7 then 'code_related' when e10 then 'paraphrase_aligned' else 'semantic_similar' end as edge_type from g where e1::int + e5::int + e7::int + e10::int >= 2"
)
def typed_edges(spark, d):
    """Edges of the pairs that spaces find among each other's nearest, as a k-NN graph of each space has them."""
    edges = graph.typed_edges(space_pairs(spark, d), dict.fromkeys(("E1", "E5", "E7", "E10"), 0.75), least=2.0)
    return edges.withColumn("weight", F.round("weight", 6))


@query(f"with {_KNN} select a, b, score, rank::int as rank from k")
def nn_descent_graph(spark, d):
    """The same graph by NN-descent: up to a leaf's 1,024 vectors it is exact, beyond nearly (the recall is measured in tests)."""
    from fathom.operators.descent import nn_descent

    return nn_descent(vectors(spark, d), "id", "v", 5)


_UNI = f"with {V}, sp(space, lo, hi, w) as (values ('E1', 1, 16, 0.4), ('E5', 17, 32, 0.25), ('E7', 33, 48, 0.2), ('E10', 49, 64, 0.15)), s as (select space, w, v.id, round((list_cosine_similarity(v.v[lo:hi], q.v[lo:hi]) + 1) / 2, 6) as score from v, q, sp where v.id <> 0), r as (select *, row_number() over (partition by space order by score desc, id) as rank from s) select id, round(sum(w / (60 + rank)), 8) as score, count(*) as contributions from r where rank <= 20 group by id order by score desc, id limit 10"


@query(_UNI)
def unified_neighbors_rrf(spark, d):
    from fathom.plans.retrieval import space_rankings

    out = fuse.rrf(space_rankings(spark, d, 20), WEIGHTS)
    return out.select("id", F.round("score", 8).alias("score"), F.size("spaces").cast("long").alias("contributions")).orderBy(F.desc("score"), "id").limit(10)


@query(f"with recursive {_KNN}, b(id, depth) as (select 0::bigint, 0 union select k.b, b.depth + 1 from b join k on k.a = b.id where b.depth < 3) select id, min(depth)::int as depth from b group by id")
def bfs_depth(spark, d):
    start = spark.createDataFrame([(0,)], "id long")
    return graph.bfs(knn_edges(spark, d).select("a", "b"), start, 3).select("id", "depth")


@query(f"with recursive {_KNN}, b(id, depth) as (select 0::bigint, 0 union select k.b, b.depth + 1 from b join k on k.a = b.id where b.depth < 12) select (min(depth) + 1)::int as nodes from b where id = 7")
def shortest_path(spark, d):
    from fathom.operators.tables import written

    path = graph.shortest_path(written(knn_edges(spark, d).select("a", "b"), "knn"), 0, 7, 12)
    return spark.createDataFrame([(len(path) or None,)], "nodes int")


@query(f"with recursive {_KNN}, b(id, product, depth) as (select 0::bigint, 1.0::double, 0 union all select k.b, b.product * k.score, b.depth + 1 from b join k on k.a = b.id where b.depth < 3 and k.score >= 0.3) select id, round(max(product), 6) as product from b group by id")
def weighted_traversal(spark, d):
    edges = knn_edges(spark, d).select("a", "b", F.col("score").alias("weight"))
    return graph.best_products(edges, 0, 3).select("id", F.round("product", 6).alias("product"))


@query(f"with recursive {_KNN}, b(id, cost, depth) as (select 0::bigint, 0.0::double, 0 union all select k.b, b.cost + 1 / (k.score + 0.001), b.depth + 1 from b join k on k.a = b.id where b.depth < 3) select id, round(min(cost), 6) as cost from b group by id")
def cheapest_paths(spark, d):
    edges = knn_edges(spark, d).select("a", "b", F.col("score").alias("weight"))
    return graph.cheapest(edges, 0, 3).select("id", F.round("cost", 6).alias("cost"))


@query(
    f"with {_KNN}, f as (select b as id, score from k where a = 0), x as (select k.b as id, f.score * k.score * 0.8 as score, k.a as via, row_number() over (partition by k.a order by f.score * k.score * 0.8 desc, k.b) as n from f join k on k.a = f.id where k.score >= 0.3 and k.b not in (select id from f)), y as (select id, max(score) as score from x where n <= 5 group by id) select id, round(score, 6) as score from y order by y.score desc, id limit 150"
)
def graph_expansion(spark, d):
    edges = knn_edges(spark, d).select("a", "b", F.col("score").alias("weight"))
    from fathom.operators.tables import written

    edges = written(edges, "knn")
    found = edges.where("a = 0").select(F.col("b").alias("id"), F.col("weight").alias("score"))
    return graph.expand(found, edges, least=0.3).select("id", F.round("score", 6).alias("score"))


_NAMED = r"list_distinct(list_filter(regexp_split_to_array(text, '[^\p{L}]+'), lambda x: regexp_matches(x, '^[A-Z][a-z]{3,}$')))"


@query(f"with m as (select conv_id * 1000 + turn as id, unnest({_NAMED}) as e from conversations) select a.e as a, b.e as b, count(*) as n from m a join m b on a.id = b.id and a.e < b.e group by 1, 2")
def entity_cooccurrence(spark, d):
    """Names of four letters or more that a turn has together."""
    from fathom.operators import text

    own = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.explode(text.capitalised("text")).alias("entity"))
    return graph.cooccurrence(own)


@query()
def connected_components(spark, d):
    """Suppliers and customers (1,000,000 up) linked by lines of orders."""
    lines = table(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("a"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") + 1_000_000).alias("b"))
    return graph.components(lines.join(orders, "l_orderkey").select("a", "b").distinct())


@query(
    f"with {V}, n as (select v.id, round((list_cosine_similarity(v.v, q.v) + 1) / 2, 6) as sim from v, q where v.id <> 0 order by sim desc, v.id limit 20), m as (select id, 0.5 + (id % 5) / 10 as edge from v where id % 7 = 1), f as (select coalesce(n.id, m.id) as id, least(1, greatest(0, (coalesce(sim * 0.4, 0) + coalesce(edge * 0.6, 0)) * case when edge is not null and sim > 0.5 then 1.2 else 1 end)) as c from n full join m on n.id = m.id) select id, round(c, 6) as confidence from f where c >= 0.3"
)
def contradiction_candidates(spark, d):
    df = vectors(spark, d)
    near = retrieve.knn(df.where("id <> 0"), dense.cos01("v", query_of(df)), 20, "id").select("id", F.col("score").alias("sim"))
    marked = df.where("id % 7 = 1").select("id", (0.5 + (F.col("id") % 5) / 10).alias("edge"))
    return graph.contradictions(near, marked).select("id", F.round("confidence", 6).alias("confidence"))


@query("select l_orderkey, l_linenumber, round(least(1, greatest(0, l_discount * 5 * (1 + 0.3 - 0.05) * (1 + 0.2 * (l_tax * 10)))), 6) as weight from lineitem")
def nt_modulated_weight(spark, d):
    w = graph.modulated(F.col("l_discount") * 5, "Code", F.col("l_tax") * 10)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(w, 6).alias("weight"))


_BALL = f"{V}, p as (select id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v)) * 0.5) as x from v), o as (select list_transform(x, lambda y: y) as y from p where id = 0)"


@query(f"with {_BALL} select id, round(acosh(1 + 2 * (list_inner_product(x, x) + list_inner_product(y, y) - 2 * list_inner_product(x, y)) / ((1 - list_inner_product(x, x)) * (1 - list_inner_product(y, y)))), 5) as distance from p, o where id <> 0")
def poincare_distance(spark, d):
    df = vectors(spark, d)
    p = df.where("id <> 0").select("id", dense.ball("v").alias("x"))
    return p.select("id", F.round(dense.poincare_distance("x", dense.ball(query_of(df))), 5).alias("distance"))


@query(f"with {V}, t as (select v.id, acos(greatest(-1, least(1, (list_inner_product(v.v, q.v) - list_inner_product(q.v, q.v)) / (sqrt(list_inner_product(q.v, q.v)) * list_distance(v.v, q.v))))) as angle from v, q where v.id <> 0) select id, round(angle, 5) as angle, round(case when angle <= 2.0 then 1 else exp(-2 * (angle - 2.0)) end, 5) as membership from t")
def cone_membership(spark, d):
    df = vectors(spark, d)
    out = df.where("id <> 0").select("id", dense.cone_angle(query_of(df), "v").alias("angle"))
    return out.select("id", F.round("angle", 5).alias("angle"), F.round(dense.cone_membership(F.col("angle"), 2.0), 5).alias("membership"))


@query()
def informed_path(spark, d):
    """Least cost of a path from vector 0 to vector 7 over nearest neighbours, by a search from both sides with hyperbolic bounds, and the nodes it expanded."""
    rows = vectors(spark, d)
    edges = knn_edges(spark, d).select("a", "b", F.col("score").alias("weight"))
    cost, expanded = graph.informed_path(edges, rows.select("id", dense.ball("v").alias("point")), 0, 7, two_sided=True)
    return spark.createDataFrame([(cost, expanded)], "cost double, expanded long")


@query(f"with {V}, s as (select v.id, round((list_cosine_similarity(v.v, q.v) + 1) / 2, 6) as sim from v, q where v.id <> 0), t as (select id, round((sim * 0.7 + (id % 5) / 4 * 0.3) * case when id % 2 = 0 then 1.2 else 1.0 end, 6) as score from s order by score desc, id limit 20) select id, score from t")
def connectivity_rank(spark, d):
    """Candidates for a question that seeks sources: similarity blended with a context's overlap, sources 1.2 times."""
    df = vectors(spark, d)
    sim = F.round(dense.cos01("v", query_of(df)), 6)
    score = graph.by_connectivity(sim, (F.col("id") % 5) / 4, 0.3, F.lit(True), F.col("id") % 2 == 0)
    return retrieve.knn(df.where("id <> 0"), score, 20, "id").select("id", "score")
