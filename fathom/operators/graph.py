"""Graphs as edge tables: construction of typed edges, traversal, expansion, components, contradictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions import dense
from fathom.functions.profiles import CATEGORY, DOMAINS, EDGE, MOST_AGREEMENT, SPACES, TOPIC_AGREEMENT
from fathom.operators.tables import written

#: Which space names the edge, the first that agrees (fixed values).
EDGE_TYPES = (("E5", "causal_chain"), ("E7", "code_related"), ("E11", "entity_shared"), ("E8", "graph_connected"), ("E10", "paraphrase_aligned"), ("E6", "keyword_overlap"), ("E13", "keyword_overlap"), ("E1", "semantic_similar"))


def typed_edges(pairs: DataFrame, thresholds: dict[str, float] | None = None, least: float = TOPIC_AGREEMENT) -> DataFrame:
    """(a, b, agreement, weight, mask, edge_type) from (space, a, b, score): undirected pairs whose agreeing spaces weigh `least` or more.

    A space agrees at its threshold; weight is the agreement over the most there can be; mask has bit i-1 for space Ei.
    """
    thresholds = thresholds or dict(zip(SPACES, EDGE, strict=True))
    limit = F.coalesce(*[F.when(F.col("space") == s, F.lit(t)) for s, t in thresholds.items()])
    near = pairs.where(F.col("score") >= limit).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "space")
    has = lambda s: F.max((F.col("space") == s).cast("int"))
    each = near.where("a != b").groupBy("a", "b").agg(*[has(s).alias(s) for s in SPACES])
    agreement = sum((F.col(s) * w for s, w in CATEGORY.items()), F.lit(0.0))
    kind = F.coalesce(*[F.when(F.col(s) == 1, F.lit(t)) for s, t in EDGE_TYPES], F.lit("multi_agreement"))
    mask = sum((F.col(s) * (1 << i) for i, s in enumerate(SPACES)), F.lit(0)).cast("int")
    return each.select("a", "b", agreement.alias("agreement"), (agreement / MOST_AGREEMENT).alias("weight"), mask.alias("mask"), kind.alias("edge_type")).where(F.col("agreement") >= least)


def both_ways(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    rest = [c for c in edges.columns if c not in (a, b)]
    return edges.select(a, b, *rest).unionByName(edges.select(F.col(b).alias(a), F.col(a).alias(b), *rest))


def bfs(edges: DataFrame, starts: DataFrame, hops: int, max_nodes: int | None = None) -> DataFrame:
    """(id, depth, parent): nodes within so many hops of starts (id), each at its least depth, with the least parent there.

    edges (a, b) are followed from a to b. Each hop joins the frontier alone, and visited nodes leave by anti join;
    frontiers are written, so plans stay short. max_nodes stops after the hop that reaches it.
    """
    edges = written(edges.select("a", "b"), "edges")
    visited = written(starts.select("id", F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent")).distinct(), "visited")
    front = visited
    for depth in range(1, hops + 1):
        step = edges.join(front.select(F.col("id").alias("a")), "a").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("parent"))
        front = written(step.join(visited, "id", "left_anti").select("id", F.lit(depth).alias("depth"), "parent"), "front")
        if front.isEmpty():
            break
        visited = visited.unionByName(front)
        if max_nodes is not None and visited.count() >= max_nodes:
            break
    return visited


def shortest_path(edges: DataFrame, source: int, target: int, hops: int) -> list[int]:
    """Nodes from source to target over the fewest edges, by parents of a search; empty if there is none within hops."""
    spark = edges.sparkSession
    seen = written(bfs(edges, spark.createDataFrame([(source,)], "id long"), hops), "seen")
    path, at = [], target
    for _ in range(hops + 1):  # a row for each step of one path
        row = seen.where(F.col("id") == at).first()
        if row is None:
            return []
        path.append(at)
        if row.parent is None:
            return path[::-1]
        at = row.parent
    return []


def best_products(edges: DataFrame, source: int, hops: int, least: float = 0.3) -> DataFrame:
    """(id, product, depth): the greatest product of weights of a path from source of at most so many edges of weight `least` or more, and its first depth."""
    spark = edges.sparkSession
    strong = written(edges.where(F.col("weight") >= least).select("a", "b", "weight"), "edges")
    best = spark.createDataFrame([(source, 1.0, 0)], "id long, product double, depth int")
    front = best
    for depth in range(1, hops + 1):
        step = strong.join(front.select(F.col("id").alias("a"), "product"), "a").groupBy(F.col("b").alias("id")).agg(F.max(F.col("weight") * F.col("product")).alias("product"))
        better = step.join(best.select("id", F.col("product").alias("had")), "id", "left").where("had is null or product > had + 1e-12").select("id", "product", F.lit(depth).alias("depth"))
        front = written(better, "front")
        if front.isEmpty():
            break
        best = written(best.unionByName(front).groupBy("id").agg(F.max(F.struct("product", -F.col("depth"))).alias("m")).select("id", F.col("m.product").alias("product"), (-F.col("m.col2")).cast("int").alias("depth")), "best")
    return best


def cheapest(edges: DataFrame, source: int, rounds: int) -> DataFrame:
    """(id, cost): least sum of 1/(weight + 0.001) from source; relaxation by joins reaches the optimum an informed search would."""
    spark = edges.sparkSession
    cost = written(edges.select("a", "b", (1 / (F.col("weight") + 0.001)).alias("w")), "edges")
    best = spark.createDataFrame([(source, 0.0)], "id long, cost double")
    front = best
    for _ in range(rounds):
        step = cost.join(front.select(F.col("id").alias("a"), "cost"), "a").groupBy(F.col("b").alias("id")).agg(F.min(F.col("w") + F.col("cost")).alias("cost"))
        front = written(step.join(best.withColumnRenamed("cost", "had"), "id", "left").where("had is null or cost < had - 1e-12").select("id", "cost"), "front")
        if front.isEmpty():
            break
        best = written(best.unionByName(front).groupBy("id").agg(F.min("cost").alias("cost")), "best")
    return best


def _lower_bounds(edges: DataFrame, nodes: DataFrame, goal: list[float]) -> DataFrame:
    """(id, h): what a path from a node to the goal costs at least: the distance of their points times the least that any edge costs for the distance it spans."""
    p = nodes.select("id", dense.vec("point").alias("p"))
    spans = edges.join(p.withColumnsRenamed({"id": "a", "p": "pa"}), "a").join(p.withColumnsRenamed({"id": "b", "p": "pb"}), "b").select("w", dense.poincare_distance("pa", "pb").alias("d")).where("d > 0")
    ratio = spans.agg(F.min(F.col("w") / F.col("d"))).first()[0] or 0.0
    return p.select("id", (F.lit(ratio) * dense.poincare_distance("p", F.lit(goal).cast("array<double>"))).alias("h"))


def informed_path(edges: DataFrame, nodes: DataFrame, source: int, target: int, two_sided: bool = False, ahead: float = 0.25, rounds: int = 1000) -> tuple[float | None, int]:
    """Least cost, sum of 1/(weight + 0.001), from source to target over edges (a, b, weight), and how many nodes were expanded for it; cost None if there is no path.

    nodes (id, point) lie in the unit ball; hyperbolic distance to the goal bounds from below what is left. A round expands the open nodes whose cost
    and bound are within `ahead` (a share) of the least, by one join, and drops all that can't beat the best path found. It ends when no open
    node can. two_sided: a second search goes back from the target, the sides take turns by the number of open nodes, and paths are
    found where they meet. Nodes without a point are bounded by 0.
    """
    spark = edges.sparkSession
    cost = written(edges.select("a", "b", (1 / (F.col("weight") + 0.001)).alias("w")).where("a is not null and b is not null and w > 0"), "costs")
    ends = {r.id: [float(x) for x in r.p] for r in nodes.where(F.col("id").isin(source, target)).select("id", dense.vec("point").alias("p")).collect()}
    sides = []
    for start, goal, own in ((source, target, cost), (target, source, cost.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))):
        bound = written(_lower_bounds(cost, nodes, ends[goal]), "bounds") if goal in ends else None
        best = spark.createDataFrame([(start, 0.0, True)], "id long, cost double, open boolean")
        sides.append({"goal": goal, "edges": own, "bound": bound, "best": best})
    sides = sides if two_sided else sides[:1]
    least, expanded = (0.0 if source == target else float("inf")), 0

    def waiting(side: dict) -> DataFrame:
        rows = side["best"].where("open")
        rows = rows.withColumn("f", F.col("cost")) if side["bound"] is None else rows.join(side["bound"], "id", "left").withColumn("f", F.col("cost") + F.coalesce("h", F.lit(0.0))).drop("h")
        return rows.where(F.col("f") < least - 1e-12)

    for _ in range(rounds):
        views = [written(waiting(s), "open") for s in sides]
        sizes = [tuple(v.agg(F.count("*"), F.min("f")).first()) for v in views]
        # one side with nothing left to try is enough: no better path crosses it
        if not all(n for n, _ in sizes):
            break
        at = min(range(len(sides)), key=lambda i: sizes[i][0])
        side, (_, low) = sides[at], sizes[at]
        chosen = written(views[at].where(F.col("f") <= low * (1 + ahead) + 1e-12).select("id", "cost"), "chosen")
        expanded += chosen.count()
        step = side["edges"].join(chosen.withColumnsRenamed({"id": "a", "cost": "c"}), "a").groupBy(F.col("b").alias("id")).agg(F.min(F.col("c") + F.col("w")).alias("cost"))
        had = side["best"].join(chosen.select("id", F.lit(True).alias("done")), "id", "left").select("id", "cost", (F.col("open") & F.col("done").isNull()).alias("open"))
        both = had.unionByName(step.select("id", "cost", F.lit(True).alias("open")))
        side["best"] = written(both.groupBy("id").agg(F.min(F.struct("cost", "open")).alias("m")).select("id", "m.cost", "m.open"), "best")
        if two_sided:
            found = sides[0]["best"].select("id", F.col("cost").alias("x")).join(sides[1]["best"].select("id", F.col("cost").alias("y")), "id").agg(F.min(F.col("x") + F.col("y"))).first()[0]
        else:
            found = side["best"].where(F.col("id") == target).agg(F.min("cost")).first()[0]
        least = min(least, found) if found is not None else least
    return (None if least == float("inf") else least), expanded


def expand(found: DataFrame, edges: DataFrame, per_node: int = 5, total: int = 150, least: float = 0.4, factor: float = 0.8) -> DataFrame:
    """(id, score, via): neighbours of found (id, score) that are not found themselves: score * weight * factor, the best few of each node, then of all."""
    strong = edges.where(F.col("weight") >= least)
    found = written(found.select("id", "score"), "found")
    reached = found.join(strong, F.col("id") == F.col("a")).select(F.col("b").alias("id"), (F.col("score") * F.col("weight") * factor).alias("score"), F.col("a").alias("via"))
    fresh = reached.join(found.select("id"), "id", "left_anti")
    quota = Window.partitionBy("via").orderBy(F.desc("score"), "id")
    few = fresh.withColumn("n", F.row_number().over(quota)).where(F.col("n") <= per_node)
    best = few.groupBy("id").agg(F.max(F.struct("score", -F.col("via"))).alias("m")).select("id", F.col("m.score").alias("score"), (-F.col("m.col2")).cast("long").alias("via"))
    return best.orderBy(F.desc("score"), "id").limit(total)


def components(edges: DataFrame) -> DataFrame:
    """(id, label): least id of each node's component, by minima over neighbours and over the label's own label until nothing changes."""
    links = written(both_ways(edges.select("a", "b").where("a != b").distinct()), "links")
    labels = written(links.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = links.join(labels, F.col("b") == F.col("id")).groupBy(F.col("a").alias("id")).agg(F.min("label").alias("n"))
        step = labels.join(near, "id").select("id", F.least("label", "n").alias("label"))
        jump = step.select(F.col("id").alias("label"), F.col("label").alias("up"))
        new = written(step.join(jump, "label", "left").select("id", F.least("label", "up").alias("label")), "labels")
        changed = new.join(labels.withColumnRenamed("label", "had"), "id").where("label != had")
        if changed.isEmpty():
            return new
        labels = new


def cooccurrence(mentions: DataFrame, least: int = 1) -> DataFrame:
    """(a, b, n) of entities named by the same memory, from (id, entity). A memory's own entities are few; its pairs arise inside its row."""
    each = mentions.groupBy("id").agg(F.array_sort(F.collect_set("entity")).alias("own"))
    pairs = each.select(F.explode(F.flatten(F.transform("own", lambda x: F.transform(F.filter("own", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p"))
    return pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def contradictions(near: DataFrame, marked: DataFrame, least: float = 0.3) -> DataFrame:
    """(id, confidence) from (id, sim) and (id, edge): 0.4 of similarity, 0.6 of the edge's weight, 1.2 times if both speak and similarity is over 0.5."""
    both = near.join(marked, "id", "full")
    base = F.coalesce(F.col("sim") * 0.4, F.lit(0.0)) + F.coalesce(F.col("edge") * 0.6, F.lit(0.0))
    value = dense.clamp(base * F.when(F.col("edge").isNotNull() & (F.col("sim") > 0.5), 1.2).otherwise(1.0))
    return both.select("id", value.alias("confidence")).where(F.col("confidence") >= least)


def modulated(weight: Column, domain: str, steering: Column | float = 0.0) -> Column:
    """Edge weight by a domain's excitation, inhibition and modulation, and by steering, within 0..1."""
    e, i, m = DOMAINS[domain]
    steering = F.lit(steering) if isinstance(steering, int | float) else steering
    return dense.clamp(weight * (1 + (e - i) + (m - 0.5) * 0.5) * (1 + 0.2 * steering))


def directed(score: Column, source_kind: Column, target_kind: Column) -> Column:
    """cause to effect 1.2, effect to cause 0.8, else 1; within 0..1."""
    factor = F.when((source_kind == "cause") & (target_kind == "effect"), 1.2).when((source_kind == "effect") & (target_kind == "cause"), 0.8).otherwise(1.0)
    return dense.clamp(score * factor)


# Typed edges from plain scores, steering, contexts

#: Which space names the edge where fewer than three agree, the first that does (fixed values).
FIRST_AGREEING = (("E7", "code_related"), ("E11", "entity_shared"), ("E5", "causal_chain"), ("E8", "graph_connected"), ("E10", "paraphrase_aligned"), ("E6", "keyword_overlap"), ("E13", "keyword_overlap"))


def edges_by_count(pairs: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """(a, b, agreeing, edge_type, weight) from (space, a, b, score): three spaces that agree make multi_agreement with their mean, else the first of the list names the edge and weighs it. Temporal spaces don't count."""
    limit = F.coalesce(*[F.when(F.col("space") == s, F.lit(t)) for s, t in thresholds.items()])
    near = pairs.where(~F.col("space").isin("E2", "E3", "E4") & (F.col("score") >= limit))
    each = near.groupBy("a", "b").agg(F.count_distinct("space").alias("agreeing"), F.avg("score").alias("mean"), *[F.max(F.when(F.col("space") == s, F.col("score"))).alias(s) for s in SPACES])
    many = F.col("agreeing") >= 3
    kind = F.when(many, "multi_agreement")
    weight = F.when(many, F.col("mean"))
    for s, name in FIRST_AGREEING:
        kind, weight = kind.when(F.col(s).isNotNull(), name), weight.when(F.col(s).isNotNull(), dense.clamp(F.col(s)))
    return each.select("a", "b", "agreeing", kind.otherwise("semantic_similar").alias("edge_type"), weight.otherwise(dense.clamp(F.coalesce("E1", F.lit(0.0)))).alias("weight"))


def steered(old: Column, reward: Column) -> Column:
    """A steering reward added up, within -1..1."""
    return dense.clamp(old + reward, -1.0, 1.0)


def overlap(a: Column, b: Column, same_domain: Column | None = None, same_mechanism: Column | None = None) -> Column:
    """How much two contexts' sets share: 0.7 of the mean of Jaccard and containment in the smaller, 0.15 for one domain and for one mechanism if that mean is over 0.1. Both empty 0.5, one empty 0.1."""
    both, union, least = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)), F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    mean = 0.5 * both / union + 0.5 * both / least
    bonus = lambda c: F.lit(0.0) if c is None else F.when((mean > 0.1) & c, 0.15).otherwise(0.0)
    value = dense.clamp(0.7 * mean + bonus(same_domain) + bonus(same_mechanism))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 0.5).when((F.size(a) == 0) | (F.size(b) == 0), 0.1).otherwise(value)


def by_connectivity(score: Column, shared: Column, weight: float, seeks_source: Column, is_source: Column) -> Column:
    """A score blended with a context's overlap; what a question for sources finds as a source counts 1.2 times."""
    return (score * (1 - weight) + shared * weight) * F.when(seeks_source & is_source, 1.2).otherwise(1.0)


# Cause and effect, hierarchies, depth first


def effects(edges: DataFrame, node: int) -> DataFrame:
    return edges.where(F.col("a") == node).select(F.col("b").alias("id"), "weight")


def causes(edges: DataFrame, node: int) -> DataFrame:
    return edges.where(F.col("b") == node).select(F.col("a").alias("id"), "weight")


def ancestors(up: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """(start, id, depth): what each start reaches over up (child, parent), itself at 0; each at its least depth. Only the frontier is joined."""
    seen = written(starts.select("start", F.col("start").alias("id"), F.lit(0).alias("depth")).distinct(), "seen")
    front = seen
    for depth in range(1, hops + 1):
        step = front.join(up, F.col("id") == F.col("child")).select("start", F.col("parent").alias("id")).distinct()
        front = written(step.join(seen.select("start", "id"), ["start", "id"], "left_anti").withColumn("depth", F.lit(depth)), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def common_ancestors(pairs: DataFrame, up: DataFrame, levels: DataFrame, hops: int) -> DataFrame:
    """(a, b, id, depth_a, depth_b): the deepest common ancestor of each pair by levels (id, level), the least id of equals."""
    starts = pairs.select(F.col("a").alias("start")).unionByName(pairs.select(F.col("b").alias("start"))).distinct()
    above = written(ancestors(up, starts, hops), "above")
    x, y = above.toDF("a", "id", "depth_a"), above.toDF("b", "id", "depth_b")
    met = pairs.select("a", "b").join(x, "a").join(y, ["b", "id"]).join(levels, "id")
    best = met.groupBy("a", "b").agg(F.max(F.struct("level", -F.col("id"), "depth_a", "depth_b")).alias("m"))
    return best.select("a", "b", (-F.col("m.col2")).alias("id"), F.col("m.depth_a").alias("depth_a"), F.col("m.depth_b").alias("depth_b"))


def entailed(edges: DataFrame, nodes: DataFrame, start: int, aperture: float, hops: int, down: bool = True, least: float = 0.0) -> DataFrame:
    """(id, depth, membership): nodes (id, point) within hops of start that its cone holds (or whose cones hold it) with a membership of `least` or more."""
    row = nodes.where(F.col("id") == start).select(F.col("point").cast("array<double>")).first()
    if row is None:
        raise LookupError("no such node")
    q = F.lit([float(x) for x in row[0]]).cast("array<double>")
    reached = bfs(edges, edges.sparkSession.createDataFrame([(start,)], "id long"), hops).where(F.col("id") != start)
    angle = dense.cone_angle(q, "point") if down else dense.cone_angle("point", q)
    return reached.join(nodes, "id").select("id", "depth", dense.cone_membership(angle, aperture).alias("membership")).where(F.col("membership") >= least)


def depth_first(edges: DataFrame, start: int, hops: int, most: int = 10_000) -> DataFrame:
    """(place, id, depth): nodes in the order of a depth-first walk over (a, b), neighbours by id, within hops of start, `most` at most.

    The order is sequential by nature: the reachable part is found in parallel, and one task walks it. A part of more than 20 * most edges
    raises an error, as no bounded task could hold it.
    """
    spark = edges.sparkSession
    near = written(bfs(edges, spark.createDataFrame([(start,)], "id long"), hops).select(F.col("id").alias("a")), "near")
    part = written(edges.join(near, "a").select("a", "b").distinct(), "part")
    if part.count() > 20 * most:
        raise ValueError("too many edges within reach for one walk; take fewer hops or more nodes")

    def walk(own):
        import pandas as pd

        after: dict[int, list[int]] = {}
        for a, b in sorted(zip(own["a"].tolist(), own["b"].tolist(), strict=True)):
            after.setdefault(a, []).append(b)
        order, seen, stack = [], set(), [(start, 0)]
        while stack and len(order) < most:
            at, depth = stack.pop()
            if at in seen:
                continue
            seen.add(at)
            order.append((len(order), at, depth))
            if depth < hops:
                stack += [(b, depth + 1) for b in reversed(after.get(at, ())) if b not in seen]
        return pd.DataFrame(order, columns=["place", "id", "depth"])

    lone = spark.createDataFrame([(start, start)], "a long, b long")  # a start without edges is walked, too
    return part.unionByName(lone).groupBy(F.lit(0).alias("one")).applyInPandas(walk, "place long, id long, depth int")


def checked_pairs(pairs: DataFrame, marked: DataFrame) -> DataFrame:
    """(a, b, confidence) of given pairs: the weight of their mark in marked (a, b, weight), 0 without one."""
    return pairs.join(marked, ["a", "b"], "left").select("a", "b", F.coalesce("weight", F.lit(0.0)).alias("confidence"))
