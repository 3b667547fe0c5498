"""Graph questions said step by step: what to look for, then how to narrow it, then run()."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.functions import dense
from fathom.operators import graph, retrieve
from fathom.operators.tables import written


@dataclass(frozen=True)
class GraphQuery:
    """An immutable question; each `with_` gives another one. Nothing runs before run().

    nodes are (id, v) and, where a domain is asked for, domain; edges are (a, b, weight, edge_type).
    """

    kind: str
    vector: tuple[float, ...] = ()
    node: int | None = None
    upward: bool = True
    options: dict = field(default_factory=dict)

    @classmethod
    def semantic(cls, vector: list[float]) -> GraphQuery:
        """The nodes nearest to a vector, by (cosine + 1) / 2."""
        return cls("semantic", tuple(vector))

    @classmethod
    def entailment(cls, node: int, upward: bool = True) -> GraphQuery:
        """Nodes whose cone holds the node's vector (upward), or that its own cone holds."""
        return cls("entailment", node=node, upward=upward)

    @classmethod
    def contradiction(cls, vector: list[float], node: int) -> GraphQuery:
        """What contradicts a node: near ones, and ones that a `contradicts` edge ties to it."""
        return cls("contradiction", tuple(vector), node)

    def _with(self, **more) -> GraphQuery:
        return replace(self, options=self.options | more)

    def with_domain(self, domain: str) -> GraphQuery:
        return self._with(domain=domain)

    def with_edge_types(self, *types: str) -> GraphQuery:
        return self._with(types=types)

    def with_min_similarity(self, least: float) -> GraphQuery:
        return self._with(least=min(1.0, max(0.0, least)))

    def with_top_k(self, k: int) -> GraphQuery:
        return self._with(k=k)

    def with_graph_context(self, depth: int) -> GraphQuery:
        return self._with(depth=depth)

    def with_contradiction_threshold(self, least: float) -> GraphQuery:
        return self._with(contradiction=least)

    def run(self, nodes: DataFrame, edges: DataFrame) -> DataFrame:
        """(id, score, depth): at most k found nodes with depth 0, and with a graph context those within so many edges of them, of score null. ValueError for an unknown kind."""
        o = self.options
        k, least = o.get("k", 10), o.get("least", 0.0)
        rows = nodes.where(F.col("domain") == o["domain"]) if "domain" in o else nodes
        ties = edges.where(F.col("edge_type").isin(*o["types"])) if "types" in o else edges
        q = F.lit([float(x) for x in self.vector]).cast("array<double>")
        if self.kind == "semantic":
            found = retrieve.knn(rows, dense.cos01("v", q), k, "id", least)
        elif self.kind == "entailment":
            own = retrieve.one_vector(nodes, F.col("id") == self.node, "v")
            angle = dense.cone_angle("v", own) if self.upward else dense.cone_angle(own, "v")
            found = retrieve.knn(rows.where(F.col("id") != self.node), dense.cone_membership(angle, o.get("aperture", 1.0)), k, "id", max(least, 1e-9))
        elif self.kind == "contradiction":
            others = rows.where(F.col("id") != self.node)
            near = retrieve.knn(others, dense.cos01("v", q), 2 * k, "id", least).select("id", F.col("score").alias("sim"))
            both = graph.both_ways(edges.where("edge_type = 'contradicts'").select("a", "b", "weight"))
            marked = both.where(F.col("a") == self.node).groupBy(F.col("b").alias("id")).agg(F.max("weight").alias("edge"))
            hits = graph.contradictions(near, marked.join(others.select("id"), "id", "left_semi"), o.get("contradiction", 0.5))
            found = retrieve.knn(hits, F.col("confidence"), k, "id")
        else:
            raise ValueError(f"no question of kind {self.kind}")
        found = written(found.select("id", "score", F.lit(0).alias("depth")), "found")
        if not o.get("depth"):
            return found
        reached = graph.bfs(graph.both_ways(ties.select("a", "b")), found.select("id"), o["depth"]).where("depth > 0")
        return found.unionByName(reached.join(nodes.select("id"), "id", "left_semi").select("id", F.lit(None).cast("double").alias("score"), "depth"))
