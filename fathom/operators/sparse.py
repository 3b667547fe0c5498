"""Sparse vectors as rows (id, term, w): products, an inverted index with document norms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def weight_of_term(query: dict[str, float], term: str = "term") -> Column:
    """A query's weight of a term as an expression; 0 for terms it lacks."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for t, w in query.items() for x in (t, float(w))]), F.col(term)), F.lit(0.0))


def similarity(post: DataFrame, query: dict[str, float]) -> DataFrame:
    """(id, dot, cosine, norm) of every sparse vector with a query: one aggregate, as the query is a literal."""
    q = weight_of_term(query)
    own = sum(w * w for w in query.values()) ** 0.5
    each = post.groupBy("id").agg(F.sum(F.col("w") * q).alias("dot"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return each.select("id", "dot", F.when((F.col("norm") > 0) & F.lit(own > 0), F.col("dot") / (F.col("norm") * own)).otherwise(0.0).alias("cosine"), "norm")


def pair_dots(x: DataFrame, y: DataFrame) -> DataFrame:
    """(a, b, dot) of the vectors of two sides that share a term, by an equi-join of postings; products are summed before they are shuffled again."""
    met = x.select(F.col("id").alias("a"), "term", F.col("w").alias("wa")).join(y.select(F.col("id").alias("b"), "term", F.col("w").alias("wb")), "term")
    return met.where("a != b").groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))


class InvertedIndex:
    """Postings (id, term, w) with each document's norm; adding and removing return a new index over the same tables."""

    def __init__(self, post: DataFrame):
        self.post = post.where("w != 0")

    def add(self, post: DataFrame) -> InvertedIndex:
        """ValueError for a document without weight."""
        empty = post.groupBy("id").agg(F.max(F.abs("w")).alias("m")).where("m = 0")
        if not empty.isEmpty():
            raise ValueError("a vector of norm zero")
        return InvertedIndex(self.post.unionByName(post.select("id", "term", "w")))

    def remove(self, ids: DataFrame) -> InvertedIndex:
        return InvertedIndex(self.post.join(ids.select("id"), "id", "left_anti"))

    def search(self, query: dict[str, float]) -> DataFrame:
        """(id, score): sum over the query's terms of query weight * document weight / document norm * ln((N - df + 0.5)/(df + 0.5) + 1)."""
        norms = self.post.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
        hits = self.post.where(F.col("term").isin(*query))
        df = hits.groupBy("term").agg(F.count("*").alias("df"))
        n = norms.agg(F.count("*").alias("n"))
        idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        rows = hits.join(F.broadcast(df), "term").join(norms, "id").crossJoin(F.broadcast(n))  # a row for each word of the query, and one row
        return rows.groupBy("id").agg(F.sum(weight_of_term(query) * F.col("w") / F.col("norm") * idf).alias("score"))
