"""How queries are registered: a function of (spark, folder) and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add


#: The query vector's row, the instant that ages are taken to, and the question of text searches.
QUERY_ID, AS_OF = 0, "2024-01-31 00:00:00"
#: Parts of the vectors that stand for spaces: start (from 1) and width.
SPACES = {"E1": (1, 16), "E5": (17, 16), "E7": (33, 16), "E10": (49, 16)}
WEIGHTS = {"E1": 0.4, "E5": 0.25, "E7": 0.2, "E10": 0.15}

#: SQL for the same: v (id, v), q (v of the query), s (space, id, score), r (s with rank, the best 50).
V = f"v as (select vec_id as id, embedding::double[] as v, label from embeddings), q as (select v from v where id = {QUERY_ID})"
_SP = ", ".join(f"('{s}', {lo}, {lo + n - 1})" for s, (lo, n) in SPACES.items())
_W = ", ".join(f"('{s}', {w})" for s, w in WEIGHTS.items())
S = f"{V}, sp(space, lo, hi) as (values {_SP}), s as (select space, v.id, round((list_cosine_similarity(v.v[lo:hi], q.v[lo:hi]) + 1) / 2, 6) as score from v, q, sp where v.id <> {QUERY_ID})"
R = f"{S}, w(space, w) as (values {_W}), r as (select * from (select *, row_number() over (partition by space order by score desc, id) as rank from s) where rank <= 50)"
