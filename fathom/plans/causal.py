"""Directional similarity: the first half of a vector as cause or source, the second as effect or target."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fathom.functions import dense
from fathom.operators import graph, retrieve, text
from fathom.plans.registry import Registry, S, V
from fathom.plans.retrieval import all_scores, others, query_of, vectors
from fathom.sources.tables import table

query = Registry()


def cause(v="v"):
    return F.slice(v, 1, 32)


def effect(v="v"):
    return F.slice(v, 33, 32)


_HALF = f"with {V}, h as (select v.id, list_cosine_similarity(q.v[1:32], v.v[33:64]) as ce, list_cosine_similarity(q.v[33:64], v.v[1:32]) as ec, (list_cosine_similarity(q.v, v.v) + 1) / 2 as e1 from v, q where v.id <> 0)"


def halves(spark, d):
    df = vectors(spark, d)
    q = query_of(df)
    return others(df).select("id", dense.cosine(F.slice(q, 1, 32), effect()).alias("ce"), dense.cosine(F.slice(q, 33, 32), cause()).alias("ec"), dense.cos01("v", q).alias("e1"))


@query(f"{_HALF} select id, round(e1 * case when ce >= 0.04 then 1.10 when ce <= 0.008 then 0.85 else 1 end, 6) as score from h")
def causal_gate(spark, d):
    gate = F.when(F.col("ce") >= 0.04, 1.10).when(F.col("ce") <= 0.008, 0.85).otherwise(1.0)
    return halves(spark, d).select("id", F.round(F.col("e1") * gate, 6).alias("score"))


@query(f"{_HALF} select id, case when ce > ec then 'effect' else 'cause' end as direction, round(least(1, greatest(0, case when ce > ec then ce * 1.2 else ec * 0.8 end)), 6) as score from h")
def direction_modifier(spark, d):
    kind = F.when(F.col("ce") > F.col("ec"), "effect").otherwise("cause")
    score = graph.directed(F.greatest("ce", "ec"), F.when(kind == "effect", "cause").otherwise("effect"), kind)
    return halves(spark, d).select("id", kind.alias("direction"), F.round(score, 6).alias("score"))


def _ranked(part: str, factor: float) -> str:
    return f"{_HALF}, t as (select id, round(least(1, greatest(0, (0.8 * e1 + 0.2 * {part}) * {factor})), 6) as score from h) select id, score, row_number() over (order by score desc, id)::int as rank from t where score >= 0.1 order by score desc, id limit 10"


@query(_ranked("ec", 0.8))
def abduction_rank(spark, d):
    return retrieve.knn(halves(spark, d), dense.clamp((0.8 * F.col("e1") + 0.2 * F.col("ec")) * 0.8), 10, "id", least=0.1)


@query(_ranked("ce", 1.2))
def prediction_rank(spark, d):
    return retrieve.knn(halves(spark, d), dense.clamp((0.8 * F.col("e1") + 0.2 * F.col("ce")) * 1.2), 10, "id", least=0.1)


@query(f"{_HALF}, t as (select id, round(least(1, greatest(0, greatest(ce * 1.2, ec * 0.8))), 6) as score from h) select id, score, row_number() over (order by score desc, id)::int as rank from t where score >= 0.1 order by score desc, id limit 10")
def asymmetric_graph_similarity(spark, d):
    return retrieve.knn(halves(spark, d), dense.clamp(F.greatest(F.col("ce") * 1.2, F.col("ec") * 0.8)), 10, "id", least=0.1)


@query(f"with {V} select id, case when c > e * 1.05 then 'cause' when e > c * 1.05 then 'effect' else 'unknown' end as direction from (select id, list_var_pop(v[1:32]) as c, list_var_pop(v[33:64]) as e from v)")
def vector_direction(spark, d):
    c, e = dense.variance(cause()), dense.variance(effect())
    return vectors(spark, d).select("id", F.when(c > e * 1.05, "cause").when(e > c * 1.05, "effect").otherwise("unknown").alias("direction"))


@query("with e as (select *, lead(value) over w as next from events window w as (partition by user_id order by ts, event_id)) select user_id, count(*) as hops, round(avg(case when next is null then null else value / 1000 * next / 1000 end), 6) as mean_product from e group by user_id")
def chain_hops(spark, d):
    """Each user's events in order as a chain: mean product of neighbouring scores."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("next", F.lead("value").over(w))
    return e.groupBy("user_id").agg(F.count("*").alias("hops"), F.round(F.avg(F.col("value") / 1000 * F.col("next") / 1000), 6).alias("mean_product"))


@query(
    f"with recursive {V}, c as (select 0::bigint as id, 0 as hop, 1.0::double as score, [0::bigint] as path union all (select b.id, c.hop + 1, round(c.score * ((list_cosine_similarity(a.v[33:64], b.v[1:32]) + 1) / 2) * pow(0.9, c.hop), 6), list_append(c.path, b.id) from c join v a on a.id = c.id join v b on not list_contains(c.path, b.id) where c.hop < 4 qualify row_number() over (order by round((list_cosine_similarity(a.v[33:64], b.v[1:32]) + 1) / 2, 6) desc, b.id) = 1)) select hop, id, score from c"
)
def causal_chain(spark, d):
    """Greedy chain of four hops: the next cause nearest to the effect at hand, attenuated by 0.9 a hop. One row comes back for each hop."""
    df = vectors(spark, d)
    at, score, path = 0, 1.0, [0]
    out = [(0, 0, 1.0)]
    for hop in range(4):
        here = retrieve.one_vector(df, F.col("id") == at, "v")
        link = dense.cos01(cause(), F.slice(here, 33, 32))
        best = df.where(~F.col("id").isin(path)).select("id", F.round(link, 6).alias("near"), F.round(score * link * 0.9**hop, 6).alias("score")).orderBy(F.desc("near"), "id").first()
        if best is None:
            break
        at, score = best.id, best.score
        path.append(at)
        out.append((hop + 1, at, score))
    return spark.createDataFrame(out, "hop int, id long, score double")


@query(f"with {S}, t as (select id, max(score) filter (space = 'E1') as e1, max(score) filter (space = 'E7') as e7 from s group by id) select id, round(0.6 * e1 + 0.4 * (case when e7 > 0.75 then 0.75 + 1.4 * (e7 - 0.75) else e7 * 0.9 end), 6) as score from t")
def code_search_hybrid(spark, d):
    e7 = F.when(F.col("E7") > 0.75, 0.75 + 1.4 * (F.col("E7") - 0.75)).otherwise(F.col("E7") * 0.9)
    return all_scores(spark, d).select("id", F.round(0.6 * F.col("E1") + 0.4 * e7, 6).alias("score"))
