"""Fusion of rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.functions import dense
from fathom.operators import fuse, retrieve
from fathom.plans.registry import SPACES, WEIGHTS, R, Registry, S
from fathom.plans.retrieval import all_scores, long_scores, others, query_of, space_rankings, vectors

query = Registry()


def _rounded(df, k: int | None = None):
    out = df.withColumn("score", F.round("score", 8))
    return out.orderBy(F.desc("score"), "id").limit(k) if k else out


def _fused(term: str, group: str = "", k: int = 10) -> str:
    return f"with {R} select id, round({term}, 8) as score{group} from r join w using (space) group by id order by score desc, id limit {k}"


@query(_fused("sum(w / (60 + rank))", ", list_sort(list(space)) as spaces"))
def weighted_rrf(spark, d):
    return _rounded(fuse.rrf(space_rankings(spark, d), WEIGHTS), 10)


@query(_fused("sum(w / (60 + rank) * case when space = 'E5' then score else 1 end)"))
def score_weighted_rrf(spark, d):
    return _rounded(fuse.rrf(space_rankings(spark, d), WEIGHTS, scored=("E5",)), 10).select("id", "score")


@query(_fused("sum(w * score)"))
def weighted_sum_fusion(spark, d):
    return _rounded(fuse.weighted_sum(space_rankings(spark, d), WEIGHTS), 10)


@query(_fused("sum(w / (60 + rank)) * case when count(*) = 1 then 1.1 else 1 end", k=20))
def rrf_additive_unique_boost(spark, d):
    return _rounded(fuse.rrf(space_rankings(spark, d), WEIGHTS, unique_boost=0.1), 20).select("id", "score")


def _normalised(expression: str) -> str:
    return f"with {R} select space, id, round({expression}, 6) as normalised from r"


@query(_normalised("case when max(score) over p > min(score) over p then (score - min(score) over p) / (max(score) over p - min(score) over p) else 1 end") + " window p as (partition by space)")
def normalize_minmax(spark, d):
    return fuse.normalise(space_rankings(spark, d), "minmax").select("space", "id", F.round("normalised", 6).alias("normalised"))


@query(_normalised("(least(3, greatest(-3, (score - avg(score) over p) / stddev_pop(score) over p)) + 3) / 6") + " window p as (partition by space)")
def normalize_zscore(spark, d):
    return fuse.normalise(space_rankings(spark, d), "zscore").select("space", "id", F.round("normalised", 6).alias("normalised"))


@query(_normalised("1 / rank"))
def normalize_rank(spark, d):
    return fuse.normalise(space_rankings(spark, d), "rank").select("space", "id", F.round("normalised", 6).alias("normalised"))


@query(f"with {R} select id, max(score) as max_score, round(sum(score), 8) as sum_score, round(avg(score), 8) as mean_score, count(*) as n from r group by id")
def aggregate_max_mean(spark, d):
    return fuse.pooled(space_rankings(spark, d)).select("id", "max_score", F.round("sum_score", 8).alias("sum_score"), F.round("mean_score", 8).alias("mean_score"), "n")


MATRIX = {("E1", "E1"): 0.4, ("E5", "E5"): 0.2, ("E7", "E7"): 0.2, ("E1", "E5"): 0.15, ("E5", "E7"): 0.05}


@query(f"with {S}, t as (select id, max(score) filter (space = 'E1') as a, max(score) filter (space = 'E5') as b, max(score) filter (space = 'E7') as c from s group by id) select id, round((a * 0.4 + b * 0.2 + c * 0.2 + sqrt(a * b) * 0.15 + sqrt(b * c) * 0.05) / 1.0, 8) as score from t")
def matrix_weighted_fusion(spark, d):
    return fuse.matrix_weighted(long_scores(spark, d), MATRIX).select("id", F.round("score", 8).alias("score"))


@query(f"with {R} select space, (case when count(*) >= 3 and var_samp(score) < 0.001 then w * 0.25 else w end)::double as weight from r join w using (space) group by space, w")
def degenerate_suppression(spark, d):
    return fuse.suppressed_weights(space_rankings(spark, d), WEIGHTS)


@query(f"with {S}, w(space, w) as (values ('E1', 0.4), ('E5', 0.25), ('E7', 0.2), ('E10', 0.15)), v2 as (select space, case when count(*) >= 3 and var_samp(score) < 0.001 then w * 0.25 else w end as w2 from s join w using (space) group by space, w), t as (select id, round(sum(w2 * score) / sum(w2), 8) as score from s join v2 using (space) group by id) select id, score from t order by score desc, id limit 20")
def semantic_fusion(spark, d):
    scores = long_scores(spark, d)
    out = fuse.semantic_fusion(scores, fuse.suppressed_weights(scores, WEIGHTS))
    return out.select("id", F.round("score", 8).alias("score")).orderBy(F.desc("score"), "id").limit(20)


@query(f"with {R} select id, count(distinct space) as found, count(distinct space) / 4 as share from r where rank <= 20 group by id")
def consensus(spark, d):
    return fuse.consensus(space_rankings(spark, d), 4, 20)


@query(f"with {R}, t as (select id, count(distinct space) as n from r group by id) select sum((n >= 4)::bigint)::bigint as in_all, count(*) as in_any, sum((n >= 4)::bigint) / count(*) as agreement from t")
def view_agreement(spark, d):
    return fuse.agreement(space_rankings(spark, d), 4)


@query(f"with {R} select id, max(space) as space, max(score) as score from r group by id having count(*) = 1")
def unique_finds(spark, d):
    return space_rankings(spark, d).groupBy("id").agg(F.max("space").alias("space"), F.max("score").alias("score"), F.count("*").alias("n")).where("n = 1").drop("n")


@query(f"with {S}, t as (select id, max(score) filter (space = 'E1') as hi, max(score) filter (space = 'E7') as lo from s group by id) select id, hi as E1, lo as E7, round(hi - lo, 6) as score from t where hi >= 0.55 and lo <= 0.5 order by score desc, id limit 10")
def cross_space_anomalies(spark, d):
    out = fuse.anomalies(all_scores(spark, d), "E1", "E7", 0.55, 0.5)
    return out.select("id", "E1", "E7", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(10)


@query(
    f"with {S}, m as (select id, score, row_number() over (order by score desc, id) as rank from s where space = 'E1'), o as (select a.id, a.score from s a join s b on a.id = b.id and b.space = 'E1' where a.space = 'E10' and a.score >= 0.15 and b.score < 0.5), x as (select id, score, 'discovery' as origin from o where id not in (select id from m where rank <= 10) order by score desc, id limit 2) select id, score, 'main' as origin from m where rank <= 8 union all select * from x"
)
def blind_spot_search(spark, d):
    scores = all_scores(spark, d)
    main = retrieve.knn(scores, F.col("E1"), 10, "id")
    weak = scores.where("E10 >= 0.15 and E1 < 0.5").select("id", F.col("E10").alias("score"))
    return fuse.blind_spots(main, weak, 10)


@query(f"with {S}, w(space, w) as (values ('E1', 0.4), ('E5', 0.25), ('E7', 0.2), ('E10', 0.15)) select id, round(sum(w * greatest(score - 0.55, 0)) / 0.45, 6) as relevance, sum((score >= 0.55)::bigint)::bigint as matching from s join w using (space) group by id")
def relevance_threshold(spark, d):
    out = fuse.relevance(long_scores(spark, d), WEIGHTS, dict.fromkeys(SPACES, 0.55))
    return out.select("id", F.round("relevance", 6).alias("relevance"), "matching")


@query(f"with {S}, w(space, w) as (values ('E1', 0.2 / 0.8), ('E5', 0.1 / 0.8), ('E7', 0.4 / 0.8), ('E10', 0.1 / 0.8)) select id, round(sum(w * score) / sum(w), 10) as score from s join w using (space) group by id order by score desc, id limit 10")
def weight_profile_rescore(spark, d):
    from fathom.functions.profiles import PROFILES, resolve

    own = dict(zip((f"E{i}" for i in range(1, 14)), PROFILES["code_search"], strict=True))
    weights = resolve(custom={s: own[s] for s in SPACES})
    out = fuse.weighted_mean(long_scores(spark, d), weights)
    return out.select("id", F.round("score", 10).alias("score")).orderBy(F.desc("score"), "id").limit(10)


@query(
    f"with {R}, c as (select distinct id from r), f as (select id, round(sum(w * score) / sum(w), 8) as fused from s join c using (id) join w using (space) group by id), k as (select * from f order by fused desc, id limit 30), m as (select k.id, k.fused, u.qs, greatest(list_cosine_similarity(q.v[qs:qs+15], v.v[1:16]), list_cosine_similarity(q.v[qs:qs+15], v.v[17:32]), list_cosine_similarity(q.v[qs:qs+15], v.v[33:48]), list_cosine_similarity(q.v[qs:qs+15], v.v[49:64])) as best from k join v using (id), q, (select unnest([1, 17, 33, 49]) as qs) u) select id, round(0.85 * max(fused) + 0.15 * avg((best + 1) / 2), 8) as score from m group by id order by score desc, id limit 10"
)
def pipeline_three_stage(spark, d):
    """Recall from every space, weighted scores of what was recalled, late interaction over the best thirty."""
    df = vectors(spark, d)
    recalled = space_rankings(spark, d).select("id").distinct()
    scored = fuse.weighted_mean(long_scores(spark, d).join(F.broadcast(recalled), "id", "left_semi"), WEIGHTS)
    best = scored.select("id", F.round("score", 8).alias("fused")).orderBy(F.desc("fused"), "id").limit(30)
    late = dense.maxsim(dense.tokens(query_of(df), 16), dense.tokens("v", 16))
    out = df.join(F.broadcast(best), "id").select("id", F.round(fuse.interpolated(F.col("fused"), late), 8).alias("score"))
    return out.orderBy(F.desc("score"), "id").limit(10)


@query(f"with {S}, t as (select a.space as space_a, b.space as space_b, corr(a.score, b.score) as r from s a join s b on a.id = b.id and ((a.space, b.space) in (('E1','E5'), ('E1','E7'), ('E1','E10'), ('E5','E7'), ('E5','E10'), ('E7','E10'))) group by a.space, b.space) select space_a, space_b, round(r, 6) as r from t")
def space_correlation(spark, d):
    return fuse.space_correlation(long_scores(spark, d), list(SPACES)).select("space_a", "space_b", F.round("r", 6).alias("r"))


@query(f"with {S} select id, round(avg(score), 8) as mean, round(sqrt(avg(score * score)), 8) as rms, round(exp(avg(ln(greatest(score, 1e-9)))), 8) as geometric, min(score) as least, max(score) as most from s group by id")
def group_aggregates(spark, d):
    s = F.col("score")
    return long_scores(spark, d).groupBy("id").agg(F.round(F.avg(s), 8).alias("mean"), F.round(F.sqrt(F.avg(s * s)), 8).alias("rms"), F.round(F.exp(F.avg(F.log(F.greatest(s, F.lit(1e-9))))), 8).alias("geometric"), F.min(s).alias("least"), F.max(s).alias("most"))


@query(f"with {S}, t as (select id, max(score) filter (space = 'E1') as e1, max(score) filter (space = 'E5') as e5, max(score) filter (space = 'E10') as e10 from s group by id) select id, e1, case when e1 < 0.5 and greatest(e5, e10) >= 0.6 then 'blind_spot' else 'covered' end as coverage from t")
def coverage_hints(spark, d):
    c = F.when((F.col("E1") < 0.5) & (F.greatest("E5", "E10") >= 0.6), "blind_spot").otherwise("covered")
    return all_scores(spark, d).select("id", F.col("E1").alias("e1"), c.alias("coverage"))


@query()
def tucker_similarity(spark, d):
    """Cosine of each vector's core with vector 0's: four spaces of sixteen dimensions, cores of three by eight."""
    from fathom.operators.tucker import core_similarity, tucker_core, tucker_factors

    df = vectors(spark, d)
    u, v = tucker_factors(df, "v", (4, 16), (3, 8))
    core = retrieve.one_vector(df.where("id = 0").select("id", tucker_core("v", (4, 16), u, v).alias("c")), "id = 0", "c")
    return df.where("id <> 0").select("id", F.round(core_similarity(tucker_core("v", (4, 16), u, v), core), 6).alias("score"))
