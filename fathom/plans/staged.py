"""Search in stages, details of late interaction, profiles of a text, alignments and directions."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.functions import dense, lexicon, temporal
from fathom.operators import fuse, retrieve, staged, text
from fathom.plans.graphs import _KNN, knn_edges
from fathom.plans.registry import SPACES, Registry, V
from fathom.plans.retrieval import _TERMS, POSTINGS, TERMS, others, query_of, vectors
from fathom.sources.tables import table

query = Registry()
_BEST = "greatest(" + ", ".join(f"list_cosine_similarity(q.v[qs:qs+15], v.v[{lo}:{lo + 15}])" for lo, _ in SPACES.values()) + ")"


@query(
    f"with {POSTINGS}, {_KNN}, r as (select id, count(*) as shared from p where term in ({_TERMS}) and id <> 0 and id in (select id from v) group by id), "
    "s1 as (select id, row_number() over (order by shared desc, id) as rank from r qualify rank <= 1000), "
    "s0 as (select v.id, round((list_cosine_similarity(v.v[1:16], q.v[1:16]) + 1) / 2, 6) as p, round((list_cosine_similarity(v.v, q.v) + 1) / 2, 6) as whole from v join s1 using (id), q), "
    "s2 as (select id, whole, row_number() over (order by p desc, id) as rank from s0 qualify rank <= 100), s3 as (select id, row_number() over (order by whole desc, id) as rank from s2), "
    "u as (select id, rank from s1 where id in (select id from s2) union all select id, rank from s2 union all select id, rank from s3), "
    "f as (select id, round(sum(1 / (60 + rank)), 10) as score from u group by id order by score desc, id limit 50), "
    "x as (select k.b as id, max(f.score * k.score * 0.8) as score from f join k on k.a = f.id where k.score >= 0.4 and k.b not in (select id from f) group by k.b order by score desc, id limit 150), "
    "c as (select id from f union select id from x), "
    f"m as (select v.id, round(avg((best + 1) / 2), 6) as score from (select v.id, {_BEST} as best from v join c using (id), q, (select unnest([1, 17, 33, 49]) as qs) where v.id <> 0) v group by v.id) "
    "select id, score, row_number() over (order by score desc, id)::int as rank from m qualify rank <= 10"
)
def pipeline_staged(spark, d):
    """Terms, prefixes, fused ranks, graph neighbours, late interaction; vectors are those of the documents with their number."""
    df = vectors(spark, d)
    rows, q = others(df), query_of(df)
    recalled = retrieve.overlap_recall(retrieve.term_counts(table(spark, d, "documents"), TERMS), TERMS).select("id", F.col("shared").alias("score"))
    edges = knn_edges(spark, d).select("a", "b", F.col("score").alias("weight"))
    late = dense.maxsim(dense.tokens(q, 16), dense.tokens("v", 16))
    return staged.staged_search(recalled, rows, dense.cos01(F.slice("v", 1, 16), F.slice(q, 1, 16)), dense.cos01("v", q), late, edges)


_TOKENS = "tk as (select unnest([0, 1, 2, 3]) as i), pairs as (select v.id, a.i as query_token, b.i as doc_token, list_cosine_similarity(q.v[a.i*16+1:a.i*16+16], v.v[b.i*16+1:b.i*16+16]) as s from v, q, tk a, tk b where v.id <> 0)"


@query(f"with {V}, {_TOKENS} select id, query_token, doc_token, round(s, 6) as similarity from (select *, row_number() over (partition by id, query_token order by s desc, doc_token) as n from pairs) where n = 1")
def token_alignments(spark, d):
    df = vectors(spark, d)
    each = others(df).select("id", F.inline(dense.token_alignments(dense.tokens(query_of(df), 16), dense.tokens("v", 16))))
    return each.withColumn("similarity", F.round("similarity", 6))


@query(f"with {V}, {_TOKENS}, e as (select id, query_token, coalesce(arg_min(s, doc_token) filter (s >= 0.2), max(s)) as s from pairs group by id, query_token) select id, round(avg(s), 6) + 0.0 as score from e group by id")
def maxsim_early(spark, d):
    df = vectors(spark, d)
    return others(df).select("id", (F.round(dense.maxsim_early(dense.tokens(query_of(df), 16), dense.tokens("v", 16), 0.2), 6) + 0.0).alias("score"))


_SHARES = ", ".join("least(1.0, 0.2 * (" + " + ".join(f"contains(t, '{w}')::int" for w in words) + f"))::double as {name}" for name, words in lexicon.PROFILE_WORDS.items())
_FIRST, _SECOND, _THIRD = lexicon.PROFILE_WORDS


@query(
    f"with t as (select conv_id, turn, lower(coalesce(text, '')) as t from conversations), s as (select conv_id, turn, {_SHARES} from t), g as (select *, greatest({_FIRST}, {_SECOND}, {_THIRD}) as m from s) "
    f"select conv_id, turn, case when {_FIRST} = m then '{_FIRST}' when {_SECOND} = m then '{_SECOND}' else '{_THIRD}' end as profile, round(case when m > 0 then m else 0.1 end, 6)::double as similarity from g"
)
def profile_best_match(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", text.profile_match("text").alias("m"))
    return rows.select("conv_id", "turn", "m.profile", F.round("m.similarity", 6).alias("similarity"))


_G = "[(a[1] + a[2] + a[3]) / 3, (a[4] + a[5] + a[6]) / 3, (a[7] + a[8] + a[9]) / 3, (a[10] + a[11] + a[12] + a[13]) / 4]"


@query(
    f"with {V}, t as (select id, list_transform(v[1:13], lambda x: least(1.0::double, abs(x))) as a from v), g as (select id, a, {_G} as g, len(list_filter(a, lambda x: x > 0.1)) as active from t) "
    "select id, list_transform(g, lambda x: round(x, 6)) as groups, round((0.5 * list_sum(a) / 13 + 0.5 * list_sum(g) / 4) * active / 13, 6) as confidence, active::int as active, (4 - list_position(list_reverse(g), list_max(g)))::int as dominant from g"
)
def alignment_fusion(spark, d):
    """The sizes of the first 13 components stand for alignments."""
    a = F.transform(F.slice("v", 1, 13), lambda x: F.least(F.lit(1.0), F.abs(x)))
    f = vectors(spark, d).select("id", fuse.alignment_fusion(a).alias("f"))
    return f.select("id", F.transform("f.groups", lambda x: F.round(x, 6)).alias("groups"), F.round("f.confidence", 6).alias("confidence"), "f.active", "f.dominant")


_WEIGHTS = {("E1", "E5"): 0.7, ("E1", "E10"): 0.6, ("E7", "E10"): 0.4}
_PAIRS = ", ".join(f"('{a}', '{b}', {SPACES[a][0]}, {SPACES[b][0]}, {_WEIGHTS.get((a, b), 1.0)})" for i, a in enumerate(SPACES) for b in list(SPACES)[i + 1 :])


@query(f"with {V}, pr(space_a, space_b, x, y, w) as (values {_PAIRS}), t as (select id, space_a, space_b, list_cosine_similarity(v[x:x+15], v[y:y+15]) * w as c from v, pr) select id, space_a, space_b, round(case when abs(c) < 0.01 then 0 else c end, 6)::double as value from t")
def cross_correlations(spark, d):
    each = vectors(spark, d).select("id", F.inline(fuse.cross_correlations(retrieve.slices_of("v", SPACES), _WEIGHTS)))
    return each.withColumn("value", F.round("value", 6))


_SEQ = "case when id % 3 = 0 then null else 500 - id end"


@query(f"with {V}, t as (select v.id, {_SEQ} as seq, (list_cosine_similarity(v.v, a.v) + 1) / 2 as s from v, (select v from v where id = 100) a) select id, round(case when (case when seq is null then id < 100 else seq < 400 end) then s else 0 end, 6)::double as before, round(case when (case when seq is null then id > 101 else seq > 400 end) then s else 0 end, 6)::double as after from t")
def sequence_directed(spark, d):
    """Nearness of memories before and after the hundredth: by a number in the session that runs against time, by time where it is missing."""
    df = vectors(spark, d)
    s = dense.cos01("v", retrieve.one_vector(df, "id = 100", "v"))
    seq = F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(500 - F.col("id"))
    of = lambda way: F.round(temporal.directed(s, seq, F.lit(400), F.col("id"), F.lit(100), way), 6).alias(way)
    return df.select("id", of("before"), of("after"))
