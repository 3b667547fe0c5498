"""Similarity and candidate retrieval over the vectors, and sparse retrieval over texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions import dense, sets
from fathom.operators import retrieve
from fathom.plans.registry import QUERY_ID, SPACES, Registry, S, V
from fathom.sources.tables import table

query = Registry()
TERMS = ["the", "erth", "ndthe", "ing", "sthe"]
_TERMS = ", ".join(f"'{t}'" for t in TERMS)
POSTINGS = "p as (select id, term, count(*) as tf from (select doc_id as id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) as term from documents) where length(term) >= 1 group by id, term), n as (select count(*) as n from documents)"


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), dense.vec("embedding").alias("v"), "label")


def query_of(df: DataFrame):
    return retrieve.one_vector(df, F.col("id") == QUERY_ID, "v")


def others(df: DataFrame) -> DataFrame:
    return df.where(F.col("id") != QUERY_ID)


def space_rankings(spark: SparkSession, d: str, k: int = 50) -> DataFrame:
    df = vectors(spark, d)
    q, own = retrieve.slices_of(query_of(df), SPACES), retrieve.slices_of("v", SPACES)
    return retrieve.rankings(others(df), {s: dense.cos01(own[s], q[s]) for s in SPACES}, k, "id")


def all_scores(spark: SparkSession, d: str) -> DataFrame:
    """(id, one score for each space) of every vector, in one scan."""
    df = vectors(spark, d)
    q, own = retrieve.slices_of(query_of(df), SPACES), retrieve.slices_of("v", SPACES)
    return others(df).select("id", "label", *[F.round(dense.cos01(own[s], q[s]), 6).alias(s) for s in SPACES])


def long_scores(spark: SparkSession, d: str) -> DataFrame:
    return all_scores(spark, d).select("id", F.inline(F.array(*[F.struct(F.lit(s).alias("space"), F.col(s).alias("score")) for s in SPACES])))


def _top(expression: str, order: str = "desc", k: int = 10) -> str:
    return f"with {V}, t as (select v.id, round({expression}, 6) as score from v, q where v.id <> {QUERY_ID}) select id, score, row_number() over (order by score {order}, id)::int as rank from t order by score {order}, id limit {k}"


@query(_top("(list_cosine_similarity(v.v, q.v) + 1) / 2"))
def knn_cosine(spark, d):
    df = vectors(spark, d)
    return retrieve.knn(others(df), dense.cos01("v", query_of(df)), 10, "id")


@query(_top("list_inner_product(v.v, q.v)"))
def knn_dot(spark, d):
    df = vectors(spark, d)
    return retrieve.knn(others(df), dense.dot("v", query_of(df)), 10, "id")


@query(_top("exp(-list_distance(v.v, q.v))"))
def knn_euclidean(spark, d):
    df = vectors(spark, d)
    return retrieve.knn(others(df), dense.similarity_of(dense.distance("v", query_of(df), "euclidean"), "euclidean"), 10, "id")


@query(_top("(list_cosine_similarity(v.v[1:16], q.v[1:16]) + 1) / 2"))
def knn_prefix_slice(spark, d):
    df = vectors(spark, d)
    return retrieve.knn(others(df), dense.cos01(F.slice("v", 1, 16), F.slice(query_of(df), 1, 16)), 10, "id")


@query(f"with {V}, t as (select a.id as query_id, b.id, round((list_cosine_similarity(a.v, b.v) + 1) / 2, 6) as score from v a join v b on a.id <> b.id where a.id % 100 = 0) select * from (select query_id, id, score, row_number() over (partition by query_id order by score desc, id)::int as rank from t) where rank <= 5")
def knn_batch(spark, d):
    """Every hundredth vector against all others, in blocks."""
    df = vectors(spark, d)
    found = retrieve.nearest_of(df.where("id % 100 = 0"), df, "id", "v", retrieve.matrix_cos01, 5)
    return found.select(F.col("a").alias("query_id"), F.col("b").alias("id"), "score", "rank")


@query(f"with {V} select a.id as a, b.id as b, round((list_cosine_similarity(a.v, b.v) + 1) / 2, 6) as score from v a join v b on a.id < b.id where (list_cosine_similarity(a.v, b.v) + 1) / 2 >= 0.7")
def pairwise_similarity(spark, d):
    pairs = retrieve.theta_pairs(vectors(spark, d), "id", "v", retrieve.matrix_cos01, lambda s: s >= 0.7)
    return pairs.select("a", "b", F.round("score", 6).alias("score"))


_TOK = "[x[1:16], x[17:32], x[33:48], x[49:64]]"


@query(
    f"with {V}, t as (select v.id, unnest([1, 17, 33, 49]) as qs from v where id <> {QUERY_ID}), m as (select t.id, t.qs, greatest(list_cosine_similarity(q.v[qs:qs+15], v.v[1:16]), list_cosine_similarity(q.v[qs:qs+15], v.v[17:32]), list_cosine_similarity(q.v[qs:qs+15], v.v[33:48]), list_cosine_similarity(q.v[qs:qs+15], v.v[49:64])) as best from t join v on v.id = t.id, q) "
    "select id, round(avg((best + 1) / 2), 6) as score, row_number() over (order by round(avg((best + 1) / 2), 6) desc, id)::int as rank from m group by id order by score desc, id limit 10"
)
def maxsim_rerank(spark, d):
    df = vectors(spark, d)
    return retrieve.knn(others(df), dense.maxsim(dense.tokens(query_of(df), 16), dense.tokens("v", 16)), 10, "id")


@query(_top("1 - list_sum(list_transform(list_zip(v.v, q.v), lambda p: ((p[1] >= 0) <> (p[2] >= 0))::int)) / 64.0"))
def hamming_binary(spark, d):
    df = vectors(spark, d)
    return retrieve.knn(others(df), dense.hamming_similarity(dense.signs("v"), dense.signs(query_of(df))), 10, "id")


@query(f"with {V}, h as (select v from v where id = 1), t as (select v.id, round(-sqrt(list_sum(list_transform(list_zip(h.v, q.v, v.v), lambda p: (p[1] + p[2] - p[3]) ** 2))), 6) as score from v, q, h where v.id > 1) select id, score, row_number() over (order by score desc, id)::int as rank from t order by score desc, id limit 10")
def transe_score(spark, d):
    df = vectors(spark, d)
    head = retrieve.one_vector(df, "id = 1", "v")
    return retrieve.knn(df.where("id > 1"), dense.transe_score(head, query_of(df), "v"), 10, "id")


@query("with w as (select doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: length(x) >= 1)) as w from documents), q as (select w from w where doc_id = 0), t as (select doc_id as id, len(list_intersect(w.w, q.w)) as i, len(list_distinct(list_concat(w.w, q.w))) as u from w, q where doc_id <> 0) select id, round(case when u > 0 then i / u else 0 end, 6) as score, row_number() over (order by round(case when u > 0 then i / u else 0 end, 6) desc, id)::int as rank from t order by score desc, id limit 10")
def jaccard_terms(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.array_distinct(sets.words("text")).alias("w"))
    own = docs.where("doc_id = 0").first()
    q = F.lit(list(own.w) if own else []).cast("array<string>")
    return retrieve.knn(docs.where("doc_id <> 0"), sets.jaccard("w", q), 10, "doc_id")


@query(f"with {POSTINGS}, qq(term, w) as (values ('the', 3.0), ('erth', 2.0), ('ing', 1.0)), t as (select p.id, sum(least(tf, coalesce(w, 0))) as lo, sum(tf) as own, count(w) as matches from p left join qq using (term) group by p.id) select id, round(lo / (own + 6 - lo), 6) as score, matches from t where matches > 0")
def weighted_jaccard(spark, d):
    found = retrieve.weighted_jaccard(retrieve.term_counts(table(spark, d, "documents"), ["the", "erth", "ing"]), {"the": 3.0, "erth": 2.0, "ing": 1.0})
    return found.select("id", F.round("score", 6).alias("score"), "matches")


@query(
    f"with {POSTINGS}, l as (select id, sum(tf) as len from p group by id), m as (select avg(len) as mean from l), df as (select term, count(*) as df from p where term in ({_TERMS}) group by term), t as (select p.id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) as s from p join df using (term) join l using (id), m, n group by p.id) select id, round(s, 6) as score, row_number() over (order by round(s, 6) desc, id)::int as rank from t order by score desc, id limit 20"
)
def bm25_search(spark, d):
    docs = table(spark, d, "documents")
    return retrieve.knn(retrieve.bm25(retrieve.term_counts(docs, TERMS), TERMS, docs.count()), F.col("score"), 20, "id")


@query(f"with {POSTINGS}, df as (select term, count(*) as df from p where term in ({_TERMS}) group by term), t as (select id, round(sum(ln((n + 1) / (df + 1)) + 1), 6) as score from p join df using (term), n group by id) select id, score, row_number() over (order by score desc, id)::int as rank from t order by score desc, id limit 20")
def sparse_idf_recall(spark, d):
    docs = table(spark, d, "documents")
    return retrieve.knn(retrieve.idf_recall(retrieve.term_counts(docs, TERMS), TERMS, docs.count()), F.col("score"), 20, "id")


@query(f"with {POSTINGS} select id, count(*) as shared from p where term in ({_TERMS}) group by id")
def term_overlap_recall(spark, d):
    return retrieve.overlap_recall(retrieve.term_counts(table(spark, d, "documents"), TERMS), TERMS)


@query(f"with {V}, l as (select label from v where id = {QUERY_ID}), t as (select v.id, round(least(1, greatest(0, (list_cosine_similarity(v.v, q.v) + 1) / 2 * (1 + 0.05 + case when v.label = l.label then 0.1 else 0 end))), 6) as score from v, q, l where v.id <> {QUERY_ID}) select id, score, row_number() over (order by score desc, id)::int as rank from t order by score desc, id limit 10")
def domain_filtered_knn(spark, d):
    df = vectors(spark, d)
    row = df.where(F.col("id") == QUERY_ID).select("label").first()
    return retrieve.knn(others(df), retrieve.domain_adjusted(dense.cos01("v", query_of(df)), F.col("label") == F.lit(row.label if row else None), 0.05), 10, "id")


@query(f"with {S} select id, space, score from s")
def all_space_scores(spark, d):
    return long_scores(spark, d)


@query(f"with {V} select id, round(sqrt(list_inner_product(v, v)), 6) as norm, len(list_filter(v, lambda x: x <> 0))::int as nonzero from v")
def memory_fingerprint(spark, d):
    return vectors(spark, d).select("id", F.round(dense.norm("v"), 6).alias("norm"), F.size(F.filter("v", lambda x: x != 0)).alias("nonzero"))


@query(f"with {V} select v.id, round(abs(c), 6) as similarity, case when c > 0.75 then 'strong' when c > 0.55 then 'moderate' else 'weak' end as band from (select v.id, (list_cosine_similarity(v.v, q.v) + 1) / 2 as c from v, q) v where id <> {QUERY_ID}")
def similarity_bands(spark, d):
    df = vectors(spark, d)
    c = dense.cos01("v", query_of(df))
    return others(df).select("id", F.round(c, 6).alias("similarity"), F.when(c > 0.75, "strong").when(c > 0.55, "moderate").otherwise("weak").alias("band"))


@query("select doc_id, lang, source from documents where lang = 'en' order by md5(doc_id::varchar), doc_id limit 50")
def unbiased_sample(spark, d):
    """A sampling operator: its limit is the feature."""
    return table(spark, d, "documents").where("lang = 'en'").orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(50).select("doc_id", "lang", "source")


@query()
def ivfpq_search(spark, d):
    """The ten nearest of every hundredth vector by residual product codes in lists, reranked exactly; eight lists are probed."""
    from fathom.operators.vector_indexes import CodedIndex

    df = vectors(spark, d)
    return CodedIndex.build(df, "id", "v").search(df.where("id % 100 = 0"), "id", "v", 10)


@query()
def hnsw_search(spark, d):
    """The ten nearest of every hundredth vector by beams through layered graphs of shards."""
    from fathom.operators.vector_indexes import LayeredIndex

    df = vectors(spark, d)
    return LayeredIndex.build(df, "id", "v").search(df.where("id % 100 = 0"), "id", "v", 10)
