"""Merging, deletion, importance, provenance, files."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fathom.operators import curate, retrieve
from fathom.plans.registry import Registry, V
from fathom.plans.retrieval import vectors
from fathom.sources.tables import table

query = Registry()
_POS = f"with {V}, t as (select label, id, generate_subscripts(v, 1)::int as pos, unnest(v) as x from v)"


def _merged(spark, d, how, weight=None):
    out = curate.merged_vectors(vectors(spark, d), "label", "v", how, weight)
    return out.select("label", (F.col("pos") + 1).alias("pos"), F.round("value", 6).alias("value"))


@query(f"{_POS} select label, pos, round(avg(x), 6) as value from t group by 1, 2")
def merge_union(spark, d):
    return _merged(spark, d, "union")


@query(f"{_POS} select label, pos, round(case when min(abs(x)) >= 0.0005 then avg(x) else 0 end, 6) as value from t group by 1, 2")
def merge_intersection(spark, d):
    out = curate.merged_vectors(vectors(spark, d), "label", "v", "intersection", floor=0.0005)
    return out.select("label", (F.col("pos") + 1).alias("pos"), F.round("value", 6).alias("value"))


@query(f"{_POS} select label, pos, round(sum((1 + id % 3) * x) / sum(1 + id % 3), 6) as value from t group by 1, 2")
def merge_weighted(spark, d):
    return _merged(spark, d, "weighted", 1 + F.col("id") % 3)


@query("with p as (select lang, doc_id as id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) as term from documents), t as (select lang, id, term, count(*) as tf from p where length(term) >= 1 group by all), n as (select lang, count(distinct id) as n from t group by lang) select lang, term, round(sum(tf) / max(n), 6) as weight from t join n using (lang) group by lang, term")
def merge_sparse_union(spark, d):
    docs = table(spark, d, "documents")
    post = retrieve.postings(docs).join(docs.select(F.col("doc_id").alias("id"), "lang"), "id")
    return curate.merged_sparse(post, "lang").withColumn("weight", F.round("weight", 6))


@query(f"with {V} select a.id as a, b.id as b, round((list_cosine_similarity(a.v, b.v) + 1) / 2, 6) as score from v a join v b on a.id < b.id where (list_cosine_similarity(a.v, b.v) + 1) / 2 >= 0.72 order by score desc, a, b limit 50")
def consolidation_similarity(spark, d):
    """The fifty closest pairs; the cap is the tool's."""
    pairs = retrieve.theta_pairs(vectors(spark, d), "id", "v", retrieve.matrix_cos01, lambda s: s >= 0.72)
    return pairs.select("a", "b", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "a", "b").limit(50)


@query("select doc_id, lang from documents where doc_id not in (select doc_id from labels where toxic = 1)")
def soft_delete_view(spark, d):
    return curate.alive(table(spark, d, "documents"), table(spark, d, "labels").where("toxic = 1"), "doc_id").select("doc_id", "lang")


@query("select event_id, user_id from events where epoch_us(timestamp '2024-01-31') - epoch_us(ts) > 604800000000")
def gc_expired(spark, d):
    return curate.expired(table(spark, d, "events"), "ts", "2024-01-31 00:00:00").select("event_id", "user_id")


@query("select doc_id, round(least(1, greatest(0, n_chars / 5000 + case when quality = 1 then 0.2 else -0.3 end)), 6) as importance from documents join labels using (doc_id)")
def importance_boost(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return rows.select("doc_id", F.round(curate.importance(F.col("n_chars") / 5000, F.when(F.col("quality") == 1, 0.2).otherwise(-0.3)), 6).alias("importance"))


@query("select event_id, user_id, ts from events where user_id = 7 and ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-25' order by ts desc, event_id limit 50")
def audit_trail(spark, d):
    """Newest first, fifty rows: the tool's own limit."""
    rows = table(spark, d, "events").where("user_id = 7 and ts >= timestamp'2024-01-05' and ts < timestamp'2024-01-25'")
    return rows.orderBy(F.desc("ts"), "event_id").limit(50).select("event_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("with h as (select conv_id, turn, sha256(concat_ws('|', conv_id::varchar, turn::varchar, role, text)) as hash from conversations) select conv_id, turn, hash, lag(hash) over (partition by conv_id order by turn) as parent_hash from h")
def hash_chain(spark, d):
    rows = table(spark, d, "conversations")
    return curate.hash_chain(rows, "conv_id", "turn", ["conv_id", "turn", "role", "text"]).select("conv_id", "turn", "hash", "parent_hash")


@query("select conv_id, count(*) as entries, count(*) filter (turn = 3 or turn = 4) as broken from conversations group by conv_id")
def hash_chain_verify(spark, d):
    """Chains in which turn 3's text was altered afterwards: its own hash no longer fits, nor does what turn 4 points at."""
    fields = ["conv_id", "turn", "role", "text"]
    chain = curate.hash_chain(table(spark, d, "conversations"), "conv_id", "turn", fields)
    altered = chain.withColumn("hash", F.when(F.col("turn") == 3, F.sha2("text", 256)).otherwise(F.col("hash")))
    return curate.verify_chain(altered, "conv_id", "turn", fields)


@query("with f as (select source, count(*) as n from documents group by source) select count(*) as files, sum(n)::bigint as chunks, round(avg(n), 6) as mean, min(n) as least, max(n) as most from f")
def file_stats(spark, d):
    files = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return files.agg(F.count("*").alias("files"), F.sum("n").alias("chunks"), F.round(F.avg("n"), 6).alias("mean"), F.min("n").alias("least"), F.max("n").alias("most"))


@query("select source, count(*) as chunks from documents where source like 'src1%' group by source")
def list_watched_files(spark, d):
    return table(spark, d, "documents").where("source like 'src1%'").groupBy("source").agg(F.count("*").alias("chunks"))


@query("select distinct doc_id from labels where doc_id not in (select page_id from pages)")
def reconcile_anti_join(spark, d):
    return table(spark, d, "labels").select("doc_id").distinct().join(table(spark, d, "pages").select(F.col("page_id").alias("doc_id")), "doc_id", "left_anti")


@query("select user_id, max_by(event_id, ts) as event_id, max(ts) as ts from events group by user_id")
def latest_version(spark, d):
    return curate.latest(table(spark, d, "events").select("user_id", "event_id", "ts"), "user_id", "ts").select("user_id", "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("with recursive p as (select turn as id, turn - 1 as parent from conversations where conv_id = 0), l(id, depth) as (select 3::bigint, 0 union all select p.parent, l.depth + 1 from l join p on p.id = l.id where l.depth < 5) select id, depth from l")
def provenance_chain(spark, d):
    rows = table(spark, d, "conversations").where("conv_id = 0").select(F.col("turn").alias("id"), (F.col("turn") - 1).alias("parent"))
    return curate.lineage(rows, 3, 5)


@query("select text_hash, min(doc_id) as doc_id, count(*) as copies from (select doc_id, sha256(trim(lower(text), ' ')) as text_hash from documents) group by text_hash")
def content_hash_dedup(spark, d):
    from fathom.operators import text

    return table(spark, d, "documents").groupBy(text.content_hash("text").alias("text_hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("select user_id, event_id, ts, last_value(case when event_type = 'signup' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as signup from events")
def as_of_signup(spark, d):
    """Each event with its user's last signup up to then."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(w)
    return table(spark, d, "events").select("user_id", "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), last.alias("signup"))
