"""Texts, context assembly, encoders and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fathom.functions import dense, encode, sets
from fathom.operators import context, metrics, retrieve, text
from fathom.plans.registry import AS_OF, Registry, V
from fathom.plans.retrieval import vectors
from fathom.plans.temporal import AGE
from fathom.sources.tables import table

query = Registry()
_WORDS = "w as (select doc_id as id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') as w from documents)"


@query(f"with {_WORDS}, c as (select id, w, unnest(range(0, greatest(1, ceil((len(w) - 50) / 150))::bigint)) as chunk from w where len(w) > 0) select id, chunk::int as chunk, (chunk * 150)::int as start_word, least(len(w), chunk * 150 + 200)::int as end_word, md5(array_to_string(w[chunk * 150 + 1 : chunk * 150 + 200], ' ')) as hash from c")
def chunk_words(spark, d):
    out = text.chunks(table(spark, d, "documents"))
    return out.select("id", "chunk", "start_word", "end_word", F.md5("text").alias("hash"))


@query()
def chunk_sentences(spark, d):
    out = text.sentence_chunks(table(spark, d, "documents"))
    return out.select("id", "chunk", "start_word", "end_word", F.md5("text").alias("hash"))


_NAMES = r"list_filter(regexp_split_to_array(text, '[^\p{L}]+'), lambda x: regexp_matches(x, '^[A-Z][a-z]{3,}$'))"


@query(f"with e as (select item_id, list_distinct({_NAMES}) as e from benchmark) select a.item_id as a, b.item_id as b, round(len(list_intersect(a.e, b.e)) / len(list_distinct(list_concat(a.e, b.e))), 6) as score from e a join e b on a.item_id < b.item_id where len(list_intersect(a.e, b.e)) > 0")
def entity_jaccard(spark, d):
    """Benchmark items that share a name, found through the names (an inverted index), then compared."""
    own = table(spark, d, "benchmark").select("item_id", text.capitalised("text").alias("e"))
    names = own.select("item_id", F.explode("e").alias("name"))
    met = names.select(F.col("item_id").alias("a"), "name").join(names.select(F.col("item_id").alias("b"), "name"), "name").where("a < b").select("a", "b").distinct()
    x, y = own.toDF("a", "ea"), own.toDF("b", "eb")
    return met.join(x, "a").join(y, "b").select("a", "b", F.round(sets.jaccard("ea", "eb"), 6).alias("score"))


@query("with q as (select text from benchmark where item_id = 0), g as (select item_id, list_distinct(list_transform(range(1, length(text) - 1), lambda i: substring(text, i, 3))) as g from benchmark), qg as (select g from g where item_id = 0) select item_id, round(len(list_intersect(g.g, qg.g)) / len(list_distinct(list_concat(g.g, qg.g))), 6) as score from g, qg where item_id <> 0")
def trigram_similarity(spark, d):
    own = table(spark, d, "benchmark").select("item_id", sets.trigrams("text").alias("g"))
    row = own.where("item_id = 0").first()
    return own.where("item_id <> 0").select("item_id", F.round(sets.jaccard("g", F.lit(list(row.g) if row else []).cast("array<string>")), 6).alias("score"))


@query(f"select event_id, round((case when age < 3600 then 1.3 when age < 86400 then 1.2 when age < 604800 then 1.1 when age < 2592000 then 1.0 else 0.8 end)::double * (case when value >= 5 then 1.5 when value >= 2.5 then 1.2 when value >= 1 then 1.0 else 0.8 end)::double, 6) as priority, case when value >= 2.5 then 'cluster' when value >= 1 then 'single' else 'none' end as category from (select *, {AGE} as age from events)")
def priority_rank(spark, d):
    from fathom.functions import temporal as t

    e = table(spark, d, "events")
    p = context.recency_factor(t.age("ts", AS_OF)) * context.diversity_bonus(F.col("value"))
    return e.select("event_id", F.round(p, 6).alias("priority"), context.category(F.col("value")).alias("category"))


@query("select conv_id, turn, ((len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) * 13 + 9) // 10)::bigint as tokens from conversations")
def token_estimate(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", context.token_estimate("text").alias("tokens"))


_CAPS = {"divergence": 50, "cluster": 100, "single": 75, "session": 50}
_CAT = "(['divergence', 'cluster', 'single', 'session'])[(turn % 4)::int + 1]"
_FITS = "used + tokens <= 300 and (c in ('divergence', 'cluster') or (c = 'single' and single + tokens <= 75) or (c = 'session' and session + tokens <= 50))"


@query(
    f"with recursive t as (select conv_id, turn, {_CAT} as c, ((len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) * 13 + 9) // 10)::bigint as tokens, row_number() over (partition by conv_id order by turn) as n from conversations), "
    f"b(conv_id, n, turn, tokens, used, single, session, took) as (select conv_id, 0::bigint, null::bigint, 0::bigint, 0::bigint, 0::bigint, 0::bigint, false from t group by conv_id union all select b.conv_id, t.n, t.turn, t.tokens, used + case when {_FITS.replace('tokens', 't.tokens')} then t.tokens else 0 end, single + case when c = 'single' and {_FITS.replace('tokens', 't.tokens')} then t.tokens else 0 end, session + case when c = 'session' and {_FITS.replace('tokens', 't.tokens')} then t.tokens else 0 end, {_FITS.replace('tokens', 't.tokens')} from b join t on t.conv_id = b.conv_id and t.n = b.n + 1) select conv_id, turn as id, tokens from b where took"
)
def budget_select(spark, d):
    """Turns of each conversation in order, each of a category by its number, taken while they fit 300 estimated tokens and their category's share."""
    kind = F.element_at(F.array(*map(F.lit, _CAPS)), (F.col("turn") % 4 + 1).cast("int"))
    rows = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("id"), context.token_estimate("text").alias("tokens"), kind.alias("kind"))
    return context.budget(rows, "conv_id", [F.col("id")], "tokens", total=300, category="kind")


_RANKED = f"{V}, t as (select a.id as query_id, b.id, (a.label = b.label)::int as relevant, round((list_cosine_similarity(a.v, b.v) + 1) / 2, 6) as score from v a join v b on a.id <> b.id), r as (select *, row_number() over (partition by query_id order by score desc, id) as rank from t), n as (select query_id, sum(relevant) as n_relevant from t group by query_id)"


def _evaluated(spark, d, k: int = 10):
    """Each vector as a query against all others; those of its label are relevant."""
    df = vectors(spark, d)
    found = retrieve.theta_pairs(df, "id", "v", retrieve.matrix_cos01, best=k)
    labels = df.select("id", "label")
    of = labels.groupBy("label").agg((F.count("*") - 1).alias("n_relevant"))
    n = labels.join(of, "label").select(F.col("id").alias("query_id"), "n_relevant")
    ranked = found.join(labels.toDF("a", "la"), "a").join(labels.toDF("b", "lb"), "b").select(F.col("a").alias("query_id"), "rank", (F.col("la") == F.col("lb")).cast("int").alias("relevant"))
    return metrics.at_k(ranked, n, k)


@query(f"with {_RANKED} select query_id, round(sum(relevant) / 10, 6) as precision, round(sum(relevant) / max(n_relevant), 6) as recall from r join n using (query_id) where rank <= 10 group by query_id")
def precision_recall_at_k(spark, d):
    return _evaluated(spark, d).select("query_id", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(f"with {_RANKED} select query_id, round(sum(relevant / log2(rank + 1)) / max(list_sum(list_transform(range(1, least(10, n_relevant::bigint) + 1), lambda i: 1 / log2(i + 1)))), 6) as ndcg from r join n using (query_id) where rank <= 10 group by query_id")
def ndcg_at_k(spark, d):
    return _evaluated(spark, d).select("query_id", F.round("ndcg", 6).alias("ndcg"))


@query(f"with {_RANKED}, m as (select query_id, max(case when relevant = 1 then 1 / rank else 0 end) as rr from r where rank <= 10 group by query_id) select round(avg(rr), 6) as mrr from m")
def mrr(spark, d):
    return _evaluated(spark, d).agg(F.round(F.avg("rr"), 6).alias("mrr"))


@query(f"with {_RANKED}, h as (select *, sum(relevant) over (partition by query_id order by rank) as hits from r where rank <= 10), m as (select query_id, sum(relevant * hits / rank) / least(10, max(n_relevant)) as ap from h join n using (query_id) group by query_id) select round(avg(ap), 6) as map from m")
def mean_average_precision(spark, d):
    return _evaluated(spark, d).agg(F.round(F.avg("ap"), 6).alias("map"))


_CT = "c as (select source as a, lang as b, count(*) as n from documents group by 1, 2)"


def _table(spark, d):
    return metrics.contingency(table(spark, d, "documents"), "source", "lang")


@query(f"with {_CT}, m as (select a, max(n) as m, sum(n) as n from c group by a) select round(sum(m) / sum(n), 6) as purity from m")
def purity(spark, d):
    return metrics.purity(_table(spark, d)).select(F.round("purity", 6).alias("purity"))


@query(f"with {_CT}, t as (select sum(n) as t from c), ra as (select a, sum(n) as na from c group by a), rb as (select b, sum(n) as nb from c group by b), i as (select sum(n / t * ln(n * t / (na * nb))) as i from c join ra using (a) join rb using (b), t), ha as (select sum(-na / t * ln(na / t)) as h from ra, t), hb as (select sum(-nb / t * ln(nb / t)) as h from rb, t) select round(2 * i / (ha.h + hb.h), 6) as nmi from i, ha, hb")
def nmi(spark, d):
    return metrics.mutual_information(_table(spark, d)).select(F.round("nmi", 6).alias("nmi"))


@query(f"with {_CT}, s as (select sum(n * (n - 1) / 2) as s, sum(n) as t from c), x as (select sum(na * (na - 1) / 2) as x from (select sum(n) as na from c group by a)), y as (select sum(nb * (nb - 1) / 2) as y from (select sum(n) as nb from c group by b)) select round((s - x * y / (t * (t - 1) / 2)) / ((x + y) / 2 - x * y / (t * (t - 1) / 2)), 6) as ari from s, x, y")
def adjusted_rand(spark, d):
    return metrics.rand_index(_table(spark, d)).select(F.round("ari", 6).alias("ari"))


@query(f"with {V}, t as (select v.id, list_cosine_similarity(v.v[1:16], q.v[1:16]) as x, list_cosine_similarity(v.v[33:48], q.v[33:48]) as y from v, q where v.id > 0) select round(sum(sign(a.x - b.x) * sign(a.y - b.y)) / (count(*)), 6) as tau from t a join t b on a.id < b.id")
def kendall_tau(spark, d):
    """Two spaces' orders of all candidates."""
    df = vectors(spark, d)
    q = retrieve.one_vector(df, "id = 0", "v")
    own = df.where("id > 0").select("id", dense.cosine(F.slice("v", 1, 16), F.slice(q, 1, 16)).alias("x"), dense.cosine(F.slice("v", 33, 16), F.slice(q, 33, 16)).alias("y"))
    return metrics.kendall(own, "x", "y").select(F.round("tau", 6).alias("tau"))


@query("with e as (select n_chars as s, quality as y from documents join labels using (doc_id)), r as (select y, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2 as r from e) select round((sum(r) filter (y = 1) - count(*) filter (y = 1) * (count(*) filter (y = 1) + 1) / 2) / (count(*) filter (y = 1) * count(*) filter (y = 0)), 6) as auc from r")
def auc_roc(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return metrics.auc(rows, "n_chars", "quality").select(F.round("auc", 6).alias("auc"))


_PH = ", ".join(f"round({f}(2 * pi() * (((epoch_us(ts) // 1000000) % {p}) / {p})), 6) + 0.0" for p in encode.PERIODS for f in ("sin", "cos"))


@query(f"select event_id, [{_PH}] as features from events")
def periodic_features(spark, d):
    return table(spark, d, "events").select("event_id", F.transform(encode.phase_features("ts"), lambda x: F.round(x, 6) + 0.0).alias("features"))


@query("select conv_id, turn, [" + ", ".join(f"round({f}(turn / {10000.0 ** (2 * i / 8)}), 6)" for i in range(4) for f in ("sin", "cos")) + "] as features from conversations")
def positional_features(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.transform(encode.positional("turn"), lambda x: F.round(x, 6)).alias("features"))


@query(f"with {V} select id, list_transform(v, lambda x: round(x / list_max(list_transform(v, lambda y: abs(y))) * 127)::int) as codes from v")
def int8_quantize(spark, d):
    return vectors(spark, d).select("id", encode.int8("v").alias("codes"))


@query(f"with {V} select id, list_transform(v, lambda x: (x >= 0)::int) as bits, list_sum(list_transform(v, lambda x: (x >= 0)::int))::bigint as ones from v")
def binary_quantize(spark, d):
    bits = dense.signs("v")
    return vectors(spark, d).select("id", bits.alias("bits"), F.aggregate(bits, F.lit(0), lambda a, x: a + x).cast("long").alias("ones"))


_F8 = "least(abs(x), 448)"


@query(f"with {V} select id, list_transform(v, lambda x: case when x = 0 then 0 else sign(x) * least(448, round_even({_F8} / pow(2, greatest(floor(log2({_F8})), -6) - 3), 0) * pow(2, greatest(floor(log2({_F8})), -6) - 3)) end::double) as values from v")
def float8_quantize(spark, d):
    return vectors(spark, d).select("id", encode.float8("v").alias("values"))


@query(f"with {V}, t as (select id, unnest([0, 1, 2, 3]) as i, unnest([v[1:16], v[17:32], v[33:48], v[49:64]]) as x from v), n as (select id, i, sqrt(list_inner_product(x, x)) as norm from t), r as (select *, row_number() over (partition by id order by norm desc, i) as place from n) select id, count(*)::int as n_tokens, list(round(norm, 6) order by i) as norms from r where place <= 2 group by id")
def token_pruning(spark, d):
    kept = encode.pruned_tokens(dense.tokens("v", 16))
    return vectors(spark, d).select("id", F.size(kept).alias("n_tokens"), F.transform(kept, lambda x: F.round(dense.norm(x), 6)).alias("norms"))


@query()
def hdc_encode(spark, d):
    from fathom.operators.encoders import hypervectors

    return hypervectors(table(spark, d, "documents"), "doc_id", "text")


@query()
def pq8(spark, d):
    from fathom.operators.encoders import product_codes

    return product_codes(vectors(spark, d), "id", "v", parts=8)


@query("select doc_id as id, 0 as first, length(text) as last, 0 as gaps from documents where text <> ''")
def code_chunk_extents(spark, d):
    """Chunks by nesting of every text cover it from end to end, each beginning where the one before stops."""
    from fathom.operators.code import code_chunks

    before = F.lag("stop", 1, 0).over(Window.partitionBy("id").orderBy("chunk"))
    own = code_chunks(table(spark, d, "documents"), "doc_id", "text").withColumn("gap", (F.col("start") != before).cast("long"))
    return own.groupBy("id").agg(F.min("start").alias("first"), F.max("stop").cast("long").alias("last"), F.sum("gap").alias("gaps"))


@query()
def document_chunks(spark, d):
    """Sections of every document in chunks of 2,000 characters with an overlap of 200."""
    from fathom.operators import code

    return code.document_chunks(table(spark, d, "documents"), "doc_id", "text")
