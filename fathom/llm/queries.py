"""The operators over their whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm.align import align_tokenizers
from fathom.llm.ann import ann_search
from fathom.llm.audit import filter_audit
from fathom.llm.common import small_batches, table, utf8_bytes, written
from fathom.llm.counts import count_tokens
from fathom.llm.exact_search import exact_top_k
from fathom.llm.licenses import corpus_weights, inherit, scan_texts
from fathom.llm.lines import MIN_SITES, remove_boilerplate
from fathom.llm.minhash import near_duplicates
from fathom.llm.packing import pack, same_words, token_lengths
from fathom.llm.pieces import encode_pieces
from fathom.llm.quality import fit, held_out, score_quality
from fathom.llm.rules import CUTOFFS, FAIL, RISK, quality_rules
from fathom.llm.shards import external_shuffle


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of every 50th vector by integer inner product. Unusable vectors take no part; an empty table has no rows."""
    vectors = table(spark, sf_dir, "embeddings")
    return exact_top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document before and after boilerplate goes, with the hash of what is left. A null text stays null, with no lines."""
    cleaned = remove_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("text_md5"))


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of equally many rows. Null texts have size 8 and the checksum of an empty text; repeated rows have a slot each."""
    dealt = external_shuffle(table(spark, sf_dir, "documents").select("doc_id", "text"), 24)
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return dealt.select("doc_id", "size", crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored. Null, empty and one-byte texts score 0; a null doc_id is not held out; repeated rows share their score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    with small_batches(spark):
        scored = written(score_quality(docs, model, keep=["doc_id"]), "scores")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every 20th vector that the index finds. Unusable and zero vectors take no part; an empty table has no rows."""
    vectors = table(spark, sf_dir, "embeddings")
    return ann_search(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its component over 2-word shingles. Texts without words are linked with nothing; rows of one doc_id are one document."""
    return near_duplicates(table(spark, sf_dir, "documents"), n=2, percent=80)


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded; null counts as empty: no ids and hashes of empty strings. Repeated rows have a row each."""
    coded = encode_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files at source/lang/doc_id (a null part is empty, a null doc_id ends the path at the language). Null and empty texts have no licence of their own."""
    docs = table(spark, sf_dir, "documents")
    files = docs.select("doc_id", "text", F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.col("doc_id").cast("string")).alias("path"))
    found = scan_texts(files, corpus_weights(files), keep=["doc_id", "path"])
    basis = F.when(F.col("file_license").isNotNull(), "file").when(F.col("notice").isNotNull(), "notice").when(F.col("inherited").isNotNull(), "inherited").otherwise("none")
    out = inherit(found)
    return out.select("doc_id", "notice", "cosine", "notice_line", "file_license", "inherited", "inherited_from", F.coalesce("file_license", "notice", "inherited").alias("license"), basis.alias("basis"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text counted; null counts as empty: 0 bytes, 0 tokens. fits_chars is the longest prefix within 512 tokens. Repeated rows have a row each."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", utf8_bytes("text").alias("n_bytes"))
    counted = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), limit=512)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"), "fits_chars")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of 2,048 tokens; texts that differ in case and white space alone are copies. Null and empty texts lie in no bin; repeated rows are copies of each other."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text", same_words().alias("cluster"))
    counted = token_lengths(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return pack(counted, F.col("n_tokens"), F.col("cluster"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text by two tokenizers. Null and empty texts, and those that a tokenizer does not give back, have zeros; repeated rows have a row each and count each."""
    docs = table(spark, sf_dir, "documents")
    out, _ = align_tokenizers(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document by base rules and its language's certain cutoffs. Null and empty texts have no words and go; repeated rows are treated alike."""
    ruled = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))
    return ruled.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed", ",").alias("failed"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders of five filters for each source; a null source is ''. Null texts are empty; repeated rows count each."""
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_exact_top_k, op2_line_dedup, op3_shards, op4_quality, op5_ann, op6_minhash, op7_pieces, op8_licenses, op9_token_counts, op10_packing, op11_alignment, op12_rules, op13_filter_audit)}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_CUTS = ", ".join(f"('{r}', {j}, {c}::double)" for r, own in CUTOFFS.items() for j, c in enumerate(own, 1))
_VALUES = {"symbols": "100.0 * n_symbols::double / nullif(n_words, 0)", "dup_lines": "100.0 * n_dup_lines::double / nullif(n_lines, 0)", "repeats": "100.0 * n_repeat_words::double / nullif(n_words, 0)", "word_length": "word_chars::double / nullif(n_words, 0)"}

ORACLE_SQL = {
    "op1_exact_top_k": """
        with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e from embeddings
                   where vec_id is not null and embedding is not null and len(embedding) > 0
                     and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
             s as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::bigint as score
                   from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0)
        select query_id, rank::integer as rank, vec_id, score
        from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5""",
    "op2_line_dedup": f"""
        with d as (select doc_id, source, text, string_split(text, chr(10)) as ls from documents),
             l as (select doc_id, source, trim(unnest(ls)) as line, generate_subscripts(ls, 1) as pos from d),
             b as (select line, count(distinct source) as sites, min(doc_id * 1000000 + pos) as first from l where line <> '' group by line having count(distinct source) >= {MIN_SITES}),
             g as (select l.doc_id, list(l.pos) as gone from l join b using (line) where l.doc_id * 1000000 + l.pos <> b.first group by l.doc_id)
        select d.doc_id, coalesce(len(d.ls), 0)::bigint as n_lines, coalesce(len(g.gone), 0)::bigint as n_removed,
               case when g.gone is null then md5(d.text)
                    else md5(array_to_string(list_transform(list_filter(range(1, len(d.ls) + 1), lambda i: not list_contains(g.gone, i)), lambda i: d.ls[i]), chr(10))) end as text_md5
        from d left join g using (doc_id)""",
    "op12_rules": rf"""
        with t as (select row_number() over () as rid, doc_id, coalesce(lang, '') as stratum, coalesce(text, '') as text, {_WORDS} as ws from documents),
             w as (select rid, unnest(ws) as w, generate_subscripts(ws, 1) as p from t),
             g as (select rid, p, w, lead(w) over o as w2, lead(w, 2) over o as w3 from w window o as (partition by rid order by p)),
             c as (select rid, p, case when w3 is null then 0 else (count(*) over (partition by rid, w, w2, w3) > 1)::int end as hit from g),
             r as (select rid, sum(cover) as n from (select rid, max(hit) over (partition by rid order by p rows 2 preceding) as cover from c) group by rid),
             m as (select t.*, len(ws)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
                          (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
                          list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls, coalesce(r.n, 0)::bigint as n_repeat_words
                   from t left join r using (rid)),
             f as (select *, len(ls)::bigint as n_lines, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m),
             v as ({" union all ".join(f"select rid, doc_id, stratum, text, base_failed, '{r}' as rule, {e} as value from f" for r, e in _VALUES.items())}),
             l as (select doc_id, min((quality = 1)::int) as good from labels where quality is not null group by doc_id),
             h as (select distinct stratum, text, good, rule, value from v join l using (doc_id) where not base_failed),
             n as (select stratum, count(*) as n from h where good = 1 and rule = 'symbols' group by stratum),
             k as (select stratum, n, (select count(*) from n) as strata, list_transform(range(0, floor(n * {RISK / len(CUTOFFS)})::bigint + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({RISK / len(CUTOFFS)}) + (n - i) * ln(1 - {RISK / len(CUTOFFS)}))) as ps from n),
             a as (select stratum, len(list_filter(range(1, len(ps) + 1), lambda i: list_sum(ps[1:i]) <= {FAIL} / ({len(CUTOFFS)} * strata))) - 1 as most from k),
             cuts(rule, j, cut) as (values {_CUTS}),
             s as (select stratum, rule, j, cut, count(*) filter (good = 1 and value > cut) as lost, count(*) filter (good = 0 and value > cut) as caught from h join cuts using (rule) group by all),
             b as (select stratum, rule, cut from (select s.*, row_number() over (partition by stratum, rule order by caught - lost desc, j) as place from s join a using (stratum) where most >= 0 and lost <= most and caught > lost) where place = 1),
             x as (select rid, string_agg(rule, ',' order by list_position({list(CUTOFFS)}, rule)) as failed from v join b using (stratum, rule) where value > cut group by rid)
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and x.failed is null as kept, coalesce(x.failed, '') as failed from f left join x using (rid)""",
    "op13_filter_audit": rf"""
        with t as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, {_WORDS} as ws from documents),
             m as (select doc_id, part, (len(ws) < 200)::int + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::int + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text))::int
                          + 8 * regexp_matches(text, '[#$%&*|]')::int + 16 * coalesce(doc_id > min(doc_id) over (partition by text), false)::int as mask from t),
             l as (select doc_id, max(coalesce((quality = 1)::int, 0)) as good, max(coalesce((toxic = 1)::int, 0)) as toxic from labels group by doc_id),
             c as (select part, mask, count(*) as n, coalesce(sum(good), 0) as good, coalesce(sum(toxic), 0) as toxic from m left join l using (doc_id) group by part, mask),
             f(x, bit) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
             o as (select [a.x, b.x, c.x, d.x, e.x] as xs, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits from f a, f b, f c, f d, f e where a.bit | b.bit | c.bit | d.bit | e.bit = 31),
             s as (select array_to_string(xs, '') as filter_order, unnest(range(1, 6)) as step, bits from o),
             p as (select filter_order, step, bits[step] as bit, coalesce(list_sum(bits[1:step - 1]), 0)::bigint as before from s),
             r as (select part, filter_order, step::int as step, bit, coalesce(sum(n) filter (mask & bit = 0 and mask & before = 0), 0)::bigint as kept, coalesce(sum(n) filter (mask & bit > 0 and mask & before = 0), 0)::bigint as removed,
                          coalesce(sum(n) filter (mask & bit > 0 and mask & before > 0), 0)::bigint as redundant, coalesce(sum(n) filter (mask = bit), 0)::bigint as unique_fails,
                          coalesce(sum(good) filter (mask & bit > 0 and mask & before = 0), 0)::bigint as good_lost, coalesce(sum(toxic) filter (mask & bit > 0 and mask & before = 0), 0)::bigint as toxic_lost
                   from c, p group by part, filter_order, step, bit)
        select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, bit))::bigint as shapley from r""",
}
