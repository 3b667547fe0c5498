"""Training-data operators against brute force, on small fixtures with the odd cases."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from fathom.llm import common, components, lines, packing, pieces, quality
from fathom.llm.ann import ann_search
from fathom.llm.counts import PrefixCounter, count_tokens
from fathom.llm.exact_search import Bounds, approximation, exact_top_k
from fathom.llm.licenses import FILE, NOTICE, corpus_weights, full_texts, inherit, lines_of, notices, scan_texts, terms
from fathom.llm.minhash import near_duplicates
from fathom.llm.pieces import encode_pieces
from fathom.llm.shards import external_shuffle, write_shards
from fathom.llm.shingles import shingle_set

DOC = "doc_id long, text string, lang string, source string, n_chars long"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BPE, SP = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n\n", "a", "  two  spaces ", "tab\tand\r\nlines", "<|endoftext|>", "x <|endoftext|> y", "don't 'l we'll", "é ü 日本 😀", "▁mark ▁▁", "a" * 3000, "\x00\x01", "1234 5678"]


def docs_of(spark, texts, sources=None):
    rows = [(i, t, "en", sources[i] if sources else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def words(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


# 1 and 5


def vectors_of(spark, n=300, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 8)).astype(np.float32)
    x[5] = x[6]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(n, None), (n + 1, [float("nan")] * 8), (n + 2, [None] * 8), (n + 3, [float("inf")] * 8), (n + 4, []), (n + 5, [1.0, 2.0]), (None, [1.0] * 8)]
    return spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>"), x


def test_exact_search_equals_brute_force(spark):
    df, x = vectors_of(spark)
    q = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    for block in (None, 37):
        got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in exact_top_k(df, df.where("vec_id % 10 = 0"), 5, block=block).collect()}
        for i in range(0, 300, 10):
            s = (q @ q[i]).astype(np.float64)
            s[i] = -np.inf
            order = np.lexsort((np.arange(300), -s))[:5]
            assert [got[i, k + 1] for k in range(5)] == [(int(j), int(s[j])) for j in order]


def test_exact_search_reads_few_vectors():
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(size=(4000, 16)) * 256)
    own = Bounds(5, np.arange(10), np.arange(10), x[:10])
    own.see(np.arange(4000), np.arange(4000), approximation(x))
    (batch,) = own.done()
    assert batch.num_rows < 0.02 * 10 * 4000
    kept = set(zip(batch.column("qkey").to_pylist(), batch.column("key").to_pylist(), strict=True))
    for j in range(10):
        s = x @ x[j]
        s[j] = -np.inf
        assert all((j, int(i)) in kept for i in np.argsort(-s)[:5])


def test_searches_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert exact_top_k(empty, empty).count() == 0 and ann_search(empty, empty).count() == 0
    two = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id) for r in exact_top_k(two, two.where("vec_id = 0")).collect()] == [(0, 1)]
    assert [(r.query_id, r.vec_id) for r in ann_search(two, two.where("vec_id = 0")).collect()] == [(0, 1)]


def test_ann_recall_and_scores(spark):
    """Over many blocks and the production shortlist's share of a larger table."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    rows = ann_search(df, df.where("vec_id % 100 = 0"), 10, shortlist=60, block=200).collect()
    d, hit = x.astype(np.float64), 0
    for i in range(0, 3000, 100):
        own = sorted((r["rank"], r.vec_id, r.score) for r in rows if r.query_id == i)
        s = d @ d[i]
        assert all(abs(s[j] - v) < 1e-9 for _, j, v in own) and [v for *_, v in own] == sorted((v for *_, v in own), reverse=True)
        s[i] = -np.inf
        hit += len({j for _, j, _ in own} & set(np.argsort(-s)[:10].tolist()))
    assert hit / 300 >= 0.9


def test_ann_ties_go_to_smaller_ids(spark):
    """A third of the vectors are equal, many more than the shortlist holds."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[rng.permutation(3000)[:1000]] = x[0]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>").orderBy(F.xxhash64("vec_id")).coalesce(1)
    rows = ann_search(df, df.where("vec_id % 50 = 0"), 10, shortlist=100).collect()
    d, hit = x.astype(np.float64), 0
    for i in range(0, 3000, 50):
        s = np.round(d @ d[i], 9)
        s[i] = -np.inf
        hit += len({r.vec_id for r in rows if r.query_id == i} & set(np.lexsort((np.arange(3000), -s))[:10].tolist()))
    assert hit / 600 >= 0.9


# 2


def lines_by_hand(texts, sources, least):
    sites, first = {}, {}
    for i, t in enumerate(texts):
        for k, line in enumerate((t or "").split("\n")):
            if line.strip(" "):
                sites.setdefault(line.strip(" "), set()).add(sources[i])
                first.setdefault(line.strip(" "), (i, k))
    out = []
    for i, t in enumerate(texts):
        if t is None:
            out.append(None)
            continue
        keep = [x for k, x in enumerate(t.split("\n")) if not x.strip(" ") or len(sites[x.strip(" ")] - {None}) < least or first[x.strip(" ")] == (i, k)]
        out.append("\n".join(keep))
    return out


def test_lines_equal_brute_force(spark):
    rng = random.Random(4)
    common_lines = [f"common {k}" for k in range(12)]
    texts = [None, "", "\n\n", "only common 0"] + ["\n".join(rng.choice(common_lines) if rng.random() < 0.5 else words(rng, 3) for _ in range(rng.randrange(1, 8))) for _ in range(200)]
    sources = [None if rng.random() < 0.1 else f"s{rng.randrange(14)}" for _ in texts]
    for least in (3, 10, 13):
        got = {r.doc_id: r.text for r in lines.remove_boilerplate(docs_of(spark, texts, sources), least).collect()}
        assert [got[i] for i in range(len(texts))] == lines_by_hand(texts, sources, least)


def test_lines_of_many_sites_near_the_threshold(spark):
    """Sketches err here; exact counts decide."""
    rows = [(i, f"edge {k}", f"site{i}") for k, n in enumerate((95, 99, 100, 101, 105, 140)) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = lines.boilerplate(lines.spread_lines(docs), 100).count()
    assert found == 4


def test_lines_plan_has_no_python(spark):
    plan = lines.remove_boilerplate(docs_of(spark, ["a\nb", "c"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_lines_names_and_repeats(spark):
    docs = spark.createDataFrame([(1, "x\ny", "a", 7), (1, "x\ny", "a", 7), (None, "x", "b", 7)], "doc_id long, text string, source string, n_lines int")
    out = lines.remove_boilerplate(docs, 2)
    assert out.columns == ["doc_id", "text", "source", "n_lines", "_n_lines", "n_removed"]
    assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == [(0, "x"), (1, "y"), (1, "y")]


# 3


@pytest.mark.parametrize("n", [0, 1, 23, 500])
def test_shards_are_even_and_gapless(spark, n):
    rng = random.Random(n)
    texts = [ODD[i] if i < len(ODD) else ("same text" if i % 3 else words(rng, 20)) for i in range(n)]
    docs = docs_of(spark, texts).withColumn("size", F.lit("clash"))
    rows = external_shuffle(docs, 7, bucket_bytes=2000).collect()
    assert sorted(r.doc_id for r in rows) == list(range(n))
    counts = Counter(r.shard for r in rows)
    assert not n or max(counts.values()) - min(counts.get(k, 0) for k in range(7)) <= 1
    for k in counts:
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(counts[k]))
    assert all(r._size == len((texts[r.doc_id] or "").encode()) + 8 for r in rows)


def test_shards_of_one_row_many_times(spark):
    """100,000 copies of a row are dealt to many buckets, none over its size by much."""
    docs = spark.range(100_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("the same text").alias("text")).unionByName(docs_of(spark, ["a", None]).select("doc_id", "text"))
    out = external_shuffle(docs, 7, bucket_bytes=1 << 16)
    counts = {r.shard: (r.n, r.lo, r.hi, r.d) for r in out.groupBy("shard").agg(F.count("*").alias("n"), F.min("slot").alias("lo"), F.max("slot").alias("hi"), F.count_distinct("slot").alias("d")).collect()}
    assert sum(n for n, *_ in counts.values()) == 100_002 and all(lo == 0 and hi == n - 1 and d == n for n, lo, hi, d in counts.values())
    assert max(n for n, *_ in counts.values()) - min(n for n, *_ in counts.values()) <= 1
    parts = out.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert max(r["count"] for r in parts) < 40_000


def test_shards_take_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "x", 5, {"a": 1}), (1, "x", 5, {"a": 1}), (None, None, None, None)], "doc_id long, text string, bucket__ int, slot map<string,int>")
    out = external_shuffle(docs, 2)
    assert out.columns == ["doc_id", "text", "bucket__", "slot", "size", "shard", "_slot"] and sorted((r.shard, r._slot) for r in out.collect()) == [(0, 0), (0, 1), (1, 0)]


def test_shards_repeat_and_differ_by_seed(spark, tmp_path):
    docs = docs_of(spark, [f"t{i}" for i in range(300)])
    place = lambda df, seed: {r.doc_id: (r.shard, r.slot) for r in external_shuffle(df, 5, seed=seed, bucket_bytes=500).collect()}
    assert place(docs, 1) == place(docs.repartition(9), 1) != place(docs, 2)
    write_shards(external_shuffle(docs, 5), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 300


# 4


def test_quality_learns_and_holds_out(spark):
    rng = random.Random(6)
    texts = [words(rng, 40) if i % 3 else " ".join(w.upper() + "!!" for w in words(rng, 40).split()) for i in range(600)] + ["", None, "x"]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), None if i % 7 else 0) for i in range(600)] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    held = {i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert len(model.labels) == 600 - len(held)
    got = {r.doc_id: r.score for r in quality.score_quality(docs, model).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and got[600] == got[601] == got[602] == 0
    assert sum((got[i] >= 0.5) == (i % 3 > 0) for i in held) / len(held) > 0.97


def test_quality_without_labels_or_rows(spark):
    docs = docs_of(spark, ["some text", ""])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score_quality(docs, quality.fit(docs, none)).collect()} == {0.5, 0.0}
    assert quality.score_quality(docs.limit(0), quality.fit(docs.limit(0), none)).count() == 0


def test_quality_vote_equals_brute_force():
    rng = np.random.default_rng(7)
    v, x = quality.unit(rng.normal(size=(50, 6))), quality.unit(rng.normal(size=(9, 6)))
    y = rng.integers(0, 2, 50).astype(float)
    v[7] = v[3]  # both vote where the fifth place is theirs
    got = quality.vote(x, quality.Model(None, None, v, y), 5)
    for i in range(9):
        c = v @ x[i]
        near = np.round(c, 6) >= np.sort(np.round(c, 6))[-5]
        w = np.maximum(c[near], 0) ** 8
        assert got[i] == pytest.approx((w * y[near]).sum() / w.sum(), abs=1e-4)


def test_quality_bounds_the_sample_by_rows(spark):
    """One key with very many rows brings no more than the sample's size to the driver."""
    docs = spark.range(3000).select(F.lit(0).cast("long").alias("doc_id"), F.concat(F.lit("some words "), F.col("id").cast("string")).alias("text"))
    model = quality.fit(docs, spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int"), fit_rows=50)
    assert len(model.labels) == 50


def test_quality_terms_of_long_texts(monkeypatch):
    """Windows of a long text add up to its terms, and texts side by side don't mix."""
    rng = random.Random(21)
    texts = [words(rng, 900).encode(), b"", b"x", "日本語 テキスト ".encode() * 90, b"same same same word", b"\n\n"]
    whole = np.concatenate([quality.term_counts([t]) for t in texts])
    assert np.array_equal(quality.term_counts(texts), whole)
    monkeypatch.setattr(quality, "WINDOW", 100)
    assert np.array_equal(quality.term_counts(texts), whole)


OFF_PATH = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[2]").config(map={{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2", "spark.checkpoint.dir": {folder!r}}}).getOrCreate()
def seen(batches):
    import importlib.util
    for b in batches:
        yield b.slice(0, 0) if importlib.util.find_spec("fathom") is None else b
assert spark.range(3).mapInArrow(seen, "id long").count() == 0, "workers see the package"
from fathom.llm import licenses, minhash, quality
docs = spark.createDataFrame([(i, f"text number {{i}} with words", "a/b") for i in range(40)] + [(40, "Released under the MIT License.", "a/c")], "doc_id long, text string, path string")
labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
assert quality.score_quality(docs, quality.fit(docs, labels)).count() == 41
assert licenses.inherit(licenses.scan_texts(docs, licenses.corpus_weights(docs), keep=["doc_id", "path"])).where("notice = 'MIT'").count() == 1
assert minhash.near_duplicates(docs).count() == 41
"""


def test_workers_need_no_package(tmp_path):
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", OFF_PATH.format(root=root, folder=str(tmp_path / "shared"))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


# 6


def components_by_hand(texts, n):
    sets = [shingle_set(t, n) for t in texts]
    label = list(range(len(texts)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def near_texts(seed):
    rng = random.Random(seed)
    out = [t for t in ODD if t is None or len(t) < 2000]
    passage = words(rng, 30)
    for g in range(8):
        base = words(rng, rng.randrange(20, 120)).split()
        for _ in range(rng.choice([1, 2, 5, 30])):
            own = list(base)
            for _ in range(rng.randrange(0, 1 + len(own) // 8)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(999)}"
            out.append(" ".join(own) if rng.random() < 0.7 else " ".join(own).upper())
    out += [f"{passage} {words(rng, 15)}" for _ in range(60)]
    return out


@pytest.mark.parametrize(("seed", "n"), [(1, 2), (2, 5), (3, 2)])
def test_near_duplicates_equal_brute_force(spark, seed, n):
    texts = near_texts(seed)
    want, sizes = components_by_hand(texts, n)
    rows = {r.doc_id: r for r in near_duplicates(docs_of(spark, texts), n=n).collect()}
    assert [rows[i].component_id for i in range(len(texts))] == want
    assert [rows[i].n_shingles for i in range(len(texts))] == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows.values())


def test_near_duplicates_of_a_template(spark):
    """Texts that share seven tenths meet nowhere; those that share more are linked across components."""
    rng = random.Random(22)
    base = [f"b{i}" for i in range(165)]
    texts = [" ".join(base + [f"u{k}x{i}" for i in range(35)]) for k in range(150)]
    for k in range(0, 40, 4):  # chains: each is near the one before, and less so to the first
        own = texts[k].split()
        for step in range(3):
            own = [f"c{k}s{step}n{rng.randrange(10**6)}" if rng.random() < 0.07 else w for w in own]
            texts.append(" ".join(own))
    want, _ = components_by_hand(texts, 1)
    got = {r.doc_id: r.component_id for r in near_duplicates(docs_of(spark, texts), n=1).collect()}
    assert [got[i] for i in range(len(texts))] == want and len(set(want)) > 130


@pytest.mark.parametrize("seed", range(3))
def test_prefix_filter_alone_finds_all_pairs(spark, seed, monkeypatch):
    """Every similar pair of sets meets, also where shingles are dealt to blocks."""
    from fathom.llm import minhash

    monkeypatch.setattr(minhash, "MANY", 5)
    texts = [t for t in near_texts(seed) if t and t.split()]
    docs = docs_of(spark, texts)
    reps = minhash.signatures(docs, 2, "doc_id", "text").select("id", F.col("n_shingles").alias("n"), "sketch", "digest")
    first = reps.groupBy("digest").agg(F.min("id").alias("id")).join(reps.drop("digest"), "id")
    opened = first.select("id", F.col("id").alias("label"))
    links = {(r.a, r.b) for r in minhash._rest_links(opened, first, docs, 2, 80, "doc_id", "text").collect()}
    sets = {r.id: shingle_set(texts[r.id], 2) for r in first.collect()}
    want = {(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert {(min(p), max(p)) for p in links} == want


def test_near_duplicates_odd_rows(spark):
    rows = [(None, "a b c d", "x"), (3, "a b c d", "x"), (3, "a b c d", "x"), (2, "a b c d", "x"), (7, "p q r s", "x"), (7, "a b c d", "x"), (9, "p q r s", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_duplicates(docs, n=2).collect())
    assert got == [(0, 0, True), (2, 2, True), (3, 2, False), (3, 2, False), (7, 2, False), (7, 2, False), (9, 2, False)]
    assert near_duplicates(docs.limit(0)).count() == 0


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(None, 5), (200, 200)]
    got = {r.id: r.label for r in components.connected_components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100)}


# 7 and 9


def random_texts(seed, n=400):
    rng = random.Random(seed)
    return ["".join(rng.choice(list(" \n\t'selvdrm<|>aé1,.▁") + ["<|endoftext|>", "word", " the"]) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_pieces_equal_the_library(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=SP)
    texts = ODD + random_texts(8)
    docs = docs_of(spark, texts).withColumn("ids", F.lit(1))
    rows = {r.doc_id: r for r in encode_pieces(docs, SP).collect()}
    for i, t in enumerate(texts):
        ids = model.encode(t or "")
        assert rows[i]._ids == ids and rows[i].decoded == model.decode(ids)


def test_piece_table_empties_itself(monkeypatch):
    monkeypatch.setattr(pieces, "TABLE_ENTRIES", 5)
    table = pieces.ChunkTable(SP)
    assert table.separable
    for t in ("one two three", "four five six seven", "one eight"):
        assert table.encode([t])[0].tolist() == table.model.encode(t)


def test_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(BPE)
    texts = ODD + random_texts(9)
    rows = {r.doc_id: r for r in count_tokens(docs_of(spark, texts), BPE, limit=8).collect()}
    for i, t in enumerate(texts):
        assert rows[i].n_tokens == len(model.encode(t or "", add_special_tokens=False).ids)
        assert 0 <= rows[i].fits_chars <= len(t or "") and (rows[i].n_tokens > 8 or rows[i].fits_chars == len(t or ""))


def test_prefix_counts_equal_the_library():
    from tokenizers import Tokenizer

    model, counter = Tokenizer.from_file(BPE), PrefixCounter(BPE)
    for t in [x for x in ODD if x and len(x) < 100] + random_texts(10, 150):
        assert list(counter.prefix_counts(t)) == [len(model.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)]


def test_fits_chars_is_the_longest_prefix(spark):
    """Also where spaces are irregular or absent, and the limit falls inside a unit or a special string."""
    counter = PrefixCounter(BPE)
    odd = ["word " * 50 + " " + "word " * 50, " lead " + "word " * 60, "word " * 40 + "\n" + "word " * 40, "    x = 1\n" * 40, "日本語の文章です" * 40, "a" * 300]
    texts = [t for t in ODD if t and len(t) < 100] + odd + random_texts(14, 200)
    for limit in (0, 1, 2, 5, 8, 40):
        want = [int(np.flatnonzero(counter.prefix_counts(t) <= limit)[-1]) for t in texts]
        got = {r.doc_id: r.fits_chars for r in count_tokens(docs_of(spark, texts), BPE, limit=limit).collect()}
        assert [got[i] for i in range(len(texts))] == want


# 8


def test_licenses(spark):
    rng = random.Random(11)
    files = [
        ("a/LICENSE", "Released under the MIT License."), ("a/b/c/x.py", words(rng, 50)), ("a/b/COPYING", "Licensed under the Apache License, Version 2.0."), ("z/y.py", words(rng, 50)),
        ("z/n.py", words(rng, 50) + "\nThis work is licensed under the GNU General Public License, version 3.\n" + words(rng, 50)), ("top.py", None), (None, ""), ("a/bc/x.py", "code"),
    ]
    rows = [(i, p, t) for i, (p, t) in enumerate(files)] + [(100 + i, f"w/{i}.txt", words(rng, 60) + " the of version") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {r.doc_id: r for r in inherit(scan_texts(docs, corpus_weights(docs), keep=["doc_id", "path"])).collect()}
    assert [got[i].file_license for i in (0, 2)] == ["MIT", "Apache-2.0"] and got[4].notice == "GPL-3.0" and got[4].notice_line == 1 and got[4].file_license is None
    assert [got[i].inherited for i in (1, 3, 5, 6, 7)] == ["Apache-2.0", None, None, None, "MIT"] and got[1].inherited_from == "a/b"
    assert all(got[100 + i].notice is None for i in range(200))
    assert inherit(scan_texts(docs.limit(0), corpus_weights(docs.limit(0)), keep=["doc_id", "path"])).count() == 0


def test_license_lines_count_in_a_large_table(spark):
    """A notice that stands in 1 % of 100,000 documents is found, as in a small table."""
    texts = F.concat(F.lit("w"), F.col("id").cast("string"), F.when(F.col("id") % 100 == 0, "\nReleased under the MIT License.").otherwise(""))
    docs = spark.range(100_000).select(F.col("id").alias("doc_id"), texts.alias("text"))
    got = scan_texts(docs, corpus_weights(docs), keep=["doc_id"]).groupBy("notice", "notice_line", (F.col("doc_id") % 100 == 0).alias("has")).count().collect()
    assert sorted((r.has, r.notice, r.notice_line, r["count"]) for r in got) == [(False, None, None, 99_000), (True, "MIT", 1, 1000)]


def test_wrapped_license_headers(spark):
    """A notice over several comment lines above code counts as one passage."""
    import textwrap

    from fathom.llm.licenses import TEMPLATES

    rng = random.Random(15)
    long = [(k, t) for k in ("MIT", "Apache-2.0", "GPL-3.0", "BSD-3-Clause", "MPL-2.0") for t in TEMPLATES[k] if len(t) > 100]
    texts = ["\n".join([f"// {words(rng, 4)}", "//", *[f"// {x}" for x in textwrap.wrap(t, 40, break_long_words=False, break_on_hyphens=False)], "", *[words(rng, 8) for _ in range(40)]]) for _, t in long]
    docs = docs_of(spark, texts + [words(rng, 30) + " the of and\nin to this" for _ in range(300)])
    got = {r.doc_id: r for r in scan_texts(docs, corpus_weights(docs), keep=["doc_id"]).collect()}
    assert [(got[i].notice, got[i].notice_line, got[i].cosine) for i in range(len(long))] == [(k, 2, 1.0) for k, _ in long]
    assert all(r.notice is None for i, r in got.items() if i >= len(long))


def best_by_hand(text, n, df, templates, run_of=None):
    """Greatest cosine over all lines and runs of lines (or of the whole text if run_of is None) to the templates."""
    vocabulary = {t for _, x in templates for t in terms(x)}
    weight = lambda t: (np.log((1 + n) / (1 + df.get(t, 0))) if t in vocabulary else np.log(1 + n)) + 1
    lines = lines_of(text)
    if run_of is None:
        passages = [(0, [t for line in lines for t in line])]
    else:
        passages = [(i, [t for line in lines[i : j + 1] for t in line]) for i in range(len(lines)) for j in range(i, len(lines)) if i == j or sum(map(len, lines[i : j + 1])) <= run_of]
    out = (0.0, None)
    for _, own in passages:
        x = {t: c * weight(t) for t, c in Counter(own).items()}
        for name, template in templates:
            y = {t: c * weight(t) for t, c in Counter(terms(template)).items()}
            both = sum(x[t] * y[t] for t in x.keys() & y.keys())
            if both:
                c = both / np.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
                if c > out[0] + 1e-9:
                    out = (c, name)
    return out


def test_license_cosines_equal_brute_force(spark):
    rng = random.Random(23)
    pool = [t for _, x in notices() for t in x.split()] + [f"w{i}" for i in range(200)]
    texts = ["\n".join(" ".join(rng.choice(pool) for _ in range(rng.randrange(0, 9))) for _ in range(rng.randrange(1, 7))) for _ in range(60)]
    texts += [f"// {words(rng, 3)}\n{x[: len(x) // 2]}\n# {x[len(x) // 2 :]}\n{words(rng, 20)}" for _, x in notices()] + [None, ""]
    texts += [x for _, x in full_texts()[:4]] + [full_texts()[0][1][:9000], full_texts()[-1][1]]
    docs = docs_of(spark, texts)
    df, n = Counter(), sum(bool(t) for t in texts)
    for t in texts:
        df.update(set(terms(t or "")))
    longest = 2 * max(len(terms(x)) for _, x in notices())
    got = {r.doc_id: r for r in scan_texts(docs, corpus_weights(docs), keep=["doc_id"]).collect()}
    for i, t in enumerate(texts):
        if len(t or "") < 2000:
            top, name = best_by_hand(t, n, df, notices(), longest)
            assert got[i].notice == (name if top >= NOTICE else None), (t, got[i], top, name)
            assert top < NOTICE or got[i].cosine == pytest.approx(top, abs=1e-8)
        top, name = best_by_hand(t, n, df, notices() + full_texts())
        assert got[i].file_license == (name if top >= FILE else None)
    assert [got[i].file_license for i in range(len(texts) - 6, len(texts))] == [*[k for k, _ in full_texts()[:4]], "Apache-2.0", "AGPL-3.0"]
    assert len({k for k, _ in notices()}) >= 20


# 10


def packed_by_hand(pieces_, capacity):
    """Best fit by a plain scan of all bins."""
    bins, out = [], []
    for length, key, piece, source, cluster in sorted(pieces_, key=lambda p: (-p[0], p[1], p[2])):
        fit = [(b["left"], k) for k, b in enumerate(bins) if b["left"] >= length and not (source is not None and source in b["s"]) and not (cluster is not None and cluster in b["c"])]
        if fit:
            k = min(fit)[1]
        else:
            bins.append({"left": capacity, "s": set(), "c": set()})
            k = len(bins) - 1
        b = bins[k]
        out.append((key, piece, k, capacity - b["left"]))
        b["left"] -= length
        b["s"].add(source), b["c"].add(cluster)
    return sorted(out)


def test_packing_equals_brute_force(spark):
    rng = random.Random(12)
    texts = [words(rng, rng.randrange(0, 120)) for _ in range(150)] + ["same words here"] * 5
    sources = [None if rng.random() < 0.2 else f"s{rng.randrange(9)}" for _ in texts]
    docs = docs_of(spark, texts, sources)
    rows = packing.pack(docs, F.regexp_count("text", F.lit(r"\S+")), F.xxhash64("text"), capacity=50, group=10_000).collect()
    cluster = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64("text").alias("h")).collect()}
    parts = [(min(50, len(t.split()) - k), i, k // 50, sources[i], cluster[i]) for i, t in enumerate(texts) for k in range(0, len(t.split()), 50)]
    assert sorted((r.doc_id, r.piece, r.bin, r.start) for r in rows if r.bin is not None) == packed_by_hand(parts, 50)
    assert {r.doc_id for r in rows if r.bin is None} == {i for i, t in enumerate(texts) if not t}


def test_packing_groups_keep_everything(spark):
    docs = docs_of(spark, [f"a b c {i}" for i in range(500)] + [None], [f"s{i % 5}" for i in range(501)])
    rows = packing.pack(docs, F.regexp_count("text", F.lit(r"\S+")), F.xxhash64("text"), capacity=20, group=50).collect()
    assert sum(r.length for r in rows) == 2000 and len({r.doc_id for r in rows}) == 501
    used = Counter()
    for r in rows:
        if r.bin is not None:
            used[r.bin] += r.length
    assert max(used.values()) <= 20
    assert packing.pack(docs.limit(0), F.regexp_count("text", F.lit(r"\S+")), F.xxhash64("text")).count() == 0


def test_token_lengths_equal_counts(spark):
    texts = [t for t in ODD + random_texts(24) if "<|endoftext|>" not in (t or "")]
    docs = docs_of(spark, texts).withColumn("n_tokens", F.lit(1))
    counter = PrefixCounter(BPE)
    got = {r.doc_id: r._n_tokens for r in packing.token_lengths(docs, RANKS).collect()}
    assert [got[i] for i in range(len(texts))] == [int(counter.table(t)[1][-1]) if t else 0 for t in texts]


def test_counts_refuse_other_vocabularies():
    with pytest.raises(ValueError, match="vocabulary"):
        PrefixCounter(public_tokenizers.path("word_bpe_49k.json"))


# queries and pipeline


def write_tables(spark, folder, texts, sources=None):
    docs_of(spark, texts, sources).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    rng = np.random.default_rng(0)
    spark.createDataFrame([(i, [float(v) for v in rng.normal(size=8)], 0) for i in range(120)], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")


def test_queries_run_on_odd_tables(spark, tmp_path):
    from fathom.llm.queries import QUERIES

    write_tables(spark, str(tmp_path), [t for t in ODD])
    for name, q in QUERIES.items():
        rows = q(spark, str(tmp_path)).collect()
        key = "query_id" if "query_id" in rows[0].asDict() else "doc_id"
        assert len(rows) >= len(ODD) if key == "doc_id" else rows, name
    want = {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in enumerate(ODD) if "▁" not in (t or "")}
    got = {r.doc_id: r.decoded_sha256 for r in QUERIES["op7_pieces"](spark, str(tmp_path)).collect()}
    assert all(got[i] == h for i, h in want.items())


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(13)
    clean = [words(rng, 60, 5000) for _ in range(60)]
    texts = clean + [clean[0]] * 2 + [clean[1] + " more"] + [" ".join(w.upper() + "!!" for w in words(rng, 40).split()) for _ in range(60)]
    texts = [t + "\nshared footer line" if i < 60 else t for i, t in enumerate(texts)]
    docs = docs_of(spark, texts, [f"s{i % 12}" for i in range(len(texts))])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 63), 0) for i in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        now = common.written(stage(spark, now, str(tmp_path)), name)
        seen.append(now)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "packing"]
    assert {r.doc_id for r in seen[0].collect()} == set(range(63))
    assert all(df.columns == docs.columns for df in seen[:3])
    assert sum("shared footer line" in r.text for r in seen[1].collect()) == 1
    assert {r.doc_id for r in seen[2].collect()} == set(range(60))
    assert {r.doc_id for r in seen[3].collect()} == set(range(60))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen[3].count()
    # each stage's rows against a plain version, on its own input
    accepted = sorted(seen[0].collect(), key=lambda r: r.doc_id)
    plain = lines_by_hand([r.text for r in accepted], [r.source for r in accepted], 10)
    cleaned = sorted(seen[1].collect(), key=lambda r: r.doc_id)
    assert [(r.doc_id, r.text, r.n_chars) for r in cleaned] == [(r.doc_id, t, len(t)) for r, t in zip(accepted, plain, strict=True) if t.strip() or r.text == t]
    labels, _ = components_by_hand([r.text for r in cleaned], 5)
    kept = sorted(seen[2].collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in kept] == [r.doc_id for i, r in enumerate(cleaned) if labels[i] == i]
    counter = PrefixCounter(BPE)
    parts = []
    for r in kept:
        n = int(counter.table(r.text)[1][-1])
        parts += [(min(2048, n - at), r.doc_id, at // 2048, r.source, r.text) for at in range(0, n, 2048)]
    packed = [(r.doc_id, r.piece, r.bin, r.start) for r in seen[3].collect()]
    assert sorted(packed) == packed_by_hand(parts, 2048)


def test_line_stage_takes_names_from_the_operator(spark):
    import corpus_pipeline

    docs = docs_of(spark, [f"own {i}\nshared" for i in range(12)] + ["alone"], [f"s{i}" for i in range(13)]).withColumn("n_removed", F.lit(9)).withColumn("n_chars", F.lit(4).cast("long"))
    got = {r.doc_id: (r.text, r.n_chars, r.n_removed) for r in corpus_pipeline.line_stage(spark, docs, "").collect()}
    assert got[0] == ("own 0\nshared", 4, 9) and got[1] == ("own 1", 5, 9) and got[12] == ("alone", 4, 9)
