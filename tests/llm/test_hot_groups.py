"""Hot keys, groups of copies and odd long texts: what is held and emitted stays bounded, and results stay whole."""

import random
import time

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from fathom.llm import exact_search, minhash, pieces, shards
from fathom.llm.exact_search import Bounds, approximation, exact_top_k, vector_classes
from fathom.llm.licenses import Scorer, inherit, lines_of
from fathom.llm.minhash import near_duplicates
from fathom.llm.shards import external_shuffle
from fathom.llm.shingles import shingle_set

SP = public_tokenizers.path("piece_bpe_32k.model")


# 1


def plain_search(rows, queries, k):
    out = []
    for q, x in queries:
        scored = sorted(((-sum(a * b for a, b in zip(x, y)), i) for i, y in rows if i != q and len(y) == len(x)))
        out.append((q, [(i, -s) for s, i in scored[:k]]))
    return sorted(out)


def test_exact_search_with_copies_equals_brute_force(spark):
    """Equal vectors, ids with several vectors, repeated rows, queries that are no rows."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 6)).astype(np.float32)
    x[rng.permutation(120)[:50]] = x[0]
    x[60:70] = x[61]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [rows[3], rows[3], rows[0], (7, rows[0][1]), (7, rows[9][1]), (200, rows[61][1]), (201, [1.0, 2.0])]
    queries = rows[::7] + [rows[0], rows[3], (7, rows[0][1]), (500, rows[0][1]), (3, rows[9][1]), (61, rows[0][1])]
    ints = lambda rs: [(i, [int(np.floor(256 * float(v))) for v in y]) for i, y in rs]
    schema = "vec_id long, embedding array<float>"
    found = exact_top_k(spark.createDataFrame(rows, schema).repartition(3), spark.createDataFrame(queries, schema), 5, block=16).collect()
    got = {}
    for r in found:
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = {}
    for q, own in plain_search(ints(rows), ints(queries), 5):
        want.setdefault(q, []).extend((k + 1, i, s) for k, (i, s) in enumerate(own))
    assert {q: sorted(v) for q, v in got.items()} == {q: sorted(v) for q, v in want.items() if v}


def test_a_vector_on_a_third_of_rows_emits_few_bounds(spark, monkeypatch):
    emitted = []
    real = exact_search.meet
    monkeypatch.setattr(exact_search, "meet", lambda *a, **b: emitted.append(real(*a, **b)) or emitted[-1])
    counts = []
    for n in (1500, 3000):
        rng = np.random.default_rng(7)
        x = rng.normal(size=(n, 8)).astype(np.float32)
        x[rng.permutation(n)[: n // 3]] = x[1]
        df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
        assert exact_top_k(df, df.where("vec_id % 50 = 0")).count() == 5 * (n // 50)
        counts.append(emitted[-1].count() / (n // 50))
    assert max(counts) < 40, counts  # some for each block; an all-pairs output has hundreds
    classes, ids, _ = vector_classes(exact_search.integers(df), 5)
    assert classes.count() == 2001 and ids.groupBy("c1", "c2").count().agg(F.max("count")).first()[0] == 6


def test_bounds_are_pruned_as_floors_rise(monkeypatch):
    monkeypatch.setattr(exact_search, "HELD", 500)
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(size=(20_000, 4)) * 256)
    own = Bounds(5, np.arange(3), np.arange(3), x[:3])
    most = 0
    for at in range(0, 20_000, 1000):
        own.see(np.arange(at, at + 1000), np.arange(at, at + 1000), approximation(x[at : at + 1000]))
        most = max(most, sum(len(f) for f, *_ in own.found))
    (batch,) = own.done()
    kept = set(zip(batch.column("qkey").to_pylist(), batch.column("key").to_pylist()))
    for j in range(3):
        s = x @ x[j]
        s[j] = -np.inf
        assert all((j, int(i)) in kept for i in np.argsort(-s)[:5])
    assert most < 4000


# 3


def test_hot_row_is_dealt_by_task(spark, monkeypatch):
    """Copies of one row keep their number and are dealt in ranges of the tasks that have them, broadcast or joined."""
    rows = [(1, "hot " * 20)] * 900 + [(i, f"text {i}") for i in range(10, 310)] + [(2, "warm " * 20)] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string").orderBy(F.rand(3)).repartition(6)
    for few in (200_000, 0):
        if not few:
            monkeypatch.setattr(shards, "BROADCAST_BUCKETS", 2)
        mixed = shards._mixed(df, 17)
        own = df.withColumns({"size": F.lit(88), "mixed": mixed})
        dealt = shards._spread_copies(own, ["doc_id", "text"], "mixed", "size", 2000, 88 * 1240)
        assert dealt.count() == len(rows) and dealt.where("doc_id = 1").select("mixed").distinct().count() == 900 and dealt.where("doc_id = 2").select("mixed").distinct().count() == 40
        out = external_shuffle(df, 5, bucket_bytes=4000).collect()
        assert sorted((r.doc_id, r.text) for r in out) == sorted(rows)
        assert sorted((r.shard, r.slot) for r in out) == sorted((i % 5, i // 5) for i in range(len(rows)))


def test_shuffle_equals_two_plain_passes(spark):
    """The same scatter and the same Fisher-Yates draws over a list."""
    rows = [(i, None if i % 50 == 0 else f"text {i} " * (i % 7)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hashed = [(r.m, r.size, r.doc_id) for r in df.select(shards._mixed(df, 17).alias("m"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).alias("size"), "doc_id").collect()]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = parts * max(1, -(-sum(s for _, s, _ in hashed) * 3 // (2 * 2000 * parts)))
    place, want = 0, {}
    for b in range(buckets):
        own = sorted(x for x in hashed if x[0] % buckets == b)
        rng = np.random.default_rng([17, b])
        draws = rng.integers(0, np.arange(len(own), 1, -1)).tolist()
        for i, j in zip(range(len(own) - 1, 0, -1), draws, strict=True):
            own[i], own[j] = own[j], own[i]
        for *_, doc in own:
            want[doc] = (place % 7, place // 7)
            place += 1
    got = {r.doc_id: (r.shard, r.slot) for r in external_shuffle(df, 7, bucket_bytes=2000).collect()}
    assert got == want


# 6


def components_by_hand(texts, n=2, percent=80):
    sets = [shingle_set(t, n) for t in texts]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return [root(i) for i in range(len(texts))]


def test_families_with_outsiders_equal_brute_force(spark, monkeypatch):
    """Large families whose shingles outsiders share, hubs dealt to several tasks, joins in place of broadcasts."""
    rng = random.Random(11)
    base = [[f"w{rng.randrange(3000)}" for _ in range(60)] for _ in range(3)]
    texts = []
    for own in base:
        for _ in range(60):
            x = list(own)
            x[rng.randrange(60)] = f"v{rng.randrange(9999)}"
            texts.append(" ".join(x))
        for k in (6, 9, 12, 20):
            x = list(own)
            for i in rng.sample(range(60), k):
                x[i] = f"u{rng.randrange(9999)}"
            texts.append(" ".join(x))
    rng.shuffle(texts)
    monkeypatch.setattr(minhash, "HUB", 8)
    monkeypatch.setattr(minhash, "MANY", 20)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = components_by_hand(texts)
    for few in (200_000, 0):
        monkeypatch.setattr(minhash, "BROADCAST_IDS", few)
        assert {r.doc_id: r.component_id for r in near_duplicates(df, n=2).collect()} == dict(enumerate(want))


def test_a_family_does_not_meet_itself(spark):
    """Of a shingle's n sets with one label and m others, about n * m are met, not n * n."""
    rows = [(1, i, 100, 0, [0, 0, 0, 0], 0) for i in range(2000)] + [(1, 5000 + i, 100, 5000 + i, [0, 0, 0, 0], 0) for i in range(3)]
    df = spark.createDataFrame(rows, "token long, id long, n long, label long, sketch array<long>, place long")
    assert minhash._candidates(df, 80).count() == 3 * 2000 + 3


# 7


def test_long_chunks_leave_nothing_behind():
    own = pieces.ChunkTable(SP)
    sizes = []
    for k in range(6):
        texts = [f"{k}日本語{i}" * 300 for i in range(40)]
        assert [x.tolist() for x in own.encode(texts)] == own.model.encode(texts)
        sizes.append(own.ids.n + len(own.index))
    assert sizes == [0] * 6
    mixed = [f"one {'長い' * 400}{i} two  three {'x' * 300}" for i in range(5)]
    assert [x.tolist() for x in own.encode(mixed)] == own.model.encode(mixed)


def test_table_is_bounded_by_its_ids(monkeypatch):
    monkeypatch.setattr(pieces, "TABLE_IDS", 2000)
    own = pieces.ChunkTable(SP)
    for k in range(20):
        texts = [" ".join(f"{k}ж{i}日本語" for i in range(j, j + 20)) for j in range(0, 60, 20)]
        assert [x.tolist() for x in own.encode(texts)] == own.model.encode(texts)
        assert own.ids.n < 4000


# 8


def test_passages_of_many_lines_take_linear_time():
    scorer = Scorer.of(1000, {})
    took = []
    for n in (5_000, 40_000):
        lines = lines_of("\n".join(f"the row {i}" for i in range(n)))
        full = [(i, x, scorer.bound(x)) for i, x in enumerate(lines) if x]
        start = time.process_time()
        scorer.passage(full, 0.75)
        took.append(time.process_time() - start)
    assert took[1] < 16 * max(took[0], 0.02)


def test_inheritance_equals_brute_force(spark):
    rng = random.Random(9)
    kinds = [None, None, None, None, "MIT", "Apache-2.0", "BSD"]
    files = [("/".join(rng.choice("abc") for _ in range(rng.randrange(0, 5))) + ("/" if rng.random() < 0.9 else "") + f"f{i}", rng.choice(kinds)) for i in range(150)] + [(None, "MIT"), (None, None), ("", "MIT"), ("x//y/f", None), ("x/LICENSE", "MIT")]
    folder = lambda p: p.rsplit("/", 1)[0] if "/" in p else ""
    givers = {}
    for p, k in files:
        if p is not None and k:
            givers[folder(p)] = min(k, givers.get(folder(p), k))
    out = sorted(((r.path or "", r.file_license or "", r.inherited, r.inherited_from) for r in inherit(spark.createDataFrame(files, "path string, file_license string")).collect()), key=str)
    want = []
    for p, k in files:
        hit = (None, None)
        if p is not None:
            d = folder(p)
            parts = d.split("/")
            for depth in range(len(parts), -1, -1):
                up = "/".join(parts[:depth])
                if up in givers:
                    hit = (givers[up], up)
                    break
        want.append((p or "", k or "", *hit))
    assert out == sorted(want, key=str)


# written tables


def test_scopes_delete_what_an_operator_wrote(spark, tmp_path):
    import os

    from fathom.llm.common import scope

    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "vec_id long, embedding array<float>")
    with scope(spark) as folder:
        exact_top_k(df, df.where("vec_id < 2")).write.parquet(str(tmp_path / "out"))
        assert len(os.listdir(folder)) > 3
    assert not os.path.exists(folder) and spark.read.parquet(str(tmp_path / "out")).count() == 10
