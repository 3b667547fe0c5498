"""Token alignment, quality rules and the filter audit against plain versions."""

import hashlib
import random
import re
from collections import Counter
from itertools import permutations
from math import comb

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from fathom.llm import align, audit
from fathom.llm.align import Aligner, align_tokenizers, pair_counts
from fathom.llm.audit import filter_audit
from fathom.llm.rules import CUTOFFS, cutoffs, measures, most_rejected, quality_rules

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "a", "  two  spaces ", "tab\tand\r\nlines", "<|endoftext|> x", "don't we'll 'l", "é ü 日本 😀", "▁mark", "a" * 3000, "日本語" * 200, "\x00\x01", "1234 5678", "x y 　z", "<s> </s> <unk> <0x41>", "end \n next", "x\n\ny", "nb sp"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, texts, ids=None, sources=None, langs=None):
    rows = [(ids[i] if ids else i, t, langs[i] if langs else "en", sources[i] if sources else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


# 11


def aligned_by_hand(texts):
    from tokenizers import Tokenizer

    import sentencepiece

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    plain = [x for x in range(256) if 33 <= x <= 126 or 161 <= x <= 172 or 174 <= x <= 255]
    back = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)}
    rows = []
    for t in texts:
        whole = (" " + (t or "")).encode()
        x, y = ([], []) if not t else (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t))
        bx = [bytes(back[c] for c in a.id_to_token(i)) for i in x]
        by = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in y)]
        if not t or b"".join(bx) != whole or b"".join(by) != whole:
            rows.append(([], [], [], []))
            continue
        spans = []
        for parts in (bx, by):
            at, own = 0, []
            for p in parts:
                own.append((at, at + len(p)))
                at += len(p)
            spans.append(own)
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups = [([i for i, (_, e) in zip(x, spans[0]) if lo < e <= hi], [i for i, (_, e) in zip(y, spans[1]) if lo < e <= hi]) for lo, hi in zip([0, *cuts], cuts)]
        links = [(i, j) for i, (s, e) in zip(x, spans[0]) for j, (u, v) in zip(y, spans[1]) if s < v and u < e]
        rows.append((x, y, groups, links))
    n = Counter(p for *_, links in rows for p in set(links))
    most = {}
    for (i, _), c in n.items():
        most[i] = max(most.get(i, 0), c)
    out = []
    for x, y, groups, links in rows:
        text = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in groups)
        out.append((len(x), len(y), len(groups), len(links), sum(n[p] == most[p[0]] for p in links), sum(n[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out, n


@pytest.mark.parametrize("frequent", [10**6, 40])
def test_alignment_equals_plain_version(spark, frequent):
    """With all pairs broadcast, and with most of them joined by shuffle."""
    rng = random.Random(4)
    texts = ODD + [" ".join(rng.choice(["Haus", "the", "unge", "naïve", "x1", "well-known", "ß", "don't", "foo\nbar", "a\tb"]) for _ in range(rng.randrange(1, 60))) for _ in range(60)] + ["the the"] * 5
    docs = docs_of(spark, texts).withColumn("pairs", F.lit(1)).withColumn("n_a", F.lit("x")).repartition(3)
    out, pairs = align_tokenizers(docs, A, B, keep=["doc_id", "n_a", "pairs"], frequent=frequent)
    want, n = aligned_by_hand(texts)
    got = {r.doc_id: (r["_n_a"], r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in out.collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert {(r.a, r.b): r.n for r in pairs.collect()} == dict(n)
    assert align_tokenizers(docs.limit(0), A, B)[0].count() == 0


def test_chunks_that_a_worker_keeps_are_bounded(monkeypatch):
    own = Aligner(A, B)
    long = [f"日本語{i}" * 90 for i in range(50)]
    assert sum(x is not None for x in own.texts(long)) == 50 and not own.index and not own.links
    monkeypatch.setattr(align, "TABLE_ENTRIES", 30)
    texts = [" ".join(f"w{i}" for i in range(k, k + 20)) for k in range(0, 200, 20)]
    for t in texts:
        first = list(own.texts([t]))[0]
        assert len(own.index) <= 30
        assert first[4] == list(Aligner(A, B).texts([t]))[0][4]


def test_pair_counts_hand_on_when_full(spark, monkeypatch):
    rows = spark.createDataFrame([([i % 7, 100 + i],) for i in range(500)], "p array<long>")
    monkeypatch.setattr(align, "HELD_PAIRS", 8)
    got = {r.pair: r.n for r in pair_counts(rows, "p").collect()}
    assert got == {i: len(range(i, 500, 7)) for i in range(7)} | {100 + i: 1 for i in range(500)}


# 12


def measured_by_hand(t):
    t = t or ""
    ws = WORD.findall(t)
    windows = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    n = Counter(windows)
    hit = {i + j for i, w in enumerate(windows) if n[w] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), len(lines), len(lines) - len(set(lines)), len(hit)


def test_measures_equal_plain_version(spark):
    rng = random.Random(2)
    texts = ODD + [" ".join(rng.choice("abcdef") for _ in range(rng.randrange(0, 80))) for _ in range(60)] + ["\n".join(rng.choice(["a b", "", " ", "c", "a b "]) for _ in range(12)) for _ in range(20)]
    texts += ["a a a", "a a a a", "a b c a b c", "a b c d e a b c", "x\x0by\x0cz", "x " * 30_000, " ".join(f"w{i % 9999}" for i in range(40_000))]
    got = docs_of(spark, texts).select("doc_id", measures(F.col("text")).alias("m")).collect()
    for r in got:
        assert tuple(r.m) == measured_by_hand(texts[r.doc_id]), texts[r.doc_id]


def test_binomial_bound_is_exact(spark):
    rows = spark.createDataFrame([(n,) for n in (0, 1, 10, 300, 2000)], "n long").select("n", most_rejected(F.col("n"), 0.0125, F.lit(0.01)).alias("k")).collect()
    for r in rows:
        below, k = 0.0, -1
        for i in range(r.n + 1):
            below += comb(r.n, i) * 0.0125**i * 0.9875 ** (r.n - i)
            if below > 0.01:
                break
            k = i
        assert r.k == k
    assert {r.n: r.k for r in rows}[2000] > 5 > -1 == {r.n: r.k for r in rows}[10]


def test_cutoffs_are_certain_and_take_the_best(spark):
    """Good rows above a cutoff are few enough, bad ones are caught, and a stratum of few rows has no cutoffs."""
    rng = np.random.default_rng(0)
    rows = [("en", 1, float(v), 0.0, 0.0, 5.0) for v in rng.exponential(0.4, 3000)] + [("en", 0, float(v), 0.0, 0.0, 5.0) for v in rng.uniform(4, 90, 300)] + [("xx", 1, 0.0, 0.0, 0.0, 5.0)] * 50 + [("xx", 0, 99.0, 0.0, 0.0, 5.0)] * 50
    df = spark.createDataFrame(rows, "stratum string, good int, symbols double, dup_lines double, repeats double, word_length double")
    (got,) = cutoffs(df).collect()
    assert got.stratum == "en" and got.dup_lines is None and got.word_length is None
    lost = {c: sum(r[1] and r[2] > c for r in rows[:3300]) for c in CUTOFFS["symbols"]}
    caught = {c: sum(not r[1] and r[2] > c for r in rows[:3300]) for c in CUTOFFS["symbols"]}
    level = 0.1 / (len(CUTOFFS) * 2)
    k, below = -1, 0.0
    while (below := below + comb(3000, k + 1) * 0.0125 ** (k + 1) * 0.9875 ** (3000 - k - 1)) <= level:
        k += 1
    certain = [c for c in CUTOFFS["symbols"] if lost[c] <= k]
    assert got.symbols == max(certain, key=lambda c: (caught[c] - lost[c], c)) and lost[got.symbols] / 3000 < 0.0125


def test_risk_is_kept_on_fresh_rows(spark):
    """Over many draws of holdouts, the true share of good rows over the cutoff is rarely above the risk."""
    rng = np.random.default_rng(1)
    rows = []
    for s in range(60):
        rows += [(f"t{s}", 1, float(v), 0.0, 0.0, 5.0) for v in rng.exponential(1.0, 500)] + [(f"t{s}", 0, 200.0 - s, 0.0, 0.0, 5.0) for _ in range(20)] + [(f"t{s}", 0, float(v), 0.0, 0.0, 5.0) for v in rng.uniform(1, 9, 400)]
    df = spark.createDataFrame(rows, "stratum string, good int, symbols double, dup_lines double, repeats double, word_length double")
    got = cutoffs(df, risk=0.1, fail=0.1).collect()
    assert len(got) > 30 and all(np.exp(-r.symbols) <= 0.1 / len(CUTOFFS) for r in got)


def test_quality_rules_end_to_end(spark):
    rng = random.Random(3)
    good = [" ".join(f"w{rng.randrange(5000)}" for _ in range(80)) for _ in range(900)]
    bad = [" ".join(f"w{rng.randrange(5000)}$$$" for _ in range(80)) for _ in range(150)]
    texts = good + bad + [None, "", "few words", "a b c " * 40, good[0], good[0]]
    docs = docs_of(spark, texts, langs=[None if i % 2 else "en" for i in range(len(texts))]).withColumn("kept", F.lit("mine"))
    labels = spark.createDataFrame([(i, 1) for i in range(900)] + [(i, 0) for i in range(900, 1000)] + [(0, None), (None, 1)], "doc_id long, quality int")
    ruled = quality_rules(docs, labels)
    out = {r.doc_id: r for r in ruled.collect()}
    assert len(out) == len(texts) and all(r.kept == "mine" for r in out.values())
    assert all(out[i]["_kept"] for i in range(900)) and not any(out[i]["_kept"] for i in range(900, 1054)) and out[1050].base_failed and out[1053].base_failed
    assert all(out[i].failed == ["symbols"] and not out[i].base_failed for i in range(900, 1050)) and out[1054]["_kept"]
    none = {r.doc_id: r for r in quality_rules(docs, labels.limit(0)).collect()}
    assert all(none[i]["_kept"] != none[i].base_failed for i in none)
    assert quality_rules(docs.limit(0), labels).count() == 0
    plan = ruled._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# 13


def audited_by_hand(rows, labels):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    flags = {}
    for i, q, x in labels:
        g, o = flags.get(i, (0, 0))
        flags[i] = (max(g, int(q == 1)), max(o, int(x == 1)))
    own = []
    for i, t, s in rows:
        t = t or ""
        ws = WORD.findall(t)
        fails = {"A": len(ws) < 200, "B": 100 * len(set(ws)) < 50 * len(ws), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > first[t]}
        own.append((s or "", {f for f, v in fails.items() if v}, *(flags.get(i, (0, 0)) if i is not None else (0, 0))))
    out = {}
    for part in {r[0] for r in own}:
        mine = [r for r in own if r[0] == part]
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                out[part, order, k + 1] = [len(left), len(gone), sum(f in r[1] for r in mine) - len(gone), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone), f]
        for key in [k for k in out if k[0] == part]:
            out[key][6] = shapley[out[key][6]]
    return out


@pytest.mark.parametrize("hot", [10_000, 4])
def test_audit_equals_plain_version(spark, monkeypatch, hot):
    """With all copies joined by shuffle, and with a hot text that is broadcast."""
    monkeypatch.setattr(audit, "HOT_TEXTS", hot)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)] + ["X#", "ABC", "Y"]
    texts = [None, "", "", " ", "ABC", "#"] + [" ".join(rng.choice(words[: rng.choice([30, 403])]) for _ in range(rng.choice([5, 210, 300]))) for _ in range(50)]
    texts += [texts[10]] * 30 + [texts[11], texts[12]]
    ids = [rng.randrange(200) for _ in texts]
    ids[3] = ids[20] = None
    ids[40] = ids[41] = ids[10]
    sources = [None if i % 5 == 0 else f"s{i % 3}" for i in range(len(texts))]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 200, 2)] + [(ids[10], 1, 1), (None, 1, 1)]
    df = docs_of(spark, texts, ids, sources).withColumn("mask", F.lit(1)).withColumn("n", F.lit("x")).repartition(3)
    got = filter_audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = audited_by_hand(list(zip(ids, texts, sources)), labels)
    assert len(got) == len(want) == 600 * len({k[0] for k in want})
    for r in got:
        assert [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] == want[r.part, r.filter_order, r.step]
    assert filter_audit(df.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0

