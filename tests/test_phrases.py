"""Phrases are looked for in one pass over texts, with the counts of a plain search."""

import random
import time

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fathom.functions import phrases
from fathom.functions.lexicon import CAUSE_SIGNS, EFFECT_SIGNS, NEGATIONS
from fathom.operators import text
from fathom.plans import words


def affirmed_by_hand(t, signs):
    n = 0
    for p in signs:
        at = t.find(p)
        n += at >= 0 and not any(d in t[max(0, at - 15) : at + 1] for d in NEGATIONS)
    return n


def odd_texts(n, seed=3):
    """Phrases, parts of them, negations and characters of one to four bytes, side by side."""
    rng = random.Random(seed)
    pieces = [*CAUSE_SIGNS, *EFFECT_SIGNS, *NEGATIONS, "é", "漢字", "😀😀", " ", "\n", "wh", "cause", "result", "a long way of saying"]
    return ["".join(p if rng.random() < 0.8 else p[: rng.randrange(len(p) + 1)] for p in rng.choices(pieces, k=rng.randrange(12))) for _ in range(n)] + ["", "why", "why?", "not why "]


@pytest.mark.parametrize("size", [64, phrases.SLICE])
def test_counts_equal_a_plain_search(size, monkeypatch):
    monkeypatch.setattr(phrases, "SLICE", size)
    texts = odd_texts(300 if size == 64 else 3000)
    signs = tuple(dict.fromkeys(p.encode() for p in (*CAUSE_SIGNS, *EFFECT_SIGNS)))
    at = {own: [signs.index(p.encode()) for p in own] for own in (CAUSE_SIGNS, EFFECT_SIGNS)}
    found = phrases.affirmed_counts(pa.array([*texts, None])[5:], signs, NEGATIONS, 15)
    assert len(found) == len(texts) - 4 and not found[-1].any()
    for own, places in at.items():
        assert found[:-1, places].sum(1).tolist() == [affirmed_by_hand(t, own) for t in texts[5:]]
    assert phrases.affirmed_counts(pa.array([], pa.string()), signs, NEGATIONS, 15).shape == (0, len(signs))


def test_intents_of_odd_texts(spark):
    texts = odd_texts(300, seed=4)
    rows = spark.createDataFrame(list(enumerate([*texts, None])), "id long, t string").select("id", text.intent("t").alias("i")).collect()
    own = {r.id: r.i for r in rows}
    for i, t in enumerate(texts):
        c, e = affirmed_by_hand(t.lower(), CAUSE_SIGNS), affirmed_by_hand(t.lower(), EFFECT_SIGNS)
        assert own[i] == ("cause" if c > e else "effect" if e > c else "cause" if c else "unknown")
    assert own[len(texts)] == "unknown"


def long_texts(spark):
    """About 40 MB: the phrases came to one search each before, and each of them lowered the whole text anew."""
    words = "alder birch cedar dogwood elm fir gum hazel ivy juniper".split()
    body = " ".join(random.Random(5).choices(words, k=3000))
    return spark.range(0, 2000, numPartitions=4).select("id", F.concat(F.lit("Why did it fail? "), F.lit(body), F.col("id").cast("string")).alias("t"))


def seconds(df):
    at = time.time()
    df.write.format("noop").mode("overwrite").save()
    return time.time() - at


def test_intents_of_long_texts_take_one_pass(spark):
    rows = long_texts(spark)
    assert seconds(rows.select(text.intent("t").alias("i"))) < 20
    assert rows.groupBy(text.intent("t").alias("i")).count().collect() == [("cause", 2000)]


def test_routes_of_long_texts_take_one_pass(spark):
    rows = long_texts(spark).withColumn("t", F.concat("t", F.element_at(F.array(F.lit(" a Class"), F.lit(" who"), F.lit(" subclass")), (F.col("id") % 3 + 1).cast("int"))))
    rows = rows.withColumn("t", F.when(F.col("id") % 2 == 0, F.replace("t", F.lit("Why did it fail?"), F.lit("No why "))).otherwise(F.col("t")))
    assert seconds(rows.select(text.route("t").alias("kind"))) < 30
    found = {(r.k, r.kind): r["count"] for r in rows.groupBy((F.col("id") % 6).alias("k"), text.route("t").alias("kind")).count().collect()}
    assert {k: kind for k, kind in found} == {0: "code", 1: "causal", 2: "general", 3: "code", 4: "entity", 5: "causal"}


def test_expansions_of_long_texts_take_one_pass(spark):
    rows = long_texts(spark).withColumn("t", F.when(F.col("id") % 2 == 0, F.replace("t", F.lit("Why did it fail?"), F.lit("Diagnose it."))).otherwise(F.col("t")))
    more = rows.select("id", F.expr("length(t)").alias("n"), F.length(text.expanded("t", text.intent("t"))).alias("m"))
    assert seconds(more) < 20
    assert {(r.even, r.longer) for r in more.select((F.col("id") % 2 == 0).alias("even"), (F.col("m") - F.col("n")).alias("longer")).distinct().collect()} == {(True, len(" cause reason root source")), (False, 0)}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def by_sql(name, sql, texts):
    """Intents, routes or expansions of texts by a query's SQL, as turns whose opening is empty."""
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, text varchar); create table pages (page_id bigint, html varchar)")
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [(-1 - i, t) for i, t in enumerate(texts)])
    return dict(con.execute(f"select conv_id, {name} from ({sql})").fetchall())


def edge_texts():
    """Word bounds, and capitals beyond ASCII whose small letters are of ASCII."""
    marks = ["", "é", "漢", "_", "9", "-", "\u0301", "\u200d", "Σ", "\n"]
    edges = [f"{m}{w}" for m in marks for w in ("class", "WHO", "Method", "person", "why ", "If you")]
    return [*edges, "\u212anoc\u212a-on", "lin\u212aed to", "\u0130f you", "\u0130\u0130\u0130\u0130\u0130 not \u0130\u0130\u0130 if i ", "ΑΣ why ", "a\0class", "a\0why ", *odd_texts(400, seed=6)]


def test_routes_equal_sql(spark):
    texts = edge_texts()
    sql = by_sql("kind", words.query.sql["query_route"], texts)
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    found = {r.id: r.kind for r in rows.select("id", text.route("t").alias("kind")).collect()}
    assert [(texts[i], k) for i, k in found.items() if k != sql[i]] == []
    assert set(found.values()) == {"code", "causal", "entity", "general"}


def test_routes_search_texts_once(spark):
    plan = plan_of(spark.createDataFrame([("why",)], "t string").select(text.route("t").alias("kind")))
    assert plan.count("ArrowEvalPython") == 1 and "RLIKE" not in plan and "lower(" not in plan, plan


def test_bytes_that_are_no_text(spark):
    rows = spark.range(1).select(F.expr("cast(unhex('FF2057485920FF436C617373') as string)").alias("t"))
    assert rows.select(text.route("t"), text.intent("t")).first() == ("code", "cause")
    assert rows.select(text.route(F.lit(None).cast("string")), text.intent(F.lit(None).cast("string"))).first() == ("general", "unknown")


def test_expansions_equal_sql(spark):
    texts = [*edge_texts(), "WHY what \u212anock", "if i\u0130f i ", "\u0130f i effect", "what results? RESULT", "Diagnose EFFECT", "diagnose Reas\u0130on"]
    sql = by_sql("expanded", words.query.sql["query_expansion"], texts)
    rows = spark.createDataFrame([*enumerate(texts), (len(texts), None)], "id long, t string")
    found = {r.id: (r.h, r.longer) for r in rows.select("id", F.md5(text.expanded("t")).alias("h"), (F.length(text.expanded("t", text.intent("t"))) - F.length("t")).alias("longer")).collect()}
    assert found.pop(len(texts)) == (None, None)
    assert [(texts[i], h) for i, (h, _) in found.items() if h != sql[i]] == []
    assert {longer for _, longer in found.values()} == {0, *(len(more) for _, more in text.EXPANSIONS.values())}


def test_expansions_search_texts_once(spark):
    opened = words.opened(spark, "/root/testdata/sf0.001")
    plan = plan_of(words.query.queries["query_expansion"](spark, "/root/testdata/sf0.001"))
    assert plan.count("ArrowEvalPython") == plan_of(opened).count("FileScan") and "lower(" not in plan and "lambda" not in plan, plan
