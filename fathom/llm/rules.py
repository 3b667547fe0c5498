"""Quality rules: counts of a text in DataFrame functions only, and cutoffs with a bounded risk of rejecting good documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import free_name, written

#: A word, and the white space between words as characters.
WORD, SPACE = "[^\\x20\\x09-\\x0D]+", " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Most of a stratum's good documents that all rules together may reject, and the probability with which that may fail anywhere.
RISK, FAIL = 0.05, 0.1
#: For each rule its cutoffs from lax to strict, fixed beforehand; a document with a value above the cutoff is rejected.
CUTOFFS = {
    "symbols": (100.0, 70.0, 50.0, 35.0, 25.0, 18.0, 12.0, 8.0, 5.0, 3.0, 2.0, 1.0),  # per 100 words
    "dup_lines": (90.0, 80.0, 70.0, 60.0, 50.0, 40.0, 30.0, 25.0, 20.0, 15.0, 10.0, 5.0),  # percent of lines with a word
    "repeats": (48.0, 45.0, 40.0, 35.0, 30.0, 25.0, 20.0, 15.0, 10.0, 5.0),  # percent of words; over 50 the base rule rejects
    "word_length": (40.0, 30.0, 25.0, 20.0, 18.0, 16.0, 14.0, 12.0, 11.0, 10.0),  # code points a word
}
#: Strata with cutoffs up to which they are broadcast (some 60 bytes each); more are joined by shuffle.
BROADCAST_STRATA = 100_000


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once for each row however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def repeated_words(ws: Column) -> Column:
    """Words that lie in a window of three which the text has twice or more.

    Where all windows' hashes differ, none does. Else windows are sorted with their places, equal neighbours leave theirs, and
    places add the words that the one before has not covered: n log n, whatever repeats.
    """
    at = F.when(F.size(ws) >= 3, F.sequence(F.lit(0), F.size(ws) - 3)).otherwise(F.array().cast("array<int>"))
    three = lambda i: (F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2))
    hashes = F.transform(at, lambda i: F.xxhash64(*three(i)))
    windows = F.sort_array(F.transform(at, lambda i: F.struct(F.concat_ws(" ", *three(i)).alias("w"), i.alias("p"))))
    same = lambda s, x, k: F.coalesce(F.get(s, k)["w"] == x["w"], F.lit(False))
    places = bound(windows, lambda s: F.sort_array(F.transform(F.filter(s, lambda x, k: same(s, x, k - 1) | same(s, x, k + 1)), lambda x: x["p"])))
    covered = F.aggregate(places, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")), lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    return bound(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered))


def measures(text: Column) -> Column:
    """(n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) of a text, longs; a null text counts as empty.

    n_lines are lines with a word, n_dup_lines those of them that equal an earlier one.
    """
    own = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(own, "\n", -1), lambda x: x.rlike(WORD))
    counted = bound(lines, lambda ls: F.struct(F.size(ls).cast("long").alias("n"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("dup")))
    worded = bound(words_of(own), lambda ws: F.struct(F.size(ws).cast("long").alias("n"), repeated_words(ws).alias("rep")))
    return bound(F.struct(worded.alias("w"), counted.alias("l")), lambda m: F.struct(
        m["w"]["n"].alias("n_words"), F.length(F.translate(own, SPACE, "")).cast("long").alias("word_chars"), (F.octet_length(own) - F.octet_length(F.translate(own, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        m["l"]["n"].alias("n_lines"), m["l"]["dup"].alias("n_dup_lines"), m["w"]["rep"].alias("n_repeat_words")))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def rule_values(m: Column) -> dict[str, Column]:
    """What each rule compares with its cutoff; null without words."""
    words, share = F.nullif(m["n_words"], F.lit(0)).cast("double"), lambda x, y: 100.0 * x.cast("double") / y
    return {"symbols": share(m["n_symbols"], words), "dup_lines": share(m["n_dup_lines"], F.nullif(m["n_lines"], F.lit(0)).cast("double")), "repeats": share(m["n_repeat_words"], words), "word_length": m["word_chars"].cast("double") / words}


def most_rejected(n: Column, risk: float, level: Column) -> Column:
    """The greatest k with P(X <= k) <= level for X binomial of n and risk, -1 if there is none: that many rejections of n hold the risk below `risk` by the exact test.

    Terms are carried as logarithms, each from the one before.
    """

    def add(acc: Column, i: Column) -> Column:
        ratio = F.when(i > 0, F.log((n - i + 1) / i) + F.log(F.lit(risk / (1 - risk)))).otherwise(0.0)
        return bound(acc["log"] + ratio, lambda log: bound(acc["sum"] + F.exp(log), lambda total: F.struct(log.alias("log"), total.alias("sum"), F.when(total <= level, i).otherwise(acc["k"]).alias("k"))))

    none = F.struct((n * F.log(F.lit(1 - risk))).alias("log"), F.lit(0.0).alias("sum"), F.lit(-1).cast("long").alias("k"))
    return F.aggregate(F.sequence(F.lit(0).cast("long"), F.floor(n * risk).cast("long")), none, add, lambda acc: acc["k"])


def cutoffs(holdout: DataFrame, risk: float = RISK, fail: float = FAIL) -> DataFrame:
    """(stratum, one column a rule) of strata with a cutoff, from holdout (stratum, good 0/1, one column a rule).

    For each stratum and rule cutoffs are tested from lax to strict, each against the hypothesis that it rejects more than its part
    (risk over rules) of the stratum's good documents, by the exact binomial tail at `fail` over strata times rules (Bonferroni). Testing
    stops at the first cutoff that does not hold, so those before it all hold at once (fixed sequence). Of these, the one that rejects
    most bad less good rows is taken, the laxest at ties; none if that is not above 0. Rules add up: by the union bound a stratum
    loses more than `risk` of its good documents with probability `fail` at most, over all strata together.
    """
    steps = lambda r: sum((F.when(F.col(r) > c, 1).otherwise(0) for c in CUTOFFS[r]), F.lit(0))  # noqa: E731  cutoffs that it exceeds
    rows = holdout.select("stratum", "good", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), steps(r).alias("b")) for r in CUTOFFS])).alias("x"))
    counts = written(rows.groupBy("stratum", "good", "x.rule", "x.b").agg(F.count("*").alias("n")), "holdout")
    strata = counts.where("good = 1 and rule = 'symbols'").groupBy("stratum").agg(F.sum("n").alias("n"))
    tests = len(CUTOFFS) * max(1, strata.count())
    allowed = strata.select("stratum", most_rejected(F.col("n"), risk / len(CUTOFFS), F.lit(fail / tests)).alias("most")).where("most >= 0")
    # a value over b cutoffs is over the last b, the strict ones
    steps_of = F.coalesce(*[F.when(F.col("rule") == r, len(own)) for r, own in CUTOFFS.items()])
    reached = counts.where("b > 0").select("stratum", "rule", "good", "n", F.explode(F.sequence(steps_of - F.col("b") + 1, steps_of)).alias("j"))
    sums = reached.groupBy("stratum", "rule", "j").agg(F.sum(F.when(F.col("good") == 1, F.col("n")).otherwise(0)).alias("lost"), F.sum(F.when(F.col("good") == 0, F.col("n")).otherwise(0)).alias("caught"))
    certain = sums.join(allowed, "stratum").where("lost <= most and caught > lost")
    best = certain.groupBy("stratum", "rule").agg(F.max(F.struct((F.col("caught") - F.col("lost")).alias("gain"), (-F.col("j")).alias("j"))).alias("m")).select("stratum", "rule", (-F.col("m.j")).alias("j"))
    at = lambda r: F.max(F.when(F.col("rule") == r, F.element_at(F.array(*map(F.lit, CUTOFFS[r])), F.least("j", F.lit(len(CUTOFFS[r]))))))
    return best.groupBy("stratum").agg(*[at(r).alias(r) for r in CUTOFFS])


def quality_rules(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", risk: float = RISK, fail: float = FAIL) -> DataFrame:
    """docs without the text, with the counts of `measures`, base_failed, failed (names of the rules that reject it) and kept.

    labels (doc_id, quality 0/1) are the holdouts: each text counts once a stratum and label, and only if it passes the base rules; rows
    without a label or with a label of null take no part, a document with both labels is bad. Null strata are one stratum; one with too few good holdouts
    (some 400 with the defaults) has no cutoffs, and base rules alone decide there. Null and empty texts have no words and fail
    the base rules. Texts are measured whole. Repeated rows are treated alike; taken names get leading underscores.
    """
    spark = docs.sparkSession
    names = {c: free_name(docs, c) for c in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "failed", "kept")}
    own, digest, m = (free_name(docs, c) for c in ("stratum__", "digest__", "m__"))
    kept = [c for c in docs.columns if c != text]
    rows = written(docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias(own), F.xxhash64(text).alias(digest), measures(F.col(text)).alias(m)), "measures")
    base = base_failed(F.col(m)["n_words"], F.col(m)["n_repeat_words"])
    values = rule_values(F.col(m))
    known = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("id__")).agg(F.min((F.col("quality") == 1).cast("int")).alias("good"))
    asked = rows.where(~base).select(F.col(key).alias("id__"), F.col(own).alias("stratum"), F.col(digest).alias("digest"), *[v.alias(r) for r, v in values.items()])
    holdout = asked.join(known, "id__").drop("id__").dropDuplicates(["stratum", "digest", "good"]).drop("digest")
    found = written(cutoffs(holdout, risk, fail).withColumnRenamed("stratum", own), "cutoffs")
    few = found.count() <= BROADCAST_STRATA
    limits = found.select(own, F.struct(*CUTOFFS).alias(limit := free_name(docs, "limits__")))
    joined = rows.join(F.broadcast(limits) if few else limits, own, "left")
    failed = F.array_compact(F.array(*[F.when(v > F.col(limit)[r], F.lit(r)) for r, v in values.items()]))
    out = joined.select(*[F.col(f"`{c}`") for c in kept], *[F.col(m)[c].alias(names[c]) for c in list(names)[:6]], base.alias(names["base_failed"]), failed.alias(names["failed"]))
    return out.withColumn(names["kept"], ~F.col(names["base_failed"]) & (F.size(names["failed"]) == 0))
