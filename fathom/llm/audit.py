"""How filters interact: a histogram of failure masks for each part, and from it every order of the filters."""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import written
from fathom.llm.rules import bound, words_of

FILTERS = "ABCDE"
#: Texts with more than this part of all rows are at most so many, and are broadcast (48 bytes each); others are joined by shuffle, with few rows a key.
HOT_TEXTS = 10_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def own_mask(text: Column) -> Column:
    """Bits 0 to 3 for filters A to D that a text fails: under 200 words; fewer distinct words than half; over 2 % A-Z; any of #$%&*|."""
    counted = bound(words_of(text), lambda ws: F.struct(F.size(ws).alias("n"), F.size(F.array_distinct(ws)).alias("d")))
    upper = F.octet_length(text) - F.octet_length(F.translate(text, _UPPER, ""))
    bit = lambda condition, i: F.when(condition, 1 << i).otherwise(0)
    return bound(counted, lambda c: bit(c["n"] < 200, 0) + bit(100 * c["d"] < 50 * c["n"], 1)) + bit(100 * upper > 2 * F.length(text), 2) + bit(text.rlike("[#$%&*|]"), 3)


def masks(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(id, part, mask): the five filters each row of docs fails, bit 4 for a text that a smaller id has too.

    The least id of each text comes from a groupBy over its digest, which sums copies before the shuffle. Rows meet it by broadcast where
    a text holds more than 1/HOT_TEXTS of all rows, else by a shuffle join, whose keys then have few rows each.
    """
    own = F.coalesce(F.col(text), F.lit(""))
    rows = written(docs.select(F.col(key).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(own, 256)).alias("digest"), own_mask(own).alias("own")), "masks")
    copies = rows.where("id is not null").groupBy("digest").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("n")).where("least < most")
    copies = written(copies.drop("most"), "copies")
    many = max(1, rows.count() // HOT_TEXTS)
    hot, rest = F.broadcast(copies.where(F.col("n") > many).drop("n")), copies.where(F.col("n") <= many).drop("n")
    met = rows.join(hot, "digest").unionByName(rows.join(hot, "digest", "left_anti").join(rest, "digest", "left"), allowMissingColumns=True)
    return met.select("id", "part", (F.col("own") + F.when(F.col("id") > F.col("least"), 16).otherwise(0)).alias("mask"))


def cells(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): at most 32 cells a part. A document is good or toxic if any of its labels says so."""
    flag = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    joined = masked.join(known, "id", "left")
    return joined.groupBy("part", "mask").agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


def _steps() -> str:
    """Every step of every order: the filter's bit and the bits of those before it."""
    out = []
    for order in map("".join, permutations(FILTERS)):
        before = 0
        for i, f in enumerate(order):
            out.append({"filter_order": order, "step": i + 1, "bit": (bit := 1 << FILTERS.index(f)), "before": before})
            before |= bit
    return json.dumps(out)


def filter_audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """part, filter_order, step and counts of that step, for each part, each of the 120 orders of five filters, and each step.

    kept: rows that fail neither this filter nor one before it; removed: failing this one and none before; redundant: failing this one and
    one before; unique_fails: failing this one only; good_lost, toxic_lost: removed rows with that label; shapley: this filter's
    removed, summed over all orders, which is n! / filters failed for each row. All come from the part's 32 cells; texts are read once.

    Null texts are empty, null parts the part ''. Rows with a null id are never copies of others nor others of them; rows of one id
    with one text are no copies of each other. An empty table has no parts, so no rows. Other columns are not looked at.
    """
    whole = cells(masks(docs, key, text, part), labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    steps = F.from_json(F.lit(_steps()), "array<struct<filter_order string, step int, bit int, before int>>")
    each = whole.select("part", "cells", F.explode(steps).alias("s"))
    fails, earlier = lambda c: c["mask"].bitwiseAND(F.col("s.bit")) != 0, lambda c: c["mask"].bitwiseAND(F.col("s.before")) != 0
    total = lambda keep, what: F.aggregate(F.filter("cells", keep), F.lit(0).cast("long"), lambda a, c: a + what(c))
    gone = lambda c: fails(c) & ~earlier(c)
    count = lambda c: c["n"]
    return each.select(
        "part", "s.filter_order", "s.step", total(lambda c: ~fails(c) & ~earlier(c), count).alias("kept"), total(gone, count).alias("removed"), total(lambda c: fails(c) & earlier(c), count).alias("redundant"),
        total(lambda c: c["mask"] == F.col("s.bit"), count).alias("unique_fails"), total(gone, lambda c: c["good"]).alias("good_lost"), total(gone, lambda c: c["toxic"]).alias("toxic_lost"),
        total(fails, lambda c: c["n"] * (F.lit(factorial(len(FILTERS))) / F.bit_count(c["mask"])).cast("long")).alias("shapley"))
