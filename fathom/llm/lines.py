"""Cross-site boilerplate lines, in DataFrame functions only: distinct-site spread from HyperLogLog sketches, exact near the threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import free_name, written

#: Sites from which on a line is boilerplate.
MIN_SITES = 10
#: Sketches of 2**12 registers err by 1.6 % (one deviation). Estimates within this share of the threshold are counted exactly.
SKETCH_LOG2, MARGIN = 12, 0.1


def spread_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """(h1, h2, site, first) of each line that is not blank: two hashes of the trimmed line, and its place (key, hash of text, position).

    Rows of one text are told apart by their key; a null key orders first. A null site counts as no site.
    """
    rows = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("t"), F.col(site).alias("site"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    line = F.trim("line")
    return rows.where(line != "").select(F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"), "site", F.struct("k", "t", "pos").alias("first"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(h1, h2, first) of lines on min_sites sites or more; first is their first place.

    Sketches are built before the shuffle and merged after it, so a line on a third of all rows costs one sketch a task.
    """
    sketched = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", SKETCH_LOG2).alias("sketch"), F.min("first").alias("first"))
    spread = sketched.select("h1", "h2", "first", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites * (1 - MARGIN) - 1)
    spread = written(spread, "spread")
    near = spread.where(F.col("sites") <= min_sites * (1 + MARGIN) + 1).select("h1", "h2")
    exact = lines.where("site is not null").join(near, ["h1", "h2"], "left_semi").select("h1", "h2", "site").distinct().groupBy("h1", "h2").agg(F.count("*").alias("exact"))
    return spread.join(exact, ["h1", "h2"], "left").where(F.coalesce("exact", "sites") >= min_sites).select("h1", "h2", "first")


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, key: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """docs with the text less its boilerplate lines, n_lines (before) and n_removed.

    A line that min_sites or more distinct sites have (compared after trimming spaces; blank lines never count) stays only at
    its first place, by key, then text, then position; elsewhere it goes. Other lines stay as they are, in order. A
    null text stays null with 0 lines; an empty one has 1. Rows equal in key and text are treated alike. Taken
    names get leading underscores.
    """
    lines = spread_lines(docs, key, text, site)
    flagged = written(boilerplate(lines, min_sites), "boilerplate")
    gone = lines.join(flagged.withColumnRenamed("first", "kept"), ["h1", "h2"]).where("first != kept")
    k, t, drop, own_t = (free_name(docs, c) for c in ("k__", "t__", "drop__", "t_own__"))
    drops = gone.groupBy(F.col("first.k").alias(k), F.col("first.t").alias(t)).agg(F.collect_set("first.pos").alias(drop))
    total, removed = free_name(docs, "n_lines"), free_name(docs, "n_removed")
    own = docs.withColumn(own_t, F.xxhash64(text))
    joined = own.join(drops, own[key].eqNullSafe(drops[k]) & (own[own_t] == drops[t]), "left")
    split = F.split(F.col(text), "\n", -1)
    left = F.array_join(F.filter(split, lambda _, i: ~F.array_contains(drop, i)), "\n")
    size = F.when(F.col(text).isNull(), 0).otherwise(F.size(split))
    names = [F.when(F.col(drop).isNull(), F.col(text)).otherwise(left).alias(text) if c == text else F.col(c) for c in docs.columns]
    return joined.select(*names, size.cast("long").alias(total), F.coalesce(F.size(drop), F.lit(0)).cast("long").alias(removed))
