"""Fusion, normalisation and agreement of rankings (space, id, score, rank)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions import dense

#: Constant of reciprocal-rank fusion, with ranks from 1 (fixed value).
RRF = 60


def weight_of(weights: dict[str, float], space: str = "space") -> Column:
    """A space's weight as an expression; 0 for spaces without one."""
    return F.coalesce(*[F.when(F.col(space) == s, F.lit(float(w))) for s, w in weights.items()], F.lit(0.0))


def rrf(ranked: DataFrame, weights: dict[str, float], scored: tuple[str, ...] = (), unique_boost: float = 0.0) -> DataFrame:
    """(id, score, spaces): sum of weight/(60 + rank), spaces of weight 0 skipped.

    Terms of the spaces in `scored` are multiplied by the similarity. unique_boost: ids found by one space only get 1 + that.
    """
    w = weight_of(weights)
    term = w / (RRF + F.col("rank")) * (F.when(F.col("space").isin(*scored), F.col("score")).otherwise(1.0) if scored else F.lit(1.0))
    out = ranked.where(w > 0).groupBy("id").agg(F.sum(term).alias("score"), F.array_sort(F.collect_set("space")).alias("spaces"))
    return out.withColumn("score", F.col("score") * F.when(F.size("spaces") == 1, 1 + unique_boost).otherwise(1.0)) if unique_boost else out


def weighted_sum(ranked: DataFrame, weights: dict[str, float]) -> DataFrame:
    return ranked.groupBy("id").agg(F.sum(weight_of(weights) * F.col("score")).alias("score"))


def weighted_mean(ranked: DataFrame, weights: dict[str, float], all_of: int = 0) -> DataFrame:
    """Sum of w*s over sum of w, of known scores of 0 or more; all_of: ids in so many spaces only."""
    w = weight_of(weights)
    out = ranked.where((w > 0) & (F.col("score") >= 0)).groupBy("id").agg((F.sum(w * F.col("score")) / F.sum(w)).alias("score"), F.count("*").alias("n"))
    return (out.where(F.col("n") >= all_of) if all_of else out).select("id", "score")


def pooled(ranked: DataFrame) -> DataFrame:
    return ranked.groupBy("id").agg(F.max("score").alias("max_score"), F.sum("score").alias("sum_score"), F.avg("score").alias("mean_score"), F.count("*").alias("n"))


def normalise(ranked: DataFrame, how: str) -> DataFrame:
    """Scores of each space brought to a common scale: minmax (flat lists 1), zscore (population, clamped to +-3, then (z+3)/6), rank (1/rank), none."""
    w = Window.partitionBy("space")
    s = F.col("score")
    span, sd = F.max(s).over(w) - F.min(s).over(w), F.stddev_pop(s).over(w)
    new = {
        "none": lambda: s,
        "minmax": lambda: F.when(span > 0, (s - F.min(s).over(w)) / span).otherwise(1.0),
        "zscore": lambda: F.when(sd > 0, (dense.clamp((s - F.avg(s).over(w)) / sd, -3.0, 3.0) + 3) / 6).otherwise(0.5),
        "rank": lambda: 1.0 / F.col("rank"),
    }[how]()
    return ranked.withColumn("normalised", new)


def suppressed_weights(ranked: DataFrame, weights: dict[str, float], least_variance: float = 0.001, factor: float = 0.25) -> DataFrame:
    """(space, weight): a space of 3 candidates or more whose sample variance is under least_variance keeps a quarter of its weight; one without any score of 0 or more, none."""
    live = F.when(F.col("score") >= 0, F.col("score"))
    each = ranked.groupBy("space").agg(F.var_samp(live).alias("v"), F.count(live).alias("n"))
    w = weight_of(weights)
    return each.select("space", F.when(F.col("n") == 0, 0.0).when((F.col("n") >= 3) & (F.col("v") < least_variance), w * factor).otherwise(w).alias("weight"))


def semantic_fusion(ranked: DataFrame, weights: DataFrame) -> DataFrame:
    """The final score: sum of w*s over sum of w where both count. weights: (space, weight), one row for each space."""
    rows = ranked.join(F.broadcast(weights), "space").where("weight > 0 and score >= 0")
    return rows.groupBy("id").agg((F.sum(F.col("weight") * F.col("score")) / F.sum("weight")).alias("score"))


def matrix_weighted(ranked: DataFrame, matrix: dict[tuple[str, str], float]) -> DataFrame:
    """Diagonal s*w, off the diagonal sqrt(s_i * s_j)*w, over the sum of the weights used; a row's scores meet inside one group."""
    each = ranked.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("space", F.greatest("score", F.lit(0.0)).alias("score")))).alias("m"))
    parts, weights = F.lit(0.0), F.lit(0.0)
    for (i, j), w in matrix.items():
        x, y = F.try_element_at("m", F.lit(i)), F.try_element_at("m", F.lit(j))
        value = x if i == j else F.sqrt(x * y)
        parts, weights = parts + F.coalesce(value * w, F.lit(0.0)), weights + F.when(value.isNotNull(), w).otherwise(0.0)
    return each.select("id", F.when(weights > 0, parts / weights).otherwise(0.0).alias("score"))


def consensus(ranked: DataFrame, n_spaces: int, top: int) -> DataFrame:
    """(id, found, share): in how many spaces' first `top` an id is."""
    return ranked.where(F.col("rank") <= top).groupBy("id").agg(F.count_distinct("space").alias("found")).withColumn("share", F.col("found") / n_spaces)


def agreement(ranked: DataFrame, n_spaces: int) -> DataFrame:
    """One row: ids that all spaces found, ids that any found, and their ratio."""
    each = ranked.groupBy("id").agg(F.count_distinct("space").alias("n"))
    return each.agg(F.sum((F.col("n") == n_spaces).cast("long")).alias("in_all"), F.count("*").alias("in_any")).withColumn("agreement", F.col("in_all") / F.col("in_any"))


def anomalies(wide: DataFrame, high: str, low: str, high_least: float, low_most: float) -> DataFrame:
    """Rows that one space finds near and another far, with the difference as score."""
    return wide.where((F.col(high) >= high_least) & (F.col(low) <= low_most)).withColumn("score", F.col(high) - F.col(low))


def blind_spots(main: DataFrame, other: DataFrame, k: int) -> DataFrame:
    """(id, score, origin): k rows of which max(1, min(2, k//3)) slots go to the best of `other` that main's first k lack."""
    slots = max(1, min(2, k // 3))
    first = main.where(F.col("rank") <= k)
    new = other.join(first.select("id"), "id", "left_anti").orderBy(F.desc("score"), "id").limit(slots).select("id", "score", F.lit("discovery").alias("origin"))
    return first.where(F.col("rank") <= k - slots).select("id", "score", F.lit("main").alias("origin")).unionByName(new)


def relevance(ranked: DataFrame, weights: dict[str, float], thresholds: dict[str, float]) -> DataFrame:
    """(id, relevance, matching): sum of w * what a score has above its threshold, over the most that could be; how many spaces match."""
    w, t = weight_of(weights), weight_of(thresholds)
    whole = sum(weights[s] * (1 - thresholds[s]) for s in weights)
    return ranked.groupBy("id").agg((F.sum(w * F.greatest(F.col("score") - t, F.lit(0.0))) / whole).alias("relevance"), F.sum((F.col("score") >= t).cast("long")).alias("matching"))


def interpolated(score: Column, maxsim: Column, weight: float = 0.15) -> Column:
    return (1 - weight) * score + weight * maxsim


def wide(ranked: DataFrame, spaces: list[str]) -> DataFrame:
    """(id, one column for each space): null where a space has no score."""
    return ranked.groupBy("id").agg(*[F.max(F.when(F.col("space") == s, F.col("score"))).alias(s) for s in spaces])


def space_correlation(ranked: DataFrame, spaces: list[str]) -> DataFrame:
    """(space_a, space_b, r): Pearson over ids that both have, all pairs in one pass."""
    pairs = [(a, b) for i, a in enumerate(spaces) for b in spaces[i + 1 :]]
    row = wide(ranked, spaces).agg(*[F.corr(a, b).alias(f"{a}_{b}") for a, b in pairs])
    entries = F.array(*[F.struct(F.lit(a).alias("space_a"), F.lit(b).alias("space_b"), F.col(f"{a}_{b}").alias("r")) for a, b in pairs])
    return row.select(F.inline(entries))


#: First place and number of the spaces of each group, in the order semantic, temporal, structural, experiential (fixed values).
GROUPS = ((0, 3), (3, 3), (6, 3), (9, 4))


def alignment_fusion(alignments: Column) -> Column:
    """Of the 13 alignments of a row (0..1): mean of each group, confidence, how many are over 0.1, and the group with the greatest mean, the last of equals.

    Confidence is half the mean of all and half that of the groups, times the share of alignments over 0.1. A value out of range is an error.
    """
    a = F.when(F.exists(alignments, lambda x: x.isNull() | (x < 0) | (x > 1)) | (F.size(alignments) != 13), F.raise_error(F.lit("13 alignments within 0..1 are needed"))).otherwise(alignments)
    groups = F.array(*[sum((F.get(a, F.lit(i)) for i in range(at + 1, at + n)), F.get(a, F.lit(at))) / n for at, n in GROUPS])
    active = F.size(F.filter(a, lambda x: x > 0.1))
    confidence = (0.5 * dense.total(a) / 13 + 0.5 * dense.total(groups) / 4) * active / 13
    dominant = (F.size(groups) - F.array_position(F.reverse(groups), F.array_max(groups))).cast("int")
    return F.struct(groups.alias("groups"), confidence.alias("confidence"), active.alias("active"), dominant.alias("dominant"))


def cross_correlations(parts: dict[str, Column], weights: dict[tuple[str, str], float] | None = None, least: float = 0.01) -> Column:
    """(space_a, space_b, value) of all pairs of a row's spaces: cosine of their vectors times the pair's weight (1 without one); nearer to 0 than `least` counts as 0."""
    pairs = [(a, b) for i, a in enumerate(parts) for b in list(parts)[i + 1 :]]
    value = lambda a, b: dense.cosine(parts[a], parts[b]) * float((weights or {}).get((a, b), 1.0))
    return F.array(*[F.struct(F.lit(a).alias("space_a"), F.lit(b).alias("space_b"), F.when(F.abs(value(a, b)) < least, 0.0).otherwise(value(a, b)).alias("value")) for a, b in pairs])


def multi_utl(semantic: Column, coherence: Column, phi: float = 0.0, lambda_s: float = 1.0, lambda_c: float = 1.0, w_e: float = 1.0, tau: list[float] | None = None) -> Column:
    """Sigmoid of 2 * weighted semantic changes * weighted coherence changes * w_e * cos(phi); weights are even unless tau is given."""
    import math

    t = F.lit(tau or [1 / 13] * 13).cast("array<double>")
    return dense.sigmoid(2 * lambda_s * dense.dot(semantic, t) * lambda_c * dense.dot(coherence, t) * w_e * math.cos(phi))
