"""Similarity of sets and sparse vectors, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathom.functions.dense import col


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Size of the intersection over that of the union; 0 if both are empty."""
    union = F.size(F.array_union(col(a), col(b)))
    return F.when(union > 0, F.size(F.array_intersect(col(a), col(b))) / union).otherwise(F.lit(0.0))


def containment(a: Column | str, b: Column | str) -> Column:
    """Share of a that b has; 0 if a is empty."""
    n = F.size(F.array_distinct(col(a)))
    return F.when(n > 0, F.size(F.array_intersect(col(a), col(b))) / n).otherwise(F.lit(0.0))


def symmetric_difference_share(a: Column | str, b: Column | str) -> Column:
    """Members of one side only over members of any; 0 if both are empty."""
    union = F.size(F.array_union(col(a), col(b)))
    apart = F.size(F.array_except(col(a), col(b))) + F.size(F.array_except(col(b), col(a)))
    return F.when(union > 0, apart / union).otherwise(F.lit(0.0))


def trigrams(text: Column | str) -> Column:
    """Distinct runs of three characters."""
    t = col(text)
    n = F.length(t)
    return F.when(n >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 2)), lambda i: F.substr(t, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def words(text: Column | str) -> Column:
    """Lower-case runs of letters a-z, in order."""
    return F.filter(F.split(F.lower(col(text)), "[^a-z]+"), lambda w: F.length(w) >= 1)
