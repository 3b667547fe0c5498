"""Recency, periodicity and sequence, as expressions. Clocks are always passed in."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathom.functions.dense import col

HOUR, DAY, WEEK = 3600.0, 86400.0, 604800.0
#: Seconds of each scale: horizon (fixed values).
HORIZON = {"micro": HOUR, "meso": DAY, "macro": WEEK, "long": 30 * DAY, "archival": 365 * DAY}
#: Ages up to which a step has its value; older memories have STEP_REST (fixed values).
STEPS = ((300.0, 1.0), (3600.0, 0.8), (86400.0, 0.5), (604800.0, 0.3))
STEP_REST = 0.1


def age(ts: Column | str, as_of: Column | str) -> Column:
    """Seconds from ts to as_of, 0 for the future."""
    of = F.to_timestamp(F.lit(as_of)) if isinstance(as_of, str) else as_of
    return F.greatest(F.lit(0.0), (F.unix_micros(of) - F.unix_micros(col(ts).cast("timestamp"))) / 1e6)


def linear(a: Column, horizon: float) -> Column:
    return F.greatest(F.lit(0.0), 1 - a / horizon)


def exponential(a: Column, half_life: float) -> Column:
    return F.exp(-math.log(2) * a / half_life)


def step(a: Column) -> Column:
    out = F.when(a <= STEPS[0][0], STEPS[0][1])
    for limit, value in STEPS[1:]:
        out = out.when(a <= limit, value)
    return out.otherwise(STEP_REST)


def decay(a: Column, kind: str, scale: str = "meso") -> Column:
    if kind in ("none", "no_decay"):
        return F.lit(1.0)
    return {"linear": lambda: linear(a, HORIZON[scale]), "exponential": lambda: exponential(a, HORIZON[scale] / 4), "step": lambda: step(a)}[kind]()


def multi_scale(a: Column) -> Column:
    return 0.4 * exponential(a, HOUR) + 0.35 * exponential(a, DAY) + 0.25 * exponential(a, WEEK)


def adaptive_half_life(base: float, n: Column) -> Column:
    return base * F.least(F.greatest(1 + 0.1 * F.log10(n / 1000), F.lit(0.8)), F.lit(2.0))


def periodic(ts: Column | str, hour: int | None = None, weekday: int | None = None) -> Column:
    """Closeness of the hour of day and the day of week (Sunday 0) to targets, round the clock; 0.5 without a target."""
    parts = []
    if hour is not None:
        d = F.abs(F.hour(col(ts)) - hour)
        parts.append(1 - F.least(d, 24 - d) / 12.0)
    if weekday is not None:
        d = F.abs(F.dayofweek(col(ts)) - 1 - weekday)
        parts.append(1 - F.least(d, 7 - d) / 3.5)
    return sum(parts[1:], parts[0]) / len(parts) if parts else F.lit(0.5)


def proximity(d: Column, most: float, exponential_fall: bool = False) -> Column:
    """Closeness in a sequence: 1 - d/most, or e^(-3 d/most); 0 beyond most."""
    d = F.abs(d)
    fall = F.exp(-3 * d / most) if exponential_fall else 1 - d / most
    return F.when(d > most, 0.0).otherwise(fall)


def directed(score: Column, own: Column, anchor: Column, own_ms: Column, anchor_ms: Column, direction: str) -> Column:
    """score where a memory stands before or after an anchor (or both: anywhere), else 0: by numbers in the session where both have one, else by time, with a millisecond of grace after."""
    known = own.isNotNull() & anchor.isNotNull()
    right = {
        "before": F.when(known, own < anchor).otherwise(own_ms < anchor_ms),
        "after": F.when(known, own > anchor).otherwise(own_ms > anchor_ms + 1),
        "both": F.lit(True),
    }[direction]
    return F.when(right, score).otherwise(0.0)


def boosted(score: Column, factor: Column, weight: float) -> Column:
    """score * clamp(1 + weight * (factor - 0.5), 0.8, 1.2)."""
    return score * F.least(F.greatest(1 + weight * (factor - 0.5), F.lit(0.8)), F.lit(1.2))


def combined(score: Column, parts: dict[str, tuple[Column, float]], weight: float) -> Column:
    """score * (1 - weight) + weight * mean of the active parts, their weights brought to sum 1."""
    whole = sum(w for _, w in parts.values())
    mixed = sum((c * (w / whole) for c, w in parts.values()), F.lit(0.0))
    return score * (1 - weight) + mixed * weight


def forgetting(hours: Column, accesses: Column, importance: Column) -> Column:
    return F.exp(-hours / ((1 + F.log(accesses + 1)) * (1 + importance) * 24))


def consolidation(importance: Column, kept: Column, access_rate: Column) -> Column:
    return 0.4 * importance + 0.3 * (1 - kept) + 0.3 * F.least(access_rate, F.lit(1.0))


def anchored(scores: Column, how: str = "average") -> Column:
    """Nearness to several anchors as one score: min (near to all), max (near to any) or average."""
    mean = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores)
    return {"min": F.array_min(scores), "max": F.array_max(scores), "average": mean}[how]
