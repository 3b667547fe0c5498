"""Deterministic encoders and quantisation, as expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathom.functions import dense
from fathom.functions.dense import col

#: Periods in seconds: hour, day, week, month, year (fixed values).
PERIODS = (3600, 86400, 604800, 2592000, 31536000)
#: Half-lives in seconds of the decay encoder (fixed values).
SCALES = (3600, 86400, 604800, 2592000)


def periodic(ts: Column | str, harmonics: int = 51, width: int = 512) -> Column:
    """Sines and cosines of harmonics of each period, padded with zeros, of norm 1."""
    t = F.unix_micros(col(ts).cast("timestamp")) / 1e6
    parts = [f(2 * math.pi * h * t / p) for p in PERIODS for h in range(1, harmonics + 1) for f in (F.sin, F.cos)]
    return dense.normalised(F.array(*parts, *[F.lit(0.0)] * (width - len(parts))))


def phase_features(ts: Column | str, harmonics: int = 1) -> Column:
    """Sine and cosine of each period's phase, the phase taken from whole seconds first."""
    t = F.unix_seconds(col(ts).cast("timestamp"))
    return F.array(*[f(2 * math.pi * h * ((t % p) / p)) for p in PERIODS for h in range(1, harmonics + 1) for f in (F.sin, F.cos)])


def positional(position: Column | str, width: int = 8, base: float = 10000.0) -> Column:
    """Sine and cosine of a position at geometrically falling frequencies."""
    p = col(position).cast("double")
    return F.array(*[f(p / base ** (2 * i / width)) for i in range(width // 2) for f in (F.sin, F.cos)])


def decay(age: Column, phases: int = 128) -> Column:
    """Decay at each scale, at so many phases, of norm 1."""
    return dense.normalised(F.array(*[F.exp(-math.log(2) * age / s) * math.cos(2 * math.pi * k / phases) for s in SCALES for k in range(phases)]))


def int8(vector: Column | str) -> Column:
    """Components as round(127 x / greatest |x|)."""
    v = dense.vec(vector)
    most = F.array_max(F.transform(v, F.abs))
    return F.when(most > 0, F.transform(v, lambda x: F.round(x / most * 127).cast("int"))).otherwise(F.transform(v, lambda _: F.lit(0)))


def int4(vector: Column | str) -> Column:
    v = dense.vec(vector)
    most = F.array_max(F.transform(v, F.abs))
    return F.when(most > 0, F.transform(v, lambda x: F.round(x / most * 7).cast("int"))).otherwise(F.transform(v, lambda _: F.lit(0)))


def float8(vector: Column | str) -> Column:
    """Components on the grid of 8-bit floats with 4 exponent and 3 mantissa bits, greatest 448."""

    def one(x: Column) -> Column:
        a = F.least(F.abs(x), F.lit(448.0))
        e = F.greatest(F.floor(F.log2(a)), F.lit(-6))
        step = F.pow(F.lit(2.0), e - 3)
        return F.when(a == 0, 0.0).otherwise(F.signum(x) * F.least(F.rint(a / step) * step, F.lit(448.0)))

    return F.transform(dense.vec(vector), one)


def pruned_tokens(tokens: Column | str, share: float = 0.5) -> Column:
    """The tokens of greatest norm, that share of them, in their old order."""
    t = col(tokens)
    keep = F.ceil(F.size(t) * share).cast("int")
    ranked = F.slice(F.array_sort(F.transform(t, lambda x, i: F.struct((-dense.norm(x)).alias("n"), i.alias("i")))), F.lit(1), keep)
    chosen = F.array_sort(F.transform(ranked, lambda r: r["i"]))
    return F.transform(chosen, lambda i: F.element_at(t, i + 1))


#: How each space is stored (fixed values).
METHODS = {"E1": "parts", "E2": "float8", "E3": "float8", "E4": "float8", "E5": "parts", "E6": "sparse", "E7": "parts", "E8": "float8", "E9": "binary", "E10": "parts", "E11": "float8", "E12": "tokens", "E13": "sparse"}


def stored(space: str, vector: Column | str, width: int = 128) -> Column:
    """A space's vector as it is stored: 8-bit floats, signs, or the tokens of greatest norm; sparse ones stay, and those kept in parts (product codes, which need a fitted codebook) are 8-bit integers here."""
    v = dense.vec(vector)
    return {"float8": lambda: float8(v), "binary": lambda: dense.signs(v).cast("array<double>"), "tokens": lambda: F.flatten(pruned_tokens(dense.tokens(v, width))), "sparse": lambda: v, "parts": lambda: int8(v).cast("array<double>")}[METHODS[space]]()
