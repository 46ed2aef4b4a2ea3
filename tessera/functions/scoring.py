"""Strength, decay, usage and trust as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import lexicon as X


def decay(age_days: Column, half_life: float = 30.0) -> Column:
    """1 where decay is switched off; the future does not count as young."""
    return F.pow(F.lit(0.5), F.greatest(age_days, F.lit(0.0)) / half_life) if half_life > 0 else F.lit(1.0)


def reinforcement(count: Column, scale: float = 5.0) -> Column:
    """0 without accesses, then towards 1; at once where there is no scale."""
    return F.when(count == 0, 0.0).otherwise(1 - F.exp(-count / scale) if scale > 0 else F.lit(1.0))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def strength(age_days: Column, accesses: Column, feedback: Column, half_life: float = 30.0, scale: float = 5.0, weight: float = 0.2, power: float = 1.0) -> Column:
    """clamp((d^m + (1 - d^m) r)(1 + w feedback))."""
    d = F.pow(decay(age_days, half_life), F.lit(power))
    return clamp((d + (1 - d) * reinforcement(accesses, scale)) * (1 + weight * clamp(feedback, -1.0, 1.0)))


def clamp_function(deltas: Column) -> Column:
    """An ordered array of additions, each held in [-1, 1], as one function x -> clamp(x + add, low, high)."""
    first = F.struct(F.lit(-1e300).alias("low"), F.lit(1e300).alias("high"), F.lit(0.0).alias("add"))

    def then(f: Column, d: Column) -> Column:
        held = lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x + d))
        return F.struct(held(f["low"]).alias("low"), held(f["high"]).alias("high"), (f["add"] + d).alias("add"))

    return F.aggregate(deltas, first, then)


def weight_of(name: Column, weights: dict[str, float], default: float) -> Column:
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.coalesce(F.try_element_at(table, name), F.lit(default))


def trust(confidence: Column, source: Column, origin: Column, kind: Column, used: Column, saved: Column, matched: Column) -> Column:
    """Confidence times the weights of its source, origin and type, plus a bounded gain from use; unknown names weigh a default."""
    tidy = lambda c: F.replace(F.lower(F.trim(c)), F.lit("-"), F.lit("_"))
    base = clamp(confidence) * weight_of(tidy(source), X.SOURCE_WEIGHTS, 0.85) * weight_of(tidy(origin), X.ORIGIN_WEIGHTS, 1.0) * weight_of(F.upper(kind), X.TYPE_WEIGHTS, 1.0)
    return F.round(base + F.least(F.lit(0.2), 0.03 * used + 0.02 * saved + 0.01 * matched), 4)
