"""Fusing ranked arms, folding further arms in, and rescoring what came out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import settled


def rrf(arms: list[DataFrame], k: int = 20, weights: list[float] | None = None) -> DataFrame:
    """(query_id, id, rrf_score, rank) from arms (query_id, id, rank): the sum of w / (k + rank).

    Ties keep first-seen order: the earliest arm, then the rank in it.
    """
    settled(arms[0].sparkSession)
    weights = weights or [1.0] * len(arms)
    rows = reduce(DataFrame.unionByName, [a.select("query_id", "id", F.col("rank").cast("int").alias("r"), F.lit(i).alias("arm"), F.lit(w).alias("w")) for i, (a, w) in enumerate(zip(arms, weights, strict=True))])
    out = rows.groupBy("query_id", "id").agg(F.round(F.sum(F.col("w") / (k + F.col("r"))), 6).alias("rrf_score"), F.min(F.struct("arm", "r")).alias("seen"))
    w = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), "seen.arm", "seen.r", "id")
    return out.withColumn("rank", F.row_number().over(w)).drop("seen")


def fold_arm(fused: DataFrame, arm: DataFrame, k: int = 20, weight: float = 1.0, add_only: bool = False, existing: DataFrame | None = None) -> DataFrame:
    """Adds w / (k + rank) of another arm.

    ``add_only``: rows that are there keep their score, missing ones get the weight of their
    place among the missing. ``existing`` (id): new ids that are not in it are left out, though
    they use up ranks.
    """
    settled(fused.sparkSession)
    if add_only:
        missing = arm.select("query_id", "id", "rank").join(fused.select("query_id", "id"), ["query_id", "id"], "left_anti")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "id"))
        added = missing.select("query_id", "id", F.round(F.lit(weight) / (k + place), 6).alias("rrf_score"))
        out = fused.select("query_id", "id", "rrf_score").unionByName(added)
    else:
        gain = arm.select("query_id", "id", (F.lit(weight) / (k + F.col("rank"))).alias("gain"))
        if existing is not None:
            known = fused.select("query_id", "id").unionByName(gain.join(existing, "id", "left_semi").select("query_id", "id")).distinct()
            gain = gain.join(known, ["query_id", "id"], "left_semi")
        out = fused.select("query_id", "id", "rrf_score").join(gain, ["query_id", "id"], "full_outer")
        out = out.select("query_id", "id", F.round(F.coalesce("rrf_score", F.lit(0.0)) + F.coalesce("gain", F.lit(0.0)), 6).alias("rrf_score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), "id")
    return out.withColumn("rank", F.row_number().over(w))


def min_max(x: Column, over: Window) -> Column:
    """Scaled to [0, 1] in the window; 1 where all are equal."""
    low, high = F.min(x).over(over), F.max(x).over(over)
    return F.when(high == low, F.lit(1.0)).otherwise((x - low) / (high - low))


def composite(rows: DataFrame, age_days: Column, importance: Column, strength: Column, signal: Column | None = None, weights: tuple[float, float, float, float] = (1.0, 0.5, 0.3, 0.4), half_life: float = 90.0, signal_weight: float = 0.0, digits: int = 6) -> DataFrame:
    """Rescores fused rows by relevance, recency, importance and strength; ties keep the fused order."""
    over = Window.partitionBy("query_id")
    w_rel, w_rec, w_imp, w_str = weights
    score = w_rel * min_max(F.col("rrf_score"), over) + w_rec * F.pow(F.lit(0.5), F.greatest(age_days, F.lit(0.0)) / half_life) + w_imp * F.greatest(F.lit(0.0), F.least(F.lit(1.0), importance))
    if w_str:
        score = score + w_str * F.coalesce(strength, F.lit(1.0))
    if signal is not None and signal_weight:
        score = score * ((1 - signal_weight) + signal_weight * (F.coalesce(signal, F.lit(0.0)) + 1) / 2)
    out = rows.withColumn("composite", F.round(score, digits))
    return out.withColumn("final_rank", F.row_number().over(over.orderBy(F.desc("composite"), "rank")))


def rerank_head(rows: DataFrame, scorer: Column, head: int) -> DataFrame:
    """The first ``head`` rows of each query in the order of a score, the tail as it was."""
    w = Window.partitionBy("query_id").orderBy((F.col("rank") > head).cast("int"), F.when(F.col("rank") <= head, -scorer).otherwise(F.lit(None)).asc_nulls_last(), "rank")
    return rows.withColumn("new_rank", F.row_number().over(w))
