"""Retrieval metrics, accuracy by category, and percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def case_metrics(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """Per case: recall, bridge recall, precision, hit, reciprocal rank and nDCG at k.

    ``ranked`` (case_id, id, rank), ``gold`` (case_id, id). Repeats in a ranking count in
    recall and precision, not in the ideal. Cases without gold score 0.
    """
    g = gold.distinct()
    size = g.groupBy("case_id").agg(F.count("*").alias("n_gold"))
    marks = g.withColumn("hit", F.lit(True))
    return marked_metrics(ranked.select("case_id", "id", "rank").join(marks, ["case_id", "id"], "left"), size, k)


def marked_metrics(rows: DataFrame, size: DataFrame, k: int) -> DataFrame:
    """The same where the rows (case_id, id, rank, hit) are marked and gold is only counted: ``size`` (case_id, n_gold)."""
    rows = rows.withColumn("hit", F.when(F.col("hit"), 1))
    top = (F.col("rank") <= k) & F.col("hit").isNotNull()
    agg = rows.groupBy("case_id").agg(
        F.count_if(top).alias("hits"),
        F.count_distinct(F.when(top, F.col("id"))).alias("found"),
        F.min(F.when(F.col("hit").isNotNull(), F.col("rank"))).alias("first"),
        F.sum(F.when(top, 1 / F.log2(F.col("rank") + 1))).alias("dcg"),
    )
    agg = agg.join(size, "case_id", "left").withColumn("n", F.coalesce("n_gold", F.lit(0)))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.col("n").cast("int"), F.lit(k)))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    zero = lambda ok, x: F.when(ok, x).otherwise(0.0)
    some = F.col("n") > 0
    return agg.select(
        "case_id",
        F.round(zero(some, F.col("hits") / F.col("n")), 6).alias("recall"),
        zero(some & (F.col("found") == F.col("n")), F.lit(1.0)).alias("bridge"),
        F.round(F.col("hits") / k, 6).alias("precision"),
        (F.col("hits") > 0).alias("hit"),
        F.round(zero(F.col("first").isNotNull(), 1 / F.col("first")), 6).alias("mrr"),
        F.round(zero(some, F.coalesce("dcg", F.lit(0.0)) / ideal), 6).alias("ndcg"),
    )


def accuracy_by(rows: DataFrame, category: str, correct: Column) -> DataFrame:
    """Accuracy of each category and, as category 'all', of everything; an empty category is '?'."""
    c = F.when(F.coalesce(F.col(category), F.lit("")) == "", "?").otherwise(F.col(category))
    rows = rows.select(c.alias("category"), correct.cast("double").alias("ok"))
    out = rows.rollup("category").agg(F.grouping("category").alias("g"), F.count("*").alias("n"), F.round(F.avg("ok"), 6).alias("accuracy"))
    return out.select(F.when(F.col("g") == 1, "all").otherwise(F.col("category")).alias("category"), "n", "accuracy")


def promotion_gate(rows: DataFrame, guards: tuple[float, float] = (0.01, 0.005), weight: float = 2.0) -> DataFrame:
    """One row: the differences of two runs' means, five conditions on them, and whether all hold.

    ``rows`` (new, contradictory, recall, mrr), a row a case and run. The objective is ``weight``
    times the contradictory cases' gain in recall plus the overall one.
    """
    c = F.col("contradictory")
    gain = lambda x, where: F.avg(F.when(F.col("new") & where, F.col(x))) - F.avg(F.when(~F.col("new") & where, F.col(x)))
    d = rows.agg(gain("recall", F.lit(True)).alias("r"), gain("mrr", F.lit(True)).alias("m"), gain("recall", c).alias("cr"), gain("mrr", c).alias("cm"))
    checks = {
        "objective_positive": weight * F.col("cr") + F.col("r") > 0,
        "contradictory_lift": F.col("cr") > 0,
        "overall_lift": F.col("r") > 0,
        "contradictory_mrr_guard": F.col("cm") >= -guards[0],
        "overall_mrr_guard": F.col("m") >= -guards[1],
    }
    told = (("overall_recall_delta", "r"), ("contradictory_recall_delta", "cr"), ("overall_mrr_delta", "m"), ("contradictory_mrr_delta", "cm"))
    every = F.lit(True)
    for ok in checks.values():
        every &= ok
    return d.select(*[F.round(x, 6).alias(n) for n, x in told], *[ok.alias(n) for n, ok in checks.items()], every.alias("promote"))
