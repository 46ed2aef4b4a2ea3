"""Certain and possible aggregates over rows whose membership is in, possible or excluded."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def individuals(rows: DataFrame, by: list[str], label: str, status: str, value: str, order: Column) -> DataFrame:
    """One row an individual: whether any mention is certain, and its value.

    The value is the first certain one, else the first that is there, else 0. Excluded mentions do not count.
    """
    r = rows.where(F.col(status) != "Excluded").withColumn("__o", F.struct(F.when(F.col(status) == "In", 0).otherwise(1), order))
    return r.groupBy(*by, label).agg(F.bool_or(F.col(status) == "In").alias("certain"), F.coalesce(F.min_by(value, F.when(F.col(value).isNotNull(), F.col("__o"))), F.lit(0.0)).alias("amount"))


def count_and_sum(found: DataFrame, by: list[str], digits: int = 2) -> DataFrame:
    """Bounds: from certain individuals alone to all of them."""
    sure = F.col("certain")
    return found.groupBy(*by).agg(
        F.count_if(sure).alias("count_lower"),
        F.count("*").alias("count_upper"),
        F.round(F.coalesce(F.sum(F.when(sure, F.col("amount"))), F.lit(0.0)), digits).alias("sum_lower"),
        F.round(F.sum("amount"), digits).alias("sum_upper"),
    )


def vote_tag(votes: DataFrame, by: list[str], tag: str, order: str) -> DataFrame:
    """in and out together, or half contested: contested. Else the most frequent tag, the first seen among equals."""
    n = votes.groupBy(*by, tag).agg(F.count("*").alias("c"), F.min(order).alias("seen"))
    some = lambda t: F.coalesce(F.sum(F.when(F.col(tag) == t, F.col("c"))), F.lit(0))
    out = n.groupBy(*by).agg(some("in").alias("i"), some("out").alias("o"), some("contested").alias("x"), F.sum("c").alias("n"), F.max_by(tag, F.struct("c", (-F.col("seen")).alias("s"))).alias("mode"))
    verdict = F.when((F.col("i") > 0) & (F.col("o") > 0), "contested").when(F.col("x") * 2 >= F.col("n"), "contested").otherwise(F.col("mode"))
    return out.select(*by, verdict.alias("tag"), F.col("n").alias("votes"))


def null_strict_sum(value: Column) -> Column:
    """Null as soon as one value is missing."""
    return F.when(F.count_if(value.isNull()) > 0, F.lit(None)).otherwise(F.sum(value))


def distinct_value_sums(rows: DataFrame, group: str, order: str, number: str, attribute: str, words: str) -> DataFrame:
    """(group, total, kept, seen): sums in which retold values count once.

    In order, a value with the number and attribute of one that was kept, and a word in
    common with it, is that one told again. The order decides, so sorted rows stream by,
    and only the kept values of a group are held.
    """

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, kept, total, seen = None, {}, 0.0, 0

        def told() -> list[tuple]:
            return [(now, total, sum(map(len, kept.values())), seen)] if seen else []

        for pdf in pdfs:
            out = []
            for g, n, a, ws in zip(pdf["g"], pdf["n"], pdf["a"], pdf["w"], strict=True):
                if g != now:
                    out += told()
                    now, kept, total, seen = g, {}, 0.0, 0
                seen += 1
                same = kept.setdefault((n, a), [])
                if not any(not k.isdisjoint(ws) for k in same):
                    same.append(set(ws))
                    total += n
            yield pd.DataFrame(out, columns=["grp", "total", "kept", "seen"])
        yield pd.DataFrame(told(), columns=["grp", "total", "kept", "seen"])

    ordered = rows.select(F.col(group).cast("long").alias("g"), F.col(order).alias("o"), F.col(number).cast("double").alias("n"), F.col(attribute).alias("a"), F.col(words).alias("w"))
    ordered = ordered.where("g is not null and n is not null and w is not null").repartition("g").sortWithinPartitions("g", "o").drop("o")
    return ordered.mapInPandas(run, "grp long, total double, kept long, seen long")
