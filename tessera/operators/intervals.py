"""Overlaps of time intervals within keys of any size, by sweeping sorted ends.

An interval begins at ``s`` and ends before ``e``; two overlap if each begins before the other
ends. All begins and ends of a key are put in order once (``ordered.placed``: a key that holds
most rows is split by range), and running counts tell for each interval how many begin before
its end and how many end by its begin: their difference is the number that it overlaps. So
which rows overlap something is told without a pair. Pairs come from the same counts: an
interval's later partners stand at consecutive places behind it, which are met in buckets of
``BUCKET`` places, so a bucket holds a bounded number of them and the work follows the pairs.

Cases: rows with a null key, id, begin or end overlap nothing, nor do those that end before
they begin; an empty interval overlaps those that it stands inside. Ids tell rows apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import kept
from tessera.operators.ordered import placed

BUCKET = 1024
#: Keys of at most so many rows are joined with themselves: a task's pairs of a key are bounded by its square.
SMALL = 1024
#: Order of events at one time: ends are asked before begins count, and ends count before begins are asked.
ASK_END, BEGIN, END, ASK_BEGIN = range(4)


def usable(rows: DataFrame, key: list[str]) -> DataFrame:
    rows = rows.where("id is not null and s is not null and e is not null and s <= e")
    for k in key:
        rows = rows.where(F.col(k).isNotNull())
    return rows


def by_size(rows: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """The usable rows of keys of at most ``SMALL`` rows, and those of larger ones, None if there are none."""
    rows = usable(rows, key)
    large = kept(rows.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > SMALL).select(*key))
    if large.isEmpty():
        return rows, None
    return rows.join(large, key, "left_anti"), rows.join(large, key, "left_semi")


def joined_pairs(rows: DataFrame, key: list[str], other: str) -> DataFrame:
    """``overlapping_pairs`` by a plain join, for keys of few rows."""
    then = rows.select(*key, F.col("id").alias("id2"), F.col(other).alias("other2"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    met = rows.join(then, key).where("id < id2 and s < e2 and s2 < e")
    return met.select("id", "id2", F.col(other).alias("other"), "other2")


def _swept(rows: DataFrame, key: list[str], side: str | None) -> DataFrame:
    """Each row's events, with the begins and ends of each side that stand before them in the key."""
    event = lambda kind, at: F.struct(F.lit(kind).alias("kind"), F.col(at).alias("at"))
    rows = usable(rows, key).withColumn("event", F.explode(F.array(event(ASK_END, "e"), event(BEGIN, "s"), event(END, "e"), event(ASK_BEGIN, "s")))).select("*", "event.kind", "event.at").drop("event")
    own = F.lit(0) if side is None else F.col(side)
    running = {}
    for k in (0,) if side is None else (0, 1):
        for name, kind in (("begun", BEGIN), ("ended", END)):
            running[f"{name}{k}"] = ((F.col("kind") == kind) & (own == k)).cast("long")
    return placed(rows, key, [F.col("at"), F.col("kind"), F.col("id")], running)


def overlap_counts(rows: DataFrame, key: list[str], side: str | None = None) -> DataFrame:
    """(id, n): how many other intervals of its key each of ``rows`` (id, key, s, e) overlaps; with ``side`` (0 or 1) those of the other side."""
    swept = _swept(rows, key, side)
    own = F.lit(0) if side is None else F.col(side)
    other = lambda name: F.col(f"{name}0") if side is None else F.when(own == 1, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))
    told = swept.where(F.col("kind").isin(ASK_END, ASK_BEGIN)).groupBy("id", *key, "s", "e", own.alias("own_side")).agg(
        F.sum(F.when(F.col("kind") == ASK_END, other("begun")).otherwise(-other("ended"))).alias("n")
    )
    # empty intervals at one time end by each other's begin, though none began before: they are given back
    flat = usable(rows, key).where("s = e").groupBy(*key, "s", own.alias("flat_side")).agg(F.count("*").alias("flat"))
    flat = flat.withColumn("flat_side", F.lit(0) if side is None else 1 - F.col("flat_side")).withColumnRenamed("s", "at")
    told = told.join(flat, [told[k] == flat[k] for k in key] + [told["s"] == flat["at"], told["e"] == flat["at"], told["own_side"] == flat["flat_side"]], "left")
    mine = F.lit(0) if side is not None else F.when(F.col("s") < F.col("e"), 1).otherwise(0)
    return told.select("id", (F.col("n") + F.coalesce("flat", F.lit(0)) - mine).alias("n"))


def overlapping_pairs(rows: DataFrame, key: list[str], other: str) -> DataFrame:
    """(id, id2, other, other2): each overlapping pair of a key once, in any order of its two rows."""
    swept = _swept(rows, key, None).where(F.col("kind").isin(ASK_END, BEGIN))
    at = swept.groupBy("id", *key, other, "s", "e").agg(F.max(F.when(F.col("kind") == BEGIN, F.col("begun0"))).alias("place"), F.max(F.when(F.col("kind") == ASK_END, F.col("begun0"))).alias("reach"))
    at = kept(at)
    bucket = lambda place: F.floor((place - 1) / BUCKET)
    first = at.where("reach > place").withColumn("bucket", F.explode(F.sequence(bucket(F.col("place") + 1), bucket(F.col("reach")))))
    then = at.select(*key, bucket(F.col("place")).alias("bucket"), F.col("id").alias("id2"), F.col(other).alias("other2"), F.col("place").alias("place2"), F.col("e").alias("e2"))
    met = first.join(then, [*key, "bucket"]).where("place2 > place and place2 <= reach and e2 > s")
    return met.select("id", "id2", F.col(other).alias("other"), "other2")
