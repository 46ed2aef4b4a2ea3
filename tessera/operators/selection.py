"""Exact order statistics of groups of any size, by histograms of the values' bits.

A number's 64 bits can be turned so that they sort as the number does. Pass by pass the counts
of the next ``BITS`` bits tell in which bin a wanted rank falls; only rows of that bin go on. So
no pass holds or sorts a group: rows are counted where they are read, and what is shuffled is at
most ``2 ** BITS`` counts a group and wanted rank. Where the bins that are wanted hold at most
``FEW`` rows each, those are put in order; after 64 / BITS passes the bits are the value.

Nulls and NaN don't count; -0.0 counts as 0.0.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.graph import kept, only

BITS = 16
FEW = 200_000
LOW = 0x7FFFFFFFFFFFFFFF


def _bits(values: pd.Series) -> pd.Series:
    raw = (values.astype("float64") + 0.0).to_numpy().view("int64")
    return pd.Series(raw ^ ((raw >> 63) & LOW))


def _value(bits: pd.Series) -> pd.Series:
    raw = bits.to_numpy("int64")
    return pd.Series((raw ^ ((raw >> 63) & LOW)).view("float64"))


def at_ranks(rows: DataFrame, by: list[str], value: str, ranks) -> DataFrame:
    """(by, n, name, x): for each group the values at ranks.

    ``ranks(n)`` makes, from the column of group sizes, {name: rank from 1}; ranks outside the
    group are held at its ends.
    """
    return only(lambda: _at_ranks(rows, by, value, ranks))


def _at_ranks(rows: DataFrame, by: list[str], value: str, ranks) -> DataFrame:
    # null groups are told apart from others by a second column
    keys = [c for i, b in enumerate(by) for c in (F.coalesce(F.col(b).cast("string"), F.lit("")).alias(f"k{i}"), F.col(b).isNull().alias(f"z{i}"))] or [F.lit(0).alias("k0")]
    names = [c for i in range(len(by)) for c in (f"k{i}", f"z{i}")] or ["k0"]
    x = F.col(value).cast("double")
    bits = F.pandas_udf(_bits, "long")
    held = kept(rows.where(x.isNotNull() & ~F.isnan(x)).select(*keys, *[F.col(b).alias(f"b{i}") for i, b in enumerate(by)], bits(x).alias("bits")))
    sizes = held.groupBy(*names).agg(F.count("*").alias("n"), *[F.first(f"b{i}").alias(f"b{i}") for i in range(len(by))])
    told = ranks(F.col("n"))
    wanted = F.array(*[F.struct(F.lit(k).alias("name"), F.greatest(F.lit(1), F.least(r.cast("long"), F.col("n"))).alias("rank")) for k, r in told.items()])
    groups = kept(sizes)
    now = groups.select(*names, F.explode(wanted).alias("w"), F.col("n").alias("c")).select(*names, F.col("w.name").alias("name"), F.col("w.rank").alias("rank"), F.lit(0).cast("long").alias("prefix"), "c")
    read, shift = held.withColumn("prefix", F.lit(0).cast("long")), 64
    while shift and (now.agg(F.max("c")).first()[0] or 0) > FEW:
        shift -= BITS
        counts = read.groupBy(*names, "prefix", F.shiftright("bits", shift).alias("bin")).agg(F.count("*").alias("c"))  # the first pass's bins are signed, as the bits are
        # at most 2 ** BITS bins a group and prefix
        before = F.sum("c").over(Window.partitionBy(*names, "prefix").orderBy("bin")) - F.col("c")
        met = now.drop("c").join(counts.withColumn("before", before), [*names, "prefix"]).where((F.col("rank") > F.col("before")) & (F.col("rank") <= F.col("before") + F.col("c")))
        now = kept(met.select(*names, "name", (F.col("rank") - F.col("before")).alias("rank"), F.col("bin").alias("prefix"), "c"))
        read = held.withColumn("prefix", F.shiftright("bits", shift)).join(now.select(*names, "prefix").distinct(), [*names, "prefix"], "left_semi")
    if shift:
        place = F.row_number().over(Window.partitionBy(*names, "prefix").orderBy("bits"))
        now = now.join(read.withColumn("place", place), [*names, "prefix"]).where("place = rank").select(*names, "name", F.col("bits").alias("prefix"))
    value_of = F.pandas_udf(_value, "double")
    out = now.join(groups, names)
    return out.select(*[F.col(f"b{i}").alias(b) for i, b in enumerate(by)], "n", "name", value_of("prefix").alias("x"))


def percentiles(rows: DataFrame, by: list[str], value: str, ps: dict[str, float], exclusive: bool = False) -> DataFrame:
    """(by, n, a column for each of ``ps``): exact percentiles between neighbours.

    Inclusive: the place is p (n - 1) from 0. Exclusive: p (n + 1) from 1, held inside the
    first and the last pair; groups of fewer than two rows have 0 there.
    """

    def place(p: float, n: Column) -> tuple[Column, Column]:
        """(rank of the lower neighbour, part of the way to the upper one)."""
        at = F.lit(p) * (n + 1) if exclusive else F.lit(p) * (n - 1) + 1
        low = F.greatest(F.lit(1), F.least(F.floor(at), n - 1)) if exclusive else F.floor(at)
        return low, at - low

    def ranks(n: Column) -> dict[str, Column]:
        return {f"{name}:{k}": place(p, n)[0] + k for name, p in ps.items() for k in (0, 1)}

    got = at_ranks(rows, by, value, ranks)
    x = lambda name: F.max(F.when(F.col("name") == name, F.col("x")))
    wide = got.groupBy(*by, "n").agg(*[x(f"{name}:{k}").alias(f"{name}:{k}") for name in ps for k in (0, 1)])
    out = []
    for name, p in ps.items():
        low, high, part = F.col(f"`{name}:0`"), F.col(f"`{name}:1`"), place(p, F.col("n"))[1]
        told = F.when(part == 0, low).otherwise(low + part * (high - low))
        out.append((F.when(F.col("n") < 2, 0.0).otherwise(told) if exclusive else told).alias(name))
    return wide.select(*by, "n", *out)
