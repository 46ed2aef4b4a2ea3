"""Places and running sums in groups of any size.

A window over a group sorts the whole group in one task. Here the rows are split by range of
(group, order), so a large group stands in several partitions; each counts and adds its own
rows, and what the partitions before it hold of the group is added from a table of one row a
group and partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.filters import fresh_name
from tessera.operators.graph import kept


def placed(rows: DataFrame, by: list[str], order: list[Column], running: dict[str, Column] | None = None) -> DataFrame:
    """The rows with ``place`` (from 1), ``group_size``, and a running sum for each of ``running``.

    ``order`` must tell all rows of a group apart. The rows are written once, as they are
    split by sampled bounds.
    """
    running = running or {}
    part = fresh_name("part", rows.columns)
    for name, value in running.items():
        rows = rows.withColumn(name, value)
    split = kept(rows.repartitionByRange(*[F.col(c) for c in by], *order).withColumn(part, F.spark_partition_id()))
    totals = split.groupBy(*by, part).agg(F.count("*").alias("n"), *[F.sum(c).alias(f"of_{c}") for c in running])
    before = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = totals.select(*by, part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"), F.sum("n").over(whole).alias("group_size"), *[F.coalesce(F.sum(f"of_{c}").over(before), F.lit(0)).alias(f"before_{c}") for c in running])
    within = Window.partitionBy(*by, part).orderBy(*order)
    own = split.withColumn("place", F.row_number().over(within))
    for c in running:
        own = own.withColumn(c, F.sum(c).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    on = [own[c].eqNullSafe(offsets[c]) for c in (*by, part)]
    out = own.join(offsets, on)
    kept_columns = [own[c] for c in rows.columns if c not in running]
    return out.select(*kept_columns, *[(own[c] + offsets[f"before_{c}"]).alias(c) for c in running], (own["place"] + offsets["n_before"]).alias("place"), offsets["group_size"])
