"""The driver's tables in the roles of the data model: memories, usage events, edges, messages.

Each adapter is a projection, so filters and column pruning reach the Parquet scan. The
SQL_ constants are the same projections for the SQL oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as memories: type from the language, project from the source, an hour between creations."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id as id",
        "text as content",
        "case when doc_id % 23 = 0 then 'SYSTEM' else upper(lang) end as type",
        "case when doc_id % 7 = 0 then '' else source end as project",
        "concat('s', cast(floor(doc_id / 8) as string)) as session",
        "timestamp '2024-01-01 00:00:00' + make_dt_interval(0, cast(doc_id as int)) as created_at",
        "0.5 + (doc_id % 50) / 100D as confidence",
    )


SQL_MEMORIES = """mem as (select doc_id as id, text as content, case when doc_id % 23 = 0 then 'SYSTEM' else upper(lang) end as type,
  case when doc_id % 7 = 0 then '' else source end as project, 's' || (doc_id // 8)::varchar as session,
  timestamp '2024-01-01 00:00:00' + to_hours(doc_id::int) as created_at, 0.5::double + (doc_id % 50) / 100::double as confidence from documents)"""


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as usage of memories: the user is the memory, the day's third of the hour is the session."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "user_id as memory_id",
        "case event_type when 'view' then 'match' when 'click' then 'inject' when 'purchase' then 'use' when 'error' then 'noise' else 'save' end as kind",
        "concat('d', cast(date_format(ts, 'yyyy-MM-dd') as string)) as session",
        "ts",
        "unix_micros(cast(ts as timestamp)) / 1e6D as epoch",
        "value",
    )


SQL_USAGE = """ev as (select event_id, user_id as memory_id, case event_type when 'view' then 'match' when 'click' then 'inject'
  when 'purchase' then 'use' when 'error' then 'noise' else 'save' end as kind, 'd' || strftime(ts, '%Y-%m-%d') as session, ts,
  epoch_us(ts) / 1e6::double as epoch, value from events)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as bitemporal triples: a customer's order is believed until the next order of the customer."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "o_orderdate", "o_totalprice")
    return o.selectExpr(
        "o_orderkey as id",
        "concat('c', cast(o_custkey as string)) as subject",
        "case o_orderstatus when 'F' then 'causes' when 'O' then 'uses' else 'prevents' end as predicate",
        "o_orderpriority as object",
        "o_orderdate as valid_from",
        "lead(o_orderdate) over (partition by o_custkey, o_orderstatus order by o_orderdate, o_orderkey) as valid_to",
        "case when o_orderkey % 11 = 0 then null else o_orderdate end as occurred_at",
        "o_orderkey % 13 = 0 as dormant",
        "round(o_totalprice / 500000, 4) as confidence",
    )


SQL_EDGES = """kg as (select o_orderkey as id, 'c' || o_custkey::varchar as subject,
  case o_orderstatus when 'F' then 'causes' when 'O' then 'uses' else 'prevents' end as predicate, o_orderpriority as object,
  o_orderdate as valid_from, lead(o_orderdate) over (partition by o_custkey, o_orderstatus order by o_orderdate, o_orderkey) as valid_to,
  case when o_orderkey % 11 = 0 then null else o_orderdate end as occurred_at, o_orderkey % 13 = 0 as dormant,
  round(o_totalprice / 500000, 4) as confidence from orders)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("message_index"), "role", "text")


def compacted(spark: SparkSession, path: str, target: str, bytes_per_file: int = 128 << 20) -> int:
    """Rewrites a Parquet table's small files into files of about ``bytes_per_file`` at ``target``; gives their number."""
    df = spark.read.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    files = max(1, -(-size // bytes_per_file))
    df.repartition(files).write.mode("overwrite").parquet(target)
    return files
