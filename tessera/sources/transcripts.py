"""Session transcripts: JSON lines and Markdown, read tolerantly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ENTRY = "type string, role string, content string, message struct<role: string, content: string>"


def parse_jsonl(lines: DataFrame) -> DataFrame:
    """Adds role and text to rows with a JSON line in ``value``; other lines, and empty texts, go."""
    e = F.from_json("value", ENTRY)
    rows = lines.withColumn("e", e).withColumn("role", F.coalesce("e.message.role", "e.role", "e.type")).withColumn("text", F.coalesce("e.message.content", "e.content"))
    return rows.where("role in ('user', 'assistant') and trim(text) <> ''").drop("e", "value")


def read_jsonl(spark: SparkSession, path: str, max_bytes: int = 50_000_000) -> DataFrame:
    """(transcript_path, message_index, role, text) of a folder of JSON-lines files; larger files are passed over."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("transcript_path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    rows = parse_jsonl(lines.where(F.col("size") <= max_bytes))
    w = Window.partitionBy("transcript_path").orderBy("block", "at")
    return rows.select("transcript_path", (F.row_number().over(w) - 1).alias("message_index"), "role", "text")


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """Sections of ``## User`` and ``## Assistant`` as messages."""
    docs = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("transcript_path"), "value")
    parts = docs.select("transcript_path", F.posexplode(F.split("value", r"(?m)^##\s+")).alias("message_index", "part")).where("message_index > 0")
    role = F.lower(F.regexp_extract("part", r"^(\w+)", 1))
    return parts.select("transcript_path", F.col("message_index") - 1, role.alias("role"), F.regexp_replace("part", r"^\w+[^\n]*\n?|\s+$", "").alias("text")).where("role in ('user', 'assistant') and text <> ''").toDF("transcript_path", "message_index", "role", "text")


def replace_transcripts(rows: DataFrame, path: str) -> None:
    """Writes messages so that a transcript's partition replaces its former rows."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("transcript_path").parquet(path)


def read_results_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An append-only JSON-lines log; malformed lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_results(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)
