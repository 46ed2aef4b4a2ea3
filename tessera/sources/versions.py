"""A keyed Parquet table that is changed by copying what a change touches.

Rows stand in buckets of their key's hash, a folder each. A version is a small file that names
every bucket's folder; a change writes new folders for the buckets it touches and then the next
version's file, so readers see the old version or the new one, untouched files stay as they are,
and a crash in between leaves the old version (its unread folders go with ``vacuum``). A change
has a name; one that a version already holds is not applied again.

One writer at a time: two that write the same version number cannot both succeed.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.graph import kept


@dataclass(frozen=True)
class Versioned:
    path: str
    key: tuple[str, ...]
    schema: str
    buckets: int = 64
    #: Names of applied changes that a version remembers.
    remembered: int = 1000

    def _fs(self, spark: SparkSession):
        at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(spark._jsc.hadoopConfiguration()), lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def version(self, spark: SparkSession) -> dict:
        """The newest version: its number, {bucket: folder}, folders that only grow, and applied changes."""
        fs, at = self._fs(spark)
        found = [f.getPath().getName() for f in fs.globStatus(at("v*.json")) or []]
        if not found:
            return {"number": 0, "folders": {}, "log": [], "applied": []}
        name = max(found, key=lambda n: int(n[1:-5]))
        stream = fs.open(at(name))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def bucket(self):
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def read(self, spark: SparkSession, buckets: list[int] | None = None) -> DataFrame:
        folders = self.version(spark)["folders"]
        paths = [f"{self.path}/{f}" for b, f in folders.items() if buckets is None or int(b) in buckets]
        if not paths:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(*paths)

    def log(self, spark: SparkSession, schema: str) -> DataFrame:
        paths = [f"{self.path}/{f}" for f in self.version(spark)["log"]]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def _commit(self, spark: SparkSession, before: dict, folders: dict, log: list[str], change: str) -> None:
        after = {"number": before["number"] + 1, "folders": before["folders"] | folders, "log": before["log"] + log, "applied": [*before["applied"], change][-self.remembered :]}
        fs, at = self._fs(spark)
        aside, place = at(f"_{uuid.uuid4().hex}"), at(f"v{after['number']}.json")
        stream = fs.create(aside, False)
        stream.write(bytearray(json.dumps(after).encode()))
        stream.close()
        if fs.exists(place) or not fs.rename(aside, place):
            fs.delete(aside, False)
            raise RuntimeError(f"another writer made version {after['number']} of {self.path}")

    def _write(self, spark: SparkSession, rows: DataFrame, buckets: list[int]) -> dict[str, str]:
        """New folders for the buckets; a bucket without rows has an empty one."""
        home = f"data/{uuid.uuid4().hex}"
        types = spark.createDataFrame([], self.schema).schema
        named = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in types])
        at = F.col("bucket_")
        named.withColumn("bucket_", self.bucket()).repartition(at).write.partitionBy("bucket_").parquet(f"{self.path}/{home}")
        fs, of = self._fs(spark)
        out = {}
        for b in buckets:
            folder = f"{home}/bucket_={b}"
            if not fs.exists(of(folder)):
                fs.mkdirs(of(folder))
            out[str(b)] = folder
        return out

    def touched(self, keys: DataFrame) -> list[int]:
        """The buckets of keys, at most ``buckets`` numbers."""
        return [r[0] for r in keys.select(self.bucket().alias("b")).distinct().collect()]

    def change(self, spark: SparkSession, keys: DataFrame, make, name: str) -> bool:
        """Applies ``make(rows)`` -> (rows, log rows or None) to the buckets of ``keys``; False if ``name`` was applied before."""
        before = self.version(spark)
        if name in before["applied"]:
            return False
        buckets = self.touched(keys)
        old = self.read(spark, buckets)
        new, told = make(old)
        folders = self._write(spark, new, buckets)
        log = []
        if told is not None:
            log = [f"log/{uuid.uuid4().hex}"]
            told.write.parquet(f"{self.path}/{log[0]}")
        self._commit(spark, before, folders, log, name)
        return True

    def replace(self, spark: SparkSession, rows: DataFrame, keys: DataFrame, name: str) -> bool:
        """The rows of ``keys`` become ``rows``."""
        on = list(self.key)

        def make(old):
            match = [old[k].eqNullSafe(keys[k]) for k in on]
            stay = old.join(keys, match, "left_anti")
            return stay.unionByName(rows.select(*old.columns)), None

        return self.change(spark, keys, make, name)

    def vacuum(self, spark: SparkSession) -> int:
        """Deletes folders that the newest version doesn't name, and older versions; gives the number of folders."""
        now = self.version(spark)
        fs, at = self._fs(spark)
        held, n = {*now["folders"].values(), *now["log"]}, 0
        for pattern in ("data/*/bucket_=*", "log/*"):
            for f in fs.globStatus(at(pattern)) or []:
                name = "/".join(f.getPath().toString().split("/")[-1 - pattern.count("/") :])
                if name not in held:
                    fs.delete(f.getPath(), True)
                    n += 1
        for f in fs.globStatus(at("v*.json")) or []:
            if int(f.getPath().getName()[1:-5]) < now["number"]:
                fs.delete(f.getPath(), False)
        return n


BELIEFS = "id long, subject string, predicate string, object string, valid_from timestamp, valid_to timestamp"
AUDIT = "change string, seq long, op string, id long, at timestamp"


def believe(spark: SparkSession, table: Versioned, changes: DataFrame, name: str) -> bool:
    """Adds, supersedes and invalidates beliefs (BELIEFS, keyed by subject); False if ``name`` was applied before.

    ``changes`` (seq, op, id, subject, predicate, object, at): ``add`` puts an open belief in;
    ``supersede`` does so and closes, at its time, what is believed of its subject and predicate;
    ``invalidate`` closes the belief ``id`` of the subject. Changes of a batch hold in the order
    of ``seq``. What was closed and put in is told in the log (AUDIT); what changes nothing is not.
    """
    told = changes.select(F.col("seq").cast("long").alias("seq"), "op", F.col("id").cast("long").alias("id"), "subject", "predicate", "object", F.col("at").cast("timestamp").alias("at"))

    def make(old: DataFrame):
        key = ["subject", "predicate"]
        closing = F.when(F.col("op") == "supersede", F.struct("seq", "at"))
        following = Window.partitionBy(*key).orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
        news = told.where("op in ('add', 'supersede')").withColumn("over", F.first(closing, ignorenulls=True).over(following))
        news = news.select("id", "subject", "predicate", "object", F.col("at").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"), "seq", "over")
        first = told.where("op = 'supersede'").groupBy(*key).agg(F.min(F.struct("seq", "at")).alias("over"))
        olds = old.join(first, [old[k].eqNullSafe(first[k]) for k in key], "left").select(old["*"], F.lit(-1).cast("long").alias("seq"), "over")
        gone = told.where("op = 'invalidate'").groupBy("subject", "id").agg(F.array_sort(F.collect_list(F.struct("seq", "at"))).alias("gone"))  # a belief's own
        rows = olds.unionByName(news).join(gone, ["subject", "id"], "left")
        later = F.try_element_at(F.filter("gone", lambda x: x["seq"] > F.col("seq")), F.lit(1))
        # the first later change that closes an open belief
        rows = rows.withColumn("by", F.when(F.col("valid_to").isNull(), F.least("over", later)))
        rows = kept(rows.drop("over", "gone"))
        closed = rows.where("by is not null").select(F.lit("close").alias("op"), "id", "by.seq", "by.at")
        added = rows.where("seq >= 0").select(F.lit("insert").alias("op"), "id", "seq", F.col("valid_from").alias("at"))
        log = closed.unionByName(added).select(F.lit(name).alias("change"), "seq", "op", "id", "at")
        return rows.withColumn("valid_to", F.coalesce("valid_to", "by.at")).drop("seq", "by"), log

    return table.change(spark, told.select("subject").distinct(), make, name)
