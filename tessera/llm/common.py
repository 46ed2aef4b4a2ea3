"""What the corpus operators share: Arrow plumbing, word splitting and written tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Words of ASCII letters, digits and anything beyond ASCII. Taken from UTF-8 bytes,
#: where every byte of a character beyond ASCII is 0x80 or more.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit numbers with their bits spread."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(29))


class Memo(dict):
    """Answers of ``make`` by key, in two generations: what is not asked for while one fills is forgotten.

    Keys of more than 64 characters are not kept, so its size is bounded.
    """

    def __init__(self, make: Callable, size: int):
        super().__init__()
        self.make, self.half, self.old = make, size // 2, {}

    def __missing__(self, key):
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.half:
                self.old = dict(self)
                self.clear()
            self[key] = got
        return got


def folded(text: str | None) -> bytes:
    """UTF-8 of the text with A-Z (and nothing else) lower-cased; null counts as empty."""
    return (text or "").encode("utf-8", "replace").lower()


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall(folded(text))


def bounded_batches(spark: SparkSession) -> None:
    """Texts can be long: what is sent to Python at once is bounded by bytes, not only by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def map_columns(df: DataFrame, columns: list[str], schema: str, task: Callable[[], Callable], rows: int = 1024) -> DataFrame:
    """Runs ``task()`` once a task; what it returns maps lists of input columns to a dict of output columns.

    Only ``columns`` reach Python, so extra columns of the input, however named, cannot clash.
    Batches are cut to ``rows`` rows so that Python holds few texts at once.
    """
    bounded_batches(df.sparkSession)
    spark_schema = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = task()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = each(*[part.column(i).to_pylist() for i in range(part.num_columns)])
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.select(*columns).mapInArrow(run, schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; one of our own only in local sessions where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = at.get() if at.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(found)
    return found


_tables: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{shared_folder(spark).rstrip('/')}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def deleted(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if path in _tables:
        _tables.remove(path)


def forgotten(df: DataFrame) -> None:
    """Deletes a table of ``written`` that nothing reads any more."""
    deleted(df.sparkSession, df._written_at)


@contextmanager
def cleared(spark: SparkSession):
    """Deletes the tables that are ``written`` inside, once the result that reads them is stored."""
    before = set(_tables)
    try:
        yield
    finally:
        for path in [p for p in _tables if p not in before]:
            deleted(spark, path)


def fresh(name: str, columns: list[str]) -> str:
    """A column name that none of ``columns`` has, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def input_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the input's size; works on any source."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
