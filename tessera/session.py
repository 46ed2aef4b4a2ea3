"""Session settings that results depend on, and a factory for local sessions."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Spark 4.1 takes a union of equally partitioned inputs for partitioned and leaves out the
#: exchange behind it; where adaptive execution then reads the inputs with different partitions,
#: groups come out in parts. The union's partitioning is not relied upon here.
SETTINGS = {"spark.sql.unionOutputPartitioning": "false"}


def settled(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def bounded(spark: SparkSession) -> SparkSession:
    """Batches sent to Python hold bounded bytes: rows of long texts would make them as large as their number allows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)
    return spark


def local(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tessera") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app).config("spark.sql.shuffle.partitions", shuffle_partitions)
    return settled(builder.config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate())


def shipped(spark: SparkSession) -> SparkSession:
    """Sends this package's sources to the executors, once a context: they need not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return spark
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="tessera-")) / "tessera-src.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(path))
    sc._tessera_shipped = True
    return spark
