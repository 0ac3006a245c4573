"""Tables between stages: written to the folder that all executors share, and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The most rows of a frame that ``small`` broadcasts.
MOST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, as in tests on this machine alone, a folder of it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(rows: DataFrame, name: str) -> DataFrame:
    """rows as a table of its own: cuts lineage and plan, survives lost executors; gone when the session's JVM ends."""
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    rows.hint("rebalance").write.parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(rows.schema).parquet(path)


def small(*frames: DataFrame) -> list[DataFrame]:
    """The frames, with a broadcast hint if they hold at most ``MOST_ROWS`` rows in all; beyond that, joins shuffle."""
    counted = sum(f.limit(MOST_ROWS + 1).count() for f in frames)
    return [F.broadcast(f) for f in frames] if counted <= MOST_ROWS else list(frames)
