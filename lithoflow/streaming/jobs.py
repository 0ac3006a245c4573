"""Streaming counterparts of the job queue and the review gate (X01-X04): an extension, on Structured Streaming.

Files that arrive are parsed into blocks; back-pressure is the number of files a trigger takes. Regions that need review wait
for their decision in a stream-stream join; what is decided in time goes on, the rest is late and ends as expired.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.blocks import blocks_of


def arriving_sources(spark: SparkSession, path: str, most_files: int = 8) -> DataFrame:
    """New files of a folder as sources, at most most_files a trigger."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", most_files).load(path)
    name = F.regexp_extract("path", r"[^/]+$", 0)
    return files.select(name.alias("source_id"), name.alias("file_name"), "content", "modificationTime")


def start_ingest(sources: DataFrame, out: str, checkpoint: str):
    """Blocks and issues of arriving sources, appended once each; the query to wait for."""
    blocks = blocks_of(sources)
    return blocks.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def decided(pending: DataFrame, decisions: DataFrame, wait: str = "1 day") -> DataFrame:
    """Pending (task_id, region_id, asked timestamp) with decisions (task_id, region_id, action, at timestamp).

    State is bounded by the watermarks: what is not decided within ``wait`` comes out with action 'expired'.
    """
    left = pending.withWatermark("asked", wait).alias("p")
    right = decisions.withWatermark("at", wait).alias("d")
    on = (F.col("p.task_id") == F.col("d.task_id")) & (F.col("p.region_id") == F.col("d.region_id")) & (F.col("d.at") >= F.col("p.asked")) & (F.col("d.at") <= F.col("p.asked") + F.expr(f"INTERVAL {wait}"))
    joined = left.join(right, on, "left_outer")
    return joined.select("p.task_id", "p.region_id", "p.asked", F.coalesce("d.action", F.lit("expired")).alias("action"))


def attempts_per_window(calls: DataFrame, window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Calls and failures of each block and window of (block_id, at, outcome)."""
    return calls.withWatermark("at", late).groupBy(F.window("at", window), "block_id").agg(F.count(F.lit(1)).alias("n_calls"), F.count_if(F.col("outcome") != "success").alias("n_failed"))
