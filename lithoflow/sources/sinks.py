"""Sinks: rendered text, traces, schemas."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def write_texts(texts: DataFrame, path: str) -> None:
    """(case_id, text) as Parquet, partitioned by nothing: one row a case, committed as a whole."""
    texts.select("case_id", "text").write.mode("append").parquet(path)


def schema_json(schema: StructType) -> str:
    """A schema with sorted keys, indented, ending in a newline."""
    return json.dumps(schema.jsonValue(), indent=2, sort_keys=True, ensure_ascii=False) + "\n"


def append_traces(calls: DataFrame, path: str) -> None:
    """Calls are appended; Spark's commit makes a run's calls visible together."""
    calls.write.mode("append").parquet(path)


def trace_summary(calls: DataFrame) -> DataFrame:
    """Counts, tokens and duration of each case's calls."""
    return calls.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n_calls"), F.count_if(F.col("outcome") == "success").alias("n_success"), F.count_if(F.col("retry_of").isNotNull()).alias("n_retries"),
        F.sum(F.coalesce("input_tokens", F.lit(0))).alias("input_tokens"), F.sum(F.coalesce("output_tokens", F.lit(0))).alias("output_tokens"), F.round(F.sum("seconds"), 3).alias("seconds"),
    )


def lineage(calls: DataFrame, chain: list[str], order: str) -> DataFrame:
    """The calls of a chain (a block, a role) numbered from 1, each with the call that it repeats."""
    window = Window.partitionBy(*chain).orderBy(order)
    return calls.withColumn("retry_of", F.lag(order).over(window)).withColumn("attempt", F.row_number().over(window))


def review_summary(decisions: DataFrame) -> DataFrame:
    """A08."""
    return decisions.groupBy("case_id").agg(*[F.count_if(F.col("action") == a).alias(f"n_{a}") for a in ("include", "exclude", "accept")])


def mark_latest(calls: DataFrame, outcomes: DataFrame, context: list[str], order: str) -> DataFrame:
    """Calls with the outcome and error_code that outcomes has for their context (one row each) on its latest call alone."""
    last = Window.partitionBy(*context)
    told = calls.withColumn("_last", F.max(order).over(last)).join(outcomes.select(*context, F.col("outcome").alias("_outcome"), F.col("error_code").alias("_error")), context, "left")
    latest = (F.col(order) == F.col("_last")) & F.col("_outcome").isNotNull()
    return told.withColumn("outcome", F.when(latest, F.col("_outcome")).otherwise(F.col("outcome"))).withColumn("error_code", F.when(latest, F.col("_error")).otherwise(F.col("error_code"))).drop("_last", "_outcome", "_error")
