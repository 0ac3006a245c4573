"""The corpus pipeline: quality classifier, line dedup, near-duplicate removal, repeated-passage removal, packing.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept and is written as Parquet before the next.
All but the last return the columns of documents; n_chars follows the text. Null texts pass the filters as they are, up to
the removal of passages, which returns them as empty texts (n_chars 0). Rows with a null or repeated doc_id pass each stage
as rows of their own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithoflow.llm import linededup, minhash, packing, quality, queries, suffix
from lithoflow.llm.common import drop_folder, drop_written, shared_dir, table, written, written_so_far

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Stages run Python; no SQL expresses them. tests/llm holds brute-force versions.
ORACLE_SQL = None


def _documents(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = quality.train(docs, quality.grades(table(spark, sf_dir, "labels")))
    return quality.select_documents(docs.select(*COLUMNS), model)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in at least 10 documents go."""
    docs = docs.select(*COLUMNS)
    return _documents(linededup.drop_lines(docs, linededup.line_bitmaps(docs, min_docs=10)))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one of the smallest doc_id. The texts of a repeated doc_id are documents of
    their own, told apart by 64-bit hashes of doc_id and text; equal rows of a doc_id stay or go together."""
    keyed = docs.withColumn("_key", F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text")))
    found = minhash.near_duplicates(keyed, shingle=5, percent=80, id_col="_key").select("id", "component").filter("id IS NOT NULL").distinct()
    found = written(found.join(keyed.select(F.col("_key").alias("id"), "doc_id").distinct(), "id"), "groups")
    first = found.groupBy("component").agg(F.min(F.struct("doc_id", "id")).alias("first")).select(F.col("first.id").alias("id"))
    gone = found.join(first, "id", "left_anti").select(F.col("id").alias("_key"))
    return keyed.join(gone, "_key", "left_anti").select(*COLUMNS)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes and more that a smaller document has go; documents that lose all their text go with them."""
    found = suffix.repeated_passages(docs, span=50, text_out=True, carry=("lang", "source"))
    kept = found.filter("n_removed < n_bytes OR n_bytes = 0")
    return _documents(kept.select(F.col("id").alias("doc_id"), F.col("kept_text").alias("text"), "lang", "source"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    packed = packing.packed_pieces(docs, queries.vocabulary_path())
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality", quality_stage), ("line_dedup", line_stage), ("near_duplicates", near_duplicate_stage), ("suffix_dedup", suffix_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents; each is written to the shared folder and read again.

    Once a stage is written, its input's folder and the tables made on the way are deleted. Packing writes what it reads of its
    input before it returns, so its input goes too; the tables behind the result stay until the session's JVM ends.
    """
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        mark, path = written_so_far(), f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        drop_written(spark, mark)
        if last:
            drop_folder(spark, last)
        docs, last = spark.read.parquet(path), path
    packed = STAGES[-1][1](spark, docs, sf_dir)
    if last:
        drop_folder(spark, last)
    return packed
