"""Line deduplication with DataFrame functions only.

Lines are reduced to keys (128-bit hashes of the trimmed, lower-cased line), range-partitioned on (key, document) -- the
composite range splits a key that a third of all rows hold over several partitions -- and sorted by position within. A
window streams over the sorted ranges and marks each document's first line of a key; only these are counted, in each range
first. Decisions go back to the ranges by (key, range), so that lines of a hot key stay spread, and from there to documents
as run-length compressed keep bitmaps (eight lines a byte; bytes that lose nothing are left out), never as text.

Defined cases: an empty table has no bitmaps; null or empty text is one empty line; keys shorter than ``min_chars`` code points are never dropped; rows
with a null doc_id count as one document and get no bitmap; rows of one doc_id count as one document, each text with a bitmap
of its own; extra columns are ignored by ``line_bitmaps`` and kept by ``drop_lines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, lower_ascii, written


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(SPACES)))


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def text_hash(text: Column) -> Column:
    """Tells the texts of one document apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1) -> DataFrame:
    """(doc, body, pos, key) for every line whose key has at least min_chars code points."""
    lines = docs.select(F.col(id_col).alias("doc"), text_hash(F.col(text_col)).alias("body"), F.posexplode(text_lines(F.col(text_col))).alias("pos", "line"))
    return (
        lines.select("doc", "body", "pos", line_key(F.col("line")).alias("k"))
        .filter(F.length("k") >= min_chars)
        .select("doc", "body", "pos", F.unhex(F.md5("k")).alias("key"))
    )


def ordered_lines(found: DataFrame) -> DataFrame:
    """Lines range-partitioned by (key, document) and sorted by position within, each with its range (part) and its turn among the
    document's lines of that key. One exchange: the window runs over the ranges as they are."""
    ranges = found.repartitionByRange("key", "doc")
    turn = F.row_number().over(Window.partitionBy("key", "doc").orderBy("pos", "body"))
    return ranges.withColumn("turn", turn).withColumn("part", F.spark_partition_id())


def common_keys(ordered: DataFrame, min_docs: int, keep_first: bool = False) -> DataFrame:
    """(key, part, first) of keys found in at least min_docs documents, a row for each range that holds lines of the key.

    A document's first line of a key stands for the document. Counts are partial in each range, so a key costs one row a
    range; the ranges of a key follow one another. first: its first (document, position, hash of the text), if wanted.
    """
    firsts = ordered.filter("turn = 1")
    facts = [F.count(F.lit(1)).alias("n_docs"), F.min("part").alias("low"), F.max("part").alias("high")]
    if keep_first:
        facts.append(F.min(F.struct("doc", "pos", "body")).alias("first"))
    counted = firsts.groupBy("key").agg(*facts).filter(F.col("n_docs") >= min_docs)
    return counted.select("key", F.explode(F.sequence("low", "high")).alias("part"), *["first"] * keep_first)


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """(doc, body, keep) for texts (body: their hash) that lose a line: keep is a run-length compressed bitmap, an array of (byte,
    n, gone): n bytes from byte on lose the bits of gone, where bit 7 of byte 0 is line 0. Bytes not named lose nothing.

    A key found in at least min_docs documents loses all its lines; with keep_first, all but the first occurrence in
    (document, position, hash of the text) order.
    """
    found = written(line_occurrences(docs, id_col, text_col, min_chars), "lines")  # texts are cut into lines once
    ordered = written(ordered_lines(found), "ordered", even=False)
    common = written(common_keys(ordered, min_docs, keep_first), "common")
    lost = ordered.join(common, ["key", "part"])
    if keep_first:
        lost = lost.filter(~F.struct("doc", "pos", "body").eqNullSafe(F.col("first")))
    own = lost.select("doc", "body", "pos").repartition("doc", "body")  # the one exchange of all that follows
    bytes_ = own.groupBy("doc", "body", F.expr("pos div 8").alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, 7 - pos % 8)")).alias("gone"))
    run = F.col("byte") - F.row_number().over(Window.partitionBy("doc", "body", "gone").orderBy("byte"))
    runs = bytes_.withColumn("run", run).groupBy("doc", "body", "gone", "run").agg(F.min("byte").alias("byte"), F.count(F.lit(1)).alias("n"))
    return runs.groupBy("doc", "body").agg(F.sort_array(F.collect_list(F.struct("byte", "n", "gone"))).alias("keep"))


def drop_lines(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text reduced to its kept lines (joined by newline), and n_lines and n_dropped added as _n_lines, _n_dropped."""
    own = (F.col(id_col) == F.col("_doc")) & (text_hash(F.col(text_col)) == F.col("_body"))
    joined = docs.join(bitmaps.select(F.col("doc").alias("_doc"), F.col("body").alias("_body"), F.col("keep").alias("_keep")), own, "left")
    lines = text_lines(F.col(text_col))
    kept = F.filter(F.col("_lines"), lambda line, i: F.coalesce(F.get(F.col("_bits"), i) != "0", F.lit(True)))
    return (
        joined.withColumn("_lines", lines)
        .withColumn("_bits", bit_string(F.col("_keep")))
        .withColumn("_kept", F.when(F.col("_keep").isNull(), F.col("_lines")).otherwise(kept))
        .withColumn(text_col, F.when(F.col("_keep").isNull(), F.col(text_col)).otherwise(F.array_join("_kept", "\n")))
        .withColumn("_n_lines", F.size("_lines").cast("long"))
        .withColumn("_n_dropped", (F.size("_lines") - F.size("_kept")).cast("long"))
        .drop("_doc", "_body", "_keep", "_lines", "_bits", "_kept")
    )


def bit_string(keep: Column) -> Column:
    """An array of '0' (lost) and '1', one for each line up to the bitmap's last named byte."""
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(keep, i - 1)["byte"] + F.get(keep, i - 1)["n"])
    own = lambda x: F.repeat(F.lpad(F.bin(F.lit(255) - x["gone"]), 8, "0"), x["n"].cast("int"))
    spelt = F.transform(keep, lambda x, i: F.concat(F.repeat(F.lit("11111111"), (x["byte"] - before(i)).cast("int")), own(x)))
    return F.filter(F.split(F.array_join(spelt, ""), ""), lambda c: c != "")
