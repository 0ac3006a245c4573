"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the word and line contracts.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a lower-cased text; none for null or blank text."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where it is unset (tests on this machine alone), a folder of it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Folders made by ``written`` and not yet deleted, the latest last.
_FOLDERS: list[str] = []


def written(df: DataFrame, name: str, even: bool = True) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, survives lost executors.

    even: partitions are first evened out to the advisory size, so that small tables are few files; else they are written as
    they are, in order. The files go with ``drop_written`` or when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.hint("rebalance") if even else df).write.parquet(path)
    folder, files = _folder(spark, path)
    files.deleteOnExit(folder)
    _FOLDERS.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _folder(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop_folder(spark: SparkSession, path: str) -> None:
    folder, files = _folder(spark, path)
    files.delete(folder, True)


def written_so_far() -> int:
    """A mark for ``drop_written``."""
    return len(_FOLDERS)


def drop_written(spark: SparkSession, since: int) -> None:
    """Deletes the tables that ``written`` made since a mark; their frames can't be read any more."""
    for path in _FOLDERS[since:]:
        drop_folder(spark, path)
    del _FOLDERS[since:]


def byte_sizes(column):
    """Bytes of each text or binary of an Arrow column, 0 for null."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)


def slices(n: int, sizes, most_rows: int = 256, most_bytes: int = 4 << 20):
    """Ranges of rows with a bounded number of rows and bytes (one row at least)."""
    start = held = 0
    for i in range(n):
        size = int(sizes[i])
        if i > start and (i - start >= most_rows or held + size > most_bytes):
            yield start, i
            start, held = i, 0
        held += size
    if n > start:
        yield start, n
