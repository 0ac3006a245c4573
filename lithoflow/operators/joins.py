"""Joins with the engine's null, guard and nearest-row rules."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left_anti") -> DataFrame:
    """A join on keys where null equals null; <=> is hashed, so it stays an equi join."""
    r = right.select(*[F.col(c).alias(f"_r_{c}") for c in on])
    return left.join(r, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on]), how)


def divided(rows: DataFrame, key: str, item: str, wanted: Sequence[str]) -> DataFrame:
    """P11, relational division: keys that have every wanted item."""
    return rows.filter(F.col(item).isin(list(wanted))).groupBy(key).agg(F.count_distinct(item).alias("n")).filter(F.col("n") == len(set(wanted))).select(key)


def unmatched(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Keys of one side only, and which side."""
    a = left.select(on).distinct().withColumn("in_left", F.lit(True))
    b = right.select(on).distinct().withColumn("in_right", F.lit(True))
    both = a.join(b, on, "full").filter("in_left IS NULL OR in_right IS NULL")
    return both.select(on, F.when(F.col("in_left").isNull(), "left").otherwise("right").alias("missing_in"))


def guarded_missing(rows: DataFrame, key: str, required: Column, guard: Column) -> DataFrame:
    """Keys without a row that meets ``required``, among keys all of whose rows meet ``guard``."""
    return rows.groupBy(key).agg(F.bool_or(required).alias("has"), F.bool_and(guard).alias("all")).filter("all AND NOT has").select(key)


def preceding(rows: DataFrame, key: str, order: Sequence[str], column: str, when: Column) -> Column:
    """The column in the last row of the key, before this one, that meets ``when``."""
    window = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.last(F.when(when, F.col(column)), ignorenulls=True).over(window)


def carried(key: str, order: Sequence[str], value: Column) -> Column:
    """The last non-null value up to this row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def block_of_metadata(key: str, order: Sequence[str], kind: Column) -> Column:
    """The number of the run of rows a row belongs to; a run ends with a block or a reset, so the metadata of a run is
    that of the block which ends it, and of none if a reset does."""
    ended = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(kind.isin("block", "reset").cast("int")).over(ended), F.lit(0))


def extent(cells: DataFrame, keys: Sequence[str], row: str, column: str, value: str) -> DataFrame:
    """(keys, top, bottom, first, last, n_cells): the rectangle around the non-null cells of each grid."""
    held = cells.filter(F.col(value).isNotNull())
    return held.groupBy(*keys).agg(F.min(row).alias("top"), F.max(row).alias("bottom"), F.min(column).alias("first"), F.max(column).alias("last"), F.count(F.lit(1)).alias("n_cells"))


def overlap(ax0, ay0, ax1, ay1, bx0, by0, bx1, by1) -> Column:
    """the shared area as a part of the first box's area (at least 1)."""
    w = F.greatest(F.least(ax1, bx1) - F.greatest(ax0, bx0), F.lit(0.0))
    h = F.greatest(F.least(ay1, by1) - F.greatest(ay0, by0), F.lit(0.0))
    return w * h / F.greatest((ax1 - ax0) * (ay1 - ay0), F.lit(1.0))


def in_cells(rows: DataFrame, spans: Sequence[tuple[str, str, str]], size: float) -> DataFrame:
    """rows once for every cell that they touch: for each (low, high, name), column name counts cells of a size between two columns.

    Joining two such tables on the cells turns an overlap join into an equi join; rows that share several cells meet in each.
    """
    for low, high, name in spans:
        first, last = F.floor(F.col(low) / size), F.floor(F.greatest(F.col(low), F.col(high)) / size)
        rows = rows.withColumn(name, F.explode(F.sequence(first, last)))
    return rows


def tolerant(a: Column, b: Column, relative: float = 1e-9, absolute: float | Column = 1e-12) -> Column:
    """Equal within the larger of a relative and an absolute tolerance."""
    bound = F.greatest(relative * F.greatest(F.abs(a), F.abs(b)), absolute if isinstance(absolute, Column) else F.lit(absolute))
    return F.abs(a - b) <= bound


def structural_diff(before: DataFrame, after: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(keys, path, before, after, change) of fields that differ, values as text."""

    def flat(df: DataFrame, name: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(f).alias("path"), F.col(f).cast("string").alias(name)) for f in fields])
        return df.select(*keys, F.explode(pairs).alias("x")).select(*keys, "x.*", F.lit(True).alias(f"has_{name}"))

    joined = flat(before, "before").join(flat(after, "after"), [*keys, "path"], "full")
    change = F.when(F.col("has_before").isNull(), "added").when(F.col("has_after").isNull(), "removed").otherwise("changed")
    return joined.filter(~F.col("before").eqNullSafe(F.col("after")) | F.col("has_before").isNull() | F.col("has_after").isNull()).select(*keys, "path", "before", "after", change.alias("change"))
