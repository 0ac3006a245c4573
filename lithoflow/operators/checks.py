"""Checks that yield issue rows: constraints, duplicates, order, levels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LAYERS = ["schema", "ontology", "domain", "export"]
RULES = [("minimum", "<"), ("maximum", ">"), ("exclusive_minimum", "<="), ("exclusive_maximum", ">=")]


def layer_level(layer: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, LAYERS)), layer).cast("int")


def violated(value: Column, concept: Column, constraints: dict[str, dict[str, float]]) -> Column:
    """The first failing rule of the concept, in the order minimum, maximum and their exclusive forms; else null."""
    out = F.lit(None).cast("string")
    for name, rules in constraints.items():
        chain = F
        for rule, sign in RULES:
            if rule in rules:
                limit = F.lit(float(rules[rule]))
                failed = {"<": value < limit, ">": value > limit, "<=": value <= limit, ">=": value >= limit}[sign]
                chain = chain.when(failed, F.lit(rule))
        if chain is not F:
            out = F.when(concept == name, chain).otherwise(out)
    return out


def duplicated(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of more than one row and their count."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def duplicate_coordinates(rows: DataFrame, key: str, coordinate: str) -> DataFrame:
    """A03."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(coordinate).alias("n_distinct")).filter("n <> n_distinct")


def too_few(owners: DataFrame, points: DataFrame, key: str, least: int) -> DataFrame:
    """Owners with fewer points than least, those without any included."""
    counts = points.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return owners.select(key).join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n")).filter(F.col("n") < least)


def _breaks(rows: DataFrame, key: str, order: Sequence[str], value: str, broken) -> DataFrame:
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_b", before).filter(broken(F.col("_b"), F.col(value))).groupBy(key).agg(F.count(F.lit(1)).alias("n_breaks"))


def not_increasing(rows: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """Keys whose value does not strictly increase in stored order."""
    return _breaks(rows, key, order, value, lambda a, b: a >= b)


def falling(rows: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """Keys whose value falls somewhere along the order."""
    return _breaks(rows, key, order, value, lambda a, b: a > b)


def rising(rows: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    return _breaks(rows, key, order, value, lambda a, b: a < b)


def short_circuit(issues: DataFrame) -> DataFrame:
    """A case's issues up to its first level with an error."""
    level = layer_level(F.col("layer"))
    first = issues.filter("severity = 'error'").groupBy("case_id").agg(F.min(level).alias("_first"))
    return issues.join(first, "case_id", "left").filter(F.col("_first").isNull() | (level <= F.col("_first"))).drop("_first")


def ordered_issues(issues: DataFrame) -> DataFrame:
    """A total order of each case's issues."""
    order = Window.partitionBy("case_id").orderBy(F.when(F.col("severity") == "error", 0).otherwise(1), layer_level(F.col("layer")), "code", "path")
    return issues.withColumn("ordinal", F.row_number().over(order))
