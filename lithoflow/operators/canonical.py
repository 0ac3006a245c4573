"""Canonical build: values, merge with conflict detection, natural order and nesting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.units import convert
from ..sources.shared import small
from .contracts import CONTEXT, path_tokens, resolve
from .joins import null_safe

WELL_TYPES = {"well.producer": "producer", "well.water_injector": "water_injector", "well.gas_injector": "gas_injector"}


def natural_key(selector: Column) -> Column:
    """A sort key with numbers first, by size, then text by folded and raw form."""
    number = F.when(selector.rlike(r"^\d+$"), selector.cast("decimal(38,0)"))
    return F.struct(number.isNull().alias("is_text"), number.alias("number"), F.lower(selector).alias("folded"), selector.alias("raw"))


def natural_sort(items: Column, selector) -> Column:
    """Items in the natural order of selector(item)."""
    return F.transform(F.array_sort(F.transform(items, lambda x: F.struct(natural_key(selector(x)).alias("k"), x.alias("v")))), lambda y: y["v"])


def merge_paths(rows: DataFrame, keys: Sequence[str], value: Sequence[str], seq: Sequence[str]) -> DataFrame:
    """A10: one row a key: its value columns (of the first row by seq), n, n_values and the conflict code.

    Rows that agree on all value columns are one assignment; provenance and confidence don't count.
    """
    same = F.count_distinct(F.struct(*[F.col(v) for v in value])).alias("n_values")
    first = F.min_by(F.struct(*value), F.struct(*seq)).alias("_first")
    merged = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), same, first)
    return merged.select(*keys, "n", "n_values", F.when(F.col("n_values") > 1, "DUPLICATE_CANONICAL_ASSIGNMENT").alias("code"), *[F.when(F.col("n_values") == 1, F.col(f"_first.{v}")).alias(v) for v in value])


def subtree_conflicts(rows: DataFrame, case: str, path: str = "path") -> DataFrame:
    """Values at a path that is also an inner node of another path of the case."""
    parts = F.split(F.col(path), r"\.")
    inner = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    nodes = rows.filter(F.size(parts) > 1).select(case, F.explode(inner).alias(path)).distinct()
    return rows.join(nodes, [case, path], "left_semi").select(case, path, F.lit("CANONICAL_PATH_CONFLICT").alias("code"))


def build(drafts: DataFrame, concepts: DataFrame, bindings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(canonical_quantity, issues) of drafts.

    drafts: case_id, seq, concept_id, context, selectors, canonical_path, value_num, value_str, source_unit,
    canonical_unit, confidence. concepts: concept_id, canonical_unit. bindings: concept_id, scope, phase, role,
    phase_system. One case's failures are its issue rows and stop no other case.
    """
    rows = resolve(drafts)
    known = concepts.select(F.col("concept_id").alias("norm_concept"), F.col("canonical_unit").alias("unit"), F.lit(True).alias("known"))
    rows = rows.join(*small(known), "norm_concept", "left")
    flat = rows.select("*", *[F.col(f"norm_context.{c}").alias(c) for c in ("scope", "phase", "role", "phase_system")])
    allowed = bindings.select(F.col("concept_id").alias("norm_concept"), "scope", "phase", "role", "phase_system")
    outside = null_safe(flat.filter("known AND norm_context IS NOT NULL"), allowed, ["norm_concept", "scope", "phase", "role", "phase_system"]).select("case_id", "seq", F.lit(True).alias("outside"))
    rows = convert(rows.join(outside, ["case_id", "seq"], "left"), "value_num", "source_unit", "unit")
    physical = F.col("unit").isNotNull()
    expected = F.create_map(*[F.lit(x) for p in WELL_TYPES.items() for x in p])[F.col("norm_concept")]
    well = F.regexp_extract("path", r"^wells\[([^\]]+)\]", 1)
    relperm = F.col("norm_concept") == "scal.relative_permeability"
    structural = relperm | F.col("norm_concept").endswith(".pvt")
    table_id, fields = F.regexp_extract("path", r"^scal\.relative_permeability\[([^\]]+)\]", 1), F.json_object_keys("value_str")
    code = (
        F.when(F.col("known").isNull() & (F.coalesce("code", F.lit("SEMANTIC_CONTEXT_REQUIRED")).isin("SEMANTIC_CONTEXT_REQUIRED", "UNSUPPORTED_CANONICAL_MAPPING")), "UNKNOWN_ONTOLOGY_CONCEPT")
        .when(F.col("code").isin("SEMANTIC_CONTEXT_CONFLICT", "SEMANTIC_CONTEXT_REQUIRED"), F.col("code"))
        .when(F.col("outside"), "INVALID_SEMANTIC_CONTEXT")
        .when(F.col("code").isNotNull(), F.col("code"))
        .when(physical & F.col("source_unit").isNull(), "SOURCE_UNIT_REQUIRED")
        .when(physical & (F.col("canonical_unit") != F.col("unit")), "CANONICAL_UNIT_MISMATCH")
        .when(physical & F.col("unit_code").isNotNull(), F.col("unit_code"))
        .when(~physical & (F.col("source_unit").isNotNull() | F.col("canonical_unit").isNotNull()), "UNEXPECTED_UNIT")
        .when(expected.isNotNull() & ~F.col("value_str").eqNullSafe(expected), "ONTOLOGY_VALUE_MISMATCH")
        .when((F.col("norm_concept") == "well") & ~F.col("value_str").eqNullSafe(well), "ENTITY_SELECTOR_MISMATCH")
        .when(structural & ~F.coalesce(F.trim("value_str").startswith("{") & fields.isNotNull(), F.lit(False)), "STRUCTURAL_VALUE_REQUIRED")
        .when(relperm & (F.get_json_object("value_str", "$.id") != table_id), "ENTITY_SELECTOR_MISMATCH")
        .when(relperm & ~F.array_sort(F.coalesce(F.from_json(F.get_json_object("value_str", "$.phase_system"), "array<string>"), F.array())).eqNullSafe(F.array(F.lit("oil"), F.lit("water"))), "SEMANTIC_CONTEXT_CONFLICT")
        .when(F.exists(path_tokens(F.col("path")), lambda t: t["name"].isNull()), "INVALID_CANONICAL_PATH")
    )
    checked = rows.select("case_id", "seq", "path", F.col("norm_concept").alias("concept_id"), F.when(physical, F.col("unit_value")).alias("value"), F.when(~physical, F.col("value_str")).alias("text"), "unit", *[F.col(f"norm_context.{c}").alias(c) for c in CONTEXT], code.alias("code"))
    good = checked.filter("code IS NULL")
    merged = merge_paths(good, ["case_id", "path"], ["concept_id", "value", "text", "unit", *CONTEXT], ["seq"])
    conflicts = merged.filter("code IS NOT NULL").select("case_id", "path", "code")
    issues = checked.filter("code IS NOT NULL").select("case_id", F.coalesce("path", F.lit("$")).alias("path"), "code").union(conflicts).union(subtree_conflicts(good, "case_id"))
    return merged.filter("code IS NULL").select("case_id", "path", "concept_id", "value", "text", "unit", *CONTEXT), issues.distinct()


def nest_wells(quantities: DataFrame) -> DataFrame:
    """(case_id, wells): wells with controls with constraints, each in natural order; an unknown type is 'unknown'."""
    parts = r"^wells\[([^\]]+)\](?:\.controls\[([^\]]+)\])?(?:\.constraints\[([^\]]+)\])?\.(\w+)$"
    rows = quantities.select("case_id", "value", "text", *[F.nullif(F.regexp_extract("path", parts, n), F.lit("")).alias(c) for n, c in ((1, "well"), (2, "control"), (3, "limit"), (4, "field"))]).filter("well IS NOT NULL")
    limits = rows.filter("limit IS NOT NULL").groupBy("case_id", "well", "control").agg(F.collect_list(F.struct(F.col("limit").alias("constraint_type"), "value")).alias("constraints"))
    target = rows.filter("control IS NOT NULL").groupBy("case_id", "well", "control").agg(F.max(F.when(F.col("field") == "target", F.col("value"))).alias("target"))
    controls = target.join(limits, ["case_id", "well", "control"], "left").select("case_id", "well", F.struct(F.col("control").alias("control_type"), "target", natural_sort(F.coalesce("constraints", F.array().cast("array<struct<constraint_type:string,value:double>>")), lambda x: x["constraint_type"]).alias("constraints")).alias("c"))
    of_well = controls.groupBy("case_id", "well").agg(F.collect_list("c").alias("controls"))
    wells = rows.groupBy("case_id", "well").agg(F.coalesce(F.max(F.when(F.col("field") == "well_type", F.col("text"))), F.lit("unknown")).alias("well_type"))
    none = F.array().cast("array<struct<control_type:string,target:double,constraints:array<struct<constraint_type:string,value:double>>>>")
    one = wells.join(of_well, ["case_id", "well"], "left").select("case_id", F.struct(F.col("well").alias("id"), "well_type", natural_sort(F.coalesce("controls", none), lambda x: x["control_type"]).alias("controls")).alias("w"))
    return one.groupBy("case_id").agg(F.collect_list("w").alias("w")).select("case_id", natural_sort(F.col("w"), lambda x: x["id"]).alias("wells"))
