"""Drafts to outcomes under a contract.

Drafts are an input table; the model that writes them is a port. One row a draft with the first failing code; checks over a
block's outcomes give issue rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import field_key
from ..sources.shared import small
from .contracts import CONTEXT, CONTEXT_DDL, contract_rows, resolve

KEY = ["case_id", "block_id"]


def flat_context(rows: DataFrame, column: str, prefix: str = "") -> DataFrame:
    """Context fields as columns, null as an empty text, so that contexts join by hash."""
    return rows.select("*", *[F.coalesce(F.col(f"{column}.{c}"), F.lit("")).alias(f"{prefix}{c}") for c in CONTEXT])


def buildable(candidates: DataFrame, top_k: int) -> DataFrame:
    """The best candidates that have a contract, and the structural parents that they need.

    candidates: case_id, block_id, concept_id, context, score, rank, supported.
    """
    spark = candidates.sparkSession
    known = flat_context(contract_rows(spark), "context").select("concept_id", *CONTEXT)
    kept = flat_context(candidates, "context").join(F.broadcast(known), ["concept_id", *CONTEXT], "left_semi")
    from pyspark.sql import Window

    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy(*KEY).orderBy("rank"))).filter(F.col("rank") <= top_k)
    part = kept.filter(F.col("scope").isin("pvt", "relative_permeability") & (F.col("role") != "model"))
    phase = F.when(F.col("scope") == "pvt", F.col("phase")).otherwise("")
    parents = part.select(*KEY, F.when(F.col("scope") == "pvt", "fluid.pvt").otherwise("scal.relative_permeability").alias("concept_id"), "scope", phase.alias("phase"), F.lit("model").alias("role"), "phase_system", "supported")
    parents = parents.groupBy(*KEY, "concept_id", *CONTEXT).agg(F.bool_or("supported").alias("child"))
    inherited = kept.join(parents, [*KEY, "concept_id", *CONTEXT], "left").withColumn("supported", F.col("supported") | F.coalesce("child", F.lit(False))).drop("child")
    missing = parents.join(kept.select(*KEY, "concept_id", *CONTEXT), [*KEY, "concept_id", *CONTEXT], "left_anti")
    context = F.struct(*[F.nullif(F.col(c), F.lit("")).alias(c) for c in CONTEXT]).cast(CONTEXT_DDL)
    added = missing.select(*KEY, "concept_id", context.alias("context"), F.lit(0.9).alias("score"), F.lit(None).cast("int").alias("rank"), F.col("child").alias("supported"))
    return inherited.select(*KEY, "concept_id", "context", "score", "rank", "supported").unionByName(added)


def materialise(drafts: DataFrame, candidates: DataFrame, concepts: DataFrame) -> DataFrame:
    """MAPPED drafts to outcomes: status, confidence, path and the first failing code.

    drafts: case_id, block_id, seq, draft_block_id, concept_id, context, selectors, canonical_path, value_num, value_str,
    source_unit, canonical_unit, confidence. An unsupported context is no error: it makes the outcome AMBIGUOUS if its concept
    has two or more contexts among the candidates, else UNMAPPED.
    """
    rows = flat_context(resolve(drafts), "norm_context")
    pairs = flat_context(candidates.select(*KEY, F.col("concept_id").alias("norm_concept"), "context", "supported"), "context").drop("context").withColumn("pair", F.lit(True))
    ids = candidates.groupBy(*KEY, F.col("concept_id").alias("norm_concept")).agg(F.count_if(F.col("context").isNotNull()).alias("choices"))
    known = concepts.select(F.col("concept_id").alias("norm_concept"), F.col("canonical_unit").alias("unit"), "value_type")
    rows = rows.join(ids, [*KEY, "norm_concept"], "left").join(pairs, [*KEY, "norm_concept", *CONTEXT], "left").join(F.broadcast(known), "norm_concept", "left")
    number = F.col("value_type").isin("float", "duration")
    finite = F.col("value_num").isNotNull() & ~F.isnan("value_num") & (F.abs("value_num") < float("inf"))
    weak = F.col("pair") & ~F.col("supported")
    early = (
        F.when(~F.col("draft_block_id").eqNullSafe(F.col("block_id")), "SOURCE_BLOCK_MISMATCH")
        .when(F.col("code").isin("SEMANTIC_CONTEXT_CONFLICT", "SEMANTIC_CONTEXT_REQUIRED"), "SEMANTIC_CONTEXT_INVALID")
        .when(F.col("choices").isNull(), "CONCEPT_OUTSIDE_CANDIDATES")
        .when(F.col("pair").isNull(), "CONTEXT_OUTSIDE_CANDIDATES")
    )
    late = (
        F.when(F.col("code").isNotNull(), "CANONICAL_PATH_OUTSIDE_CONTRACT")
        .when(~F.col("canonical_unit").eqNullSafe(F.col("unit")), "CANONICAL_UNIT_OUTSIDE_CONTRACT")
        .when(number & ~finite, "VALUE_OUTSIDE_CONTRACT")
        .when((F.col("norm_concept") == "scal.relative_permeability") & F.get_json_object("value_str", "$.phase_system").isNull(), "STRUCTURAL_VALUE_OUTSIDE_CONTRACT")
        .when((F.col("norm_concept") == "fluid.pvt") & ~F.coalesce(F.get_json_object("value_str", "$.model_type").isin("table", "constant"), F.lit(False)), "STRUCTURAL_VALUE_OUTSIDE_CONTRACT")
        .when(F.col("unit").isNotNull() & F.col("source_unit").isNull(), "SOURCE_UNIT_REQUIRED")
        .when(F.col("unit").isNull() & F.col("source_unit").isNotNull(), "UNEXPECTED_SOURCE_UNIT")
    )
    rows = rows.withColumn("first_error", F.when(early.isNotNull(), early).when(~F.coalesce(weak, F.lit(False)), late))
    status = F.when(F.col("first_error").isNotNull(), "ERROR").when(weak & (F.col("choices") >= 2), "AMBIGUOUS").when(weak, "UNMAPPED").otherwise("MAPPED")
    confidence = F.when(status == "AMBIGUOUS", F.least(F.col("confidence"), F.lit(0.79))).when(status == "UNMAPPED", 0.0).otherwise(F.col("confidence"))
    return rows.select(*KEY, "seq", status.alias("status"), F.col("norm_concept").alias("concept_id"), "norm_context", F.when(status == "MAPPED", F.col("path")).alias("path"), "value_num", "value_str", "source_unit", confidence.alias("confidence"), F.col("first_error").alias("code"))


def automatic_unmapped(blocks: DataFrame, candidates: DataFrame) -> DataFrame:
    """Blocks without any candidate."""
    return blocks.join(candidates.select(*KEY).distinct(), KEY, "left_anti").select(*KEY, F.lit("UNMAPPED").alias("status"), F.lit(0.0).alias("confidence"), F.col("key").alias("source_field"))


def block_issues(outcomes: DataFrame) -> DataFrame:
    """A04, J09-J11 over a block's mapped paths: (case_id, block_id, code, path)."""
    mapped = outcomes.filter("status = 'MAPPED'").select(*KEY, "path")
    issue = lambda df, code: df.select(*KEY, F.lit(code).alias("code"), "path")
    twice = issue(mapped.groupBy(*KEY, "path").count().filter("count > 1"), "DUPLICATE_CANONICAL_PATH")
    point = r"^(.*)\.points\["
    parents = mapped.filter(F.col("path").rlike(point)).select(*KEY, F.regexp_extract("path", point, 1).alias("path")).distinct()
    orphan = issue(parents.join(mapped, [*KEY, "path"], "left_anti"), "REQUIRED_STRUCTURAL_MAPPING_MISSING")
    part = lambda n: F.regexp_extract("path", r"^wells\[([^\]]+)\]\.controls\[([^\]]+)\]", n)
    targets = mapped.filter(F.col("path").rlike(r"^wells\[[^\]]+\]\.controls\[[^\]]+\]\.target$")).select(*KEY, part(1).alias("well"), part(2).alias("control")).groupBy(*KEY, "well").agg(F.collect_set("control").alias("targets"))
    limits = mapped.filter(F.col("path").rlike(r"\.constraints\[[^\]]+\]\.value$")).select(*KEY, "path", part(1).alias("well"), part(2).alias("control")).distinct()
    astray = issue(limits.join(targets, [*KEY, "well"]).filter(~F.array_contains("targets", F.col("control"))), "CONSTRAINT_CONTROL_TARGET_MISMATCH")
    whole = outcomes.groupBy(*KEY).agg(F.bool_and(F.col("status") == "MAPPED").alias("all")).filter("all")
    pvt = r"^(fluids\.[^.]+\.pvt\.points\[\d+\])\.[^.]+$"
    points = mapped.filter(F.col("path").rlike(pvt)).select(*KEY, F.concat(F.regexp_extract("path", pvt, 1), F.lit(".pressure")).alias("path")).distinct()
    bare = issue(points.join(mapped, [*KEY, "path"], "left_anti").join(whole, KEY, "left_semi"), "PVT_POINT_PRESSURE_MISSING")
    return twice.union(orphan).union(astray).union(bare)


def applies(outcomes: DataFrame, ancestors: DataFrame, targets: DataFrame) -> DataFrame:
    """Properties of wells of a known type to which none of their targets, or an ancestor of the type, applies.

    ancestors: (node, ancestor); targets: (src, dst) of applies_to. Concepts without targets are not judged.
    """
    mapped = outcomes.filter("status = 'MAPPED'").withColumn("well", F.regexp_extract("path", r"^wells\[([^\]]+)\]\.", 1)).filter("well <> ''")
    kinds = mapped.filter(F.col("path").endswith("].well_type")).select(*KEY, "well", F.col("concept_id").alias("node"))
    rows = mapped.select(*KEY, "well", "path", F.col("concept_id").alias("src")).join(kinds, [*KEY, "well"])
    targets, ancestors = small(targets, ancestors.select("node", F.col("ancestor").alias("dst")))
    judged = rows.join(targets.select("src").distinct(), "src", "left_semi")
    fits = judged.join(targets, "src").join(ancestors, ["node", "dst"], "left_semi").select(*KEY, "path")
    return judged.join(fits, [*KEY, "path"], "left_anti").select(*KEY, F.lit("ONTOLOGY_RELATIONSHIP_CONFLICT").alias("code"), "path")


def consumed(unmapped: DataFrame, mapped: DataFrame, record: DataFrame) -> DataFrame:
    """UNMAPPED qualifiers that a mapped fact of the same one-row well record proves.

    unmapped: case_id, block_id, seq, source_field. mapped: case_id, block_id, well_id, concept_id, value_num,
    source_unit, confidence. record: case_id, block_id, fields (map of normalised name to text).
    """
    rows = unmapped.withColumn("k", field_key(F.col("source_field"))).join(record, KEY)
    get = lambda n: F.try_element_at("fields", F.lit(n))
    rows = rows.withColumn("v", F.try_element_at("fields", F.col("k"))).withColumn("well_id", get("wellid"))
    facts = mapped.filter("confidence >= 0.8").select(*KEY, "well_id", F.col("concept_id").alias("c"), "value_num", F.col("source_unit").alias("u"))
    number = lambda n: F.try_element_at("fields", F.lit(n)).try_cast("double")
    mode = F.lower("v")
    proof = (
        ((F.col("k") == "fluid") & (mode == "water") & (F.col("c") == "well.water_injector"))
        | ((F.col("k") == "controlmode") & (((mode == "injection_rate") & (F.col("c") == "well.control.water_injection_rate")) | ((mode == "liquid_rate") & (F.col("c") == "well.control.liquid_rate"))) & (F.col("value_num") == number("target")))
        | ((F.col("k") == "unit") & F.col("c").startswith("well.control.") & (F.col("u") == F.col("v")) & (F.col("value_num") == number("target")))
        | ((F.col("k") == "pressureunit") & F.col("c").startswith("well.constraint.") & (F.col("u") == F.col("v")) & ((F.col("value_num") == number("minbhp")) | (F.col("value_num") == number("maxbhp"))))
    )
    return rows.join(facts, [*KEY, "well_id"]).filter(F.coalesce(proof, F.lit(False))).select(*KEY, "seq", "source_field", F.col("v").alias("value")).distinct()


def table_identity(samples: DataFrame) -> DataFrame:
    """(case_id, block_id, sample) to sample_id, technical id and the conflicting ids if there are several."""
    safe = F.substring(F.regexp_replace("block_id", r"(?U)[^\w-]", "_"), 1, 128)
    found = samples.groupBy(*KEY).agg(F.array_sort(F.collect_set("sample")).alias("s"))
    one = F.when(F.size("s") == 1, F.element_at("s", 1))
    return found.select(*KEY, one.alias("sample_id"), F.when(one.rlike(r"^(?U)[\w-]{1,128}$"), one).otherwise(safe).alias("technical_id"), F.when(F.size("s") > 1, F.array_join("s", ",")).alias("conflicting"))


def provenance(row_text: Column, block_id: Column, provider: Column) -> Column:
    """The parser's text, whatever the provider says."""
    return F.struct(row_text.alias("raw_text"), block_id.alias("source_block_id"), F.concat(F.lit("semantic_model:"), provider).alias("extraction_method"))
