"""The whole lifecycle as DataFrames: sources and drafts in, gated canonical records, issues and rendered text out.

Any number of sources in one job; ``case_id`` is the source. Each stage's frame is in the result, so that a caller can write
or inspect what it needs. What several stages read is written to the shared folder once, so plans stay small and no stage runs
twice; the last stages are lazy.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import candidates, canonical, contracts, outcomes, render, validate
from .sources import blocks as B
from .sources.shared import written

KEY = ["case_id", "block_id"]
RENDERERS = {"eclipse": (render.include_records, render.render_include), "cmg": (render.fragment_records, render.render_fragment)}


@dataclass(frozen=True)
class Translation:
    blocks: DataFrame
    candidates: DataFrame
    outcomes: DataFrame
    status: DataFrame
    quantities: DataFrame
    issues: DataFrame
    texts: DataFrame


def searchable(blocks: DataFrame) -> DataFrame:
    """Blocks with case_id and the text that is searched: text itself, or compact JSON with sorted keys."""
    table = F.to_json(F.struct("columns", "rows"))
    pair = F.to_json(F.struct("key", "value"))
    content = F.when(F.col("block_type") == "table", table).when(F.col("block_type") == "key_value", pair)
    rows = blocks.filter("code IS NULL").withColumn("text", F.when(F.col("block_type") == "text", F.col("text")).otherwise(content))
    return rows.select(F.col("source_id").alias("case_id"), "block_id", "block_type", "text", "columns", "rows", "key", "value", "source_location")


def canonical_patterns() -> list[str]:
    """Paths of the canonical schema: those of the contracts."""
    return [contracts.pattern_of(t) for _, _, t in contracts.contracts()]


def translate(sources: DataFrame, drafts: DataFrame, vocabulary: dict[str, DataFrame], profiles: list[dict] = (), platform: str = "eclipse", dialect: str = "", constraints: dict[str, dict[str, float]] | None = None, top_k: int = 40, notes: dict[str, str] | None = None) -> Translation:
    """sources: source_id, file_name, content. drafts: as outcomes.materialise takes them.

    notes: whole-line patterns ``heading``, ``metadata`` and ``absence`` (P09); blocks that they, or known metadata keys, cover
    are context of their document and are neither searched nor reported as unmapped (P06).
    """
    parsed = written(B.blocks_of(sources), "parsed")
    blocks = searchable(parsed)
    if notes:
        kind = candidates.metadata_kind(F.col("block_type"), F.col("key"), F.col("value"), F.col("text"), notes["heading"], notes["metadata"], notes["absence"])
        blocks = blocks.filter(kind.isNull())
    blocks = written(blocks, "blocks")
    found = candidates.retrieve(blocks, vocabulary, profiles, k=3 * top_k)
    context = F.when(F.col("scope").isNotNull(), F.struct(*[F.col(c) for c in contracts.CONTEXT]).cast(contracts.CONTEXT_DDL))
    found = found.select(*KEY, "concept_id", context.alias("context"), "score", "rank", "supported")
    offered = written(outcomes.buildable(found, top_k), "offered")
    gated = candidates.missing_pressure_unit(blocks, list(profiles)).select(*KEY).withColumn("gated", F.lit(True))
    open_ = drafts.join(gated, KEY, "left_anti")
    mapped = written(outcomes.materialise(open_, offered, vocabulary["concepts"]), "mapped")
    checks = outcomes.block_issues(mapped)
    skipped = outcomes.automatic_unmapped(blocks.join(gated, KEY, "left_anti"), offered).select(*KEY, "status").union(gated.select(*KEY, F.lit("UNMAPPED")))
    bad = mapped.select("case_id", ((F.col("status") != "MAPPED") | (F.col("confidence") < 0.8)).alias("r"))
    bad = bad.union(checks.select("case_id", F.lit(True))).union(skipped.select("case_id", F.lit(True))).union(parsed.filter("code IS NOT NULL").select("source_id", F.lit(True)))
    per_case = bad.groupBy("case_id").agg(F.bool_or("r").alias("r"))
    status = sources.select(F.col("source_id").alias("case_id")).join(per_case, "case_id", "left").select("case_id", F.when(F.coalesce("r", F.lit(True)), "review_required").otherwise("ready").alias("gate"))
    status = written(status, "status")
    ready = open_.join(status.filter("gate = 'ready'").select("case_id"), "case_id", "left_semi")
    quantities, build_issues = canonical.build(ready.withColumn("seq", F.struct("block_id", "seq")).drop("block_id", "draft_block_id"), vocabulary["concepts"], vocabulary["bindings"])
    quantities = written(quantities, "quantities")
    broken = build_issues.select("case_id", F.lit("schema").alias("layer"), F.lit("error").alias("severity"), "code", "path")
    levels = [broken, validate.schema_level(quantities, canonical_patterns()), validate.ontology_level(quantities, vocabulary["concepts"], vocabulary["bindings"], vocabulary.get("edges")), validate.domain_level(quantities, constraints or {})]
    issues = written(validate.validate(levels, quantities, platform), "issues")
    good = validate.valid(issues, quantities.select("case_id").distinct()).filter("valid").select("case_id")
    done = status.join(good.withColumn("ok", F.lit(True)), "case_id", "left").select("case_id", F.when(F.col("gate") != "ready", F.col("gate")).when(F.col("ok"), "success").otherwise("validation_failed").alias("status"))
    records, text = RENDERERS[platform.casefold()]
    texts = text(records(quantities.join(good, "case_id", "left_semi")), dialect)
    parsing = parsed.filter("code IS NOT NULL").select(F.col("source_id").alias("case_id"), F.lit("ingestion").alias("layer"), F.lit("error").alias("severity"), "code", F.coalesce("file_name", F.lit("$")).alias("path"))
    mapping = mapped.filter("code IS NOT NULL").select("case_id", F.lit("mapping").alias("layer"), F.lit("error").alias("severity"), "code", F.concat_ws("#", "block_id", "seq").alias("path")).union(checks.select("case_id", F.lit("mapping"), F.lit("error"), "code", "path"))
    every = parsing.union(mapping).union(issues.select("case_id", "layer", "severity", "code", "path"))
    return Translation(parsed, offered, mapped, done, quantities, every, texts)
