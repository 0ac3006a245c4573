"""Validation levels over the long canonical form, and over vocabularies, as issue rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import plain_normal
from ..sources.shared import small
from . import checks
from .joins import null_safe
from .render import supported_control

ISSUE = ["case_id", "layer", "severity", "code", "path"]


def _issue(rows: DataFrame, layer: str, code: str, path: Column | str = "path", severity: str = "error") -> DataFrame:
    return rows.select("case_id", F.lit(layer).alias("layer"), F.lit(severity).alias("severity"), F.lit(code).alias("code"), (F.col(path) if isinstance(path, str) else path).alias("path"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def schema_level(quantities: DataFrame, patterns: list[str], required: list[str] = ()) -> DataFrame:
    """C11: paths outside the canonical schema, values that are no finite number, and required paths that a case lacks."""
    known = reduce(Column.__or__, [F.col("path").rlike(p) for p in patterns], F.lit(False))
    bad = F.col("unit").isNotNull() & (F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf")))
    cases = quantities.select("case_id").distinct()
    parts = [_issue(quantities.filter(~known), "schema", "UNKNOWN_FIELD"), _issue(quantities.filter(bad), "schema", "SCHEMA_VALIDATION_ERROR")]
    for p in required:
        parts.append(_issue(cases.join(quantities.filter(F.col("path") == p), "case_id", "left_anti"), "schema", "REQUIRED_FIELD_MISSING", F.lit(p)))
    return union(parts)


def ontology_level(quantities: DataFrame, concepts: DataFrame, bindings: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Unknown concepts, contexts outside the bindings (scope, phase, role, phase_system columns), wrong units; with the
    vocabulary's edges (src, relation, dst), controls and limits that do not apply to their well's type or an ancestor of it."""
    known = concepts.select("concept_id", F.col("canonical_unit").alias("want"), F.lit(True).alias("known"))
    rows = quantities.join(*small(known), "concept_id", "left")
    outside = null_safe(rows.filter("known AND scope IS NOT NULL"), bindings, ["concept_id", "scope", "phase", "role", "phase_system"])
    return union([
        _issue(rows.filter("known IS NULL"), "ontology", "ONTOLOGY_CONCEPT_MISSING"), _issue(outside, "ontology", "ONTOLOGY_CONTEXT_ERROR"),
        _issue(rows.filter("known AND NOT (unit <=> want)"), "ontology", "ONTOLOGY_UNIT_ERROR", F.concat("path", F.lit(".unit"))),
        _issue(rows.filter(F.col("path").rlike(r"^wells\[[^\]]+\]\.well_type$") & F.col("text").eqNullSafe("unknown")), "ontology", "ONTOLOGY_CONTEXT_UNRESOLVED", severity="warning"),
        *([] if edges is None else [_issue(unrelated(quantities, concepts, edges), "ontology", "ONTOLOGY_RELATIONSHIP_ERROR")]),
    ])


def unrelated(quantities: DataFrame, concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """(case_id, path) of what applies to no type of its well, by the edges applies_to and the concepts' parents."""
    from .graph import closure
    from .outcomes import applies

    parents = concepts.filter("parent IS NOT NULL").select(F.col("concept_id").alias("child"), "parent")
    alone = concepts.select(F.col("concept_id").alias("node"), F.col("concept_id").alias("ancestor"))
    up = closure(parents).select("node", "ancestor").union(alone).distinct()
    rows = quantities.select("case_id", F.lit("").alias("block_id"), F.lit("MAPPED").alias("status"), "concept_id", "path")
    return applies(rows, up, edges.filter("relation = 'applies_to'").select("src", "dst").distinct()).select("case_id", "path")


def domain_level(quantities: DataFrame, constraints: dict[str, dict[str, float]], minimum_points: int = 2) -> DataFrame:
    """Ranges, table sizes, ids of two entities, duplicate and unordered coordinates, trends, schedule."""
    p = F.col("path")
    ranged = quantities.withColumn("rule", checks.violated(F.col("value"), F.col("concept_id"), constraints)).filter("rule IS NOT NULL")
    grammar = r"^(.*\.points|scal\.relative_permeability\[[^\]]+\]\.points)\[(\d+)\]\.(\w+)$"
    points = quantities.filter(p.rlike(grammar)).select("case_id", "value", F.regexp_extract("path", grammar, 1).alias("path"), F.regexp_extract("path", grammar, 2).cast("int").alias("i"), F.regexp_extract("path", grammar, 3).alias("field"))
    wide = points.groupBy("case_id", "path", "i").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in ("sw", "krw", "kro", "pressure")])
    keyed = wide.withColumn("x", F.coalesce("sw", "pressure")).withColumn("t", F.struct("case_id", "path"))
    back = lambda df: df.select("t.*")
    double = back(checks.duplicate_coordinates(keyed, "t", "x"))
    unique = keyed.join(double, ["case_id", "path"], "left_anti")
    scal = unique.filter("sw IS NOT NULL")
    tables = quantities.filter(p.rlike(r"^scal\.relative_permeability\[[^\]]+\]$")).select("case_id", F.concat("path", F.lit(".points")).alias("path")).union(wide.filter("sw IS NOT NULL").select("case_id", "path")).distinct()
    models = quantities.filter(p.rlike(r"^fluids\.\w+\.pvt$") & (F.get_json_object("text", "$.model_type") == "table")).select("case_id", F.concat("path", F.lit(".points")).alias("path"))
    schedule = quantities.groupBy("case_id").agg(*[F.max(F.when(p == f"schedule.{f}", F.col("value"))).alias(f) for f in ("duration", "report_interval")])
    names = quantities.filter(p.rlike(r"^wells\[[^\]]+\]\.id$") & F.col("text").isNotNull())
    short = checks.too_few(tables.select(F.struct("case_id", "path").alias("t")), keyed, "t", minimum_points)
    return union([
        _issue(ranged, "domain", "VALUE_OUT_OF_RANGE"), _issue(back(short), "domain", "TABLE_TOO_SHORT"),
        _issue(models.join(wide.select("case_id", "path").distinct(), ["case_id", "path"], "left_anti"), "domain", "TABLE_EMPTY"),
        _issue(double, "domain", "DUPLICATE_COORDINATE"), _issue(checks.duplicated(names, ["case_id", "text"]), "domain", "DUPLICATE_ENTITY_ID", F.lit("wells")),
        _issue(back(checks.not_increasing(unique, "t", ["i"], "x")), "domain", "COORDINATE_ORDER_WARNING", severity="warning"),
        _issue(back(checks.falling(scal, "t", ["sw"], "krw")), "domain", "KRW_TREND_WARNING", severity="warning"),
        _issue(back(checks.rising(scal, "t", ["sw"], "kro")), "domain", "KRO_TREND_WARNING", severity="warning"),
        _issue(schedule.filter("report_interval > duration"), "domain", "REPORT_INTERVAL_EXCEEDS_DURATION", F.lit("schedule.report_interval"), "warning"),
    ])


def _export_facts(quantities: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    part = lambda pattern: F.nullif(F.regexp_extract("path", pattern, 1), F.lit(""))
    rows = quantities.select("case_id", "path", "value", "text", part(r"^wells\[([^\]]+)\]").alias("well"), part(r"controls\[([^\]]+)\]").alias("control"), part(r"^fluids\.(\w+)\.").alias("phase"), part(r"pvt\.points\[(\d+)\]").alias("point"), F.element_at(F.split("path", r"\."), -1).alias("field"))
    wells = rows.filter("well IS NOT NULL").groupBy("case_id", "well").agg(F.coalesce(F.max(F.when(F.col("field") == "well_type", F.col("text"))), F.lit("unknown")).alias("well_type"), F.collect_set("control").alias("controls"))
    fields = ["pressure", "formation_volume_factor", "viscosity", "compressibility", "viscosibility"]
    points = rows.filter("point IS NOT NULL").groupBy("case_id", "phase", "point").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields])
    return rows, wells, points.withColumn("path", F.format_string("fluids.%s.pvt.points[%s]", "phase", "point"))


def include_level(quantities: DataFrame) -> DataFrame:
    """C14 for the INCLUDE platform."""
    rows, wells, points = _export_facts(quantities)
    control = wells.select("case_id", "well", "well_type", F.explode("controls").alias("control"))
    where = F.format_string("wells[%s].controls[%s]", "well", "control")
    model = rows.filter(F.col("path").rlike(r"^fluids\.(oil|gas)\.pvt$") & (F.get_json_object("text", "$.model_type") != "table"))
    cased = rows.groupBy("case_id").agg(*[F.max(F.when(F.col("path") == p, F.col("value"))).alias(p.replace(".", "_")) for p in ("rock.compressibility", "rock.reference_pressure", "fluids.oil.density", "fluids.water.density", "fluids.gas.density")])
    n = reduce(Column.__add__, [F.col(f"fluids_{x}_density").isNotNull().cast("int") for x in ("oil", "water", "gas")])
    name = F.format_string("wells[%s].id", "well")
    water = rows.filter(F.col("path").rlike(r"^fluids\.water\.pvt")).select("case_id").distinct().join(points.filter("phase = 'water'").groupBy("case_id").count(), "case_id", "left").filter("coalesce(count, 0) <> 1")
    dry = points.filter("phase IN ('oil', 'gas')")
    code = lambda df, c, p="path", s="error": _issue(df, "export", c, p, s)
    parts = [
        code(wells.filter(F.length("well") > 8), "ECLIPSE_WELL_NAME_TOO_LONG", name),
        code(control.filter(~supported_control(F.col("well_type"), F.col("control"))), "ECLIPSE_CONTROL_UNSUPPORTED", where),
        code(model, "ECLIPSE_PVT_MODEL_UNSUPPORTED", F.concat("path", F.lit(".model_type"))),
        *[code(dry.filter(F.col(f).isNotNull()), "ECLIPSE_PVT_PROPERTY_UNSUPPORTED", F.concat("path", F.lit(f".{f}"))) for f in ("compressibility", "viscosibility")],
        code(dry.filter("pressure IS NULL OR formation_volume_factor IS NULL OR viscosity IS NULL"), "ECLIPSE_PVT_POINT_INCOMPLETE"),
        code(water, "ECLIPSE_PVTW_POINT_COUNT_UNSUPPORTED", F.lit("fluids.water.pvt.points")),
        code(points.filter("phase = 'water' AND (formation_volume_factor IS NULL OR compressibility IS NULL OR viscosity IS NULL)"), "ECLIPSE_PVTW_POINT_INCOMPLETE"),
        code(points.filter("phase = 'water' AND viscosibility IS NULL"), "ECLIPSE_PVTW_VISCOSIBILITY_DEFAULTED", F.concat("path", F.lit(".viscosibility")), "warning"),
        code(cased.filter("(rock_compressibility IS NULL) <> (rock_reference_pressure IS NULL)"), "ECLIPSE_PARTIAL_ROCK_NOT_EXPORTED", F.lit("rock"), "warning"),
        code(cased.filter((n > 0) & (n < 3)), "ECLIPSE_PARTIAL_DENSITY_NOT_EXPORTED", F.lit("fluids"), "warning"),
        code(wells.select("case_id").distinct(), "ECLIPSE_HOST_DECK_CONTEXT_REQUIRED", F.lit("wells"), "warning"),
    ]
    found = union(parts)
    from .render import include_records

    empty = rows.select("case_id").distinct().join(include_records(quantities).select("case_id").distinct(), "case_id", "left_anti").join(found.filter("severity = 'error'").select("case_id").distinct(), "case_id", "left_anti")
    return found.unionByName(code(empty, "ECLIPSE_NO_EXPORTABLE_CONTENT", F.lit("$")))


def fragment_level(quantities: DataFrame) -> DataFrame:
    """C14 for the control fragment platform."""
    rows, wells, _ = _export_facts(quantities)
    cases = rows.select("case_id").distinct()
    control = wells.select("case_id", "well", "well_type", F.explode("controls").alias("control"))
    code = lambda df, c, p, s="error": _issue(df, "export", c, p, s)
    return union([
        code(cases.join(wells.select("case_id").distinct(), "case_id", "left_anti"), "CMG_NO_EXPORTABLE_WELLS", F.lit("wells")),
        code(wells.filter(F.size("controls") == 0), "CMG_WELL_CONTROL_MISSING", F.format_string("wells[%s].controls", "well")),
        code(control.filter(~supported_control(F.col("well_type"), F.col("control"))), "CMG_CONTROL_UNSUPPORTED", F.format_string("wells[%s].controls[%s]", "well", "control")),
        code(rows.filter("well IS NULL").select("case_id").distinct(), "CMG_DEMO_NONWELL_DATA_NOT_EXPORTED", F.lit("$"), "warning"),
        code(cases, "CMG_HOST_DATASET_CONTEXT_REQUIRED", F.lit("wells"), "warning"),
    ])


EXPORTERS = {"eclipse": include_level, "cmg": fragment_level}


def validate(levels: list[DataFrame], quantities: DataFrame | None = None, platform: str | None = None) -> DataFrame:
    """The issues of all levels, cut at each case's first failing level, in a total order."""
    parts = list(levels)
    if platform is not None and quantities is not None:
        level = EXPORTERS.get(platform.casefold())
        parts.append(level(quantities) if level else _issue(quantities.select("case_id").distinct(), "export", "EXPORT_VALIDATOR_NOT_CONFIGURED", F.lit(platform)))
    return checks.ordered_issues(checks.short_circuit(union(parts)))


def valid(issues: DataFrame, cases: DataFrame) -> DataFrame:
    """A case is valid if it has no error."""
    bad = issues.filter("severity = 'error'").select("case_id").distinct().withColumn("valid", F.lit(False))
    return cases.join(bad, "case_id", "left").select("case_id", F.coalesce("valid", F.lit(True)).alias("valid"))


def vocabulary_issues(v: dict[str, DataFrame], convention: dict) -> DataFrame:
    """A vocabulary's issues (concept_id, severity, code, path), one filter or anti join a code."""
    c, aliases, edges, limits = v["concepts"], v["aliases"], v["edges"], v["constraints"]
    out = []

    def add(rows: DataFrame, code: str, path="", severity: str = "error") -> None:
        out.append(rows.select("concept_id", F.lit(severity).alias("severity"), F.lit(code).alias("code"), (F.lit(path) if isinstance(path, str) else path).alias("path")))

    ids = c.select("concept_id").distinct()
    named = lambda df, column: df.join(ids.select(F.col("concept_id").alias(column)), column, "left_anti")
    roots = list(convention.get("root_concepts") or [])
    add(c.groupBy("concept_id").count().filter("count > 1"), "DUPLICATE_CONCEPT_ID", "concept_id")
    spark = c.sparkSession
    add(named(spark.createDataFrame([(r,) for r in roots], "concept_id string"), "concept_id"), "ROOT_CONCEPT_MISSING", "convention.root_concepts")
    add(named(c.filter("parent IS NOT NULL"), "parent"), "UNKNOWN_PARENT", "parent")
    at = F.format_string("relationships.%s[%d]", "relation", "seq")
    edge = edges.withColumn("concept_id", F.col("src"))
    add(named(edge, "dst"), "UNKNOWN_RELATIONSHIP_TARGET", at)
    if pattern := convention.get("concept_id_pattern"):
        add(c.filter(~F.col("concept_id").rlike(pattern)), "INVALID_CONCEPT_ID", "concept_id")
    add(c.filter(F.col("parent").isNull() & ~F.col("concept_id").isin(roots)), "UNDECLARED_ROOT_CONCEPT", "parent")
    odd = c.filter(F.col("parent").isNotNull() & ~F.col("parent").isin(roots) & (F.regexp_replace("concept_id", r"\.[^.]*$", "") != F.col("parent")))
    exempt = list((convention.get("hierarchy_exceptions") or {}).keys())
    add(odd.filter(F.col("concept_id").isin(exempt)), "HIERARCHY_EXCEPTION", "parent", "info")
    add(odd.filter(~F.col("concept_id").isin(exempt)), "CONCEPT_HIERARCHY_MISMATCH", "parent", "warning")
    add(c.filter(~F.col("value_type").isin(list(convention["value_types"]))), "UNKNOWN_VALUE_TYPE", "value_type")
    statuses = list(convention.get("lifecycle_statuses") or ["active", "deprecated"])
    add(c.filter(~F.col("status").isin(statuses)), "UNKNOWN_LIFECYCLE_STATUS", "status")
    add(c.filter("status = 'deprecated' AND replaced_by IS NULL"), "DEPRECATED_REPLACEMENT_MISSING", "replaced_by", "warning")
    add(c.filter("status = 'active' AND replaced_by IS NOT NULL"), "ACTIVE_CONCEPT_HAS_REPLACEMENT", "replaced_by")
    add(c.filter("replaced_by = concept_id"), "SELF_REPLACEMENT", "replaced_by")
    add(named(c.filter("replaced_by IS NOT NULL"), "replaced_by"), "UNKNOWN_REPLACEMENT", "replaced_by")
    dims = {d: list((x or {}).get("canonical_units") or []) for d, x in convention["dimensions"].items()}
    add(c.filter("dimension IS NULL AND canonical_unit IS NOT NULL"), "UNIT_WITHOUT_DIMENSION", "canonical_unit")
    add(c.filter(F.col("dimension").isNotNull() & ~F.col("dimension").isin(list(dims))), "UNKNOWN_DIMENSION", "dimension")
    add(c.filter(F.col("dimension").isin(list(dims)) & F.col("canonical_unit").isNull()), "MISSING_CANONICAL_UNIT", "canonical_unit")
    pairs = spark.createDataFrame([(d, u) for d, us in dims.items() for u in us], "dimension string, canonical_unit string")
    add(c.filter(F.col("dimension").isin(list(dims)) & F.col("canonical_unit").isNotNull()).join(*small(pairs), ["dimension", "canonical_unit"], "left_anti"), "INCOMPATIBLE_CANONICAL_UNIT", "canonical_unit")
    rule = F.concat(F.lit("constraints."), "rule")
    keyed = limits.join(c.select("concept_id", "value_type"), "concept_id")
    add(limits.filter(~F.col("rule").isin(list(convention["constraint_keys"]))), "UNKNOWN_CONSTRAINT", rule)
    per = limits.groupBy("concept_id").agg(F.map_from_entries(F.collect_list(F.struct("rule", "bound"))).alias("m"))
    get = lambda n: F.try_element_at("m", F.lit(n))
    has = lambda n: F.array_contains(F.map_keys("m"), n)
    add(per.filter((has("minimum") & has("exclusive_minimum")) | (has("maximum") & has("exclusive_maximum"))), "CONFLICTING_CONSTRAINT_KEYS", "constraints")
    point = F.col("rule").isin("minimum_points", "maximum_points")
    add(keyed.filter(point & (F.col("value_type") != "table")), "POINT_CONSTRAINT_ON_NON_TABLE", rule)
    add(keyed.filter(point & (F.col("bound").isNull() | (F.col("bound") < 1) | (F.col("bound") != F.floor("bound")))), "INVALID_POINT_CONSTRAINT", rule)
    add(keyed.filter(~point & F.col("rule").isin(list(convention["constraint_keys"])) & F.col("bound").isNull()), "NON_NUMERIC_CONSTRAINT", rule)
    add(per.filter(F.coalesce(get("minimum"), get("exclusive_minimum")) > F.coalesce(get("maximum"), get("exclusive_maximum"))), "INVALID_CONSTRAINT_RANGE", "constraints")
    add(per.filter(get("minimum_points") > get("maximum_points")), "INVALID_POINT_CONSTRAINT_RANGE", "constraints")
    spelled = aliases.withColumn("k", plain_normal(F.col("alias")))
    add(spelled.groupBy("concept_id", "k").count().filter("count > 1"), "DUPLICATE_NORMALIZED_ALIAS", "aliases", "warning")
    for rule_ in convention.get("suspicious_alias_patterns") or []:
        add(aliases.filter(F.col("alias").rlike("(?iu)" + rule_["pattern"])), "ALIAS_LOOKS_LIKE_VALUE", F.format_string("aliases[%d]", "seq"), "warning")
    owners = spelled.filter("k <> ''").groupBy("k").agg(F.array_sort(F.collect_set("concept_id")).alias("o"), F.min_by("alias", F.struct("concept_id", "seq")).alias("first")).filter(F.size("o") > 1)
    add(owners.select(F.element_at("o", 1).alias("concept_id"), "first"), "CROSS_CONCEPT_ALIAS_COLLISION", F.concat(F.lit("aliases."), "first"), "warning")
    relations = convention["relationships"]
    types = spark.createDataFrame([(r, list(x["source_value_types"]), list(x["target_value_types"]), bool(x.get("allow_multiple", True)), x.get("inverse")) for r, x in relations.items()], "relation string, source_types array<string>, target_types array<string>, many boolean, inverse string")
    add(edge.filter(~F.col("relation").isin(list(relations))), "UNKNOWN_RELATIONSHIP", at)
    typed = edge.join(*small(types), "relation").join(c.select(F.col("concept_id").alias("src"), F.col("value_type").alias("src_type")), "src").join(c.select(F.col("concept_id").alias("dst"), F.col("value_type").alias("dst_type")), "dst", "left")
    add(typed.filter("NOT array_contains(source_types, src_type)").select("concept_id", "relation").distinct(), "INVALID_RELATIONSHIP_SOURCE_TYPE", F.concat(F.lit("relationships."), "relation"))
    add(typed.filter("dst_type IS NOT NULL AND NOT array_contains(target_types, dst_type)"), "INVALID_RELATIONSHIP_TARGET_TYPE", at)
    add(typed.filter("NOT many").groupBy("concept_id", "relation").count().filter("count > 1"), "RELATIONSHIP_CARDINALITY_ERROR", F.concat(F.lit("relationships."), "relation"))
    back = edges.select(F.col("dst").alias("src"), F.col("relation").alias("inverse"), F.col("src").alias("dst"))
    add(typed.filter("inverse IS NOT NULL AND dst_type IS NOT NULL").join(back, ["src", "inverse", "dst"], "left_anti"), "INVERSE_RELATIONSHIP_MISSING", at)
    if tokens := list(convention.get("source_specific_tokens") or []):
        word = "(?i)(?<![a-z0-9])(" + "|".join(tokens) + ")(?![a-z0-9])"
        for column, code in (("concept_id", "SOURCE_SPECIFIC_CONCEPT_ID"), ("name", "SOURCE_SPECIFIC_NAME"), ("description", "SOURCE_SPECIFIC_DESCRIPTION")):
            add(c.filter(F.col(column).rlike(word)), code, column)
        add(aliases.filter(F.col("alias").rlike(word)), "SOURCE_SPECIFIC_ALIAS", F.format_string("aliases[%d]", "seq"))
    cycles = cyclic(c)
    add(cycles, "PARENT_CYCLE", "parent")
    found = union(out)
    return found.orderBy(F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2), F.coalesce("concept_id", F.lit("")), "code", "path")


def cyclic(concepts: DataFrame) -> DataFrame:
    """The smallest concept of every cycle of parents."""
    from .graph import closure

    edges = concepts.filter("parent IS NOT NULL").select(F.col("concept_id").alias("child"), "parent")
    up = closure(edges)
    back = edges.select(F.col("child").alias("ancestor"), F.col("parent").alias("node"))
    loops = back.join(up, ["node", "ancestor"])  # child reaches parent, and parent reaches child
    on = loops.select(F.col("ancestor").alias("node")).distinct()
    peers = up.join(on, "node").join(on.select(F.col("node").alias("ancestor")), "ancestor")
    return peers.groupBy("node").agg(F.min("ancestor").alias("concept_id")).select("concept_id").distinct()
