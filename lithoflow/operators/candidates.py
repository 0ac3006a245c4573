"""Candidate retrieval over a whole vocabulary.

blocks: case_id, block_id, block_type, text (searchable), columns, rows. The vocabulary's frames (sources.vocabulary) are
tens of rows: their distinct terms are matched in one projection per block, words meet concepts through an inverted index, and
everything after that is equi joins of what matched with vocabulary tables (broadcast up to ``MOST_ROWS`` rows). Keys are
(case_id, block_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import MOST_ROWS, written
from .retrieve import best_per_key, top_k

KEY = ["case_id", "block_id"]
CONTEXT = ["scope", "phase", "role", "phase_system"]
PHASES = ["oil", "water", "gas"]
#: Scopes whose bindings are told apart by a phase that the text names.
PHASED = ["pvt", "fluid_properties"]

#: Local evidence of a clause, as patterns and terms.
DENSITY = r"(?i)density|密度|kg\s*/\s*m(?:3|³)|g\s*/\s*cm(?:3|³)"
PVT_TERMS = ["pvt", "formation volume factor", "viscosity", "体积系数", "粘度", "黏度"]
ROCK_TERMS = ("岩石", "压缩系数")
REPORT = r"(?:每|间隔)\s*\d+\s*个?(?:月|天|年).*?(?:输出|报告|看一次)"
PAIR_TERMS = ["oil water", "water oil", "油水", "水驱油"]
PRESSURE_UNIT = r"(?i)(?<![A-Za-z])(?:bar|barsa|psi|psia|kPa|MPa|Pa)(?![A-Za-z])"
UNIT_SYSTEM = r"(?im)^\s*(?:METRIC|FIELD)\s*(?:--[^\n]*)?$"


def _texts(rows: DataFrame) -> list:
    return [r[0] for r in rows.distinct().orderBy(rows.columns[0]).collect()]


def _matched(text: Column, terms: list[str], how=T.contains) -> Column:
    """The terms that a text contains; terms are literals, so the array is made once a plan."""
    return F.filter(F.array(*[F.lit(t) for t in terms]).cast("array<string>"), lambda x: how(text, x))


def _phase_hits(t: Column, phases: dict[str, list[str]]) -> Column:
    """Sorted phases that the normalised text names."""
    return F.array_compact(F.array(*[F.when(F.size(_matched(t, phases.get(p, []))) > 0, F.lit(p)) for p in PHASES]).cast("array<string>"))


def local_evidence(blocks: DataFrame, phases: dict[str, list[str]]) -> DataFrame:
    """(key, scope, phase or null, concept or null) that one clause, or a table's columns, show by themselves."""
    clause = blocks.select(*KEY, F.explode(F.split("text", "[;；\n]")).alias("c")).withColumn("t", T.normal(F.col("c")))
    density, pvt = F.col("c").rlike(DENSITY), F.size(_matched(F.col("t"), PVT_TERMS)) > 0
    raw = F.when(density & ~pvt, "fluid_properties").when(pvt & ~density, "pvt")
    named = clause.select(*KEY, raw.alias("scope"), _phase_hits(F.col("t"), phases).alias("p"), F.lit(None).cast("string").alias("concept_id")).filter("scope IS NOT NULL")
    rock = F.when(T.contains(F.col("t"), F.lit(ROCK_TERMS[0])) & T.contains(F.col("t"), F.lit(ROCK_TERMS[1])), F.struct(F.lit("rock").alias("scope"), F.lit("rock.compressibility").alias("concept_id")))
    report = F.when(F.col("c").rlike(REPORT), F.struct(F.lit("schedule").alias("scope"), F.lit("schedule.report_interval").alias("concept_id")))
    facts = clause.select(*KEY, F.explode(F.array_compact(F.array(rock, report))).alias("x")).select(*KEY, "x.scope", F.array().cast("array<string>").alias("p"), "x.concept_id")
    head = F.array_join(F.transform("columns", lambda c: T.normal(c)), " ")
    kind = F.transform("columns", lambda c: T.normal(c).isin("fluid", "phase", "fluid phase"))
    cells = F.flatten(F.transform("rows", lambda r: F.filter(r, lambda v, i: F.get(kind, i))))
    table = blocks.filter("block_type = 'table'").withColumn("h", head).filter(F.contains("h", F.lit("pressure")) & (F.contains("h", F.lit("formation volume")) | F.contains("h", F.lit("viscosity"))))
    rows = table.select(*KEY, F.lit("pvt").alias("scope"), F.array_distinct(F.flatten(F.transform(F.coalesce(cells, F.array().cast("array<string>")), lambda v: _phase_hits(T.normal(v), phases)))).alias("p"), F.lit(None).cast("string").alias("concept_id"))
    return named.unionByName(facts).unionByName(rows).select(*KEY, "scope", F.explode_outer("p").alias("phase"), "concept_id").distinct()


def profile_matches(blocks: DataFrame, profiles: list[dict]) -> DataFrame:
    """(key, concept_id, context or null, score, term) of the profiles that a block activates."""
    t = F.col("t")
    found = []
    for p in profiles:
        active = F.lit(True)
        for a in p["activation_terms"]:
            active = active & T.contains(t, T.normal(F.lit(a)))
        for e in p["entries"]:
            how = T.source_match(t, T.normal(F.lit(e["source_term"])))
            ctx = e.get("context") or {}
            fields = [F.lit(ctx.get(c)).cast("string").alias(c) for c in CONTEXT]
            score = F.when(how == "exact", 0.99).otherwise(0.98)
            found.append(F.when(active & how.isNotNull(), F.struct(F.lit(e["concept_id"]).alias("concept_id"), F.lit(bool(ctx)).alias("bound"), *fields, score.alias("score"), F.lit(e["source_term"]).alias("term"))))
    if not found:
        return blocks.select(*KEY).limit(0).selectExpr(*KEY, "'' concept_id", "true bound", *[f"'' {c}" for c in CONTEXT], "0D score", "'' term")
    rows = (blocks if "t" in blocks.columns else T.with_normals(blocks)).select(*KEY, F.explode(F.array_compact(F.array(*found))).alias("x"))
    return rows.select(*KEY, "x.*")


def missing_pressure_unit(blocks: DataFrame, profiles: list[dict]) -> DataFrame:
    """P10: blocks of a profile that needs a pressure unit and that state none."""
    t = T.normal(F.col("text"))
    needs = F.lit(False)
    for p in profiles:
        if p["requires_pressure_unit"]:
            active = F.lit(True)
            for a in p["activation_terms"]:
                active = active & T.contains(t, T.normal(F.lit(a)))
            needs = needs | active
    return blocks.filter(needs & ~F.col("text").rlike(PRESSURE_UNIT) & ~F.col("text").rlike(UNIT_SYSTEM)).select(*KEY)


def retrieve(blocks: DataFrame, v: dict[str, DataFrame], profiles: list[dict] = (), k: int = 8) -> DataFrame:
    """(key, rank, concept_id, context columns, score, match_type, terms, supported), ranked and cut to k a block."""
    if k < 1:
        raise ValueError("k must be at least 1")
    blocks = written(T.with_normals(blocks.select(*KEY, "block_type", "text", "columns", "rows").filter(F.length(F.trim("text")) > 0)), "blocks")
    # every derived frame has at most a few rows for each of the vocabulary's
    held = sum(f.limit(MOST_ROWS + 1).count() for f in v.values())
    small = F.broadcast if held <= MOST_ROWS else lambda df: df
    concept = v["concepts"].filter("status = 'active'").select("concept_id", "name", "description")
    tail = F.element_at(F.split("concept_id", r"\."), -1)
    alias = v["aliases"].select("concept_id", T.normal(F.col("alias"), exact=True).alias("term"), F.col("alias").alias("shown"))
    naming = alias.select("concept_id", "term").union(concept.select("concept_id", T.normal(tail))).union(concept.select("concept_id", T.normal(F.col("name")))).filter("term <> ''").distinct()
    bound = v["bindings"].withColumn("n", F.row_number().over(Window.orderBy("concept_id", *CONTEXT)).cast("long"))  # tens of rows
    bound_alias = v["binding_aliases"].select("concept_id", *CONTEXT, T.normal(F.col("alias"), exact=True).alias("term"), F.col("alias").alias("shown")).filter("term <> ''")
    fluid = {p: _texts(alias.filter(F.col("concept_id") == f"fluid.{p}").select("term").filter("term <> ''")) for p in PHASES}
    terms = sorted({*_texts(naming.select("term")), *_texts(bound_alias.select("term")), *(t for p in PHASES for t in fluid[p])})
    base = written(blocks.select(*KEY, "t").withColumn("found", _matched(F.col("t"), terms)).withColumn("q", T.keywords(F.col("t"))), "found")
    hit = base.select(*KEY, F.explode("found").alias("term"), (T.compact(F.col("t")) == T.compact(F.col("term"))).alias("exact"))
    local = written(local_evidence(blocks, fluid), "local")

    scope_terms = v["scope_aliases"].select("scope", T.scope_normal(F.col("alias"), exact=True).alias("term")).filter("term <> ''").distinct()
    spoken = blocks.select(*KEY, F.explode(_matched(F.col("ts"), _texts(scope_terms.select("term")), T.scope_contains)).alias("term"))
    explicit = written(spoken.join(small(scope_terms), "term").select(*KEY, "scope").union(local.select(*KEY, "scope")).distinct(), "explicit")
    used = hit.join(small(naming), "term").select(*KEY, "concept_id").distinct().join(small(bound.select("concept_id", "scope").distinct()), "concept_id")
    told = used.join(explicit.withColumn("x", F.lit(True)), [*KEY, "scope"], "left").groupBy(*KEY, "concept_id").agg(F.bool_or(F.coalesce("x", F.lit(False))).alias("told"), F.collect_set("scope").alias("s"))
    scopes = written(explicit.union(told.filter("NOT told").select(*KEY, F.explode("s"))).distinct(), "scopes")

    hints = hit.join(small(bound_alias.filter("phase IS NOT NULL")), "term").select(*KEY, "scope", "phase").union(local.filter("phase IS NOT NULL").select(*KEY, "scope", "phase")).distinct()
    phased = scopes.join(small(v["scopes"].filter(F.size("phases") > 0).select("scope")), "scope").groupBy(*KEY).agg(F.collect_set("scope").alias("s")).filter(F.size("s") == 1).select(*KEY, F.element_at("s", 1).alias("scope")).filter(F.col("scope").isin(PHASED))
    bare = base.select(*KEY, F.explode(_phase_hits(F.col("t"), fluid)).alias("phase")).join(phased, KEY).join(hints.select(*KEY).distinct(), KEY, "left_anti").select(*KEY, "scope", "phase")
    hints = written(hints.union(bare).distinct(), "hints")
    per_scope = hints.groupBy(*KEY, "scope").agg(F.collect_set("phase").alias("hinted"))

    any_scope = scopes.select(*KEY).distinct().withColumn("some", F.lit(True))
    lone = base.select(*KEY).join(any_scope, KEY, "left").filter("some IS NULL").select(*KEY)
    # what a block can reach at all: concepts of its terms, of its local facts and, by an inverted index, of its words
    by_concept = hit.join(small(alias.filter("term <> ''")), "term").select(*KEY, "concept_id", "exact", "shown")
    heard = hit.join(small(bound_alias.select("concept_id", "term").distinct()), "term").select(*KEY, "concept_id")
    words = concept.join(v["aliases"].groupBy("concept_id").agg(F.array_join(F.array_sort(F.collect_list("alias")), " ").alias("ca")), "concept_id", "left").select("concept_id", F.concat_ws(" ", F.replace("concept_id", F.lit("."), F.lit(" ")), "name", "description", "ca").alias("w"))
    index = words.select("concept_id", F.col("w").alias("x")).union(v["binding_aliases"].select("concept_id", "alias"))
    index = index.select("concept_id", F.explode(T.keywords(T.normal(F.col("x"), exact=True))).alias("word")).distinct()
    by_word = base.select(*KEY, F.explode("q").alias("word")).join(small(index), "word").select(*KEY, "concept_id")
    reach = by_concept.select(*KEY, "concept_id").union(heard).union(local.filter("concept_id IS NOT NULL").select(*KEY, "concept_id")).union(by_word)
    reach = written(reach.distinct(), "reach")
    entries = scopes.join(small(bound), "scope").select(*KEY, "concept_id", *CONTEXT, "n").join(reach, [*KEY, "concept_id"], "left_semi")
    entries = entries.unionByName(lone.join(reach, KEY).join(small(bound), "concept_id").select(*KEY, "concept_id", *CONTEXT, "n"))
    entries = entries.join(per_scope, [*KEY, "scope"], "left").filter(~F.col("scope").isin(PHASED) | F.col("hinted").isNull() | F.array_contains("hinted", F.col("phase")))
    free = concept.join(bound.select("concept_id").distinct(), "concept_id", "left_anti").select("concept_id")
    open_ = reach.join(small(free), "concept_id").select(*KEY, "concept_id", *[F.lit(None).cast("string").alias(c) for c in CONTEXT], F.lit(1 << 40).alias("n"), F.lit(None).cast("array<string>").alias("hinted"))
    entries = entries.join(small(concept.select("concept_id")), "concept_id").select(*KEY, "concept_id", *CONTEXT, "n", "hinted").unionByName(open_)
    pair = base.select(*KEY, (F.size(_matched(F.col("t"), PAIR_TERMS)) > 0).alias("pair"))
    entries = entries.join(explicit.withColumn("explicit", F.lit(True)), [*KEY, "scope"], "left").join(pair, KEY)
    gated = F.col("concept_id").startswith("physical.") | F.col("concept_id").startswith("fluid.pvt")
    named = F.col("phase").isNull() | F.coalesce(F.array_contains("hinted", F.col("phase")), F.lit(False))
    both = F.coalesce(F.array_contains("hinted", "oil") & F.array_contains("hinted", "water"), F.lit(False)) | F.col("pair")
    ok = F.col("scope").isNull() | ~gated | ((F.coalesce("explicit", F.lit(False)) | (F.col("scope") == "relative_permeability")) & named)
    entries = entries.withColumn("supported", ok & (~F.coalesce(F.col("phase_system") == "oil_water", F.lit(False)) | both))

    null_key = [F.coalesce(F.col(c), F.lit("")).alias(f"k_{c}") for c in CONTEXT]
    keyed = [*KEY, "concept_id", *[f"k_{c}" for c in CONTEXT]]
    entries = written(entries.select("*", *null_key), "entries")
    by_binding = hit.join(small(bound_alias.select("concept_id", *null_key, "term", "shown")), "term").drop("term")
    said = entries.join(by_concept, [*KEY, "concept_id"]).select(*keyed, "exact", "shown").union(entries.join(by_binding, keyed).select(*keyed, "exact", "shown"))
    aliased = said.groupBy(*keyed).agg(F.max("exact").alias("exact"), F.array_sort(F.collect_set(F.when(F.col("exact"), F.col("shown")))).alias("e"), F.array_sort(F.collect_set("shown")).alias("all"))
    rows = entries.join(aliased, keyed, "left")
    made = lambda df, seq, kind, score, shown: df.select(*KEY, "concept_id", *CONTEXT, score.alias("score"), F.lit(kind).alias("match_type"), shown.alias("terms"), "supported", F.struct(F.lit(seq).alias("a"), F.col("n").alias("b")).alias("seq"))
    bounded = entries.join(local.filter("concept_id IS NOT NULL").select(*KEY, "concept_id").distinct(), [*KEY, "concept_id"])
    everything = v["binding_aliases"].groupBy("concept_id", *null_key).agg(F.array_join(F.array_sort(F.collect_list("alias")), " ").alias("ba"))
    quiet = rows.filter("exact IS NULL").join(small(words), "concept_id").join(small(everything), ["concept_id", *[f"k_{c}" for c in CONTEXT]], "left").join(base.select(*KEY, "q"), KEY)
    common = F.array_sort(F.array_intersect("q", T.keywords(T.normal(F.concat_ws(" ", "w", "ba"), exact=True))))
    quiet = quiet.withColumn("common", common).filter(F.size("common") > 0)
    score = F.round(F.least(F.lit(0.79), 0.45 + 0.34 * F.size("common") / F.greatest(F.size("q"), F.lit(1))), 6)
    from_profile = profile_matches(blocks, list(profiles)).join(small(concept.select("concept_id")), "concept_id")
    fanned = from_profile.filter("NOT bound").drop(*CONTEXT).join(small(bound.drop("n")), "concept_id", "left").select(*KEY, "concept_id", *CONTEXT, "score", "term")
    source = from_profile.filter("bound").select(*KEY, "concept_id", *CONTEXT, "score", "term").unionByName(fanned).withColumn("supported", F.lit(True)).withColumn("n", F.lit(0).cast("long"))
    found = (
        made(source, 0, "source_mapping", F.col("score"), F.array("term")).unionByName(made(bounded, 1, "bounded_context", F.lit(0.9), F.array("concept_id")))
        .unionByName(made(rows.filter("exact IS NOT NULL"), 2, "alias", F.when(F.col("exact"), 1.0).otherwise(0.9), F.when(F.col("exact"), F.col("e")).otherwise(F.col("all")))).unionByName(made(quiet, 3, "keyword", score, F.col("common")))
    )
    best = best_per_key(found.select("*", *null_key), keyed).withColumn("ctx", F.to_json(F.struct(*CONTEXT)))
    return top_k(best, KEY, k, "concept_id", "ctx").select(*KEY, "rank", "concept_id", *CONTEXT, "score", "match_type", "terms", "supported")


def sibling_metadata(blocks: DataFrame, metadata: DataFrame) -> DataFrame:
    """Metadata of the same JSON object, by the parent of the location; asset names are not shared."""
    parent = F.regexp_replace("source_location", r"\.[^.]*$", "")
    left = blocks.select("case_id", "block_id", parent.alias("parent"))
    right = metadata.filter(T.field_key(F.col("key")) != "asset").select("case_id", F.col("block_id").alias("from_block"), parent.alias("parent"), "key", "value")
    return left.join(right, ["case_id", "parent"]).filter("block_id <> from_block").drop("parent")


def container_key(location: Column) -> Column:
    """The name of the object a block lies in; rows and points take their parent's."""
    last, up = F.regexp_extract(location, r"([^.]*)$", 1), F.regexp_extract(location, r"([^.]*)\.[^.]*$", 1)
    return F.when(location.startswith("$."), F.when(last.isin("rows", "points"), up).otherwise(last))


def metadata_kind(block_type: Column, key: Column, value: Column, text: Column, heading: str, metadata: str, absence: str) -> Column:
    """Metadata, heading or absence_statement, or null. The three patterns are the user's, matched to whole lines."""
    k = T.field_key(key)
    basis = (k == "saturationbasis") & F.lower(value).isin("fraction", "percent", "%")
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    is_meta = lambda x: x.rlike(f"(?i)^(?:{metadata})$")
    covered = (F.size(lines) > 0) & F.forall(lines, lambda x: x.rlike(f"^(?:{heading})$") | is_meta(x))
    of_text = F.when(covered, F.when(F.exists(lines, is_meta), "metadata").otherwise("heading")).when(F.trim(text).rlike(f"^(?:{absence})$"), "absence_statement")
    return F.when((block_type == "key_value") & (k.isin("asset", "sourcesample", "sampleid") | basis), "metadata").when(block_type == "text", of_text)
