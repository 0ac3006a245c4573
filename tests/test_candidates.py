"""Retrieval over a small vocabulary of our own."""

import pytest
from pyspark.sql import functions as F

from lithoflow.operators import candidates as C
from lithoflow.sources import vocabulary

FILES = {
    "main.yaml": "ontology: {version: 0.1.0, convention_file: conv.yaml, concept_files: [c.yaml], scope_file: s.yaml}",
    "conv.yaml": "convention: {version: 0.1.0, value_types: [float], constraint_keys: [], dimensions: {}, relationships: {}}",
    "c.yaml": """
concepts:
- {concept_id: fluid.oil, name: Oil, description: crude, value_type: entity, aliases: [oil, 原油]}
- {concept_id: fluid.water, name: Water, description: brine, value_type: entity, aliases: [water, 水]}
- {concept_id: fluid.gas, name: Gas, description: vapour, value_type: entity, aliases: [gas]}
- {concept_id: physical.viscosity, name: Viscosity, description: flow resistance of a liquid, value_type: float, aliases: [viscosity, 粘度]}
- {concept_id: physical.density, name: Density, description: mass per volume, value_type: float, aliases: [density]}
- {concept_id: well, name: Well, description: a hole, value_type: entity, aliases: [well name]}
- {concept_id: old.thing, name: Old, description: x, value_type: float, aliases: [well name], status: deprecated}
- {concept_id: rock.compressibility, name: Rock squeeze, description: rock, value_type: float, aliases: [rock compressibility]}
- {concept_id: schedule.report_interval, name: Interval, description: output step, value_type: duration, aliases: [report step]}
""",
    "s.yaml": """
scopes:
- {scope_id: pvt, phases: [oil, water], aliases: [PVT], bindings: [{concept_id: physical.viscosity, context: {scope: pvt, phase: oil, role: property}, aliases: [oil viscosity, MUO]}, {concept_id: physical.viscosity, context: {scope: pvt, phase: water, role: property}, aliases: [water viscosity]}]}
- {scope_id: fluid_properties, phases: [oil], aliases: [fluid report], bindings: [{concept_id: physical.density, context: {scope: fluid_properties, phase: oil, role: property}}]}
- {scope_id: well_controls, aliases: [controls], bindings: [{concept_id: well, context: {scope: well_controls, role: entity}, aliases: [Well_ID]}]}
- {scope_id: rock, aliases: [rock data], bindings: [{concept_id: rock.compressibility, context: {scope: rock, role: property}}]}
- {scope_id: schedule, aliases: [schedule], bindings: [{concept_id: schedule.report_interval, context: {scope: schedule, role: report_interval}}]}
""",
}


@pytest.fixture(scope="module")
def frames(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("vocabulary")
    for n, t in FILES.items():
        (d / n).write_text(t)
    out = vocabulary.load(d).frames(spark)
    return {k: df.cache() for k, df in out.items()}


def blocks(spark, texts):
    rows = [("c", f"b{n}", "text", t, None, None) if isinstance(t, str) else ("c", f"b{n}", "table", t[0], t[1], t[2]) for n, t in enumerate(texts)]
    return spark.createDataFrame(rows, "case_id string, block_id string, block_type string, text string, columns array<string>, rows array<array<string>>")


def test_ranked_matches(spark, frames):
    got = {}
    for r in C.retrieve(blocks(spark, ["oil viscosity", "MUO", "PVT: viscosity of water is 0.5", "the bottom of a hole", "  ", "岩石压缩系数", "每3个月输出一次"]), frames, k=3).collect():
        got.setdefault(r["block_id"], {})[r["rank"]] = (r["concept_id"], r["phase"], r["score"], r["match_type"], r["supported"])
    assert got["b0"][1] == ("physical.viscosity", "oil", 1.0, "alias", True) and got["b1"][1][:4] == ("physical.viscosity", "oil", 1.0, "alias")
    assert ("physical.viscosity", "water", 0.9, "alias", True) in got["b2"].values() and not any(x[1] == "oil" for x in got["b2"].values())
    assert got["b3"][1][0] == "well" and got["b3"][1][3] == "keyword" and got["b3"][1][2] < 0.8
    assert "b4" not in got and got["b5"][1][:4] == ("rock.compressibility", None, 0.9, "bounded_context") and got["b6"][1][0] == "schedule.report_interval"
    assert all(x[0] != "old.thing" for b in got.values() for x in b.values())


def test_unknown_phase_keeps_choices_unsupported(spark, frames):
    got = [r for r in C.retrieve(blocks(spark, ["PVT viscosity table"]), frames).collect() if r["concept_id"] == "physical.viscosity"]
    assert {r["phase"] for r in got} == {"oil", "water"} and not any(r["supported"] for r in got)


def test_table_names_its_phases(spark, frames):
    table = ("pressure viscosity fluid", ["Fluid", "Pressure", "Viscosity"], [["oil", "1", "2"], ["oil", "2", "3"]])
    got = [r for r in C.retrieve(blocks(spark, [table]), frames).collect() if r["concept_id"] == "physical.viscosity"]
    assert [(r["phase"], r["supported"]) for r in got] == [("oil", True)]


def test_profiles(spark, frames):
    profiles = [{"source_system": "a", "activation_terms": ["SWOF", "pcow"], "requires_pressure_unit": True, "entries": [{"source_term": "Well_No", "concept_id": "well"}, {"source_term": "mu", "concept_id": "physical.viscosity"}]}]
    df = blocks(spark, ["SWOF pcow Well_No 1", "SWOF Well_No 1", "SWOF pcow in bar mu", "METRIC\nSWOF pcow"])
    got = [(r["block_id"], r["concept_id"], r["score"]) for r in C.retrieve(df, frames, profiles, k=20).filter("match_type = 'source_mapping'").collect()]
    assert sorted(got) == [("b0", "well", 0.98), ("b2", "physical.viscosity", 0.98), ("b2", "physical.viscosity", 0.98)]
    assert [r["block_id"] for r in C.missing_pressure_unit(df, profiles).collect()] == ["b0"]


def test_order_and_partitions_do_not_matter(spark, frames):
    df = blocks(spark, ["oil viscosity and density", "water viscosity; oil density", "well name"])
    a, b = ([tuple(map(str, r)) for r in C.retrieve(x, frames, k=5).orderBy("block_id", "rank").collect()] for x in (df, df.orderBy(F.desc("block_id")).repartition(3)))
    assert a == b and len(a) > 4


def test_context_helpers(spark):
    df = spark.createDataFrame([("c", "m", "$.a.sample", "sampleId", "S"), ("c", "x", "$.asset", "asset", "F"), ("c", "t", "$.a.rows", None, None)], "case_id string, block_id string, source_location string, key string, value string")
    got = C.sibling_metadata(df.filter("block_id = 't'"), df.filter("key IS NOT NULL")).collect()
    assert [(r["block_id"], r["from_block"], r["value"]) for r in got] == [("t", "m", "S")]
    assert df.filter("block_id = 't'").select(C.container_key(F.col("source_location"))).first()[0] == "a"
    kinds = spark.createDataFrame([("key_value", "Sample_ID", "1", None), ("key_value", "saturation basis", "Percent", None), ("key_value", "depth", "1", None), ("text", None, None, "Log\nsample: 7"), ("text", None, None, "Log"), ("text", None, None, "nothing here."), ("text", None, None, "Log\nfree")], "t string, k string, v string, x string")
    kind = C.metadata_kind(F.col("t"), F.col("k"), F.col("v"), F.col("x"), "Log", r"sample:\s*\d+", r"nothing here\.?")
    assert [r[0] for r in kinds.select(kind).collect()] == ["metadata", "metadata", None, "metadata", "heading", "absence_statement", None]
