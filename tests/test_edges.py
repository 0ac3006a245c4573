"""Ports, sinks, sources and vocabulary files that no query reaches."""

import json

import pytest
from pyspark.sql import functions as F

from lithoflow.operators import contracts, ocr
from lithoflow.operators import ports as P
from lithoflow.sources import blocks, shared, sinks, vocabulary


def test_prompts_name_structural_parents_first(spark):
    ddl = f"case_id string, block_id string, concept_id string, context {contracts.CONTEXT_DDL}, score double, rank int"
    rows = [("c", "b", "physical.viscosity", ("pvt", "oil", "property", None), 0.9, 1), ("c", "b", "fluid.pvt", ("pvt", "oil", "model", None), 0.9, None)]
    text = spark.createDataFrame([("c", "b", "some text"), ("c", "d", "no candidates")], "case_id string, block_id string, text string")
    got = P.prompt_rows(spark.createDataFrame(rows, ddl), text).collect()
    assert [r["block_id"] for r in got] == ["b"]
    prompt = json.loads(got[0]["prompt"])
    assert prompt["source"] == "some text" and [c["concept_id"] for c in prompt["candidates"]] == ["fluid.pvt", "physical.viscosity"]
    again = P.correction(got[0]["prompt"], "SOME_CODE", "why").rsplit("\n", 1)
    assert again[0] == got[0]["prompt"] and json.loads(again[1])["error"] == "SOME_CODE"


def test_selector_schemas():
    assert contracts.selector_schema("rock.compressibility") == {"type": "object", "required": [], "additionalProperties": False, "properties": {}}
    got = contracts.selector_schema("a[{table_id}].points[{point_index}].x")
    assert got["required"] == ["table_id", "point_index"] and got["properties"]["point_index"] == {"type": "integer", "minimum": 0}
    assert contracts.selector_schema("w[{control_type}]")["properties"]["control_type"]["enum"][-1] == "bhp"


def test_spreadsheet_port_needs_its_library():
    try:
        import openpyxl  # noqa: F401
    except ImportError:
        with pytest.raises(ImportError):
            P.xlsx_parser(b"")


def test_boxes_and_views(spark):
    df = spark.createDataFrame([("c", "p", 1.0, None, "bar", 0.9, 1.0, 2.0, 3.0, 4.0)], "case_id string, path string, value double, text string, unit string, confidence double, x0 double, top double, x1 double, bottom double")
    assert ocr.business_view(df).columns == ["case_id", "path", "value", "text", "unit"]
    box = [F.col(c) for c in ("x0", "top", "x1", "bottom")]
    assert list(df.select(*ocr.shifted(box, [F.lit(10.0), F.lit(20.0)])).first()) == [11.0, 22.0, 13.0, 24.0]


def test_files_and_texts(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("one\n\ntwo")
    got = blocks.blocks_of(blocks.read_sources(spark, str(folder))).collect()
    assert [(r["source_id"], r["text"]) for r in got] == [("a.txt", "one"), ("a.txt", "two")]
    sinks.write_texts(spark.createDataFrame([("c", "x", 1)], "case_id string, text string, more int"), str(tmp_path / "out"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("c", "x")]
    rows = spark.createDataFrame([("text", "body", "Title", "{}"), ("text", "body", None, "{}"), ("table", None, "Title", "{}")], "block_type string, text string, title string, content string")
    found = rows.select(blocks.search_text(F.col("block_type"), F.col("text"), F.col("title"), F.col("content")).alias("t")).collect()
    assert [r["t"] for r in found] == ["Title\nbody", "body", "{}"]


def test_profiles_and_platforms(tmp_path):
    (tmp_path / "a.yaml").write_text("source_system: one\nactivation_terms: [x]\nentries: [{source_term: Q, concept_id: c}]\n")
    (tmp_path / "b.yaml").write_text("source_system: two\nentries: [{source_term: R, concept_id: d}]\n")
    found = vocabulary.load_profiles(tmp_path)
    assert [p["source_system"] for p in found] == ["one", "two"]
    assert [p["source_system"] for p in vocabulary.select_profiles(found)] == ["one"] and len(vocabulary.select_profiles(found, "two")) == 2
    with pytest.raises(vocabulary.VocabularyError):
        vocabulary.select_profiles(found, "three")
    path = tmp_path / "p.yaml"
    path.write_text("platform: P\nmappings:\n  lone: {target_type: A}\n  rule2: {concept_id: twice, target_type: B, semantic_context: {scope: s}}\n")
    platform = vocabulary.load_platform(path)
    bind = lambda concept, scope: {"concept_id": concept, "context": {"scope": scope}}
    bound = [bind("lone", "r"), bind("twice", "s"), bind("twice", "t")]
    assert vocabulary.output_rules(platform, bound) == {("lone", ("r", None, None, None)): "A", ("twice", ("s", None, None, None)): "B"}
    for wrong in ([*bound, bind("lone", "q")], bound[1:], [bound[0], bound[2]]):  # ambiguous, unbound, bound elsewhere
        with pytest.raises(vocabulary.VocabularyError):
            vocabulary.output_rules(platform, wrong)
    same = platform | {"rules": platform["rules"] | {("lone", ("r", None, None, None)): "C"}}
    with pytest.raises(vocabulary.VocabularyError):
        vocabulary.output_rules(same, bound)


def test_large_frames_get_no_broadcast_hint(spark, monkeypatch):
    df = spark.range(5)
    assert "broadcast" in shared.small(df)[0]._jdf.queryExecution().logical().toString().lower()
    monkeypatch.setattr(shared, "MOST_ROWS", 4)
    assert "broadcast" not in shared.small(df)[0]._jdf.queryExecution().logical().toString().lower()


def test_structural_values_and_identities(spark):
    from lithoflow.operators import canonical, validate

    ddl = f"case_id string, seq int, concept_id string, context {contracts.CONTEXT_DDL}, selectors map<string,string>, canonical_path string, value_num double, value_str string, source_unit string, canonical_unit string, confidence double"
    table = ("relative_permeability", None, "model", "oil_water")
    texts = ['{"phase_system": ["oil", "water"]}', "no object", '{"id": "U", "phase_system": ["oil", "water"]}', '{"phase_system": ["gas", "oil"]}']
    rows = [(f"c{n}", 1, "scal.relative_permeability", table, {"table_id": "T"}, None, None, t, None, None, 0.9) for n, t in enumerate(texts)] + [("c4", 1, "fluid.pvt", ("pvt", "oil", "model", None), {}, None, None, "table", None, None, 0.9)]
    concepts = spark.createDataFrame([("scal.relative_permeability", None), ("fluid.pvt", None)], "concept_id string, canonical_unit string")
    bound = spark.createDataFrame([(c, *x) for c, x, _ in contracts.contracts()], "concept_id string, scope string, phase string, role string, phase_system string")
    good, issues = canonical.build(spark.createDataFrame(rows, ddl), concepts, bound)
    assert [r["case_id"] for r in good.collect()] == ["c0"]
    assert {(r["case_id"], r["code"]) for r in issues.collect()} == {("c1", "STRUCTURAL_VALUE_REQUIRED"), ("c2", "ENTITY_SELECTOR_MISMATCH"), ("c3", "SEMANTIC_CONTEXT_CONFLICT"), ("c4", "STRUCTURAL_VALUE_REQUIRED")}
    wells = spark.createDataFrame([("c", "wells[A].id", "well", None, "X", None), ("c", "wells[B].id", "well", None, "X", None), ("d", "wells[A].id", "well", None, "A", None)], "case_id string, path string, concept_id string, value double, text string, unit string")
    assert [(r["case_id"], r["path"]) for r in validate.domain_level(wells, {}).filter("code = 'DUPLICATE_ENTITY_ID'").collect()] == [("c", "wells")]
