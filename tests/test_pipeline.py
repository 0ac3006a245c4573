"""Sources and drafts to text, and the OCR-side rules."""

import pytest
from pyspark.sql import functions as F

from lithoflow import pipeline
from lithoflow.operators import contracts, ocr
from lithoflow.sources import vocabulary

FILES = {
    "main.yaml": "ontology: {version: 0.1.0, convention_file: conv.yaml, concept_files: [c.yaml], scope_file: s.yaml}",
    "conv.yaml": "convention: {version: 0.1.0, value_types: [float], constraint_keys: [], dimensions: {}, relationships: {}}",
    "c.yaml": """
concepts:
- {concept_id: well, name: Well, description: hole, value_type: entity, aliases: [well id]}
- {concept_id: well.producer, name: Producer, description: produces, value_type: entity_type, aliases: [producer]}
- {concept_id: well.control.liquid_rate, name: Liquid rate, description: target, value_type: float, canonical_unit: m3/day, aliases: [liquid rate]}
- {concept_id: well.constraint.minimum_bhp, name: Minimum pressure, description: limit, value_type: float, canonical_unit: bar, aliases: [min bhp]}
""",
    "s.yaml": """
scopes:
- scope_id: well_controls
  aliases: [well id]
  bindings:
  - {concept_id: well, context: {scope: well_controls, role: entity}}
  - {concept_id: well.producer, context: {scope: well_controls, role: type}}
  - {concept_id: well.control.liquid_rate, context: {scope: well_controls, role: control}}
  - {concept_id: well.constraint.minimum_bhp, context: {scope: well_controls, role: constraint}}
""",
}
DRAFT = f"case_id string, block_id string, seq int, draft_block_id string, concept_id string, context {contracts.CONTEXT_DDL}, selectors map<string,string>, canonical_path string, value_num double, value_str string, source_unit string, canonical_unit string, confidence double"


def test_translate(spark, tmp_path):
    for n, t in FILES.items():
        (tmp_path / n).write_text(t)
    frames = vocabulary.load(tmp_path).frames(spark)
    csv = "Well ID,Type,Liquid rate,Min BHP\nP-1,producer,500,12\n"
    files = {"good.csv": csv, "doubt.csv": csv, "twice.csv": csv, "bad.csv": "a,b\n1\n", "range.csv": csv}
    sources = spark.createDataFrame([(n, n, bytearray(t.encode())) for n, t in files.items()], "source_id string, file_name string, content binary")
    s, rows = {"well_id": "P-1"}, []
    for case in ("good.csv", "doubt.csv", "twice.csv", "range.csv"):
        confidence = 0.5 if case == "doubt.csv" else 0.96
        facts = [("well", None, "P-1", None, None), ("well.producer", None, "producer", None, None), ("well.control.liquid_rate", 500.0, None, "m3/d", "m3/day"), ("well.constraint.minimum_bhp", -1.0 if case == "range.csv" else 12.0, None, "MPa", "bar")]
        facts += [facts[2]] * (case == "twice.csv")
        rows += [(case, "block_0001", n, "block_0001", c, None, s, None, v, t, u, cu, confidence) for n, (c, v, t, u, cu) in enumerate(facts)]
    got = pipeline.translate(sources, spark.createDataFrame(rows, DRAFT), frames, dialect="D", constraints={"well.constraint.minimum_bhp": {"minimum": 0}})
    assert {r["case_id"]: r["status"] for r in got.status.collect()} == {"good.csv": "success", "doubt.csv": "review_required", "twice.csv": "review_required", "bad.csv": "review_required", "range.csv": "validation_failed"}
    assert {(r["case_id"], r["code"]) for r in got.issues.filter("severity = 'error'").collect()} == {("bad.csv", "INCONSISTENT_TABLE_WIDTH"), ("twice.csv", "DUPLICATE_CANONICAL_PATH"), ("range.csv", "VALUE_OUT_OF_RANGE")}
    texts = {r["case_id"]: r["text"] for r in got.texts.collect()}
    assert texts.keys() == {"good.csv"} and "  'P-1' 'OPEN' 'LRAT' 1* 1* 1* 500 1* 120 /" in texts["good.csv"]


BOX = "x0 double, top double, x1 double, bottom double"


def test_boxes(spark):
    df = spark.createDataFrame([([[0.0, 5.0], [4.0, 1.0]],), ([],), (None,)], "p array<array<double>>")
    got = [r[0] for r in df.select(ocr.polygon_box(F.col("p"))).collect()]
    assert tuple(got[0]) == (0.0, 1.0, 4.0, 5.0) and got[1] is None and got[2] is None
    b = spark.createDataFrame([(0.0, 0.0, 50.0, 100.0), (60.0, 0.0, 50.0, 10.0), (0.0, 0.0, 150.0, 10.0)], BOX)
    cols = [F.col(c) for c in ocr.BOX]
    assert [r[0] is None for r in b.select(ocr.to_points(cols, (F.lit(100.0), F.lit(200.0)), (F.lit(10.0), F.lit(20.0)))).collect()] == [False, True, True]
    assert [r[0] and r[0]["x1"] for r in b.select(ocr.clamped(cols, F.lit(100.0), F.lit(100.0))).collect()] == [50.0, None, 100.0]
    c = spark.createDataFrame([(1.5,), (-1.0,), (float("nan"),), (None,)], "v double")
    assert [r[0] for r in c.select(ocr.confidence(F.col("v"))).collect()] == [1.0, 0.0, None, None]


def test_region_texts(spark):
    d = spark.createDataFrame([("r", "a", 10.0, 0.0), ("r", "b", 0.0, 0.0), ("q", "a", 0.0, 0.0)], "region_id string, span_id string, top double, x0 double")
    t = spark.createDataFrame([("r", "a", "two", 0.9), ("r", "b", "one", 0.8), ("q", "a", "x", 0.5), ("q", "z", "y", 0.5)], "region_id string, span_id string, text string, score double")
    assert {r["region_id"]: (r["text"], r["confidence"], r["code"]) for r in ocr.region_texts(d, t).collect()} == {"r": ("one\ntwo", 0.8, None), "q": ("x", 0.5, "OCR_SPAN_UNKNOWN")}


def test_splits(spark):
    rows = [("ok", 1, 0, 50, 50, 100), ("ok", 2, 0, 0, 100, 49), ("cover", 1, 0, 0, 100, 100), ("cover", 2, 0, 0, 10, 10), ("cross", 1, 0, 0, 60, 60), ("cross", 2, 40, 0, 90, 60), ("one", 1, 0, 0, 10, 10)]
    df = spark.createDataFrame([(n, i, *map(float, b), 100.0, 100.0) for n, i, *b in rows], f"node_id string, box_id int, {BOX}, width double, height double")
    assert [(r["node_id"], r["box_id"]) for r in ocr.accepted_splits(df).orderBy("node_id", "position").collect()] == [("ok", 2), ("ok", 1)]


def test_payloads_and_flags(spark):
    r = spark.createDataFrame([(1, "a", 0.0, 0.0, 9.0, 9.0), (1, "b", 50.0, 0.0, 60.0, 9.0), (2, "c", 0.0, 0.0, 9.0, 9.0)], f"page int, region_id string, {BOX}")
    p = spark.createDataFrame([(1, "a", 90.0, 90.0, 99.0, 99.0), (1, "y", 51.0, 1.0, 61.0, 8.0), (2, "z", 70.0, 0.0, 79.0, 9.0)], f"page int, payload_id string, {BOX}")
    assert {x["region_id"]: x["payload_id"] for x in ocr.payload_of(r, p).collect()} == {"a": "a", "b": "y", "c": "z"}
    f = spark.createDataFrame([(["A", "A"], 0.5, False), (["OCR_LOW_CONFIDENCE", "B"], 0.1, True), ([], None, False)], "f array<string>, s double, m boolean")
    assert [x[0] for x in f.select(ocr.review_flags(F.col("f"), F.col("s"), F.col("m"))).collect()] == [["A", "OCR_LOW_CONFIDENCE"], ["B"], ["OCR_CONFIDENCE_MISSING"]]


def test_unknown_platform(spark):
    with pytest.raises(KeyError):
        pipeline.RENDERERS["none"]
