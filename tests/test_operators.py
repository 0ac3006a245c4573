"""Operators on small rows of our own."""

import json

import pytest
from pyspark.sql import functions as F

from lithoflow.functions import text as T
from lithoflow.functions import units
from lithoflow.operators import canonical, checks, chunk, contracts, graph, joins, outcomes, render, retrieve, validate
from lithoflow.sources import blocks, vocabulary


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize(
    ("value", "source", "target", "want"),
    [(1.0, "psi", "bar", 0.0689475729316836), (2.0, "MPa", "bar", 20.0), (1.0, "bbl per day", "m3/day", 0.158987294928), (3.0, "Pa·s", "cP", 3000.0), (1.0, "quarter", "day", 91.25), (25.0, " % ", "fraction", 0.25), (1.0, "psi^-1", "1/bar", 14.503773773020923), (-0.0, "bar", "bar", 0.0)],
)
def test_units(spark, value, source, target, want):
    got = units.convert(spark.createDataFrame([(value, source, target)], "v double, s string, t string"), "v", "s", "t", exact=True).first()
    assert got["unit_value"] == pytest.approx(want, rel=1e-12) and got["unit_code"] is None and str(got["unit_value"])[0] != "-"


def test_unit_issues(spark):
    df = spark.createDataFrame([(1.0, "furlong", "bar"), (1.0, "bar", "day"), (float("nan"), "bar", "bar"), (None, "bar", "bar"), (1.0, None, "bar"), (1.0, "degC", "degC")], "v double, s string, t string")
    assert [r["unit_code"] for r in units.convert(df, "v", "s", "t").collect()] == ["UNSUPPORTED_UNIT", "INCOMPATIBLE_UNITS", "INVALID_MAGNITUDE", "INVALID_MAGNITUDE", "UNSUPPORTED_UNIT", "UNSUPPORTED_UNIT"]


def test_normalisers(spark):
    df = spark.createDataFrame([("oilDensity_Kg",), ("PVTTable",), ("Straße ＡＢＣ",), (None,)], "t string")
    got = df.select(T.normal(F.col("t"), exact=True), T.scope_normal(F.col("t"), exact=True), T.plain_normal(F.col("t"), exact=True), T.field_key(F.col("t"))).collect()
    assert tuple(got[0]) == ("oil density kg", "oil density kg", "oildensity kg", "oildensitykg")
    assert got[1][1] == "pvt table" and got[1][0] == "pvttable" and got[2][0] == "strasse abc" and got[3][0] is None


def test_contains(spark):
    df = spark.createDataFrame([("bottom of it", "bo"), ("the bo value", "bo"), ("原油 体积系数 为", "体积系数"), ("a . b", "."), ("x", "")], "t string, m string")
    assert [r[0] for r in df.select(T.contains(F.col("t"), F.col("m"))).collect()] == [False, True, True, True, False]


def test_token_estimate_as_python(spark):
    texts = ["Hello, world_42!", "压力 12.5 MPa", "a" * 9, "", "é ß"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.token_estimate(F.col("t"))).collect()]
    assert got == [chunk.tokens(t) for t in texts]


def source(spark, name, content):
    return blocks.blocks_of(spark.createDataFrame([(name, name, content if content is None else bytearray(content.encode()))], "source_id string, file_name string, content binary")).collect()


def test_text_csv_json_blocks(spark):
    t = source(spark, "a.TXT", "one\ntwo\n\n \nthree")
    assert [(r["block_id"], r["text"], r["source_location"]) for r in t] == [("block_0001", "one\ntwo", "lines 1-2"), ("block_0002", "three", "line 5")]
    c = source(spark, "a.csv", '﻿a,b\n1,"x,y"\n2,z\n')
    assert (c[0]["columns"], c[0]["rows"], c[0]["source_location"]) == (["a", "b"], [["1", "x,y"], ["2", "z"]], "rows 1-2")
    j = source(spark, "a.json", json.dumps({"asset": "X", "controls": [{"id": 1, "u": "bar"}, {"id": 2, "v": 3}], "odd key": {"e": {}}, "list": [1, 2], "rows": [{"a": 1}, {"a": 2}]}))
    assert [(r["block_type"], r["source_location"]) for r in j] == [("key_value", "$.asset"), ("table", "$.controls[0]"), ("table", "$.controls[1]"), ("key_value", '$["odd key"].e'), ("key_value", "$.list"), ("table", "$.rows")]


@pytest.mark.parametrize(
    ("name", "content", "code"),
    [("a.csv", "a,b\n1\n2,3,4\n", "INCONSISTENT_TABLE_WIDTH"), ("a.json", "{", "MALFORMED_JSON"), ("a.doc", "x", "UNSUPPORTED_SOURCE_TYPE"), ("a.txt", None, "SOURCE_NOT_FOUND"), ("a.pdf", "x", "UNSUPPORTED_SOURCE_TYPE")],
)
def test_bad_sources_are_rows(spark, name, content, code):
    got = source(spark, name, content)
    assert [r["code"] for r in got] == [code] and got[0]["block_id"] is None
    assert code != "INCONSISTENT_TABLE_WIDTH" or got[0]["message"] == "records 2, 3"


def test_empty_sources(spark):
    assert source(spark, "a.csv", "") == source(spark, "a.csv", "a,b\n") == source(spark, "a.txt", " \n") == []


def test_inline_sources(spark):
    df = spark.createDataFrame([("1", None, "hi", None), ("2", "a.txt", None, "aGk="), ("3", "a.txt", None, "%%%"), ("4", "../a.txt", "x", None)], "source_id string, file_name string, text string, base64 string")
    got = blocks.inline_sources(df).orderBy("source_id").collect()
    assert [r["code"] for r in got] == [None, None, "INVALID_BASE64_SOURCE", "INVALID_FILE_NAME"] and bytes(got[1]["content"]) == b"hi"


def test_best_keeps_first_of_ties(spark):
    df = spark.createDataFrame([("k", 0.9, 1, "bounded"), ("k", 0.9, 2, "alias"), ("k", 0.5, 0, "low")], "key string, score double, seq int, kind string").repartition(3)
    assert retrieve.best_per_key(df, ["key"]).first()["kind"] == "bounded"
    with pytest.raises(ValueError):
        retrieve.top_k(df, ["key"], 0)


def test_bands(spark):
    df = spark.createDataFrame([(0.79,), (0.8,), (0.949,), (0.95,)], "c double")
    assert [r[0] for r in df.select(retrieve.confidence_band(F.col("c"))).collect()] == ["review", "warning", "warning", "auto"]


def test_contracts_round_trip(spark):
    assert len(contracts.contracts()) == 34
    pick = {"well_id": "P-1", "table_id": "t_1", "point_index": "3", "control_type": "bhp"}
    data = [(c, x, {n: pick[n] for n in contracts.names_of(t)}, None, t.format(**pick)) for c, x, t in contracts.contracts()]
    df = spark.createDataFrame(data, f"concept_id string, context {contracts.CONTEXT_DDL}, selectors map<string,string>, canonical_path string, want string")
    assert all(r["path"] == r["want"] and r["code"] is None for r in contracts.resolve(df).collect())


@pytest.mark.parametrize("bad", ["A.1", "A[1]", "A/1", "A 1", "A\n", "", "x" * 129])
def test_unsafe_selectors(spark, bad):
    df = spark.createDataFrame([("well", None, {"well_id": bad}, None)], f"concept_id string, context {contracts.CONTEXT_DDL}, selectors map<string,string>, canonical_path string")
    assert contracts.resolve(df).first()["code"] == "INVALID_CANONICAL_SELECTORS"


def test_resolution_codes(spark):
    ctx = ("pvt", "oil", "model", None)
    data = [
        ("fluid.oil.pvt.viscosity", None, {}, "fluids.oil.pvt.points[2].viscosity", "fluids.oil.pvt.points[2].viscosity", None),
        ("physical.viscosity", ("pvt", "oil", "property", None), {}, "fluids.oil.pvt.points[2].viscosity", None, "CANONICAL_SELECTORS_REQUIRED"),
        ("physical.viscosity", None, {}, None, None, "SEMANTIC_CONTEXT_REQUIRED"),
        ("fluid.oil.pvt", ("pvt", "gas", "model", None), {}, None, None, "SEMANTIC_CONTEXT_CONFLICT"),
        ("fluid.pvt", ctx, {"well_id": "A"}, None, None, "INVALID_CANONICAL_SELECTORS"),
        ("fluid.pvt", ctx, {}, "fluids.gas.pvt", None, "CANONICAL_PATH_MISMATCH"),
        ("physical.temperature", ("reference_condition", None, "reference", None), {}, None, None, "UNSUPPORTED_CANONICAL_MAPPING"),
        ("well", None, {"well_id": "A"}, "wells[B].id", None, "CANONICAL_PATH_MISMATCH"),
    ]
    df = spark.createDataFrame([(n, *d) for n, d in enumerate(data)], f"n int, concept_id string, context {contracts.CONTEXT_DDL}, selectors map<string,string>, canonical_path string, want string, want_code string")
    for r in contracts.resolve(df).collect():
        assert (r["path"], r["code"]) == (r["want"], r["want_code"]), r


CONCEPTS = [("well", None, "entity"), ("well.producer", None, "entity_type"), ("well.control.liquid_rate", "m3/day", "float"), ("well.constraint.minimum_bhp", "bar", "float"), ("rock.compressibility", "1/bar", "float")]


def drafts(spark, data):
    ddl = f"case_id string, seq int, concept_id string, context {contracts.CONTEXT_DDL}, selectors map<string,string>, canonical_path string, value_num double, value_str string, source_unit string, canonical_unit string, confidence double"
    return spark.createDataFrame([(c, n, i, None, s, None, v, t, u, None, 0.9) for n, (c, i, s, v, t, u) in enumerate(data)], ddl)


def build(spark, data):
    concepts = spark.createDataFrame(CONCEPTS, "concept_id string, canonical_unit string, value_type string")
    bound = spark.createDataFrame([(c, *x) for c, x, _ in contracts.contracts()], "concept_id string, scope string, phase string, role string, phase_system string")
    return canonical.build(drafts(spark, data), concepts, bound)


def test_build_merge_nest(spark):
    w = {"well_id": "10"}
    data = [("a", "well", w, None, "10", None), ("a", "well", {"well_id": "9"}, None, "9", None), ("a", "well.producer", w, None, "producer", None), ("a", "well.control.liquid_rate", w, 100.0, None, "bbl/d"), ("a", "well.control.liquid_rate", w, 100.0, None, "bbl/day"), ("a", "well.constraint.minimum_bhp", w, 1.0, None, "MPa")]
    for order in (data, data[::-1]):
        good, issues = build(spark, order)
        assert issues.count() == 0 and good.count() == 5
        wells = canonical.nest_wells(good).first()["wells"]
        assert [x["id"] for x in wells] == ["9", "10"] and wells[0]["well_type"] == "unknown"
        assert wells[1]["controls"][0]["target"] == pytest.approx(15.8987294928) and wells[1]["controls"][0]["constraints"][0]["value"] == 10.0


def test_build_issues_stop_only_their_case(spark):
    w = {"well_id": "A"}
    data = [("bad", "well.control.liquid_rate", w, 1.0, None, "m3/d"), ("bad", "well.control.liquid_rate", w, 2.0, None, "m3/d"), ("bad", "nowhere", {}, 1.0, None, "bar"), ("bad", "well.producer", w, None, "injector", None), ("bad", "well", w, None, "B", None), ("bad", "rock.compressibility", {}, 1.0, None, None), ("ok", "well", w, None, "A", None)]
    good, issues = build(spark, data)
    assert {(r["case_id"], r["code"]) for r in issues.collect()} == {("bad", c) for c in ("DUPLICATE_CANONICAL_ASSIGNMENT", "UNKNOWN_ONTOLOGY_CONCEPT", "ONTOLOGY_VALUE_MISMATCH", "ENTITY_SELECTOR_MISMATCH", "SOURCE_UNIT_REQUIRED")}
    assert [r["case_id"] for r in good.collect()] == ["ok"]


def quantities(spark, data):
    return spark.createDataFrame([("c", p, i, v, t, u, None, None, None, None) for p, i, v, t, u in data], "case_id string, path string, concept_id string, value double, text string, unit string, scope string, phase string, role string, phase_system string")


def model(spark):
    data = [("rock.compressibility", "rock.compressibility", 4e-5, None, "1/bar"), ("rock.reference_pressure", "physical.pressure", 200.0, None, "bar"), ("wells[P-1].id", "well", None, "P-1", None), ("wells[P-1].well_type", "well.producer", None, "producer", None), ("wells[P-1].controls[liquid_rate].target", "well.control.liquid_rate", 500.0, None, "m3/day"), ("wells[P-1].controls[liquid_rate].constraints[minimum_bhp].value", "well.constraint.minimum_bhp", 120.5, None, "bar"), ("schedule.duration", "schedule.duration", 200.0, None, "day"), ("schedule.report_interval", "schedule.report_interval", 91.25, None, "day")]
    for i, (sw, krw, kro) in enumerate([(0.2, 0.0, 0.8), (0.5, 0.3, 0.3), (0.8, 0.7, 0.0)]):
        data += [(f"scal.relative_permeability[T].points[{i}].{f}", "physical", v, None, "fraction") for f, v in (("sw", sw), ("krw", krw), ("kro", kro))]
    return quantities(spark, data)


def test_render_include(spark):
    text = render.render_include(render.include_records(model(spark)), "X").first()["text"]
    assert text == "\n".join(["-- Generated deterministic demo INCLUDE", "-- Dialect: X", "-- Requires a compatible host deck; no missing values were guessed.", "", "-- PROPS", "ROCK", "  200 4e-05 /", "SWOF", "  0.2 0 0.8 1*", "  0.5 0.3 0.3 1*", "  0.8 0.7 0 1*", "/", "", "-- SCHEDULE", "WCONPROD", "  'P-1' 'OPEN' 'LRAT' 1* 1* 1* 500 1* 120.5 /", "/", "TSTEP", "  91.25 91.25 17.5 /", ""])


def test_render_fragment(spark):
    text = render.render_fragment(render.fragment_records(model(spark)), "Y").first()["text"]
    assert text.splitlines()[3:] == ["*WELL 'P-1'", "*PRODUCER 'P-1'", "*OPERATE 'P-1' *MAX *STL 500", "*OPERATE 'P-1' *MIN *BHP 120.5"]


def test_domain_level(spark):
    data = [("wells[A].controls[bhp].target", "q", -1.0, None, "bar"), ("schedule.duration", "d", 10.0, None, "day"), ("schedule.report_interval", "d", 20.0, None, "day"), ("fluids.oil.pvt", "fluid.pvt", None, '{"model_type": "table"}', None), ("scal.relative_permeability[S]", "scal", None, "{}", None)]
    for t, pts in {"D": [(0.2, 0, 1), (0.2, 0, 1)], "T": [(0.5, 0.1, 0.2), (0.2, 0.3, 0.1)], "O": [(0.3, 0, 1)]}.items():
        data += [(f"scal.relative_permeability[{t}].points[{i}].{f}", "p", float(v), None, "fraction") for i, p in enumerate(pts) for f, v in zip(("sw", "krw", "kro"), p, strict=True)]
    got = {(r["code"], r["path"]) for r in validate.domain_level(quantities(spark, data), {"q": {"exclusive_minimum": 0}}).collect()}
    at = lambda t: f"scal.relative_permeability[{t}].points"
    assert got == {("VALUE_OUT_OF_RANGE", "wells[A].controls[bhp].target"), ("REPORT_INTERVAL_EXCEEDS_DURATION", "schedule.report_interval"), ("TABLE_EMPTY", "fluids.oil.pvt.points"), ("TABLE_TOO_SHORT", at("O")), ("TABLE_TOO_SHORT", at("S")), ("DUPLICATE_COORDINATE", at("D")), ("COORDINATE_ORDER_WARNING", at("T")), ("KRW_TREND_WARNING", at("T")), ("KRO_TREND_WARNING", at("T"))}


def test_export_levels_and_short_circuit(spark):
    assert {r["code"] for r in validate.include_level(model(spark)).collect()} == {"ECLIPSE_HOST_DECK_CONTEXT_REQUIRED"}
    assert {r["code"] for r in validate.fragment_level(model(spark)).collect()} == {"CMG_DEMO_NONWELL_DATA_NOT_EXPORTED", "CMG_HOST_DATASET_CONTEXT_REQUIRED"}
    q = quantities(spark, [("wells[LONGNAME1].well_type", "well.gas_injector", None, "gas_injector", None), ("wells[LONGNAME1].controls[bhp].target", "x", 1.0, None, "bar"), ("rock.compressibility", "r", 1.0, None, "1/bar")])
    codes = {r["code"] for r in validate.validate([validate.schema_level(q, [".*"])], q, "Eclipse").collect()}
    assert codes == {"ECLIPSE_WELL_NAME_TOO_LONG", "ECLIPSE_CONTROL_UNSUPPORTED", "ECLIPSE_PARTIAL_ROCK_NOT_EXPORTED", "ECLIPSE_HOST_DECK_CONTEXT_REQUIRED"}
    stopped = validate.validate([validate.schema_level(q, ["^rock"])], q, "eclipse")
    assert {r["layer"] for r in stopped.collect()} == {"schema"}
    assert not validate.valid(stopped, q.select("case_id").distinct()).first()["valid"]
    assert validate.validate([], q, "none").first()["code"] == "EXPORT_VALIDATOR_NOT_CONFIGURED"


def test_outcomes(spark):
    ddl = f"case_id string, block_id string, seq int, draft_block_id string, concept_id string, context {contracts.CONTEXT_DDL}, selectors map<string,string>, canonical_path string, value_num double, value_str string, source_unit string, canonical_unit string, confidence double"
    pvt = lambda phase: ("pvt", phase, "property", None)
    sel = {"point_index": "0"}
    data = [
        ("b", "physical.viscosity", pvt("oil"), sel, 1.0, "cP", "cP", "MAPPED", None), ("x", "physical.viscosity", pvt("oil"), sel, 1.0, "cP", "cP", "ERROR", "SOURCE_BLOCK_MISMATCH"),
        ("b", "physical.viscosity", None, sel, 1.0, "cP", "cP", "ERROR", "SEMANTIC_CONTEXT_INVALID"), ("b", "physical.density", ("fluid_properties", "oil", "property", None), {}, 1.0, "kg/m3", "kg/m3", "ERROR", "CONCEPT_OUTSIDE_CANDIDATES"),
        ("b", "physical.viscosity", pvt("water"), sel, 1.0, "cP", "cP", "ERROR", "CONTEXT_OUTSIDE_CANDIDATES"), ("b", "physical.viscosity", pvt("gas"), sel, 1.0, "cP", "cP", "AMBIGUOUS", None),
        ("b", "physical.viscosity", pvt("oil"), {}, 1.0, "cP", "cP", "ERROR", "CANONICAL_PATH_OUTSIDE_CONTRACT"), ("b", "physical.viscosity", pvt("oil"), sel, 1.0, "cP", "bar", "ERROR", "CANONICAL_UNIT_OUTSIDE_CONTRACT"),
        ("b", "physical.viscosity", pvt("oil"), sel, float("inf"), "cP", "cP", "ERROR", "VALUE_OUTSIDE_CONTRACT"), ("b", "physical.viscosity", pvt("oil"), sel, 1.0, None, "cP", "ERROR", "SOURCE_UNIT_REQUIRED"),
    ]
    df = spark.createDataFrame([("c", "b", n, b, i, x, s, None, v, None, u, cu, 0.9) for n, (b, i, x, s, v, u, cu, _, _) in enumerate(data)], ddl)
    candidates = spark.createDataFrame([("c", "b", "physical.viscosity", pvt("oil"), True), ("c", "b", "physical.viscosity", pvt("gas"), False)], f"case_id string, block_id string, concept_id string, context {contracts.CONTEXT_DDL}, supported boolean")
    concepts = spark.createDataFrame([("physical.viscosity", "cP", "float"), ("physical.density", "kg/m3", "float")], "concept_id string, canonical_unit string, value_type string")
    got = outcomes.materialise(df, candidates, concepts).orderBy("seq").collect()
    assert [(r["status"], r["code"]) for r in got] == [d[-2:] for d in data] and got[5]["confidence"] == 0.79


def test_block_issues(spark):
    paths = ["wells[A].controls[bhp].target", "wells[A].controls[liquid_rate].constraints[minimum_bhp].value", "fluids.oil.pvt.points[0].viscosity", "wells[B].id", "wells[B].id"]
    df = spark.createDataFrame([("c", "b", "MAPPED", p) for p in paths], "case_id string, block_id string, status string, path string")
    assert {r["code"] for r in outcomes.block_issues(df).collect()} == {"DUPLICATE_CANONICAL_PATH", "REQUIRED_STRUCTURAL_MAPPING_MISSING", "CONSTRAINT_CONTROL_TARGET_MISMATCH", "PVT_POINT_PRESSURE_MISSING"}
    more = df.union(spark.createDataFrame([("c", "b", "UNMAPPED", None)], df.schema))
    assert "PVT_POINT_PRESSURE_MISSING" not in {r["code"] for r in outcomes.block_issues(more).collect()}


def test_buildable_adds_parents(spark):
    c = spark.createDataFrame([("c", "b", "physical.viscosity", ("pvt", "oil", "property", None), 0.9, 2, True), ("c", "b", "no.contract", None, 1.0, 1, True)], f"case_id string, block_id string, concept_id string, context {contracts.CONTEXT_DDL}, score double, rank int, supported boolean")
    got = outcomes.buildable(c, 5).collect()
    assert {(r["concept_id"], r["supported"]) for r in got} == {("physical.viscosity", True), ("fluid.pvt", True)}


def test_applies_and_identity(spark):
    o = spark.createDataFrame([("c", "b", "MAPPED", "wells[A].well_type", "well.water_injector"), ("c", "b", "MAPPED", "wells[A].controls[liquid_rate].target", "lrat"), ("c", "b", "MAPPED", "wells[A].controls[bhp].target", "bhp")], "case_id string, block_id string, status string, path string, concept_id string")
    up = graph.closure(spark.createDataFrame([("well.water_injector", "well"), ("well.producer", "well")], "child string, parent string"))
    targets = spark.createDataFrame([("lrat", "well.producer"), ("bhp", "well")], "src string, dst string")
    assert [r["path"] for r in outcomes.applies(o, up, targets).collect()] == ["wells[A].controls[liquid_rate].target"]
    s = spark.createDataFrame([("c", "b 1", "S-1"), ("c", "b 1", "S-1"), ("c", "b2", "x"), ("c", "b2", "y"), ("c", "b3", "bad id")], "case_id string, block_id string, sample string")
    assert rows(outcomes.table_identity(s)) == [("c", "b 1", "S-1", "S-1", None), ("c", "b2", None, "b2", "x,y"), ("c", "b3", "bad id", "b3", None)]


def test_consumed_metadata(spark):
    u = spark.createDataFrame([("c", "b", 1, "unit"), ("c", "b", 2, "Fluid"), ("c", "b", 3, "mystery")], "case_id string, block_id string, seq int, source_field string")
    m = spark.createDataFrame([("c", "b", "W", "well.control.liquid_rate", 5.0, "m3/d", 0.9), ("c", "b", "W", "well.water_injector", None, None, 0.7)], "case_id string, block_id string, well_id string, concept_id string, value_num double, source_unit string, confidence double")
    r = spark.createDataFrame([("c", "b", {"wellid": "W", "unit": "m3/d", "fluid": "water", "target": "5"})], "case_id string, block_id string, fields map<string,string>")
    assert [x["seq"] for x in outcomes.consumed(u, m, r).collect()] == [1]


def test_closure_ends_in_cycles(spark):
    up = graph.closure(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "child string, parent string"))
    assert {(r[0], r[1]) for r in up.filter("node = 'd'").collect()} == {("d", x) for x in "dabc"}


def test_closure_of_deep_trees(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(120)], "child int, parent int")
    assert [tuple(r) for r in graph.closure(edges).filter("node = 0").orderBy("depth").collect()] == [(0, i, i) for i in range(121)]
    assert graph.closure(edges, most_depth=120).count() == 121 * 122 // 2
    with pytest.raises(Exception, match="RECURSION_LEVEL_LIMIT_EXCEEDED"):
        graph.closure(edges, most_depth=119).count()


def test_json_repair():
    assert chunk.repair_json('{"a": 1}') == ('{"a": 1}', "none")
    assert chunk.repair_json('```json\n{"a": 1}\n```')[1] == "code_fence"
    assert chunk.repair_json('{"a": [1, 2,], "b": ",}",}') == ('{"a": [1, 2], "b": ",}"}', "trailing_comma")
    assert chunk.repair_json('so {"a": 1} ok')[1] == "single_value" and chunk.repair_json('so {"a": 1,} ok')[1] == "single_value_trailing_comma"
    assert chunk.repair_json('{"a": 1} {"b": 2}') == (None, "AMBIGUOUS_JSON") and chunk.repair_json("none") == (None, "INVALID_JSON") == chunk.repair_json(None)


def test_html_grid():
    columns, body, merged = chunk.html_grid("<table><tr><th rowspan='2'>a</th><th colspan=2>b</th></tr><tr><td>c</td><td>d<br>e</td></tr><tr><td>x</td></tr></table>")
    assert (columns, body, merged) == (["a", "b", ""], [["", "c", "d e"], ["x", "", ""]], [(0, 0, 2, 1), (0, 1, 1, 2)])
    assert chunk.html_grid("<table><tr><td>1</td><td>2</td></tr></table>")[:2] == (["column_1", "column_2"], [["1", "2"]])


def test_splitters():
    text = "One two three. Four five six! Seven.\n\n" + "word " * 50
    parts = chunk.split_text(text, 10)
    assert all(chunk.tokens(p) <= 10 for p in parts) and "".join("".join(parts).split()) == "".join(text.split())
    assert chunk.hard_split("abcd" * 10, 3)[0] == "abcd" * 3
    assert chunk.split_table(["a"], [["1"], ["2"], ["3"]], 40) and pytest.raises(ValueError, chunk.split_table, ["a" * 400], [], 5)


def test_greedy_groups_as_loop(spark):
    sizes = [3, 4, 5, 9, 1, 1, 10, 2]
    want, g, used = [], 0, 0
    for s in sizes:
        if used and used + s > 10:
            g, used = g + 1, 0
        used += s
        want.append(g)
    assert spark.createDataFrame([(sizes,)], "s array<int>").select(chunk.greedy_groups(F.col("s"), 10)).first()[0] == want


def test_null_safe_and_tolerant(spark):
    a = spark.createDataFrame([("x", None), (None, "y"), ("x", "y")], "p string, q string")
    assert rows(joins.null_safe(a, a.filter("q IS NULL OR p IS NULL"), ["p", "q"])) == [("x", "y")]
    df = spark.createDataFrame([(1.0, 1.0 + 1e-10, True), (1.0, 1.001, False), (0.0, 1e-13, True)], "a double, b double, w boolean")
    assert all(r[0] == r[1] for r in df.select(joins.tolerant(F.col("a"), F.col("b")), "w").collect())


def test_time_steps(spark):
    df = spark.createDataFrame([(365.0, 91.25), (10.0, 3.0), (1.0, 5.0)], "d double, i double")
    assert [r[0] for r in df.select(render.time_steps(F.col("d"), F.col("i"))).collect()] == [[91.25] * 4, [3.0, 3.0, 3.0, 1.0], [1.0]]


VOCABULARY = {
    "main.yaml": "ontology: {version: 0.1.0, convention_file: conv.yaml, concept_files: [c.yaml], scope_file: s.yaml}",
    "conv.yaml": "convention: {version: 0.1.0, concept_id_pattern: '^[a-z.]+$', root_concepts: [top], value_types: [object, float], constraint_keys: [minimum, maximum, minimum_points], dimensions: {pressure: {canonical_units: [bar]}}, source_specific_tokens: [acme], suspicious_alias_patterns: [{pattern: '^bar$', description: unit}], relationships: {forth: {source_value_types: [float], target_value_types: [float], allow_multiple: false, inverse: back}, back: {source_value_types: [float], target_value_types: [float], inverse: forth}}}",
    "c.yaml": "concepts: [{concept_id: top, name: Top, description: x, value_type: object}, {concept_id: top.a, name: A, parent: top, description: acme thing, value_type: float, dimension: pressure, canonical_unit: psi, aliases: [bar, Same], constraints: {minimum: 5, maximum: 1, odd: 1}, relationships: {forth: [top.b]}}, {concept_id: top.b, name: B, parent: nowhere, description: x, value_type: blob, aliases: [same], status: old, replaced_by: top.b}]",
    "s.yaml": "scopes: [{scope_id: s, phases: [oil], aliases: [sss], bindings: [{concept_id: top.a, context: {scope: s, phase: oil}}]}]",
}


def written(tmp_path, change=()):
    for name, text in (VOCABULARY | dict(change)).items():
        (tmp_path / name).write_text(text)
    return tmp_path


def test_vocabulary(spark, tmp_path):
    v = vocabulary.load(written(tmp_path))
    frames = v.frames(spark)
    assert frames["concepts"].count() == 3 and rows(frames["bindings"]) == [("top.a", "s", "oil", None, None)]
    codes = {(r["concept_id"], r["code"]) for r in validate.vocabulary_issues(frames, v.convention).collect()}
    assert codes == {("top.a", c) for c in ("SOURCE_SPECIFIC_DESCRIPTION", "INCOMPATIBLE_CANONICAL_UNIT", "ALIAS_LOOKS_LIKE_VALUE", "INVALID_CONSTRAINT_RANGE", "UNKNOWN_CONSTRAINT", "CROSS_CONCEPT_ALIAS_COLLISION", "INVALID_RELATIONSHIP_TARGET_TYPE", "INVERSE_RELATIONSHIP_MISSING")} | {("top.b", c) for c in ("UNKNOWN_PARENT", "CONCEPT_HIERARCHY_MISMATCH", "UNKNOWN_VALUE_TYPE", "UNKNOWN_LIFECYCLE_STATUS", "SELF_REPLACEMENT")}


@pytest.mark.parametrize(("name", "text"), [("main.yaml", "ontology: {version: 1, convention_file: ../x.yaml, concept_files: [], scope_file: s.yaml}"), ("s.yaml", "scopes: [{scope_id: s, phases: [], bindings: [{concept_id: zzz, context: {scope: s}}]}]"), ("s.yaml", "scopes: [{scope_id: s, bindings: [{concept_id: top.a, context: {scope: other}}]}]"), ("c.yaml", "concepts: [{name: x}]"), ("c.yaml", "[")])
def test_bad_vocabularies(tmp_path, name, text):
    with pytest.raises(vocabulary.VocabularyError):
        vocabulary.load(written(tmp_path, {name: text}))


def test_cycle(spark):
    c = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a")], "concept_id string, parent string")
    assert [r[0] for r in validate.cyclic(c).collect()] == ["a"]


def test_metadata_runs(spark):
    kinds = ["metadata", "block", "metadata", "reset", "block", "metadata", "metadata", "block"]
    df = spark.createDataFrame([("d", n, k) for n, k in enumerate(kinds)], "d string, n int, kind string")
    got = df.withColumn("run", joins.block_of_metadata("d", ["n"], F.col("kind"))).groupBy("run").agg(F.max(F.when(F.col("kind") == "block", F.col("n"))).alias("b"), F.count_if(F.col("kind") == "metadata").alias("m")).filter("b IS NOT NULL")
    assert sorted((r["b"], r["m"]) for r in got.collect()) == [(1, 1), (4, 0), (7, 2)]


def test_issue_order_is_total(spark):
    data = [("c", "export", "warning", "B", "p"), ("c", "schema", "warning", "A", "p"), ("c", "export", "error", "Z", "p")]
    df = spark.createDataFrame(data, "case_id string, layer string, severity string, code string, path string")
    assert [r["code"] for r in checks.ordered_issues(df.repartition(3)).orderBy("ordinal").collect()] == ["Z", "A", "B"]
