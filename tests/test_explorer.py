"""Read-back INCLUDE texts, exploration, review lists and outcomes of calls on small fixtures."""

from lithoflow.operators import deck, graph, render, retrieve
from lithoflow.sources import sinks
from pyspark.sql import functions as F


def texts(spark, **by_case):
    return spark.createDataFrame(list(by_case.items()), "case_id string, text string")


def parsed(spark, text):
    rows = deck.parse_include(texts(spark, c=text)).orderBy("section", "keyword", "row", "col").collect()
    return [(r["keyword"], r["row"], r["col"], r["field"], r["value"]) for r in rows]


def test_include_is_read(spark):
    got = parsed(spark, "-- ROCK\r\nrock\n  200 4.5E-5 9 /\r\n\nPVTW\n 1 2* 3 4 5 /\n 6 / \n/\nWCONINJE\n'A B' WATER OPEN RATE 10 1* 300 /\n/\n")
    # a quoted name with a blank is two items of this grammar, as the engine writes no such name
    assert got[:2] == [("PVTW", 0, 0, None, "1"), ("PVTW", 0, 1, None, None)]
    assert ("ROCK", 0, 0, None, "200") in got and ("ROCK", 0, 1, None, "4.5E-5") in got and not [g for g in got if g[0] == "ROCK" and g[2] > 1]
    assert ("PVTW", 1, 0, None, "6") in got and not [g for g in got if g[0] == "PVTW" and g[2] > 4]
    assert [g[3] for g in got if g[0] == "WCONINJE"] == ["well", "phase", "status", "control_mode", "rate", "bhp"]


def test_texts_without_keywords_have_no_rows(spark):
    assert deck.parse_include(texts(spark, a=None, b="", c="-- ROCK\n1 2 /\n")).count() == 0
    assert deck.parse_include(texts(spark, a="ROCK\n1 /\n").limit(0)).count() == 0


def test_written_texts_are_read_back(spark):
    rows = [("c", 0, "PROPS", "ROCK", 0, "200 4.5E-05"), ("c", 1, "PROPS", "PVDO", 0, "100 1.2 0.8"), ("c", 1, "PROPS", "PVDO", 1, "200 1.1 0.9"), ("c", 2, "SCHEDULE", "TSTEP", 0, "30 2")]
    records = spark.createDataFrame(rows, "case_id string, block_no int, section string, keyword string, record_no int, line string")
    got = deck.parse_include(render.render_include(records, "X"))
    assert {(r["keyword"], r["row"], r["col"]): r["number"] for r in got.collect()} == {
        ("ROCK", 0, 0): 200.0, ("ROCK", 0, 1): 4.5e-5, ("TSTEP", 0, 0): 30.0, ("TSTEP", 0, 1): 2.0,
        **{("PVDO", i, j): v for i, row in enumerate([[100.0, 1.2, 0.8], [200.0, 1.1, 0.9]]) for j, v in enumerate(row)},
    }


def test_formats_compare_equal(spark):
    a = texts(spark, c="ROCK\n 200 4.5E-5 /\nTSTEP\n 2*30 /\n", d="ROCK\n 1 2 /\n")
    b = texts(spark, c="TSTEP\n 30.0 3E1 /\nROCK\n 200.00000000001 0.000045 /\n", d="ROCK\n 1 2.1 /\n")
    got = deck.compare_includes(deck.parse_include(a), deck.parse_include(b)).collect()
    assert [tuple(r) for r in got] == [("d", "$.ROCK[1]", "2", "2.1")]


def test_exploration(spark):
    edges = spark.createDataFrame([("a", "is", "b", None), ("b", "is", "c", None), ("a", "has", "b", "s"), ("b", "is", "a", "t")], "src string, relation string, dst string, scope string")
    assert {r["node"] for r in graph.neighbourhood(edges, "b").collect()} == {"a", "b", "c"}
    assert {r["node"] for r in graph.neighbourhood(edges, "z").collect()} == {"z"}
    seen = graph.visible_edges(edges, graph.neighbourhood(edges, "a"), ["is"], "s").collect()
    assert [(r["src"], r["dst"]) for r in seen] == [("a", "b")]
    concepts = spark.createDataFrame([(i, None if i == 3 else f"Name {i}") for i in range(12)], "i int, label string")
    assert [r["i"] for r in graph.search(concepts, " NAME ", ["label"], "i").collect()] == [0, 1, 2, 4, 5, 6, 7, 8]
    assert graph.search(concepts, " ", ["label"], "i").count() == 0


def test_review_and_outcomes(spark):
    flags = spark.createDataFrame([(["ocr_low_text_confidence"],), (["BELOW_CONFIDENCE"],), ([None],), ([],), (None,)], "f array<string>")
    assert [r[0] for r in flags.select(retrieve.low_confidence_flag(F.col("f"))).collect()] == [True, False, False, False, False]
    rows = spark.createDataFrame([(1, "MAPPED", 0.79), (2, "MAPPED", 0.8), (3, "MAPPED", 0.95), (4, None, 0.99), (5, "MAPPED", None)], "i int, status string, confidence double")
    assert {(r["i"], r["list"]) for r in retrieve.review_list(rows).collect()} == {(1, "low_confidence"), (2, "warning"), (4, "unresolved")}
    calls = spark.createDataFrame([("a", 1, "success", None), ("a", 2, "success", None), ("b", 1, "error", "E")], "block string, seq int, outcome string, error_code string")
    told = spark.createDataFrame([("a", "contract_invalid", "X"), ("z", "contract_invalid", "Y")], "block string, outcome string, error_code string")
    got = {(r["block"], r["seq"]): (r["outcome"], r["error_code"]) for r in sinks.mark_latest(calls, told, ["block"], "seq").collect()}
    assert got == {("a", 1): ("success", None), ("a", 2): ("contract_invalid", "X"), ("b", 1): ("error", "E")}
    values = spark.createDataFrame([("a", "wells[W].x", 1.0, None), ("a", "rock.compressibility", None, None), ("b", "fluids.gas.density", 1.0, None), ("c", "schedule.duration", None, "3 d")], "case_id string, path string, value double, text string")
    assert {tuple(r) for r in render.nonwell_data(values).collect()} == {("a", False), ("b", True), ("c", True)}
