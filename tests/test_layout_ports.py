"""Layout joins, ports, sinks and streams on small rows of our own."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lithoflow.operators import layout as L
from lithoflow.operators import ports as P
from lithoflow.sources import sinks
from lithoflow.streaming import jobs

BOX = "x0 double, top double, x1 double, bottom double"


def lines(spark, rows):
    return spark.createDataFrame([("c", 1, i, *map(float, b), t, lab) for i, b, t, lab in rows], f"case_id string, page int, line_id int, {BOX}, text string, label string")


def test_excluded_lines(spark):
    df = lines(spark, [(1, (0, 0, 10, 10), "a", None), (2, (0, 20, 10, 30), "b", None), (3, (0, 14, 10, 24), "c", None)])
    boxes = spark.createDataFrame([("c", 1, 0.0, 0.0, 20.0, 18.9)], f"case_id string, page int, {BOX}")
    assert sorted(r["line_id"] for r in L.excluded_lines(df, boxes).collect()) == [2, 3]


def test_captions_are_owned_once(spark):
    df = lines(spark, [(1, (0, 0, 50, 8), "About it", None), (2, (0, 10, 50, 18), "Table 1 rates", None), (3, (100, 60, 150, 68), "plain", None)])
    tables = spark.createDataFrame([("c", 1, "t1", 0.0, 20.0, 60.0, 40.0), ("c", 1, "t2", 0.0, 21.0, 55.0, 40.0), ("c", 1, "t3", 100.0, 70.0, 150.0, 90.0)], f"case_id string, page int, table_id string, {BOX}")
    assert sorted((r["table_id"], r["line_id"]) for r in L.captions(tables, df).collect()) == [("t1", 1), ("t1", 2)]


def test_reading_order(spark):
    rows = [("c", 1, 1, 0.0, 50.0, 40.0, 60.0), ("c", 1, 2, 0.0, 10.0, 40.0, 20.0), ("c", 2, 1, 60.0, 10.0, 90.0, 20.0), ("c", 2, 2, 0.0, 12.0, 40.0, 22.0)]
    df = spark.createDataFrame(rows, f"case_id string, page int, seq int, {BOX}")
    assert [(r["page"], r["seq"]) for r in L.reading_order(df).orderBy("page", "reading_order").collect()] == [(1, 2), (1, 1), (2, 1), (2, 2)]


def test_sections_offsets_chunks(spark):
    df = lines(spark, [(1, (0, 0, 9, 9), "Head:", None), (2, (0, 10, 30, 19), "body", None), (3, (0, 20, 9, 29), "T", "title"), (4, (0, 30, 9, 39), "x", None)]).withColumn("reading_order", F.col("line_id"))
    got = L.offsets(L.sections(df)).orderBy("line_id").collect()
    assert [r["section_title"] for r in got] == ["Head", "Head", "T", "T"] and [(r["start"], r["end"]) for r in got] == [(0, 5), (7, 11), (13, 14), (16, 17)]
    chunks = spark.createDataFrame([("c", 0, 0, 9), ("c", 1, 9, 17)], "case_id string, chunk_no int, start long, end long")
    box = {r["chunk_no"]: (r["x1"], r["bottom"], r["start"], r["end"]) for r in L.chunk_regions(chunks, L.offsets(df)).collect()}
    assert box == {0: (30.0, 19.0, 0, 9), 1: (30.0, 39.0, 9, 17)}


def test_tables_pages_regions(spark):
    t = spark.createDataFrame([(1, [["a", "b"], ["", None], ["1", "2"]]), (2, [["h"]]), (3, [[None]])], "id int, cells array<array<string>>")
    assert [(r["id"], r["columns"], r["rows"]) for r in L.table_blocks(t).collect()] == [(1, ["a", "b"], [["1", "2"]])]
    pages = spark.createDataFrame([("n", 5, 0, False), ("o", 0, 1, False), ("m", 5, 0, False), ("m", 0, 2, False), ("r", 5, 0, True)], "case_id string, n_text int, n_images int, restricted boolean")
    assert {r["case_id"]: (r["mode"], r["code"]) for r in L.page_modes(pages).collect()} == {"n": ("native", None), "o": ("ocr", None), "m": ("mixed", "PDF_MIXED_CAPABILITY"), "r": ("ocr", None)}
    regions = spark.createDataFrame([("c", 1, "a", "text", 0.0, 0.0, 10.0, 10.0), ("c", 1, "b", "table", 20.0, 0.0, 30.0, 10.0), ("c", 1, "f", "footer", 0.0, 90.0, 10.0, 99.0)], f"case_id string, page int, region_id string, label string, {BOX}")
    words = spark.createDataFrame([("c", 1, 0.0, 0.0, 4.0, 4.0, 0.5), ("c", 1, 6.0, 0.0, 14.0, 4.0, 0.7)], f"case_id string, page int, {BOX}, score double")
    got = L.ocr_regions(regions, words)
    assert {r["region_id"]: (r["kind"], r["confidence"], r["flags"]) for r in got.collect()} == {"a": ("text", pytest.approx(0.6), ["OCR_LOW_CONFIDENCE"]), "b": ("table", None, ["OCR_CONFIDENCE_MISSING"])}
    decisions = spark.createDataFrame([("c", "a", "exclude"), ("c", "z", "accept")], "case_id string, region_id string, action string")
    assert {(r["region_id"], r["code"]) for r in L.review_issues(got, decisions).collect()} == {("b", "OCR_REVIEW_REQUIRED"), ("z", "OCR_REVIEW_UNKNOWN_ISSUE")}
    assert [r["region_id"] for r in L.reviewed(got, decisions).collect()] == ["b"]


def test_provider_retries():
    slept = []
    provider = P.FixtureProvider({"x": [P.ProviderError(503, "busy"), '{"a": 1,}'], "y": [P.ProviderError(400, "bad")]})
    assert P.call(provider, "x", sleep=slept.append) == ('{"a": 1}', "trailing_comma", 2) and slept == [0.25]
    assert P.call(provider, "y", sleep=slept.append) == (None, "PROVIDER_400", 1)
    down = P.FixtureProvider({"x": P.ProviderError(None, "gone")})
    assert P.call(down, "x", sleep=slept.append) == (None, "PROVIDER_TRANSPORT", 3) and slept == [0.25, 0.25, 0.5]


def test_drafts_and_registry(spark):
    prompts = spark.createDataFrame([("c", "b", "ask x"), ("c", "d", "ask z")], "case_id string, block_id string, prompt string")
    got = {r["block_id"]: (r["response"], r["outcome"]) for r in P.drafts_of(prompts, lambda: P.FixtureProvider({"x": '{"m": []}'})).collect()}
    assert got == {"b": ('{"m": []}', "none"), "d": (None, "PROVIDER_404")}
    r = P.Registry()
    r.register("Ocr", dict)
    assert r.get("OCR") is r.get("ocr")
    with pytest.raises(ValueError):
        r.register("oCr", dict)


def test_sinks(spark, tmp_path):
    calls = spark.createDataFrame([("c", "success", None, 5, 7, 0.5), ("c", "error", "k", None, None, 0.25)], "case_id string, outcome string, retry_of string, input_tokens int, output_tokens int, seconds double")
    sinks.append_traces(calls, str(tmp_path / "t"))
    sinks.append_traces(calls, str(tmp_path / "t"))
    got = sinks.trace_summary(spark.read.parquet(str(tmp_path / "t"))).first()
    assert (got["n_calls"], got["n_success"], got["n_retries"], got["input_tokens"], got["seconds"]) == (4, 2, 2, 10, 1.5)
    assert sinks.schema_json(calls.schema).endswith("}\n")


def test_stream_of_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("one\n\ntwo")
    (folder / "b.csv").write_text("h\n1,2\n")
    for _ in range(2):  # a second run takes nothing again
        jobs.start_ingest(jobs.arriving_sources(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["source_id"], r["text"], r["code"]) for r in got.collect()) == [("a.txt", "one", None), ("a.txt", "two", None), ("b.csv", None, "INCONSISTENT_TABLE_WIDTH")]


def test_window_of_calls(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    calls = spark.createDataFrame([("b", at, "success"), ("b", at + dt.timedelta(minutes=3), "error"), ("b", at + dt.timedelta(minutes=15), "error")], "block_id string, at timestamp, outcome string")
    calls.write.parquet(str(tmp_path / "calls"))
    stream = spark.readStream.schema(calls.schema).parquet(str(tmp_path / "calls"))
    q = jobs.attempts_per_window(stream).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r["n_calls"], r["n_failed"]) for r in spark.table("windows").collect()) == [(1, 1), (2, 1)]
