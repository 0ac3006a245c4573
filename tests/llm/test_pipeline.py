"""The pipeline's stages against plain versions of each, on small tables of our own."""

import hashlib
import random

import corpus_pipeline as P
from lithoflow.llm import quality

from .test_llm import duplicates, lines, repeats


def tables(spark, tmp_path):
    rng = random.Random(6)
    prose = lambda rng, n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    rows = []
    for i in range(120):
        rows.append((i, "\n".join(prose(rng, rng.randint(8, 20)) for _ in range(3)) + ("\nshared line" if i % 4 == 0 else ""), "en", f"s{i % 3}", 0))
    rows += [(200 + i, rows[i][1] + " more", "en", "s", 0) for i in range(4)] + [(300, rows[7][1][:120] + prose(rng, 30), "en", "s", 0), (301, None, None, None, None), (302, "", "en", "s", 0)]
    labels = []
    for i in range(120):
        if i % 3 == 0:
            bad = i % 9 == 0
            if bad:
                rows[i] = (i, rows[i][1] + " idiot moron idiot", *rows[i][2:])
            labels.append((i, 1, int(bad)))
    d = str(tmp_path / "sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages(spark, tmp_path):
    d = tables(spark, tmp_path)
    assert [n for n, _ in P.STAGES] == ["quality", "line_dedup", "near_duplicates", "suffix_dedup", "packing"]
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = {}
    for n, (name, stage) in enumerate(P.STAGES[:-1]):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        stage(spark, docs, d).write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        assert docs.columns == P.COLUMNS
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
        rows = [*before.items()]
        if name == "line_dedup":
            want = {r[0]: r for r in lines(rows, 10)}
            assert {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in kept[name].items()} == {i: r[3] for i, r in want.items()} and sum(r[2] for r in want.values()) > 10
        if name == "near_duplicates":
            assert kept[name].keys() == {i for i, _, c in duplicates(rows, 5) if i == c}
        if name == "suffix_dedup":
            want = {r[0]: r for r in repeats(rows)}
            assert kept[name].keys() == {i for i, r in want.items() if r[2] < r[1] or not r[1]}
            assert all(len(t.encode()) == want[i][1] - want[i][2] for i, t in kept[name].items())
    assert 0 not in kept["quality"] and len(kept["quality"]) > 100
    packed = P.STAGES[-1][1](spark, docs, d)
    assert {r["doc_id"] for r in packed.collect()} == kept["suffix_dedup"].keys()
    assert sorted(map(tuple, P.run(spark, d).select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted(map(tuple, packed.select("doc_id", "piece", "length", "ids_crc32").collect()))


def test_run_leaves_no_stage_behind(spark, tmp_path):
    import glob
    import urllib.parse

    from lithoflow.llm.common import shared_dir

    folder = urllib.parse.urlparse(shared_dir(spark)).path
    before = {*glob.glob(f"{folder}/*")}
    got = P.run(spark, tables(spark, tmp_path))
    left = [f.rsplit("/", 1)[1].split("-")[0] for f in {*glob.glob(f"{folder}/*")} - before]
    assert got.count() > 100 and {*left} <= {"pieces", "packed", "repacked"}


def test_stages_of_nothing(spark, tmp_path):
    d = tables(spark, tmp_path)
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == P.COLUMNS and out.count() == 0
    assert P.STAGES[-1][1](spark, docs, d).count() == 0


def test_quality_uses_labels(spark, tmp_path):
    d = tables(spark, tmp_path)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = quality.train(docs, quality.grades(spark.read.parquet(f"{d}/labels.parquet")))
    gone = {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in quality.select_documents(docs, model).collect()}
    assert gone >= set(range(0, 120, 9))


def odd_rows(spark):
    """Null and repeated ids, null texts and columns: (id, text, lang, source, n_chars)."""
    rng = random.Random(8)
    a, b, c = (" ".join(f"v{rng.randrange(3000)}" for _ in range(40)) for _ in range(3))
    rows = [(None, a, "en", "p", 0), (None, a, None, "q", 0), (None, None, "de", None, 0), (4, b, "en", "r", 0), (4, b, "en", "r", 0), (5, c, "en", "s", 0), (5, c[:90] + " other end", "fr", "t", 0), (6, None, "en", "u", 0), (6, "", "en", "u", 0)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def plain(rows):
    return sorted(((r[0], r[1] or "", r[2], r[3], len(r[1] or "")) for r in rows), key=str)


def test_suffix_stage_keeps_null_and_repeated_ids(spark):
    rows, docs = odd_rows(spark)
    got = P.suffix_stage(spark, docs, "")
    assert got.columns == P.COLUMNS and sorted(map(tuple, got.collect()), key=str) == plain(rows)
    gone = spark.createDataFrame([(2, rows[3][1], "en", "late", 0)], docs.schema)  # a smaller document takes the text of both rows of 4
    assert sorted(map(tuple, P.suffix_stage(spark, docs.union(gone), "").collect()), key=str) == plain([r for r in rows if r[0] != 4] + [(2, rows[3][1], "en", "late", 0)])


def test_null_and_repeated_ids_reach_packing(spark):
    rows, docs = odd_rows(spark)
    packed = P.packing_stage(spark, P.suffix_stage(spark, P.near_duplicate_stage(spark, P.line_stage(spark, docs, ""), ""), ""), "")
    assert sorted((r["doc_id"] for r in packed.filter("piece = 0").collect()), key=str) == sorted((r[0] for r in rows), key=str)


def test_near_duplicate_stage_keeps_other_texts_of_an_id(spark):
    rng = random.Random(9)
    a, b = (" ".join(f"v{rng.randrange(3000)}" for _ in range(60)) for _ in range(2))
    rows = [(1, a), (5, a), (5, b), (5, b), (9, b + " end"), (12, b), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = P.near_duplicate_stage(spark, docs, "").collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted([(1, a), (5, b), (5, b), (None, a)], key=str)
