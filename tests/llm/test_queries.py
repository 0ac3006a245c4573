"""Every registered corpus query on the smallest tables: DuckDB where SQL can express it, its own contract otherwise."""

import hashlib
import os
import zlib

import duckdb
import numpy as np
import pytest

from lithoflow.llm import packing
from lithoflow.llm import queries as Q

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def plain(row):
    return str([f"{x:.6g}" if isinstance(x, float) else x for x in row])


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_same_as_oracle(spark, name):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    df = Q.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({Q.oracle_sql()[name]})")
    assert [KINDS[dict(df.dtypes)[c]] for c in columns] == [str(t) for t in want.types]
    assert sorted(plain([r[c] for c in columns]) for r in df.collect()) == sorted(map(plain, want.fetchall()))


def test_media_query(spark, texts):
    got = {r["doc_id"]: r for r in Q.op2_media(spark, DATA).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        raw = t.encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_token_queries(spark, texts):
    library = packing._library(Q.vocabulary_path())
    ids = {i: library.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    for r in Q.op4_bpe(spark, DATA).collect():
        own = ids[r["doc_id"]]
        assert r["n_tokens"] == len(own) and r["ids_sha256"] == hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(own, skip_special_tokens=False).encode()).hexdigest()
    pieces, places = {}, {}
    for r in Q.op3_packing(spark, DATA).collect():
        pieces.setdefault(r["doc_id"], []).append(r)
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert r["lower_bound"] <= sum(len(x) + 1 for x in ids.values())
    for i, own in ids.items():
        own = [*own, 0]
        mine = sorted(pieces[i], key=lambda r: r["piece"])
        assert [(r["start"], r["length"]) for r in mine] == packing.cut(len(own), 2048)
        assert all(r["ids_crc32"] == zlib.crc32(np.array(own[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for r in mine)
    for p in places.values():
        p.sort()
        assert p[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(p, p[1:])) and sum(p[-1]) <= 2048
    assert len(places) <= mine[0]["lower_bound"] + 1


def test_model_queries(spark, texts):
    quality = Q.op7_quality(spark, DATA).collect()
    assert sorted(r["doc_id"] for r in quality) == sorted(texts) and all(0 <= r["tail_probability"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in quality)
    same = {}
    for r in quality:  # equal texts, equal scores
        assert same.setdefault(texts[r["doc_id"]], r["score"]) == r["score"]
    found = Q.op9_language(spark, DATA).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(texts) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)


def test_nearest_query(spark):
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()}
    got = {}
    for r in Q.op6_nearest(spark, DATA).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert got.keys() == {i for i in rows if i % 20 == 0}
    hits = []
    for q, found in got.items():
        found.sort()
        assert [n for n, _, _ in found] == list(range(1, len(found) + 1)) and all(abs(s - (rows[q] * rows[j]).sum()) < 1e-12 for _, j, s in found)
        best = sorted((-(rows[q] * v).sum(), j) for j, v in rows.items() if j != q)[:20]
        hits.append(len({j for _, j in best} & {j for _, j, _ in found}) / len(best))
    assert np.mean(hits) >= 0.9
