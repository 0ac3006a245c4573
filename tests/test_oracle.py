"""Every query with an oracle agrees with DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from lithoflow.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def plain(row):
    return str([f"{x:.6g}" if isinstance(x, float) else x for x in row])


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_as_oracle(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    want = duck.sql(f"SELECT {', '.join(f'\"{c}\"' for c in columns)} FROM ({catalogue.oracle_sql()[name]})")
    assert [KINDS[dict(df.dtypes)[c]] for c in columns] == [str(t) for t in want.types]
    assert sorted(plain([r[c] for c in columns]) for r in df.collect()) == sorted(map(plain, want.fetchall()))


def test_every_query_is_lazy_or_small(spark):
    for name in ("sentence_split", "greedy_chunks", "greedy_groups", "html_grid_expand", "json_repair"):
        assert catalogue.queries()[name](spark, DATA).count() > 0


def plain_split(text, budget, level=0):
    """The splitter by its rules, counting every candidate anew."""
    import re

    from lithoflow.operators import chunk as K

    if K.tokens(text) <= budget:
        return [text] if text.strip() else []
    if level == 2:
        out = []
        while text:
            n = max(n for n in range(len(text) + 1) if K.tokens(text[:n]) <= budget)
            if n < len(text):
                blank = max(text.rfind(" ", int(n * 0.8), n), text.rfind("\n", int(n * 0.8), n))
                n = blank + 1 if blank > 0 else n
            out.append(text[:n])
            text = text[n:]
        return [x for x in out if x.strip()]
    units, glue = (re.split(r"\n+", text), "\n") if level == 0 else (K.SENTENCE.split(text), " ")
    out, held = [], ""
    for unit in (u for u in units if u and u.strip()):
        joined = held + glue + unit if held else unit
        if K.tokens(joined) <= budget:
            held = joined
        else:
            out += [held] * bool(held)
            big = K.tokens(unit) > budget
            out += plain_split(unit, budget, level + 1) if big else []
            held = "" if big else unit
    return out + [held] * bool(held)


def test_chunks_are_the_plain_ones(spark):
    import random

    from lithoflow.operators import chunk as K

    rng = random.Random(1)
    texts = ["".join(rng.choice(["word", "averylongword", "日本", "é", ".", "! ", " ", "\n", "\n\n", "x1 "]) for _ in range(rng.randint(0, 120))) for _ in range(300)]
    for budget in (1, 3, 17):
        for t in texts:
            assert K.split_text(t, budget) == plain_split(t, budget), (t, budget)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = {}
    for r in catalogue.queries()["greedy_chunks"](spark, DATA).orderBy("chunk_no").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
        assert r["n_tokens"] == K.tokens(r["text"]) <= 200
    assert all(got.get(d["doc_id"], []) == plain_split(d["text"] or "", 200) for d in docs if len(d["text"] or "") < 5000)
    assert all("".join("".join(got[d["doc_id"]]).split()) == "".join(d["text"].split()) for d in docs if (d["text"] or "").strip())


def test_sentences_are_the_plain_ones(spark):
    import re

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {}
    for r in catalogue.queries()["sentence_split"](spark, DATA).orderBy("sentence_no").collect():
        got.setdefault(r["doc_id"], []).append(r["sentence"])
    for i, t in docs.items():
        cut = re.split(r"(?<=[.!?。！？；;])[ \t\n\x0b\f\r]+|(?<=[。！？；])", t or "")
        assert got.get(i, []) == [s for s in cut if s.strip(" ")], i


def test_grid_of_spans(spark):
    """Places that a span covers stay empty, a span that is no number is one, breaks are blanks."""
    got = [(r["columns"], r["cells"]) for r in catalogue.queries()["html_grid_expand"](spark, DATA).orderBy("row_no").collect()]
    assert {c for c, _ in got} == {"Well|Rate|"} and [c for _, c in got] == ["|oil|water", "P-1|10|4", "P-2|7 8|"]
