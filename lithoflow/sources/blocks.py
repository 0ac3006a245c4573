"""Sources as one block table.

raw_blocks: source_id, source_type, file_name, block_seq, block_id, block_type, text, columns, rows, key, value,
source_location. Bad sources give rows of ``issues`` (source_id, code, message) and never fail the job. One source is read by
one task; files are bounded by ``MOST_BYTES``.
"""

from __future__ import annotations

import csv
import io
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MOST_BYTES = 16 << 20
TYPES = {".txt": "text", ".dat": "text", ".json": "json", ".csv": "csv", ".xlsx": "xlsx", ".pdf": "pdf"}
BLOCK = (
    "source_id string, source_type string, file_name string, block_seq int, block_id string, block_type string, text string, "
    "columns array<string>, rows array<array<string>>, key string, value string, source_location string, code string, message string"
)


class SourceError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def text_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", separator: Column | None = None) -> DataFrame:
    """S07 as gaps and islands: runs of lines between separators (blank lines unless ``separator``, on column line, says otherwise).

    (id, block_no, start_line, end_line, text), lines from 1.
    """
    blank = (F.length(F.trim(F.col("line"))) == 0) if separator is None else separator
    lines = docs.select(F.col(id_col), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("i", "line")).withColumn("blank", blank.cast("int"))
    order = Window.partitionBy(id_col).orderBy("i")
    islands = lines.withColumn("island", F.sum("blank").over(order)).filter("blank = 0")
    runs = islands.groupBy(id_col, "island").agg(F.min("i").alias("lo"), F.max("i").alias("hi"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n").alias("text"))
    number = F.row_number().over(Window.partitionBy(id_col).orderBy("island"))
    return runs.select(id_col, number.alias("block_no"), (F.col("lo") + 1).alias("start_line"), (F.col("hi") + 1).alias("end_line"), "text")


def block_id(n: Column) -> Column:
    """W03."""
    return F.format_string("block_%04d", n)


def _text_blocks(raw: str) -> list[dict]:
    out, held = [], []
    for n, line in enumerate([*raw.splitlines(), ""], 1):
        if line.strip():
            held.append((n, line))
        elif held:
            a, b = held[0][0], held[-1][0]
            out.append({"block_type": "text", "text": "\n".join(x for _, x in held), "source_location": f"line {a}" if a == b else f"lines {a}-{b}"})
            held = []
    return out


def _csv_blocks(raw: str) -> list[dict]:
    try:
        records = [r for r in csv.reader(io.StringIO(raw, newline=""), strict=True)]
    except csv.Error as e:
        raise SourceError("MALFORMED_CSV", str(e)) from e
    if not records:
        return []
    bad = [n for n, r in enumerate(records[1:], 2) if len(r) != len(records[0])]
    if bad:
        raise SourceError("INCONSISTENT_TABLE_WIDTH", "records " + ", ".join(map(str, bad)))
    if len(records) == 1:
        return []
    return [{"block_type": "table", "columns": records[0], "rows": records[1:], "source_location": f"rows 1-{len(records) - 1}"}]


def json_key(key: str) -> str:
    """S06."""
    return f".{key}" if key.isidentifier() else f"[{json.dumps(key, ensure_ascii=False)}]"


def is_table(items: list) -> bool:
    """All objects, all with the keys of the first."""
    return bool(items) and all(isinstance(x, dict) and x.keys() == items[0].keys() for x in items) and bool(items[0])


def _cell(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _json_blocks(raw: str) -> list[dict]:
    """Objects of scalars and arrays of like objects are tables, other scalars key and value."""
    try:
        root = json.loads(raw)
    except ValueError as e:
        raise SourceError("MALFORMED_JSON", str(e)) from e
    out: list[dict] = []
    scalar = lambda v: not isinstance(v, (dict, list))

    def pair(name, value, at):
        out.append({"block_type": "key_value", "key": name, "value": _cell(value), "source_location": at})

    def table(rows, at):
        columns = [*rows[0]]
        out.append({"block_type": "table", "columns": columns, "rows": [[_cell(r[c]) for c in columns] for r in rows], "source_location": at})

    def visit(value, at, name):
        if isinstance(value, dict):
            if not value:
                pair(name, value, at)
            elif all(map(scalar, value.values())):
                table([value], at)
            else:
                for k, v in value.items():
                    visit(v, at + json_key(k), k)
        elif isinstance(value, list):
            if is_table(value):
                table(value, at)
            elif all(map(scalar, value)):
                pair(name, value, at)
            else:
                for i, v in enumerate(value):
                    visit(v, f"{at}[{i}]", f"{name}[{i}]")
        elif at == "$" and isinstance(value, str):
            out.append({"block_type": "text", "text": value, "source_location": at})
        else:
            pair(name, value, at)

    visit(root, "$", "$")
    return out


PARSERS = {"text": _text_blocks, "csv": _csv_blocks, "json": _json_blocks}


def parse_source(source_id: str, file_name: str, content: bytes | None, parsers=PARSERS) -> list[dict]:
    """The rows of one source: its blocks, or one row with an issue code."""
    suffix = (re.search(r"\.[^.]+$", file_name or "") or [""])[0].lower()
    kind = TYPES.get(suffix)
    base = {"source_id": source_id, "source_type": kind, "file_name": file_name}
    try:
        if not (source_id or "").strip():
            raise SourceError("INVALID_SOURCE_ID", "a source needs an id")
        if content is None:
            raise SourceError("SOURCE_NOT_FOUND", file_name)
        if kind is None:
            raise SourceError("UNSUPPORTED_SOURCE_TYPE", suffix)
        if len(content) > MOST_BYTES:
            raise SourceError("SOURCE_TOO_LARGE", str(len(content)))
        if kind not in parsers:
            raise SourceError("UNSUPPORTED_SOURCE_TYPE", f"no port for {suffix}")
        try:
            raw = content if kind in ("xlsx", "pdf") else content.decode("utf-8-sig")
        except UnicodeDecodeError as e:
            raise SourceError("SOURCE_DECODE_ERROR", str(e)) from e
        found = parsers[kind](raw)
    except SourceError as e:
        return [base | {"code": e.code, "message": str(e)}]
    return [base | {"block_seq": n, "block_id": f"block_{n:04d}"} | b for n, b in enumerate(found, 1)]


def blocks_of(sources: DataFrame, parsers=PARSERS) -> DataFrame:
    """Blocks and issues of (source_id, file_name, content): issue rows have a code, blocks none."""
    names = [x.split(" ")[0] for x in re.split(r", (?=\w+ )", BLOCK)]

    def run(frames):
        for f in frames:
            rows = [r for s, n, c in zip(f["source_id"], f["file_name"], f["content"], strict=True) for r in parse_source(s, n, None if c is None else bytes(c), parsers)]
            yield pd.DataFrame(rows, columns=names).astype(object).where(lambda x: x.notna(), None).assign(block_seq=lambda x: pd.array([None if v is None else int(v) for v in x["block_seq"]], dtype="Int32"))

    return sources.select("source_id", "file_name", "content").mapInPandas(run, BLOCK)


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """Files as (source_id, file_name, content); the id is the file's name."""
    name = F.regexp_extract(F.col("path"), r"[^/]+$", 0)
    return spark.read.format("binaryFile").load(path).select(name.alias("source_id"), name.alias("file_name"), "content")


def inline_sources(requests: DataFrame) -> DataFrame:
    """(source_id, file_name, text, base64) to sources; refused ones get null content and a code."""
    strict = F.try_to_binary("base64", F.lit("base64"))
    code = (
        F.when(F.col("file_name").rlike(r"[/\\]") | F.col("file_name").isin("", ".", ".."), "INVALID_FILE_NAME")
        .when(F.col("text").isNull() & (F.col("base64").isNull() | strict.isNull()), "INVALID_BASE64_SOURCE")
        .when(F.length(F.coalesce(F.col("text").cast("binary"), strict)) > MOST_BYTES, "SOURCE_TOO_LARGE")
    )
    content = F.when(code.isNull(), F.coalesce(F.col("text").cast("binary"), strict))
    return requests.select("source_id", F.coalesce("file_name", F.lit("source.txt")).alias("file_name"), content.alias("content"), code.alias("code"))


def duplicate_blocks(blocks: DataFrame) -> DataFrame:
    """Ids that a source has twice."""
    return blocks.filter("block_id IS NOT NULL").groupBy("source_id", "block_id").count().filter("count > 1")


def search_text(block_type: Column, text: Column, title: Column, content: Column) -> Column:
    """Title and text of text blocks, the compact JSON of others."""
    return F.when(block_type == "text", F.concat_ws("\n", title, text)).otherwise(content)
