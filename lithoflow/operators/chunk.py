"""Budgeted chunking, span grids and JSON repair: folds that no window expresses.

Greedy packing is a fold with a reset: an ``aggregate`` over the array of unit sizes in the JVM, or Python over Arrow where
text has to be cut inside units. One document is one value; nothing is shuffled.
"""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens (as functions.text.token_estimate) and the ends of sentences.
TOKEN = re.compile(r"[㐀-鿿]|[^\x00-\x7f\s]|[A-Za-z0-9_]{1,4}|[^\w\s]", re.ASCII)
SENTENCE = re.compile(r"(?<=[.!?。！？；;])\s+|(?<=[。！？；])")


def greedy_groups(sizes: Column, budget: int, gap: int = 0) -> Column:
    """The group (from 0) of each unit: a group takes units while its sizes, and gap between them, fit the budget."""
    zero = F.struct(F.lit(0).alias("g"), F.lit(0).alias("used"), F.array().cast("array<int>").alias("out"))

    def step(a, size):
        fits = (a["used"] == 0) | (a["used"] + gap + size <= budget)
        g = F.when(fits, a["g"]).otherwise(a["g"] + 1)
        used = F.when(fits & (a["used"] > 0), a["used"] + gap + size).otherwise(size)
        return F.struct(g.alias("g"), used.cast("int").alias("used"), F.concat(a["out"], F.array(g)).alias("out"))

    return F.aggregate(sizes, zero, step, lambda a: a["out"])


def tokens(text: str) -> int:
    return len(TOKEN.findall(text))


def hard_split(text: str, budget: int) -> list[str]:
    """longest prefixes within the budget, cut back to white space in their last fifth. A prefix has as many tokens as start in
    it, so the start of the first token too many is its end; no part is read twice."""
    out, at = [], 0
    while at < len(text):
        starts = [m.start() for m in islice(TOKEN.finditer(text, at), budget + 1)]
        if len(starts) <= budget:
            out.append(text[at:])
            break
        low = starts[budget] - at
        if low < 1:
            raise ValueError("PDF_CHUNK_BUDGET_TOO_SMALL")
        back = at + int(low * 0.8)
        blank = max(text.rfind(" ", back, at + low), text.rfind("\n", back, at + low))
        cut = blank + 1 if blank > at else at + low
        out.append(text[at:cut])
        at = cut
    return out


def split_text(text: str, budget: int, level: int = 0) -> list[str]:
    """whole, else paragraphs, sentences, then hard cuts; units are grouped greedily. White space between units is no token and
    ends one, so the tokens of a group are those of its units."""
    if tokens(text) <= budget:
        return [text] if text.strip() else []
    if level == 2:
        return [x for x in hard_split(text, budget) if x.strip()]
    units, glue = (re.split(r"\n+", text), "\n") if level == 0 else (SENTENCE.split(text), " ")
    out, held, used = [], [], 0
    for unit in (u for u in units if u and u.strip()):
        size = tokens(unit)
        if used + size <= budget:
            held.append(unit)
            used += size
            continue
        if held:
            out.append(glue.join(held))
        held, used = [unit], size
        if size > budget:
            out += split_text(unit, budget, level + 1)
            held, used = [], 0
    return out + [glue.join(held)] * bool(held)


def chunks(docs: DataFrame, budget: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_no, text, n_tokens)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(frames):
        for f in frames:
            rows = [(i, n, c, tokens(c)) for i, t in zip(f.iloc[:, 0], f.iloc[:, 1], strict=True) for n, c in enumerate(split_text(t or "", budget))]
            yield pd.DataFrame(rows, columns=[id_col, "chunk_no", "text", "n_tokens"])

    return docs.select(id_col, text_col).mapInPandas(run, f"{id_col} {kind}, chunk_no int, text string, n_tokens int")


def split_table(columns: list[str], rows: list[list[str]], budget: int) -> list[list[list[str]]]:
    """groups of rows whose canonical text, header included, fits the budget."""
    size = lambda r: tokens(json.dumps({"columns": columns, "rows": r}, ensure_ascii=False, sort_keys=True, separators=(",", ":")))
    if size([]) > budget:
        raise ValueError("PDF_TABLE_HEADER_TOO_LARGE")
    out: list[list[list[str]]] = []
    for row in rows:
        if size([row]) > budget:
            raise ValueError("PDF_TABLE_ROW_TOO_LARGE")
        if out and size([*out[-1], row]) <= budget:
            out[-1].append(row)
        else:
            out.append([row])
    return out


class _Table(HTMLParser):
    """Cells of the first table as (text, is_header, rowspan, colspan)."""

    def __init__(self):
        super().__init__()
        self.rows, self.cell, self.depth = [], None, 0

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "table"
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th"):
            span = lambda n: max(1, int(v)) if (v := dict(attrs).get(n) or "").isdigit() else 1
            self.cell = [[], tag == "th", span("rowspan"), span("colspan")]
        elif tag == "br" and self.cell:
            self.cell[0].append("\n")

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell:
            text = " ".join("".join(self.cell[0]).split())
            self.rows = self.rows or [[]]
            self.rows[-1].append((text, *self.cell[1:]))
            self.cell = None

    def handle_data(self, data):
        if self.cell:
            self.cell[0].append(data)


def html_grid(html: str) -> tuple[list[str], list[list[str]], list[tuple[int, int, int, int]]]:
    """(columns, rows, merged cells as row, column, rowspan, colspan); text stands in a span's first cell only."""
    parser = _Table()
    parser.feed(html)
    grid: dict[tuple[int, int], str] = {}
    merged = []
    for r, cells in enumerate(parser.rows):
        c = 0
        for text, _, down, right in cells:
            while (r, c) in grid:
                c += 1
            for i in range(down):
                for j in range(right):
                    grid[r + i, c + j] = ""
            grid[r, c] = text
            if down > 1 or right > 1:
                merged.append((r, c, down, right))
            c += right
    height, width = len(parser.rows), 1 + max((c for _, c in grid), default=-1)
    rows = [[grid.get((r, c), "") for c in range(width)] for r in range(height)]
    if height > 1 or any(x[1] for x in parser.rows[:1] for x in x):
        return rows[0], rows[1:], merged
    return [f"column_{n}" for n in range(1, width + 1)], rows, merged


#: The codes of the corrections.
CORRECTIONS = {
    "code_fence": "markdown_fence_removed", "trailing_comma": "trailing_commas_removed", "single_value": "json_extracted_from_wrapper", "single_value_trailing_comma": "wrapper_extracted_and_trailing_commas_removed",
}


def repair_json(raw: str | None) -> tuple[str | None, str | None]:
    """(JSON text, correction): strict, without a fence, without trailing commas, one balanced value, or both; (None, code) if
    nothing or more than one value is found."""

    def load(text):
        try:
            return json.loads(text), True
        except ValueError:
            return None, False

    commas = lambda t: re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', lambda m: m[1] or "", t)

    def outermost(text):
        out, stack, start, inside, escaped = [], [], 0, False, False
        for i, ch in enumerate(text):
            if inside:
                escaped, inside = (not escaped and ch == "\\"), not (ch == '"' and not escaped)
            elif ch == '"' and stack:
                inside = True
            elif ch in "{[":
                start = i if not stack else start
                stack.append(ch)
            elif ch in "}]" and stack and (stack.pop() + ch) in ("{}", "[]") and not stack:
                out.append(text[start : i + 1])
        return out

    if raw is None:
        return None, "INVALID_JSON"
    fence = re.fullmatch(r"\s*```(?:json)?\s*(.*?)\s*```\s*", raw, re.S)
    for name, text in (("none", raw), ("code_fence", fence[1] if fence else None), ("trailing_comma", commas(raw))):
        if text is not None and (got := load(text))[1]:
            return json.dumps(got[0], ensure_ascii=False, sort_keys=True), name
    for name, change in (("single_value", lambda t: t), ("single_value_trailing_comma", commas)):
        found = {json.dumps(v, ensure_ascii=False, sort_keys=True) for t in outermost(raw) for v, ok in [load(change(t))] if ok}
        if len(found) == 1:
            return found.pop(), name
        if found:
            return None, "AMBIGUOUS_JSON"
    return None, "INVALID_JSON"


def repaired(rows: DataFrame, column: str) -> DataFrame:
    """rows with json, correction and code (that of the correction, or of the failure; null if the text was strict)."""

    @F.pandas_udf("json string, correction string, code string")
    def run(text: pd.Series) -> pd.DataFrame:
        found = [repair_json(t) for t in text]
        return pd.DataFrame([(j, c, CORRECTIONS.get(c, None if c == "none" else c)) for j, c in found], columns=["json", "correction", "code"])

    return rows.withColumn("_x", run(column)).select(*rows.columns, "_x.json", "_x.correction", "_x.code")
