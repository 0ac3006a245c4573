"""Page layout as joins and windows: reading order, captions, sections, spans.

Lines: case_id, page, line_id, x0, top, x1, bottom, text. Tables and figures: the same box columns and an id. Everything is
partitioned by document and page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import carried, in_cells, overlap

PAGE = ["case_id", "page"]
BOX = ["x0", "top", "x1", "bottom"]
#: Fixed values of the layout rules: points between a table and its caption, between two caption lines, heading length.
CAPTION_GAP, SECOND_GAP, HEADING_CHARS, EXCLUDED_SHARE, LOW_CONFIDENCE = 24.0, 18.0, 40, 0.5, 0.7
#: Cells of the overlap joins: points, and characters.
CELL, SPAN = 64.0, 1000
ACROSS, DOWN = ("x0", "x1", "cx"), ("top", "bottom", "cy")
DROPPED = ["header", "footer", "page_number", "number", "header_image", "footer_image"]


def _boxes(prefix: str) -> list[Column]:
    return [F.col(f"{prefix}.{c}") for c in BOX]


def excluded_lines(lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """Lines less than half under any excluded box of their page. Lines and boxes meet in the cells that both touch."""
    keys = [*PAGE, "cx", "cy"]
    own = in_cells(lines.select(*PAGE, "line_id", *BOX), [ACROSS, DOWN], CELL).alias("l")
    hit = own.join(in_cells(boxes.select(*PAGE, *BOX), [ACROSS, DOWN], CELL).alias("b"), [F.col(f"l.{c}") == F.col(f"b.{c}") for c in keys]).filter(overlap(*_boxes("l"), *_boxes("b")) >= EXCLUDED_SHARE)
    return lines.join(hit.select(*[F.col(f"l.{c}").alias(c) for c in [*PAGE, "line_id"]]).distinct(), [*PAGE, "line_id"], "left_anti")


def table_blocks(tables: DataFrame) -> DataFrame:
    """(…, columns, rows) of raw cell rows: empty rows go, the first left is the header; tables of a header alone give none."""
    full = F.filter("cells", lambda r: F.exists(r, lambda c: c.isNotNull() & (F.trim(c) != "")))
    return tables.withColumn("_r", full).filter(F.size("_r") > 1).withColumn("columns", F.element_at("_r", 1)).withColumn("rows", F.slice("_r", 2, F.size("_r"))).drop("_r", "cells")


def numbered_figures(figures: DataFrame) -> DataFrame:
    """S12."""
    return figures.withColumn("figure_index", F.row_number().over(Window.partitionBy(*PAGE).orderBy("top", "x0")))


def page_modes(pages: DataFrame) -> DataFrame:
    """Native, ocr or mixed (an issue) for each document of pages with n_text, n_images, restricted."""
    needs = (F.col("n_text") == 0) & (F.col("n_images") > 0)
    found = pages.groupBy("case_id").agg(F.bool_or("restricted").alias("restricted"), F.bool_or(needs).alias("some"), F.bool_or(F.col("n_text") > 0).alias("native"), F.count(F.lit(1)).alias("n_pages"))
    mode = F.when(F.col("restricted") | (F.col("some") & ~F.col("native")), "ocr").when(F.col("some"), "mixed").otherwise("native")
    code = F.when(F.col("n_pages") > 500, "PDF_PAGE_LIMIT_EXCEEDED").when(mode == "mixed", "PDF_MIXED_CAPABILITY")
    return found.select("case_id", mode.alias("mode"), code.alias("code"), F.when(F.col("restricted"), F.array(F.lit("SOURCE_TEXT_EXTRACTION_RESTRICTED"))).otherwise(F.array().cast("array<string>")).alias("flags"))


def image_coverage(images: DataFrame) -> DataFrame:
    """S18."""
    area = (F.col("x1") - F.col("x0")) * (F.col("bottom") - F.col("top"))
    return images.groupBy(*PAGE).agg(F.least(F.sum(area) / F.greatest(F.max("page_area"), F.lit(1.0)), F.lit(1.0)).alias("coverage"))


def ocr_regions(regions: DataFrame, words: DataFrame) -> DataFrame:
    """Regions without page furniture, typed, with the mean score of the words inside and review flags."""
    kept = regions.filter(~F.col("label").isin(DROPPED))
    kind = F.when(F.col("label") == "table", "table").when(F.col("label").isin("image", "figure", "chart"), "figure").otherwise("text")
    # a word has its centre in one cell of its page, so a word and a region meet once at most
    keys = [*PAGE, "cx", "cy"]
    centre = words.select(*PAGE, ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("top") + F.col("bottom")) / 2).alias("y"), "score")
    centre = centre.withColumn("cx", F.floor(F.col("x") / CELL)).withColumn("cy", F.floor(F.col("y") / CELL)).alias("w")
    own = in_cells(kept.select(*PAGE, "region_id", *BOX), [ACROSS, DOWN], CELL).alias("r")
    met = own.join(centre, [F.col(f"r.{c}") == F.col(f"w.{c}") for c in keys]).filter(F.col("x").between(F.col("r.x0"), F.col("r.x1")) & F.col("y").between(F.col("r.top"), F.col("r.bottom")))
    scored = met.groupBy("r.case_id", "r.page", "r.region_id").agg(F.avg("w.score").alias("confidence"), F.count(F.lit(1)).alias("n_words"))
    flag = F.when(F.col("label") == "formula", F.array().cast("array<string>")).when(F.col("confidence").isNull(), F.array(F.lit("OCR_CONFIDENCE_MISSING"))).when(F.col("confidence") < LOW_CONFIDENCE, F.array(F.lit("OCR_LOW_CONFIDENCE"))).otherwise(F.array().cast("array<string>"))
    return kept.join(scored, [*PAGE, "region_id"], "left").withColumn("kind", kind).withColumn("flags", flag)


def reading_order(blocks: DataFrame) -> DataFrame:
    """Order within a page: the extractor's (seq) if two boxes lie side by side, else top to bottom."""
    strips = in_cells(blocks.select(*PAGE, "seq", *BOX), [DOWN], CELL)  # boxes side by side share a strip of the page
    a, b = strips.alias("a"), strips.alias("b")
    beside = (F.col("a.seq") < F.col("b.seq")) & (F.least("a.bottom", "b.bottom") > F.greatest("a.top", "b.top")) & ((F.col("a.x1") <= F.col("b.x0")) | (F.col("b.x1") <= F.col("a.x0")))
    pages = a.join(b, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in [*PAGE, "cy"]]).filter(beside).select(*[F.col(f"a.{c}").alias(c) for c in PAGE]).distinct().withColumn("columns", F.lit(True))
    rows = blocks.join(pages, PAGE, "left")
    key = F.when(F.col("columns"), F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.col("seq").alias("c"))).otherwise(F.struct(F.col("top").alias("a"), F.col("x0").alias("b"), F.col("seq").alias("c")))
    return rows.withColumn("reading_order", F.row_number().over(Window.partitionBy(*PAGE).orderBy(key))).drop("columns")


def captions(tables: DataFrame, lines: DataFrame) -> DataFrame:
    """(case_id, page, table_id, line_id): the nearest caption line above a table, and the line above that one.

    A line belongs to one table: of tables that want it, the first in order has it, and a later one goes without, as the
    tables' greedy order says.
    """
    label = F.col("l.text").rlike(r"(?i)^\s*(table|tab\.|表)\s*[\d一二三四五六七八九十]") | F.coalesce(F.col("l.label") == "table_caption", F.lit(False))
    share = F.greatest(F.least("l.x1", "t.x1") - F.greatest("l.x0", "t.x0"), F.lit(0.0)) / F.greatest(F.col("l.x1") - F.col("l.x0"), F.lit(1.0))
    gap = F.col("t.top") - F.col("l.bottom")
    near = tables.alias("t").join(lines.alias("l"), [F.col(f"t.{c}") == F.col(f"l.{c}") for c in PAGE]).filter((gap >= 0) & (share >= 0.5))
    rows = near.select(*[F.col(f"t.{c}").alias(c) for c in PAGE], "t.table_id", F.col("t.top").alias("t_top"), F.col("t.x0").alias("t_x0"), "l.line_id", "l.top", "l.bottom", gap.alias("gap"), label.alias("is_caption"))
    order = Window.partitionBy(*PAGE, "table_id").orderBy(F.desc("bottom"), "line_id")
    ranked = rows.withColumn("n", F.row_number().over(order)).withColumn("below_top", F.lag("top").over(order)).withColumn("below_caption", F.lag("is_caption").over(order)).withColumn("below_gap", F.lag("gap").over(order))
    first = (F.col("n") == 1) & F.col("is_caption") & (F.col("gap") <= CAPTION_GAP)
    second = (F.col("n") == 2) & F.col("below_caption") & (F.col("below_gap") <= CAPTION_GAP) & (F.col("below_top") - F.col("bottom") <= SECOND_GAP)
    owner = Window.partitionBy(*PAGE, "line_id").orderBy("t_top", "t_x0", "table_id")
    return ranked.filter(first | second).withColumn("o", F.row_number().over(owner)).filter("o = 1").select(*PAGE, "table_id", "line_id")


def heading(text: Column, label: Column) -> Column:
    """P20."""
    short = (F.length(text) <= HEADING_CHARS) & F.trim(text).rlike("[:：]$") & ~F.contains(text, F.lit("\n"))
    return F.coalesce(label.isin("title", "doc_title", "paragraph_title", "section_title"), F.lit(False)) | short


def sections(lines: DataFrame) -> DataFrame:
    """section_title of every line, carried from the last heading of the document."""
    mark = F.when(heading(F.col("text"), F.col("label")), F.regexp_replace(F.trim("text"), "[:：]$", ""))
    return lines.withColumn("section_title", carried("case_id", ["page", "reading_order"], mark))


def offsets(lines: DataFrame) -> DataFrame:
    """Start and end of each line in its document's joined text (two characters between lines)."""
    before = F.sum(F.length("text") + 2).over(Window.partitionBy("case_id").orderBy("page", "reading_order").rowsBetween(Window.unboundedPreceding, -1))
    return lines.withColumn("start", F.coalesce(before, F.lit(0))).withColumn("end", F.col("start") + F.length("text"))


def chunk_regions(chunks: DataFrame, lines: DataFrame) -> DataFrame:
    """Box and clipped span of each chunk (start, end) on each page that its lines lie on."""
    cells = lambda df: in_cells(df.withColumn("first", F.floor(F.col("start") / SPAN)), [("start", "end", "cell")], SPAN)
    meet = (F.col("c.case_id") == F.col("l.case_id")) & (F.col("c.cell") == F.col("l.cell")) & (F.col("l.end") > F.col("c.start")) & (F.col("l.start") < F.col("c.end"))
    # a chunk and a line that share several cells meet in the first of them alone
    hit = cells(chunks).alias("c").join(cells(lines).alias("l"), meet).filter(F.col("c.cell") == F.greatest("c.first", "l.first"))
    return hit.groupBy("c.case_id", "c.chunk_no", "l.page").agg(
        F.min("l.x0").alias("x0"), F.min("l.top").alias("top"), F.max("l.x1").alias("x1"), F.max("l.bottom").alias("bottom"), F.min(F.greatest("l.start", "c.start")).alias("start"), F.max(F.least("l.end", "c.end")).alias("end"),
    )


def location(page: Column, box: list[Column], start: Column, end: Column) -> Column:
    """F18."""
    where = F.format_string("page %d, bbox (%.2f, %.2f, %.2f, %.2f)", page, *box)
    return F.when(start.isNull(), where).otherwise(F.concat(where, F.format_string(", chars %d-%d", start, end)))


def review_issues(regions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Open review of OCR regions (region_id, flags): undecided, and decisions on unknown regions."""
    flagged = regions.filter(F.size("flags") > 0).select("case_id", "region_id")
    undecided = flagged.join(decisions, ["case_id", "region_id"], "left_anti").select("case_id", "region_id", F.lit("OCR_REVIEW_REQUIRED").alias("code"))
    unknown = decisions.join(flagged, ["case_id", "region_id"], "left_anti").select("case_id", "region_id", F.lit("OCR_REVIEW_UNKNOWN_ISSUE").alias("code"))
    return undecided.unionByName(unknown)


def reviewed(regions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Regions that decisions (action include, accept or exclude) leave."""
    gone = decisions.filter("action = 'exclude'").select("case_id", "region_id")
    return regions.join(gone, ["case_id", "region_id"], "left_anti")
