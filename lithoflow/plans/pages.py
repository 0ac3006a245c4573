"""Queries on page layout, OCR results and review: the layout operators over parts and documents as pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layout, ocr
from ..sources import sinks
from .common import table


def _parts(spark, sf_dir):
    """Parts in pages of ten: (case_id, page, at, p_partkey, p_size, p_retailprice)."""
    return table(spark, sf_dir, "part").select(F.lit("c").alias("case_id"), F.expr("p_partkey div 10").alias("page"), (F.col("p_partkey") % 10).alias("at"), "p_partkey", "p_size", "p_retailprice")


def table_captions(spark, sf_dir):
    """Tables at places 0 and 5 of a page, lines elsewhere; some lines look like captions."""
    top = (F.col("at") * 20).cast("double")
    rows = _parts(spark, sf_dir).select("case_id", "page", "at", "p_partkey", F.lit(0.0).alias("x0"), top.alias("top"), F.lit(100.0).alias("x1"), (top + 10).alias("bottom"), F.when(F.col("p_size") % 2 == 0, "Table 3: rates").otherwise("other").alias("text"), F.lit(None).cast("string").alias("label"))
    tables, lines = rows.filter("at % 5 = 0").withColumnRenamed("p_partkey", "table_id"), rows.filter("at % 5 <> 0").withColumnRenamed("p_partkey", "line_id")
    return layout.captions(tables, lines).select("page", "table_id", "line_id")


SQL_CAPTIONS = """
WITH p AS (SELECT p_partkey, p_partkey // 10 AS page, p_size FROM part),
t AS (SELECT t.page, t.p_partkey AS table_id FROM p t JOIN p l ON l.p_partkey = t.p_partkey - 1 WHERE t.p_partkey % 10 = 5 AND l.p_size % 2 = 0)
SELECT page, table_id, table_id - 1 AS line_id FROM t UNION ALL SELECT t.page, table_id, table_id - 2 FROM t JOIN part ON p_partkey = table_id - 2
"""


def page_reading_order(spark, sf_dir):
    """Even pages have one column, odd ones two."""
    top = (F.col("p_partkey") * 7 % 10 * 30).cast("double")
    x0 = F.when(F.col("page") % 2 == 1, F.col("p_size") % 2 * 300).otherwise(0).cast("double")
    rows = _parts(spark, sf_dir).select("case_id", "page", F.col("p_partkey").alias("seq"), x0.alias("x0"), top.alias("top"), (x0 + 200).alias("x1"), (top + 70).alias("bottom"))
    return layout.reading_order(rows).select("page", "seq", "reading_order")


SQL_ORDER = """
WITH b AS (SELECT p_partkey // 10 AS page, p_partkey AS seq, CASE WHEN (p_partkey // 10) % 2 = 1 THEN p_size % 2 * 300 ELSE 0 END AS x0, p_partkey * 7 % 10 * 30 AS top FROM part),
w AS (SELECT DISTINCT a.page FROM b a JOIN b c ON a.page = c.page AND a.seq < c.seq AND least(a.top, c.top) + 70 > greatest(a.top, c.top) AND (a.x0 + 200 <= c.x0 OR c.x0 + 200 <= a.x0))
SELECT b.page, seq, CAST(row_number() OVER (PARTITION BY b.page ORDER BY CASE WHEN w.page IS NULL THEN top ELSE 0 END, CASE WHEN w.page IS NULL THEN x0 ELSE 0 END, seq) AS INTEGER) AS reading_order FROM b LEFT JOIN w ON w.page = b.page
"""


def _lines(spark, sf_dir):
    """Lines of documents: ten on a page, the first of every third document a title."""
    cut = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "text"))
    top = (F.col("line_no") % 10 * 12).cast("double")
    label = F.when((F.col("line_no") == 0) & (F.col("case_id") % 3 == 0), "title")
    return cut.select("case_id", F.expr("line_no div 10").alias("page"), (F.col("line_no") % 10).alias("reading_order"), "line_no", F.lit(0.0).alias("x0"), top.alias("top"), F.length("text").cast("double").alias("x1"), (top + 10).alias("bottom"), "text", label.alias("label"))


SQL_LINES = "l AS (SELECT doc_id, i - 1 AS n, parts[i] AS line FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)))"


def section_titles(spark, sf_dir):
    """Each line's section, from the last heading of its document."""
    found = layout.sections(_lines(spark, sf_dir))
    return found.select(F.col("case_id").alias("doc_id"), "line_no", "section_title")


SQL_SECTIONS = f"""
WITH {SQL_LINES}, h AS (SELECT doc_id, n, CASE WHEN (n = 0 AND doc_id % 3 = 0) OR (length(line) <= 40 AND regexp_matches(trim(line), '[:：]$')) THEN regexp_replace(trim(line), '[:：]$', '') END AS t FROM l)
SELECT doc_id, CAST(n AS INTEGER) AS line_no, last_value(t IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section_title FROM h
"""


def chunk_page_boxes(spark, sf_dir):
    """Chunks of 1000 characters of the joined text, with the box and span on each page they touch."""
    lines = layout.offsets(_lines(spark, sf_dir))
    length = lines.groupBy("case_id").agg(F.max("end").alias("n")).filter("n > 0")
    chunks = length.select("case_id", "n", F.explode(F.sequence(F.lit(0), F.expr("(n - 1) div 1000"))).alias("chunk_no")).select("case_id", "chunk_no", (F.col("chunk_no") * 1000).alias("start"), F.least(F.col("chunk_no") * 1000 + 1000, F.col("n")).alias("end"))
    found = layout.chunk_regions(chunks, lines)
    box = [F.col(c) for c in ("x0", "top", "x1", "bottom")]
    return found.select(F.col("case_id").alias("doc_id"), "chunk_no", "page", "x1", "top", "bottom", "start", "end", layout.location(F.col("page"), box, F.col("start"), F.col("end")).alias("location"))


SQL_CHUNKS = f"""
WITH {SQL_LINES}, o AS (SELECT doc_id, n, line, coalesce(sum(length(line) + 2) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM l),
e AS (SELECT *, s + length(line) AS e FROM o), d AS (SELECT doc_id, max(e) AS n FROM e GROUP BY 1 HAVING max(e) > 0),
c AS (SELECT doc_id, k AS chunk_no, k * 1000 AS a, least(k * 1000 + 1000, n) AS b FROM (SELECT doc_id, n, unnest(range(0, (n - 1) // 1000 + 1)) AS k FROM d)),
r AS (SELECT c.doc_id, chunk_no, n // 10 AS page, max(length(line))::DOUBLE AS x1, min(n % 10 * 12)::DOUBLE AS top, max(n % 10 * 12 + 10)::DOUBLE AS bottom, min(greatest(s, a)) AS start, max(least(e, b)) AS "end" FROM c JOIN e ON c.doc_id = e.doc_id AND e.e > a AND e.s < b GROUP BY 1, 2, 3)
SELECT doc_id, chunk_no, page, x1, top, bottom, start, "end", printf('page %d, bbox (%.2f, %.2f, %.2f, %.2f), chars %d-%d', page, 0.0::DOUBLE, top, x1, bottom, start, "end") AS location FROM r
"""


def page_modes(spark, sf_dir):
    """Orders as documents, their lines as pages."""
    line = table(spark, sf_dir, "lineitem")
    pages = line.select(F.col("l_orderkey").alias("case_id"), F.when(F.col("l_returnflag") == "N", 0).otherwise(F.col("l_linenumber")).alias("n_text"), F.when(F.col("l_returnflag") == "N", 1).otherwise(0).alias("n_images"), (F.col("l_quantity") > 48).alias("restricted"))
    found = layout.page_modes(pages)
    return found.select("case_id", "mode", "code", F.array_join("flags", ",").alias("flags"))


SQL_MODES = """
WITH g AS (SELECT l_orderkey, bool_or(l_quantity > 48) AS r, bool_or(l_returnflag = 'N') AS o, bool_or(l_returnflag <> 'N') AS n, count(*) AS c FROM lineitem GROUP BY 1),
m AS (SELECT *, CASE WHEN r OR (o AND NOT n) THEN 'ocr' WHEN o THEN 'mixed' ELSE 'native' END AS mode FROM g)
SELECT l_orderkey AS case_id, mode, CASE WHEN c > 500 THEN 'PDF_PAGE_LIMIT_EXCEEDED' WHEN mode = 'mixed' THEN 'PDF_MIXED_CAPABILITY' END AS code, CASE WHEN r THEN 'SOURCE_TEXT_EXTRACTION_RESTRICTED' ELSE '' END AS flags FROM m
"""


def page_tables(spark, sf_dir):
    """An order's lines as cell rows; some are empty, and orders of one row that is left have a header alone."""
    line = table(spark, sf_dir, "lineitem")
    cells = F.when(F.col("l_linenumber") % 3 == 0, F.array(F.lit(" "), F.lit(None).cast("string"))).otherwise(F.array(F.col("l_returnflag"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey")))
    grids = line.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", cells.alias("c")))), lambda x: x["c"]).alias("cells"))
    found = layout.table_blocks(grids)
    return found.select("l_orderkey", F.array_join("columns", "|").alias("columns"), F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), ";").alias("rows"))


SQL_TABLES = """
WITH l AS (SELECT l_orderkey, l_returnflag || '|' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS t, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem WHERE l_linenumber % 3 <> 0)
SELECT l_orderkey, max(CASE WHEN n = 1 THEN t END) AS columns, string_agg(CASE WHEN n > 1 THEN t END, ';' ORDER BY n) AS rows FROM l GROUP BY 1 HAVING count(*) > 1
"""


def page_figures(spark, sf_dir):
    """Figures numbered on their page, and the share of the page that they cover."""
    x0 = (F.col("p_size") % 7).cast("double")
    rows = _parts(spark, sf_dir).select("case_id", "page", "p_partkey", x0.alias("x0"), (F.col("p_partkey") * 3 % 10).cast("double").alias("top"), (x0 + F.col("p_size")).alias("x1"), (F.col("p_partkey") * 3 % 10 + 10).cast("double").alias("bottom"), F.lit(2000.0).alias("page_area"))
    share = layout.image_coverage(rows)
    return layout.numbered_figures(rows).join(share, ["case_id", "page"]).select("page", "p_partkey", "figure_index", F.round("coverage", 6).alias("coverage"))


def review_of_regions(spark, sf_dir):
    """Flagged regions without a decision, decisions on regions without a flag, and what is left to use."""
    part = _parts(spark, sf_dir)
    flags = F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit("OCR_LOW_CONFIDENCE"))).otherwise(F.array().cast("array<string>"))
    regions = part.select("case_id", F.col("p_partkey").alias("region_id"), flags.alias("flags"))
    decisions = part.filter("p_partkey % 4 = 0").select("case_id", F.col("p_partkey").alias("region_id"), F.when(F.col("p_size") > 25, "exclude").when(F.col("p_size") > 10, "accept").otherwise("include").alias("action"))
    left = layout.reviewed(regions, decisions).select("region_id", F.lit("USED").alias("code"))
    return layout.review_issues(regions, decisions).select("region_id", "code").union(left)


def review_summary(spark, sf_dir):
    """Decisions of each page."""
    action = F.when(F.col("p_size") > 25, "exclude").when(F.col("p_size") > 10, "accept").otherwise("include")
    return sinks.review_summary(_parts(spark, sf_dir).select(F.col("page").alias("case_id"), action.alias("action")))


def ocr_text_regions(spark, sf_dir):
    """Lines of an order are spans; recognised ones give the region's text; some are unknown, some come twice."""
    line = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"), F.max("l_returnflag").alias("f"))
    span = line.select(F.col("l_orderkey").alias("region_id"), F.col("l_linenumber").alias("span_id"), F.col("q").alias("top"), F.lit(0.0).alias("x0"), F.col("f").alias("text"), (F.col("q") / 50).alias("score"))
    detected = span.filter("span_id <> 6 OR region_id % 2 = 0").select("region_id", "span_id", "top", "x0")
    recognised = span.select("region_id", "span_id", "text", "score").union(span.filter("span_id = 2 AND region_id % 5 = 0").select("region_id", "span_id", "text", "score"))
    return ocr.region_texts(detected, recognised).select("region_id", "text", F.round("confidence", 6).alias("confidence"), "code")


SQL_REGIONS = """
WITH s AS (SELECT l_orderkey AS r, l_linenumber AS n, min(l_quantity) AS q, max(l_returnflag) AS f FROM lineitem GROUP BY 1, 2),
d AS (SELECT r, n, q FROM s WHERE n <> 6 OR r % 2 = 0), c AS (SELECT r, n, f, q / 50 AS score FROM s UNION ALL SELECT r, n, f, q / 50 FROM s WHERE n = 2 AND r % 5 = 0),
t AS (SELECT c.r, string_agg(f, chr(10) ORDER BY d.q, c.n, f) AS text, min(score) AS confidence FROM c JOIN d ON c.r = d.r AND c.n = d.n GROUP BY 1),
x AS (SELECT r, min(code) AS code FROM (SELECT r, 'OCR_SPAN_DUPLICATE' AS code FROM c GROUP BY r, n HAVING count(*) > 1 UNION ALL SELECT c.r, 'OCR_SPAN_UNKNOWN' FROM c ANTI JOIN d ON c.r = d.r AND c.n = d.n) GROUP BY 1)
SELECT coalesce(t.r, x.r) AS region_id, text, round(confidence, 6) AS confidence, code FROM t FULL JOIN x ON t.r = x.r
"""


def ocr_boxes(spark, sf_dir):
    """Polygons to boxes, pixels to points, boxes cut to the page, scores and their flags."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice", (F.col("p_partkey") % 97).cast("double").alias("x"), (F.col("p_partkey") % 89).cast("double").alias("y"))
    s = F.col("p_size").cast("double")
    point = lambda x, y: F.array(x, y)
    points = F.when(F.col("p_partkey") % 11 == 0, F.array().cast("array<array<double>>")).otherwise(F.array(point(F.col("x"), F.col("y")), point(F.col("x") + s, F.col("y") + 1), point(F.col("x"), F.col("y") + s)))
    rows = part.withColumn("b", ocr.polygon_box(points))
    box = [F.col(f"b.{c}") for c in ("x0", "top", "x1", "bottom")]
    score = F.when(F.col("p_partkey") % 7 == 0, F.lit(float("nan"))).when(F.col("p_partkey") % 5 != 0, F.col("p_retailprice") / 1500 - 0.1)
    flags = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("ROTATED"), F.lit("ROTATED"))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("cut", ocr.clamped(box, F.lit(100.0), F.lit(80.0))).withColumn("pt", ocr.to_points(box, (F.lit(100.0), F.lit(80.0)), (F.lit(600.0), F.lit(800.0)))).withColumn("score", ocr.confidence(score))
    rows = rows.withColumn("flags", ocr.review_flags(flags, F.col("score"), F.col("p_partkey") % 13 == 0))
    return rows.select("p_partkey", F.col("b.x1").alias("box_x1"), F.col("cut.bottom").alias("cut_bottom"), F.round("pt.x1", 6).alias("pt_x1"), F.round("pt.top", 6).alias("pt_top"), F.round("score", 6).alias("score"), F.array_join("flags", ",").alias("flags"))


SQL_BOXES = """
WITH p AS (SELECT p_partkey AS k, p_partkey % 97 AS x, p_partkey % 89 AS y, greatest(p_size, 0)::DOUBLE AS s, p_partkey % 11 <> 0 AS ok, CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 5 <> 0 THEN least(greatest(p_retailprice / 1500 - 0.1, 0), 1) END AS score FROM part),
b AS (SELECT *, CASE WHEN ok THEN x + s END AS x1, CASE WHEN ok THEN greatest(y + 1, y + s) END AS bottom FROM p)
SELECT k AS p_partkey, x1 AS box_x1, CASE WHEN ok AND least(x1, 100) > x AND least(bottom, 80) > y THEN least(bottom, 80)::DOUBLE END AS cut_bottom,
  CASE WHEN x1 > x AND bottom > y AND x1 * 6 <= 600 + 1e-6 AND bottom * 10 <= 800 + 1e-6 THEN round(x1 * 6, 6) END AS pt_x1, CASE WHEN x1 > x AND bottom > y AND x1 * 6 <= 600 + 1e-6 AND bottom * 10 <= 800 + 1e-6 THEN round(y * 10.0::DOUBLE, 6) END AS pt_top,
  round(score, 6) AS score, concat_ws(',', CASE WHEN k % 2 = 0 THEN 'ROTATED' END, CASE WHEN k % 13 = 0 THEN NULL WHEN score IS NULL THEN 'OCR_CONFIDENCE_MISSING' WHEN score < 0.7 THEN 'OCR_LOW_CONFIDENCE' END) AS flags FROM b
"""


def ocr_splits(spark, sf_dir):
    """An order's lines as proposed parts of a region; parts that cross or cover all void the proposal."""
    line = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"))
    top = (F.col("l_linenumber") * 50).cast("double")
    proposals = line.select(F.col("l_orderkey").alias("node_id"), F.col("l_linenumber").alias("box_id"), F.lit(0.0).alias("x0"), top.alias("top"), F.lit(100.0).alias("x1"), (top + 10 + F.col("q")).alias("bottom"), F.lit(100.0).alias("width"), F.lit(400.0).alias("height"))
    return ocr.accepted_splits(proposals).select(F.col("node_id").alias("l_orderkey"), F.col("box_id").alias("l_linenumber"), "position")


SQL_SPLITS = """
WITH p AS (SELECT l_orderkey AS o, l_linenumber AS n, l_linenumber * 50 AS top, 10 + min(l_quantity) AS h FROM lineitem GROUP BY 1, 2),
void AS (SELECT a.o FROM p a JOIN p b ON a.o = b.o AND a.n < b.n WHERE greatest(least(a.top + a.h, b.top + b.h) - greatest(a.top, b.top), 0) > 0.05 * least(a.h, b.h) UNION SELECT o FROM p GROUP BY o HAVING count(*) < 2 UNION SELECT o FROM p WHERE h * 100 >= 0.98 * 40000)
SELECT o AS l_orderkey, n AS l_linenumber, CAST(row_number() OVER (PARTITION BY o ORDER BY top, n) AS INTEGER) AS position FROM p WHERE o NOT IN (SELECT o FROM void)
"""


def ocr_payloads(spark, sf_dir):
    """Regions and raw tables of a page by id, by a box within two pixels, or as a page's only one."""
    rows = _parts(spark, sf_dir)
    box = lambda shift: [(F.col("at") * 100 + shift).cast("double").alias("x0"), F.lit(0.0).alias("top"), (F.col("at") * 100 + 50 + shift).cast("double").alias("x1"), F.lit(50.0).alias("bottom")]
    regions = rows.filter("at < 3").select("page", F.col("p_partkey").cast("string").alias("region_id"), *box(0))
    name = F.when(F.col("at") == 0, F.col("p_partkey").cast("string")).otherwise(F.concat(F.lit("t"), "p_partkey"))
    payloads = rows.filter("at < 2 AND page % 3 <> 0 OR at = 5 AND page % 3 = 0").select("page", name.alias("payload_id"), *box(F.when(F.col("page") % 2 == 0, 1.5).otherwise(2.5)))
    return ocr.payload_of(regions, payloads).select("page", F.col("region_id"), "payload_id")


SQL_PAYLOADS = """
WITH p AS (SELECT p_partkey AS k, p_partkey // 10 AS page, p_partkey % 10 AS spot FROM part),
y AS (SELECT page, spot, CASE WHEN spot = 0 THEN k::VARCHAR ELSE 't' || k END AS id FROM p WHERE (spot < 2 AND page % 3 <> 0) OR (spot = 5 AND page % 3 = 0)),
lone AS (SELECT page, min(id) AS id FROM y GROUP BY page HAVING count(*) = 1),
hit AS (SELECT r.page, r.k, y.id FROM p r JOIN y ON r.page = y.page AND r.spot = y.spot AND (y.spot = 0 OR r.page % 2 = 0) WHERE r.spot < 3)
SELECT page, k::VARCHAR AS region_id, id AS payload_id FROM hit UNION ALL
SELECT r.page, r.k::VARCHAR, lone.id FROM p r JOIN lone ON r.page = lone.page WHERE r.spot < 3 AND NOT EXISTS (SELECT 1 FROM hit WHERE hit.k = r.k)
"""
QUERIES = {
    "table_captions": (table_captions, SQL_CAPTIONS),
    "page_reading_order": (page_reading_order, SQL_ORDER),
    "section_titles": (section_titles, SQL_SECTIONS),
    "chunk_page_boxes": (chunk_page_boxes, SQL_CHUNKS),
    "page_modes": (page_modes, SQL_MODES),
    "page_tables": (page_tables, SQL_TABLES),
    "page_figures": (page_figures, "WITH f AS (SELECT p_partkey, p_partkey // 10 AS page, p_size % 7 AS x0, p_partkey * 3 % 10 AS top, p_size * 10.0::DOUBLE AS area FROM part) SELECT page, p_partkey, CAST(row_number() OVER (PARTITION BY page ORDER BY top, x0) AS INTEGER) AS figure_index, round(least(sum(area) OVER (PARTITION BY page) / 2000, 1), 6) AS coverage FROM f"),
    "review_of_regions": (review_of_regions, "SELECT p_partkey AS region_id, 'OCR_REVIEW_REQUIRED' AS code FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 4 <> 0 UNION ALL SELECT p_partkey, 'OCR_REVIEW_UNKNOWN_ISSUE' FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 4 = 0 UNION ALL SELECT p_partkey, 'USED' FROM part WHERE NOT (p_partkey % 4 = 0 AND p_size > 25)"),
    "review_summary": (review_summary, "SELECT p_partkey // 10 AS case_id, count_if(p_size <= 10)::BIGINT AS n_include, count_if(p_size > 25)::BIGINT AS n_exclude, count_if(p_size > 10 AND p_size <= 25)::BIGINT AS n_accept FROM part GROUP BY 1"),
    "ocr_text_regions": (ocr_text_regions, SQL_REGIONS),
    "ocr_boxes": (ocr_boxes, SQL_BOXES),
    "ocr_splits": (ocr_splits, SQL_SPLITS),
    "ocr_payloads": (ocr_payloads, SQL_PAYLOADS),
}
