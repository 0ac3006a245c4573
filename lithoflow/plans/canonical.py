"""Queries on identities, paths, merge, chunking and rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import canonical, chunk, contracts, render
from .common import table, values

LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
BRANDS = [("fluid.oil.density", None), ("fluid.oil.density", "gas"), ("rock.compressibility", None), ("physical.pressure", None), ("fluid.gas.pvt.viscosity", None), ("no.such.concept", "oil")]


def legacy_id_migration(spark, sf_dir):
    """Every part plays one of six identities."""
    at = lambda n: F.element_at(F.array(*[F.lit(b[n]) for b in BRANDS]), (F.col("p_partkey") % 6 + 1).cast("int"))
    phase = at(1)
    context = F.when(phase.isNotNull(), F.struct(F.lit("fluid_properties").alias("scope"), phase.alias("phase"), F.lit("property").alias("role"), F.lit(None).cast("string").alias("phase_system")))
    rows = contracts.migrate(table(spark, sf_dir, "part").select("p_partkey", at(0).alias("concept_id"), context.alias("context")))
    return rows.select("p_partkey", "norm_concept", F.col("norm_context.scope").alias("scope"), F.col("norm_context.phase").alias("phase"), "compat", "code")


SQL_LEGACY = f"""
WITH b AS (SELECT * FROM {values([(n, *x) for n, x in enumerate(BRANDS)])} v(n, c, p)),
r AS (SELECT p_partkey, n, c, p FROM part JOIN b ON p_partkey % 6 = n)
SELECT p_partkey, CASE n WHEN 0 THEN 'physical.density' WHEN 1 THEN 'physical.density' WHEN 4 THEN 'physical.viscosity' ELSE c END AS norm_concept,
  CASE n WHEN 0 THEN 'fluid_properties' WHEN 1 THEN 'fluid_properties' WHEN 2 THEN 'rock' WHEN 4 THEN 'pvt' WHEN 5 THEN 'fluid_properties' END AS scope,
  CASE n WHEN 0 THEN 'oil' WHEN 1 THEN 'oil' WHEN 4 THEN 'gas' WHEN 5 THEN 'oil' END AS phase, n IN (0, 1, 2, 4) AS compat,
  CASE n WHEN 1 THEN 'SEMANTIC_CONTEXT_CONFLICT' WHEN 3 THEN 'SEMANTIC_CONTEXT_REQUIRED' END AS code FROM r
"""


def path_resolve(spark, sf_dir):
    """Lines as drafts of a pressure limit; some selectors are unsafe, missing or contradict the path."""
    n = F.col("l_linenumber")
    well = F.when(n == 7, F.concat(F.lit("W "), "l_orderkey")).otherwise(F.concat(F.lit("W"), "l_orderkey"))
    control = F.element_at(F.array(*map(F.lit, ["liquid_rate", "bhp", "water_injection_rate"])), (F.col("l_suppkey") % 3 + 1).cast("int"))
    selectors = F.when(n == 6, F.create_map(F.lit("well_id"), well)).when(n == 5, F.create_map(F.lit("well_id"), well, F.lit("control_type"), F.lit("spin"))).otherwise(F.create_map(F.lit("well_id"), well, F.lit("control_type"), control))
    given = F.when(n == 4, F.lit("wells[OTHER].controls[bhp].constraints[maximum_bhp].value")).when(n == 3, F.lit("rock.compressibility"))
    rows = table(spark, sf_dir, "lineitem").select(*LINE, F.lit("well.constraint.maximum_bhp").alias("concept_id"), F.lit(None).cast(contracts.CONTEXT_DDL).alias("context"), selectors.alias("selectors"), given.alias("canonical_path"))
    return contracts.resolve(rows).select(*LINE, "path", "code")


SQL_PATH = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN l_linenumber <= 2 THEN 'wells[W' || l_orderkey || '].controls[' || ['liquid_rate', 'bhp', 'water_injection_rate'][l_suppkey % 3 + 1] || '].constraints[maximum_bhp].value' END AS path,
  CASE l_linenumber WHEN 7 THEN 'INVALID_CANONICAL_SELECTORS' WHEN 5 THEN 'INVALID_CANONICAL_SELECTORS' WHEN 6 THEN 'CANONICAL_SELECTORS_REQUIRED' WHEN 4 THEN 'CANONICAL_PATH_MISMATCH' WHEN 3 THEN 'CANONICAL_PATH_MISMATCH' END AS code
FROM lineitem
"""


def path_merge_conflicts(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.concat(F.lit("lines["), "l_linenumber", F.lit("].flag")).alias("path"), F.col("l_returnflag").alias("text"), "l_partkey", "l_suppkey")
    return canonical.merge_paths(rows, ["case_id", "path"], ["text"], ["l_partkey", "l_suppkey"])


def path_nest_render(spark, sf_dir):
    """An order's selectors in natural order; some are numbers, some text."""
    line = table(spark, sf_dir, "lineitem")
    selector = F.when(F.col("l_partkey") % 2 == 0, F.col("l_partkey").cast("string")).otherwise(F.concat(F.when(F.col("l_partkey") % 3 == 0, "B").otherwise("a"), F.col("l_partkey")))
    items = line.groupBy("l_orderkey").agg(F.collect_set(selector).alias("s"))
    return items.select("l_orderkey", F.array_join(canonical.natural_sort(F.col("s"), lambda x: x), ",").alias("selectors"))


SQL_NEST = """
WITH s AS (SELECT DISTINCT l_orderkey, CASE WHEN l_partkey % 2 = 0 THEN l_partkey::VARCHAR ELSE (CASE WHEN l_partkey % 3 = 0 THEN 'B' ELSE 'a' END) || l_partkey END AS s, l_partkey % 2 AS t, l_partkey AS n FROM lineitem)
SELECT l_orderkey, string_agg(s, ',' ORDER BY t, CASE WHEN t = 0 THEN n END, lower(s), s) AS selectors FROM s GROUP BY 1
"""


def greedy_groups(spark, sf_dir):
    """W08 in the JVM: lines of a document in groups of at most 400 characters."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n", -1).alias("l"))
    sizes = F.transform("l", lambda x: F.greatest(F.length(x), F.lit(1)))
    return lines.select("doc_id", (F.array_max(chunk.greedy_groups(sizes, 400)) + 1).cast("long").alias("n_groups"))


def greedy_chunks(spark, sf_dir):
    return chunk.chunks(table(spark, sf_dir, "documents"), 200)


#: Our own span table: header of two rows, a cell over two rows.
GRID = "<table><tr><th rowspan=2>Well</th><th colspan=2>Rate</th></tr><tr><th>oil</th><th>water</th></tr><tr><td>P-1</td><td>10</td><td>4</td></tr><tr><td>P-2</td><td colspan='x'>7<br>8</td></tr></table>"


def html_grid_expand(spark, sf_dir):
    columns, rows, _ = chunk.html_grid(GRID)
    return spark.createDataFrame([(n, "|".join(columns), "|".join(r)) for n, r in enumerate(rows)], "row_no int, columns string, cells string")


def json_repair(spark, sf_dir):
    broken = F.element_at(F.array(F.col("props"), F.concat(F.lit("```json\n"), "props", F.lit("\n```")), F.replace(F.col("props"), F.lit("}"), F.lit(",}")), F.concat(F.lit("so: "), "props", F.lit(" ok")), F.concat("props", F.lit(' {"z": 1}'))), (F.col("event_id") % 5 + 1).cast("int"))
    return chunk.repaired(table(spark, sf_dir, "events").select("event_id", broken.alias("raw")), "raw").select("event_id", "json", "correction", "code")


def time_steps(spark, sf_dir):
    steps = render.time_steps(F.floor("o_totalprice") / 100.0, F.lit(91.25))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.posexplode(steps).alias("step_no", "days")).select("o_orderkey", "step_no", F.round("days", 6).alias("days"))


SQL_STEPS = """
WITH d AS (SELECT o_orderkey, floor(o_totalprice) / 100.0::DOUBLE AS d FROM orders), n AS (SELECT o_orderkey, d, floor(d / 91.25::DOUBLE)::INTEGER AS n FROM d)
SELECT o_orderkey, CAST(i AS INTEGER) AS step_no, CASE WHEN i < n THEN 91.25::DOUBLE ELSE round(d - 91.25::DOUBLE * n, 6) END AS days FROM (SELECT *, unnest(range(0, n + 1)) AS i FROM n) WHERE i < n OR d - 91.25::DOUBLE * n > 1e-9
"""


def render_records(spark, sf_dir):
    """An order's lines as one table keyword, one well keyword and one plain keyword."""
    line = table(spark, sf_dir, "lineitem")
    keyword = F.element_at(F.array(*map(F.lit, ["SWOF", "WCONPROD", "ROCK"])), (F.col("l_suppkey") % 3 + 1).cast("int"))
    section = F.when(keyword == "WCONPROD", "SCHEDULE").otherwise("PROPS")
    rows = line.select(
        F.col("l_orderkey").alias("case_id"), F.when(keyword == "ROCK", 1).when(keyword == "SWOF", 2).otherwise(3).alias("block_no"), section.alias("section"), keyword.alias("keyword"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("record_no"),
        F.concat_ws(" ", render.quoted(F.concat("l_returnflag", F.lit("'"), "l_linestatus")), render.number_token(F.col("l_extendedprice") / 7), render.number_token(F.when(F.col("l_tax") > 0, F.col("l_tax")))).alias("line"),
    )
    return render.render_include(rows, "TEST").select("case_id", "text")


SQL_RENDER = """
WITH r AS (SELECT *, ['SWOF', 'WCONPROD', 'ROCK'][l_suppkey % 3 + 1] AS k FROM lineitem),
x AS (SELECT l_orderkey, k, CASE k WHEN 'ROCK' THEN 1 WHEN 'SWOF' THEN 2 ELSE 3 END AS b, l_linenumber, l_partkey, l_suppkey,
  '  ''' || l_returnflag || '''''' || l_linestatus || ''' ' || printf('%.12g', l_extendedprice / 7) || ' ' || CASE WHEN l_tax > 0 THEN printf('%.12g', l_tax) ELSE '1*' END || CASE WHEN k = 'SWOF' THEN '' ELSE ' /' END AS line FROM r),
g AS (SELECT l_orderkey, b, k, k || chr(10) || string_agg(line, chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey) || CASE WHEN k IN ('SWOF', 'WCONPROD') THEN chr(10) || '/' ELSE '' END AS t FROM x GROUP BY l_orderkey, b, k),
h AS (SELECT *, CASE WHEN b = 3 THEN 'SCHEDULE' ELSE 'PROPS' END AS s, lag(b) OVER (PARTITION BY l_orderkey ORDER BY b) AS p FROM g),
i AS (SELECT l_orderkey, b, CASE WHEN p IS NULL OR b = 3 THEN chr(10) || '-- ' || s || chr(10) ELSE '' END || t AS t FROM h)
SELECT l_orderkey AS case_id, '-- Generated deterministic demo INCLUDE' || chr(10) || '-- Dialect: TEST' || chr(10) || '-- Requires a compatible host deck; no missing values were guessed.' || chr(10) || string_agg(t, chr(10) ORDER BY b) || chr(10) AS text FROM i GROUP BY 1
"""
SQL_REPAIR = """
SELECT event_id, CASE WHEN event_id % 5 <> 4 THEN props END AS json, ['none', 'code_fence', 'trailing_comma', 'single_value', 'AMBIGUOUS_JSON'][event_id % 5 + 1] AS correction,
  [NULL, 'markdown_fence_removed', 'trailing_commas_removed', 'json_extracted_from_wrapper', 'AMBIGUOUS_JSON'][event_id % 5 + 1] AS code FROM events
"""
SQL_GREEDY = """
WITH RECURSIVE l AS (SELECT doc_id, i, greatest(length(parts[i]), 1) AS n, len(parts) AS last FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))),
g AS (SELECT doc_id, i, n AS used, 1 AS groups, last FROM l WHERE i = 1 UNION ALL
  SELECT l.doc_id, l.i, CASE WHEN g.used + l.n <= 400 THEN g.used + l.n ELSE l.n END, CASE WHEN g.used + l.n <= 400 THEN g.groups ELSE g.groups + 1 END, l.last FROM g JOIN l ON l.doc_id = g.doc_id AND l.i = g.i + 1)
SELECT doc_id, groups::BIGINT AS n_groups FROM g WHERE i = last
"""
QUERIES = {
    "legacy_id_migration": (legacy_id_migration, SQL_LEGACY),
    "path_resolve": (path_resolve, SQL_PATH),
    "path_merge_conflicts": (path_merge_conflicts, "SELECT l_orderkey AS case_id, 'lines[' || l_linenumber || '].flag' AS path, count(*) AS n, count(DISTINCT l_returnflag) AS n_values, CASE WHEN count(DISTINCT l_returnflag) > 1 THEN 'DUPLICATE_CANONICAL_ASSIGNMENT' END AS code, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) END AS text FROM lineitem GROUP BY l_orderkey, l_linenumber"),
    "path_nest_render": (path_nest_render, SQL_NEST),
    "greedy_groups": (greedy_groups, SQL_GREEDY),
    "greedy_chunks": (greedy_chunks, None),
    "html_grid_expand": (html_grid_expand, None),
    "json_repair": (json_repair, SQL_REPAIR),
    "time_steps": (time_steps, SQL_STEPS),
    "render_records": (render_records, SQL_RENDER),
}
