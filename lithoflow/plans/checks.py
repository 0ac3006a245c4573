"""Queries on joins, guards, aggregates and ordered checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import units
from ..operators import checks as C
from ..operators import graph, joins, layout, retrieve
from ..sources import sinks
from .common import table, values

ALLOWED = [("NATION_0", "BUILDING"), ("NATION_1", None), ("NATION_7", "MACHINERY"), (None, "HOUSEHOLD")]
LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def profile_activation(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag")
    return joins.divided(rows, "l_orderkey", "l_returnflag", ["A", "N", "R"]).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus"), "l_orderkey")


def allowlist_anti(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("segment"))
    rows = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.when(F.col("c_custkey") % 11 != 0, F.col("n_name")).alias("nation"), "segment")
    return joins.null_safe(rows, spark.createDataFrame(ALLOWED, "nation string, segment string"), ["nation", "segment"])


def required_parent_missing(spark, sf_dir):
    left = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderkey"))
    return joins.unmatched(left, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("orderkey")), "orderkey")


def point_coordinate_missing(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return joins.guarded_missing(rows, "l_orderkey", F.col("l_linenumber") == 1, F.col("l_returnflag") != "R")


def constraint_target_mismatch(spark, sf_dir):
    """Returned lines of orders that have open lines, none of them of the same supplier."""
    line = table(spark, sf_dir, "lineitem")
    targets = line.filter("l_linestatus = 'O'").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("targets"))
    found = line.filter("l_returnflag = 'R'").join(targets, "l_orderkey", "left").filter(F.size("targets") > 0).filter(~F.array_contains("targets", F.col("l_suppkey")))
    return found.select(*LINE)


def duplicate_entity(spark, sf_dir):
    return C.duplicated(table(spark, sf_dir, "part"), ["p_name"])


def duplicate_coordinate(spark, sf_dir):
    return C.duplicate_coordinates(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_shipdate")


def minimum_points(spark, sf_dir):
    owners = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    return C.too_few(owners, table(spark, sf_dir, "lineitem"), "l_orderkey", 2)


CONSTRAINTS = {
    "A": {"minimum": 5, "maximum": 45},
    "N": {"exclusive_minimum": 10, "exclusive_maximum": 50},
    "R": {"maximum": 30},
}


def range_violation(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("rule", C.violated(F.col("l_quantity"), F.col("l_returnflag"), CONSTRAINTS))
    return rows.filter("rule IS NOT NULL").select(*LINE, "l_quantity", "rule")


def monotonic_coordinate(spark, sf_dir):
    return C.not_increasing(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], "l_shipdate")


def trend_after_sort(spark, sf_dir):
    return C.falling(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_quantity", "l_linenumber", "l_partkey", "l_suppkey"], "l_extendedprice")


def hierarchy_closure(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    edges = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("child"), F.col("r_name").alias("parent")).union(region.select("r_name", F.lit("WORLD")))
    up = graph.closure(edges)
    customers = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("node"), "n")
    return up.join(customers, "node").groupBy("ancestor", "depth").agg(F.sum("n").alias("n_customers"))


SQL_CLOSURE = """
WITH RECURSIVE e AS (SELECT n_name AS child, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 'WORLD' FROM region),
up AS (SELECT n AS node, n AS ancestor, 0 AS depth FROM (SELECT child AS n FROM e UNION SELECT parent FROM e) UNION ALL SELECT node, e.parent, depth + 1 FROM up JOIN e ON up.ancestor = e.child)
SELECT ancestor, depth, count(*) AS n_customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN up ON up.node = n_name GROUP BY ALL
"""


def edge_degrees(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    name = F.broadcast(nation.select("n_nationkey", "n_name"))
    edges = nation.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("src"), F.col("r_name").alias("dst"))
    edges = edges.union(table(spark, sf_dir, "supplier").join(name, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name"), "n_name"))
    return graph.degrees(edges)


def inverse_edge_missing(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("n"), "n_regionkey")
    forth = nation.select(F.col("n").alias("src"), F.lit("referenced_at").alias("relation"), F.concat(F.lit("R"), F.col("n_regionkey")).alias("dst"))
    back = nation.filter("n_nationkey % 4 <> 0").select(F.concat(F.lit("R"), F.col("n_regionkey")), F.lit("reference_for"), "n")
    return graph.missing_inverse(forth.union(back), {"referenced_at": "reference_for", "reference_for": "referenced_at"})


UNIT_OF = {"A": "PSI", "N": "bbl per day", "R": "MPa"}


def _unit_rows(spark, sf_dir):
    source = F.element_at(F.create_map(*[F.lit(x) for p in UNIT_OF.items() for x in p]), F.col("l_returnflag"))
    source = F.when(F.col("l_linenumber") == 7, F.lit("furlong")).otherwise(source)
    target = F.when(F.col("l_returnflag") == "N", "m3/day").when(F.col("l_linenumber") == 6, "cP").otherwise("bar")
    rows = table(spark, sf_dir, "lineitem").select(*LINE, "l_quantity", source.alias("s"), target.alias("t"))
    return units.convert(rows, "l_quantity", "s", "t").select(*LINE, F.round("unit_value", 6).alias("value"), F.col("unit_code").alias("code"))


def unit_normalise(spark, sf_dir):
    return _unit_rows(spark, sf_dir)


def unit_issue_summary(spark, sf_dir):
    return _unit_rows(spark, sf_dir).groupBy(F.coalesce("code", F.lit("OK")).alias("code")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total"))


SQL_UNIT = f"""
u AS (SELECT * FROM {values([(k, d, repr(f)) for d, m in units.UNITS.items() for k, f in m.items()])} v(k, d, f)),
x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CASE WHEN l_linenumber = 7 THEN 'furlong' WHEN l_returnflag = 'A' THEN 'psi' WHEN l_returnflag = 'N' THEN 'bbl/day' ELSE 'mpa' END AS s,
  CASE WHEN l_returnflag = 'N' THEN 'm3/day' WHEN l_linenumber = 6 THEN 'cp' ELSE 'bar' END AS t FROM lineitem),
r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN a.k IS NULL OR b.k IS NULL THEN 'UNSUPPORTED_UNIT' WHEN a.d <> b.d THEN 'INCOMPATIBLE_UNITS' END AS code,
  CASE WHEN a.d = b.d THEN round(l_quantity * a.f::DOUBLE / b.f::DOUBLE, 6) END AS value FROM x LEFT JOIN u a ON a.k = s LEFT JOIN u b ON b.k = t)
"""


def confidence_bands(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    confidence = F.coalesce(0.7 + 0.25 * F.col("quality") - 0.1 * F.col("toxic"), F.lit(0.5))
    banded = docs.select(retrieve.confidence_band(F.round(confidence, 6)).alias("band"))
    return banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"))


def review_gate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    band = F.when(F.col("quality").isNotNull(), retrieve.confidence_band(F.round(0.7 + 0.25 * F.col("quality") - 0.1 * F.col("toxic"), 6)))
    return retrieve.gate(docs.withColumn("band", band), "doc_id")


def _issues(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    one = lambda c, layer, severity, code: line.filter(c).select(F.col("l_orderkey").alias("case_id"), F.lit(layer).alias("layer"), F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.concat_ws(".", "l_linenumber", "l_partkey", "l_suppkey").alias("path"))
    return one("l_discount > 0.09", "schema", "warning", "DISCOUNT_HIGH").union(one("l_quantity > 48", "ontology", "error", "QUANTITY_LARGE")).union(one("l_tax > 0.07", "domain", "error", "TAX_HIGH")).union(one("l_returnflag = 'R'", "export", "warning", "RETURNED"))


SQL_ISSUES = """
i AS (SELECT l_orderkey AS case_id, layer, severity, code, l_linenumber || '.' || l_partkey || '.' || l_suppkey AS path FROM lineitem, LATERAL (
  SELECT * FROM (VALUES ('schema', 'warning', 'DISCOUNT_HIGH', l_discount > 0.09), ('ontology', 'error', 'QUANTITY_LARGE', l_quantity > 48), ('domain', 'error', 'TAX_HIGH', l_tax > 0.07), ('export', 'warning', 'RETURNED', l_returnflag = 'R')) v(layer, severity, code, ok) WHERE ok)),
o AS (SELECT *, CASE layer WHEN 'schema' THEN 1 WHEN 'ontology' THEN 2 WHEN 'domain' THEN 3 ELSE 4 END AS level FROM i)
"""


def level_short_circuit(spark, sf_dir):
    return C.short_circuit(_issues(spark, sf_dir)).select("case_id", "layer", "severity", "code", "path")


def issue_order(spark, sf_dir):
    return C.ordered_issues(_issues(spark, sf_dir)).select("case_id", "ordinal", "severity", "layer", "code", "path")


def trace_summary(spark, sf_dir):
    """Turns as calls; answers succeed, later turns repeat the one before, a system turn states no tokens."""
    role, chars = F.col("role"), F.length("text")
    calls = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("case_id"), F.when(role == "assistant", "success").otherwise("error").alias("outcome"), F.when(F.col("turn") > 0, F.col("turn") - 1).alias("retry_of"),
        F.when(role == "user", chars).alias("input_tokens"), F.when(role == "assistant", chars).alias("output_tokens"), (chars / 100.0).alias("seconds"),
    )
    return sinks.trace_summary(calls)


def retry_lineage(spark, sf_dir):
    return sinks.lineage(table(spark, sf_dir, "conversations"), ["conv_id", "role"], "turn").select("conv_id", "turn", "role", "retry_of", "attempt")


def structural_diff(spark, sf_dir):
    old = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", F.col("o_custkey").cast("string").alias("o_custkey"))
    new = old.filter("o_orderkey % 17 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus"))).withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderpriority")))
    return joins.structural_diff(old.filter("o_orderkey % 19 <> 0"), new, ["o_orderkey"], ["o_orderstatus", "o_orderpriority", "o_custkey"])


SQL_DIFF = """
WITH a AS (SELECT o_orderkey, unnest(['o_orderstatus', 'o_orderpriority', 'o_custkey']) AS path, unnest([o_orderstatus, o_orderpriority, o_custkey::VARCHAR]) AS before FROM orders WHERE o_orderkey % 19 <> 0),
b AS (SELECT o_orderkey, unnest(['o_orderstatus', 'o_orderpriority', 'o_custkey']) AS path, unnest([CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderpriority END, o_custkey::VARCHAR]) AS after FROM orders WHERE o_orderkey % 17 <> 0)
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, coalesce(a.path, b.path) AS path, before, after, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey AND a.path = b.path WHERE before IS DISTINCT FROM after OR a.path IS NULL OR b.path IS NULL
"""


def tolerant_compare(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    want, got = F.col("l_extendedprice"), F.col("l_extendedprice") * (1 + F.when(F.col("l_linenumber") == 3, 1e-6).when(F.col("l_linenumber") == 4, 1e-11).otherwise(0.0))
    return line.filter(~joins.tolerant(want, got)).select(*LINE, "l_extendedprice")


def _boxes(spark, sf_dir):
    """Every part as a box on one page."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice", (F.col("p_partkey") * 37 % 1000).cast("double").alias("x0"), (F.col("p_partkey") * 91 % 1000).cast("double").alias("top"))
    return part.select(F.lit("c").alias("case_id"), F.lit(1).alias("page"), "*")


def spatial_overlap_anti(spark, sf_dir):
    """Boxes not covered to a half by any excluded box."""
    box = _boxes(spark, sf_dir).withColumn("x1", F.col("x0") + F.col("p_size")).withColumn("bottom", F.col("top") + F.col("p_size")).withColumnRenamed("p_partkey", "line_id")
    left = layout.excluded_lines(box.filter("line_id % 10 <> 0"), box.filter("line_id % 10 = 0"))
    return left.select(F.col("line_id").alias("p_partkey"), "x0", F.col("top").alias("y0"))


SQL_SPATIAL = """
WITH b AS (SELECT p_partkey, (p_partkey * 37 % 1000)::DOUBLE AS x0, (p_partkey * 91 % 1000)::DOUBLE AS y0, p_size AS s FROM part)
SELECT p_partkey, x0, y0 FROM b l WHERE p_partkey % 10 <> 0 AND NOT EXISTS (SELECT 1 FROM b e WHERE e.p_partkey % 10 = 0 AND
  greatest(least(l.x0 + l.s, e.x0 + e.s) - greatest(l.x0, e.x0), 0) * greatest(least(l.y0 + l.s, e.y0 + e.s) - greatest(l.y0, e.y0), 0) / greatest(l.s * l.s, 1) >= 0.5)
"""


def point_in_region_mean(spark, sf_dir):
    """Mean score of the words whose centre lies in each region (inclusive), and the regions' flags."""
    part = _boxes(spark, sf_dir)
    words = part.filter("p_partkey % 20 <> 0").select("case_id", "page", "x0", "top", F.col("x0").alias("x1"), F.col("top").alias("bottom"), F.col("p_retailprice").alias("score"))
    label = F.when(F.col("p_partkey") % 100 == 0, "footer").when(F.col("p_partkey") % 60 == 0, "table").otherwise("text")
    regions = part.filter("p_partkey % 20 = 0").select("case_id", "page", F.col("p_partkey").alias("region_id"), label.alias("label"), "x0", "top", (F.col("x0") + 3 * F.col("p_size")).alias("x1"), (F.col("top") + 3 * F.col("p_size")).alias("bottom"))
    found = layout.ocr_regions(regions, words)
    return found.select(F.col("region_id").alias("region"), "kind", F.coalesce("n_words", F.lit(0)).alias("n"), F.round("confidence", 4).alias("mean"), F.array_join("flags", ",").alias("flags"))


SQL_POINT = """
WITH b AS (SELECT p_partkey, p_partkey * 37 % 1000 AS x, p_partkey * 91 % 1000 AS y, p_retailprice, p_size FROM part)
SELECT r.p_partkey AS region, CASE WHEN r.p_partkey % 60 = 0 THEN 'table' ELSE 'text' END AS kind, count(p.p_partkey) AS n, round(avg(p.p_retailprice), 4) AS mean, CASE WHEN count(p.p_partkey) = 0 THEN 'OCR_CONFIDENCE_MISSING' WHEN avg(p.p_retailprice) < 0.7 THEN 'OCR_LOW_CONFIDENCE' ELSE '' END AS flags
FROM b r LEFT JOIN b p ON p.p_partkey % 20 <> 0 AND p.x BETWEEN r.x AND r.x + 3 * r.p_size AND p.y BETWEEN r.y AND r.y + 3 * r.p_size WHERE r.p_partkey % 20 = 0 AND r.p_partkey % 100 <> 0 GROUP BY 1
"""


def asof_preceding(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return rows.withColumn("last_view", joins.preceding(rows, "user_id", ["ts", "event_id"], "event_id", F.col("event_type") == "view")).filter("event_type = 'purchase'").select("event_id", "user_id", "last_view")


def section_carry_forward(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", "user_id", joins.carried("user_id", ["ts", "event_id"], F.when(F.col("event_type") == "signup", F.concat(F.lit("s"), F.col("event_id")))).alias("section"))


def metadata_attach(spark, sf_dir):
    """Errors of a user count for the user's next purchase, unless a signup comes first."""
    rows = table(spark, sf_dir, "events").withColumn("kind", F.when(F.col("event_type") == "purchase", "block").when(F.col("event_type") == "signup", "reset").when(F.col("event_type") == "error", "metadata").otherwise("other"))
    runs = rows.withColumn("run", joins.block_of_metadata("user_id", ["ts", "event_id"], F.col("kind")))
    found = runs.groupBy("user_id", "run").agg(F.max(F.when(F.col("kind") == "block", F.col("event_id"))).alias("event_id"), F.count_if(F.col("kind") == "metadata").alias("n_errors"))
    return found.filter("event_id IS NOT NULL").select("event_id", "user_id", "n_errors")


def inventory_counts(spark, sf_dir):
    """Names owned by more than one brand, with the first spelling."""
    part = table(spark, sf_dir, "part").withColumn("alias", F.lower("p_name"))
    return part.groupBy("alias").agg(F.count_distinct("p_brand").alias("n_owners"), F.min_by("p_name", "p_partkey").alias("display")).filter("n_owners > 1")


ORDER_LINE = "l_linenumber, l_partkey, l_suppkey"
QUERIES = {
    "profile_activation": (profile_activation, "SELECT l_orderkey, o_orderstatus FROM (SELECT l_orderkey FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 3) JOIN orders ON o_orderkey = l_orderkey"),
    "allowlist_anti": (allowlist_anti, f"WITH a AS (SELECT * FROM {values(ALLOWED)} v(nation, segment)), r AS (SELECT c_custkey, CASE WHEN c_custkey % 11 <> 0 THEN n_name END AS nation, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS segment FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.nation IS NOT DISTINCT FROM r.nation AND a.segment IS NOT DISTINCT FROM r.segment)"),
    "required_parent_missing": (required_parent_missing, "SELECT o_orderkey AS orderkey, 'right' AS missing_in FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT DISTINCT l_orderkey, 'left' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)"),
    "point_coordinate_missing": (point_coordinate_missing, "SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_and(l_returnflag <> 'R') AND NOT bool_or(l_linenumber = 1)"),
    "constraint_target_mismatch": (constraint_target_mismatch, "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem r WHERE l_returnflag = 'R' AND EXISTS (SELECT 1 FROM lineitem o WHERE o.l_orderkey = r.l_orderkey AND o.l_linestatus = 'O') AND NOT EXISTS (SELECT 1 FROM lineitem o WHERE o.l_orderkey = r.l_orderkey AND o.l_linestatus = 'O' AND o.l_suppkey = r.l_suppkey)"),
    "duplicate_entity": (duplicate_entity, "SELECT p_name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1"),
    "duplicate_coordinate": (duplicate_coordinate, "SELECT l_orderkey, count(*) AS n, count(DISTINCT l_shipdate) AS n_distinct FROM lineitem GROUP BY 1 HAVING count(*) <> count(DISTINCT l_shipdate)"),
    "minimum_points": (minimum_points, "SELECT o_orderkey AS l_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1 HAVING count(l_orderkey) < 2"),
    "range_violation": (range_violation, "SELECT * FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CASE l_returnflag WHEN 'A' THEN CASE WHEN l_quantity < 5 THEN 'minimum' WHEN l_quantity > 45 THEN 'maximum' END WHEN 'N' THEN CASE WHEN l_quantity <= 10 THEN 'exclusive_minimum' WHEN l_quantity >= 50 THEN 'exclusive_maximum' END WHEN 'R' THEN CASE WHEN l_quantity > 30 THEN 'maximum' END END AS rule FROM lineitem) WHERE rule IS NOT NULL"),
    "monotonic_coordinate": (monotonic_coordinate, f"SELECT l_orderkey, count(*) AS n_breaks FROM (SELECT l_orderkey, l_shipdate, lag(l_shipdate) OVER (PARTITION BY l_orderkey ORDER BY {ORDER_LINE}) AS p FROM lineitem) WHERE p >= l_shipdate GROUP BY 1"),
    "trend_after_sort": (trend_after_sort, f"SELECT l_orderkey, count(*) AS n_breaks FROM (SELECT l_orderkey, l_extendedprice, lag(l_extendedprice) OVER (PARTITION BY l_orderkey ORDER BY l_quantity, {ORDER_LINE}) AS p FROM lineitem) WHERE p > l_extendedprice GROUP BY 1"),
    "hierarchy_closure": (hierarchy_closure, SQL_CLOSURE),
    "edge_degrees": (edge_degrees, "WITH e AS (SELECT n_name AS src, r_name AS dst FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey), x AS (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) SELECT node, sum(o)::BIGINT AS n_out, sum(i)::BIGINT AS n_in FROM x GROUP BY 1"),
    "inverse_edge_missing": (inverse_edge_missing, "SELECT n_name AS src, 'referenced_at' AS relation, 'R' || n_regionkey AS dst FROM nation WHERE n_nationkey % 4 = 0"),
    "unit_normalise": (unit_normalise, f"WITH {SQL_UNIT} SELECT * FROM r"),
    "unit_issue_summary": (unit_issue_summary, f"WITH {SQL_UNIT} SELECT coalesce(code, 'OK') AS code, count(*) AS n, round(sum(value), 3) AS total FROM r GROUP BY 1"),
    "confidence_bands": (confidence_bands, "SELECT CASE WHEN c < 0.8 THEN 'review' WHEN c < 0.95 THEN 'warning' ELSE 'auto' END AS band, count(*) AS n FROM (SELECT coalesce(round((0.7 + 0.25 * quality - 0.1 * toxic)::DOUBLE, 6), 0.5) AS c FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY 1"),
    "review_gate": (review_gate, "SELECT doc_id, count(c) AS n_matches, CASE WHEN count(c) = 0 OR bool_or(c < 0.8) THEN 'review_required' ELSE 'ready' END AS status FROM (SELECT doc_id, round((0.7 + 0.25 * quality - 0.1 * toxic)::DOUBLE, 6) AS c FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY 1"),
    "level_short_circuit": (level_short_circuit, f"WITH {SQL_ISSUES} SELECT case_id, layer, severity, code, path FROM o QUALIFY level <= coalesce(min(CASE WHEN severity = 'error' THEN level END) OVER (PARTITION BY case_id), 4)"),
    "issue_order": (issue_order, f"WITH {SQL_ISSUES} SELECT case_id, CAST(row_number() OVER (PARTITION BY case_id ORDER BY CASE severity WHEN 'error' THEN 0 ELSE 1 END, level, code, path) AS INTEGER) AS ordinal, severity, layer, code, path FROM o"),
    "trace_summary": (trace_summary, "SELECT conv_id AS case_id, count(*) AS n_calls, count_if(role = 'assistant')::BIGINT AS n_success, count_if(turn > 0)::BIGINT AS n_retries, sum(CASE WHEN role = 'user' THEN length(text) ELSE 0 END)::BIGINT AS input_tokens, sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS output_tokens, round(sum(length(text) / 100.0::DOUBLE), 3) AS seconds FROM conversations GROUP BY 1"),
    "retry_lineage": (retry_lineage, "SELECT conv_id, turn, role, lag(turn) OVER w AS retry_of, CAST(row_number() OVER w AS INTEGER) AS attempt FROM conversations WINDOW w AS (PARTITION BY conv_id, role ORDER BY turn)"),
    "structural_diff": (structural_diff, SQL_DIFF),
    "tolerant_compare": (tolerant_compare, "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem WHERE l_linenumber = 3"),
    "spatial_overlap_anti": (spatial_overlap_anti, SQL_SPATIAL),
    "point_in_region_mean": (point_in_region_mean, SQL_POINT),
    "asof_preceding": (asof_preceding, "SELECT event_id, user_id, last_view FROM (SELECT *, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_view FROM events) WHERE event_type = 'purchase'"),
    "section_carry_forward": (section_carry_forward, "SELECT event_id, user_id, last_value(CASE WHEN event_type = 'signup' THEN 's' || event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM events"),
    "metadata_attach": (metadata_attach, "WITH r AS (SELECT *, coalesce(sum((event_type IN ('purchase', 'signup'))::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM events) SELECT max(CASE WHEN event_type = 'purchase' THEN event_id END) AS event_id, user_id, count_if(event_type = 'error')::BIGINT AS n_errors FROM r GROUP BY user_id, run HAVING max(CASE WHEN event_type = 'purchase' THEN event_id END) IS NOT NULL"),
    "inventory_counts": (inventory_counts, "SELECT lower(p_name) AS alias, count(DISTINCT p_brand) AS n_owners, arg_min(p_name, p_partkey) AS display FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1"),
}
