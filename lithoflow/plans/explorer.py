"""Queries on read-back INCLUDE texts, vocabulary exploration, review lists and outcomes of calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import deck, graph, render, retrieve
from ..sources import sinks
from .common import table


def _deck(spark, sf_dir, changed: bool = False):
    """An order as an INCLUDE text; changed: another customer, steps left out, a step more."""
    o = table(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    if changed:
        cust = F.when(key % 5 == 0, cust + 1).otherwise(cust)
    steps = F.concat(F.lit("TSTEP\n  "), key, F.lit(" 2*30.0"), F.when((key % 11 == 0) & F.lit(changed), " 7").otherwise(""), F.lit(" /\n"))
    steps = F.when((key % 7 == 0) & F.lit(changed), "").otherwise(steps)
    text = F.concat(F.lit("-- made\n\n-- PROPS\nSWOF\n  0.1 "), key, F.lit(" 2*\n  0.2 5 6 7\n/\n\nWCONPROD\n  'W"), key, F.lit("' OPEN LRAT 3* "), cust, F.lit(" 1* 200 /\n/\n"), steps)
    return o.select(key.cast("string").alias("case_id"), text.alias("text"))


def include_parse(spark, sf_dir):
    """The values of every order's INCLUDE text."""
    return deck.parse_include(_deck(spark, sf_dir))


SQL_PARSE = """
WITH o AS (SELECT o_orderkey::VARCHAR AS k, o_custkey::VARCHAR AS c FROM orders)
SELECT k AS case_id, 'props' AS section, 'SWOF' AS keyword, CAST((i - 1) // 4 AS INTEGER) AS row, CAST((i - 1) % 4 AS INTEGER) AS col, NULL::VARCHAR AS field, v AS value, TRY_CAST(v AS DOUBLE) AS number
FROM (SELECT k, unnest(['0.1', k, NULL, NULL, '0.2', '5', '6', '7']) AS v, unnest(range(1, 9)) AS i FROM o)
UNION ALL SELECT k, 'schedule', 'WCONPROD', 0, i::INTEGER, f, v, TRY_CAST(v AS DOUBLE) FROM (SELECT k, unnest(['W' || k, 'OPEN', 'LRAT', c, '200']) AS v, unnest([0, 1, 2, 6, 8]) AS i, unnest(['well', 'status', 'control_mode', 'liquid_rate', 'bhp']) AS f FROM o)
UNION ALL SELECT k, 'schedule', 'TSTEP', 0, CAST(i - 1 AS INTEGER), NULL, v, v::DOUBLE FROM (SELECT k, unnest([k, '30.0', '30.0']) AS v, unnest(range(1, 4)) AS i FROM o)
"""


def include_compare(spark, sf_dir):
    """Values that differ between two INCLUDE texts of an order."""
    return deck.compare_includes(deck.parse_include(_deck(spark, sf_dir)), deck.parse_include(_deck(spark, sf_dir, changed=True)))


SQL_COMPARE = """
SELECT o_orderkey::VARCHAR AS case_id, '$.WCONPROD[0].liquid_rate' AS path, o_custkey::VARCHAR AS golden, (o_custkey + 1)::VARCHAR AS generated FROM orders WHERE o_orderkey % 5 = 0
UNION ALL SELECT o_orderkey::VARCHAR, '$.TSTEP', '3', NULL FROM orders WHERE o_orderkey % 7 = 0
UNION ALL SELECT o_orderkey::VARCHAR, '$.TSTEP', '3', '4' FROM orders WHERE o_orderkey % 11 = 0 AND o_orderkey % 7 <> 0
"""


def concept_neighbourhood(spark, sf_dir):
    """Edges that show when a nation is in focus, in the scope of customers."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    part_of = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("src"), F.lit("part_of").alias("relation"), F.col("r_name").alias("dst"), F.lit(None).cast("string").alias("scope"))
    at = lambda name, key, own, scope: table(spark, sf_dir, name).join(nation, F.col(key) == F.col("n_nationkey")).select(F.col(own), F.lit("located_in"), "n_name", F.lit(scope))
    edges = part_of.union(at("customer", "c_nationkey", "c_name", "customers")).union(at("supplier", "s_nationkey", "s_name", "suppliers"))
    return graph.visible_edges(edges, graph.neighbourhood(edges, "NATION_6"), ["part_of", "located_in"], "customers").select("src", "relation", "dst", "scope")


SQL_NEIGHBOURS = """
SELECT n_name AS src, 'part_of' AS relation, r_name AS dst, NULL::VARCHAR AS scope FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name = 'NATION_6'
UNION ALL SELECT c_name, 'located_in', n_name, 'customers' FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_6'
"""


def concept_search(spark, sf_dir):
    """The first eight parts whose name, brand or type holds the query (a top-k report)."""
    return graph.search(table(spark, sf_dir, "part"), " Bolt ", ["p_name", "p_brand", "p_type"], "p_partkey", 8).select("p_partkey", "p_name", "p_type")


def low_confidence_flags(spark, sf_dir):
    """Events with a flag made of their type."""
    shape = F.element_at(F.array(*map(F.lit, ["LOW_", "ocr_low_", "BELOW_", " low_text_"])), (F.col("event_id") % 4 + 1).cast("int"))
    end = F.when(F.col("user_id") % 3 == 0, "_CONFIDENCE_X").when(F.col("user_id") % 3 == 1, "_confidence ").otherwise("_CONFIDENCE")
    flags = F.when(F.col("event_id") % 9 == 0, F.lit(None)).otherwise(F.array(F.lit("OTHER"), F.concat(shape, "event_type", end), F.lit(None)))
    return table(spark, sf_dir, "events").select("event_id", retrieve.low_confidence_flag(flags).alias("low"))


def review_lists(spark, sf_dir):
    """Documents as mappings; those without a label are unresolved."""
    docs = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rows = docs.select("doc_id", F.when(F.col("quality").isNotNull(), "MAPPED").when(F.col("doc_id") % 2 == 0, "UNMAPPED").alias("status"), F.round(0.99 - 0.1 * F.col("toxic") - 0.3 * (1 - F.col("quality")), 6).alias("confidence"))
    return retrieve.review_list(rows).select("doc_id", "list")


def nonwell_cases(spark, sf_dir):
    """Lines as quantities of their order."""
    line = F.col("l_linenumber")
    names = F.array(*map(F.lit, ["wells[W1].type", "wells[W2].controls[c].value", "rock.compressibility", "fluids.oil.density", "schedule.duration", "fluids.steam.density", "rock.other"]))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.element_at(names, line.cast("int")).alias("path"), F.when(F.col("l_returnflag") == "N", F.col("l_quantity").cast("double")).alias("value"), F.lit(None).cast("string").alias("text"))
    return render.nonwell_data(rows)


def trace_outcomes(spark, sf_dir):
    """Turns as calls; conversations with an id divisible by 3 failed their contract, which their last turn tells."""
    calls = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lit("success").alias("outcome"), F.lit(None).cast("string").alias("error_code"))
    failed = calls.select("conv_id").distinct().filter("conv_id % 3 = 0").withColumns({"outcome": F.lit("contract_invalid"), "error_code": F.lit("CONTRACT_FAILED")})
    return sinks.mark_latest(calls, failed, ["conv_id"], "turn")


QUERIES = {
    "include_parse": (include_parse, SQL_PARSE),
    "include_compare": (include_compare, SQL_COMPARE),
    "concept_neighbourhood": (concept_neighbourhood, SQL_NEIGHBOURS),
    "concept_search": (concept_search, "SELECT p_partkey, p_name, p_type FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'bolt') ORDER BY p_partkey LIMIT 8"),
    "low_confidence_flags": (low_confidence_flags, "SELECT event_id, event_id % 9 <> 0 AND event_id % 4 IN (0, 1, 3) AND user_id % 3 <> 0 AS low FROM events"),
    "review_lists": (review_lists, "SELECT doc_id, CASE WHEN c IS NULL THEN 'unresolved' WHEN c < 0.8 THEN 'low_confidence' ELSE 'warning' END AS list FROM (SELECT doc_id, round((0.99 - 0.1 * toxic - 0.3 * (1 - quality))::DOUBLE, 6) AS c FROM documents LEFT JOIN labels USING (doc_id)) WHERE c IS NULL OR c < 0.95"),
    "nonwell_cases": (nonwell_cases, "SELECT l_orderkey AS case_id, bool_or(l_linenumber IN (3, 4, 5) AND l_returnflag = 'N') AS nonwell FROM lineitem GROUP BY 1"),
    "trace_outcomes": (trace_outcomes, "SELECT conv_id, turn, CASE WHEN l THEN 'contract_invalid' ELSE 'success' END AS outcome, CASE WHEN l THEN 'CONTRACT_FAILED' END AS error_code FROM (SELECT conv_id, turn, conv_id % 3 = 0 AND turn = max(turn) OVER (PARTITION BY conv_id) AS l FROM conversations)"),
}
