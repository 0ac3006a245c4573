"""Queries on sources, drafts, outcomes and validation levels: the lifecycle's operators over orders and their lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import candidates, canonical, contracts, graph, outcomes, render, validate
from ..sources import blocks
from .common import sql_contains, sql_normal, table, values

LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


# sources
def json_blocks(spark, sf_dir):
    """An event's properties nested in a document: an object, an array of like objects, a scalar and a bare list."""
    props = F.col("props")
    raw = _text('{"meta": ', props, ', "rows": [', props, ", ", props, '], "odd name": ', F.col("user_id").cast("string"), ', "bare": [1, 2]}')
    raw = F.when(F.col("event_id") % 10 == 0, F.lit('{"broken": ')).otherwise(raw)
    found = blocks.blocks_of(table(spark, sf_dir, "events").select(F.concat(F.lit("e"), "event_id").alias("source_id"), F.lit("a.json").alias("file_name"), raw.cast("binary").alias("content")))
    cells = F.array_join(F.transform("rows", lambda r: F.array_join(r, ",", "null")), ";")
    return found.select("source_id", "block_id", "block_type", F.array_join("columns", ",").alias("columns"), cells.alias("cells"), "key", "value", "source_location", "code")


SQL_JSON = """
WITH e AS (SELECT 'e' || event_id AS source_id, event_id % 10 = 0 AS bad, user_id, json_keys(props)[1] AS k, json_extract_string(props, '$.' || json_keys(props)[1]) AS v FROM events),
b AS (SELECT source_id, unnest([1, 2, 3, 4]) AS n, k, v, user_id FROM e WHERE NOT bad)
SELECT source_id, 'block_000' || n AS block_id, CASE WHEN n <= 2 THEN 'table' ELSE 'key_value' END AS block_type, CASE WHEN n <= 2 THEN k END AS columns, CASE n WHEN 1 THEN v WHEN 2 THEN v || ';' || v END AS cells,
  CASE n WHEN 3 THEN 'odd name' WHEN 4 THEN 'bare' END AS key, CASE n WHEN 3 THEN user_id::VARCHAR WHEN 4 THEN '[1, 2]' END AS value, ['$.meta', '$.rows', '$["odd name"]', '$.bare'][n] AS source_location, NULL::VARCHAR AS code FROM b
UNION ALL SELECT source_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'MALFORMED_JSON' FROM e WHERE bad
"""


def csv_blocks(spark, sf_dir):
    """An order as a CSV file: some have a record too wide, some a header alone, some another name or no id."""
    key = F.col("o_orderkey")
    body = _text("id,status\n", key.cast("string"), ',"', F.col("o_orderstatus"), '"\n', key.cast("string"), F.when(key % 7 == 0, ",x,extra\n").otherwise(",\n"))
    raw = F.when(key % 5 == 0, F.lit("id,status\n")).otherwise(body)
    rows = table(spark, sf_dir, "orders").select(F.when(key % 13 == 0, F.concat(F.lit(" "))).otherwise(F.concat(F.lit("o"), key)).alias("source_id"), F.when(key % 11 == 0, "a.doc").otherwise("A.CSV").alias("file_name"), raw.cast("binary").alias("content"), key.alias("o_orderkey"))
    found = blocks.blocks_of(rows.withColumn("file_name", F.concat_ws("_", "o_orderkey", "file_name")))
    cells = F.array_join(F.transform("rows", lambda r: F.array_join(r, ",")), ";")
    return found.select(F.substring_index("file_name", "_", 1).cast("long").alias("o_orderkey"), F.array_join("columns", ",").alias("columns"), cells.alias("cells"), "source_location", "code")


SQL_CSV = """
WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS s, CASE WHEN o_orderkey % 13 = 0 THEN 'INVALID_SOURCE_ID' WHEN o_orderkey % 11 = 0 THEN 'UNSUPPORTED_SOURCE_TYPE' WHEN o_orderkey % 5 <> 0 AND o_orderkey % 7 = 0 THEN 'INCONSISTENT_TABLE_WIDTH' END AS code FROM orders)
SELECT k AS o_orderkey, CASE WHEN code IS NULL THEN 'id,status' END AS columns, CASE WHEN code IS NULL THEN k || ',' || s || ';' || k || ',' END AS cells, CASE WHEN code IS NULL THEN 'rows 1-2' END AS source_location, code FROM o WHERE code IS NOT NULL OR k % 5 <> 0
"""


def inline_sources(spark, sf_dir):
    """Sources given as text or base64; names with a path, texts that are no base64."""
    key = F.col("o_orderkey")
    name = F.when(key % 7 == 0, _text("../", key.cast("string"))).when(key % 3 == 0, F.lit(None)).otherwise(_text(key.cast("string"), ".csv"))
    rows = table(spark, sf_dir, "orders").select(key.cast("string").alias("source_id"), name.alias("file_name"), F.when(key % 2 == 0, F.col("o_orderpriority")).alias("text"), F.when(key % 5 == 0, F.lit("no base64!")).otherwise(F.base64(F.col("o_orderpriority").cast("binary"))).alias("base64"))
    return blocks.inline_sources(rows).select("source_id", "file_name", F.col("content").cast("string").alias("content"), "code")


SQL_INLINE = """
WITH o AS (SELECT o_orderkey AS k, o_orderpriority AS p, CASE WHEN o_orderkey % 7 = 0 THEN '../' || o_orderkey WHEN o_orderkey % 3 = 0 THEN 'source.txt' ELSE o_orderkey || '.csv' END AS n FROM orders),
c AS (SELECT *, CASE WHEN k % 7 = 0 THEN 'INVALID_FILE_NAME' WHEN k % 2 <> 0 AND k % 5 = 0 THEN 'INVALID_BASE64_SOURCE' END AS code FROM o)
SELECT k::VARCHAR AS source_id, n AS file_name, CASE WHEN code IS NULL THEN p END AS content, code FROM c
"""


def duplicate_block_ids(spark, sf_dir):
    """Lines of an order that share a number."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source_id"), blocks.block_id(F.col("l_linenumber")).alias("block_id"))
    return blocks.duplicate_blocks(rows)


# matching
PROFILES = [
    {"activation_terms": ["the"], "requires_pressure_unit": True, "entries": [{"source_term": "license", "concept_id": "rights"}, {"source_term": "Released under the MIT License", "concept_id": "rights.mit", "context": {"scope": "rights"}}]},
    {"activation_terms": ["die", "und"], "requires_pressure_unit": False, "entries": [{"source_term": "nicht", "concept_id": "lang.german"}, {"source_term": "der", "concept_id": "lang.german.article"}]},
]


def _lines(spark, sf_dir):
    """Lines of documents as blocks."""
    cut = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "text"))
    return cut.select(F.col("doc_id").alias("case_id"), F.col("i").alias("block_id"), "text")


def profile_matches(spark, sf_dir):
    """Source terms of the profiles that a line activates."""
    return candidates.profile_matches(_lines(spark, sf_dir), PROFILES).select("case_id", "block_id", "concept_id", "scope", "score", "term")


def _sql_profiles() -> str:
    parts = []
    for p in PROFILES:
        active = " AND ".join(sql_contains("t", "'" + a + "'") for a in p["activation_terms"])
        for e in p["entries"]:
            term = e["source_term"].lower()
            scope = (e.get("context") or {}).get("scope")
            parts.append(f"SELECT doc_id AS case_id, i AS block_id, '{e['concept_id']}' AS concept_id, {'NULL::VARCHAR' if scope is None else repr(scope)} AS scope, CASE WHEN replace(t, ' ', '') = '{term.replace(' ', '')}' THEN 0.99 ELSE 0.98 END::DOUBLE AS score, '{e['source_term']}' AS term FROM q WHERE {active} AND (replace(t, ' ', '') = '{term.replace(' ', '')}' OR {sql_contains('t', repr(term))})")
    return SQL_LINES + " UNION ALL ".join(parts)


SQL_LINES = f"WITH q AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS i, line, {sql_normal('line')} AS t FROM (SELECT doc_id, parts[i] AS line, i FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)))) "


def pressure_unit_gate(spark, sf_dir):
    """P10: lines of a profile that needs a pressure unit and that state none."""
    rows = _lines(spark, sf_dir).withColumn("text", F.when(F.col("block_id") % 3 == 0, _text(F.col("text"), " at 12 bar")).otherwise(F.col("text")))
    return candidates.missing_pressure_unit(rows, PROFILES)


SQL_PRESSURE = SQL_LINES + f"SELECT doc_id AS case_id, i AS block_id FROM q WHERE i % 3 <> 0 AND {sql_contains('t', repr('the'))} AND NOT regexp_matches(line, '(?i)(^|[^A-Za-z])(bar|barsa|psi|psia|kPa|MPa|Pa)($|[^A-Za-z])') AND NOT regexp_matches(line, '(?i)^\\s*(METRIC|FIELD)\\s*(--.*)?$')"


def metadata_kinds(spark, sf_dir):
    """Parts as key-value blocks and as texts of whole lines."""
    key = F.col("p_partkey")
    kind = F.when(key % 3 == 0, "key_value").otherwise("text")
    name = F.element_at(F.array(*map(F.lit, ["Sample ID", "asset", "saturationBasis", "p_size"])), (key % 4 + 1).cast("int"))
    value = F.when(key % 8 < 4, F.lit("Percent")).otherwise(F.col("p_name"))
    text = F.element_at(F.array(F.lit("Heading"), F.lit("Heading\n  well: A1"), F.lit("No data was given."), F.col("p_name"), F.lit("Well: B2\nWELL: b3")), (key % 5 + 1).cast("int"))
    found = table(spark, sf_dir, "part").select("p_partkey", candidates.metadata_kind(kind, name, value, text, "Heading", r"well: \w+", r"No data was given\.").alias("kind"))
    return found


SQL_KINDS = """
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_partkey % 4 < 2 OR (p_partkey % 4 = 2 AND p_partkey % 8 < 4) THEN 'metadata' END
  ELSE CASE p_partkey % 5 WHEN 0 THEN 'heading' WHEN 1 THEN 'metadata' WHEN 2 THEN 'absence_statement' WHEN 4 THEN 'metadata' END END AS kind FROM part
"""


def sibling_metadata(spark, sf_dir):
    """Lines as blocks of one object an order and flag; their metadata is shared among them, but for asset names."""
    line = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("f"), F.min("l_suppkey").alias("s"))
    place = _text("$.", F.col("f"), ".", F.concat(F.lit("b"), "l_linenumber"))
    rows = line.select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("block_id"), place.alias("source_location"), F.when(F.col("s") % 2 == 0, "asset").otherwise("unit").alias("key"), F.col("s").cast("string").alias("value"))
    return candidates.sibling_metadata(rows.filter("block_id % 2 = 0"), rows.filter("block_id % 2 = 1")).select("case_id", "block_id", "from_block", "key", "value")


SQL_SIBLING = """
WITH r AS (SELECT l_orderkey AS o, l_linenumber AS n, min(l_returnflag) AS f, min(l_suppkey) AS s FROM lineitem GROUP BY 1, 2)
SELECT a.o AS case_id, a.n AS block_id, b.n AS from_block, 'unit' AS key, b.s::VARCHAR AS value FROM r a JOIN r b ON a.o = b.o AND a.f = b.f AND a.n % 2 = 0 AND b.n % 2 = 1 AND b.s % 2 <> 0
"""


# outcomes
def block_issue_codes(spark, sf_dir):
    """An order's lines as mapped paths: repeated, without a parent, without a pressure, off target."""
    path = F.element_at(F.array(*map(F.lit, PATHS)), F.col("l_linenumber"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.lit("b").alias("block_id"), F.when((F.col("l_linenumber") == 7) & (F.col("l_orderkey") % 2 == 0), "UNMAPPED").otherwise("MAPPED").alias("status"), path.alias("path"))
    return outcomes.block_issues(rows).select("case_id", "code", "path")


PATHS = ["wells[W].controls[liquid_rate].target", "wells[W].controls[bhp].constraints[maximum_bhp].value", "fluids.oil.pvt.points[0].viscosity", "fluids.oil.pvt", "fluids.oil.pvt.points[0].viscosity", "fluids.oil.pvt.points[0].pressure", "rock.compressibility"]
SQL_BLOCK_ISSUES = f"""
WITH p AS (SELECT * FROM {values([(n, x) for n, x in enumerate(PATHS, 1)])} v(n, path)),
m AS (SELECT l_orderkey AS o, path FROM lineitem JOIN p ON n = l_linenumber WHERE NOT (n = 7 AND l_orderkey % 2 = 0)),
w AS (SELECT l_orderkey AS o, bool_and(NOT (l_linenumber = 7 AND l_orderkey % 2 = 0)) AS whole FROM lineitem GROUP BY 1),
g AS (SELECT o, bool_or(path = '{PATHS[0]}') AS target, bool_or(path = '{PATHS[1]}') AS bound, bool_or(path LIKE '%.points[0].%') AS point, bool_or(path = '{PATHS[3]}') AS model, bool_or(path = '{PATHS[5]}') AS pressure FROM m GROUP BY o)
SELECT o AS case_id, 'DUPLICATE_CANONICAL_PATH' AS code, path FROM m GROUP BY o, path HAVING count(*) > 1
UNION ALL SELECT o, 'REQUIRED_STRUCTURAL_MAPPING_MISSING', 'fluids.oil.pvt' FROM g WHERE point AND NOT model
UNION ALL SELECT o, 'CONSTRAINT_CONTROL_TARGET_MISMATCH', '{PATHS[1]}' FROM g WHERE target AND bound
UNION ALL SELECT g.o, 'PVT_POINT_PRESSURE_MISSING', '{PATHS[5]}' FROM g JOIN w ON g.o = w.o WHERE whole AND point AND NOT pressure
"""
DRAFT = [("rock.compressibility", "1/bar", "float"), ("schedule.duration", "day", "duration"), ("well.producer", None, "enum"), ("well", None, "entity")]


def _drafts(spark, sf_dir):
    """Every line as a draft of one of four concepts; the line's number says what is wrong with it."""
    n, s = F.col("l_linenumber"), (F.col("l_partkey") % 4 + 1).cast("int")
    pick = lambda i: F.element_at(F.array(*[F.lit(d[i]) for d in DRAFT]), s)
    well = F.when(s >= 3, F.create_map(F.lit("well_id"), F.concat(F.lit("W"), "l_orderkey"))).otherwise(F.create_map().cast("map<string,string>"))
    seq = F.concat_ws(".", "l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("case_id"), F.lit("b").alias("block_id"), seq.alias("seq"), F.when(n == 7, "x").otherwise("b").alias("draft_block_id"), F.when(n == 6, "no.concept").otherwise(pick(0)).alias("concept_id"),
        F.lit(None).cast(contracts.CONTEXT_DDL).alias("context"), F.when(n == 5, F.create_map(F.lit("odd"), F.lit("y"))).otherwise(well).alias("selectors"), F.lit(None).cast("string").alias("canonical_path"),
        F.when(n != 4, F.col("l_quantity")).alias("value_num"), F.when(s == 3, "producer").when(s == 4, F.concat(F.lit("W"), "l_orderkey")).alias("value_str"),
        F.when(n == 3, F.lit(None)).otherwise(pick(1)).alias("source_unit"), F.when(n == 2, "psi").otherwise(pick(1)).alias("canonical_unit"), (F.col("l_discount") * 10).alias("confidence"),
    )


def _concepts(spark):
    return spark.createDataFrame([(c, u, t) for c, u, t in DRAFT], "concept_id string, canonical_unit string, value_type string")


def _offered(spark, rows):
    """Candidates of every block: the four concepts in their own contexts; on some orders a context is not supported."""
    known = spark.createDataFrame([(c, x) for c, x, _ in contracts.contracts() if c in [d[0] for d in DRAFT]], f"concept_id string, context {contracts.CONTEXT_DDL}")
    blocks_ = rows.select("case_id", "block_id").distinct()
    wanted = blocks_.withColumn("concept_id", F.explode(F.array(*[F.lit(d[0]) for d in DRAFT])))
    return wanted.join(F.broadcast(known), "concept_id").withColumn("supported", (F.col("case_id") % 9 != 0) | (F.col("concept_id") != "well"))


def materialise_drafts(spark, sf_dir):
    """Drafts to outcomes with the first code that fails."""
    rows = _drafts(spark, sf_dir)
    return outcomes.materialise(rows, _offered(spark, rows), _concepts(spark)).select("case_id", "seq", "status", "concept_id", "path", F.round("confidence", 6).alias("confidence"), "code")


SQL_DRAFTS = f"""
WITH k AS (SELECT * FROM {values([(n, *d) for n, d in enumerate(DRAFT)])} v(s, concept, unit, kind)),
d AS (SELECT l_orderkey AS o, l_linenumber AS n, l_linenumber || '.' || l_partkey || '.' || l_suppkey AS seq, s, concept, unit, kind, l_discount * 10 AS confidence FROM lineitem JOIN k ON l_partkey % 4 = s),
"""
SQL_MATERIALISE = SQL_DRAFTS + """
x AS (SELECT *, s = 3 AND o % 9 = 0 AS weak, CASE WHEN n = 7 THEN 'SOURCE_BLOCK_MISMATCH' WHEN n = 6 THEN 'SEMANTIC_CONTEXT_INVALID' END AS early,
  CASE WHEN n = 5 THEN 'CANONICAL_PATH_OUTSIDE_CONTRACT' WHEN n = 2 THEN 'CANONICAL_UNIT_OUTSIDE_CONTRACT' WHEN n = 4 AND kind IN ('float', 'duration') THEN 'VALUE_OUTSIDE_CONTRACT' WHEN n = 3 AND unit IS NOT NULL THEN 'SOURCE_UNIT_REQUIRED' END AS late FROM d),
c AS (SELECT *, CASE WHEN early IS NOT NULL THEN early WHEN NOT (weak AND n <> 6) THEN late END AS code FROM x),
t AS (SELECT *, CASE WHEN code IS NOT NULL THEN 'ERROR' WHEN weak AND n < 6 THEN 'UNMAPPED' ELSE 'MAPPED' END AS status FROM c)
SELECT o AS case_id, seq, status, CASE WHEN n = 6 THEN 'no.concept' ELSE concept END AS concept_id, CASE WHEN status = 'MAPPED' THEN ['rock.compressibility', 'schedule.duration', 'wells[W' || o || '].well_type', 'wells[W' || o || '].id'][s + 1] END AS path,
  round(CASE WHEN status = 'UNMAPPED' THEN 0 ELSE confidence END, 6) AS confidence, code FROM t
"""


def buildable_candidates(spark, sf_dir):
    """The best candidates with a contract, and the models that their points need."""
    pool = [("physical.viscosity", "pvt", "oil", "property", None), ("physical.pressure", "pvt", "water", "coordinate", None), ("fluid.pvt", "pvt", "oil", "model", None), ("physical.density", "pvt", "oil", "property", None), ("rock.compressibility", "rock", None, "property", None)]
    line = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    fields = [F.element_at(F.array(*[F.lit(x[i]).cast("string") for x in pool]), (F.col("l_linenumber") % 5 + 1).cast("int")) for i in range(5)]
    context = F.struct(*[f.alias(c) for f, c in zip(fields[1:], contracts.CONTEXT, strict=True)]).cast(contracts.CONTEXT_DDL)
    rows = line.filter("l_linenumber <= 5").select(F.col("l_orderkey").alias("case_id"), F.lit("b").alias("block_id"), fields[0].alias("concept_id"), context.alias("context"), F.lit(0.5).alias("score"), F.col("l_linenumber").alias("rank"), (F.col("p") % 2 == 0).alias("supported"))
    return outcomes.buildable(rows, 2).select("case_id", "concept_id", F.col("context.phase").alias("phase"), "score", "rank", "supported")


SQL_BUILDABLE = """
WITH r AS (SELECT l_orderkey AS o, l_linenumber AS n, min(l_partkey) % 2 = 0 AS ok FROM lineitem WHERE l_linenumber <= 5 GROUP BY 1, 2),
x AS (SELECT o, ok, ['physical.viscosity', 'physical.pressure', 'fluid.pvt', 'physical.density', 'rock.compressibility'][n % 5 + 1] AS c, ['oil', 'water', 'oil', 'oil', NULL][n % 5 + 1] AS p, row_number() OVER (PARTITION BY o ORDER BY n) AS rank FROM r WHERE n <> 3),
k AS (SELECT * FROM x WHERE rank <= 2), parent AS (SELECT o, p, bool_or(ok) AS ok FROM k WHERE c IN ('physical.viscosity', 'physical.pressure') GROUP BY 1, 2)
SELECT k.o AS case_id, c AS concept_id, k.p AS phase, 0.5::DOUBLE AS score, CAST(rank AS INTEGER) AS rank, k.ok OR (c = 'fluid.pvt' AND coalesce(parent.ok, false)) AS supported FROM k LEFT JOIN parent ON parent.o = k.o AND parent.p = k.p
UNION ALL SELECT parent.o, 'fluid.pvt', parent.p, 0.9, NULL, parent.ok FROM parent WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.o = parent.o AND k.c = 'fluid.pvt' AND k.p = parent.p)
"""


def automatic_unmapped(spark, sf_dir):
    """Orders none of whose lines is a candidate."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.lit("b").alias("block_id"), F.col("o_orderstatus").alias("key"))
    found = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("case_id"), F.lit("b").alias("block_id"))
    return outcomes.automatic_unmapped(rows, found).select("case_id", "status", "confidence", "source_field")


WELLS = ["wells[W].well_type", "wells[W].controls[liquid_rate].target", "wells[W].controls[gas_rate].target", "wells[V].well_type", "wells[V].controls[liquid_rate].target", "wells[V].id", "rock.compressibility"]
TYPES = ["well.producer", "well.control.liquid_rate", "well.control.gas_rate", "well.water_injector", "well.control.liquid_rate", "well", "rock.compressibility"]


def well_type_relations(spark, sf_dir):
    """Controls of wells that apply to no type of theirs, nor to a type above it."""
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), F.col("l_linenumber"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), "l_linenumber").distinct()
    rows = rows.select("case_id", pick(WELLS).alias("path"), pick(TYPES).alias("concept_id"))
    concepts = spark.createDataFrame([("well", None), ("well.producer", "well"), ("well.oil_producer", "well.producer"), ("well.water_injector", "well"), ("well.control.liquid_rate", None), ("well.control.gas_rate", None)], "concept_id string, parent string")
    edges = spark.createDataFrame([("well.control.liquid_rate", "applies_to", "well.producer"), ("well.control.gas_rate", "applies_to", "well")], "src string, relation string, dst string")
    return validate.unrelated(rows, concepts, edges)


def table_identities(spark, sf_dir):
    """An order's suppliers as sample ids: one is the id, several conflict."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.concat(F.lit("block "), "l_orderkey").alias("block_id"), F.concat(F.when(F.col("l_suppkey") % 2 == 0, "S ").otherwise("S"), F.col("l_suppkey") % 3).alias("sample"))
    return outcomes.table_identity(rows).select("case_id", "sample_id", "technical_id", "conflicting")


SQL_IDENTITY = """
WITH s AS (SELECT DISTINCT l_orderkey AS o, CASE WHEN l_suppkey % 2 = 0 THEN 'S ' ELSE 'S' END || l_suppkey % 3 AS s FROM lineitem), g AS (SELECT o, count(*) AS n, min(s) AS one, string_agg(s, ',' ORDER BY s) AS every FROM s GROUP BY o)
SELECT o AS case_id, CASE WHEN n = 1 THEN one END AS sample_id, CASE WHEN n = 1 AND NOT contains(one, ' ') THEN one ELSE 'block_' || o END AS technical_id, CASE WHEN n > 1 THEN every END AS conflicting FROM g
"""


def consumed_metadata(spark, sf_dir):
    """Units that a mapped control of the same record proves."""
    line = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").groupBy("l_orderkey").agg(F.min("l_quantity").alias("q"), F.min("l_returnflag").alias("f"), F.min("l_discount").alias("d"))
    rows = line.select(F.col("l_orderkey").alias("case_id"), F.lit("b").alias("block_id"), F.lit(1).alias("seq"), F.lit("Unit").alias("source_field"), "q", "f", "d")
    record = rows.select("case_id", "block_id", F.create_map(F.lit("wellid"), F.lit("W"), F.lit("unit"), F.lit("m3/day"), F.lit("target"), F.col("q").cast("string")).alias("fields"))
    facts = rows.select("case_id", "block_id", F.lit("W").alias("well_id"), F.lit("well.control.liquid_rate").alias("concept_id"), F.when(F.col("case_id") % 3 == 0, F.col("q") + 1).otherwise(F.col("q")).alias("value_num"), F.when(F.col("f") == "A", "bbl/day").otherwise("m3/day").alias("source_unit"), (1 - F.col("d") * 4).alias("confidence"))
    return outcomes.consumed(rows.select("case_id", "block_id", "seq", "source_field"), facts, record).select("case_id", "source_field", "value")


def compatible_bindings(spark, sf_dir):
    """Parts as bindings of a scope with a phase or a phase system, against a few others."""
    pick = lambda xs, n: F.element_at(F.array(*[F.lit(x).cast("string") for x in xs]), (F.expr(n) + 1).cast("int"))
    a = table(spark, sf_dir, "part").select("p_partkey", pick(["pvt", "rock"], "p_partkey % 2").alias("scope"), pick([None, "oil", "gas"], "p_partkey % 3").alias("phase"), pick([None, None, None, "oil_water"], "p_partkey % 4").alias("phase_system"))
    b = spark.createDataFrame([(1, "pvt", "oil", None), (2, "pvt", None, "oil_water"), (3, "rock", None, None), (4, "rock", "gas", "gas_oil")], "n int, scope string, phase string, phase_system string")
    return graph.compatible(a, b).select("p_partkey", "n")


SQL_COMPATIBLE = """
WITH a AS (SELECT p_partkey, ['pvt', 'rock'][p_partkey % 2 + 1] AS scope, [NULL, 'oil', 'gas'][p_partkey % 3 + 1] AS phase, CASE WHEN p_partkey % 4 = 3 THEN 'oil_water' END AS system FROM part),
b AS (SELECT * FROM (VALUES (1, 'pvt', 'oil', NULL), (2, 'pvt', NULL, 'oil_water'), (3, 'rock', NULL, NULL), (4, 'rock', 'gas', 'gas_oil')) v(n, scope, phase, system))
SELECT p_partkey, n FROM a JOIN b ON a.scope = b.scope AND CASE WHEN a.system IS NOT NULL AND b.system IS NOT NULL THEN a.system = b.system ELSE a.phase IS NULL OR b.phase IS NULL OR a.phase = b.phase END
"""


# canonical form, levels, rendering
def canonical_build_issues(spark, sf_dir):
    """Drafts to quantities: the code of each draft that fails, and of paths that conflict."""
    rows = _drafts(spark, sf_dir).drop("draft_block_id", "block_id")
    concepts = _concepts(spark)
    bound = spark.createDataFrame([(c, *x) for c, x, _ in contracts.contracts()], "concept_id string, scope string, phase string, role string, phase_system string")
    good, issues = canonical.build(rows, concepts, bound)
    return good.select("case_id", "path", F.lit("OK").alias("code")).union(issues.select("case_id", "path", "code")).groupBy("case_id", "code").agg(F.count(F.lit(1)).alias("n"))


SQL_BUILD = SQL_DRAFTS + """
c AS (SELECT *, ['rock.compressibility', 'schedule.duration', 'wells[W' || o || '].well_type', 'wells[W' || o || '].id'][s + 1] AS path, CASE WHEN n = 6 THEN 'UNKNOWN_ONTOLOGY_CONCEPT' WHEN n = 5 THEN 'INVALID_CANONICAL_SELECTORS'
  WHEN n = 3 AND unit IS NOT NULL THEN 'SOURCE_UNIT_REQUIRED' WHEN n = 2 AND unit IS NOT NULL THEN 'CANONICAL_UNIT_MISMATCH' WHEN unit IS NOT NULL AND n = 4 THEN 'INVALID_MAGNITUDE' WHEN unit IS NULL AND n = 2 THEN 'UNEXPECTED_UNIT' END AS code FROM d),
q AS (SELECT c.*, l_quantity AS v FROM c JOIN lineitem ON l_orderkey = o AND seq = l_linenumber || '.' || l_partkey || '.' || l_suppkey),
m AS (SELECT o, path, CASE WHEN count(DISTINCT CASE WHEN unit IS NOT NULL THEN v ELSE 0 END) > 1 THEN 'DUPLICATE_CANONICAL_ASSIGNMENT' ELSE 'OK' END AS code FROM q WHERE code IS NULL GROUP BY 1, 2),
i AS (SELECT DISTINCT o, CASE WHEN n IN (5, 6) THEN '$' ELSE path END AS path, code FROM c WHERE code IS NOT NULL)
SELECT o AS case_id, code, count(*) AS n FROM (SELECT o, code FROM m UNION ALL SELECT o, code FROM i) GROUP BY 1, 2
"""


def _quantities(spark, sf_dir):
    """Every order as a case: a table of points, a schedule, and wells named by the line's number."""
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    line = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("l_quantity"), F.min("l_suppkey").alias("s"))
    path = F.when(n <= 4, F.concat(F.lit("fluids.oil.pvt.points["), n - 1, F.lit("].pressure"))).when(n == 5, "schedule.report_interval").when(n == 6, "schedule.duration").otherwise("wells[A].well_type")
    value = F.when((n <= 4) & (F.col("s") % 10 == 0), 7.0).when(n <= 6, q)
    return line.select(F.col("l_orderkey").alias("case_id"), path.alias("path"), F.when(n <= 4, "physical.pressure").when(n == 7, "well.producer").otherwise("schedule.duration").alias("concept_id"), value.alias("value"), F.when(n == 7, F.when(F.col("s") % 2 == 0, "unknown").otherwise("producer")).alias("text"), F.when(n <= 4, F.when(F.col("s") % 3 == 0, "psi").otherwise("bar")).when(n <= 6, "day").alias("unit"))


SQL_QUANTITIES = "WITH q AS (SELECT l_orderkey AS o, l_linenumber AS n, min(l_suppkey) AS s, CASE WHEN l_linenumber <= 4 AND min(l_suppkey) % 10 = 0 THEN 7.0 WHEN l_linenumber <= 6 THEN min(l_quantity) END::DOUBLE AS v FROM lineitem GROUP BY 1, 2), "


def domain_issues(spark, sf_dir):
    """Ranges, repeated and unordered coordinates, the schedule."""
    found = validate.domain_level(_quantities(spark, sf_dir), {"physical.pressure": {"maximum": 40.0}, "schedule.duration": {"exclusive_minimum": 2.0}})
    return found.select("case_id", "severity", "code", "path")


SQL_DOMAIN = SQL_QUANTITIES + """
p AS (SELECT o, n, v, lag(v) OVER (PARTITION BY o ORDER BY n) AS b FROM q WHERE n <= 4), twice AS (SELECT o FROM p GROUP BY o HAVING count(*) <> count(DISTINCT v)),
s AS (SELECT o, max(CASE WHEN n = 5 THEN v END) AS r, max(CASE WHEN n = 6 THEN v END) AS d FROM q GROUP BY o)
SELECT o AS case_id, 'error' AS severity, 'VALUE_OUT_OF_RANGE' AS code, CASE WHEN n <= 4 THEN 'fluids.oil.pvt.points[' || (n - 1) || '].pressure' WHEN n = 5 THEN 'schedule.report_interval' ELSE 'schedule.duration' END AS path FROM q WHERE (n <= 4 AND v > 40) OR (n IN (5, 6) AND v <= 2)
UNION ALL SELECT o, 'error', 'DUPLICATE_COORDINATE', 'fluids.oil.pvt.points' FROM twice
UNION ALL SELECT DISTINCT o, 'warning', 'COORDINATE_ORDER_WARNING', 'fluids.oil.pvt.points' FROM p WHERE b >= v AND o NOT IN (SELECT o FROM twice)
UNION ALL SELECT o, 'warning', 'REPORT_INTERVAL_EXCEEDS_DURATION', 'schedule.report_interval' FROM s WHERE r > d
"""


def schema_issues(spark, sf_dir):
    """C11: paths outside the schema, values that are no number, required paths."""
    found = validate.schema_level(_quantities(spark, sf_dir).withColumn("value", F.when(F.col("value") != 7, F.col("value"))), [r"^fluids\.oil\.pvt\.points\[\d+\]\.pressure$", r"^schedule\.duration$", r"^wells\["], ["schedule.duration"])
    return found.select("case_id", "code", "path")


SQL_SCHEMA = SQL_QUANTITIES + """
p AS (SELECT *, CASE WHEN n <= 4 THEN 'fluids.oil.pvt.points[' || (n - 1) || '].pressure' WHEN n = 5 THEN 'schedule.report_interval' WHEN n = 6 THEN 'schedule.duration' ELSE 'wells[A].well_type' END AS path FROM q)
SELECT o AS case_id, 'UNKNOWN_FIELD' AS code, path FROM p WHERE n = 5 UNION ALL SELECT o, 'SCHEMA_VALIDATION_ERROR', path FROM p WHERE n <= 6 AND v = 7
UNION ALL SELECT o, 'REQUIRED_FIELD_MISSING', 'schedule.duration' FROM p GROUP BY o HAVING NOT bool_or(n = 6)
"""


def ontology_issues(spark, sf_dir):
    """Unknown concepts, units and contexts."""
    concepts = spark.createDataFrame([("physical.pressure", "bar", None), ("schedule.duration", "day", None)], "concept_id string, canonical_unit string, parent string")
    bound = spark.createDataFrame([("physical.pressure", "pvt", "oil", "coordinate", None), ("schedule.duration", "schedule", None, "duration", None)], "concept_id string, scope string, phase string, role string, phase_system string")
    physical = F.col("concept_id") == "physical.pressure"
    rows = _quantities(spark, sf_dir).select("*", F.when(physical, "pvt").otherwise("schedule").alias("scope"), F.when(physical, F.when(F.col("case_id") % 4 == 0, "gas").otherwise("oil")).alias("phase"), F.when(physical, "coordinate").otherwise("duration").alias("role"), F.lit(None).cast("string").alias("phase_system"))
    return validate.ontology_level(rows, concepts, bound).select("case_id", "severity", "code", "path")


SQL_ONTOLOGY = SQL_QUANTITIES + """
p AS (SELECT *, 'fluids.oil.pvt.points[' || (n - 1) || '].pressure' AS path FROM q)
SELECT o AS case_id, 'error' AS severity, 'ONTOLOGY_CONCEPT_MISSING' AS code, 'wells[A].well_type' AS path FROM p WHERE n = 7
UNION ALL SELECT o, 'error', 'ONTOLOGY_CONTEXT_ERROR', path FROM p WHERE n <= 4 AND o % 4 = 0
UNION ALL SELECT o, 'error', 'ONTOLOGY_UNIT_ERROR', path || '.unit' FROM p WHERE n <= 4 AND s % 3 = 0
UNION ALL SELECT o, 'warning', 'ONTOLOGY_CONTEXT_UNRESOLVED', 'wells[A].well_type' FROM p WHERE n = 7 AND s % 2 = 0
"""


def _wells(spark, sf_dir):
    """Wells of an order, one a line: type, control and limit by the line's numbers."""
    line = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("s"), F.min("l_quantity").alias("q"))
    name = F.when(F.col("l_linenumber") == 4, F.concat(F.lit("LONGNAME"), "l_linenumber")).otherwise(F.concat(F.lit("W"), "l_linenumber"))
    kind = F.when(F.col("s") % 3 == 0, "producer").otherwise("water_injector")
    control = F.when(F.col("s") % 2 == 0, "liquid_rate").otherwise("water_injection_rate")
    at = lambda *x: _text("wells[", name, "]", *x)
    entry = lambda path, value, text: F.struct(path.alias("path"), value.cast("double").alias("value"), text.cast("string").alias("text"))
    none = F.lit(None)
    rows = F.array(entry(at(".id"), none, name), entry(at(".well_type"), none, kind), entry(at(".controls[", control, "].target"), F.col("q"), none), entry(at(".controls[", control, "].constraints[minimum_bhp].value"), F.col("q") * 2, none))
    return line.select(F.col("l_orderkey").alias("case_id"), F.explode(F.when(F.col("l_linenumber") == 3, F.slice(rows, 1, 2)).otherwise(rows)).alias("x")).select("case_id", "x.*")


def nested_wells(spark, sf_dir):
    """Wells with controls with limits, in natural order, as JSON."""
    return canonical.nest_wells(_wells(spark, sf_dir)).select("case_id", F.to_json("wells").alias("wells"))


SQL_WELLS = "WITH l AS (SELECT l_orderkey AS o, l_linenumber AS n, min(l_suppkey) AS s, min(l_quantity) AS q FROM lineitem GROUP BY 1, 2), w AS (SELECT *, CASE WHEN n = 4 THEN 'LONGNAME4' ELSE 'W' || n END AS name, CASE WHEN s % 3 = 0 THEN 'producer' ELSE 'water_injector' END AS kind, CASE WHEN s % 2 = 0 THEN 'liquid_rate' ELSE 'water_injection_rate' END AS control FROM l) "
SQL_NESTED = SQL_WELLS + """
SELECT o AS case_id, '[' || string_agg('{"id":"' || name || '","well_type":"' || kind || '","controls":[' || CASE WHEN n = 3 THEN '' ELSE '{"control_type":"' || control || '","target":' || printf('%.1f', q) || ',"constraints":[{"constraint_type":"minimum_bhp","value":' || printf('%.1f', q * 2) || '}]}' END || ']}', ',' ORDER BY lower(name)) || ']' AS wells FROM w GROUP BY o
"""


def control_fragments(spark, sf_dir):
    """The control fragment of an order's wells."""
    return render.render_fragment(render.fragment_records(_wells(spark, sf_dir)), "TEST").select("case_id", F.sha2("text", 256).alias("sha256"), F.length("text").alias("n_chars"))


SQL_FRAGMENTS = SQL_WELLS + """, t AS (SELECT o, name, 0 AS n, '' AS l, '*WELL ''' || name || '''' AS t FROM w UNION ALL SELECT o, name, 1, '', CASE kind WHEN 'producer' THEN '*PRODUCER ''' || name || '''' ELSE '*INJECTOR ''' || name || ''' *WATER' END FROM w
  UNION ALL SELECT o, name, 2, '', '*OPERATE ''' || name || ''' *MAX ' || CASE kind WHEN 'producer' THEN '*STL ' ELSE '*STW ' END || printf('%.12g', q) FROM w WHERE n <> 3 UNION ALL SELECT o, name, 2, 'minimum_bhp', '*OPERATE ''' || name || ''' *MIN *BHP ' || printf('%.12g', q * 2) FROM w WHERE n <> 3),
x AS (SELECT o, '** Generated deterministic CMG demo control fragment' || chr(10) || '** Dialect: TEST' || chr(10) || '** Not a standalone dataset; host well/completion context is required.' || chr(10) || string_agg(t, chr(10) ORDER BY name, n, l) || chr(10) AS x FROM t GROUP BY o)
SELECT o AS case_id, sha256(x) AS sha256, CAST(length(x) AS INTEGER) AS n_chars FROM x
"""


def include_texts(spark, sf_dir):
    """The INCLUDE text of an order's wells."""
    return render.render_include(render.include_records(_wells(spark, sf_dir)), "TEST").select("case_id", F.sha2("text", 256).alias("sha256"), F.length("text").alias("n_chars"))


SQL_INCLUDES = SQL_WELLS + """, r AS (SELECT o, name, CASE kind WHEN 'producer' THEN 'WCONPROD' ELSE 'WCONINJE' END AS k, '  ''' || name || '''' || CASE kind WHEN 'producer' THEN ' ''OPEN'' ''LRAT'' 1* 1* 1* ' || printf('%.12g', q) || ' 1* ' || printf('%.12g', q * 2) ELSE ' ''WATER'' ''OPEN'' ''RATE'' ' || printf('%.12g', q) || ' 1* 1*' END || ' /' AS line FROM w WHERE n <> 3),
g AS (SELECT o, k, k || chr(10) || string_agg(line, chr(10) ORDER BY name) || chr(10) || '/' AS t FROM r GROUP BY o, k),
x AS (SELECT o, '-- Generated deterministic demo INCLUDE' || chr(10) || '-- Dialect: TEST' || chr(10) || '-- Requires a compatible host deck; no missing values were guessed.' || chr(10) || chr(10) || '-- SCHEDULE' || chr(10) || string_agg(t, chr(10) ORDER BY k DESC) || chr(10) AS x FROM g GROUP BY o)
SELECT o AS case_id, sha256(x) AS sha256, CAST(length(x) AS INTEGER) AS n_chars FROM x
"""


def include_issues(spark, sf_dir):
    """Export issues of the INCLUDE platform."""
    return validate.include_level(_wells(spark, sf_dir)).select("case_id", "severity", "code", "path")


SQL_INCLUDE_ISSUES = SQL_WELLS + """, e AS (SELECT o, 'ECLIPSE_WELL_NAME_TOO_LONG' AS code, 'wells[' || name || '].id' AS path FROM w WHERE length(name) > 8
  UNION ALL SELECT o, 'ECLIPSE_CONTROL_UNSUPPORTED', 'wells[' || name || '].controls[' || control || ']' FROM w WHERE n <> 3 AND (s % 3 = 0) <> (s % 2 = 0))
SELECT o AS case_id, 'error' AS severity, code, path FROM e UNION ALL SELECT DISTINCT o, 'warning', 'ECLIPSE_HOST_DECK_CONTEXT_REQUIRED', 'wells' FROM w
UNION ALL SELECT o, 'error', 'ECLIPSE_NO_EXPORTABLE_CONTENT', '$' FROM w WHERE o NOT IN (SELECT o FROM e) GROUP BY o HAVING NOT bool_or(n <> 3)
"""


def fragment_issues(spark, sf_dir):
    """Export issues of the fragment platform."""
    rows = _wells(spark, sf_dir).union(table(spark, sf_dir, "orders").filter("o_orderkey % 2 = 0").select("o_orderkey", F.lit("rock.compressibility"), F.lit(1.0), F.lit(None).cast("string")))
    return validate.fragment_level(rows).select("case_id", "severity", "code", "path")


SQL_FRAGMENT = SQL_WELLS + """, c AS (SELECT o_orderkey AS o FROM orders WHERE o_orderkey % 2 = 0 UNION SELECT o FROM w)
SELECT o AS case_id, 'error' AS severity, 'CMG_NO_EXPORTABLE_WELLS' AS code, 'wells' AS path FROM c WHERE o NOT IN (SELECT o FROM w)
UNION ALL SELECT o, 'error', 'CMG_WELL_CONTROL_MISSING', 'wells[' || name || '].controls' FROM w WHERE n = 3
UNION ALL SELECT o, 'error', 'CMG_CONTROL_UNSUPPORTED', 'wells[' || name || '].controls[' || control || ']' FROM w WHERE n <> 3 AND (s % 3 = 0) <> (s % 2 = 0)
UNION ALL SELECT o_orderkey, 'warning', 'CMG_DEMO_NONWELL_DATA_NOT_EXPORTED', '$' FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT o, 'warning', 'CMG_HOST_DATASET_CONTEXT_REQUIRED', 'wells' FROM c
"""
CONVENTION = {
    "root_concepts": ["r0", "r1", "r9"], "value_types": ["number", "table"], "dimensions": {"mass": {"canonical_units": ["kg"]}}, "constraint_keys": ["minimum", "maximum", "minimum_points"],
    "relationships": {"near": {"source_value_types": ["number"], "target_value_types": ["number"], "inverse": "near"}},
}


def vocabulary_checks(spark, sf_dir):
    """Nations as concepts under regions; keys say what is wrong with each."""
    key = F.col("n_nationkey")
    name = F.concat(F.lit("r"), F.col("n_regionkey"), F.lit(".n"), key)
    nation = table(spark, sf_dir, "nation")
    text = lambda x: F.lit(x).cast("string")
    leaf = nation.select(
        name.alias("concept_id"), F.col("n_name").alias("name"), F.when(key % 7 == 6, "gone").otherwise(F.concat(F.lit("r"), F.col("n_regionkey"))).alias("parent"), text("").alias("description"), F.when(key % 5 == 4, "odd").when(key % 3 == 0, "table").otherwise("number").alias("value_type"),
        F.when(key % 4 == 1, "mass").alias("dimension"), F.when(key % 8 == 1, "lb").when(key % 6 == 2, "kg").alias("canonical_unit"), F.when(key % 10 == 3, "deprecated").otherwise("active").alias("status"), text(None).alias("replaced_by"),
    )
    roots = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey")), F.col("r_name"), text(None), text(""), text("number"), text(None), text(None), text("active"), text(None))
    concepts = leaf.union(roots)
    aliases = nation.select(name.alias("concept_id"), F.lit(0).alias("seq"), F.when(key < 4, "Shared Name").otherwise(F.col("n_name")).alias("alias"))
    edges = nation.filter(key < 20).select(name.alias("src"), F.lit("near").alias("relation"), F.when(key % 9 == 8, "nowhere").otherwise(F.concat(F.lit("r"), F.col("n_regionkey"))).alias("dst"), F.lit(0).alias("seq"))
    limits = nation.select(name.alias("concept_id"), F.when(key % 3 == 1, "minimum_points").when(key % 3 == 2, "odd").otherwise("minimum").alias("rule"), F.when(key % 11 != 10, key.cast("double")).alias("bound"))
    return validate.vocabulary_issues({"concepts": concepts, "aliases": aliases, "edges": edges, "constraints": limits}, CONVENTION).select("concept_id", "severity", "code", "path")


SQL_VOCABULARY = """
WITH n AS (SELECT n_nationkey AS k, 'r' || n_regionkey || '.n' || n_nationkey AS c, n_name, n_regionkey AS r, CASE WHEN n_nationkey % 5 = 4 THEN 'odd' WHEN n_nationkey % 3 = 0 THEN 'table' ELSE 'number' END AS t, CASE WHEN n_nationkey % 4 = 1 THEN 'mass' END AS d, CASE WHEN n_nationkey % 8 = 1 THEN 'lb' WHEN n_nationkey % 6 = 2 THEN 'kg' END AS u FROM nation),
a AS (SELECT c, CASE WHEN k < 4 THEN 'Shared Name' ELSE n_name END AS alias FROM n)
SELECT 'r9' AS concept_id, 'error' AS severity, 'ROOT_CONCEPT_MISSING' AS code, 'convention.root_concepts' AS path
UNION ALL SELECT c, 'error', 'UNKNOWN_PARENT', 'parent' FROM n WHERE k % 7 = 6
UNION ALL SELECT c, 'warning', 'CONCEPT_HIERARCHY_MISMATCH', 'parent' FROM n WHERE k % 7 = 6
UNION ALL SELECT 'r' || r_regionkey, 'error', 'UNDECLARED_ROOT_CONCEPT', 'parent' FROM region WHERE r_regionkey > 1
UNION ALL SELECT c, 'error', 'UNKNOWN_VALUE_TYPE', 'value_type' FROM n WHERE t = 'odd'
UNION ALL SELECT c, 'warning', 'DEPRECATED_REPLACEMENT_MISSING', 'replaced_by' FROM n WHERE k % 10 = 3
UNION ALL SELECT c, 'error', 'UNIT_WITHOUT_DIMENSION', 'canonical_unit' FROM n WHERE d IS NULL AND u IS NOT NULL
UNION ALL SELECT c, 'error', 'MISSING_CANONICAL_UNIT', 'canonical_unit' FROM n WHERE d IS NOT NULL AND u IS NULL
UNION ALL SELECT c, 'error', 'INCOMPATIBLE_CANONICAL_UNIT', 'canonical_unit' FROM n WHERE d IS NOT NULL AND u = 'lb'
UNION ALL SELECT c, 'error', 'UNKNOWN_CONSTRAINT', 'constraints.odd' FROM n WHERE k % 3 = 2
UNION ALL SELECT c, 'error', 'POINT_CONSTRAINT_ON_NON_TABLE', 'constraints.minimum_points' FROM n WHERE k % 3 = 1 AND t <> 'table'
UNION ALL SELECT c, 'error', 'INVALID_POINT_CONSTRAINT', 'constraints.minimum_points' FROM n WHERE k % 3 = 1 AND (k % 11 = 10 OR k < 1)
UNION ALL SELECT c, 'error', 'NON_NUMERIC_CONSTRAINT', 'constraints.minimum' FROM n WHERE k % 3 = 0 AND k % 11 = 10
UNION ALL SELECT min(c), 'warning', 'CROSS_CONCEPT_ALIAS_COLLISION', 'aliases.' || arg_min(alias, c) FROM a GROUP BY lower(alias) HAVING count(DISTINCT c) > 1
UNION ALL SELECT c, 'error', 'UNKNOWN_RELATIONSHIP_TARGET', 'relationships.near[0]' FROM n WHERE k < 20 AND k % 9 = 8
UNION ALL SELECT c, 'error', 'INVALID_RELATIONSHIP_SOURCE_TYPE', 'relationships.near' FROM n WHERE k < 20 AND t <> 'number'
UNION ALL SELECT c, 'error', 'INVERSE_RELATIONSHIP_MISSING', 'relationships.near[0]' FROM n WHERE k < 20 AND k % 9 <> 8
"""


# text
def path_grammar(spark, sf_dir):
    """Paths to names and selectors; null names mark what is outside the grammar."""
    path = F.concat_ws(".", "p_brand", F.concat(F.lit("a["), F.col("p_partkey"), F.when(F.col("p_size") % 2 == 0, "]").otherwise("")), F.lit("b_1"))
    found = table(spark, sf_dir, "part").select("p_partkey", F.explode(contracts.path_tokens(F.replace(path, F.lit("#"), F.lit("_")))).alias("t"))
    return found.groupBy("p_partkey").agg(F.count(F.lit(1)).alias("n"), F.count("t.name").alias("n_named"), F.max("t.selector").alias("selector"))


def readable_text(spark, sf_dir):
    """Texts as a log shows them."""
    return table(spark, sf_dir, "documents").select("doc_id", F.length(T.readable(F.col("text"))).alias("n_chars"))


QUERIES = {
    "json_blocks": (json_blocks, SQL_JSON),
    "csv_blocks": (csv_blocks, SQL_CSV),
    "inline_sources": (inline_sources, SQL_INLINE),
    "duplicate_block_ids": (duplicate_block_ids, "SELECT l_orderkey AS source_id, 'block_000' || l_linenumber AS block_id, count(*) AS count FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1"),
    "profile_matches": (profile_matches, _sql_profiles()),
    "pressure_unit_gate": (pressure_unit_gate, SQL_PRESSURE),
    "metadata_kinds": (metadata_kinds, SQL_KINDS),
    "sibling_metadata": (sibling_metadata, SQL_SIBLING),
    "block_issue_codes": (block_issue_codes, SQL_BLOCK_ISSUES),
    "materialise_drafts": (materialise_drafts, SQL_MATERIALISE),
    "buildable_candidates": (buildable_candidates, SQL_BUILDABLE),
    "automatic_unmapped": (automatic_unmapped, "SELECT o_orderkey AS case_id, 'UNMAPPED' AS status, 0.0::DOUBLE AS confidence, o_orderstatus AS source_field FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)"),
    "well_type_relations": (well_type_relations, "WITH l AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS n FROM lineitem) SELECT a.o AS case_id, 'wells[V].controls[liquid_rate].target' AS path FROM l a JOIN l b ON a.o = b.o AND a.n = 5 AND b.n = 4"),
    "table_identities": (table_identities, SQL_IDENTITY),
    "consumed_metadata": (consumed_metadata, "SELECT l_orderkey AS case_id, 'Unit' AS source_field, 'm3/day' AS value FROM (SELECT l_orderkey, min(l_returnflag) AS f, min(l_discount) AS d FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) WHERE l_orderkey % 3 <> 0 AND f <> 'A' AND 1 - d * 4 >= 0.8"),
    "compatible_bindings": (compatible_bindings, SQL_COMPATIBLE),
    "canonical_build_issues": (canonical_build_issues, SQL_BUILD),
    "domain_issues": (domain_issues, SQL_DOMAIN),
    "schema_issues": (schema_issues, SQL_SCHEMA),
    "ontology_issues": (ontology_issues, SQL_ONTOLOGY),
    "nested_wells": (nested_wells, SQL_NESTED),
    "control_fragments": (control_fragments, SQL_FRAGMENTS),
    "include_texts": (include_texts, SQL_INCLUDES),
    "include_issues": (include_issues, SQL_INCLUDE_ISSUES),
    "fragment_issues": (fragment_issues, SQL_FRAGMENT),
    "vocabulary_checks": (vocabulary_checks, SQL_VOCABULARY),
    "path_grammar": (path_grammar, "SELECT p_partkey, 3::BIGINT AS n, CASE WHEN p_size % 2 = 0 THEN 3 ELSE 2 END::BIGINT AS n_named, CASE WHEN p_size % 2 = 0 THEN p_partkey::VARCHAR END AS selector FROM part"),
    "readable_text": (readable_text, "SELECT doc_id, CAST(length(trim(regexp_replace(regexp_replace(text, '[^\\p{L}\\p{N}\\p{P}\\s%°±×÷=<>^]', '', 'g'), '\\s+', ' ', 'g'))) AS INTEGER) AS n_chars FROM documents"),
}
