"""Queries on blocks, normalisation and matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import candidates, joins
from ..operators import retrieve as R
from ..sources import blocks
from .common import ALIASES, SCOPES, sql_contains, sql_normal, sql_plain, table, values

SHORT = 40
SQL_BLOCKS = f"""
lines AS (SELECT doc_id, i, parts[i] AS line FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))),
marked AS (SELECT *, sum(CASE WHEN length(line) < {SHORT} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM lines),
runs AS (SELECT doc_id, island, min(i) AS lo, max(i) AS hi, string_agg(line, chr(10) ORDER BY i) AS text FROM marked WHERE length(line) >= {SHORT} GROUP BY doc_id, island),
blocks AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY island) AS INTEGER) AS block_no, CAST(lo AS INTEGER) AS start_line, CAST(hi AS INTEGER) AS end_line, text FROM runs)
"""
SQL_ALIAS = f"a AS (SELECT * FROM {values([(n, *x) for n, x in enumerate(ALIASES)])} v(seq, concept, term))"
SQL_MATCH = f"""
q AS (SELECT doc_id, {sql_normal("text")} AS t FROM documents),
m AS (SELECT doc_id, seq, concept, term, CASE WHEN replace(t, ' ', '') = replace(term, ' ', '') THEN 1.0 ELSE 0.9 END::DOUBLE AS score FROM q JOIN a ON replace(t, ' ', '') = replace(term, ' ', '') OR {sql_contains("t", "term")})
"""


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.text_paragraphs(table(spark, sf_dir, "documents").select("doc_id", "text"), separator=F.length("line") < SHORT)


def block_paragraphs(spark, sf_dir):
    return paragraphs(spark, sf_dir).select("doc_id", "block_no", blocks.block_id(F.col("block_no")).alias("block_id"), "start_line", "end_line", F.length("text").cast("long").alias("n_chars"))


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, concept, term, score, seq) of every alias in a document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", T.normal(F.col("text")).alias("t"))
    found = docs.select("doc_id", F.explode(R.alias_matches(F.col("t"), ALIASES)).alias("m")).select("doc_id", "m.*")
    order = F.create_map(*[F.lit(x) for n, (c, a) in enumerate(ALIASES) for x in (f"{c}|{a}", n)])
    return found.withColumn("seq", F.element_at(order, F.concat_ws("|", "concept", "term")))


def flagship_gate(spark, sf_dir):
    """Documents to blocks, matched, ranked, banded and gated: one row a document. Blocks without a match stay as rows without a
    concept, so one pass gives both counts."""
    parts = paragraphs(spark, sf_dir).select("doc_id", "block_no", T.normal(F.col("text")).alias("t"))
    found = parts.select("doc_id", "block_no", F.explode_outer(R.alias_matches(F.col("t"), ALIASES)).alias("m")).select("doc_id", "block_no", "m.*")
    best = found.groupBy("doc_id", "block_no", "concept").agg(F.max("score").alias("score"))
    ranked = R.top_k(best, ["doc_id", "block_no"], 3).withColumn("band", F.when(F.col("concept").isNotNull(), R.confidence_band(F.col("score"))))
    top = F.max(F.when(F.col("concept").isNotNull(), F.struct("score", F.expr("-rank").alias("r"), "concept")))
    per_doc = ranked.groupBy("doc_id").agg(F.count_if(F.col("rank") == 1).alias("n_blocks"), F.count("band").alias("n_matches"), F.coalesce(F.bool_or(F.col("band") == "review"), F.lit(False)).alias("r"), top["concept"].alias("best_concept"), F.max("score").alias("best_score"))
    all_docs = table(spark, sf_dir, "documents").select("doc_id").join(per_doc, "doc_id", "left")
    status = F.when((F.coalesce("n_matches", F.lit(0)) == 0) | F.col("r"), "review_required").otherwise("ready")
    return all_docs.select("doc_id", F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"), F.coalesce("n_matches", F.lit(0)).alias("n_matches"), "best_concept", "best_score", status.alias("status"))


SQL_FLAGSHIP = f"""
WITH {SQL_BLOCKS}, {SQL_ALIAS},
q AS (SELECT doc_id, block_no, {sql_normal("text")} AS t FROM blocks),
best AS (SELECT doc_id, block_no, concept, max(CASE WHEN replace(t, ' ', '') = replace(term, ' ', '') THEN 1.0 ELSE 0.9 END)::DOUBLE AS score FROM q JOIN a ON replace(t, ' ', '') = replace(term, ' ', '') OR {sql_contains("t", "term")} GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, block_no ORDER BY score DESC, length(concept) - length(replace(concept, '.', '')) DESC, concept) AS rank FROM best QUALIFY rank <= 3),
per AS (SELECT doc_id, count(*) AS n_matches, bool_or(score < 0.8) AS r, max(score) AS best_score FROM ranked GROUP BY doc_id),
top AS (SELECT doc_id, concept FROM ranked QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, rank, concept DESC) = 1),
nb AS (SELECT doc_id, count(*) AS n_blocks FROM blocks GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_blocks, 0)::BIGINT AS n_blocks, coalesce(n_matches, 0)::BIGINT AS n_matches, concept AS best_concept, best_score,
  CASE WHEN n_matches IS NULL OR r THEN 'review_required' ELSE 'ready' END AS status
FROM documents d LEFT JOIN nb USING (doc_id) LEFT JOIN per USING (doc_id) LEFT JOIN top USING (doc_id)
"""


def json_props_flatten(spark, sf_dir):
    """One row a key of a JSON object."""
    rows = table(spark, sf_dir, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("k", "value"))
    return rows.select("event_id", F.concat(F.lit("$."), "k").alias("json_path"), "value")


def table_rectangularity(spark, sf_dir):
    """Derived CSV lines whose width is not the header's."""
    line = F.concat_ws(",", "o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 7 == 0, F.concat_ws(",", "o_orderstatus", F.lit("extra"))).otherwise(F.col("o_orderstatus")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.size(F.split(line, ",")).cast("long").alias("width"))
    return rows.filter("width <> 3")


def bounding_rectangle(spark, sf_dir):
    """Extent of the non-null cells of a grid."""
    cells = table(spark, sf_dir, "part").select("p_brand", F.col("p_size").alias("r"), (F.col("p_partkey") % 13).alias("c"), F.when(F.col("p_retailprice") > 950, F.col("p_retailprice")).alias("v"))
    return joins.extent(cells, ["p_brand"], "r", "c", "v")


def normalise_terms(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    terms = part.select(F.col("p_name").alias("term")).union(part.select("p_type")).distinct()
    return terms.select("term", T.normal(F.col("term")).alias("n1"), T.plain_normal(F.col("term")).alias("n4"), T.field_key(F.col("term")).alias("n7"))


def normalise_exact(spark, sf_dir):
    """full compatibility normalisation and case folding of part names, with signs that both change."""
    name = F.concat(F.lit("\uff21\u00c4\u00df\u2460 "), F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", T.normal(name, exact=True).alias("n1"), T.unit_key(F.concat(F.lit(" \uff2b"), F.lit("g per M\u00b7s")), exact=True).alias("unit"))


def alias_theta_match(spark, sf_dir):
    return matches(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"), F.count_distinct("concept").alias("n_concepts"), F.max("score").alias("best"))


SOURCE_TERMS = [("the", "lang.english.article"), ("die", "lang.german.article"), ("license", "rights"), ("released under the mit license", "rights.mit")]


def source_term_match(spark, sf_dir):
    """Exact 0.99, contained 0.98."""
    t = F.col("t")
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line")).select("doc_id", "i", T.normal(F.col("line")).alias("t"))
    one = [F.struct(F.lit(a).alias("term"), F.lit(c).alias("concept"), F.when(R.literal_equal(t, a), 0.99).when(R.literal_contains(t, a), 0.98).alias("score")) for a, c in SOURCE_TERMS]
    found = lines.select("doc_id", F.explode(F.filter(F.array(*one), lambda x: x["score"].isNotNull())).alias("m")).select("doc_id", "m.*")
    return found.groupBy("doc_id", "concept").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("n"))


SQL_SOURCE = f"""
WITH s AS (SELECT * FROM {values(SOURCE_TERMS)} v(term, concept)),
l AS (SELECT doc_id, {sql_normal("line")} AS t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)),
m AS (SELECT doc_id, concept, CASE WHEN replace(t, ' ', '') = replace(term, ' ', '') THEN 0.99 ELSE 0.98 END::DOUBLE AS score FROM l JOIN s ON replace(t, ' ', '') = replace(term, ' ', '') OR {sql_contains("t", "term")})
SELECT doc_id, concept, max(score) AS score, count(*) AS n FROM m GROUP BY ALL
"""
CONCEPT_WORDS = [("size", "large small medium"), ("colour", "red blue green"), ("thing", "ring gear bolt widget"), ("kind", "economy standard promo")]


def keyword_overlap_score(spark, sf_dir):
    words = T.keywords(T.normal(F.concat_ws(" ", "p_name", "p_type")))
    rows = table(spark, sf_dir, "part").select("p_partkey", words.alias("q"))
    one = [F.struct(F.lit(c).alias("concept"), R.keyword_score(F.col("q"), F.array(*map(F.lit, w.split()))).alias("score")) for c, w in CONCEPT_WORDS]
    return rows.select("p_partkey", F.explode(F.filter(F.array(*one), lambda x: x["score"].isNotNull())).alias("m")).select("p_partkey", "m.*")


SQL_KEYWORD = f"""
WITH q AS (SELECT p_partkey, list_distinct(list_filter(string_split({sql_normal("p_name || ' ' || p_type")}, ' '), lambda w: length(w) > 1 AND w NOT IN {tuple(T.STOP_WORDS)})) AS q FROM part),
c AS (SELECT concept, string_split(w, ' ') AS w FROM {values(CONCEPT_WORDS)} v(concept, w))
SELECT p_partkey, concept, round(least(0.79, 0.45 + 0.34 * len(list_intersect(q, w)) / greatest(len(q), 1)), 6)::DOUBLE AS score FROM q, c WHERE len(list_intersect(q, w)) > 0
"""


def best_candidate_per_key(spark, sf_dir):
    return R.best_per_key(matches(spark, sf_dir).withColumn("family", F.substring_index("concept", ".", 2)), ["doc_id", "family"]).select("doc_id", "family", "concept", "term", "score")


SQL_BEST = f"""
WITH {SQL_ALIAS}, {SQL_MATCH}
SELECT doc_id, family, concept, term, score FROM (SELECT *, array_to_string(string_split(concept, '.')[1:2], '.') AS family FROM m)
QUALIFY row_number() OVER (PARTITION BY doc_id, family ORDER BY score DESC, seq) = 1
"""


def topk_candidates(spark, sf_dir):
    found = matches(spark, sf_dir).groupBy("doc_id", "concept").agg(F.max("score").alias("score"))
    return R.top_k(found, ["doc_id"], 3).select("doc_id", "rank", "concept", "score")


SQL_TOPK = f"""
WITH {SQL_ALIAS}, {SQL_MATCH}, b AS (SELECT doc_id, concept, max(score) AS score FROM m GROUP BY ALL)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, length(concept) - length(replace(concept, '.', '')) DESC, concept) AS INTEGER) AS rank, concept, score FROM b QUALIFY rank <= 3
"""
PART_ALIASES = [("thing.ring", "ring"), ("thing", "GEAR"), ("thing.ring.small", "Small_Ring"), ("colour.red", "red"), ("thing.widget", "redwidget"), ("colour", "blue")]


def alias_search_ranked(spark, sf_dir):
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    found = R.search_alias(names, "p_name", PART_ALIASES)
    order = Window.partitionBy("p_name").orderBy("rank", F.desc(R.dots(F.col("concept"))), "concept")
    return found.withColumn("position", F.row_number().over(order))


SQL_ALIAS_SEARCH = f"""
WITH a AS (SELECT concept, {sql_plain("alias")} AS k FROM {values(PART_ALIASES)} v(concept, alias)),
t AS (SELECT DISTINCT p_name, {sql_plain("p_name")} AS k FROM part),
m AS (SELECT p_name, concept, min(CASE WHEN t.k = a.k THEN 0 WHEN contains(t.k, a.k) THEN 1 WHEN contains(replace(t.k, ' ', ''), replace(a.k, ' ', '')) THEN 2 END) AS rank FROM t, a GROUP BY ALL HAVING rank IS NOT NULL)
SELECT p_name, concept, CAST(rank AS INTEGER) AS rank, CAST(row_number() OVER (PARTITION BY p_name ORDER BY rank, length(concept) - length(replace(concept, '.', '')) DESC, concept) AS INTEGER) AS position FROM m
"""


#: A small vocabulary over part names and types: (concept, name, description, aliases).
PART_CONCEPTS = [
    ("thing.ring", "Ring", "a round part", ["ring", "Gear Ring"]), ("colour.red", "Red", "hue of a thing", ["red"]), ("size.large", "Large", "size of a part", ["LARGE"]),
    ("kind.promo", "Promo kind", "promo brushed", []), ("kind.standard", "Standard", "polished nickel", ["StandardPolished"]), ("old.blue", "Blue", "blue", ["blue"]),
]


def retrieve_candidates(spark, sf_dir):
    """A vocabulary without scopes: aliases first, else common words, the best three."""
    frame = spark.createDataFrame
    context = "concept_id string, scope string, phase string, role string, phase_system string"
    v = {
        "concepts": frame([(c, n, d, "retired" if c.startswith("old.") else "active") for c, n, d, _ in PART_CONCEPTS], "concept_id string, name string, description string, status string"),
        "aliases": frame([(c, a) for c, _, _, aliases in PART_CONCEPTS for a in aliases], "concept_id string, alias string"),
        "bindings": frame([], context), "binding_aliases": frame([], f"{context}, alias string"), "scopes": frame([], "scope string, phases array<string>"), "scope_aliases": frame([], "scope string, alias string"),
    }
    none = F.array().cast("array<string>")
    rows = table(spark, sf_dir, "part").select(F.lit("c").alias("case_id"), F.col("p_partkey").alias("block_id"), F.lit("text").alias("block_type"), F.concat_ws(" ", "p_name", "p_type").alias("text"), none.alias("columns"), F.array().cast("array<array<string>>").alias("rows"))
    return candidates.retrieve(rows, v, k=3).select(F.col("block_id").alias("p_partkey"), "rank", "concept_id", "score", "match_type")


SQL_RETRIEVE = f"""
WITH c AS (SELECT * FROM {values([(c, f"{c} {n} {d} {' '.join(sorted(a))}".replace('.', ' ')) for c, n, d, a in PART_CONCEPTS if not c.startswith('old.')])} v(concept, w)),
a AS (SELECT concept, {sql_normal("alias")} AS term FROM {values([(c, x) for c, _, _, a in PART_CONCEPTS for x in a if not c.startswith('old.')])} v(concept, alias)),
words AS (SELECT concept, list_distinct(list_filter(string_split({sql_normal("w")}, ' '), lambda x: length(x) > 1 AND x NOT IN {tuple(T.STOP_WORDS)})) AS w FROM c),
q AS (SELECT p_partkey, {sql_normal("p_name || ' ' || p_type")} AS t FROM part),
k AS (SELECT *, list_distinct(list_filter(string_split(t, ' '), lambda x: length(x) > 1 AND x NOT IN {tuple(T.STOP_WORDS)})) AS q FROM q),
hit AS (SELECT p_partkey, concept, max(CASE WHEN replace(t, ' ', '') = replace(term, ' ', '') THEN 1.0 ELSE 0.9 END)::DOUBLE AS score FROM q JOIN a ON replace(t, ' ', '') = replace(term, ' ', '') OR {sql_contains("t", "term")} GROUP BY ALL),
word AS (SELECT p_partkey, concept, round(least(0.79, 0.45 + 0.34 * len(list_intersect(q, w)) / greatest(len(q), 1)), 6)::DOUBLE AS score FROM k, words WHERE len(list_intersect(q, w)) > 0),
b AS (SELECT p_partkey, concept, score, 'alias' AS kind FROM hit UNION ALL SELECT p_partkey, concept, score, 'keyword' FROM word WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.p_partkey = word.p_partkey AND hit.concept = word.concept))
SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, length(concept) - length(replace(concept, '.', '')) DESC, concept) AS INTEGER) AS rank, concept AS concept_id, score, kind AS match_type FROM b QUALIFY rank <= 3
"""


def scope_detect(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", T.scope_normal(F.col("text")).alias("t"))
    return docs.select("doc_id", F.array_join(R.detect_scopes(F.col("t"), SCOPES), ",").alias("scopes"))


SQL_SCOPE = f"""
WITH s AS (SELECT * FROM {values(SCOPES)} v(scope, term)),
q AS (SELECT doc_id, {sql_normal("regexp_replace(text, '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')")} AS t FROM documents)
SELECT doc_id, coalesce(string_agg(DISTINCT scope, ',' ORDER BY scope), '') AS scopes FROM q LEFT JOIN s ON regexp_matches(t, '(^|[^a-z0-9])' || term || '($|[^a-z0-9])') GROUP BY doc_id
"""


def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).cast("long").alias("n_tokens"))


def sentence_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("sentence_no", "sentence")).withColumn("n_chars", F.length("sentence"))


def interval_overlap(spark, sf_dir):
    """Chunks of 1000 characters joined with the lines they overlap, spans clipped to the chunk.

    Offsets are code points; the join is a range join on the chunk numbers that a line touches, so it is an equi join.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    begin = F.coalesce(F.sum(F.length("line") + 1).over(Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = lines.select("doc_id", "line_no", begin.alias("s"), (begin + F.length("line")).alias("e")).filter("e > s")
    touched = spans.select("*", F.explode(F.sequence(F.expr("s div 1000"), F.expr("(e - 1) div 1000"))).alias("chunk_no"))
    return touched.select("doc_id", "chunk_no", "line_no", F.greatest(F.col("s"), F.col("chunk_no") * 1000).alias("start"), F.least(F.col("e"), F.col("chunk_no") * 1000 + 1000).alias("end"))


SQL_INTERVAL = """
WITH l AS (SELECT doc_id, i - 1 AS line_no, parts[i] AS line FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))),
s AS (SELECT doc_id, line_no, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s, length(line) AS n FROM l),
c AS (SELECT doc_id, unnest(range(0, (length(text) + 999) // 1000)) AS chunk_no FROM documents)
SELECT c.doc_id, chunk_no, CAST(line_no AS INTEGER) AS line_no, greatest(s, chunk_no * 1000) AS start, least(s + n, chunk_no * 1000 + 1000) AS "end"
FROM c JOIN s ON c.doc_id = s.doc_id AND s + n > chunk_no * 1000 AND s < chunk_no * 1000 + 1000 WHERE n > 0
"""
QUERIES = {
    "flagship_gate": (flagship_gate, SQL_FLAGSHIP),
    "block_paragraphs": (block_paragraphs, f"WITH {SQL_BLOCKS} SELECT doc_id, block_no, 'block_' || lpad(block_no::VARCHAR, 4, '0') AS block_id, start_line, end_line, length(text) AS n_chars FROM blocks"),
    "json_props_flatten": (json_props_flatten, "SELECT event_id, '$.' || k AS json_path, json_extract_string(props, '$.' || k) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)"),
    "table_rectangularity": (table_rectangularity, "SELECT o_orderkey, len(string_split(concat_ws(',', o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN o_orderstatus || ',extra' ELSE o_orderstatus END), ','))::BIGINT AS width FROM orders WHERE width <> 3"),
    "bounding_rectangle": (bounding_rectangle, "SELECT p_brand, min(p_size) AS top, max(p_size) AS bottom, min(p_partkey % 13) AS first, max(p_partkey % 13) AS last, count(*) AS n_cells FROM part WHERE p_retailprice > 950 GROUP BY p_brand"),
    "normalise_terms": (normalise_terms, f"SELECT term, {sql_normal('term')} AS n1, {sql_plain('term')} AS n4, regexp_replace(replace(lower(term), 'ß', 'ss'), '[^a-z0-9]', '', 'g') AS n7 FROM (SELECT p_name AS term FROM part UNION SELECT p_type FROM part)"),
    "normalise_exact": (normalise_exact, f"SELECT p_partkey, 'aäss1 ' || {sql_normal('p_name')} AS n1, 'kg/m.s' AS unit FROM part"),
    "alias_theta_match": (alias_theta_match, f"WITH {SQL_ALIAS}, {SQL_MATCH} SELECT doc_id, count(*) AS n_terms, count(DISTINCT concept) AS n_concepts, max(score) AS best FROM m GROUP BY doc_id"),
    "source_term_match": (source_term_match, SQL_SOURCE),
    "keyword_overlap_score": (keyword_overlap_score, SQL_KEYWORD),
    "best_candidate_per_key": (best_candidate_per_key, SQL_BEST),
    "topk_candidates": (topk_candidates, SQL_TOPK),
    "alias_search_ranked": (alias_search_ranked, SQL_ALIAS_SEARCH),
    "retrieve_candidates": (retrieve_candidates, SQL_RETRIEVE),
    "scope_detect": (scope_detect, SQL_SCOPE),
    "token_estimate": (token_estimate, "SELECT doc_id, len(regexp_extract_all(text, '[\\x{3400}-\\x{9fff}]|[^\\x00-\\x7f\\s]|[A-Za-z0-9_]{1,4}|[^\\w\\s]'))::BIGINT AS n_tokens FROM documents"),
    "sentence_split": (sentence_split, None),
    "interval_overlap": (interval_overlap, SQL_INTERVAL),
}
