"""The thin queries of the corpus operators, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, langid, license_scan, linededup, media, minhash, packing, quality, suffix
from .common import table

VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts stored as PGM images, read back and hashed."""
    found = media.media_features(media.text_media(table(spark, sf_dir, "documents")), tiles=True)
    return found.select(
        F.col("id").alias("doc_id"), "n_bytes", F.col("samples_bytes").alias("payload_bytes"), F.col("samples_sha256").alias("payload_sha256"), "tail_crc32", "media_bytes", "media_sha256",
        F.col("dhash").alias("feature"), "width", "height", F.sha2("tile", 256).alias("tile_sha256"),
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.packed_pieces(table(spark, sf_dir, "documents"), vocabulary_path())
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "lower_bound")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import hashlib

    import pyarrow as pa

    def facts(e, text, ids):
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(e.decode(ids).encode()).hexdigest()

    schema = pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    out = bpe.encoded(table(spark, sf_dir, "documents"), vocabulary_path(), facts, schema, "n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", "doc_id")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(None, vectors, k=20, queried=F.col("id") % 20 == 0)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, quality.grades(table(spark, sf_dir, "labels")))
    found = quality.score_documents(docs, model)
    return found.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), F.round("expected_grade", 6).alias("expected_grade"), F.round("tail", 6).alias("tail_probability"), (F.col("tail") >= quality.KEEP).alias("kept"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeated_passages(table(spark, sf_dir, "documents"), span=50).withColumnRenamed("id", "doc_id")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = langid.train(docs.filter(~held_out))
    found = langid.predict(docs, model).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = linededup.drop_lines(docs, linededup.line_bitmaps(docs, min_docs=10))
    return kept.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH lines AS (
  SELECT doc_id, u.i AS i, parts[u.i] AS line, lower_key AS k FROM (
    SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
  ) u, LATERAL (SELECT translate(trim(parts[u.i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_key)
), common AS (SELECT k FROM lines WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(common.k)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE common.k IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN common ON lines.k = common.k GROUP BY doc_id
"""

OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS sh FROM w)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b USING (sh) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id WHERE r.root < e.b)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(root) AS component_id, r.doc_id = min(root) AS kept FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""

OP8_SQL = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS (SELECT doc_id, p, substr(x, 2 * p + 1, 100) AS s FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 49)) AS p FROM h)),
f AS (SELECT s, min(doc_id) AS d FROM win GROUP BY s),
bad AS (SELECT doc_id, p FROM win JOIN f USING (s) WHERE d < doc_id),
cut AS (SELECT *, CASE WHEN p <= lag(p) OVER w + 50 THEN 0 ELSE 1 END AS new FROM bad WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
runs AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS r FROM cut) GROUP BY doc_id, r),
parts AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM runs),
kept AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS n, max(b) AS last, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS k FROM parts JOIN h USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k || substr(x, 2 * last + 1), x))) AS kept_sha256 FROM h LEFT JOIN kept USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_license_scan, op2_media, op3_packing, op4_bpe, op5_near_duplicates, op6_nearest, op7_quality, op8_suffix_dedup, op9_language, op10_line_dedup]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": license_scan.oracle(), "op5_near_duplicates": OP5_SQL, "op8_suffix_dedup": OP8_SQL, "op10_line_dedup": OP10_SQL}
