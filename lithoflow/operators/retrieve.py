"""Vocabulary matching and ranked retrieval.

Vocabularies are small (tens of entries) and given as rows on the driver, so that every term becomes a literal predicate in
one narrow projection: no join, no shuffle and no pattern compiled per row. What is shuffled is only what matched.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def literal_contains(text: Column, term: str) -> Column:
    """M1 for a normalised term known on the driver."""
    if not term:
        return F.lit(False)
    if term.isascii():
        bounded = text.rlike("(?<![a-z0-9])" + re.escape(term) + "(?![a-z0-9])")
        return F.contains(text, F.lit(term)) & bounded
    return F.contains(T.compact(text), F.lit(term.replace(" ", "")))


def literal_equal(text: Column, term: str) -> Column:
    """Equality without blanks; a normalised text over twice the term's length can't be equal, which spares most texts the work."""
    bare = term.replace(" ", "")
    return (F.length(text) < 2 * len(bare)) & (T.compact(text) == bare)


def alias_matches(text: Column, aliases: Sequence[tuple[str, str]]) -> Column:
    """Array of (concept, term, score) for normalised text and (concept, normalised term): 1.0 equal, 0.9 contained.

    A text is cut into ASCII words once, and one set intersection finds all terms of one word; its form without blanks is made
    once too. Only terms of several words are searched one by one.
    """
    plain = sorted({t for _, t in aliases if re.fullmatch("[a-z0-9]+", t)})
    words = F.array_intersect(F.split(text, "[^a-z0-9]+"), F.array(*map(F.lit, plain)).cast("array<string>"))
    bare = T.compact(text) if any(not t.isascii() for _, t in aliases) else F.lit(None).cast("string")
    facts = F.struct(text.alias("t"), words.alias("w"), bare.alias("c"))

    def held(x: Column, term: str) -> Column:
        if term in plain:
            return F.array_contains(x["w"], term)
        return literal_contains(x["t"], term) if term.isascii() else F.contains(x["c"], F.lit(term.replace(" ", "")))

    def one(x: Column, concept: str, term: str) -> Column:
        hit = F.when(literal_equal(x["t"], term), 1.0).when(held(x, term), 0.9)
        return F.when(hit.isNotNull(), F.struct(F.lit(concept).alias("concept"), F.lit(term).alias("term"), hit.alias("score")))

    return F.get(F.transform(F.array(facts), lambda x: F.array_compact(F.array(*[one(x, c, t) for c, t in aliases]))), F.lit(0))


def keyword_score(query: Column, concept: Column) -> Column:
    """Score of two keyword arrays, null without a common word."""
    common = F.size(F.array_intersect(query, concept))
    return F.when(common > 0, F.round(F.least(F.lit(0.79), 0.45 + 0.34 * common / F.greatest(F.size(query), F.lit(1))), 6))


def best_per_key(rows: DataFrame, keys: Sequence[str], score: str = "score", seq: str = "seq") -> DataFrame:
    """The highest score of each key, the first inserted on ties."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), F.asc(seq))
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def dots(concept: Column) -> Column:
    return F.length(concept) - F.length(F.replace(concept, F.lit("."), F.lit("")))


def top_k(rows: DataFrame, keys: Sequence[str], k: int, concept: str = "concept", context: str | None = None) -> DataFrame:
    """The k best of each key by score, depth of the concept, concept and context; rank from 1."""
    if k < 1:
        raise ValueError("k must be at least 1")
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc(dots(F.col(concept))), F.asc(concept), *([F.asc(F.coalesce(F.col(context), F.lit("")))] if context else []))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search_alias(rows: DataFrame, text_col: str, aliases: Sequence[tuple[str, str]]) -> DataFrame:
    """(concept, rank) of every row's matching concepts, the least rank each."""
    one = [F.struct(F.lit(c).alias("concept"), T.alias_rank(F.col(text_col), F.lit(a)).alias("rank")) for c, a in aliases]
    found = rows.withColumn("_m", F.explode(F.filter(F.array(*one), lambda x: x["rank"].isNotNull())))
    return found.groupBy(*rows.columns, F.col("_m.concept").alias("concept")).agg(F.min("_m.rank").alias("rank"))


def detect_scopes(text: Column, scopes: Sequence[tuple[str, str]]) -> Column:
    """sorted distinct scopes with an alias in the scope-normalised text (M2)."""
    hits = [F.when(T.scope_contains(text, F.lit(a)), F.lit(s)) for s, a in scopes]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*hits))))


def confidence_band(confidence: Column) -> Column:
    """P04."""
    return F.when(confidence < 0.8, "review").when(confidence < 0.95, "warning").otherwise("auto")


def gate(rows: DataFrame, key: str, band: str = "band") -> DataFrame:
    """One status a case; anything for review, or nothing at all, stops it."""
    return rows.groupBy(key).agg(F.count(band).alias("n_matches"), F.coalesce(F.bool_or(F.col(band) == "review"), F.lit(False)).alias("r")).withColumn("status", F.when((F.col("n_matches") == 0) | F.col("r"), "review_required").otherwise("ready")).drop("r")


def low_confidence_flag(flags: Column) -> Column:
    """Whether a flag of the array names a low confidence; false for null and for an empty array."""
    # fixed value: the pattern of such flags
    low = F.exists(flags, lambda f: F.coalesce(F.upper(F.trim(f)).rlike(r"(^|_)LOW(_[A-Z0-9]+)*_CONFIDENCE$"), F.lit(False)))
    return F.coalesce(low, F.lit(False))


def review_list(mappings: DataFrame) -> DataFrame:
    """Mappings (status, confidence) for a reviewer, with their list: unresolved, low_confidence below 0.8, warning below 0.95."""
    confidence = F.col("confidence")
    kind = F.when(~F.col("status").eqNullSafe(F.lit("MAPPED")), "unresolved").when(confidence < 0.8, "low_confidence").when(confidence < 0.95, "warning")
    return mappings.withColumn("list", kind).filter("list IS NOT NULL")
