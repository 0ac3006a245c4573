"""Shared by the query modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A small vocabulary over the words of the test corpus: (concept, normalised alias).
ALIASES = [
    ("lang.english.article", "the"), ("lang.english.article", "of the"), ("lang.english.verb", "is"), ("lang.english.verb", "be"),
    ("lang.french.article", "la"), ("lang.french.article", "des"), ("lang.french.link", "que"), ("lang.french.link", "dans"),
    ("lang.german.article", "der"), ("lang.german.article", "die"), ("lang.german.link", "und"), ("lang.german.link", "für"),
    ("lang.spanish.article", "el"), ("lang.spanish.article", "los"), ("lang.spanish.link", "con"), ("lang.spanish.link", "según"),
    ("rights.apache", "apache license"), ("rights.mit", "mit license"), ("rights", "licensed under"), ("tone.insult", "idiot"),
]
SCOPES = [("english", "the"), ("english", "and"), ("french", "les"), ("german", "nicht"), ("german", "für"), ("spanish", "para"), ("rights", "license"), ("rights", "licensed under")]


def values(rows) -> str:
    """SQL VALUES of tuples of text and numbers."""
    one = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + ")"


def sql_normal(x: str) -> str:
    """normal() in DuckDB."""
    return f"trim(regexp_replace(replace(lower(regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), 'ß', 'ss'), '[^\\pL\\pN\\pM]+', ' ', 'g'))"


def sql_plain(x: str) -> str:
    return f"trim(regexp_replace(replace(lower({x}), 'ß', 'ss'), '[^\\pL\\pN\\pM]+', ' ', 'g'))"


def sql_contains(text: str, term: str) -> str:
    return (
        f"(CASE WHEN regexp_matches({term}, '^[\\x00-\\x7F]+$') THEN contains({text}, {term}) AND regexp_matches({text}, '(^|[^a-z0-9])' || {term} || '($|[^a-z0-9])') "
        f"ELSE contains(replace({text}, ' ', ''), replace({term}, ' ', '')) END)"
    )
