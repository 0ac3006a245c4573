"""Text normalisers, match predicates and estimates as Column functions.

All are JVM expressions but ``nfkc`` and ``fold``, which have no built-in and are Arrow UDFs; ``normal`` and the others take
text as it is unless exact=True.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Words that carry no meaning in keyword search.
STOP_WORDS = ["a", "an", "and", "at", "columns", "data", "for", "in", "is", "key", "of", "on", "or", "rows", "the", "to", "value", "with"]


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility normalisation."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(StringType())
def fold(text: pd.Series) -> pd.Series:
    """Full Unicode case folding."""
    return text.map(lambda t: None if t is None else t.casefold())


def lower_fold(text: Column) -> Column:
    """Case folding by built-ins: lower case, with sharp s as ss."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def _prepared(text: Column, exact: bool) -> tuple[Column, object]:
    return (nfkc(text), fold) if exact else (text, lower_fold)


def squash(text: Column) -> Column:
    """Runs of anything but letters, digits and marks become one blank."""
    return F.trim(F.regexp_replace(text, r"(?U)[_\W]+", " "))


def camel_split(text: Column) -> Column:
    """A blank between a lower-case letter or digit and a capital."""
    return F.regexp_replace(text, r"(?<=[a-z0-9])(?=[A-Z])", " ")


def normal(text: Column, exact: bool = False) -> Column:
    """Split camel case, fold, squash."""
    t, f = _prepared(text, exact)
    return squash(f(camel_split(t)))


def scope_normal(text: Column, exact: bool = False) -> Column:
    """Like normal, and acronyms end before a capitalised word."""
    t, f = _prepared(text, exact)
    return squash(f(F.regexp_replace(camel_split(t), r"(?<=[A-Z])(?=[A-Z][a-z])", " ")))


def plain_normal(text: Column, exact: bool = False) -> Column:
    """Fold and squash."""
    t, f = _prepared(text, exact)
    return squash(f(t))


def exact_normal(text: str | None, scope: bool = False) -> str | None:
    """normal (or scope_normal) with full compatibility normalisation and folding, for rows that are in Python anyway."""
    if text is None:
        return None
    t = re.sub(r"(?<=[a-z0-9])(?=[A-Z])" + (r"|(?<=[A-Z])(?=[A-Z][a-z])" if scope else ""), " ", unicodedata.normalize("NFKC", text))
    return " ".join(re.sub(r"[_\W]+", " ", t.casefold()).split())


def with_normals(rows: DataFrame, column: str = "text") -> DataFrame:
    """rows with t and ts, the exact normal forms of a text column: one pass of Python, and none in what follows."""

    def run(frames):
        for f in frames:
            yield f.assign(t=f[column].map(exact_normal), ts=f[column].map(lambda x: exact_normal(x, True)))

    return rows.mapInPandas(run, StructType([*rows.schema.fields, StructField("t", StringType()), StructField("ts", StringType())]))


def unit_key(unit: Column, exact: bool = False) -> Column:
    """The spelling of a unit."""
    t, f = _prepared(unit, exact)
    t = F.regexp_replace(f(F.trim(t)), "[·⋅]", ".")
    return F.regexp_replace(F.regexp_replace(t, r"\bper\b", "/"), r"(?U)\s+", "")


def field_key(name: Column) -> Column:
    """Letters a-z and digits only."""
    return F.regexp_replace(lower_fold(name), "[^a-z0-9]", "")


def compact(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit(""))


def keywords(normalised: Column) -> Column:
    """distinct words of a normalised text that are longer than a letter and mean something."""
    return F.array_distinct(F.filter(F.split(normalised, " "), lambda w: (F.length(w) > 1) & ~w.isin(STOP_WORDS)))


def is_ascii(text: Column) -> Column:
    return ~text.rlike(r"[^\x00-\x7F]")


def word_match(text: Column, term: Column) -> Column:
    """The term stands in the text with no a-z or digit beside it, without a regular expression a row."""
    first = F.instr(text, term)
    bounded = F.concat(F.lit("(?<![a-z0-9])\\Q"), term, F.lit("\\E(?![a-z0-9])"))
    return (first > 0) & F.regexp_like(text, bounded)


def contains(text: Column, term: Column) -> Column:
    """M1, on normalised text and term."""
    return (F.length(term) > 0) & F.when(is_ascii(term), word_match(text, term)).otherwise(F.instr(compact(text), compact(term)) > 0)


def scope_contains(text: Column, term: Column) -> Column:
    """M2: terms with an ideograph are parts of the compact text, others words."""
    cjk = term.rlike("[\\x{4E00}-\\x{9FFF}]")
    return (F.length(term) > 0) & F.when(cjk, F.instr(compact(text), compact(term)) > 0).otherwise(word_match(text, term))


def source_match(text: Column, term: Column) -> Column:
    """M3: 'exact' if equal without blanks, 'contained', or null."""
    return F.when(compact(text) == compact(term), "exact").when(contains(text, term), "contained")


def alias_rank(text: Column, alias: Column) -> Column:
    """M4: 0 equal, 1 a part, 2 a part without blanks; null if none."""
    t, a = plain_normal(text), plain_normal(alias)
    return F.when(t == a, 0).when((F.length(a) > 0) & (F.instr(t, a) > 0), 1).when((F.length(a) > 0) & (F.instr(compact(t), compact(a)) > 0), 2)


def token_estimate(text: Column) -> Column:
    """ideographs and other non-ASCII signs one each, up to four ASCII word characters one, punctuation one."""
    pattern = r"[\x{3400}-\x{9fff}]|[^\x00-\x7f\s]|[A-Za-z0-9_]{1,4}|[^\w\s]"
    return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def sentences(text: Column) -> Column:
    """pieces that end at a sentence's sign, kept with it."""
    return F.filter(F.split(text, r"(?<=[.!?。！？；;])\s+|(?<=[。！？；])"), lambda s: F.length(F.trim(s)) > 0)


def readable(text: Column) -> Column:
    """Letters, digits, punctuation and a few signs, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}\p{P}\s%°±×÷=<>^]", ""), r"(?U)\s+", " "))
