"""Licence scan with DataFrame functions only.

Texts and templates are five-word shingles, as 64-bit hashes. A template of m shingles is looked for in windows of 2 B
shingles that start every B shingles, with B the power of two from 1.25 m up, so that each run of B shingles lies within a
window. MinHash bands of one row retrieve the templates of a window; ``BANDS`` bands find a template that the window holds
to 0.8 (similarity at least 0.8 m / (2 B) > 0.16) with probability 1 - (1 - 0.16)^64 > 0.9999. Exact containment of the
template's shingles in the window then decides.

A window without any shingle of a template has no band in common with one, whatever the permutation, so such windows are
dropped before their bands are computed; this changes no result.

Defined cases: null and empty texts, and texts of under five words, match nothing; repeated rows of a document count once;
rows with a null id are one document; a template of under five words is an error; no templates or documents: an empty
result; extra columns are ignored. Templates of ``MOST_TEMPLATE_WORDS`` words in all at most are broadcast; beyond that,
bands meet by a shuffled join on (block, band) and nothing is dropped beforehand, with the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let

SHINGLE, BANDS, CONTAINED, MOST_TEMPLATE_WORDS = 5, 64, 0.8, 50_000

#: Public licence notices.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "mit-notice": "Released under the MIT License.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def licence_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingle_row(text: Column) -> Column:
    """Hashes of the five-word shingles, in order; empty for fewer words."""
    one = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)]))
    return let(licence_words(text), lambda w: F.when(F.size(w) < SHINGLE, F.array().cast("array<bigint>")).otherwise(one(w)))


def bands(window: Column) -> Column:
    """One-row MinHash bands: the band's number and its least permuted hash, hashed together."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda j: F.xxhash64(j, F.array_min(F.transform(window, lambda x: F.xxhash64(x, j)))))


def template_rows(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """(license, shingles, m, block, bands) of each template."""
    rows = spark.createDataFrame([*templates.items()], "license string, text string")
    rows = rows.select("license", F.array_distinct(shingle_row(F.col("text"))).alias("shingles")).withColumn("m", F.size("shingles"))
    return rows.withColumn("block", F.pow(F.lit(2), F.ceil(F.round(F.log2(F.col("m") * 1.25), 9))).cast("int")).withColumn("bands", bands(F.col("shingles")))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, contained: float = CONTAINED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, license, containment, n_windows, first_shingle) of every template that a document holds.

    containment is that of the best window, first_shingle the start of the first window that holds the template.
    """
    spark = docs.sparkSession
    large = sum(len(t.split()) for t in templates.values()) > MOST_TEMPLATE_WORDS
    if any(len(t.split()) < SHINGLE for t in templates.values()):
        raise ValueError("a template needs five words")
    if not templates:
        kind = docs.schema[id_col].dataType.simpleString()
        return spark.createDataFrame([], f"id {kind}, license string, containment double, n_windows long, first_shingle long")
    known = template_rows(spark, templates)
    if large:
        blocks = sorted(r["block"] for r in known.select("block").distinct().collect())  # powers of two
        hits = lambda a: F.size(a) > 0
    else:
        held = known.collect()
        known = spark.createDataFrame(held)
        of_template = sorted({h for r in held for h in r["shingles"]})
        blocks = sorted({r["block"] for r in held})
        hits = lambda a: F.exists(a, lambda x: x.isin(of_template))
    rows = docs.select(F.col(id_col).alias("id"), shingle_row(F.col(text_col)).alias("h")).filter(hits(F.col("h")))

    def windows(size: int) -> Column:
        n = F.ceil(F.size("h") / size).cast("int")
        every = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.struct(F.lit(size).alias("block"), i.alias("at"), F.slice(F.col("h"), i * size + 1, F.lit(2 * size)).alias("sh")))
        return F.filter(every, lambda x: hits(x["sh"]))

    cut = rows.select("id", F.explode(F.concat(*[windows(b) for b in blocks])).alias("x")).select("id", "x.*").withColumn("found", bands(F.col("sh")))
    if large:  # equal bands meet by a shuffle; a window and a template that share several meet once
        cut = cut.withColumn("text", F.xxhash64("sh"))
        asked = cut.select("id", "block", "at", "text", "sh", F.explode("found").alias("band"))
        met = asked.join(known.select("license", "block", F.explode("bands").alias("band")), ["block", "band"])
        met = met.groupBy("id", "block", "at", "text", "license").agg(F.first("sh").alias("sh"))
        retrieved = met.alias("w").join(known.select("license", "m", "shingles").alias("t"), "license")
    else:
        retrieved = cut.alias("w").join(F.broadcast(known.alias("t")), (F.col("w.block") == F.col("t.block")) & F.arrays_overlap("w.found", "t.bands"))
    share = (F.size(F.array_intersect("w.sh", "t.shingles")) / F.col("m")).alias("share")
    verified = retrieved.select("id", "license", (F.col("at") * F.col("w.block")).cast("long").alias("start"), share).filter(F.col("share") >= contained)
    return verified.groupBy("id", "license").agg(F.round(F.max("share"), 6).alias("containment"), F.count_distinct("start").alias("n_windows"), F.min("start").alias("first_shingle"))


def oracle(templates: dict[str, str] = TEMPLATES, contained: float = CONTAINED) -> str:
    """DuckDB SQL of the same result: every window and template, compared on shingle texts."""
    values = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in templates.items())
    cut = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\pL\\pN]+'), lambda w: w <> '')"
    return f"""
WITH t AS (SELECT license, w FROM (SELECT license, {cut} AS w FROM (VALUES {values}) v(license, text))),
ts AS (SELECT DISTINCT license, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT license, w, unnest(range(1, len(w) - 3)) AS i FROM t)),
tm AS (SELECT license, count(*) AS m, CAST(pow(2, ceil(round(log2(count(*) * 1.25), 9))) AS BIGINT) AS b FROM ts GROUP BY license),
d AS (SELECT doc_id, {cut} AS w FROM documents),
ds AS (SELECT doc_id, i - 1 AS pos, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
hit AS (SELECT doc_id, license, pos, s, m, b FROM ds JOIN ts USING (s) JOIN tm USING (license)),
win AS (SELECT doc_id, license, s, m, b, (pos // b) * b AS start FROM hit UNION ALL SELECT doc_id, license, s, m, b, (pos // b - 1) * b FROM hit WHERE pos >= b),
ok AS (SELECT doc_id, license, start, count(DISTINCT s) / m AS share FROM win GROUP BY doc_id, license, start, m HAVING count(DISTINCT s) / m >= {contained})
SELECT doc_id, license, round(max(share), 6) AS containment, count(DISTINCT start) AS n_windows, CAST(min(start) AS BIGINT) AS first_shingle FROM ok GROUP BY doc_id, license
"""
