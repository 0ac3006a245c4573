"""The INCLUDE grammar that this engine writes, read back and compared (C19, Y19). No simulator's own parser is called."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the format: keywords, numbers in a row of a table, columns read of a record (number of the item, name).
TABLES = {"SWOF": 4, "PVDO": 3, "PVDG": 3}
FIRST = {"DENSITY": 3, "ROCK": 2}
EVERY = {"PVTW": 5}
STEPS = "TSTEP"
WELLS = {
    "WCONPROD": {0: "well", 1: "status", 2: "control_mode", 6: "liquid_rate", 8: "bhp"},
    "WCONINJE": {0: "well", 1: "phase", 2: "status", 3: "control_mode", 4: "rate", 6: "bhp"},
}
SCHEDULE = ["WCONPROD", "WCONINJE", "TSTEP"]
KEYWORDS = [*TABLES, *FIRST, *EVERY, *WELLS, STEPS]


def parse_include(texts: DataFrame) -> DataFrame:
    """(case_id, section, keyword, row, col, field, value, number) of (case_id, text): one row a value that is read.

    Comments (--) go, n* stands for n defaults (null values) and n*x for n times x; quotes of names go. section is schedule
    from the first schedule keyword on, props before. field names the column of a well record. A case without any keyword,
    or with a null text, has no rows. All within a row: no shuffle.
    """
    line_of = rf"(?m)^[ \t]*(?i:{'|'.join(KEYWORDS)})[ \t]*$"
    clean = F.regexp_replace(F.regexp_replace(F.col("text"), r"\r\n?", "\n"), r"--[^\n]*", "")
    part = F.filter(F.split(clean, rf"(?={line_of})"), lambda x: x.rlike(line_of))
    blocks = texts.select("case_id", F.posexplode(F.transform(part, F.trim)).alias("block", "body"))
    blocks = blocks.select("case_id", "block", F.upper(F.regexp_extract("body", r"^\s*(\S+)", 1)).alias("keyword"), F.regexp_replace("body", r"^\s*\S+", "").alias("body"))
    words = lambda x: F.filter(F.split(x, r"\s+"), lambda w: w != "")
    times = lambda w: F.regexp_extract(w, r"^(\d+)\*", 1).cast("int")
    item = lambda w: F.nullif(F.regexp_replace(F.regexp_replace(w, r"^\d+\*", ""), "'", ""), F.lit(""))
    items = lambda x: F.flatten(F.transform(words(x), lambda w: F.when(w.rlike(r"^\d+\*"), F.array_repeat(item(w), times(w))).otherwise(F.array(item(w)))))
    records = F.filter(F.transform(F.split("body", "/"), items), lambda r: F.size(r) > 0)
    keyword = F.col("keyword")
    read = F.when(keyword.isin(*EVERY, *WELLS), F.col("records")).otherwise(F.slice("records", 1, 1))
    rows = blocks.select("case_id", "block", "keyword", records.alias("records")).select("case_id", "block", "keyword", F.posexplode(read).alias("record", "items"))
    cells = rows.select("case_id", "block", "keyword", "record", F.posexplode("items").alias("i", "value"))
    table = F.create_map(*[F.lit(x) for p in TABLES.items() for x in p])
    most = F.create_map(*[F.lit(x) for p in (FIRST | EVERY).items() for x in p])
    names = F.create_map(*[F.lit(x) for k, fields in WELLS.items() for i, name in fields.items() for x in (f"{k} {i}", name)])
    width = F.try_element_at(table, keyword)
    cells = cells.select(
        "case_id", F.when(keyword.isin(SCHEDULE), "schedule").otherwise("props").alias("section"), "keyword",
        F.when(width.isNotNull(), F.floor(F.col("i") / width)).otherwise(F.col("record")).cast("int").alias("row"), F.when(width.isNotNull(), F.col("i") % width).otherwise(F.col("i")).cast("int").alias("col"),
        F.try_element_at(names, F.concat_ws(" ", keyword, "i")).alias("field"), "value", F.expr("try_cast(value AS double)").alias("number"),
    )
    return cells.filter(~keyword.isin(*WELLS) | F.col("field").isNotNull()).filter(~keyword.isin(*FIRST, *EVERY) | (F.col("col") < F.try_element_at(most, keyword)))


def compare_includes(golden: DataFrame, generated: DataFrame) -> DataFrame:
    """(case_id, path, golden, generated) where two parsed texts of a case differ; numbers are equal to 1e-9 of the larger, or 1e-12.

    A keyword that one text lacks, or whose number of values differs, is one row with its path and both numbers of values.
    """
    key = ["case_id", "keyword"]
    sizes = lambda d, n: d.groupBy(*key).agg(F.count(F.lit(1)).alias(n))
    of = sizes(golden, "g").join(sizes(generated, "h"), key, "full")
    counts = of.filter(~F.col("g").eqNullSafe(F.col("h"))).select("case_id", F.concat(F.lit("$."), "keyword").alias("path"), F.col("g").cast("string").alias("golden"), F.col("h").cast("string").alias("generated"))
    place = [*key, "row", "col"]
    two = golden.select(*place, "field", F.col("value").alias("golden"), F.col("number").alias("x")).join(generated.select(*place, F.col("value").alias("generated"), F.col("number").alias("y")), place)
    near = F.abs(F.col("x") - F.col("y")) <= F.greatest(1e-9 * F.greatest(F.abs("x"), F.abs("y")), F.lit(1e-12))
    same = F.coalesce(near, F.col("golden").eqNullSafe(F.col("generated")))
    path = F.concat(F.lit("$."), "keyword", F.when(F.col("keyword").isin(*FIRST, STEPS), "").otherwise(F.concat(F.lit("["), "row", F.lit("]"))), F.coalesce(F.concat(F.lit("."), "field"), F.concat(F.lit("["), "col", F.lit("]"))))
    cells = two.filter(~same).join(of.filter("g = h").select(*key), key, "left_semi").select("case_id", path.alias("path"), "golden", "generated")
    return counts.union(cells)
