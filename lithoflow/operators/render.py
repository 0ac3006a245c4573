"""Platform records and text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Keywords closed by one slash after all records, and those closed after each record and once more.
TABLE_KEYWORDS, WELL_KEYWORDS = ["PVDO", "PVDG", "SWOF"], ["WCONPROD", "WCONINJE"]
SUPPORTED = {"producer": "liquid_rate", "water_injector": "water_injection_rate"}


@F.pandas_udf(StringType())
def general_12(value: pd.Series) -> pd.Series:
    """Twelve significant digits in the shortest form; neither engine's format_string has it."""
    return value.map(lambda v: None if v is None or v != v else format(v + 0.0, ".12g"))


def quoted(text: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))


def number_token(value: Column, missing: str = "1*") -> Column:
    return F.coalesce(general_12(value), F.lit(missing))


def time_steps(duration: Column, interval: Column) -> Column:
    """whole intervals, and the rest if it is over a billionth."""
    n = F.floor(duration / interval).cast("int")
    rest = duration - interval * n
    return F.when((interval > 0) & (duration >= 0), F.concat(F.array_repeat(interval, n), F.filter(F.array(rest), lambda x: x > 1e-9)))


def supported_control(well_type: Column, control: Column) -> Column:
    """P22."""
    return ((well_type == "producer") & (control == "liquid_rate")) | ((well_type == "water_injector") & (control == "water_injection_rate"))


def render_include(records: DataFrame, dialect: str) -> DataFrame:
    """(case_id, text) of (case_id, block_no, section, keyword, record_no, line), line already rendered."""
    keyword = F.col("keyword")
    blocks = records.groupBy("case_id", "block_no", "section", "keyword").agg(F.transform(F.array_sort(F.collect_list(F.struct("record_no", "line"))), lambda x: F.concat(F.lit("  "), x["line"])).alias("lines"))
    slashed = F.transform("lines", lambda x: F.concat(x, F.lit(" /")))
    body = F.when(keyword.isin(TABLE_KEYWORDS), F.concat("lines", F.array(F.lit("/")))).when(keyword.isin(WELL_KEYWORDS), F.concat(slashed, F.array(F.lit("/")))).otherwise(slashed)
    before = F.lag("section").over(Window.partitionBy("case_id").orderBy("block_no"))
    head = F.when(before.eqNullSafe(F.col("section")), F.array().cast("array<string>")).otherwise(F.array(F.lit(""), F.concat(F.lit("-- "), F.col("section"))))
    text = blocks.withColumn("text", F.array_join(F.concat(head, F.array(keyword), body), "\n"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "text"))), lambda x: x["text"]), "\n")
    top = "\n".join(["-- Generated deterministic demo INCLUDE", f"-- Dialect: {dialect}", "-- Requires a compatible host deck; no missing values were guessed."])
    return text.groupBy("case_id").agg(F.concat(F.lit(top + "\n"), joined, F.lit("\n")).alias("text"))


def render_fragment(records: DataFrame, dialect: str) -> DataFrame:
    """(case_id, text): one starred keyword line a record."""
    line = F.rtrim(F.concat(F.lit("*"), "keyword", F.lit(" "), "line"))
    top = "\n".join(["** Generated deterministic CMG demo control fragment", f"** Dialect: {dialect}", "** Not a standalone dataset; host well/completion context is required."])
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "record_no", line.alias("t")))), lambda x: x["t"]), "\n")
    return records.groupBy("case_id").agg(F.concat(F.lit(top + "\n"), body, F.lit("\n")).alias("text"))


def _facts(quantities: DataFrame) -> DataFrame:
    """Long rows with the selectors and the field of their path."""
    p = F.col("path")
    part = lambda pattern: F.nullif(F.regexp_extract(p, pattern, 1), F.lit(""))
    return quantities.select(
        "case_id", "path", "value", "text", part(r"^fluids\.(\w+)").alias("phase"), part(r"^scal\.relative_permeability\[([^\]]+)\]").alias("table_id"), part(r"points\[(\d+)\]").cast("int").alias("point"),
        part(r"^wells\[([^\]]+)\]").alias("well"), part(r"controls\[([^\]]+)\]").alias("control"), part(r"constraints\[([^\]]+)\]").alias("limit"), F.element_at(F.split(p, r"\."), -1).alias("field"),
    )


def include_records(quantities: DataFrame) -> DataFrame:
    """C17: the INCLUDE records of every case: ROCK, DENSITY, PVDO, PVDG, PVTW, SWOF, WCONPROD, WCONINJE, TSTEP."""
    f = _facts(quantities)
    pick = lambda c, v="value": F.max(F.when(c, F.col(v)))
    out = []

    def emit(rows, block, section, keyword, record, *tokens):
        line = F.concat_ws(" ", *tokens)
        out.append(rows.select("case_id", block.alias("block_no"), F.lit(section).alias("section"), keyword.alias("keyword"), record.alias("record_no"), line.alias("line")))

    key = lambda n, x=None: F.struct(F.lit(n).alias("n"), (F.lit("") if x is None else x).alias("x"))
    zero = F.struct(F.lit(0).alias("a"), F.lit("").alias("b"), F.lit("").alias("c"))
    at = lambda a, b=None, c=None: F.struct(a.cast("int").alias("a"), (F.lit("") if b is None else b).alias("b"), (F.lit("") if c is None else c).alias("c"))
    rock = f.groupBy("case_id").agg(pick(F.col("path") == "rock.reference_pressure").alias("p"), pick(F.col("path") == "rock.compressibility").alias("c")).filter("p IS NOT NULL AND c IS NOT NULL")
    emit(rock, key(1), "PROPS", F.lit("ROCK"), zero, number_token(F.col("p")), number_token(F.col("c")))
    dens = f.filter("field = 'density'").groupBy("case_id").agg(*[pick(F.col("phase") == x).alias(x) for x in ("oil", "water", "gas")]).filter("oil IS NOT NULL AND water IS NOT NULL AND gas IS NOT NULL")
    emit(dens, key(2), "PROPS", F.lit("DENSITY"), zero, *[number_token(F.col(x)) for x in ("oil", "water", "gas")])
    fields = ("pressure", "formation_volume_factor", "compressibility", "viscosity", "viscosibility")
    pvt = f.filter("phase IS NOT NULL AND point IS NOT NULL").groupBy("case_id", "phase", "point").agg(*[pick(F.col("field") == x).alias(x) for x in fields])
    emit(pvt.filter("phase = 'oil'"), key(3), "PROPS", F.lit("PVDO"), at(F.col("point")), *[number_token(F.col(x)) for x in ("pressure", "formation_volume_factor", "viscosity")])
    emit(pvt.filter("phase = 'gas'"), key(4), "PROPS", F.lit("PVDG"), at(F.col("point")), *[number_token(F.col(x)) for x in ("pressure", "formation_volume_factor", "viscosity")])
    emit(pvt.filter("phase = 'water'"), key(5), "PROPS", F.lit("PVTW"), at(F.col("point")), *[number_token(F.col(x)) for x in fields])
    scal = f.filter("table_id IS NOT NULL AND point IS NOT NULL").groupBy("case_id", "table_id", "point").agg(*[pick(F.col("field") == x).alias(x) for x in ("sw", "krw", "kro", "pcow")])
    emit(scal, key(6, F.col("table_id")), "PROPS", F.lit("SWOF"), at(F.col("point")), *[number_token(F.col(x)) for x in ("sw", "krw", "kro", "pcow")])
    kind = f.filter("field = 'well_type'").select("case_id", "well", F.col("text").alias("well_type"))
    wells = f.filter("control IS NOT NULL").groupBy("case_id", "well", "control").agg(pick(F.col("field") == "target").alias("target"), pick(F.col("limit") == "minimum_bhp").alias("low"), pick(F.col("limit") == "maximum_bhp").alias("high")).join(kind, ["case_id", "well"]).filter("target IS NOT NULL")
    name = quoted(F.col("well"))
    emit(wells.filter("well_type = 'producer'"), key(7), "SCHEDULE", F.lit("WCONPROD"), at(F.lit(0), F.col("well"), F.col("control")), name, F.lit("'OPEN' 'LRAT' 1* 1* 1*"), number_token(F.col("target")), F.lit("1*"), number_token(F.col("low")))
    emit(wells.filter("well_type = 'water_injector'"), key(8), "SCHEDULE", F.lit("WCONINJE"), at(F.lit(0), F.col("well"), F.col("control")), name, F.lit("'WATER' 'OPEN' 'RATE'"), number_token(F.col("target")), F.lit("1*"), number_token(F.col("high")))
    steps = f.groupBy("case_id").agg(pick(F.col("path") == "schedule.duration").alias("d"), pick(F.col("path") == "schedule.report_interval").alias("i")).filter("d IS NOT NULL AND i IS NOT NULL")
    each = steps.select("case_id", F.posexplode(time_steps(F.col("d"), F.col("i"))).alias("n", "step")).select("case_id", "n", number_token(F.col("step")).alias("t"))
    lines = each.groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "t"))), lambda x: x["t"]), " ").alias("t"))
    emit(lines, key(9), "SCHEDULE", F.lit("TSTEP"), zero, F.col("t"))
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    return rows


def fragment_records(quantities: DataFrame) -> DataFrame:
    """C17 for the control fragment: WELL, its kind, and one line a control and constraint.

    Fixed values: keywords WELL, PRODUCER, INJECTOR, OPERATE; operations STL and STW.
    """
    f = _facts(quantities).filter("well IS NOT NULL")
    kind = f.filter("field = 'well_type'").select("case_id", "well", F.col("text").alias("well_type"))
    producer = F.col("well_type") == "producer"
    rows = f.join(kind, ["case_id", "well"])
    key = lambda n, control, limit: F.struct(F.col("well").alias("w"), F.lit(n).alias("n"), control.alias("c"), limit.alias("l"))
    none, name = F.lit(""), quoted(F.col("well"))
    heads = rows.select("case_id", "well", "well_type").distinct()
    zero = F.lit(0).alias("record_no")
    operation = F.when(producer, "*STL").otherwise("*STW")
    mode = F.when(F.col("limit") == "minimum_bhp", "*MIN").otherwise("*MAX")
    return (
        heads.select("case_id", key(0, none, none).alias("block_no"), zero, F.lit("WELL").alias("keyword"), name.alias("line"))
        .union(heads.select("case_id", key(1, none, none), zero, F.when(producer, "PRODUCER").otherwise("INJECTOR"), F.when(producer, name).otherwise(F.concat(name, F.lit(" *WATER")))))
        .union(rows.filter("field = 'target'").select("case_id", key(2, F.col("control"), none), zero, F.lit("OPERATE"), F.concat_ws(" ", name, F.lit("*MAX"), operation, number_token(F.col("value"), "*"))))
        .union(rows.filter("limit IS NOT NULL").select("case_id", key(2, F.col("control"), F.col("limit")), zero, F.lit("OPERATE"), F.concat_ws(" ", name, mode, F.lit("*BHP"), number_token(F.col("value"), "*"))))
    )


def nonwell_data(quantities: DataFrame) -> DataFrame:
    """(case_id, nonwell): whether a case has any value outside its wells (rock, fluids, relative permeability, schedule)."""
    # fixed values: the fields that count
    outside = F.col("path").rlike(r"^(rock\.(compressibility|reference_pressure)|fluids\.(oil|water|gas)\b.*|scal\.relative_permeability\b.*|schedule\.(duration|report_interval))$")
    given = F.col("value").isNotNull() | F.col("text").isNotNull()
    return quantities.groupBy("case_id").agg(F.coalesce(F.bool_or(outside & given), F.lit(False)).alias("nonwell"))
