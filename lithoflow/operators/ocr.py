"""What happens around an OCR engine, without the engine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOX = ["x0", "top", "x1", "bottom"]
#: A child that covers its parent, overlap of two children, match of two boxes in pixels.
COVERS, OVERLAPS, NEAR = 0.98, 0.05, 2.0


def polygon_box(points: Column) -> Column:
    """The box of an array of (x, y) arrays, or of four numbers in one array; null if inverted or empty."""
    xs, ys = F.transform(points, lambda p: F.get(p, 0)), F.transform(points, lambda p: F.get(p, 1))
    box = F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("top"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("bottom"))
    return F.when((F.size(points) > 0) & box["x0"].isNotNull() & (box["x1"] >= box["x0"]) & (box["bottom"] >= box["top"]), box)


def to_points(box: list[Column], pixels: tuple[Column, Column], page: tuple[Column, Column]) -> Column:
    """a pixel box in points; null if it is inverted or off the page."""
    x, y = page[0] / pixels[0], page[1] / pixels[1]
    x0, top, x1, bottom = box[0] * x, box[1] * y, box[2] * x, box[3] * y
    ok = (x1 > x0) & (bottom > top) & (x0 >= 0) & (top >= 0) & (x1 <= page[0] + 1e-6) & (bottom <= page[1] + 1e-6)
    return F.when(ok, F.struct(x0.alias("x0"), top.alias("top"), x1.alias("x1"), bottom.alias("bottom")))


def clamped(box: list[Column], width: Column, height: Column) -> Column:
    """A box cut to the image; null if it is null or nothing is left."""
    low, high = [F.greatest(c, F.lit(0.0)) for c in box[:2]], [F.least(box[2], width), F.least(box[3], height)]
    whole = reduce(Column.__and__, [c.isNotNull() for c in box])  # least and greatest pass over nulls
    return F.when(whole & (high[0] > low[0]) & (high[1] > low[1]), F.struct(low[0].alias("x0"), low[1].alias("top"), high[0].alias("x1"), high[1].alias("bottom")))


def confidence(value: Column) -> Column:
    """F16: clamped to 0 and 1; null (an issue) if not finite."""
    return F.when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")), F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))


def region_texts(detected: DataFrame, recognised: DataFrame) -> DataFrame:
    """Text and least confidence of each region, lines in order of place; a code if recognised lines don't fit.

    detected: region_id, span_id, top, x0. recognised: region_id, span_id, text, score.
    """
    keys = ["region_id", "span_id"]
    twice = recognised.groupBy(*keys).count().filter("count > 1").select("region_id", F.lit("OCR_SPAN_DUPLICATE").alias("code"))
    unknown = recognised.join(detected, keys, "left_anti").select("region_id", F.lit("OCR_SPAN_UNKNOWN").alias("code"))
    codes = twice.union(unknown).groupBy("region_id").agg(F.min("code").alias("code"))
    lines = F.array_sort(F.collect_list(F.struct("top", "x0", "span_id", "text")))
    text = recognised.join(detected, keys).groupBy("region_id").agg(F.array_join(F.transform(lines, lambda x: x["text"]), "\n").alias("text"), F.min("score").alias("confidence"))
    return text.join(codes, "region_id", "full")


def accepted_splits(proposals: DataFrame) -> DataFrame:
    """Proposals (node_id, box_id, box columns, width, height) of the nodes where all may stand, in order of place.

    A child that covers its parent, or two that overlap by more than a twentieth of the smaller, void all of the node's.
    """
    area = lambda p="": (F.col(f"{p}x1") - F.col(f"{p}x0")) * (F.col(f"{p}bottom") - F.col(f"{p}top"))
    whole = proposals.filter(area() >= COVERS * F.col("width") * F.col("height")).select("node_id")
    a, b = proposals.alias("a"), proposals.alias("b")
    w = F.greatest(F.least("a.x1", "b.x1") - F.greatest("a.x0", "b.x0"), F.lit(0.0))
    h = F.greatest(F.least("a.bottom", "b.bottom") - F.greatest("a.top", "b.top"), F.lit(0.0))
    crossing = a.join(b, (F.col("a.node_id") == F.col("b.node_id")) & (F.col("a.box_id") < F.col("b.box_id"))).filter(w * h > OVERLAPS * F.least(area("a."), area("b."))).select(F.col("a.node_id").alias("node_id"))
    lone = proposals.groupBy("node_id").count().filter("count < 2").select("node_id")
    void = whole.union(crossing).union(lone).distinct()
    from pyspark.sql import Window

    return proposals.join(void, "node_id", "left_anti").withColumn("position", F.row_number().over(Window.partitionBy("node_id").orderBy("top", "x0", "box_id")))


def payload_of(regions: DataFrame, payloads: DataFrame) -> DataFrame:
    """(page, region_id, payload_id) by equal id or a box within two pixels, if that names one; else a page's only table."""
    near = reduce(Column.__and__, [F.abs(F.col(f"r.{c}") - F.col(f"p.{c}")) <= NEAR for c in BOX])
    hit = regions.alias("r").join(payloads.alias("p"), (F.col("r.page") == F.col("p.page")) & ((F.col("r.region_id") == F.col("p.payload_id")) | near)).select("r.page", "r.region_id", "p.payload_id")
    one = hit.groupBy("page", "region_id").agg(F.count(F.lit(1)).alias("n"), F.min("payload_id").alias("payload_id")).filter("n = 1").drop("n")
    only = payloads.groupBy("page").agg(F.count(F.lit(1)).alias("n"), F.min("payload_id").alias("only_id")).filter("n = 1").drop("n")
    rest = regions.select("page", "region_id").join(hit.select("page", "region_id").distinct(), ["page", "region_id"], "left_anti").join(only, "page")
    return one.unionByName(rest.withColumnRenamed("only_id", "payload_id"))


def shifted(box: list[Column], offset: list[Column]) -> list[Column]:
    """A box in a crop as a box on the page."""
    return [box[0] + offset[0], box[1] + offset[1], box[2] + offset[0], box[3] + offset[1]]


def review_flags(flags: Column, score: Column, is_formula: Column, low: float = 0.7) -> Column:
    """Flags in order without repeats; formulas take none for text confidence; a missing score is flagged."""
    own = F.when(is_formula, F.filter(flags, lambda f: ~f.rlike("TEXT_CONFIDENCE|LOW_CONFIDENCE"))).otherwise(F.concat(flags, F.when(score.isNull(), F.array(F.lit("OCR_CONFIDENCE_MISSING"))).when(score < low, F.array(F.lit("OCR_LOW_CONFIDENCE"))).otherwise(F.array().cast("array<string>"))))
    return F.array_distinct(own)


def business_view(quantities: DataFrame) -> DataFrame:
    """What two sources must agree on: path, value, text and unit."""
    return quantities.select("case_id", "path", "value", "text", "unit")
