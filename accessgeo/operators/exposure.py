"""Overlap of lines and boxes with flooded cells, and the hit rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accessgeo.session import dealt, shuffled


def segment_cells(segments: DataFrame, cell: float) -> DataFrame:
    """Length of each segment (seg_id, x0, y0, x1, y1) inside every cell it may touch: seg_id, row, col, length.

    The segment's box names the candidate cells; the clipped part comes from its parameter range in the cell.
    """
    c = F.col
    lo = lambda a, b: F.floor(F.least(a, b) / cell).cast("int")
    hi = lambda a, b: F.floor(F.greatest(a, b) / cell).cast("int")
    out = dealt(segments).withColumn("col", F.explode(F.sequence(lo("x0", "x1"), hi("x0", "x1")))).withColumn("row", F.explode(F.sequence(lo("y0", "y1"), hi("y0", "y1"))))
    low, high = F.lit(0.0), F.lit(1.0)
    for p, q, k in (("x0", "x1", "col"), ("y0", "y1", "row")):
        d = c(q) - c(p)
        t0, t1 = (c(k) * cell - c(p)) / d, ((c(k) + 1) * cell - c(p)) / d
        low = F.greatest(low, F.when(d == 0, F.lit(0.0)).otherwise(F.least(t0, t1)))
        high = F.least(high, F.when(d == 0, F.lit(1.0)).otherwise(F.greatest(t0, t1)))
    part = F.greatest(high - low, F.lit(0.0)) * F.hypot(c("x1") - c("x0"), c("y1") - c("y0"))
    return out.select("seg_id", "row", "col", part.alias("length")).where("length > 0")


def flooded_length(segments: DataFrame, flooded: DataFrame, cell: float) -> DataFrame:
    """seg_id, length, flooded, tier over cells (row, col, tier) by an equi-join on the cell."""
    met = shuffled(segment_cells(segments, cell)).join(flooded.select("row", "col", "tier"), ["row", "col"])
    found = met.groupBy("seg_id").agg(F.sum("length").alias("flooded"), F.max("tier").alias("tier"))
    whole = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).alias("length")
    return segments.select("seg_id", whole).join(found, "seg_id", "left").fillna(0.0, ["flooded"]).fillna(0, ["tier"])


def hit(length: Column, flooded: Column, least_m: float = 20, least_share: float = 0.1) -> Column:
    return (flooded > 0) & ((flooded >= least_m) | (flooded / length >= least_share))


def box_tier(boxes: DataFrame, flooded: DataFrame, cell: float) -> DataFrame:
    """Highest tier of the cells that a box (box_id, x0, y0, x1, y1) touches, 0 if none."""
    f = lambda x: F.floor(F.col(x) / cell).cast("int")
    cells = boxes.withColumn("col", F.explode(F.sequence(f("x0"), f("x1")))).withColumn("row", F.explode(F.sequence(f("y0"), f("y1"))))
    found = shuffled(cells).join(flooded.select("row", "col", "tier"), ["row", "col"]).groupBy("box_id").agg(F.max("tier").alias("tier"))
    return boxes.select("box_id").join(found, "box_id", "left").fillna(0, ["tier"])


def line_samples(segments: DataFrame, flooded: DataFrame, cell: float) -> DataFrame:
    """Tiers under points at half-cell spacing along each segment: seg_id, samples, wet, median."""
    n = F.greatest(F.ceil(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / (cell / 2)), F.lit(1)).cast("int")
    at = segments.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n")))).withColumn("t", F.col("i") / F.col("n"))
    at = at.select("seg_id", F.floor((F.col("y0") + F.col("t") * (F.col("y1") - F.col("y0"))) / cell).cast("int").alias("row"), F.floor((F.col("x0") + F.col("t") * (F.col("x1") - F.col("x0"))) / cell).cast("int").alias("col"))
    seen = shuffled(at).join(flooded.select("row", "col", "tier"), ["row", "col"], "left")
    return seen.groupBy("seg_id").agg(F.count(F.lit(1)).alias("samples"), F.count("tier").alias("wet"), F.coalesce(F.expr("percentile(tier, 0.5)"), F.lit(0.0)).alias("median_tier"))
