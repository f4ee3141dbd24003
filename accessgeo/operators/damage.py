"""Evidence of damage on lines: approaches, the hit rule for bridges, tunnels and fords, merged sources, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accessgeo.operators.exposure import flooded_length, hit
from accessgeo.session import dealt, shuffled


def _box_distance(x: Column, y: Column, cell: float) -> Column:
    """Distance of a point to the closed cell (row, col)."""
    def beyond(v: Column, k: str) -> Column:
        return F.greatest(F.col(k) * cell - v, v - (F.col(k) + 1) * cell, F.lit(0.0))

    return F.hypot(beyond(x, "col"), beyond(y, "row"))


def _corner_distance(cell: float) -> Column:
    """Least distance of the cell's corners to the segment, which has dx, dy and dd, the square of its length."""
    dx, dy, dd = F.col("dx"), F.col("dy"), F.col("dd")
    each = []
    for a in (0, 1):
        for b in (0, 1):
            px, py = (F.col("col") + a) * cell - F.col("x0"), (F.col("row") + b) * cell - F.col("y0")
            t = F.greatest(F.least(F.when(dd == 0, F.lit(0.0)).otherwise((px * dx + py * dy) / dd), F.lit(1.0)), F.lit(0.0))
            each.append(F.hypot(px - t * dx, py - t * dy))
    return F.least(*each)


def approach_tier(segments: DataFrame, flooded: DataFrame, cell: float, reach: float) -> DataFrame:
    """Highest tier of the cells near a bridge (whole length) or a tunnel (its ends): seg_id, approach.

    The segment's box, wider by `reach`, names the candidate cells, which meet the flooded ones by an equi-join. What is the same for all cells
    of a segment is computed before they are named: Java does not compile a method of more than 8,000 bytes, which the test of all corners else is.
    """
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    special = dealt(segments.where("is_bridge or is_tunnel")).select("seg_id", "x0", "y0", "x1", "y1", "is_tunnel", dx.alias("dx"), dy.alias("dy"), (dx * dx + dy * dy).alias("dd"))
    lo = lambda a, b: F.floor((F.least(a, b) - reach) / cell).cast("int")
    hi = lambda a, b: F.floor((F.greatest(a, b) + reach) / cell).cast("int")
    near = special.withColumn("col", F.explode(F.sequence(lo("x0", "x1"), hi("x0", "x1")))).withColumn("row", F.explode(F.sequence(lo("y0", "y1"), hi("y0", "y1"))))
    ends = F.least(_box_distance(F.col("x0"), F.col("y0"), cell), _box_distance(F.col("x1"), F.col("y1"), cell))
    reached = near.where(F.least(ends, F.when(F.col("is_tunnel"), None).otherwise(_corner_distance(cell))) <= reach).select("seg_id", "row", "col")
    return shuffled(reached).join(flooded.select("row", "col", "tier"), ["row", "col"]).groupBy("seg_id").agg(F.max("tier").alias("approach"))


def line_damage(segments: DataFrame, flooded: DataFrame, cell: float, reach: float = 30, least_m: float = 20, least_share: float = 0.1) -> DataFrame:
    """length, flooded, approach_hit, hit and damage_tier of every segment (seg_id, ends, is_bridge, is_tunnel, is_ford).

    A tunnel counts by its ends only, a bridge also by what floods near it, a ford that is hit is weak evidence.
    """
    met = flooded_length(segments, flooded, cell).withColumn("flooded", F.round("flooded", 6))
    kinds = segments.select("seg_id", "is_bridge", "is_tunnel", "is_ford")
    out = met.join(shuffled(kinds), "seg_id").join(approach_tier(segments, flooded, cell, reach), "seg_id", "left")
    # what a bridge crosses is near it
    approach = F.when(F.col("is_bridge") & ~F.col("is_tunnel"), F.greatest(F.coalesce("approach", F.lit(0)), "tier")).otherwise(F.coalesce("approach", F.lit(0)))
    out = out.withColumn("approach", approach).withColumn("approach_hit", F.col("approach") > 0)
    direct = hit(F.col("length"), F.col("flooded"), least_m, least_share)
    out = out.withColumn("hit", F.when(F.col("is_tunnel"), F.col("approach_hit")).otherwise(direct | (F.col("is_bridge") & F.col("approach_hit"))))
    tier = F.when(~F.col("hit"), 0).when(F.col("is_ford"), 1).otherwise(F.greatest("tier", "approach"))
    return out.select("seg_id", "length", "flooded", "approach_hit", "hit", tier.alias("damage_tier"))


def merged_evidence(flood: DataFrame, candidates: DataFrame) -> DataFrame:
    """Each source qualifies alone: a candidate adds hits of tier 1 and never raises the tier of flood evidence."""
    other = candidates.select("seg_id", F.col("hit").alias("candidate_hit"), F.col("flooded").alias("candidate_m"))
    out = flood.withColumnRenamed("hit", "flood_hit").join(other, "seg_id", "left").withColumn("candidate_hit", F.coalesce("candidate_hit", F.lit(False)))
    source = F.when(F.col("flood_hit"), "flood").when(F.col("candidate_hit"), "debris_candidate").otherwise("none")
    tier = F.when(~F.col("flood_hit") & F.col("candidate_hit"), 1).otherwise(F.col("damage_tier"))
    return out.select("seg_id", "flooded", "candidate_m", "flood_hit", "candidate_hit", (F.col("flood_hit") | F.col("candidate_hit")).alias("hit"), tier.alias("damage_tier"), source.alias("evidence_source"))


def summary(damage: DataFrame, by: str) -> DataFrame:
    """Per class: hits, hits by tier, kilometres of the segments that are hit, and flooded kilometres of all segments."""
    n = lambda c: F.sum(c.cast("long"))
    tiers = [n(F.col("hit") & (F.col("damage_tier") == k)).alias(f"tier{k}") for k in (1, 2, 3)]
    return damage.groupBy(by).agg(F.count(F.lit(1)).alias("segments"), n(F.col("hit")).alias("hits"), *tiers, (F.sum(F.when(F.col("hit"), F.col("length")).otherwise(0.0)) / 1000).alias("hit_km"), (F.sum("flooded") / 1000).alias("flooded_km"))


def inside_polygons(cells: DataFrame, edges: DataFrame, cell: float) -> DataFrame:
    """Distinct cells whose centre lies in a polygon, by the even-odd rule: row, col, poly_id.

    `edges` are (poly_id, x0, y0, x1, y1). An edge meets only the rows whose centre line it crosses, and a polygon's
    crossings of a row are its few edges there. Taken in order, two and two of them enclose the centres between them.
    """
    top, low = F.greatest("y0", "y1"), F.least("y0", "y1")
    crossed = edges.where("y0 <> y1").withColumn("row", F.explode_outer(F.filter(F.sequence(F.floor(low / cell - 0.5).cast("int"), F.floor(top / cell + 0.5).cast("int")), lambda r: ((r + 0.5) * cell >= low) & ((r + 0.5) * cell < top)))).where("row is not null")
    at = F.col("x0") + ((F.col("row") + 0.5) * cell - F.col("y0")) / (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0"))
    along = Window.partitionBy("poly_id", "row").orderBy("x")
    spans = crossed.select("poly_id", "row", at.alias("x")).select("poly_id", "row", F.col("x").alias("x0"), F.lead("x").over(along).alias("x1"), F.row_number().over(along).alias("k")).where("k % 2 = 1 and x0 < x1")
    columns = F.filter(F.sequence(F.floor(F.col("x0") / cell - 0.5).cast("int"), F.ceil(F.col("x1") / cell).cast("int")), lambda c: ((c + 0.5) * cell >= F.col("x0")) & ((c + 0.5) * cell < F.col("x1")))
    return spans.select("poly_id", "row", F.explode(columns).alias("col")).join(shuffled(cells.select("row", "col").distinct()), ["row", "col"]).select("poly_id", "row", "col")
