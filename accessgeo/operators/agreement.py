"""Agreement of a predicted with a reference extent, strict and within a tolerance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accessgeo.operators.raster import near


def strict(cells: DataFrame) -> DataFrame:
    """Counts over (pred, ref, valid); a ratio without cells is 0."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    p, r = F.col("pred"), F.col("ref")
    out = cells.where("valid").agg(n(p & r).alias("tp"), n(p & ~r).alias("fp"), n(~p & r).alias("fn"), n(~p & ~r).alias("tn"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.select("*", share(tp, tp + fp + fn).alias("iou"), share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"))


def tolerant(cells: DataFrame, reach: float) -> DataFrame:
    """Share of predicted cells within `reach` cells of the reference, and the other way round."""
    pred, ref = cells.where("valid and pred").select("row", "col"), cells.where("valid and ref").select("row", "col")
    a = pred.join(near(ref, reach), ["row", "col"], "left_semi").agg(F.count(F.lit(1)).alias("pred_near"))
    b = ref.join(near(pred, reach), ["row", "col"], "left_semi").agg(F.count(F.lit(1)).alias("ref_near"))
    sums = cells.where("valid").agg(F.sum(F.col("pred").cast("long")).alias("pred"), F.sum(F.col("ref").cast("long")).alias("ref"))
    out = sums.join(F.broadcast(a)).join(F.broadcast(b))
    return out.select("*", F.coalesce(F.try_divide("pred_near", "pred"), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide("ref_near", "ref"), F.lit(0.0)).alias("recall"))
