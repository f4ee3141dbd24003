"""Agreement and calibration of probabilities with labels. Ignored labels are null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counts(label: Column, positive: Column) -> list[Column]:
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return [n((label == 1) & positive).alias("tp"), n((label == 0) & positive).alias("fp"), n((label == 1) & ~positive).alias("fn"), n((label == 0) & ~positive).alias("tn")]


def ratios(df: DataFrame) -> DataFrame:
    """iou, f1, precision, recall, accuracy: 0 where a denominator is 0, null without any pixel."""
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    total = tp + fp + fn + tn
    def share(a: Column, b: Column) -> Column:
        return F.when(total > 0, F.coalesce(F.try_divide(a, b), F.lit(0.0)))
    return df.select("*", share(tp, tp + fp + fn).alias("iou"), share(2 * tp, 2 * tp + fp + fn).alias("f1"), share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(tp + tn, total).alias("accuracy"))


def confusion(rows: DataFrame, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    """Counts and ratios over all rows and, with `by`, each group, in one pass with grouping sets."""
    cells = counts(F.col("label"), F.col("prob") >= threshold)
    out = rows.where(F.col("label").isNotNull())
    return ratios((out.rollup(*by) if by else out.groupBy()).agg(*cells))


def sweep(rows: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """The same over many thresholds. Rows are first counted by probability and label, so that the thresholds multiply few rows."""
    few = rows.where(F.col("label").isNotNull()).groupBy("prob", "label").agg(F.count(F.lit(1)).alias("n"))
    each = few.select("prob", "label", "n", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    up, y = F.col("prob") >= F.col("threshold"), F.col("label")
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return ratios(each.groupBy("threshold").agg(n((y == 1) & up).alias("tp"), n((y == 0) & up).alias("fp"), n((y == 1) & ~up).alias("fn"), n((y == 0) & ~up).alias("tn")))


def best_threshold(swept: DataFrame) -> DataFrame:
    """Highest f1, then nearest to one half, then lowest."""
    t = F.col("threshold")
    return swept.agg(F.max_by("threshold", F.struct("f1", -F.abs(t - 0.5), -t)).alias("threshold"), F.max("f1").alias("f1"))


def reliability(rows: DataFrame, bins: int = 10) -> DataFrame:
    place = F.least(F.floor(F.col("prob") * bins + 1e-9), F.lit(bins - 1)).cast("int")
    return rows.where(F.col("label").isNotNull()).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("prob_pct").alias("prob_pct"), F.sum("label").alias("ones"))


def calibration_error(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal bins; probabilities are whole hundredths here, so sums are exact."""
    gap = F.abs(F.col("prob_pct") / 100 - F.col("ones"))
    return reliability(rows, bins).agg((F.sum(gap) / F.sum("n")).alias("ece"), F.sum("n").cast("long").alias("n"))


def class_balance(rows: DataFrame, by: str) -> DataFrame:
    out = rows.rollup(by).agg(F.sum((F.col("label") == 1).cast("long")).alias("water"), F.sum((F.col("label") == 0).cast("long")).alias("dry"), F.sum(F.col("label").isNull().cast("long")).alias("ignored"))
    known = F.col("water") + F.col("dry")
    return out.select("*", F.try_divide(F.col("dry"), F.col("water")).alias("pos_weight"), F.try_divide(known, 2 * F.col("dry")).alias("weight_dry"), F.try_divide(known, 2 * F.col("water")).alias("weight_water"))


def standardisation(rows: DataFrame, value: Column, low: float, high: float, by: str) -> DataFrame:
    """Mean and population deviation of the clipped values; a deviation below 1e-6 counts as 1."""
    clipped = F.greatest(F.least(value, F.lit(high)), F.lit(low))
    out = rows.select(by, clipped.alias("x")).groupBy(by).agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    return out.withColumn("std", F.when(F.col("std") < 1e-6, 1.0).otherwise(F.col("std")))


def log_loss(rows: DataFrame, weight: float, eps: float = 1e-6) -> DataFrame:
    """Weighted binary cross-entropy and soft Dice loss over the rows that count."""
    p, y = F.greatest(F.least(F.col("prob"), F.lit(1 - eps)), F.lit(eps)), F.col("label")
    bce = F.when(y == 1, -weight * F.log(p)).otherwise(-F.log(1 - p))
    known = rows.where(y.isNotNull())
    return known.agg(F.round(F.avg(bce), 9).alias("bce"), F.round(1 - (2 * F.sum(F.col("prob") * y) + eps) / (F.sum("prob") + F.sum(y) + eps), 9).alias("dice"))


def inspection(rows: DataFrame, value: str, by: str) -> DataFrame:
    """Per group: rows, lowest and highest value, and how often each label and no label stands."""
    n = lambda c: F.sum(c.cast("long"))
    y = F.col("label")
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), n(y.eqNullSafe(1)).alias("ones"), n(y.eqNullSafe(0)).alias("zeros"), n(y.isNull()).alias("no_data"))
