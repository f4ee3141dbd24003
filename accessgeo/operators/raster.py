"""Pixel tables: classification, morphology, focal filters.

A pixel table has one row per cell with `row` and `col`; a value that is not valid is null, never NaN.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accessgeo.operators.fixpoint import components
from accessgeo.session import checkpointed, shuffled

#: The eight neighbours in the order N, NE, E, SE, S, SW, W, NW.
EIGHT = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def classify(pixels: DataFrame, threshold: float = 0.6, pre_threshold: float | None = None, hand_max: float = 15, slope_max: float = 20, change_db: float = 3) -> DataFrame:
    """Water, terrain and change masks from p_post, p_pre, hand, slope, dvv, dvh and valid."""
    pre = threshold if pre_threshold is None else pre_threshold
    c = F.col
    return (
        pixels.withColumn("water_post", _true(c("valid") & (c("p_post") >= threshold)))
        .withColumn("water_pre", _true(c("valid") & (c("p_pre") >= pre)))
        .withColumn("preexisting", c("water_post") & c("water_pre"))
        .withColumn("new_water", c("water_post") & ~c("water_pre"))
        .withColumn("plausible", _true((c("hand") <= hand_max) & (c("slope") <= slope_max)))
        .withColumn("excluded", c("new_water") & ~c("plausible"))
        .withColumn("support", _true(c("valid") & ((c("dvv") <= -change_db) | (c("dvh") <= -change_db))))
    )


def tier(flood: Column, threshold: float = 0.6, post_min: float = 0.8, pre_max: float = 0.2) -> Column:
    """3 strong, 2 probable, 1 uncertain, 0 no flood."""
    c = F.col
    strong = flood & c("plausible") & c("support") & (c("p_post") >= max(threshold, post_min)) & (c("p_pre") < pre_max)
    probable = flood & c("new_water") & c("plausible") & (c("support") | (c("p_post") >= post_min))
    return F.when(_true(strong), 3).when(_true(probable), 2).when(flood, 1).otherwise(0)


def shifted(cells: DataFrame, offsets: list[tuple[int, int]], keep: list[str]) -> DataFrame:
    """Each cell's neighbours at the offsets: row, col, k (place in `offsets`) and the neighbour's columns, one row for each neighbour that exists."""
    steps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, (a, b) in enumerate(offsets)])
    moved = cells.select("row", "col", *keep, F.explode(steps).alias("s"))
    return shuffled(moved.select((F.col("row") - F.col("s.a")).alias("row"), (F.col("col") - F.col("s.b")).alias("col"), F.col("s.k").alias("k"), *keep))


def cell_number(row: str, col: str) -> Column:
    """One number for a cell, in the order of rows and columns; both may be any 32-bit integers."""
    return F.col(row).cast("long") * 2**32 + F.col(col).cast("long")


def label_components(cells: DataFrame) -> DataFrame:
    """8-connected components of the rows of (row, col): row, col, comp (the least cell number in it)."""
    named = cells.select("row", "col", cell_number("row", "col").alias("node"))
    near = shifted(named, EIGHT[:4], ["node"]).withColumnRenamed("node", "v").drop("k")
    edges = named.join(near, ["row", "col"]).select(F.col("node").alias("u"), "v")
    return shuffled(named).join(components(named.select("node"), edges), "node").select("row", "col", "comp")


def remove_small(cells: DataFrame, least: int) -> DataFrame:
    """Labelled cells with `size` and `kept`: components of at least `least` cells stay."""
    found = label_components(cells)
    sizes = found.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    return found.join(sizes, "comp").withColumn("kept", F.col("size") >= least)


def fill_holes(grid: DataFrame, flood: DataFrame, most: int) -> DataFrame:
    """Cells of enclosed holes of fewer than `most` cells: row, col, filled (else blocked by a cell that may not fill).

    `grid` has all cells with `eligible`; holes are 8-connected like components, and one that touches the border
    of the grid is open.
    """
    dry = grid.join(flood.select("row", "col"), ["row", "col"], "left_anti")
    edge = grid.agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    found = label_components(dry).join(dry.select("row", "col", "eligible"), ["row", "col"]).join(F.broadcast(edge))
    border = (F.col("row") == F.col("r0")) | (F.col("row") == F.col("r1")) | (F.col("col") == F.col("c0")) | (F.col("col") == F.col("c1"))
    holes = found.groupBy("comp").agg(F.count(F.lit(1)).alias("size"), F.bool_or(border).alias("open"), F.bool_and("eligible").alias("filled")).where((F.col("size") < most) & ~F.col("open"))
    return found.join(holes.select("comp", "filled"), "comp").select("row", "col", "filled")


def fill_voids(cells: DataFrame, z: str, most: int = 16) -> DataFrame:
    """row, col and `z`, where enclosed voids (null cells, 8-connected) of at most `most` cells are filled.

    A filled cell is the mean of its four neighbours, filled ones included, so a plane is continued exactly. Voids that are larger or
    touch the border of the grid, where a cell has no neighbour on some side, stay. A group is one void, so a task solves systems of at most `most` unknowns.
    """
    around = shifted(cells.select("row", "col", F.col(z).alias("zn"), F.col("row").alias("at_row"), F.col("col").alias("at_col")), EIGHT[::2], ["zn", "at_row", "at_col"])
    met = label_components(cells.where(F.col(z).isNull())).select("row", "col", "comp").join(around, ["row", "col"], "left")
    counted = met.groupBy("comp", "row", "col").agg(F.count("at_row").alias("beside"))
    small = counted.groupBy("comp").agg(F.count(F.lit(1)).alias("n"), F.min("beside").alias("beside")).where((F.col("n") <= most) & (F.col("beside") == 4))
    inside = met.join(small.select("comp"), "comp")

    def solved(group: pd.DataFrame) -> pd.DataFrame:
        places = {p: k for k, p in enumerate(dict.fromkeys(zip(group["row"], group["col"], strict=True)))}
        a, b = np.zeros((len(places), len(places))), np.zeros(len(places))
        for row, col, at_row, at_col, value in group[["row", "col", "at_row", "at_col", "zn"]].itertuples(index=False):
            k = places[(row, col)]
            a[k, k] += 1
            if (at_row, at_col) in places:
                a[k, places[(at_row, at_col)]] -= 1
            else:
                b[k] += value
        return pd.DataFrame({"row": [p[0] for p in places], "col": [p[1] for p in places], "filled": np.linalg.solve(a, b)})

    filled = inside.groupBy("comp").applyInPandas(solved, "row int, col int, filled double")
    return cells.select("row", "col", F.col(z).alias("z")).join(shuffled(filled), ["row", "col"], "left").select("row", "col", F.coalesce("z", "filled").alias(z))


def near(cells: DataFrame, reach: float) -> DataFrame:
    """Distinct cells whose centre is at most `reach` cells from one of `cells`.

    A cell sends one span of columns to each row that its disk meets; in a row, in order, a span gives the columns that no span before it reached.
    """
    r = int(reach)
    widths = [(a, max(b for b in range(r + 1) if a * a + b * b <= reach * reach)) for a in range(-r, r + 1)]
    sent = cells.select("row", "col", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(w).alias("w")) for a, w in widths])).alias("s"))
    spans = sent.select((F.col("row") + F.col("s.a")).alias("row"), (F.col("col") - F.col("s.w")).alias("lo"), (F.col("col") + F.col("s.w")).alias("hi"))
    before = F.max("hi").over(Window.partitionBy("row").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1))
    fresh = spans.withColumn("lo", F.greatest("lo", before + 1)).where("lo <= hi")
    return fresh.select("row", F.explode(F.sequence("lo", "hi")).alias("col"))


def _spread_along(parts: DataFrame, by: str, low: str, high: str, radius: int) -> DataFrame:
    """Each row once for every place along `by` (between `low` and `high`) in whose window it lies, as often as the mirrored grid shows it there."""
    at = F.col(by)
    seen = F.array_compact(F.array(at, F.when(at < F.col(low) + radius, 2 * F.col(low) - at - 1), F.when(at > F.col(high) - radius, 2 * F.col(high) - at + 1)))
    steps = F.array(*[F.lit(k) for k in range(-radius, radius + 1)])
    moved = F.flatten(F.transform(seen, lambda p: F.transform(steps, lambda k: p + k)))
    return parts.withColumn(by, F.explode(F.filter(moved, lambda p: (p >= F.col(low)) & (p <= F.col(high)))))


def box_statistics(cells: DataFrame, value: str, radius: int) -> DataFrame:
    """row, col, x (the value), mean and variance of the valid values around each cell; beyond the border the grid is mirrored with its edge repeated.

    Windows are summed along columns first and then along rows, so a cell travels 2 (2 radius + 1) times and not (2 radius + 1)^2 times. Parts
    are put together by their counts, means and squared deviations, which do not cancel. The cells themselves go along, so no join is needed.
    """
    edge = F.broadcast(cells.agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1")))
    bounds = ["r0", "r1", "c0", "c1"]
    x = cells.select("row", "col", F.col(value).cast("double").alias("x")).join(edge)
    across = _spread_along(x.where("x is not null"), "col", "c0", "c1", radius).groupBy("row", "col", *bounds).agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    parts = _spread_along(across, "row", "r0", "r1", radius).select("row", "col", F.struct("n", "m", "v").alias("part"), F.lit(None).cast("double").alias("x"), F.lit(0).alias("own"))
    own = x.select("row", "col", F.lit(None).cast(parts.schema["part"].dataType).alias("part"), "x", F.lit(1).alias("own"))
    # 2 radius + 1 parts at most, one for each row of the window
    met = parts.unionByName(own).groupBy("row", "col").agg(F.collect_list("part").alias("parts"), F.max("x").alias("x"), F.max("own").alias("own")).where("own = 1")
    total = lambda f: F.aggregate("parts", F.lit(0.0), lambda s, p: s + f(p))
    counted = met.withColumn("n", total(lambda p: p.n)).withColumn("mean", F.try_divide(total(lambda p: p.n * p.m), F.col("n")))
    return counted.select("row", "col", "x", "mean", F.try_divide(total(lambda p: p.n * (p.v + (p.m - F.col("mean")) * (p.m - F.col("mean")))), F.col("n")).alias("variance"))


def exact_quantile(values: DataFrame, name: str, share: float, bins: int = 4096) -> float | None:
    """The quantile of a column, linear between two ranks; null and what is not finite are left out, None without values.

    Each round counts the values in equal ranges between the least and the greatest that are left and goes on in the range that holds the rank.
    So `bins` rows a round come to the driver, and at last the values of one range if it has no more than that; no task holds the column.
    """
    known = values.select(F.col(name).cast("double").alias("v")).where("abs(v) < double('infinity')")
    low, high, n = known.agg(F.min("v"), F.max("v"), F.count("v")).first()
    if not n:
        return None
    place = share * (n - 1)
    rank, part = int(place), place - int(place)
    below, after = 0, None
    while low < high:
        at = F.least(F.floor((F.col("v") - low) / (high - low) * bins), F.lit(bins - 1))
        found = sorted(known.where((F.col("v") >= low) & (F.col("v") <= high)).groupBy(at.alias("k")).agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect(), key=lambda r: r.k)
        for i, r in enumerate(found):
            if below + r.n > rank:
                break
            below += r.n
        after = found[i + 1].low if i + 1 < len(found) else after
        low, high = r.low, r.high
        if r.n <= bins:
            last = sorted(x.v for x in known.where((F.col("v") >= low) & (F.col("v") <= high)).collect())
            one = last[rank - below]
            two = last[rank - below + 1] if rank - below + 1 < len(last) else after
            return one + part * (two - one) if part else one
        n = below + r.n
    two = low if rank + 1 < n else after
    return low + part * (two - low) if part else low


def lee_filter(cells: DataFrame, value: str, window: int = 5) -> DataFrame:
    """Speckle filter: each value moves towards its window's mean, the more the less its window varies.

    The noise level is the 25 % quantile of variance / mean**2 over the grid, one number.
    """
    stats = checkpointed(box_statistics(cells, value, window // 2).withColumn("ratio", F.expr("case when mean <> 0 and x is not null then variance / (mean * mean) end")))
    noise = F.lit(exact_quantile(stats, "ratio", 0.25)).cast("double")
    spread = noise * F.col("mean") * F.col("mean")
    signal = F.greatest((F.col("variance") - spread) / (1 + noise), F.lit(0.0))
    weight = F.when(signal + spread > 0, signal / (signal + spread)).otherwise(0.0)
    return stats.select("row", "col", F.when(F.col("x").isNotNull(), F.col("mean") + weight * (F.col("x") - F.col("mean"))).alias(value))


def slope_degrees(cells: DataFrame, z: str, resolution: float) -> DataFrame:
    """Slope from centred differences, one-sided at the border of the grid; null in a void and where a neighbour that is needed is null or absent."""
    edge = F.broadcast(cells.agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1")))

    def gradient(by: str, along: str, first: str, last: str) -> Column:
        w = Window.partitionBy(by).orderBy(along)
        low = F.when(F.lag(along).over(w) == F.col(along) - 1, F.lag(z).over(w))
        high = F.when(F.lead(along).over(w) == F.col(along) + 1, F.lead(z).over(w))
        return F.when(F.col(along) == F.col(first), high - F.col(z)).when(F.col(along) == F.col(last), F.col(z) - low).otherwise((high - low) / 2) / resolution

    steepest = F.degrees(F.atan(F.hypot(gradient("row", "col", "c0", "c1"), gradient("col", "row", "r0", "r1"))))
    return cells.join(edge).select("row", "col", F.when(F.col(z).isNotNull(), steepest).alias("slope"))


def receivers(cells: DataFrame, z: str) -> DataFrame:
    """The neighbour with the steepest descent of each cell (first of EIGHT on ties), null for pits: row, col, to_row, to_col."""
    around = shifted(cells.select("row", "col", F.col(z).alias("zn"), F.col("row").alias("to_row"), F.col("col").alias("to_col")), EIGHT, ["zn", "to_row", "to_col"])
    drop = (F.col(z) - F.col("zn")) / F.when(F.col("k") % 2 == 1, F.sqrt(F.lit(2.0))).otherwise(F.lit(1.0))
    best = cells.join(around, ["row", "col"]).where(F.col("zn") < F.col(z)).groupBy("row", "col").agg(F.max(F.struct(drop.alias("drop"), (-F.col("k")).alias("first"), "to_row", "to_col")).alias("b"))
    return cells.select("row", "col").join(shuffled(best), ["row", "col"], "left").select("row", "col", F.col("b.to_row").alias("to_row"), F.col("b.to_col").alias("to_col"))


def power_to_db(power: Column) -> Column:
    """10 log10 of a positive finite power, held within -35 and 5; null otherwise."""
    return F.when((power > 0) & (power < float("inf")), F.greatest(F.least(10 * F.log10(power), F.lit(5.0)), F.lit(-35.0)))


def flood_statistics(cells: DataFrame, resolution: float = 10) -> DataFrame:
    """One row of counts and areas over a classified table with `tier`."""
    n = lambda name: F.sum(F.col(name).cast("long")).alias(name + "_px")
    km2 = resolution * resolution / 1e6
    sums = cells.agg(*[n(x) for x in ("water_post", "water_pre", "preexisting", "new_water", "excluded", "valid")], F.count(F.lit(1)).alias("cells"), *[F.sum((F.col("tier") == k).cast("long")).alias(f"tier{k}_px") for k in (1, 2, 3)], F.sum(F.col("hand").isNull().cast("long")).alias("hand_missing_px"))
    flood = F.col("tier1_px") + F.col("tier2_px") + F.col("tier3_px")
    return sums.withColumn("flood_px", flood).withColumn("flood_km2", flood * km2).withColumn("preexisting_km2", F.col("preexisting_px") * km2).withColumn("valid_fraction", F.col("valid_px") / F.col("cells")).withColumn("flood_fraction_of_valid", F.when(F.col("valid_px") > 0, flood / F.col("valid_px")))
