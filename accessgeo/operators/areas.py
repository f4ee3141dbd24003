"""Areas of interest, raster grids, catalogue items and the rules on their fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accessgeo.session import shuffled

KM_PER_DEGREE = 111.32


def valid_box(w: Column, s: Column, e: Column, n: Column) -> Column:
    """Four finite numbers, west below east and south below north, on the globe. Null and NaN are not valid."""
    finite = F.lit(True)
    for c in (w, s, e, n):
        finite = finite & c.isNotNull() & ~F.isnan(c)
    return F.coalesce(finite & (w >= -180) & (w < e) & (e <= 180) & (s >= -90) & (s < n) & (n <= 90), F.lit(False))


def _km_per_degree_east(lat: Column) -> Column:
    return KM_PER_DEGREE * F.cos(F.radians(lat))


def clamped(boxes: DataFrame, most_km: float = 50) -> DataFrame:
    """Sides of w, s, e, n held to `most_km` around the centre, with `clamped` and `area_km2`."""
    c = F.col
    mid_x, mid_y = (c("w") + c("e")) / 2, (c("s") + c("n")) / 2
    half_x, half_y = most_km / 2 / _km_per_degree_east(mid_y), F.lit(most_km / 2 / KM_PER_DEGREE)
    narrow_x, narrow_y = F.least((c("e") - c("w")) / 2, half_x), F.least((c("n") - c("s")) / 2, half_y)
    out = boxes.select("*", mid_x.alias("cx"), mid_y.alias("cy"), narrow_x.alias("hx"), narrow_y.alias("hy"), ((c("e") - c("w") > 2 * half_x) | (c("n") - c("s") > 2 * half_y)).alias("clamped"))
    out = out.withColumns({"w": c("cx") - c("hx"), "e": c("cx") + c("hx"), "s": c("cy") - c("hy"), "n": c("cy") + c("hy")})
    area = (c("e") - c("w")) * _km_per_degree_east(c("cy")) * (c("n") - c("s")) * KM_PER_DEGREE
    return out.withColumn("area_km2", area).drop("cx", "cy", "hx", "hy")


def expanded(boxes: DataFrame, km: float) -> DataFrame:
    """w, s, e, n moved outward by `km`, measured at the centre's latitude, within the globe."""
    c = F.col
    dx, dy = km / _km_per_degree_east((c("s") + c("n")) / 2), F.lit(km / KM_PER_DEGREE)
    return boxes.withColumns({"w": F.greatest(c("w") - dx, F.lit(-180.0)), "e": F.least(c("e") + dx, F.lit(180.0)), "s": F.greatest(c("s") - dy, F.lit(-90.0)), "n": F.least(c("n") + dy, F.lit(90.0))})


def utm_epsg(lon: Column, lat: Column) -> Column:
    zone = F.least(F.lit(60), F.floor((lon + 180) / 6).cast("int") + 1)
    return F.when(lat >= 0, 32600).otherwise(32700) + zone


def grids(extents: DataFrame, resolution: int = 10, most_px: int = 4_000) -> DataFrame:
    """Raster grid of each metric extent (x0, y0, x1, y1), snapped outward; twice as coarse if it has more than
    `most_px` cells a side, and null if that is not enough."""
    def sides(step: Column) -> tuple[Column, Column]:
        return tuple((F.ceil(F.col(hi) / step) - F.floor(F.col(lo) / step)).cast("int") for lo, hi in (("x0", "x1"), ("y0", "y1")))

    def fits(step: int) -> Column:
        return F.greatest(*sides(F.lit(step))) <= most_px

    step = F.when(fits(resolution), resolution).when(fits(2 * resolution), 2 * resolution)
    out = extents.withColumn("step", step)
    wide, high = sides(F.col("step"))
    return out.select("*", (F.floor(F.col("x0") / F.col("step")) * F.col("step")).alias("left"), (F.ceil(F.col("y1") / F.col("step")) * F.col("step")).alias("top"), wide.alias("width"), high.alias("height"))


def orbit_state(c: Column) -> Column:
    s = F.lower(F.trim(c))
    return F.when(s.isin("ascending", "descending"), s)


def orbit_number(c: Column) -> Column:
    """A whole number above zero, given as a number or as text; anything else is null."""
    n = F.trim(c.cast("string")).try_cast("int")
    return F.when(n > 0, n)


def zoned_time(text: Column, assume_utc: bool) -> Column:
    """Seconds since 1970 of an ISO time. Without a zone it is UTC if `assume_utc`, else null; unreadable text is null."""
    zoned = text.rlike(r"(Z|[+-]\d\d:\d\d)$")
    read = F.when(zoned, text) if not assume_utc else F.when(zoned, text).otherwise(F.concat(text, F.lit("Z")))
    return F.unix_seconds(read.try_cast("timestamp"))


def usable_items(items: DataFrame) -> DataFrame:
    """Catalogue items in interferometric wide mode with both polarisations, a valid orbit and a time; of several
    with one id the last by (time, seq) stays."""
    c = F.col
    sound = items.withColumn("orbit_state", orbit_state(c("orbit_state"))).withColumn("relative_orbit", orbit_number(c("relative_orbit")))
    sound = sound.where((c("mode") == "IW") & F.array_contains("polarisations", "VV") & F.array_contains("polarisations", "VH") & c("orbit_state").isNotNull() & c("relative_orbit").isNotNull() & c("time").isNotNull())
    return sound.groupBy("id").agg(F.max_by(F.struct("time", "orbit_state", "relative_orbit", "assets"), F.struct("time", "seq")).alias("i")).select("id", "i.*")


def matching_items(passes: DataFrame, items: DataFrame) -> DataFrame:
    """Items of the same UTC day, direction and orbit as a pass that have both bands, by an equi-join."""
    have = items.where(F.map_contains_key("assets", "vv") & F.map_contains_key("assets", "vh")).withColumn("day", F.to_date("time"))
    keys = ["orbit_state", "relative_orbit", "day"]
    return passes.select(*keys).join(have.groupBy(*keys).agg(F.count(F.lit(1)).alias("items"), F.min("id").alias("first_item")), keys, "left").select(*keys, F.coalesce("items", F.lit(0)).alias("items"), "first_item")


def mosaic(layers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The first valid value per cell in the order of the items' ids, with the number of valid ones."""
    return layers.groupBy(*keys).agg(F.min_by("value", F.when(F.col("value").isNotNull(), F.col("item"))).alias("value"), F.count("value").alias("valid"), F.count(F.lit(1)).alias("layers"))


def first_answer(attempts: DataFrame, key: str) -> DataFrame:
    """The successful attempt of the best-ranked endpoint for each tile, and how many attempts failed before it."""
    ok = F.when(F.col("ok"), F.struct("rank", "endpoint"))
    out = attempts.groupBy(key).agg(F.min(ok).alias("best"), F.count(F.lit(1)).alias("attempts"), F.sort_array(F.collect_list(F.when(~F.col("ok"), F.col("rank")))).alias("bad"))
    return out.select(key, F.col("best.endpoint").alias("endpoint"), "attempts", F.size(F.filter("bad", lambda r: r < F.coalesce(F.col("best.rank"), F.lit(2**30)))).alias("failed_before"))


def pairing(left: DataFrame, right: DataFrame, split: DataFrame, key: str) -> DataFrame:
    """What is wrong with each chip: without image, without label, not in a split, or in several; sound chips are left out."""
    sides = left.select(key, F.lit(1).alias("i"), F.lit(0).alias("l"), F.lit(0).alias("s")).unionByName(right.select(key, F.lit(0).alias("i"), F.lit(1).alias("l"), F.lit(0).alias("s"))).unionByName(split.select(key, F.lit(0).alias("i"), F.lit(0).alias("l"), F.lit(1).alias("s")))
    sums = sides.groupBy(key).agg(F.sum("i").alias("i"), F.sum("l").alias("l"), F.sum("s").alias("s"))
    state = F.when(F.col("i") == 0, "no image").when(F.col("l") == 0, "no label").when(F.col("s") == 0, "unassigned").when(F.col("s") > 1, "assigned twice")
    return sums.select(key, state.alias("state")).where("state is not null")


def early_stopping(log: DataFrame, patience: int) -> DataFrame:
    """Per run: the best epoch before training stops, that is before `patience` epochs in a row bring no higher score."""
    along = Window.partitionBy("run").orderBy("epoch")
    before = F.max("score").over(along.rowsBetween(Window.unboundedPreceding, -1))
    marked = log.withColumn("better", (before.isNull() | (F.col("score") > before)).cast("int")).withColumn("streak", F.sum("better").over(along))
    stale = marked.withColumn("stale", F.row_number().over(Window.partitionBy("run", "streak").orderBy("epoch")) - 1)
    stopped = F.coalesce(F.max((F.col("stale") >= patience).cast("int")).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ran = stale.withColumn("stopped", stopped).where("stopped = 0")
    return ran.groupBy("run").agg(F.max("epoch").alias("last_epoch"), F.max_by("epoch", F.struct("score", -F.col("epoch"))).alias("best_epoch"), F.max("score").alias("best_score"))


def _inside(box: Sequence[float]) -> tuple[Column, Column]:
    """Range of the parameter (0 to 1) in which a segment (x0, y0, x1, y1) lies in a box (w, s, e, n), border included. Empty if the first is not below the second."""
    c = F.col
    low, high = F.lit(0.0), F.lit(1.0)
    for p, q, a, b in (("x0", "x1", box[0], box[2]), ("y0", "y1", box[1], box[3])):
        d = c(q) - c(p)
        t0, t1 = F.try_divide(a - c(p), d), F.try_divide(b - c(p), d)
        inside = (c(p) >= a) & (c(p) <= b)
        low = F.greatest(low, F.when(d == 0, F.when(inside, 0.0).otherwise(2.0)).otherwise(F.least(t0, t1)))
        high = F.least(high, F.when(d == 0, F.when(inside, 1.0).otherwise(-1.0)).otherwise(F.greatest(t0, t1)))
    return low, high


def _ends() -> list[Column]:
    """Ends of the part of a segment between its parameters t0 and t1."""
    at = lambda v, t: F.col(f"{v}0") + F.col(t) * (F.col(f"{v}1") - F.col(f"{v}0"))
    return [at(v, f"t{k}").alias(f"{v}{k}") for k in (0, 1) for v in ("x", "y")]


def clip_segments(segments: DataFrame, w: float, s: float, e: float, n: float) -> DataFrame:
    """The part of each segment (seg_id, x0, y0, x1, y1) inside a box: its ends and length, by the parameter range that every side leaves."""
    low, high = _inside((w, s, e, n))
    out = segments.withColumn("t0", low).withColumn("t1", high).where("t1 > t0").select("seg_id", *_ends())
    return out.withColumn("length", F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))


def area_parts(points: DataFrame, area: Sequence[float], context: Sequence[float]) -> DataFrame:
    """Parts of the segments of lines (line, idx, x, y, major) inside the area, and of major lines also those inside the context but outside the area:
    line, in_aoi, piece, seg, t0, t1 and ends. Parts that go on where the one before ended belong to one piece.

    Outside is the context's range of parameters less the area's, at most one range on either side of it. Pieces are numbered from 0,
    those in the area first, then by their place along the line; pieces without length go. Points with a null coordinate are left out of their line.
    """
    along = Window.partitionBy("line").orderBy("idx")
    known = points.where("x is not null and y is not null").select("line", "major", "idx", F.col("x").cast("double").alias("x0"), F.col("y").cast("double").alias("y0"))
    segments = known.select("*", F.lead("x0").over(along).alias("x1"), F.lead("y0").over(along).alias("y1"), F.row_number().over(along).alias("seg")).where("x1 is not null")
    (a0, a1), (c0, c1) = _inside(area), _inside(context)
    ranged = segments.select("*", a0.alias("a0"), a1.alias("a1"), c0.alias("c0"), c1.alias("c1"))
    # a point that is there twice makes a range from 0 to 1 in one box, which joins what is before it with what is after it
    still = "(x0 = x1 and y0 = y1)"
    met, wide = f"(a1 > a0 or {still} and a1 >= a0)", "coalesce(major, false)"
    beyond = [("c0", f"if({met}, least(c1, a0), c1)", wide), ("greatest(c0, a1)", "c1", f"{wide} and {met}")]
    shares = [f"struct(true as in_aoi, a0 as t0, a1 as t1, {met} as some)"] + [f"struct(false as in_aoi, {x} as t0, {y} as t1, {on} and {y} > {x} and not ({still} and {met}) as some)" for x, y, on in beyond]
    ranges = f"array({', '.join(shares)})"
    parts = ranged.withColumn("p", F.explode(F.expr(ranges))).where("p.some").select("line", "seg", "x0", "y0", "x1", "y1", "p.in_aoi", "p.t0", "p.t1")
    order = Window.partitionBy("line", "in_aoi").orderBy("seg", "t0")
    goes_on = (F.col("t0") == 0) & (F.lag("t1").over(order) == 1) & (F.lag("seg").over(order) == F.col("seg") - 1)
    run = parts.withColumn("run", F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(order))
    long = run.withColumn("whole", F.sum((F.col("t1") - F.col("t0")) * F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).over(Window.partitionBy("line", "in_aoi", "run"))).where("whole > 0")
    return long.withColumn("piece", F.dense_rank().over(Window.partitionBy("line").orderBy(F.desc("in_aoi"), "run")) - 1).select("line", "in_aoi", "piece", "seg", "t0", "t1", *_ends())


def area_pieces(parts: DataFrame) -> DataFrame:
    """Pieces of `area_parts`: line, piece, in_aoi, number of points, length and the ends."""
    first, last = F.struct("seg", "t0"), F.struct("seg", "t0")
    ends = [F.min_by("x0", first).alias("x0"), F.min_by("y0", first).alias("y0"), F.max_by("x1", last).alias("x1"), F.max_by("y1", last).alias("y1")]
    return parts.groupBy("line", "piece", "in_aoi").agg((F.count(F.lit(1)) + 1).alias("points"), F.sum(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).alias("length"), *ends)


def out_of_scope(parts: DataFrame, area: Sequence[float], context: Sequence[float], slack: float = 1e-8) -> DataFrame:
    """Parts that leave the box they are said to lie in, the area or the context, by more than `slack`, or have no coordinates."""
    def within(box: Sequence[float]) -> Column:
        return F.coalesce(*[F.reduce(F.array(*[(F.col(f"{v}{k}") >= box[i] - slack) & (F.col(f"{v}{k}") <= box[i + 2] + slack) for i, v in enumerate("xy") for k in (0, 1)]), F.lit(True), lambda a, b: a & b), F.lit(False)])

    return parts.where(~F.when(F.col("in_aoi"), within(area)).otherwise(within(context)))


def blended(patches: DataFrame, size: int) -> DataFrame:
    """Overlapping patches put together with Hann weights: (tile_row, tile_col, r, c, value) to (row, col, value)."""
    def hann(k: str) -> Column:
        return F.greatest(F.sin(F.lit(3.141592653589793) * (F.col(k) + 0.5) / size) * F.sin(F.lit(3.141592653589793) * (F.col(k) + 0.5) / size), F.lit(1e-3))

    weight = hann("r") * hann("c")
    sums = patches.select((F.col("tile_row") + F.col("r")).alias("row"), (F.col("tile_col") + F.col("c")).alias("col"), (F.col("value") * weight).alias("vw"), F.when(F.col("value").isNotNull(), weight).alias("w")).groupBy("row", "col").agg(F.sum("vw").alias("vw"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("patches"))
    return sums.select("row", "col", F.try_divide("vw", "w").alias("value"), "patches")


def resampled(cells: DataFrame, targets: DataFrame, value: str) -> DataFrame:
    """Bilinear values at target points (id, fx, fy in cell units, cell centres at whole numbers): four neighbours by an
    equi-join; null if one of those that count is missing."""
    near = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])
    asked = targets.withColumn("x", F.floor("fx").cast("int")).withColumn("y", F.floor("fy").cast("int")).withColumn("d", F.explode(near))
    wx = F.when(F.col("d.a") == 1, F.col("fx") - F.col("x")).otherwise(1 - (F.col("fx") - F.col("x")))
    wy = F.when(F.col("d.b") == 1, F.col("fy") - F.col("y")).otherwise(1 - (F.col("fy") - F.col("y")))
    asked = asked.select("id", (F.col("x") + F.col("d.a")).alias("col"), (F.col("y") + F.col("d.b")).alias("row"), (wx * wy).alias("weight")).where("weight > 0")
    met = asked.join(shuffled(cells.select("row", "col", F.col(value).alias("v"))), ["row", "col"], "left")
    return met.groupBy("id").agg(F.when(F.count("v") == F.count(F.lit(1)), F.sum(F.col("v") * F.col("weight"))).alias(value))
