"""Grouping of radar scenes into passes and choice of the best pair."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accessgeo.session import checkpointed

#: The area of interest in grid units: west, south, east, north.
AREA = (0, 0, 10, 10)


def windows(flood: dt.date, pre_days: int = 60, post_days: int = 12) -> tuple[dt.date, dt.date, dt.date, dt.date]:
    """First and last day of the observation windows before and after the flood day."""
    day = dt.timedelta(days=1)
    return flood - pre_days * day, flood - day, flood, flood + post_days * day


def passes(scenes: DataFrame) -> DataFrame:
    """One row per (orbit_state, relative_orbit, day): scene ids and the covered share of AREA.

    Footprints are boxes on whole grid units. A box is a bit mask of rows for each column of AREA, so the union over a
    pass is a bitwise OR, which is taken before the shuffle like any sum.
    """
    w, s, e, n = AREA
    low, high = F.least(F.greatest("s", F.lit(s)), F.lit(n)) - s, F.least(F.greatest("n", F.lit(s)), F.lit(n)) - s
    rows = F.when(F.col("high") > F.col("low"), F.expr("shiftleft(1L, high) - shiftleft(1L, low)")).otherwise(F.lit(0).cast("long"))
    boxes = scenes.withColumn("low", low).withColumn("high", high).withColumn("rows", rows)
    columns = [F.bit_or(F.when((F.col("w") <= x) & (F.col("e") > x), F.col("rows")).otherwise(F.lit(0).cast("long"))).alias(f"c{x}") for x in range(w, e)]
    found = boxes.groupBy("orbit_state", "relative_orbit", "day").agg(F.array_join(F.array_sort(F.collect_set("id")), ",").alias("ids"), F.count(F.lit(1)).alias("scenes"), *columns)
    covered = sum((F.bit_count(f"c{x}") for x in range(w, e)), F.lit(0))
    return found.select("orbit_state", "relative_orbit", "day", "ids", "scenes", (covered / ((e - w) * (n - s))).alias("coverage"))


#: Footprints of a pass that are laid over each other at once; what of a pass is needed beyond that is cut into tiles of the area.
AT_ONCE = 4_000
#: Footprints with a side in a box that are swept at once; a box of more is halved both ways, down to a 2 ** -DEEPEST of its sides.
SWEPT, DEEPEST = 6, 10
#: Shares that a pass's scenes are dealt into; footprints of a share of which all go on, and how often boxes are halved to find which of more are needed.
SHARES, FEW, COARSE = 8, 64, 8
PASS = ["orbit_state", "relative_orbit", "day"]

Box = tuple[float, float, float, float]


def _boxes(rings: list[np.ndarray], box: Box, deepest: int) -> Iterator[tuple[Box, np.ndarray, bool]]:
    """Boxes in which the union of polygons is settled: the box, numbers of polygons, and whether each of these fills it; else they are all that reach into it.

    A box that one polygon fills is done, and polygons without a side in it are in it wholly or not at all. So boxes are quartered until few sides are left in each, and
    only along the border of the union are polygons laid over each other.
    """
    start, sizes = np.concatenate(rings), np.array([len(r) for r in rings])
    follows, last = np.arange(1, len(start) + 1), np.cumsum(sizes)
    follows[last - 1] = last - sizes
    end, owner = start[follows], np.repeat(np.arange(len(rings)), sizes)
    open_ = [(np.arange(len(start)), tuple(map(float, box)), 0)]
    while open_:
        sides, (x0, y0, x1, y1), depth = open_.pop()
        a, b, own = start[sides], end[sides], owner[sides]
        # sides stand by owner
        first = np.concatenate([[True], own[1:] != own[:-1]])
        names, own = own[first], np.cumsum(first) - 1
        # a side meets the box if their extents meet and the corners are not all on one side of it
        meets = (np.minimum(a, b) <= (x1, y1)).all(1) & (np.maximum(a, b) >= (x0, y0)).all(1)
        turn = [(b[:, 0] - a[:, 0]) * (y - a[:, 1]) - (b[:, 1] - a[:, 1]) * (x - a[:, 0]) for x in (x0, x1) for y in (y0, y1)]
        meets &= (np.minimum.reduce(turn) <= 0) & (np.maximum.reduce(turn) >= 0)
        crossed = np.bincount(own, meets, len(names)) > 0
        x, y = (x0 + x1) / 2, (y0 + y1) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            right = ((a[:, 1] > y) != (b[:, 1] > y)) & (x < a[:, 0] + (y - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1]))
        inside = np.bincount(own, right, len(names)) % 2 == 1
        if (inside & ~crossed).any():
            yield (x0, y0, x1, y1), names[inside & ~crossed], True
            continue
        left = names[crossed]
        if len(left) <= SWEPT or depth == deepest:
            if len(left):
                yield (x0, y0, x1, y1), left, False
            continue
        kept = sides[crossed[own]]
        open_ += [(kept, part, depth + 1) for part in ((x0, y0, x, y), (x, y0, x1, y), (x0, y, x, y1), (x, y, x1, y1))]


def union_area(rings: list[np.ndarray], box: Box) -> float:
    """Area of the union of polygons (rings of x, y, even-odd where a ring crosses itself) inside a box."""
    total = 0.0
    for part, some, filled in _boxes(rings, box, DEEPEST) if rings else ():
        x0, y0, x1, y1 = part
        total += (x1 - x0) * (y1 - y0) if filled else _swept([rings[k] for k in some.tolist()], part)
    return total


def needed(rings: list[np.ndarray], box: Box) -> list[int]:
    """Numbers of polygons whose union is, inside the box, that of all: one for each box that is filled, and those at its border. Of equal ones the first. Of few all
    go on, which costs less than to look."""
    firsts = list({(r + 0.0).tobytes(): k for k, r in reversed(list(enumerate(rings)))}.values())[::-1]
    if len(firsts) <= FEW:
        return firsts
    kept: set[int] = set()
    for _, some, filled in _boxes([rings[k] for k in firsts], box, COARSE):
        if not filled or kept.isdisjoint(some.tolist()):
            kept.update(some[:1].tolist() if filled else some.tolist())
    return [firsts[k] for k in sorted(kept)]


def _swept(rings: list[np.ndarray], box: tuple[float, float, float, float]) -> float:
    """`union_area` by one sweep over all cuts.

    The box is cut where a corner lies or two sides cross, so between two cuts the polygons are trapezoids whose sides do not cross, and the union's
    height in the middle times the width is its area there.
    """
    x0, y0, x1, y1 = box
    start = np.concatenate([*rings, [[x0, y0], [x0, y1]]])
    end = np.concatenate([*[np.roll(r, -1, 0) for r in rings], [[x1, y0], [x1, y1]]])
    owner = np.repeat(np.arange(len(rings) + 1), [*map(len, rings), 2])
    steep = start[:, 0] == end[:, 0]
    low, high = (np.where((start[:, 0] <= end[:, 0])[:, None] == first, start, end)[~steep] for first in (True, False))
    owner = owner[~steep]
    slope = (high[:, 1] - low[:, 1]) / (high[:, 0] - low[:, 0])
    base = low[:, 1] - slope * low[:, 0]
    cuts = [np.array([x0, x1]), low[:, 0], high[:, 0]]
    for k in range(len(low) - 1):
        with np.errstate(divide="ignore", invalid="ignore"):
            x = (base[k + 1 :] - base[k]) / (slope[k] - slope[k + 1 :])
        cuts.append(x[np.isfinite(x) & (x > np.maximum(low[k, 0], low[k + 1 :, 0])) & (x < np.minimum(high[k, 0], high[k + 1 :, 0]))])
    cuts = np.unique(np.concatenate(cuts))
    cuts, total = cuts[(cuts >= x0) & (cuts <= x1)], 0.0
    for left, right in zip(cuts[:-1], cuts[1:], strict=True):
        middle = (left + right) / 2
        met = np.flatnonzero((low[:, 0] <= left) & (high[:, 0] >= right) & (owner < len(rings)))
        y = base[met] + slope[met] * middle
        order = np.lexsort((y, owner[met]))
        span = np.clip(y[order].reshape(-1, 2), y0, y1)
        span = span[np.argsort(span[:, 0])]
        if len(span):
            till = np.maximum.accumulate(span[:, 1])
            total += (right - left) * float(np.maximum(span[:, 1] - np.maximum(span[:, 0], np.concatenate([[y0], till[:-1]])), 0).sum())
    return total


def _corners(x: pa.ListArray, y: pa.ListArray) -> list[np.ndarray]:
    """Rings of x, y from the lists of both."""
    points = np.column_stack([x.flatten().to_numpy(), y.flatten().to_numpy()])
    last = np.cumsum(x.value_lengths().to_numpy())
    return [points[a:b] for a, b in zip([0, *last[:-1].tolist()], last.tolist(), strict=True)] if len(last) else []


def footprint_passes(scenes: DataFrame, area: Box) -> DataFrame:
    """One row per (orbit_state, relative_orbit, day): ids, scenes, platforms, first and last time, and the share of `area` (west, south, east, north) that
    the union of the footprints covers.

    `scenes`: id, orbit_state, relative_orbit, time, platform and ring, the corners of a polygon as array<struct<x, y>>, closed or not. The day is that of
    the time in UTC. Scenes without an id, with another orbit than ascending or descending and a positive number, without a time, or with a ring that is null, holds a null
    or non-finite number or has no area are left out; of several scenes with one id in a pass the latest counts. A pass is dealt into shares, and of at most AT_ONCE footprints
    of a share only those go on whose union is that of all. Equal ones of a pass count once; a pass of which more than AT_ONCE are left is cut into tiles of the area, so that
    a task holds those of a tile.
    """
    w, s, e, n = (float(x) for x in area)
    if not (e > w and n > s):
        raise ValueError("the area must have a positive width and height")
    c = F.col
    of = lambda ring: {k: c(ring)[k].cast("array<double>") for k in "xy"}
    nexts = lambda v: F.concat(F.slice(v, 2, F.size(v)), F.slice(v, 1, 1))
    products = F.zip_with(F.zip_with("x", nexts("y"), lambda p, q: p * q), F.zip_with(nexts("x"), "y", lambda p, q: p * q), lambda p, q: p - q)
    sound = (F.size("ring") >= 3) & F.forall(F.concat("x", "y"), lambda v: F.abs(v) < float("inf")) & (F.aggregate(products, F.lit(0.0), lambda t, v: t + v) != 0)
    known = scenes.select("id", F.lower("orbit_state").alias("orbit_state"), c("relative_orbit").cast("int").alias("relative_orbit"), "time", F.to_date("time").alias("day"), "platform", "ring")
    known = known.where(c("id").isNotNull() & (c("id") != "") & c("orbit_state").isin("ascending", "descending") & (c("relative_orbit") > 0) & c("time").isNotNull())
    # whether a ring is sound is a column found after the shuffle: Spark would put a ring's making into each place where a filter names it
    dealt = known.withColumn("share", F.pmod(F.hash("id"), F.lit(SHARES))).repartition(*PASS, "share").withColumns(of("ring"))
    frames = dealt.withColumn("sound", F.coalesce(sound, F.lit(False))).groupBy(*PASS, "share", "id").agg(F.max(F.struct("sound", "time", "ring", "platform")).alias("f")).where("f.sound")
    frames = frames.sortWithinPartitions(*PASS, "share").select(*PASS, "id", "f.time", "f.platform", *(v.alias(k) for k, v in of("f.ring").items()))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(k) for k in PASS]
            codes = np.array([keys[0].dictionary_encode().indices.to_numpy(), keys[1].to_numpy(), keys[2].cast(pa.int32()).to_numpy()])
            runs = [0, *(np.flatnonzero((codes[:, 1:] != codes[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            cuts = [k for a, b in zip(runs[:-1], runs[1:], strict=True) for k in range(a, b, AT_ONCE)] + [batch.num_rows]
            rings = _corners(batch.column("x"), batch.column("y"))
            kept = [[a + k for k in needed(rings[a:b], area)] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            facts = pa.table({"part": np.repeat(np.arange(len(kept)), np.diff(cuts)), **{k: batch.column(k) for k in ("id", "time", "platform")}})
            facts = facts.group_by("part", use_threads=False).aggregate([("id", "list"), ("time", "min"), ("time", "max"), ("platform", "distinct")]).combine_chunks()
            facts = [facts.column(k).combine_chunks() for k in ("id_list", "platform_distinct", "time_min", "time_max")]
            taken = pa.array([k for ks in kept for k in ks], pa.int64())
            shapes = pa.StructArray.from_arrays([batch.column(k).take(taken) for k in "xy"], ["x", "y"])
            shapes = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, kept)]), pa.int32()), shapes)
            yield pa.RecordBatch.from_arrays([*[k.take(pa.array(cuts[:-1])) for k in keys], *facts, shapes], [*PASS, "ids", "platforms", "earliest", "latest", "rings"])

    made = {k: frames.schema[k].dataType.simpleString() for k in ("id", "platform", "time")}
    parts = checkpointed(frames.mapInArrow(reduce, f"orbit_state string, relative_orbit int, day date, ids array<{made['id']}>, platforms array<{made['platform']}>, earliest {made['time']}, latest {made['time']}, rings array<struct<x: array<double>, y: array<double>>>"))
    ids, platforms = F.flatten(F.collect_list("ids")), F.array_distinct(F.flatten(F.collect_list("platforms")))
    found = parts.groupBy(*PASS).agg(F.array_join(F.sort_array(ids), ",").alias("ids"), F.sum(F.size("ids")).alias("scenes"), F.array_join(F.sort_array(platforms), ",").alias("platforms"), F.min("earliest").alias("earliest"), F.max("latest").alias("latest"))

    shapes = parts.select(*PASS, F.explode("rings").alias("ring")).select(*PASS, "ring.x", "ring.y").distinct()
    cut = shapes.groupBy(*PASS).agg(F.ceil(F.sqrt(F.count(F.lit(1)) / AT_ONCE)).cast("int").alias("side"))

    def tiles(values: str, low: float, high: float) -> Column:
        at = lambda v: F.floor((v - low) / (high - low) * c("side"))
        first, last = F.greatest(at(F.array_min(values)), F.lit(0)), F.least(at(F.array_max(values)), c("side") - 1)
        return F.explode(F.when(first <= last, F.sequence(first.cast("int"), last.cast("int"))).otherwise(F.array().cast("array<int>")))

    laid = shapes.join(cut, PASS).select(*PASS, "side", "x", "y", tiles("x", w, e).alias("i")).select("*", tiles("y", s, n).alias("j"))
    grouped = laid.groupBy(*PASS, "side", "i", "j").agg(F.collect_list(F.struct("x", "y")).alias("rings"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("rings").flatten()
            rings, areas, at = _corners(*(held.field(k) for k in "xy")), [], 0
            for many, side, i, j in zip(batch.column("rings").value_lengths().to_pylist(), *[batch.column(k).to_pylist() for k in ("side", "i", "j")], strict=True):
                box = (w + (e - w) * i / side, s + (n - s) * j / side, w + (e - w) * (i + 1) / side, s + (n - s) * (j + 1) / side)
                areas.append(union_area(rings[at : at + many], box))
                at += many
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in PASS], pa.array(areas, pa.float64())], [*PASS, "area"])

    covered = grouped.mapInArrow(run, "orbit_state string, relative_orbit int, day date, area double").groupBy(*PASS).agg(F.sum("area").alias("area"))
    share = F.least(F.coalesce(c("area"), F.lit(0.0)) / ((e - w) * (n - s)), F.lit(1.0))
    return found.join(covered, PASS, "left").select(*PASS, "ids", "scenes", "platforms", "earliest", "latest", share.alias("coverage"))


def rank_pairs(found: DataFrame, flood: dt.date, least_coverage: float = 0.5, good_coverage: float = 0.95, keep: int = 4) -> DataFrame:
    """The best pairs of one pass before and one after the flood on the same orbit, ranked."""
    a, b, c, d = windows(flood)
    usable = found.where(F.col("coverage") >= least_coverage)
    pre = usable.where(F.col("day").between(a, b)).select("orbit_state", "relative_orbit", F.col("ids").alias("pre_ids"), F.col("coverage").alias("c0"), F.datediff(F.lit(flood), "day").alias("days_before"))
    post = usable.where(F.col("day").between(c, d)).select("orbit_state", "relative_orbit", F.col("ids").alias("post_ids"), F.col("coverage").alias("c1"), F.datediff("day", F.lit(flood)).alias("days_after"))
    pairs = pre.join(post, ["orbit_state", "relative_orbit"]).withColumn("coverage", F.least("c0", "c1"))
    order = [F.col("coverage") < good_coverage, "days_after", "days_before", "orbit_state", "relative_orbit", "pre_ids", "post_ids"]
    best = pairs.orderBy(*order).limit(keep)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("rank", "orbit_state", "relative_orbit", "days_before", "days_after", "coverage", "pre_ids", "post_ids")
