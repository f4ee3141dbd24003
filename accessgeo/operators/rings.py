"""Polygon rings of cell components, and Douglas-Peucker simplification of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accessgeo.operators.fixpoint import components, doubled
from accessgeo.operators.raster import EIGHT, shifted
from accessgeo.session import checkpointed

#: Rows and columns may lie between -REACH and REACH - 1, so that a side of a cell has a 64-bit number.
REACH = 2**29
#: Where the side of a cell above, right, below and left of it begins and ends, clockwise as seen with rows downwards.
CORNERS = [((0, 0), (1, 0)), ((1, 0), (1, 1)), ((1, 1), (0, 1)), ((0, 1), (0, 0))]


def _edge(row: Column, col: Column, side: int) -> Column:
    return (row.cast("long") * (2 * REACH) + col.cast("long") + REACH) * 4 + side


def ring_edges(cells: DataFrame) -> DataFrame:
    """(edge, next, side, comp, x1, y1, x2, y2): the sides of cells (row, col, comp) that part them from cells not in the table, and the side that follows.

    A cell covers x from col to col + 1 and y from row to row + 1; its component lies to the right of the way. Where two cells touch in a
    corner only, the way goes on to the other one: components hold together over corners, as in `label_components`, and holes do not.
    """
    near = shifted(cells.select("row", "col"), EIGHT, []).groupBy("row", "col").agg(F.sum(F.expr("shiftleft(1, k)")).cast("int").alias("near"))
    known = cells.select("row", "col", "comp").join(near, ["row", "col"], "left").withColumn("near", F.coalesce("near", F.lit(0)))
    row, col, sides = F.col("row"), F.col("col"), []
    has = lambda k: F.col("near").bitwiseAND(1 << k) != 0
    for s, (start, end) in enumerate(CORNERS):
        (lr, lc), (rr, rc) = EIGHT[2 * s + 1], EIGHT[(2 * s + 2) % 8]
        after = F.when(has(2 * s + 1), _edge(row + lr, col + lc, (s + 3) % 4)).when(has((2 * s + 2) % 8), _edge(row + rr, col + rc, s)).otherwise(_edge(row, col, (s + 1) % 4))
        places = [(axis + d).cast("long").alias(name) for name, axis, d in (("x1", col, start[0]), ("y1", row, start[1]), ("x2", col, end[0]), ("y2", row, end[1]))]
        sides.append(F.when(~has(2 * s), F.struct(_edge(row, col, s).alias("edge"), after.alias("next"), F.lit(s).alias("side"), *places)))
    return known.select("comp", F.explode(F.array_compact(F.array(*sides))).alias("e")).select("e.*", "comp")


def ring_summary(cells: DataFrame) -> DataFrame:
    """comp, ring, edges, corners, area and hole of each closed ring around the components of cells (row, col, comp).

    The area is the ring's signed shoelace sum: positive for the one outer ring of a component, negative for holes, so the areas of a
    component's rings add up to its cells. A ring is named by its least edge.
    """
    found = checkpointed(ringed(cells))
    turns = found.select(F.col("next").alias("edge"), F.col("side").alias("before"))
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    rows = found.join(turns, "edge").groupBy("comp", "ring").agg(F.count(F.lit(1)).alias("edges"), F.sum((F.col("side") != F.col("before")).cast("long")).alias("corners"), (F.sum(cross) / 2).alias("area"))
    return rows.withColumn("hole", F.col("area") < 0)


def ringed(cells: DataFrame) -> DataFrame:
    """`ring_edges` with `ring`, the least edge of the same ring."""
    edges = checkpointed(ring_edges(cells))
    rings = components(edges.select(F.col("edge").alias("node")), edges.select(F.col("edge").alias("u"), F.col("next").alias("v")))
    return edges.join(rings.select(F.col("node").alias("edge"), F.col("comp").alias("ring")), "edge")


def ring_corners(cells: DataFrame) -> DataFrame:
    """comp, ring, place, x, y: the corners of each ring in order, from the first one on the way from its least edge. Close a ring with its first corner.

    An edge's distance from the ring's least edge comes from pointers backwards that double their reach, so a ring of any length takes
    logarithmically many rounds and no task holds it.
    """
    found = checkpointed(ringed(cells))
    start = found.select(F.col("next").alias("node"), F.when(F.col("next") != F.col("ring"), F.col("edge")).alias("to"), F.col("side").alias("before"), (F.col("next") != F.col("ring")).cast("long").alias("steps"))
    turns = checkpointed(start.select(F.col("node").alias("edge"), "before"))

    def step(now: DataFrame) -> DataFrame:
        there = now.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("steps").alias("steps2"))
        return now.join(there, "to", "left").select("node", F.col("to2").alias("to"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"))

    order = doubled(start.select("node", "to", "steps"), step, "to is not null").select(F.col("node").alias("edge"), "steps")
    corners = found.join(turns, "edge").where("side <> before").join(order, "edge")
    return corners.select("comp", "ring", (F.row_number().over(Window.partitionBy("ring").orderBy("steps")) - 1).alias("place"), F.col("x1").alias("x"), F.col("y1").alias("y"))


def _apart(x: str, y: str) -> Column:
    """Distance of (x, y) from the stretch between (ax, ay) and (bx, by)."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    along = (F.col(x) - F.col("ax")) * dx + (F.col(y) - F.col("ay")) * dy
    square = dx * dx + dy * dy
    share = F.when(square > 0, F.greatest(F.least(along / square, F.lit(1.0)), F.lit(0.0))).otherwise(F.lit(0.0))
    return F.hypot(F.col(x) - F.col("ax") - share * dx, F.col(y) - F.col("ay") - share * dy)


def simplified(points: DataFrame, tolerance: float) -> DataFrame:
    """The points (line, place, x, y) that stay when each line is simplified by Douglas-Peucker: no point is further than `tolerance` from the line left.

    The ends of a line stay. Each stretch between two points that stay is split at its farthest point (the first one on ties) if that lies beyond the
    tolerance; all stretches of all lines are split at once, so there are as many rounds as the deepest tree of splits has levels. Stretches
    without such a point leave the rounds. Points with a null coordinate are left out; a line that ends where it begins is split like any other.
    """
    known = points.where("x is not null and y is not null").select("line", "place", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    ends = known.groupBy("line").agg(F.min(F.struct("place", "x", "y")).alias("a"), F.max(F.struct("place", "x", "y")).alias("b"))
    kept = [checkpointed(ends.select("line", F.explode(F.array_distinct(F.array("a", "b"))).alias("p")).select("line", "p.*"))]
    held = ends.select("line", F.col("a.place").alias("lo"), F.col("b.place").alias("hi"), F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by"))
    inner = checkpointed(known.join(held, "line").where("place > lo and place < hi"))
    while not inner.isEmpty():
        far = inner.groupBy("line", "lo").agg(F.max(F.struct(_apart("x", "y").alias("d"), (-F.col("place")).alias("first"), "x", "y")).alias("f")).where(F.col("f.d") > tolerance)
        far = checkpointed(far.select("line", "lo", (-F.col("f.first")).alias("at"), F.col("f.x").alias("fx"), F.col("f.y").alias("fy")))
        kept.append(far.select("line", F.col("at").alias("place"), F.col("fx").alias("x"), F.col("fy").alias("y")))
        before = F.col("place") < F.col("at")
        pick = lambda low, high, name: F.when(before, low).otherwise(high).alias(name)
        c = F.col
        inner = checkpointed(inner.join(far, ["line", "lo"]).where("place <> at").select(
            "line", "place", "x", "y", pick(c("lo"), c("at"), "lo"), pick(c("at"), c("hi"), "hi"), pick(c("ax"), c("fx"), "ax"), pick(c("ay"), c("fy"), "ay"), pick(c("fx"), c("bx"), "bx"), pick(c("fy"), c("by"), "by")))
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    return out
