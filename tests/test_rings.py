"""Rings around components, and lines simplified by splitting at their farthest points."""

from __future__ import annotations

import math
import random

import pytest

from accessgeo.operators import raster, rings


def labelled(spark, picture):
    return raster.label_components(spark.createDataFrame([(r - 2, c - 3) for r, line in enumerate(picture) for c, x in enumerate(line) if x == "#"], "row int, col int"))


def outlines(cells):
    out = {}
    for r in sorted(rings.ring_corners(cells).collect(), key=lambda r: r["place"]):
        out.setdefault((r["comp"], r["ring"]), []).append((r["x"], r["y"]))
    return out


def shoelace(p):
    return sum(a * d - c * b for (a, b), (c, d) in zip(p, p[1:] + p[:1], strict=True)) / 2


PICTURES = {
    "hole": ["#####", "#...#", "#.#.#", "#...#", "#####"],
    "corners touch": ["##..", "##..", "..##", "..#.", ".#.."],
    "holes that touch": ["####.", "#.##.", "##.##", "#####"],
    "one": ["#"],
}


@pytest.fixture(scope="module")
def drawn(spark):
    """All pictures and random cells in one table: cells by component, rings, and the corners of each ring."""
    rng = random.Random(8)
    pictures = [*PICTURES.values(), ["".join(rng.choice("##.") for _ in range(18)) for _ in range(15)]]
    cells = labelled(spark, ["".join(p[r].ljust(25, ".") if r < len(p) else "." * 25 for p in pictures) for r in range(15)]).persist()
    count = {}
    for r in cells.collect():
        count[r["comp"]] = count.get(r["comp"], 0) + 1
    return count, rings.ring_summary(cells).collect(), outlines(cells)


def test_areas_add_up_to_the_cells_and_each_component_has_one_outer_ring(drawn):
    count, summary, paths = drawn
    total, outer = dict.fromkeys(count, 0), {}
    for r in summary:
        total[r["comp"]] += r["area"]
        outer[r["comp"]] = outer.get(r["comp"], 0) + (not r["hole"])
        path = paths[r["comp"], r["ring"]]
        assert len(path) == r["corners"] and shoelace(path) == r["area"]
        assert sum(abs(a - c) + abs(b - d) for (a, b), (c, d) in zip(path, path[1:] + path[:1], strict=True)) == r["edges"]
    assert total == count and set(outer.values()) == {1}


def test_holes_are_told_from_outer_rings(drawn):
    found = [(r["area"], r["edges"], r["hole"]) for r in drawn[1]]
    assert {(-9.0, 12, True), (25.0, 20, False)} <= set(found) and found.count((-1.0, 4, True)) >= 2
    assert any(area == 18.0 and not hole for area, _, hole in found)


def test_no_cells(spark):
    empty = spark.createDataFrame([], "row int, col int, comp bigint")
    assert rings.ring_summary(empty).count() == 0 and rings.ring_corners(empty).count() == 0


def apart(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    square = dx * dx + dy * dy
    t = max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / square)) if square else 0.0
    return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)


def split(points, lo, hi, tolerance):
    far = max(range(lo + 1, hi), key=lambda k: (apart(points[k], points[lo], points[hi]), -k), default=None)
    if far is None or apart(points[far], points[lo], points[hi]) <= tolerance:
        return {lo, hi}
    return split(points, lo, far, tolerance) | split(points, far, hi, tolerance)


def test_lines_equal_plain_splitting_and_stay_within_the_tolerance(spark):
    rng = random.Random(2)
    lines = {k: [(float(rng.randint(0, 40)), float(rng.randint(0, 9))) for _ in range(rng.choice([1, 2, 3, 14]))] for k in range(14)}
    lines[20] = lines[5] + [lines[5][0]]  # closed
    lines[21] = [(0.0, 0.0)] * 5
    lines[22] = [(float(k), 0.0 if k % 2 else 2.0) for k in range(12)]
    rows = [(k, i * 3, x, y) for k, p in lines.items() for i, (x, y) in enumerate(p)] + [(7, 1, None, 4.0), (30, 0, None, None)]
    for tolerance in (2.0,):
        kept = {}
        for r in rings.simplified(spark.createDataFrame(rows, "line int, place int, x double, y double"), tolerance).collect():
            kept.setdefault(r["line"], []).append(r["place"] // 3)
        assert {k: sorted(v) for k, v in kept.items()} == {k: sorted(split(p, 0, len(p) - 1, tolerance)) for k, p in lines.items()}
        for k, places in kept.items():
            left = sorted(places)
            for lo, hi in zip(left, left[1:], strict=False):
                assert all(apart(lines[k][i], lines[k][lo], lines[k][hi]) <= tolerance for i in range(lo, hi + 1))
