"""Lines cut by an area and its context, beside dense sampling."""

from __future__ import annotations

import math
import random

from accessgeo.operators import areas

AREA, CONTEXT = (10, 10, 30, 30), (0, 0, 50, 40)


def inside(box, x, y):
    return box[0] <= x <= box[2] and box[1] <= y <= box[3]


def points_of(spark, lines):
    rows = [(k, i, float(x), float(y), major) for k, (major, line) in enumerate(lines) for i, (x, y) in enumerate(line)]
    return spark.createDataFrame(rows, "line int, idx int, x double, y double, major boolean")


def sampled(lines, steps=2000):
    """Length of each line inside the area, and of major ones in the context outside it, by the middles of short steps."""
    told = {}
    for k, (major, line) in enumerate(lines):
        for (x0, y0), (x1, y1) in zip(line, line[1:]):
            for i in range(steps):
                x, y = x0 + (i + 0.5) / steps * (x1 - x0), y0 + (i + 0.5) / steps * (y1 - y0)
                place = True if inside(AREA, x, y) else False if major and inside(CONTEXT, x, y) else None
                if place is not None:
                    told[k, place] = told.get((k, place), 0) + math.hypot(x1 - x0, y1 - y0) / steps
    return told


def test_lengths_equal_sampling(spark):
    rng = random.Random(5)
    lines = [(k % 3 > 0, [(rng.uniform(-20, 70), rng.uniform(-20, 60)) for _ in range(rng.randint(2, 7))]) for k in range(60)]
    parts = areas.area_parts(points_of(spark, lines), AREA, CONTEXT).cache()
    found = {}
    for r in areas.area_pieces(parts).collect():
        found[r.line, r.in_aoi] = found.get((r.line, r.in_aoi), 0) + r.length
    told = sampled(lines)
    for key in set(found) | set(told):
        assert abs(found.get(key, 0) - told.get(key, 0)) < 0.5, key
    assert areas.out_of_scope(parts, AREA, CONTEXT).count() == 0


def test_pieces_of_known_lines(spark):
    lines = [
        (True, [(5, 20), (20, 20), (20, 20), (35, 20)]),  # in, through a point that is there twice, and out
        (False, [(5, 20), (35, 20)]),  # a minor line has no part outside
        (True, [(5, 5), (6, 5), (60, 5)]),  # outside only, until the context ends
        (True, [(20, 30), (20, 35), (25, 35), (25, 25)]),  # starts on the border, leaves and comes back
        (True, [(12, 10), (28, 10)]),  # along the border: inside
        (True, [(60, 60), (70, 70)]),  # beyond both
        (True, [(20, 20), (20, 20)]),  # without length
    ]
    found = [(r.line, r.piece, r.in_aoi, r.points, r.length, r.x0, r.y0, r.x1, r.y1) for r in areas.area_pieces(areas.area_parts(points_of(spark, lines), AREA, CONTEXT)).orderBy("line", "piece").collect()]
    assert found == [
        (0, 0, True, 4, 20, 10, 20, 30, 20), (0, 1, False, 2, 5, 5, 20, 10, 20), (0, 2, False, 2, 5, 30, 20, 35, 20),
        (1, 0, True, 2, 20, 10, 20, 30, 20),
        (2, 0, False, 3, 45, 5, 5, 50, 5),
        (3, 0, True, 2, 5, 25, 30, 25, 25), (3, 1, False, 4, 15, 20, 30, 25, 30),
        (4, 0, True, 2, 16, 12, 10, 28, 10),
    ]


def test_nulls_single_points_and_empty_tables(spark):
    rows = [(1, 0, 20.0, 20.0, None), (1, 1, None, 5.0, None), (1, 2, 20.0, 40.0, None), (2, 0, 15.0, 15.0, True)]
    points = spark.createDataFrame(rows, "line int, idx int, x double, y double, major boolean")
    assert [(r.line, r.in_aoi, r.length) for r in areas.area_pieces(areas.area_parts(points, AREA, CONTEXT)).collect()] == [(1, True, 10.0)]
    assert areas.area_parts(points.limit(0), AREA, CONTEXT).count() == 0


def test_parts_out_of_scope_are_told(spark):
    rows = [(1, True, 10.0, 10.0, 30.0, 30.0), (2, True, 9.0, 10.0, 30.0, 30.0), (3, False, 0.0, 0.0, 50.0, 40.0), (4, False, 0.0, 0.0, 50.0, 40.1), (5, True, None, 10.0, 30.0, 30.0)]
    parts = spark.createDataFrame(rows, "line int, in_aoi boolean, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r.line for r in areas.out_of_scope(parts, AREA, CONTEXT).collect()) == [2, 4, 5]
