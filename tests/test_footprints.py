"""Unions of footprints beside counting on a fine grid."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest

from accessgeo.operators import scenes


def counted(rings, box, n=400):
    """Share of an n x n grid of points in the box that lies in a polygon, times its area."""
    x0, y0, x1, y1 = box
    x, y = np.meshgrid(x0 + (np.arange(n) + 0.5) * (x1 - x0) / n, y0 + (np.arange(n) + 0.5) * (y1 - y0) / n)
    inside = np.zeros(x.shape, bool)
    for ring in rings:
        odd = np.zeros(x.shape, bool)
        for (ax, ay), (bx, by) in zip(ring, np.roll(ring, -1, 0), strict=True):
            if ay != by:
                odd ^= ((ay > y) != (by > y)) & (x < ax + (y - ay) * (bx - ax) / (by - ay))
        inside |= odd
    return inside.mean() * (x1 - x0) * (y1 - y0)


def quad(rng):
    x, y, a, b, slant = rng.uniform(-3, 8), rng.uniform(-3, 8), rng.uniform(0.5, 6), rng.uniform(0.5, 6), rng.uniform(-2, 2)
    return np.array([(x, y), (x + a, y + slant), (x + a + slant, y + b), (x + slant / 2, y + b)])


@pytest.mark.parametrize("seed", range(8))
def test_union_equals_counting(seed):
    rng = random.Random(seed)
    rings, box = [quad(rng) for _ in range(rng.randint(1, 9))], (0.5, -0.25, 7.75, 6.5)
    assert abs(scenes.union_area(rings, box) - counted(rings, box)) < 0.15


def test_exact_unions():
    square = np.array([(0.0, 0.0), (2, 0), (2, 2), (0, 2)])
    box = (-1.0, -1.0, 5.0, 5.0)
    assert scenes.union_area([square, square, square + 1], box) == pytest.approx(7)
    assert scenes.union_area([np.array([(0.0, 0.0), (4, 0), (0, 4)]), np.array([(4.0, 4.0), (0, 4), (4, 0)])], box) == pytest.approx(16)
    assert scenes.union_area([square - 10], box) == 0 and scenes.union_area([square[::-1]], (0.0, 0.0, 1.0, 1.0)) == pytest.approx(1)


def test_passes_of_many_footprints_and_of_bad_ones(spark, monkeypatch):
    rng = random.Random(3)
    area, day = (0.0, 0.0, 8.0, 7.0), dt.datetime(2020, 8, 9, 23, 50)
    rings = [quad(rng).tolist() for _ in range(30)]
    rows = [(f"s{k:02}", "ASCENDING", 4, day + dt.timedelta(seconds=k), "A" if k % 2 else "B", r) for k, r in enumerate(rings)]
    rows += [("s00", "ascending", 4, day - dt.timedelta(hours=1), "C", quad(rng).tolist()), ("late", "ascending", 4, day + dt.timedelta(hours=1), "A", rings[0]), (None, "ascending", 4, day, "A", rings[0]), ("x", "sideways", 4, day, "A", rings[0]), ("y", "ascending", 0, day, "A", rings[0])]
    rows += [("line", "ascending", 4, day, "A", [[0.0, 0.0], [1.0, 1.0], [2.0, 2.0]]), ("none", "ascending", 4, day, "A", None), ("nan", "ascending", 4, day, "A", [[0.0, 0.0], [float("nan"), 1.0], [2.0, 0.0]]), ("far", "descending", 4, day, None, [[90.0, 90.0], [91.0, 90.0], [91.0, 91.0]])]
    made = [(*r[:5], r[5] and [(float(x), float(y)) for x, y in r[5]]) for r in rows]
    df = spark.createDataFrame(made, "id string, orbit_state string, relative_orbit int, time timestamp, platform string, ring array<struct<x:double,y:double>>")
    for at_once in (24, 2):
        monkeypatch.setattr(scenes, "AT_ONCE", at_once)
        found = {(r["orbit_state"], str(r["day"])): r for r in scenes.footprint_passes(df, area).collect()}
        assert set(found) == {("ascending", "2020-08-09"), ("ascending", "2020-08-10"), ("descending", "2020-08-09")}
        one = found["ascending", "2020-08-09"]
        assert (one["scenes"], one["platforms"], found["descending", "2020-08-09"]["coverage"]) == (30, "A,B", 0.0)
        assert one["coverage"] * 56 == pytest.approx(scenes.union_area([np.array(r) for r in rings], area))
    with pytest.raises(ValueError, match="area"):
        scenes.footprint_passes(df, (0, 0, 0, 1))


def test_many_large_footprints_are_swept_by_few(monkeypatch):
    """Hundreds of footprints over each other: no sweep holds more than a few, and the area is that of one sweep over all."""
    rng = random.Random(3)
    rings, box = [quad(rng) * 0.6 for _ in range(60)], (-0.75, 0.4, 9.5, 8.25)
    whole, sizes = scenes._swept(rings, box), []
    swept = scenes._swept
    monkeypatch.setattr(scenes, "_swept", lambda few, part: sizes.append(len(few)) or swept(few, part))
    assert scenes.union_area(rings, box) == pytest.approx(whole, abs=1e-10)
    assert sorted(sizes)[len(sizes) * 9 // 10] <= scenes.SWEPT


def frame(rings):
    """Scenes s0, s1, ... of one pass."""
    at = dt.datetime(2020, 8, 9, 12)
    return [(f"s{k}", "ascending", 4, at, "A", [(float(x), float(y)) for x, y in r]) for k, r in enumerate(rings)]


SCHEMA = "id string, orbit_state string, relative_orbit int, time timestamp, platform string, ring array<struct<x:double,y:double>>"


@pytest.mark.parametrize("seed", range(6))
def test_needed_footprints_have_the_union_of_all(monkeypatch, seed):
    rng = random.Random(seed)
    monkeypatch.setattr(scenes, "FEW", 0)
    rings, box = [quad(rng) * rng.choice((0.3, 0.6, 1)) for _ in range(rng.choice((3, 40, 150)))], (-0.75, 0.4, 9.5, 8.25)
    kept = scenes.needed([*rings, *rings], box)
    assert max(kept) < len(rings) and len(set(kept)) == len(kept)
    assert scenes.union_area([rings[k] for k in kept], box) == pytest.approx(scenes.union_area(rings, box), abs=1e-9)
    assert scenes.needed([], box) == [] and scenes.needed([rings[0] + 100], box) == []


def test_large_footprints_are_not_laid_in_every_tile(spark, monkeypatch):
    """1,600 footprints that all reach into each of the four tiles of a pass of more than AT_ONCE: those that add nothing to the union do not get there."""
    rng = random.Random(5)
    rings, area = [np.array([(rng.uniform(0, 40), rng.uniform(0, 40)), (rng.uniform(60, 100), rng.uniform(0, 40)), (rng.uniform(60, 100), rng.uniform(60, 100)), (rng.uniform(0, 40), rng.uniform(60, 100))]) for _ in range(1600)], (0.0, 0.0, 100.0, 100.0)
    df = spark.createDataFrame(frame(rings), SCHEMA)
    monkeypatch.setattr(scenes, "AT_ONCE", 1000)
    one = scenes.footprint_passes(df, area).collect()[0]
    assert (one["scenes"], one["coverage"] * 10_000) == (1600, pytest.approx(scenes.union_area(rings, area), abs=1e-6))
    monkeypatch.setattr(scenes, "union_area", lambda rings, box: float(len(rings)))
    assert scenes.footprint_passes(df, area).collect()[0]["coverage"] * 10_000 < 1600


def test_many_small_footprints_all_count(spark, monkeypatch):
    """Nothing of them can be left out, so the pass is cut into tiles."""
    rings = [np.array([(x, y), (x + 0.5, y), (x + 0.5, y + 0.5), (x, y + 0.5)]) for x in range(30) for y in range(30)]
    monkeypatch.setattr(scenes, "AT_ONCE", 100)
    one = scenes.footprint_passes(spark.createDataFrame(frame(rings), SCHEMA), (0.0, 0.0, 30.0, 30.0)).collect()[0]
    assert (one["scenes"], one["coverage"]) == (900, pytest.approx(0.25))


def test_a_later_frame_without_a_sound_ring_hides_no_earlier_one(spark):
    rows = frame([[(0, 0), (2, 0), (2, 2), (0, 2)]])
    rows += [(*rows[0][:3], rows[0][3] + dt.timedelta(hours=k), "B", bad) for k, bad in ((1, None), (2, []), (3, [(0.0, 0.0), None, (1.0, 1.0)]), (4, [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)]), (5, [(0.0, 0.0), (1.0, float("inf")), (2.0, 2.0)]))]
    one = scenes.footprint_passes(spark.createDataFrame(rows, SCHEMA), (0.0, 0.0, 4.0, 4.0)).collect()[0]
    assert (one["ids"], one["scenes"], one["platforms"], one["coverage"], one["earliest"]) == ("s0", 1, "A", 0.25, one["latest"])


def test_rings_are_not_made_anew_in_filters(spark):
    """A filter that names a ring gets the whole making of it at each place, by an interpreter."""
    df = spark.createDataFrame([(1, "s1")], "k int, id string").selectExpr("id", "'ascending' as orbit_state", "4 as relative_orbit", "timestamp '2020-08-09' as time", "'A' as platform", "array(struct(k + 0D as x, 0D as y), struct(k + 1D as x, 0D as y), struct(k + 1D as x, 1D as y)) as ring")
    plan = scenes.footprint_passes(df, (0.0, 0.0, 4.0, 4.0))._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "lambda" in line]
