"""Filled surfaces and routes over flats, tile by tile, beside a plain priority flood."""

from __future__ import annotations

import heapq
import random

import pytest

from accessgeo.operators import hydrology
from accessgeo.operators.raster import EIGHT


def surface(spark, heights):
    return spark.createDataFrame([(r, c, z) for (r, c), z in heights.items()], "row int, col int, z double")


def flooded(heights):
    known = {p: z for p, z in heights.items() if z is not None}
    near = lambda p: [(p[0] + a, p[1] + b) for a, b in EIGHT]
    fill = {p: z for p, z in known.items() if any(q not in known for q in near(p))}
    outlets, heap = set(fill), [(z, p) for p, z in fill.items()]
    heapq.heapify(heap)
    while heap:
        z, p = heapq.heappop(heap)
        for q in near(p):
            if q in known and q not in fill:
                fill[q] = max(z, known[q])
                heapq.heappush(heap, (fill[q], q))
    return fill, outlets


def random_heights(seed, rows, cols, levels):
    rng = random.Random(seed)
    return {(r - 3, c - 5): None if rng.random() < 0.01 else float(rng.randrange(levels)) for r in range(rows) for c in range(cols)}


@pytest.mark.parametrize(("seed", "tile", "shard", "levels"), [(1, 8, 10_000, 12), (2, 5, 40, 4), (3, 64, 10_000, 30)])
def test_levels_equal_a_plain_flood(spark, seed, tile, shard, levels):
    heights = random_heights(seed, 30, 27, levels)
    fill, outlets = flooded(heights)
    found = hydrology.fill_pits(surface(spark, heights), tile=tile, shard_edges=shard).collect()
    assert {(r["row"], r["col"]): r["fill"] for r in found} == fill
    assert {(r["row"], r["col"]) for r in found if r["outlet"]} == outlets


def test_every_cell_of_a_filled_surface_drains(spark):
    heights = random_heights(7, 26, 26, 3)
    fill, outlets = flooded(heights)
    found = {(r["row"], r["col"]): r for r in hydrology.drained(surface(spark, heights), tile=7, shard_edges=60).collect()}
    for p in found:
        steps = 0
        while found[p]["to_row"] is not None:
            q = (found[p]["to_row"], found[p]["to_col"])
            assert fill[q] <= fill[p] and (fill[q] < fill[p] or found[q]["layer"] == found[p]["layer"] - 1)
            p, steps = q, steps + 1
            assert steps <= len(found)
        assert p in outlets


def test_a_channel_that_winds_through_a_million_cells_fills_to_its_mouth(spark, monkeypatch):
    """Every other row of 1,000 x 1,000 cells is a channel; it turns at alternate ends, so the way out of the last row is 500,000 cells long."""
    n, rounds = 1_000, []
    channel = f"r % 2 = 0 and r between 2 and {n - 3} and c between 1 and {n - 2}"
    turn = f"r % 2 = 1 and r between 3 and {n - 4} and c = case when (r div 2) % 2 = 1 then {n - 2} else 1 end"
    cells = spark.range(n * n).selectExpr(f"cast(id div {n} as int) as r", f"cast(id % {n} as int) as c").selectExpr("r as row", "c as col", f"case when r < 2 and c = 1 then 50D when ({channel}) or ({turn}) then 49 - 20D * r / {n} else 100D end as z")
    real = hydrology.checkpointed
    monkeypatch.setattr("accessgeo.operators.fixpoint.checkpointed", lambda df: rounds.append(1) or real(df))
    found = hydrology.fill_pits(cells)
    deep, wrong = found.selectExpr("count_if(z < 100)", "count_if(fill <> if(z < 100, 50, 100))").first()
    assert deep > 490_000 and wrong == 0 and len(rounds) < 60


def test_tables_of_voids_and_of_one_cell(spark):
    assert hydrology.fill_pits(surface(spark, {(0, 0): None, (0, 1): None})).count() == 0
    row = hydrology.drained(surface(spark, {(5, -7): 2.5})).first()
    assert (row["row"], row["col"], row["fill"], row["outlet"], row["to_row"], row["layer"]) == (5, -7, 2.5, True, None, 0)
