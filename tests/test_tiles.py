"""Scores by tiles beside the same scorer over the whole grid."""

from __future__ import annotations

import numpy as np
import pytest

from accessgeo.operators import tiles


def identity(patch):
    return patch[0]


def crooked(patch):
    """Looks two cells to the right and one down, so mirror images differ."""
    return patch[0] + 2 * np.roll(patch[0], -2, axis=1) + 3 * np.roll(patch[1], -1, axis=0)


def mirrored(array, flips):
    """`crooked` over the whole grid with a mirrored border."""
    padded = np.pad(array, ((0, 0), (4, 4), (4, 4)), mode="reflect")
    turned = tiles.FLIPS if flips else [()]
    return (sum(np.flip(crooked(np.flip(padded, x)), [a - 1 for a in x]) for x in turned) / len(turned))[4:-4, 4:-4]


def grid(spark, array, hole=None):
    rows = [(r, c, (r, c) != hole, *[float(v) for v in array[:, r, c]]) for r in range(array.shape[1]) for c in range(array.shape[2])]
    return spark.createDataFrame(rows, "row int, col int, valid boolean, a double, b double")


def values(df):
    return {(r.row, r.col): r.value for r in df.collect()}


@pytest.mark.parametrize(("shape", "tile", "overlap"), [((23, 17), 8, 4), ((5, 30), 16, 6), ((9, 9), 4, 0), ((1, 12), 5, 2)])
def test_identity_gives_the_grid_back(spark, shape, tile, overlap):
    array = np.random.default_rng(3).random((2, *shape))
    found = values(tiles.scored_by_tiles(grid(spark, array), ["a", "b"], identity, tile, overlap, flips=True))
    assert len(found) == shape[0] * shape[1]
    assert all(abs(v - array[0][p]) < 1e-12 for p, v in found.items())


@pytest.mark.parametrize("flips", [False, True])
def test_scores_equal_the_whole_grid(spark, flips):
    array = np.random.default_rng(4).random((2, 21, 26))
    found = values(tiles.scored_by_tiles(grid(spark, array), ["a", "b"], crooked, 10, 6, flips))
    told = mirrored(array, flips)
    assert max(abs(v - told[p]) for p, v in found.items()) < 1e-12


def test_cells_without_value_are_null_and_zero_for_others(spark):
    array = np.ones((2, 6, 6))
    array[0, 1, 1] = np.nan
    cells = grid(spark, array, hole=(3, 3)).where("not (row = 5 and col = 5)")
    found = values(tiles.scored_by_tiles(cells, ["a", "b"], crooked, 6, 4))
    assert found[1, 1] is None and found[3, 3] is None and (5, 5) not in found
    assert [found[3, 1], found[0, 1], found[2, 2]] == pytest.approx([4, 3, 6])


def test_empty_tables_and_bad_sizes(spark):
    cells = grid(spark, np.ones((2, 2, 2)))
    assert tiles.scored_by_tiles(cells.limit(0), ["a"], identity, 4, 2).count() == 0
    with pytest.raises(ValueError, match="overlap"):
        tiles.scored_by_tiles(cells, ["a"], identity, 4, 4)
    with pytest.raises(ValueError, match="from 0"):
        tiles.scored_by_tiles(cells.selectExpr("row - 1 as row", "col", "valid", "a"), ["a"], identity, 4, 2)
