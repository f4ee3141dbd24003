"""Window statistics and quantiles beside brute force."""

from __future__ import annotations

import numpy as np
import pytest

from accessgeo.operators import raster


@pytest.mark.parametrize(("shape", "radius"), [((7, 9), 2), ((2, 6), 2), ((1, 5), 1), ((6, 6), 3)])
def test_box_statistics_equal_brute_force(spark, shape, radius):
    array = np.random.default_rng(1).random(shape) + 1e6
    array[0, 1] = np.nan
    rows = [(r, c, None if np.isnan(array[r, c]) else float(array[r, c])) for r in range(shape[0]) for c in range(shape[1])]
    found = {(r.row, r.col): r for r in raster.box_statistics(spark.createDataFrame(rows, "row int, col int, z double"), "z", radius).collect()}
    assert len(found) == array.size

    def mirrored(k, n):
        return -k - 1 if k < 0 else 2 * n - k - 1 if k >= n else k

    for (r, c), got in found.items():
        places = [(mirrored(r + a, shape[0]), mirrored(c + b, shape[1])) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1)]
        window = [array[p] for p in places if 0 <= p[0] < shape[0] and 0 <= p[1] < shape[1] and not np.isnan(array[p])]
        assert got.mean == pytest.approx(np.mean(window), rel=1e-14) and got.variance == pytest.approx(np.var(window), abs=1e-9)
        assert (got.x is None) == bool(np.isnan(array[r, c]))


def test_windows_without_values_and_empty_tables(spark):
    cells = spark.createDataFrame([(0, 0, None), (0, 1, None)], "row int, col int, z double")
    assert [(r.mean, r.variance) for r in raster.box_statistics(cells, "z", 2).collect()] == [(None, None)] * 2
    assert raster.box_statistics(cells.limit(0), "z", 2).count() == 0
    assert [r.z for r in raster.lee_filter(cells, "z").collect()] == [None, None]


@pytest.mark.parametrize("share", [0.0, 0.25, 0.5, 0.77, 1.0])
def test_quantiles_equal_sorting(spark, share):
    rng = np.random.default_rng(2)
    cases = [rng.random(500), np.repeat([3.0, 1.0, 2.0], 50), np.array([7.0]), np.concatenate([rng.random(300) * 1e-12, [1e9, -1e9]]), rng.integers(0, 9, 400).astype(float), np.exp(rng.normal(0, 20, 300))]
    for values in cases:
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double").coalesce(2)
        assert raster.exact_quantile(df, "v", share, bins=8) == pytest.approx(float(np.quantile(values, share)), rel=1e-9, abs=1e-24)


def test_no_quantile_without_values(spark):
    assert raster.exact_quantile(spark.createDataFrame([(None,)], "v double"), "v", 0.25) is None
