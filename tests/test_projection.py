"""UTM coordinates: known values, and back again."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from accessgeo.operators import projection

#: Fixed values of WGS 84: lengths of the meridian from the equator to 45 and to 90 degrees.
HALF, QUADRANT = 4_984_944.378, 10_001_965.729


def metres(spark, rows):
    df = spark.createDataFrame(rows, "lon double, lat double, epsg int")
    x, y = projection.to_utm(*[F.col(c) for c in ("lon", "lat", "epsg")])
    return [tuple(r) for r in df.select(x, y).collect()]


def test_known_places(spark):
    got = metres(spark, [(3.0, 0.0, 32631), (3.0, 45.0, 32631), (3.0, 89.9999999, 32631), (3.0, -45.0, 32731), (0.0, 0.0, 32631), (6.0, 0.0, 32631)])
    assert got[0] == pytest.approx((500_000, 0), abs=1e-6) and got[1] == pytest.approx((500_000, 0.9996 * HALF), abs=2e-3)
    assert got[2] == pytest.approx((500_000, 0.9996 * QUADRANT), abs=0.02) and got[3] == pytest.approx((500_000, 10_000_000 - 0.9996 * HALF), abs=2e-3)
    assert got[4] == pytest.approx((166_021.443, 0), abs=1e-3) and got[5] == pytest.approx((833_978.557, 0), abs=1e-3)


def test_there_and_back_is_within_a_tenth_of_a_millimetre(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(500):
        zone, lat = rng.randint(1, 60), rng.uniform(-80, 84)
        rows.append((zone * 6 - 183 + rng.uniform(-4, 4), lat, (32600 if lat >= 0 else 32700) + zone))
    df = spark.createDataFrame(rows, "lon double, lat double, epsg int")
    x, y = projection.to_utm(F.col("lon"), F.col("lat"), F.col("epsg"))
    back = projection.from_utm(F.col("x"), F.col("y"), F.col("epsg"))
    for r in df.withColumns({"x": x, "y": y}).select("lon", "lat", back[0].alias("lon2"), back[1].alias("lat2")).collect():
        assert abs(r["lon"] - r["lon2"]) * 111_320 < 1e-4 and abs(r["lat"] - r["lat2"]) * 111_320 < 1e-4


def test_grids_of_areas(spark):
    rows = [("small", 84.0, 27.9, 84.2, 28.1), ("wide", 2.0, 45.0, 2.8, 45.2), ("too wide", 1.0, 45.0, 3.0, 46.0), ("two zones", 5.9, -1.0, 6.2, -0.9), ("polar", 0.0, 83.0, 1.0, 85.0)]
    out = {r["id"]: r for r in projection.area_grids(spark.createDataFrame(rows, "id string, w double, s double, e double, n double")).collect()}
    assert {k: (r["epsg"], r["step"], r["spans_zones"]) for k, r in out.items()} == {"small": (32645, 10, False), "wide": (32631, 20, False), "too wide": (32631, None, False), "two zones": (32732, 10, True), "polar": (32631, None, False)}
    one = out["small"]
    assert one["left"] <= one["x0"] < one["left"] + 10 and one["top"] - 10 < one["y1"] <= one["top"] and one["left"] % 10 == 0
    assert abs(one["width"] - (one["x1"] - one["x0"]) / 10) < 2 and 1_950 < one["width"] < 2_050 and 2_200 < one["height"] < 2_270
