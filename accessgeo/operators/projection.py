"""Transverse Mercator in UTM zones as Columns (Krueger's series to the fourth power of the third flattening), and metric grids of areas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accessgeo.operators.areas import grids, utm_epsg

# The WGS 84 ellipsoid and the UTM scale and offsets.
RADIUS, FLATTENING, SCALE, EAST, SOUTH = 6_378_137.0, 1 / 298.257223563, 0.9996, 500_000.0, 10_000_000.0
_N = FLATTENING / (2 - FLATTENING)
#: Radius of the sphere whose meridian is as long as the ellipsoid's.
MEAN = RADIUS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
#: Coefficients of the series: forward, backward, and from the conformal to the geodetic latitude.
FORWARD = [_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280]
BACKWARD = [_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280]
LATITUDE = [2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45, 7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45, 56 * _N**3 / 15 - 136 * _N**4 / 35, 4279 * _N**4 / 630]
ECCENTRICITY = 2 * _N**0.5 / (1 + _N)


def _middle(epsg: Column) -> Column:
    """Longitude of the zone's middle, in radians."""
    return F.radians((epsg % 100) * 6 - 183)


def _south(epsg: Column) -> Column:
    return F.when(epsg >= 32700, SOUTH).otherwise(0.0)


def to_utm(lon: Column, lat: Column, epsg: Column) -> tuple[Column, Column]:
    """Easting and northing, in metres, of a place in degrees in the zone of an EPSG code 326xx or 327xx."""
    sine, away = F.sin(F.radians(lat)), F.radians(lon) - _middle(epsg)
    t = F.sinh(F.atanh(sine) - ECCENTRICITY * F.atanh(ECCENTRICITY * sine))
    along, across = F.atan2(t, F.cos(away)), F.atanh(F.sin(away) / F.sqrt(1 + t * t))
    east, north = across, along
    for k, a in enumerate(FORWARD, 1):
        east = east + a * F.cos(2 * k * along) * F.sinh(2 * k * across)
        north = north + a * F.sin(2 * k * along) * F.cosh(2 * k * across)
    return EAST + SCALE * MEAN * east, _south(epsg) + SCALE * MEAN * north


def from_utm(x: Column, y: Column, epsg: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees of a place in metres in a zone."""
    north, east = (y - _south(epsg)) / (SCALE * MEAN), (x - EAST) / (SCALE * MEAN)
    along, across = north, east
    for k, b in enumerate(BACKWARD, 1):
        along = along - b * F.sin(2 * k * north) * F.cosh(2 * k * east)
        across = across - b * F.cos(2 * k * north) * F.sinh(2 * k * east)
    conformal = F.asin(F.sin(along) / F.cosh(across))
    lat = conformal
    for k, d in enumerate(LATITUDE, 1):
        lat = lat + d * F.sin(2 * k * conformal)
    return F.degrees(_middle(epsg) + F.atan2(F.sinh(across), F.cos(along))), F.degrees(lat)


def metric_extents(boxes: DataFrame, between: int = 21) -> DataFrame:
    """`boxes` (w, s, e, n in degrees) with epsg and the metric extent x0, y0, x1, y1 in the zone of their centre.

    A side of a box is bent in the zone, so `between` places on each side count besides its corners. Boxes that reach beyond 80 degrees south or 84 north
    have no extent.
    """
    c, n = F.col, between + 1
    share = [F.lit(k / n) for k in range(n + 1)]
    rim = [(c("w") + (c("e") - c("w")) * k, c(lat)) for k in share for lat in ("s", "n")] + [(c(lon), c("s") + (c("n") - c("s")) * k) for k in share for lon in ("w", "e")]
    found = boxes.withColumn("epsg", utm_epsg((c("w") + c("e")) / 2, (c("s") + c("n")) / 2))
    found = found.withColumn("rim", F.array(*[F.struct(a.alias("lon"), b.alias("lat")) for a, b in rim]))

    def metric(p: Column) -> Column:
        x, y = to_utm(p["lon"], p["lat"], c("epsg"))
        return F.struct(x.alias("x"), y.alias("y"))

    found = found.withColumn("rim", F.when((c("s") >= -80) & (c("n") <= 84), F.transform("rim", metric)))
    ends = {f"{a}{k}": pick(c("rim")[a]) for a in "xy" for k, pick in ((0, F.array_min), (1, F.array_max))}
    return found.withColumns(ends).drop("rim")


def area_grids(boxes: DataFrame, resolution: int = 10, most_px: int = 4_000) -> DataFrame:
    """Raster grid of each box in the UTM zone of its centre (see areas.grids), with `spans_zones` where its sides lie in several."""
    found = grids(metric_extents(boxes), resolution, most_px)
    zone = lambda x: F.floor((F.col(x) + 180) / 6)
    return found.withColumn("spans_zones", zone("w") != zone("e"))
