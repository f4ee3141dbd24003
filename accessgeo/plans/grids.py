"""Grids of areas in their UTM zones, with the SQL beside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from accessgeo.operators import projection as p
from accessgeo.plans.acquisition import BOXES, _boxes
from accessgeo.plans.oracles import _q


def projected_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raster grid of each area in the zone of its centre, snapped outward."""
    return p.area_grids(_boxes(spark, sf_dir).where("e > w and n > s")).select("id", "epsg", "step", "left", "top", "width", "height", "spans_zones")


def _series(outer: str, inner: str) -> str:
    return " + ".join(f"{a!r}::DOUBLE * {outer}({2 * k} * al) * {inner}({2 * k} * ac)" for k, a in enumerate(p.FORWARD, 1))


SIDES = "greatest(ceil(x1 / {0}) - floor(x0 / {0}), ceil(y1 / {0}) - floor(y0 / {0})) <= 4000"
SQL = {
    "projected_grids": _q(BOXES + f""",
ok AS (SELECT *, CASE WHEN (s + n) / 2 >= 0 THEN 32600 ELSE 32700 END + least(60, floor(((w + e) / 2 + 180) / 6)::INT + 1) AS epsg FROM bx WHERE e > w AND n > s),
rim AS (SELECT id, epsg, w + (e - w) * k / 22 AS lon, unnest([s, n]) AS lat FROM ok, range(23) t(k) UNION ALL SELECT id, epsg, unnest([w, e]), s + (n - s) * k / 22 FROM ok, range(23) t(k)),
tt AS (SELECT *, sinh(atanh(sin(radians(lat))) - {p.ECCENTRICITY!r}::DOUBLE * atanh({p.ECCENTRICITY!r}::DOUBLE * sin(radians(lat)))) AS t, radians(lon - ((epsg % 100) * 6 - 183)) AS away FROM rim),
aa AS (SELECT *, atan2(t, cos(away)) AS al, atanh(sin(away) / sqrt(1 + t * t)) AS ac FROM tt),
xy AS (SELECT id, min(500000 + {p.SCALE * p.MEAN!r}::DOUBLE * (ac + {_series('cos', 'sinh')})) AS x0, max(500000 + {p.SCALE * p.MEAN!r}::DOUBLE * (ac + {_series('cos', 'sinh')})) AS x1,
  min(CASE WHEN epsg >= 32700 THEN 10000000 ELSE 0 END + {p.SCALE * p.MEAN!r}::DOUBLE * (al + {_series('sin', 'cosh')})) AS y0, max(CASE WHEN epsg >= 32700 THEN 10000000 ELSE 0 END + {p.SCALE * p.MEAN!r}::DOUBLE * (al + {_series('sin', 'cosh')})) AS y1 FROM aa GROUP BY id),
st AS (SELECT ok.*, x0, x1, y0, y1, CASE WHEN s < -80 OR n > 84 THEN NULL WHEN {SIDES.format(10)} THEN 10 WHEN {SIDES.format(20)} THEN 20 END AS step FROM ok JOIN xy USING (id))""",
        "SELECT id, epsg, step, (floor(x0 / step) * step)::BIGINT AS \"left\", (ceil(y1 / step) * step)::BIGINT AS top, (ceil(x1 / step) - floor(x0 / step))::INT AS width, (ceil(y1 / step) - floor(y0 / step))::INT AS height, floor((w + 180) / 6) <> floor((e + 180) / 6) AS spans_zones FROM st"),
}
QUERIES = {"projected_grids": projected_grids}
