"""Routes of water over the filled surface, with the SQL beside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accessgeo.operators import hydrology
from accessgeo.plans.oracles import FILLED, PIXELS, _q
from accessgeo.sources import adapters


def _heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.pixels(spark, sf_dir).select("row", "col", F.col("hand").alias("z"))


def drained_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cell that each cell drains to on the filled surface, and its layer on a flat."""
    return hydrology.drained(_heights(spark, sf_dir)).select("row", "col", "fill", "outlet", "to_row", "to_col", "layer")


def filled_drainage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upstream cells, streams and height above them, with pits filled and flats routed."""
    return hydrology.height_above_drainage(_heights(spark, sf_dir), 20, filled=True)


DRAINED = FILLED + """,
fl AS (SELECT row, col, node, z, f, border FROM zz JOIN ff ON ff.n = node),
nb AS (SELECT a.node AS u, a.f AS fu, b.node AS v, b.row AS vr, b.col AS vc, b.f AS fv, list_position([(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)], (b.row - a.row, b.col - a.col)) AS k
  FROM fl a JOIN fl b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND a.node <> b.node),
steep AS (SELECT u, arg_max(v, ((fu - fv) / CASE WHEN k % 2 = 0 THEN sqrt(2) ELSE 1 END, -k)) AS t FROM nb WHERE fv < fu GROUP BY u),
flat AS (SELECT node FROM fl WHERE NOT border AND node NOT IN (SELECT u FROM steep)),
level AS (SELECT u, v, k FROM nb WHERE fu = fv AND u IN (SELECT node FROM flat)),
ly(n, d) USING KEY (n) AS (SELECT DISTINCT v, 0 FROM level WHERE v NOT IN (SELECT node FROM flat) UNION SELECT DISTINCT l.u, ly.d + 1 FROM ly JOIN level l ON l.v = ly.n LEFT JOIN recurring.ly r ON r.n = l.u WHERE r.n IS NULL),
over AS (SELECT l.u, arg_min(l.v, l.k) AS t, any_value(x.d) AS d FROM level l JOIN ly x ON x.n = l.u JOIN ly y ON y.n = l.v AND y.d = x.d - 1 GROUP BY 1),
route AS (SELECT fl.row, fl.col, fl.node, fl.z, fl.f AS fill, fl.border AS outlet, coalesce(s.t, o.t) AS t, coalesce(o.d, 0) AS layer FROM fl LEFT JOIN steep s ON s.u = fl.node LEFT JOIN over o ON o.u = fl.node)"""
SQL = {
    "drained_surface": _q(PIXELS + "," + DRAINED, "SELECT r.row, r.col, r.fill, r.outlet, t.row AS to_row, t.col AS to_col, r.layer FROM route r LEFT JOIN route t ON t.node = r.t", True),
    "filled_drainage": _q(PIXELS + "," + DRAINED + """,
walk(node, here, steps) AS (SELECT node, node, 0 FROM route UNION ALL SELECT w.node, r.t, steps + 1 FROM walk w JOIN route r ON r.node = w.here WHERE r.t IS NOT NULL),
acc AS (SELECT here AS node, count(*) AS cells FROM walk GROUP BY 1),
goal AS (SELECT w.node, arg_min(r.z, steps) AS z0 FROM walk w JOIN acc a ON a.node = w.here AND a.cells >= 20 JOIN route r ON r.node = w.here GROUP BY 1)""",
        "SELECT row, col, cells, cells >= 20 AS stream, CASE WHEN z0 IS NOT NULL THEN greatest(z - z0, 0) END AS hand FROM route JOIN acc USING (node) LEFT JOIN goal USING (node)", True),
}
QUERIES = {f.__name__: f for f in (drained_surface, filled_drainage)}
