"""Rings of flooded components and simplified ways, with the SQL beside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accessgeo.operators import raster, rings
from accessgeo.plans.impact import _vertices
from accessgeo.plans.oracles import COMPONENTS, PIXELS, _q
from accessgeo.plans.queries import _cells


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.label_components(_cells(spark, sf_dir).where("tier > 0"))


def component_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outer rings and holes of the flooded components, with their areas."""
    return rings.ring_summary(_labelled(spark, sf_dir)).drop("ring").groupBy("comp", "hole", "area", "edges", "corners").agg(F.count(F.lit(1)).alias("rings"))


def component_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corners of the rings in order."""
    return rings.ring_corners(_labelled(spark, sf_dir)).select("comp", "ring", "place", "x", "y")


def simplified_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways with bends of a few metres in them, simplified by 5 m."""
    points = _vertices(spark, sf_dir).selectExpr("way as line", "idx as place", "x", "y + (way * 7 + idx * 13) % 11 as y")
    return rings.simplified(points, 5).select("line", "place", "x", "y")


EDGES = COMPONENTS + """,
sd(s, br, bc, lr, lc, rr, rc, x1, y1, x2, y2) AS (VALUES (0, -1, 0, -1, 1, 0, 1, 0, 0, 1, 0), (1, 0, 1, 1, 1, 1, 0, 1, 0, 1, 1), (2, 1, 0, 1, -1, 0, -1, 1, 1, 0, 1), (3, 0, -1, -1, -1, -1, 0, 0, 1, 0, 0)),
eg AS (SELECT l.comp, l.row, l.col, s, l.col + x1 AS x1, l.row + y1 AS y1, l.col + x2 AS x2, l.row + y2 AS y2,
    CASE WHEN a.row IS NOT NULL THEN a.row WHEN b.row IS NOT NULL THEN b.row ELSE l.row END AS nr, CASE WHEN a.row IS NOT NULL THEN a.col WHEN b.row IS NOT NULL THEN b.col ELSE l.col END AS nc,
    CASE WHEN a.row IS NOT NULL THEN (s + 3) % 4 WHEN b.row IS NOT NULL THEN s ELSE (s + 1) % 4 END AS ns
  FROM lab l CROSS JOIN sd LEFT JOIN lab z ON z.row = l.row + br AND z.col = l.col + bc LEFT JOIN lab a ON a.row = l.row + lr AND a.col = l.col + lc LEFT JOIN lab b ON b.row = l.row + rr AND b.col = l.col + rc WHERE z.row IS NULL),
en AS (SELECT *, (row::BIGINT * 1073741824 + col + 536870912) * 4 + s AS e, (nr::BIGINT * 1073741824 + nc + 536870912) * 4 + ns AS n FROM eg),
rg(e, r) USING KEY (e) AS (SELECT e, e FROM en UNION SELECT k.n, min(rg.r) FROM rg JOIN en k ON k.e = rg.e JOIN recurring.rg o ON o.e = k.n WHERE rg.r < o.r GROUP BY k.n),
rn AS (SELECT en.*, r AS ring, p.s <> en.s AS turn FROM en JOIN rg USING (e) JOIN en p ON p.n = en.e)"""
SQL = {
    "component_rings": _q(PIXELS + "," + EDGES + ", one AS (SELECT comp, ring, count(*) AS edges, count(*) FILTER (turn) AS corners, sum(x1 * y2 - x2 * y1) / 2 AS area FROM rn GROUP BY 1, 2)", "SELECT comp, area < 0 AS hole, area, edges, corners, count(*) AS rings FROM one GROUP BY ALL", True),
    "component_outlines": _q(PIXELS + "," + EDGES + ", wk(ring, e, k) AS (SELECT ring, e, 0 FROM rn WHERE e = ring UNION ALL SELECT wk.ring, rn.n, k + 1 FROM wk JOIN rn ON rn.e = wk.e WHERE rn.n <> wk.ring)", "SELECT rn.comp, rn.ring::BIGINT AS ring, row_number() OVER (PARTITION BY rn.ring ORDER BY k) - 1 AS place, x1 AS x, y1 AS y FROM wk JOIN rn USING (e) WHERE turn", True),
    "simplified_ways": """
WITH RECURSIVE ix AS (SELECT o.*, i, 2 * i + 1 AS place FROM orders o, range(5) t(i) UNION ALL SELECT *, 2, 6 FROM orders WHERE o_orderkey % 4 = 0),
pt AS (SELECT o_orderkey AS line, place, ((o_custkey % 100 * 10 + o_orderkey % 10 + i * (1 + o_orderkey % 3)) * 100)::DOUBLE AS x, ((o_custkey // 100 * 7 + o_orderkey % 7 + i * (o_orderkey % 2)) * 100 + (o_orderkey * 7 + place * 13) % 11)::DOUBLE AS y FROM ix),
sg(line, lo, hi) AS (SELECT line, 1::BIGINT, 9::BIGINT FROM pt GROUP BY line UNION ALL SELECT line, unnest([lo, mid]), unnest([mid, hi]) FROM (
  SELECT s.line, s.lo, s.hi, arg_max(p.place, (sqrt((p.x - a.x - t * (b.x - a.x)) ** 2 + (p.y - a.y - t * (b.y - a.y)) ** 2), -p.place)) AS mid, max(sqrt((p.x - a.x - t * (b.x - a.x)) ** 2 + (p.y - a.y - t * (b.y - a.y)) ** 2)) AS d
  FROM sg s JOIN pt a ON a.line = s.line AND a.place = s.lo JOIN pt b ON b.line = s.line AND b.place = s.hi JOIN pt p ON p.line = s.line AND p.place > s.lo AND p.place < s.hi,
    LATERAL (SELECT CASE WHEN (b.x - a.x) ** 2 + (b.y - a.y) ** 2 > 0 THEN greatest(least(((p.x - a.x) * (b.x - a.x) + (p.y - a.y) * (b.y - a.y)) / ((b.x - a.x) ** 2 + (b.y - a.y) ** 2), 1), 0) ELSE 0 END AS t) GROUP BY ALL) WHERE d > 5)
SELECT line, place, x, y FROM pt JOIN (SELECT line, lo AS place FROM sg UNION SELECT line, hi FROM sg) USING (line, place)
""",
}
QUERIES = {f.__name__: f for f in (component_rings, component_outlines, simplified_ways)}
