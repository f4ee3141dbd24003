"""Passes of scenes with slanted footprints over any area, with the SQL beside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accessgeo.operators import scenes
from accessgeo.sources.adapters import scenes as boxes

AREA = (-0.75, 0.4, 9.5, 8.25)
#: Corners of a footprint: a box of the table, sheared by a number of its own.
CORNERS = ["w + slant", "s", "e + slant", "s + slant / 2", "e - slant", "n", "w - slant", "n - slant / 2"]


def footprint_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of the area by passes of an orbit's week, so that many footprints lie over each other."""
    found = boxes(spark, sf_dir).selectExpr("*", "(cast(substr(id, 2) as bigint) * 7 % 19 - 9) / 8D as slant", "timestamp(date_trunc('week', day)) as time", "concat('S', relative_orbit % 2) as platform")
    ring = F.array(*[F.struct(F.expr(f"cast({x} as double)").alias("x"), F.expr(f"cast({y} as double)").alias("y")) for x, y in zip(CORNERS[::2], CORNERS[1::2], strict=True)])
    out = scenes.footprint_passes(found.withColumn("ring", ring), AREA)
    return out.select("orbit_state", "relative_orbit", F.col("day").cast("string").alias("day"), "ids", "scenes", "platforms", F.round("coverage", 9).alias("coverage"))


W, S, E, N = AREA
SQL = {
    "footprint_passes": f"""
WITH sc AS (SELECT 'i' || o_orderkey AS id, date_trunc('week', o_orderdate)::DATE AS day, (1 + o_custkey % 12)::INT AS relative_orbit, CASE WHEN o_custkey % 2 = 0 THEN 'ascending' ELSE 'descending' END AS orbit_state, (o_orderkey % 5 - 1)::DOUBLE AS w, (o_orderkey % 3 - 1)::DOUBLE AS s, (5 + o_orderkey % 8)::DOUBLE AS e, (6 + o_orderkey % 7)::DOUBLE AS n, (o_orderkey * 7 % 19 - 9) / 8.0::DOUBLE AS slant FROM orders),
rg AS (SELECT DISTINCT orbit_state, relative_orbit, day, [{", ".join(f"[{x}, {y}]" for x, y in zip(CORNERS[::2], CORNERS[1::2], strict=True))}] AS r FROM sc),
pg AS (SELECT *, row_number() OVER (PARTITION BY orbit_state, relative_orbit, day ORDER BY r) AS p FROM rg),
sd0 AS (SELECT orbit_state, relative_orbit, day, p, r[k] AS a, r[k % 4 + 1] AS b FROM pg, range(1, 5) t(k)
  UNION ALL SELECT orbit_state, relative_orbit, day, 0, [{W}, y], [{E}, y] FROM (SELECT DISTINCT orbit_state, relative_orbit, day FROM rg), (VALUES ({S}), ({N})) v(y)),
sd AS (SELECT orbit_state, relative_orbit, day, p, least(a[1], b[1])::DOUBLE AS lo, greatest(a[1], b[1])::DOUBLE AS hi, ((b[2] - a[2]) / (b[1] - a[1]))::DOUBLE AS m, (a[2] - (b[2] - a[2]) / (b[1] - a[1]) * a[1])::DOUBLE AS q FROM sd0 WHERE a[1] <> b[1]),
ct AS (SELECT orbit_state, relative_orbit, day, lo AS x FROM sd UNION SELECT orbit_state, relative_orbit, day, hi FROM sd UNION SELECT orbit_state, relative_orbit, day, a[1] FROM sd0
  UNION SELECT orbit_state, relative_orbit, day, (f.q - g.q) / (g.m - f.m) FROM sd f JOIN sd g USING (orbit_state, relative_orbit, day) WHERE f.m <> g.m AND (f.q - g.q) / (g.m - f.m) > greatest(f.lo, g.lo) AND (f.q - g.q) / (g.m - f.m) < least(f.hi, g.hi)),
sl AS (SELECT *, lead(x) OVER (PARTITION BY orbit_state, relative_orbit, day ORDER BY x) AS x2 FROM ct WHERE x BETWEEN {W} AND {E}),
ys AS (SELECT orbit_state, relative_orbit, day, x, x2, p, y, row_number() OVER (PARTITION BY orbit_state, relative_orbit, day, x, p ORDER BY y) AS k
  FROM (SELECT l.*, d.p, d.q + d.m * (x + x2) / 2 AS y FROM sl l JOIN sd d USING (orbit_state, relative_orbit, day) WHERE d.p > 0 AND d.lo <= x AND d.hi >= x2)),
sp AS (SELECT a.orbit_state, a.relative_orbit, a.day, a.x, a.x2, least(greatest(a.y, {S}), {N}) AS y0, least(greatest(b.y, {S}), {N}) AS y1 FROM ys a JOIN ys b USING (orbit_state, relative_orbit, day, x, p) WHERE a.k % 2 = 1 AND b.k = a.k + 1),
un AS (SELECT *, coalesce(max(y1) OVER (PARTITION BY orbit_state, relative_orbit, day, x ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), {S}) AS till FROM sp),
ar AS (SELECT orbit_state, relative_orbit, day, sum((x2 - x) * greatest(y1 - greatest(y0, till), 0)) AS area FROM un GROUP BY 1, 2, 3)
SELECT orbit_state, relative_orbit, day::VARCHAR AS day, string_agg(id, ',' ORDER BY id) AS ids, count(*) AS scenes, 'S' || any_value(relative_orbit % 2) AS platforms, round(least(coalesce(any_value(area), 0) / {(E - W) * (N - S)}::DOUBLE, 1), 9) AS coverage
FROM sc LEFT JOIN ar USING (orbit_state, relative_orbit, day) GROUP BY 1, 2, 3
""",
}
QUERIES = {"footprint_passes": footprint_passes}
