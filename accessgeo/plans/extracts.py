"""Ways cut at the border of an area and of the context around it, with the SQL beside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accessgeo.operators import areas, elements
from accessgeo.plans.impact import _vertices
from accessgeo.plans.oracles import _q
from accessgeo.sources import adapters

AREA = (20051.5, 401.25, 60033.5, 1003.75)
CONTEXT = (10027.5, 203.25, 80049.5, 1609.75)


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways with sharp bends; two of three are of classes that stay in the context."""
    points = _vertices(spark, sf_dir).selectExpr("way as line", "idx", "x + (way + idx * 5) % 7 * 40 as x", "y + (way * 37 + idx * 211) % 500 as y", "way % 3 <> 0 as major")
    return areas.area_parts(points, AREA, CONTEXT)


def way_extracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the ways inside the area, and of major ones in the context around it."""
    found = areas.area_pieces(_parts(spark, sf_dir))
    return found.select("line", "piece", "in_aoi", "points", *[F.round(c, 6).alias(c) for c in ("length", "x0", "y0", "x1", "y1")])


def scope_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in the area and around it, and those that lie outside the box they should lie in."""
    parts = _parts(spark, sf_dir)
    outside = areas.out_of_scope(parts, AREA, CONTEXT).groupBy("in_aoi").agg(F.count(F.lit(1)).alias("outside"))
    return parts.groupBy("in_aoi").agg(F.count(F.lit(1)).alias("parts")).join(outside, "in_aoi", "left").fillna(0, ["outside"])


def merged_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements whose copies carry a centre, a shape or both, by day and one of two versions."""
    e = adapters.elements(spark, sf_dir).selectExpr("type", "id", "event_id", "cast(cast(ts as date) as string) as ts", "event_id % 2 as version", "if(event_id % 3 < 2, user_id, null) as centre", "if(event_id % 5 < 2, event_type, null) as shape")
    return elements.merged_copies(e, ["centre", "shape"], "event_id")


def _within(box: tuple[float, ...]) -> str:
    """SQL: the middle of a cut lies in the box."""
    return f"(mx BETWEEN {box[0]} AND {box[2]} AND my BETWEEN {box[1]} AND {box[3]})"


CUTS = ", ".join(f"({x} - {v}0) / nullif({v}1 - {v}0, 0)" for box in (AREA, CONTEXT) for k, v in ((0, "x"), (1, "y")) for x in (box[k], box[k + 2]))
#: Every segment is cut at all sides of both boxes, and the middle of a cut tells where it lies; `pt` has one row per segment and box.
PARTS = f"""
ix AS (SELECT o.*, i, 2 * i + 1 AS idx FROM orders o, range(5) t(i) UNION ALL SELECT *, 2, 6 FROM orders WHERE o_orderkey % 4 = 0),
pn AS (SELECT o_orderkey AS line, idx, o_orderkey % 3 <> 0 AS major, ((o_custkey % 100 * 10 + o_orderkey % 10 + i * (1 + o_orderkey % 3)) * 100 + (o_orderkey + idx * 5) % 7 * 40)::DOUBLE AS x, ((o_custkey // 100 * 7 + o_orderkey % 7 + i * (o_orderkey % 2)) * 100 + (o_orderkey * 37 + idx * 211) % 500)::DOUBLE AS y FROM ix),
se AS (SELECT line, major, row_number() OVER w AS seg, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM pn WINDOW w AS (PARTITION BY line ORDER BY idx)),
ct AS (SELECT line, seg, unnest(list_distinct([0, 1, {CUTS}])) AS t FROM se WHERE x1 IS NOT NULL),
tw AS (SELECT line, seg, t AS t0, lead(t) OVER (PARTITION BY line, seg ORDER BY t) AS t1 FROM ct WHERE t BETWEEN 0 AND 1),
mi AS (SELECT se.*, t0, t1, x0 + (t0 + t1) / 2 * (x1 - x0) AS mx, y0 + (t0 + t1) / 2 * (y1 - y0) AS my FROM tw JOIN se USING (line, seg) WHERE t1 IS NOT NULL),
kn AS (SELECT *, CASE WHEN {_within(AREA)} THEN true WHEN major AND {_within(CONTEXT)} THEN false END AS in_aoi FROM mi),
st AS (SELECT *, CASE WHEN in_aoi = lag(in_aoi) OVER (PARTITION BY line ORDER BY seg, t0) THEN 0 ELSE 1 END AS fresh FROM kn),
rn AS (SELECT *, sum(fresh) OVER (PARTITION BY line ORDER BY seg, t0) AS run, (t1 - t0) * sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS m FROM st),
pt AS (SELECT line, in_aoi, run, seg, min(t0) AS t0, max(t1) AS t1, sum(m) AS m, any_value(x0) AS x0, any_value(y0) AS y0, any_value(x1) AS x1, any_value(y1) AS y1 FROM rn WHERE in_aoi IS NOT NULL GROUP BY 1, 2, 3, 4)"""
SQL = {
    "way_extracts": _q(PARTS + """, pc AS (SELECT line, in_aoi, run, count(*) + 1 AS points, sum(m) AS length, arg_min(x0 + t0 * (x1 - x0), seg) AS a, arg_min(y0 + t0 * (y1 - y0), seg) AS b, arg_max(x0 + t1 * (x1 - x0), seg) AS c, arg_max(y0 + t1 * (y1 - y0), seg) AS d FROM pt GROUP BY 1, 2, 3)""",
        "SELECT line, row_number() OVER (PARTITION BY line ORDER BY in_aoi DESC, run) - 1 AS piece, in_aoi, points, round(length, 6) AS length, round(a, 6) AS x0, round(b, 6) AS y0, round(c, 6) AS x1, round(d, 6) AS y1 FROM pc WHERE length > 0"),
    "scope_audit": _q(PARTS, "SELECT in_aoi, count(*) AS parts, 0 AS outside FROM pt SEMI JOIN (SELECT line, run FROM pt GROUP BY 1, 2 HAVING sum(m) > 0) USING (line, run) GROUP BY 1"),
    "merged_elements": """
WITH e AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'node' ELSE 'way' END AS type, event_id % 400 AS id, event_id, ts::DATE::VARCHAR AS ts, event_id % 2 AS version, CASE WHEN event_id % 3 < 2 THEN user_id END AS centre, CASE WHEN event_id % 5 < 2 THEN event_type END AS shape FROM events),
f AS (SELECT type, id, ts, version, arg_max(centre, event_id) AS centre, arg_max(shape, event_id) AS shape, count(*) AS merged FROM e GROUP BY 1, 2, 3, 4),
k AS (SELECT *, row_number() OVER w AS place, sum(merged) OVER (PARTITION BY type, id)::BIGINT AS copies, count(*) OVER (PARTITION BY type, id) > 1 AS conflict FROM f WINDOW w AS (PARTITION BY type, id ORDER BY ts DESC, version DESC))
SELECT type, id, ts, version, centre, shape, merged, copies, conflict FROM k WHERE place = 1
""",
}
QUERIES = {f.__name__: f for f in (way_extracts, scope_audit, merged_elements)}
