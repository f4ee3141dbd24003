"""Queries on damage, road geometry, routes and weak points, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accessgeo.functions.roads import LINK_WEIGHTS, SPEEDS
from accessgeo.operators import damage, network, paths, scoring
from accessgeo.plans.oracles import ACCESS, PIXELS, PLACES, ROADS, SEGMENTS, SP, _q
from accessgeo.plans.queries import _cells, _isolated, _segments, damaged_links
from accessgeo.session import checkpointed, read
from accessgeo.sources import adapters

REACH = 12
KINDS_SQL = "seg_id % 7 IN (0, 3) AS is_bridge, seg_id % 7 = 1 AS is_tunnel, seg_id % 7 = 2 AS is_ford"


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir).selectExpr("*", "seg_id % 7 in (0, 3) as is_bridge", "seg_id % 7 = 1 as is_tunnel", "seg_id % 7 = 2 as is_ford")


def line_damage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = damage.line_damage(_kinds(spark, sf_dir), _cells(spark, sf_dir).where("tier > 0"), 10, REACH)
    return out.select("seg_id", F.round("length", 6).alias("length"), "flooded", "approach_hit", "hit", "damage_tier")


def merged_damage(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, segments = _cells(spark, sf_dir), _kinds(spark, sf_dir)
    debris = cells.where("valid and not water_post and dvv >= 3").withColumn("tier", F.lit(1))
    return damage.merged_evidence(damage.line_damage(segments, cells.where("tier > 0"), 10, REACH), damage.line_damage(segments, debris, 10, REACH))


def damage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_damage(spark, sf_dir).withColumn("highway", F.element_at(F.array(*[F.lit(c) for c in SPEEDS]), (F.col("seg_id") % 15 + 1).cast("int")))
    out = damage.summary(found, "highway")
    return out.withColumns({c: F.round(c, 6) for c in ("hit_km", "flooded_km")})


def polygon_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells whose centre lies in one of the triangles beside the pixels."""
    px = adapters.pixels(spark, sf_dir)
    corners = px.selectExpr("id as poly_id", "explode(array(struct(0 as dx0, 0 as dy0, 47 as dx1, 13 as dy1), struct(47 as dx0, 13 as dy0, 5 as dx1, 61 as dy1), struct(5 as dx0, 61 as dy0, 0 as dx1, 0 as dy1))) as e", "col * 10 + 1 as x", "row * 10 + 2 as y")
    edges = corners.selectExpr("poly_id", "cast(x + e.dx0 as double) as x0", "cast(y + e.dy0 as double) as y0", "cast(x + e.dx1 as double) as x1", "cast(y + e.dy1 as double) as y1")
    return damage.inside_polygons(px, edges, 10)


def _vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways of five vertices on a lattice, one per order; in every fourth a vertex is there twice."""
    o = read(spark, sf_dir, "orders")
    at = o.selectExpr("o_orderkey as way", "o_custkey as c", "explode(case when o_orderkey % 4 = 0 then array(0, 1, 2, 2, 3, 4) else array(0, 1, 2, 3, 4) end) as i", "o_orderkey as k")
    return at.selectExpr("way", "c", "k", "i").groupBy("way", "i").agg(F.first("c").alias("c"), F.first("k").alias("k"), F.count(F.lit(1)).alias("n")).selectExpr(
        "way", "i", "(c % 100 * 10 + k % 10 + i * (1 + k % 3)) * 100 as x", "(c div 100 * 7 + k % 7 + i * (k % 2)) * 100 as y", "explode(sequence(1, n)) as twice").selectExpr("way", "i * 2 + twice as idx", "x", "y")


def road_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.way_pieces(_vertices(spark, sf_dir)).withColumn("length", F.round("length", 6))


def latent_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = adapters.road_members(spark, sf_dir)
    links = checkpointed(network.build_links(m).select("a", "b", "is_bridge", "lost_possible", "any_hit")).withColumn("link_id", F.concat_ws("-", "a", "b"))
    comp = checkpointed(network.road_components(None, m).select("node", "comp"))
    return paths.latent_losses(links, comp, adapters.subjects(spark, sf_dir), adapters.destinations(spark, sf_dir))


def route_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links on every node's baseline route to a hospital, and those of them whose fastest member is hit."""
    links = checkpointed(network.build_links(adapters.road_members(spark, sf_dir)))
    costs = checkpointed(network.routes(adapters.destinations(spark, sf_dir).where("class = 'hospital'"), {"baseline": links}).select("scenario", "node", "cost"))
    both = links.select("link_id", F.col("a").alias("u"), F.col("b").alias("v"), F.col("travel_ms").alias("cost")).unionByName(links.select("link_id", F.col("b").alias("u"), F.col("a").alias("v"), F.col("travel_ms").alias("cost")))
    ahead = paths.route_pointers(costs, both, ["scenario"]).join(links.select("link_id", "fastest_hit"), "link_id", "left")
    valued = ahead.select("scenario", "node", "next", F.col("link_id").isNotNull().cast("long").alias("links"), F.coalesce(F.col("fastest_hit").cast("long"), F.lit(0).cast("long")).alias("responsible"))
    return paths.sums_along(valued, ["links", "responsible"], ["scenario"]).select("node", "links", "responsible")


def link_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranking of the damaged links that would give someone access back."""
    rows = damaged_links(spark, sf_dir).where("count > 0")
    values = {"settlements": F.col("count"), "hospital": F.col("hospital"), "town": F.col("town"), "evidence": F.col("evidence_tier")}
    return scoring.explained(rows, values, {k: LINK_WEIGHTS[k] for k in values}, "link_id").select("link_id", "score", "rank", "why")


def links_without_leverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return damaged_links(spark, sf_dir).where("count = 0").select("link_id", "evidence_tier")


def data_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uncertain subjects that no evidence explains: not on the network, or without a mapped hospital or town before the flood."""
    out = _isolated(spark, sf_dir).where("status = 'UNCERTAIN' and (not snapped or not baseline_hospital or not baseline_town) and not (lost_possible_hospital or lost_possible_town)")
    lacks = F.array_join(F.array_compact(F.array(F.when(~F.col("baseline_hospital"), "hospital"), F.when(~F.col("baseline_town"), "town"))), ", ")
    return out.select("osm_id", "snapped", F.when(~F.col("snapped"), "not on the network").otherwise(F.concat(F.lit("no baseline road access: "), lacks)).alias("reason"))


NEAR = "sqrt(greatest(c.col * 10 - {x}, {x} - (c.col + 1) * 10, 0) ** 2 + greatest(c.row * 10 - {y}, {y} - (c.row + 1) * 10, 0) ** 2)"
CORNER = "sqrt(((c.col + {a}) * 10 - x0 - t{k} * (x1 - x0)) ** 2 + ((c.row + {b}) * 10 - y0 - t{k} * (y1 - y0)) ** 2)"
CORNERS = [(a, b) for a in (0, 1) for b in (0, 1)]


def _damage_sql(name: str, cells: str) -> str:
    """CTE `name` (seg_id, length, flooded, approach_hit, hit, damage_tier) over segments and a cell table. A segment's part in a cell is its range of parameters there."""
    ts = ", ".join(f"greatest(least((((c.col + {a}) * 10 - x0) * (x1 - x0) + ((c.row + {b}) * 10 - y0) * (y1 - y0)) / nullif((x1 - x0) ** 2 + (y1 - y0) ** 2, 0), 1), 0) AS t{k}" for k, (a, b) in enumerate(CORNERS))
    corner = "least(" + ", ".join(CORNER.format(a=a, b=b, k=k) for k, (a, b) in enumerate(CORNERS)) + ")"
    ends = f"least({NEAR.format(x='x0', y='y0')}, {NEAR.format(x='x1', y='y1')})"
    bound = lambda f, still: ", ".join(f"CASE WHEN {v}1 = {v}0 THEN {still} ELSE {f}(({k} * 10 - {v}0) / ({v}1 - {v}0), ({k} * 10 + 10 - {v}0) / ({v}1 - {v}0)) END" for v, k in (("x", "c.col"), ("y", "c.row")))
    first, last = bound("least", 0), bound("greatest", 1)
    return f"""
{name}_p AS (SELECT seg_id, c.tier, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS len, greatest(0, {first}) AS lo, least(1, {last}) AS hi
  FROM kd JOIN {cells} c ON c.col BETWEEN floor(least(x0, x1) / 10) AND floor(greatest(x0, x1) / 10) AND c.row BETWEEN floor(least(y0, y1) / 10) AND floor(greatest(y0, y1) / 10)),
{name}_f AS (SELECT seg_id, sum((hi - lo) * len) AS flooded, max(tier) AS tier FROM {name}_p WHERE hi > lo GROUP BY 1),
{name}_n AS (SELECT *, {ts} FROM kd JOIN {cells} c ON c.col * 10 BETWEEN x0 - 30 AND x1 + 30 AND c.row * 10 BETWEEN y0 - 30 AND y1 + 30 WHERE is_bridge OR is_tunnel),
{name}_a AS (SELECT seg_id, max(c.tier) AS approach FROM {name}_n c WHERE CASE WHEN is_tunnel THEN {ends} ELSE least({ends}, {corner}) END <= {REACH} GROUP BY 1),
{name}_m AS (SELECT seg_id, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS length, round(coalesce(flooded, 0), 6) AS flooded, coalesce(tier, 0) AS tier, is_bridge, is_tunnel, is_ford, CASE WHEN is_bridge AND NOT is_tunnel THEN greatest(coalesce(approach, 0), coalesce(tier, 0)) ELSE coalesce(approach, 0) END AS approach
  FROM kd LEFT JOIN {name}_f USING (seg_id) LEFT JOIN {name}_a USING (seg_id)),
{name}_h AS (SELECT *, CASE WHEN is_tunnel THEN approach > 0 ELSE (flooded > 0 AND (flooded >= 20 OR flooded / length >= 0.1)) OR (is_bridge AND approach > 0) END AS hit FROM {name}_m),
{name} AS (SELECT seg_id, round(length, 6) AS length, flooded, approach > 0 AS approach_hit, hit, CASE WHEN NOT hit THEN 0 WHEN is_ford THEN 1 ELSE greatest(tier, approach) END AS damage_tier FROM {name}_h)
"""


KD = PIXELS + "," + SEGMENTS + f", kd AS (SELECT *, {KINDS_SQL} FROM sg), wetc AS (SELECT row, col, tier FROM cells WHERE tier > 0)," + _damage_sql("dmg", "wetc")
DAMAGED = ROADS + "," + PLACES + "," + ACCESS + """, gone AS (SELECT link_id, evidence_tier, x.comp AS ca, y.comp AS cb FROM links JOIN comp x ON x.scenario = 'likely' AND x.node = a JOIN comp y ON y.scenario = 'likely' AND y.node = b WHERE lost_likely),
 back AS (SELECT g.link_id, i.osm_id, lost_h AND EXISTS (SELECT 1 FROM dest d JOIN comp z ON z.scenario = 'likely' AND z.node = d.loc WHERE d.class = 'hospital' AND d.osm_id <> i.osm_id AND z.comp IN (g.ca, g.cb)) AS h, lost_t AND EXISTS (SELECT 1 FROM dest d JOIN comp z ON z.scenario = 'likely' AND z.node = d.loc WHERE d.class = 'town' AND d.osm_id <> i.osm_id AND z.comp IN (g.ca, g.cb)) AS t
  FROM gone g JOIN comp c ON c.scenario = 'likely' AND c.comp IN (g.ca, g.cb) JOIN isolated i ON i.loc = c.node),
 dl AS (SELECT g.link_id, g.evidence_tier, count(*) FILTER (h) AS hospital, count(*) FILTER (t) AS town, count(*) FILTER (h OR t) AS count FROM gone g LEFT JOIN back USING (link_id) GROUP BY 1, 2)"""

SQL = {
    "line_damage": _q(KD, "SELECT * FROM dmg"),
    "merged_damage": _q(KD + ", debc AS (SELECT row, col, 1 AS tier FROM cells WHERE valid AND NOT water_post AND dvv >= 3)," + _damage_sql("deb", "debc"),
        "SELECT f.seg_id, f.flooded, d.flooded AS candidate_m, f.hit AS flood_hit, d.hit AS candidate_hit, f.hit OR d.hit AS hit, CASE WHEN NOT f.hit AND d.hit THEN 1 ELSE f.damage_tier END AS damage_tier, CASE WHEN f.hit THEN 'flood' WHEN d.hit THEN 'debris_candidate' ELSE 'none' END AS evidence_source FROM dmg f JOIN deb d USING (seg_id)"),
    "damage_summary": _q(KD, f"SELECT {list(SPEEDS)}[seg_id % 15 + 1] AS highway, count(*) AS segments, count(*) FILTER (hit) AS hits, " + ", ".join(f"count(*) FILTER (hit AND damage_tier = {k}) AS tier{k}" for k in (1, 2, 3)) + ", round(coalesce(sum(length) FILTER (hit), 0) / 1000, 6) AS hit_km, round(sum(flooded) / 1000, 6) AS flooded_km FROM dmg GROUP BY 1"),
    "polygon_cells": _q(PIXELS + """, tri AS (SELECT id AS poly_id, col * 10 + 1 + e.a AS x0, row * 10 + 2 + e.b AS y0, col * 10 + 1 + e.c AS x1, row * 10 + 2 + e.d AS y1 FROM px, (VALUES (0, 0, 47, 13), (47, 13, 5, 61), (5, 61, 0, 0)) e(a, b, c, d))""",
        "SELECT poly_id, p.row, p.col FROM px p JOIN tri ON row * 10 + 5 >= least(y0, y1) AND row * 10 + 5 < greatest(y0, y1) AND x0 + (row * 10 + 5 - y0)::DOUBLE / (y1 - y0) * (x1 - x0) > col * 10 + 5 GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1"),
    "road_pieces": """
WITH v0 AS (SELECT o_orderkey AS way, i, (o_custkey % 100 * 10 + o_orderkey % 10 + i * (1 + o_orderkey % 3)) * 100 AS x, (o_custkey // 100 * 7 + o_orderkey % 7 + i * (o_orderkey % 2)) * 100 AS y FROM orders, range(5) t(i)),
j AS (SELECT x, y FROM v0 GROUP BY 1, 2 HAVING count(DISTINCT way) > 1),
m AS (SELECT v0.*, j.x IS NOT NULL OR i IN (0, 4) AS cut FROM v0 LEFT JOIN j USING (x, y)),
c AS (SELECT way, i, x, y, row_number() OVER (PARTITION BY way ORDER BY i) - 1 AS piece, lead(i) OVER (PARTITION BY way ORDER BY i) AS till, lead(x) OVER (PARTITION BY way ORDER BY i) AS x2, lead(y) OVER (PARTITION BY way ORDER BY i) AS y2 FROM m WHERE cut)
SELECT way, piece, x || ':' || y AS u, x2 || ':' || y2 AS v, till - i + 1 AS points, round(sqrt((x2 - x) ** 2 + (y2 - y) ** 2), 6) AS length FROM c WHERE till IS NOT NULL
""",
    "latent_bridges": _q(ROADS + "," + PLACES + """,
be AS (SELECT a AS u, b AS v FROM links UNION ALL SELECT b, a FROM links),
cand AS (SELECT link_id, a, b FROM links WHERE is_bridge AND NOT lost_possible AND NOT any_hit),
side(l, n, w) USING KEY (l, n) AS (SELECT link_id, a, 0 FROM cand UNION SELECT s.l, be.v, 0 FROM side s JOIN cand k ON k.link_id = s.l JOIN be ON be.u = s.n AND NOT (be.u IN (k.a, k.b) AND be.v IN (k.a, k.b)) LEFT JOIN recurring.side r ON r.l = s.l AND r.n = be.v WHERE r.n IS NULL),
far(l, n, w) USING KEY (l, n) AS (SELECT link_id, b, 0 FROM cand UNION SELECT s.l, be.v, 0 FROM far s JOIN cand k ON k.link_id = s.l JOIN be ON be.u = s.n AND NOT (be.u IN (k.a, k.b) AND be.v IN (k.a, k.b)) LEFT JOIN recurring.far r ON r.l = s.l AND r.n = be.v WHERE r.n IS NULL),
cuts AS (SELECT link_id FROM cand k WHERE NOT EXISTS (SELECT 1 FROM side s WHERE s.l = k.link_id AND s.n = k.b)),
halves AS (SELECT l, n, 0 AS half FROM side WHERE l IN (SELECT link_id FROM cuts) UNION ALL SELECT l, n, 1 FROM far WHERE l IN (SELECT link_id FROM cuts)),
care AS (SELECT h.l, h.half, d.class, d.osm_id FROM halves h JOIN dest d ON d.loc = h.n),
who AS (SELECT h.l, h.half, s.osm_id FROM halves h JOIN subjects s ON s.loc = h.n),
own AS (SELECT w.l, w.osm_id, """ + ", ".join(f"count(*) FILTER (c.class = '{k}' AND c.osm_id <> w.osm_id) > 0 AS had_{k}, count(*) FILTER (c.class = '{k}' AND c.osm_id <> w.osm_id AND c.half = w.half) > 0 AS has_{k}" for k in ("hospital", "town")) + """ FROM who w LEFT JOIN care c ON c.l = w.l GROUP BY 1, 2)""",
        "SELECT link_id, count(*) FILTER (had_hospital AND NOT has_hospital) AS hospital, count(*) FILTER (had_town AND NOT has_town) AS town, count(*) FILTER ((had_hospital AND NOT has_hospital) OR (had_town AND NOT has_town)) AS count FROM cuts LEFT JOIN own ON l = link_id GROUP BY 1", True),
    "route_evidence": _q(ROADS + "," + PLACES + "," + SP + """,
hc AS (SELECT node, cost FROM cost WHERE scenario = 'baseline' AND class = 'hospital'),
ahead AS (SELECT u.node, arg_min(e.v, (e.v, e.link_id)) AS next, arg_min(e.hit, (e.v, e.link_id)) AS hit FROM hc u JOIN (SELECT a AS u, b AS v, travel_ms, link_id, fastest_hit AS hit FROM links UNION ALL SELECT b, a, travel_ms, link_id, fastest_hit FROM links) e ON e.u = u.node JOIN hc w ON w.node = e.v WHERE u.cost > 0 AND w.cost + e.travel_ms = u.cost GROUP BY 1),
walk(node, links, responsible) AS (SELECT node, 0, 0 FROM hc WHERE cost = 0 UNION ALL SELECT a.node, w.links + 1, w.responsible + a.hit::INT FROM walk w JOIN ahead a ON a.next = w.node)""",
        "SELECT node, links, responsible FROM walk", True),
    "link_priorities": _q(DAMAGED + ", s AS (SELECT *, count * 10.0::DOUBLE + hospital * 20 + town * 10 + evidence_tier * 3 AS score FROM dl WHERE count > 0)", "SELECT link_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, link_id) AS rank, format('settlements={} contributes {:.3f}; hospital={} contributes {:.3f}; town={} contributes {:.3f}; evidence={} contributes {:.3f}', count, count * 10.0::DOUBLE, hospital, hospital * 20.0::DOUBLE, town, town * 10.0::DOUBLE, evidence_tier, evidence_tier * 3.0::DOUBLE) AS why FROM s", True),
    "links_without_leverage": _q(DAMAGED, "SELECT link_id, evidence_tier FROM dl WHERE count = 0", True),
    "data_gaps": _q(ROADS + "," + PLACES + "," + ACCESS, "SELECT osm_id, snapped, CASE WHEN NOT snapped THEN 'not on the network' ELSE 'no baseline road access: ' || concat_ws(', ', CASE WHEN NOT baseline_hospital THEN 'hospital' END, CASE WHEN NOT baseline_town THEN 'town' END) END AS reason FROM isolated WHERE status = 'UNCERTAIN' AND (NOT snapped OR NOT baseline_hospital OR NOT baseline_town) AND NOT ((baseline_hospital AND NOT possible_hospital) OR (baseline_town AND NOT possible_town))", True),
}
QUERIES = {f.__name__: f for f in (line_damage, merged_damage, damage_summary, polygon_cells, road_pieces, latent_bridges, route_evidence, link_priorities, links_without_leverage, data_gaps)}
