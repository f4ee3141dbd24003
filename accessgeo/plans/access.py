"""Queries on the final status of settlements, ways between towns, and restoration of clusters, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accessgeo.functions.roads import SETTLEMENT_WEIGHTS, STATUS_POINTS
from accessgeo.operators import network, scoring, settlements
from accessgeo.plans.oracles import ACCESS, BUILDINGS, PLACES, ROADS, SP, _q
from accessgeo.plans.queries import _isolated, buildings_near
from accessgeo.session import checkpointed
from accessgeo.sources import adapters


def _graphs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    m = adapters.road_members(spark, sf_dir)
    return {"baseline": checkpointed(network.build_links(m)), "likely": checkpointed(network.surviving(m, 2))}


def other_town_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest other town of every town, before the flood and in the likely scenario."""
    graphs, places = _graphs(spark, sf_dir), adapters.destinations(spark, sf_dir).where("class = 'town'")
    found = checkpointed(network.routes(places, graphs))
    edges = settlements.both_ways(graphs["baseline"], "baseline").unionByName(settlements.both_ways(graphs["likely"], "likely"))
    return settlements.other_towns(found, edges, places.select("osm_id", "at")).select("scenario", "osm_id", "cost", "target")


def _settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    graphs, places = _graphs(spark, sf_dir), adapters.destinations(spark, sf_dir)
    return settlements.analysed(checkpointed(_isolated(spark, sf_dir)), places, graphs, network.routes(places, graphs))


def settlement_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status after the rule on uncertain evidence, its reason, detail and detours."""
    out = _settled(spark, sf_dir)
    return out.select("osm_id", "status", "reason", "access_detail", "responsible", "ones", *[F.round(f"detour_{k}", 9).alias(f"detour_{k}") for k in settlements.MAIN])


def status_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three fixed statuses, also those that nobody has."""
    names = spark.createDataFrame([("CUT OFF",), ("UNCERTAIN",), ("CONNECTED",)], "status string")
    counted = _settled(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return names.join(counted, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def cluster_restoration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapped buildings of each cluster of cut-off settlements, and which of its boundary links would suffice."""
    m = adapters.road_members(spark, sf_dir)
    links = network.build_links(m)
    likely = checkpointed(network.component_of(network.nodes_of(links), network.surviving(m, 2)))
    return settlements.restoration(_isolated(spark, sf_dir), adapters.destinations(spark, sf_dir), links, likely, buildings_near(spark, sf_dir))


def _attributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = adapters.road_members(spark, sf_dir)
    links = network.build_links(m)
    likely = checkpointed(network.component_of(network.nodes_of(links), network.surviving(m, 2)))
    return settlements.attributed(checkpointed(_settled(spark, sf_dir)), buildings_near(spark, sf_dir), links, likely)


def settlement_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranking of the settlements whose state the flood explains, with all terms of the score."""
    return scoring.settlement_scores(_attributed(spark, sf_dir), STATUS_POINTS, scoring.chosen_weights(SETTLEMENT_WEIGHTS))


def settlement_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uncertain settlements that nothing but missing data explains, after the rule on uncertain evidence."""
    return _attributed(spark, sf_dir).where("gap").select("osm_id", "status", "reason", "snapped")


REGIONS = ROADS + "," + PLACES + "," + SP + """,
tight AS MATERIALIZED (SELECT e.scenario, a.class, e.u, e.v FROM re e JOIN cost a ON a.scenario = e.scenario AND a.node = e.u AND a.class <> 'clinic' JOIN cost b ON b.scenario = e.scenario AND b.class = a.class AND b.node = e.v AND b.cost = a.cost + e.w),
near_dest AS (SELECT loc, class, min(osm_id) AS osm_id FROM dest GROUP BY 1, 2),
tgt(s, c, n, t) USING KEY (s, c, n) AS (SELECT k.scenario, k.class, k.node, coalesce(d.osm_id, '~') FROM cost k LEFT JOIN near_dest d ON d.loc = k.node AND d.class = k.class AND k.cost = 0 WHERE k.class <> 'clinic' UNION
  SELECT e.scenario, tgt.c, e.v, min(tgt.t) FROM tgt JOIN tight e ON e.u = tgt.n AND e.scenario = tgt.s AND e.class = tgt.c JOIN recurring.tgt r ON r.s = tgt.s AND r.c = tgt.c AND r.n = e.v WHERE tgt.t < r.t GROUP BY 1, 2, 3),
near AS MATERIALIZED (SELECT scenario, class, node, cost, t AS target FROM cost JOIN tgt ON s = scenario AND c = class AND n = node),
leave AS (SELECT e.scenario, x.target AS osm_id, x.cost + e.w + y.cost AS cost, y.target, e.u, e.v FROM re e JOIN near x ON x.scenario = e.scenario AND x.class = 'town' AND x.node = e.u JOIN near y ON y.scenario = e.scenario AND y.class = 'town' AND y.node = e.v WHERE x.target <> y.target),
out AS MATERIALIZED (SELECT scenario, osm_id, min(cost) AS cost, arg_min(target, (cost, target, u, v)) AS target, arg_min(u, (cost, target, u, v)) AS u, arg_min(v, (cost, target, u, v)) AS v FROM leave GROUP BY 1, 2)
"""
FINAL = REGIONS + "," + ACCESS + """,
fl AS (SELECT a, b, link_id, travel_ms, fastest_hit::INT AS responsible, (fastest_hit AND evidence_tier = 1)::INT AS ones, (fastest_hit AND evidence_tier = 2)::INT AS twos FROM links),
fe AS (SELECT a AS u, b AS v, link_id, travel_ms, responsible, ones, twos FROM fl UNION ALL SELECT b, a, link_id, travel_ms, responsible, ones, twos FROM fl),
hc AS (SELECT class, node, cost, target FROM near WHERE scenario = 'baseline'),
ahead AS MATERIALIZED (SELECT x.class, x.node, arg_min(e.v, (e.v, e.link_id)) AS next, arg_min(e.responsible, (e.v, e.link_id)) AS responsible, arg_min(e.ones, (e.v, e.link_id)) AS ones, arg_min(e.twos, (e.v, e.link_id)) AS twos FROM hc x JOIN fe e ON e.u = x.node JOIN hc y ON y.class = x.class AND y.target = x.target AND y.node = e.v WHERE x.cost > 0 AND y.cost + e.travel_ms = x.cost GROUP BY 1, 2),
walk(class, node, responsible, ones, twos) AS (SELECT class, node, 0, 0, 0 FROM hc WHERE cost = 0 UNION ALL SELECT a.class, a.node, w.responsible + a.responsible, w.ones + a.ones, w.twos + a.twos FROM walk w JOIN ahead a ON a.next = w.node AND a.class = w.class),
hops AS (SELECT s.osm_id, w.responsible, w.ones, w.twos FROM subjects s JOIN walk w ON w.node = s.loc WHERE w.class = 'hospital' OR s.place <> 'town'
  UNION ALL SELECT o.osm_id, w.responsible, w.ones, w.twos FROM out o JOIN walk w ON w.class = 'town' AND w.node IN (o.u, o.v) WHERE o.scenario = 'baseline' UNION ALL SELECT o.osm_id, e.responsible, e.ones, e.twos FROM out o JOIN fe e ON e.u = o.u AND e.v = o.v WHERE o.scenario = 'baseline'),
met AS (SELECT osm_id, sum(responsible)::BIGINT AS responsible, sum(ones)::BIGINT AS ones, sum(twos)::BIGINT AS twos FROM hops GROUP BY 1),
tm AS (SELECT osm_id, """ + ", ".join(f"min(cost) FILTER (scenario = '{s}' AND class = '{k}') AS {s}_{k}_ms" for s in ("baseline", "likely") for k in ("hospital", "town", "clinic")) + """ FROM
  (SELECT s.osm_id, k.scenario, k.class, k.cost FROM subjects s JOIN cost k ON k.node = s.loc WHERE k.class = 'clinic' UNION ALL SELECT s.osm_id, n.scenario, n.class, n.cost FROM subjects s JOIN near n ON n.node = s.loc WHERE n.class = 'hospital' OR s.place <> 'town' UNION ALL SELECT osm_id, scenario, 'town', cost FROM out) GROUP BY 1),
de AS (SELECT i.*, coalesce(responsible, 0) AS responsible, coalesce(ones, 0) AS ones, coalesce(twos, 0) AS twos, baseline_hospital AND NOT possible_hospital OR baseline_town AND NOT possible_town AS lost_p, """ + ", ".join(f"CASE WHEN baseline_{k}_ms IS NULL OR likely_{k}_ms IS NULL THEN NULL WHEN baseline_{k}_ms = 0 THEN 1.0::DOUBLE ELSE likely_{k}_ms / baseline_{k}_ms END AS detour_{k}" for k in ("hospital", "town", "clinic")) + """ FROM isolated i LEFT JOIN met USING (osm_id) LEFT JOIN tm USING (osm_id)),
fin AS (SELECT osm_id, CASE WHEN status = 'CONNECTED' AND responsible > 0 AND responsible = ones THEN 'UNCERTAIN' ELSE status END AS status, CASE WHEN NOT snapped THEN 'not on the network' WHEN lost_h OR lost_t THEN 'lost in the likely scenario' WHEN lost_p THEN 'lost only in the possible scenario'
  WHEN NOT baseline_hospital OR NOT baseline_town THEN 'no baseline road access: ' || concat_ws(', ', CASE WHEN NOT baseline_hospital THEN 'hospital' END, CASE WHEN NOT baseline_town THEN 'town' END) WHEN responsible > 0 AND responsible = ones THEN 'way hit by uncertain evidence only' ELSE 'access kept' END AS reason,
  CASE WHEN NOT snapped THEN 'unmapped' WHEN lost_h OR lost_t THEN 'none' WHEN NOT baseline_hospital OR NOT baseline_town THEN 'unmapped' WHEN coalesce(greatest(detour_hospital, detour_town) > 1.5, false) THEN 'degraded' ELSE 'full' END AS access_detail, responsible, ones, round(detour_hospital, 9) AS detour_hospital, round(detour_town, 9) AS detour_town FROM de)
"""
SQL = {
    "other_town_routes": _q(REGIONS, "SELECT n.scenario, d.osm_id, o.cost, o.target FROM dest d JOIN nodes ON node = d.loc JOIN near n ON n.class = 'town' AND n.node = d.loc LEFT JOIN out o ON o.scenario = n.scenario AND o.osm_id = d.osm_id WHERE d.class = 'town'", True),
    "settlement_access": _q(FINAL, "SELECT * FROM fin", True),
    "status_tallies": _q(FINAL, "SELECT t.s AS status, count(f.osm_id) AS n FROM (VALUES ('CUT OFF'), ('UNCERTAIN'), ('CONNECTED')) t(s) LEFT JOIN fin f ON f.status = t.s GROUP BY 1", True),
    "cluster_restoration": _q(ROADS + "," + PLACES + "," + ACCESS + "," + BUILDINGS + """,
cut AS (SELECT c.comp, i.osm_id, lost_h, lost_t, buildings FROM isolated i JOIN comp c ON c.scenario = 'likely' AND c.node = i.loc JOIN buildings USING (osm_id) WHERE status = 'CUT OFF'),
gone AS (SELECT link_id, x.comp AS ca, y.comp AS cb FROM links JOIN comp x ON x.scenario = 'likely' AND x.node = a JOIN comp y ON y.scenario = 'likely' AND y.node = b WHERE lost_likely AND x.comp <> y.comp),
placed AS (SELECT z.comp, d.class, d.osm_id FROM dest d JOIN comp z ON z.scenario = 'likely' AND z.node = d.loc),
member AS (SELECT c.comp, g.link_id, c.buildings, (NOT lost_h OR EXISTS (SELECT 1 FROM placed p WHERE p.class = 'hospital' AND p.comp IN (g.ca, g.cb) AND p.osm_id <> c.osm_id)) AND (NOT lost_t OR EXISTS (SELECT 1 FROM placed p WHERE p.class = 'town' AND p.comp IN (g.ca, g.cb) AND p.osm_id <> c.osm_id)) AS ok FROM cut c JOIN gone g ON c.comp IN (g.ca, g.cb))""",
        "SELECT comp, sum(buildings)::BIGINT AS buildings, link_id, bool_and(ok) AS sufficient FROM member GROUP BY 1, 3", True),
}
ATTRIBUTED = FINAL + "," + BUILDINGS + """,
at0 AS (SELECT d.*, f.status AS final, f.reason, f.access_detail, c.comp AS lc, b.buildings FROM de d JOIN fin f USING (osm_id) JOIN buildings b USING (osm_id) LEFT JOIN comp c ON c.scenario = 'likely' AND c.node = d.loc),
tot AS (SELECT lc, sum(buildings) AS total FROM at0 WHERE final = 'CUT OFF' GROUP BY 1),
aro AS (SELECT lc, min(evidence_tier) AS around FROM (SELECT unnest([x.comp, y.comp]) AS lc, evidence_tier FROM links JOIN comp x ON x.scenario = 'likely' AND x.node = a JOIN comp y ON y.scenario = 'likely' AND y.node = b WHERE lost_likely AND x.comp <> y.comp) GROUP BY 1),
at1 AS (SELECT *, CASE WHEN final = 'CUT OFF' THEN greatest(buildings, coalesce(total, 0)) ELSE buildings END::BIGINT AS cb, coalesce(least(CASE WHEN ones > 0 THEN 1 WHEN twos > 0 THEN 2 WHEN responsible > 0 THEN 3 END, CASE WHEN final = 'CUT OFF' THEN around END), 0) AS tier, coalesce(greatest(detour_hospital, detour_town, detour_clinic), 1) AS detour
  FROM at0 LEFT JOIN tot USING (lc) LEFT JOIN aro USING (lc)),
att AS (SELECT *, final = 'CUT OFF' OR (snapped AND responsible > 0 AND (access_detail = 'degraded' OR detour > 1.5)) OR (final = 'UNCERTAIN' AND snapped AND responsible > 0 AND (lost_p OR (baseline_hospital AND baseline_town AND ones > 0))) AS attributable FROM at1)"""
SQL |= {
    "settlement_priorities": _q(ATTRIBUTED + """,
sv AS (SELECT *, CASE WHEN final = 'CONNECTED' AND access_detail = 'degraded' THEN 'degraded' ELSE final END AS st, lost_h::INT AS h, lost_t::INT AS t, least(log10(cb + 1), 3) AS b, greatest(least(detour, 10) - 1, 0) AS dd FROM att WHERE attributable),
sr AS (SELECT *, CASE st WHEN 'CUT OFF' THEN 100 WHEN 'UNCERTAIN' THEN 40 WHEN 'degraded' THEN 20 ELSE 0 END AS sp FROM sv),
ss AS (SELECT *, round(0.0::DOUBLE + sp + h * 50.0::DOUBLE + t * 20.0::DOUBLE + b * 10.0::DOUBLE + tier * 5.0::DOUBLE + dd * 5.0::DOUBLE, 6) AS score FROM sr)""",
        "SELECT osm_id, score, row_number() OVER (ORDER BY score DESC, osm_id) AS rank, format('status={} contributes {:.3f}; hospital={} contributes {:.3f}; town={} contributes {:.3f}; buildings={} contributes {:.3f}; evidence={} contributes {:.3f}; detour={:.3f} contributes {:.3f}', st, sp::DOUBLE, h, h * 50.0::DOUBLE, t, t * 20.0::DOUBLE, cb, b * 10, tier, tier * 5.0::DOUBLE, detour, dd * 5) AS why, CASE tier WHEN 3 THEN 'strong' WHEN 2 THEN 'probable' ELSE 'uncertain' END AS confidence FROM ss", True),
    "settlement_gaps": _q(ATTRIBUTED, "SELECT osm_id, final AS status, reason, snapped FROM att WHERE NOT attributable AND final = 'UNCERTAIN' AND (NOT snapped OR NOT baseline_hospital OR NOT baseline_town)", True),
}
QUERIES = {f.__name__: f for f in (other_town_routes, settlement_access, status_tallies, cluster_restoration, settlement_priorities, settlement_gaps)}
