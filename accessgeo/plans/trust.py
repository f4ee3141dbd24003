"""Flags, trust and provenance of one incident per order, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accessgeo.operators import flags
from accessgeo.session import read

#: One incident per order, in words that both engines read.
INCIDENT = [
    'o_orderkey AS incident',
    "case when o_orderkey % 7 = 0 then 'blocked' when o_orderkey % 3 = 0 then 'partial' else 'ready' end AS status",
    "case o_custkey % 11 when 0 then 'no_scenes' when 1 then 'no_same_orbit_pair' else 'ok' end AS pair_status",
    "concat('reason ', o_custkey % 3) AS reason",
    'o_orderkey % 5 = 0 AS widened',
    'case when o_custkey % 11 > 1 then o_orderkey % 9 end AS days_after',
    'case when o_orderkey % 13 > 0 then (50 + o_custkey % 48) / cast(97 as double) end AS valid_fraction',
    "case when o_orderkey % 13 = 0 then null when o_orderkey % 4 = 0 then 'grd_fallback' else 'rtc' end AS s1_source",
    'case when o_orderkey % 13 > 0 then 10 + o_orderkey % 3 * 10 end AS resolution',
    "case when o_orderkey % 6 = 0 then null when o_custkey % 2 = 0 then 'cop-dem-glo-30' else 'other' end AS dem_source",
    'o_orderkey % 7 / cast(193 as double) AS hand_nan_fraction',
    'case when o_custkey % 29 > 0 then o_custkey % 17 / cast(19 as double) end AS road_density',
    'o_custkey % 4 AS hospitals',
    'o_orderkey % 5 AS settlements',
    'case when o_orderkey % 3 > 0 then o_orderkey % 23 / cast(29 as double) end AS stale_share',
    'case when o_orderkey % 8 > 0 then o_custkey % 5 > 0 end AS snapshot_verified',
    'o_orderkey % 2 = 0 AS with_buildings',
    'o_custkey % 6 = 0 AS with_debris',
    'o_custkey % 4 AS hospitals_snapped',
    'o_custkey % 3 AS clinics_snapped',
    'o_orderkey % 6 AS subjects',
    'o_orderkey % 10 AS flood_px',
    'o_custkey % 8 AS links',
    'o_orderkey % 19 = 0 AS drill',
    "case when o_custkey % 31 = 0 then 'soon' else '2024-06-15' end AS flood_date",
]
#: One input per line item.
INPUT = [
    'l_orderkey AS incident',
    'cast(l_linenumber as int) AS place',
    "case l_partkey % 20 when 0 then 'elsewhere' when 1 then null when 2 then 'permitted-training-datasets' when 3 then 'sentinel-1-grd' when 4 then 'sentinel-2' when 5 then 'cop-dem-glo-30' when 6 then 'sentinel-1-rtc' else 'pre-event-openstreetmap' end AS source",
    "case when l_suppkey % 2 = 0 then 'open' end AS collection",
    "case l_linenumber when 1 then 's1_pre' when 2 then 's1_post' when 3 then 'dem' when 4 then 'osm' when 5 then 'notes' end AS role",
    'case when l_suppkey % 9 > 0 then l_suppkey % 7 > 0 end AS snapshot_verified',
    "case l_partkey % 6 when 0 then '2024-06-15' when 1 then '2024-06-15T00:00:01Z' when 2 then '2024-06-15T01:00:00+02:00' when 3 then '2024-06-14T10:00:00' when 4 then null else '2024-01-01' end AS snapshot",
]


def _incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").selectExpr(*INCIDENT)


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey as incident", "element_at(array('aoi', 's1_search', 'preprocess', 'terrain', 'osm'), cast(l_linenumber % 5 + 1 as int)) as stage", "if(l_partkey % 17 = 0, 'failed', 'ok') as status", "concat('error ', l_suppkey % 3) as error")
    return flags.incident_flags(_incidents(spark, sf_dir), stages)


def incident_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags with the message where the rule takes it from the table."""
    return _flags(spark, sf_dir).select("incident", "code", "stage", "severity", F.when(F.col("code").isin("no_same_orbit_pair", "stage_failed"), F.col("message")).alias("message"))


def incident_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags.trust(_incidents(spark, sf_dir), _flags(spark, sf_dir), (F.col("status") == "blocked") & (F.col("limiting") > 0))


def impact_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trust in impacts, whose flags are those of the incident and their own; a drill has none."""
    rows = _incidents(spark, sf_dir)
    return flags.trust(rows, flags.impact_flags(rows, _flags(spark, sf_dir)), F.col("drill"))


def impact_flag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _incidents(spark, sf_dir)
    return flags.impact_flags(rows, _flags(spark, sf_dir)).groupBy("code", "severity").agg(F.count(F.lit(1)).alias("flags"), F.countDistinct("incident").alias("incidents"))


def provenance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = read(spark, sf_dir, "lineitem").selectExpr(*INPUT)
    return flags.provenance_problems(inputs, _incidents(spark, sf_dir))


def _told(rules: list[tuple[str, str, str, str]]) -> str:
    """SQL: one select per code, stage, severity and condition."""
    return " UNION ALL ".join(f"SELECT incident, '{code}' AS code, '{where}' AS stage, {severity} AS severity, {'reason' if code == 'no_same_orbit_pair' else 'NULL'} AS message FROM inc WHERE {test}" for code, where, severity, test in rules)


L, C, I = "'limiting'", "'caution'", "'info'"
FLAGS = f"""WITH inc AS (SELECT {', '.join(INCIDENT)} FROM orders),
fl AS ({_told([
    ("no_same_orbit_pair", "s1_search", L, "pair_status <> 'ok'"), ("widened_post_window", "s1_search", C, "widened"), ("acquisition_gap_long", "s1_search", C, "days_after >= 7"), ("post_on_flood_date", "s1_search", C, "days_after = 0"),
    ("s1_low_valid_fraction", "preprocess", "CASE WHEN valid_fraction < 0.6::DOUBLE THEN 'limiting' ELSE 'caution' END", "valid_fraction < 0.9::DOUBLE"), ("s1_grd_fallback", "preprocess", L, "s1_source = 'grd_fallback'"),
    ("dem_surface_model", "terrain", I, "dem_source LIKE 'cop%'"), ("dem_resampled_30m", "terrain", I, "dem_source LIKE 'cop%' AND resolution <= 20"), ("hand_nan_present", "terrain", C, "hand_nan_fraction > 0.02::DOUBLE"), ("osm_sparse_network", "osm", C, "road_density < 0.3::DOUBLE"),
    ("osm_no_hospitals", "osm", L, "hospitals = 0"), ("osm_no_settlements", "osm", L, "settlements = 0"), ("osm_stale", "osm", C, "stale_share > 0.5::DOUBLE"), ("osm_snapshot_unverified", "osm", L, "road_density IS NOT NULL AND snapshot_verified IS DISTINCT FROM true"), ("buildings_deferred", "osm", I, "NOT with_buildings"),
])} UNION ALL SELECT l_orderkey, 'stage_failed', ['aoi', 's1_search', 'preprocess', 'terrain', 'osm'][l_linenumber % 5 + 1], 'limiting', 'error ' || l_suppkey % 3 FROM lineitem WHERE l_partkey % 17 = 0)"""
IMPACT = FLAGS + f""", own AS ({_told([
    ("road_graph_ignores_oneway_and_vehicle_type", "i", I, "true"), ("travel_time_heuristic", "i", I, "true"), ("damage_is_inundation_not_structural", "i", C, "true"), ("debris_candidate_input", "i", C, "with_debris"), ("buildings_deferred", "i", I, "NOT with_buildings"),
    ("osm_sparse_network", "i", C, "road_density < 0.3::DOUBLE"), ("osm_stale", "i", C, "stale_share > 0.5::DOUBLE"), ("osm_no_hospitals", "i", L, "hospitals_snapped = 0"), ("only_clinics_no_hospitals", "i", C, "hospitals_snapped = 0 AND clinics_snapped > 0"), ("osm_no_settlements", "i", L, "subjects = 0"),
    ("no_flood_detected", "i", I, "flood_px = 0"), ("road_graph_empty", "i", L, "links = 0"),
])}), al AS (SELECT DISTINCT incident, code, severity, message FROM fl UNION ALL SELECT incident, code, severity, message FROM own ANTI JOIN fl USING (incident, code))"""
TRUST = "SELECT incident, limiting, caution, CASE WHEN {none} THEN 'insufficient' WHEN limiting > 0 OR caution > 1 THEN 'uncertain' WHEN caution = 1 THEN 'probable' ELSE 'strong' END AS trust FROM (SELECT inc.incident, any_value(status) AS status, any_value(drill) AS drill, count(*) FILTER (severity = 'limiting') AS limiting, count(*) FILTER (severity = 'caution') AS caution FROM inc LEFT JOIN {flags} f USING (incident) GROUP BY 1)"
SQL = {
    "incident_flags": FLAGS + " SELECT * FROM fl",
    "incident_trust": FLAGS + " " + TRUST.format(none="status = 'blocked' AND limiting > 0", flags="fl"),
    "impact_trust": IMPACT + " " + TRUST.format(none="drill", flags="al"),
    "impact_flag_counts": IMPACT + " SELECT code, severity, count(*) AS flags, count(DISTINCT incident) AS incidents FROM al GROUP BY 1, 2",
    "provenance_gate": f"""WITH inc AS (SELECT {', '.join(INCIDENT)} FROM orders), inp AS (SELECT {', '.join(INPUT)} FROM lineitem),
mm AS (SELECT inp.*, status, CASE WHEN flood_date LIKE '2024%' THEN epoch(TIMESTAMP '2024-06-15') END AS till, CASE WHEN length(snapshot) = 10 THEN epoch(snapshot::TIMESTAMP) WHEN regexp_matches(snapshot, '(Z|[+-][0-9]{{2}}:[0-9]{{2}})$') THEN epoch(snapshot::TIMESTAMPTZ) END AS moment FROM inp JOIN inc USING (incident)),
pr AS (SELECT incident, place, CASE WHEN source IS NULL OR source = 'elsewhere' THEN 'source not allowed' WHEN source LIKE 'permitted%' THEN 'training data not registered' WHEN source LIKE 'pre-event%' THEN CASE WHEN snapshot_verified IS DISTINCT FROM true THEN 'map not verified' WHEN moment IS NULL OR till IS NULL THEN 'time not readable' WHEN moment > till THEN 'map younger than the flood' END END AS problem FROM mm),
ms AS (SELECT incident, r FROM inc, (VALUES ('dem'), ('osm'), ('s1_post'), ('s1_pre')) v(r) WHERE status = 'ready' AND NOT EXISTS (SELECT 1 FROM inp WHERE inp.incident = inc.incident AND role = r))
SELECT * FROM pr WHERE problem IS NOT NULL UNION ALL SELECT incident, NULL, 'missing ' || string_agg(r, ', ' ORDER BY r) FROM ms GROUP BY 1""",
}
QUERIES = {f.__name__: f for f in (incident_flags, incident_trust, impact_trust, impact_flag_counts, provenance_gate)}
