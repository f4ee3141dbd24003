"""A case for each rule of the flags, trust and provenance."""

from __future__ import annotations

import re

import pytest

from accessgeo.operators import flags

#: An incident on which no rule holds, and what makes each rule hold.
SOUND = {
    "pair_status": "ok", "reason": None, "widened": False, "days_after": 3, "valid_fraction": 0.9, "s1_source": "rtc", "resolution": 30, "dem_source": "other", "hand_nan_fraction": 0.02, "road_density": 0.3,
    "hospitals": 1, "settlements": 1, "stale_share": 0.5, "snapshot_verified": True, "with_buildings": True, "with_debris": False, "hospitals_snapped": 1, "clinics_snapped": 0, "subjects": 1, "flood_px": 1, "links": 1,
}
TYPES = "incident int, pair_status string, reason string, widened boolean, days_after int, valid_fraction double, s1_source string, resolution int, dem_source string, hand_nan_fraction double, road_density double, hospitals int, settlements int, stale_share double, snapshot_verified boolean, with_buildings boolean, with_debris boolean, hospitals_snapped int, clinics_snapped int, subjects int, flood_px int, links int"
INCIDENT = [
    ({}, set()), ({"pair_status": "no_scenes", "reason": "none found"}, {("no_same_orbit_pair", "limiting", "none found")}), ({"widened": True}, {("widened_post_window", "caution")}), ({"days_after": 7}, {("acquisition_gap_long", "caution", "the scene was taken 7 days after the flood")}),
    ({"days_after": 0}, {("post_on_flood_date", "caution")}), ({"valid_fraction": 0.7}, {("s1_low_valid_fraction", "caution", "0.7000 of the cells are valid in both scenes")}), ({"valid_fraction": 0.5}, {("s1_low_valid_fraction", "limiting")}), ({"s1_source": "grd_fallback"}, {("s1_grd_fallback", "limiting")}),
    ({"dem_source": "cop-dem-glo-30"}, {("dem_surface_model", "info")}), ({"dem_source": "cop-dem-glo-30", "resolution": 10}, {("dem_surface_model", "info"), ("dem_resampled_30m", "info")}), ({"hand_nan_fraction": 0.21}, {("hand_nan_present", "caution", "21.00 % of the cells have no height above drainage")}),
    ({"road_density": 0.29}, {("osm_sparse_network", "caution")}), ({"hospitals": 0}, {("osm_no_hospitals", "limiting")}), ({"settlements": 0}, {("osm_no_settlements", "limiting")}), ({"stale_share": 0.51}, {("osm_stale", "caution")}), ({"snapshot_verified": None}, {("osm_snapshot_unverified", "limiting")}),
    ({"with_buildings": False}, {("buildings_deferred", "info")}), ({k: None for k in SOUND}, set()),
]
ALWAYS = {("road_graph_ignores_oneway_and_vehicle_type", "info"), ("travel_time_heuristic", "info"), ("damage_is_inundation_not_structural", "caution")}
IMPACT = [
    ({}, set()), ({"with_debris": True}, {("debris_candidate_input", "caution")}), ({"with_buildings": False}, {("buildings_deferred", "info")}), ({"road_density": 0.2}, {("osm_sparse_network", "caution")}), ({"stale_share": 0.6}, {("osm_stale", "caution")}), ({"hospitals_snapped": 0}, {("osm_no_hospitals", "limiting")}),
    ({"hospitals_snapped": 0, "clinics_snapped": 2}, {("osm_no_hospitals", "limiting"), ("only_clinics_no_hospitals", "caution")}), ({"subjects": 0}, {("osm_no_settlements", "limiting")}), ({"flood_px": 0}, {("no_flood_detected", "info")}), ({"links": 0}, {("road_graph_empty", "limiting")}),
]


def incidents(spark, cases):
    return spark.createDataFrame([(k, *(SOUND | change).values()) for k, (change, _) in enumerate(cases)], TYPES)


@pytest.mark.parametrize(("rules", "cases", "always"), [(flags.INCIDENT_RULES, INCIDENT, set()), (flags.IMPACT_RULES, IMPACT, ALWAYS)])
def test_each_rule(spark, rules, cases, always):
    found = {}
    for r in flags.flagged(incidents(spark, cases), rules).collect():
        found.setdefault(r.incident, []).append((r.code, r.severity, r.message))
    for k, (_, told) in enumerate(cases):
        assert {x[:2] for x in found.get(k, [])} == {x[:2] for x in told} | always, cases[k]
        assert {x for x in told if len(x) == 3} <= set(found.get(k, []))


def test_failed_stages_and_empty_tables(spark):
    rows = incidents(spark, [({}, set())])
    stages = spark.createDataFrame([(0, "terrain", "failed", "no heights"), (0, "osm", "ok", None)], "incident int, stage string, status string, error string")
    assert [tuple(r) for r in flags.incident_flags(rows, stages).collect()] == [(0, "stage_failed", "terrain", "limiting", "no heights")]
    assert flags.incident_flags(rows.limit(0), stages.limit(0)).count() == 0


def test_codes_handed_on_are_not_raised_again(spark):
    rows = incidents(spark, [({"links": 0, "with_buildings": False}, set()), ({"links": 0}, set())])
    before = spark.createDataFrame([(0, "buildings_deferred", "osm", "info", "a"), (0, "buildings_deferred", "aoi", "info", "a"), (0, "buildings_deferred", "osm", "info", "b"), (0, "road_graph_empty", "x", "caution", "c")], "incident int, code string, stage string, severity string, message string")
    found = sorted((r.incident, r.code, r.severity, r.message) for r in flags.impact_flags(rows, before).collect() if r.code in ("buildings_deferred", "road_graph_empty"))
    assert found == [(0, "buildings_deferred", "info", "a"), (0, "buildings_deferred", "info", "b"), (0, "road_graph_empty", "caution", "c"), (1, "road_graph_empty", "limiting", "no road is mapped")]


def test_trust(spark):
    rows = spark.createDataFrame([(k, s) for k, s in enumerate(["ready", "ready", "ready", "ready", "blocked", "blocked"])], "incident int, status string")
    found = spark.createDataFrame([(1, "info"), (1, "caution"), (2, "caution"), (2, "caution"), (3, "limiting"), (4, "limiting"), (5, "caution")], "incident int, severity string")
    told = {r.incident: r.trust for r in flags.trust(rows, found, (rows.status == "blocked") & (flags.F.col("limiting") > 0)).collect()}
    assert told == {0: "strong", 1: "probable", 2: "uncertain", 3: "uncertain", 4: "insufficient", 5: "probable"}


def test_provenance(spark):
    osm = "pre-event-openstreetmap"
    inputs = [
        (1, 0, "sentinel-1-rtc", None, "s1_pre", None, None), (1, 1, "sentinel-1-grd", None, "s1_post", None, None), (1, 2, "cop-dem-glo-30", None, "dem", None, None), (1, 3, osm, None, "osm", True, "2024-06-15"),
        (2, 0, "my-own", None, "dem", None, None), (2, 1, None, None, "osm", None, None), (2, 2, "permitted-training-datasets", "open", "x", None, None), (2, 3, "permitted-training-datasets", "shut", None, None, None),
        (3, 0, osm, None, None, None, "2024-01-01"), (3, 1, osm, None, None, True, "2024-06-15T00:00:01Z"), (3, 2, osm, None, None, True, "2024-06-15T01:00:00+02:00"), (3, 3, osm, None, None, True, "2024-06-14T10:00:00"), (3, 4, osm, None, None, True, None),
    ]
    table = spark.createDataFrame(inputs, "incident int, place int, source string, collection string, role string, snapshot_verified boolean, snapshot string")
    rows = spark.createDataFrame([(1, "ready", "2024-06-15"), (2, "ready", "2024-06-15"), (3, "partial", "2024-06-15"), (4, "ready", "2024-06-15")], "incident int, status string, flood_date string")
    found = sorted(flags.provenance_problems(table, rows, ["open"]).collect(), key=lambda r: (r.incident, r.place is None, r.place or 0))
    assert [tuple(r) for r in found] == [
        (2, 0, "source not allowed"), (2, 1, "source not allowed"), (2, 3, "training data not registered"), (2, None, "missing s1_post, s1_pre"),
        (3, 0, "map not verified"), (3, 1, "map younger than the flood"), (3, 3, "time not readable"), (3, 4, "time not readable"), (4, None, "missing dem, osm, s1_post, s1_pre"),
    ]


def test_texts_of_inputs_do_not_travel(spark, capsys):
    """Rows are narrow before a shuffle: a task that sorts them else holds the texts of all inputs."""
    table = spark.createDataFrame([(1, 0, "my-own", None, "dem", True, "2024-01-01")], "incident int, place int, source string, collection string, role string, snapshot_verified boolean, snapshot string")
    rows = spark.createDataFrame([(1, "ready", "2024-06-15")], "incident int, status string, flood_date string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        flags.provenance_problems(table, rows).explain("formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    sent = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", capsys.readouterr().out)
    assert len(sent) >= 3 and not any(re.search(r"\b(source|collection|role|snapshot|flood_date)#", x) for x in sent)


def test_inputs_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(flags, "PART_ROWS", 10)
    table = spark.range(95).selectExpr("cast(id as int) as incident", "0 as place", "'my-own' as source", "'x' as collection", "'dem' as role", "true as snapshot_verified", "'2024-01-01' as snapshot")
    out = flags.provenance_problems(table, spark.range(95).selectExpr("cast(id as int) as incident", "'partial' as status", "'2024-06-15' as flood_date"))
    assert "10), REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 95
