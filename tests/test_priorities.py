"""Which settlements the flood explains, their terms, and the weights that users may set."""

from __future__ import annotations

import pytest

from accessgeo.functions.roads import SETTLEMENT_WEIGHTS, STATUS_POINTS
from accessgeo.operators import scoring, settlements

FINAL = "osm_id string, place string, snapped boolean, status string, access_detail string, baseline_hospital boolean, baseline_town boolean, lost_likely_hospital boolean, lost_likely_town boolean, lost_possible_hospital boolean, lost_possible_town boolean, responsible bigint, ones bigint, twos bigint, detour_hospital double, detour_town double, detour_clinic double, likely_comp bigint"


def row(osm_id, status="CONNECTED", detail="full", base=(True, True), likely=(False, False), possible=(False, False), hits=(0, 0, 0), detours=(1.0, 1.0, None), comp=1, snapped=True):
    return (osm_id, "village", snapped, status, detail, *base, *likely, *possible, *hits, *detours, comp)


@pytest.fixture(scope="module")
def found(spark):
    rows = [
        row("cut", "CUT OFF", "none", likely=(True, False), possible=(True, False), comp=5),
        row("cut too", "CUT OFF", "none", likely=(True, True), possible=(True, True), hits=(3, 0, 0), comp=5),
        row("fine"), row("hit but fine", hits=(2, 0, 2)),
        row("slow", detail="degraded", hits=(1, 0, 1), detours=(1.0, 14.0, None)), row("slow without a hit", detail="degraded", detours=(1.0, 2.0, None)), row("slow clinic", hits=(1, 0, 0), detours=(1.0, 1.0, 1.6)),
        row("possible", "UNCERTAIN", "full", possible=(False, True), hits=(1, 1, 0)), row("possible without a hit", "UNCERTAIN", possible=(False, True)), row("doubtful", "UNCERTAIN", hits=(2, 2, 0)),
        row("unmapped", "UNCERTAIN", "unmapped", base=(False, True)), row("unmapped and hit", "UNCERTAIN", "unmapped", base=(False, True), hits=(1, 1, 0)), row("nowhere", "UNCERTAIN", "unmapped", snapped=False, comp=None),
    ]
    links = spark.createDataFrame([(10, 20, 2, True), (20, 30, 1, True), (11, 10, 3, True), (40, 10, 1, False)], "a bigint, b bigint, evidence_tier int, lost_likely boolean")
    likely = spark.createDataFrame([(10, 5), (11, 5), (20, 7), (30, 8), (40, 1)], "node bigint, comp bigint")
    buildings = spark.createDataFrame([("cut", 40), ("cut too", 9), ("slow", 99), ("fine", 1)], "osm_id string, buildings bigint")
    return settlements.attributed(spark.createDataFrame(rows, FINAL), buildings, links, likely)


def test_what_the_flood_explains_and_what_is_a_gap(found):
    rows = found.collect()
    assert {r["osm_id"] for r in rows if r["attributable"]} == {"cut", "cut too", "slow", "slow clinic", "possible", "doubtful"}
    assert {r["osm_id"] for r in rows if r["gap"]} == {"unmapped", "unmapped and hit", "nowhere"}


def test_tiers_buildings_and_detours(found):
    rows = {r["osm_id"]: (r["tier"], r["cluster_buildings"], r["detour"]) for r in found.collect()}
    assert rows["cut"] == (2, 49, 1.0) and rows["cut too"] == (2, 49, 1.0)  # around component 5 lies one removed link, of tier 2
    assert rows["slow"] == (2, 99, 14.0) and rows["slow clinic"] == (3, 0, 1.6) and rows["doubtful"][0] == 1 and rows["fine"] == (0, 1, 1.0)


def test_scores_have_all_terms(found):
    rows = {r["osm_id"]: r for r in scoring.settlement_scores(found, STATUS_POINTS, scoring.chosen_weights(SETTLEMENT_WEIGHTS)).collect()}
    assert rows["slow"]["score"] == 20 + 20 + 2 * 5 + 9 * 5 and rows["slow"]["confidence"] == "probable"
    assert rows["possible"]["score"] == 40 + 5 and rows["slow clinic"]["score"] == pytest.approx(15 + 0.6 * 5)
    assert rows["cut too"]["rank"] == 1 and rows["cut too"]["why"].startswith("status=CUT OFF contributes 100.000; hospital=1 contributes 50.000; town=1 contributes 20.000; buildings=49 contributes 16.990; evidence=2 contributes 10.000; detour=1.000")
    other = {r["osm_id"]: r["score"] for r in scoring.settlement_scores(found, STATUS_POINTS, scoring.chosen_weights(SETTLEMENT_WEIGHTS, {"detour": 0.0}), building_log_cap=1).collect()}
    assert other["slow"] == 20 + 10 + 10


def test_weights_and_caps_are_checked(found):
    for own in ({"fame": 1.0}, {"town": -1.0}, {"town": float("nan")}):
        with pytest.raises(ValueError, match="weights"):
            scoring.chosen_weights(SETTLEMENT_WEIGHTS, own)
    with pytest.raises(ValueError, match="cap"):
        scoring.settlement_scores(found, STATUS_POINTS, SETTLEMENT_WEIGHTS, detour_cap=0.5)
