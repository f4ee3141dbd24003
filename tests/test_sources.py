"""Readers and writers over small files."""

from __future__ import annotations

import datetime as dt
import json

from accessgeo.sources import readers, writers


def test_map_elements_and_roads(spark, tmp_path):
    way = {"type": "way", "id": 1, "version": 2, "timestamp": "2026-08-01T00:00:00Z", "tags": {"highway": "primary", "bridge": "yes", "tunnel": "no"}, "geometry": [{"lon": 0.1, "lat": 0.2}, {"lon": 0.3, "lat": 0.2}]}
    node = {"type": "node", "id": 7, "lon": 1.5, "lat": 2.5, "tags": {"amenity": "hospital"}}
    area = {"type": "way", "id": 8, "center": {"lon": 3.5, "lat": 4.5}, "tags": {"amenity": "clinic"}}
    (tmp_path / "a.json").write_text(json.dumps({"elements": [way, node, area]}))
    e = readers.map_elements(spark, str(tmp_path))
    assert {(r["id"], r["x"], r["y"]) for r in e.collect()} == {(1, None, None), (7, 1.5, 2.5), (8, 3.5, 4.5)}
    (road,) = readers.road_table(e).collect()
    assert (road["highway"], road["is_bridge"], road["is_tunnel"], road["is_ford"], len(road["geometry"])) == ("primary", True, False, False, 2)


def test_scene_items(spark, tmp_path):
    def item(name, box):
        w, s, e, n = box
        return {"id": name, "geometry": {"type": "Polygon", "coordinates": [[[w, s], [e, s], [e, n], [w, n], [w, s]]]}, "properties": {"datetime": "2020-08-09T01:02:03Z", "sar:instrument_mode": "IW", "sar:polarizations": ["VV", "VH"], "sat:orbit_state": "ascending", "sat:relative_orbit": 12}, "assets": {"vv": {"href": "x"}}}

    (tmp_path / "s.json").write_text(json.dumps({"features": [item("a", (0, 0, 1, 2)), item("flat", (0, 0, 0, 2))]}))
    (row,) = readers.scene_items(spark, str(tmp_path)).collect()
    assert (row["id"], row["polarisations"], row["relative_orbit"], row["w"], row["n"], row["assets"]) == ("a", ["VV", "VH"], "12", 0.0, 2.0, ["vv"])


def test_splits_and_dates(spark, tmp_path):
    (tmp_path / "train.csv").write_text("Ghana_1_S1Hand.tif,Ghana_1_LabelHand.tif\n")
    (tmp_path / "val.csv").write_text("x/Peru_2_S1Hand.tif,Peru_2_LabelHand.tif\n")
    assert {tuple(r) for r in readers.splits(spark, f"{tmp_path}/*.csv").collect()} == {("Ghana_1", "train"), ("Peru_2", "val")}
    (tmp_path / "a.xml").write_text("<m:x><m:dateStamp>2020-01-01</m:dateStamp><g:acquisitionDate>2020-08-09</g:acquisitionDate></m:x>")
    (tmp_path / "b.xml").write_text("<x><beginPosition>2020-08-09</beginPosition><beginPosition>2020-08-10</beginPosition></x>")
    assert {(r["file"][-5:], r["date"], r["dates"]) for r in readers.acquisition_dates(spark, f"{tmp_path}/*.xml").collect()} == {("a.xml", dt.date(2020, 8, 9), 1), ("b.xml", None, 2)}


def test_tiles_read_back_by_window(spark, tmp_path):
    rows = [(r, c, float("nan") if (r, c) == (3, 3) else 1.5, True) for r in range(20) for c in range(20)]
    df = spark.createDataFrame(rows, "row int, col int, post_vv float, valid boolean")
    writers.write_tiles(df, f"{tmp_path}/t", 8)
    back = readers.pixels(spark, f"{tmp_path}/t", rows=(2, 4), cols=(3, 3))
    assert sorted((r["row"], r["post_vv"]) for r in back.collect()) == [(2, 1.5), (3, None), (4, 1.5)]


def test_features_and_receipts(spark, tmp_path):
    points = spark.createDataFrame([("a", 1.23456789, float("nan"), 3.5), ("b", 2.0, 4.0, None)], "id string, x double, y double, depth double")
    writers.write_features(points, f"{tmp_path}/f", ["depth"])
    found = [json.loads(r["value"]) for r in spark.read.text(f"{tmp_path}/f").collect()]
    assert {json.dumps(f["geometry"]["coordinates"]) for f in found} == {"[1.234568, null]", "[2.0, 4.0]"} and {f["properties"]["depth"] for f in found} == {3.5, None}
    for k in "12":
        writers.write_receipt(points.limit(1), f"{tmp_path}/r{k}")
    assert spark.read.json(f"{tmp_path}/r1").first()["key"] == spark.read.json(f"{tmp_path}/r2").first()["key"]
