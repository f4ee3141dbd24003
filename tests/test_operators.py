"""Operators over tiny tables with known answers."""

from __future__ import annotations

import datetime as dt
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from accessgeo.operators import agreement, areas, damage, elements, exposure, facts, fixpoint, hydrology, metrics, network, paths, raster, scenes, scoring


def cells(spark, values, name="z", kind="double"):
    return spark.createDataFrame([(r, c, v) for r, row in enumerate(values) for c, v in enumerate(row)], f"row int, col int, {name} {kind}")


def grid(df, name):
    return {(r["row"], r["col"]): r[name] for r in df.collect()}


class TestPixels:
    def frame(self, spark, rows):
        return spark.createDataFrame([(0, k, *r) for k, r in enumerate(rows)], "row int, col int, p_post double, p_pre double, hand double, slope double, dvv double, dvh double, valid boolean")

    def tiers(self, spark, rows, **options):
        px = raster.classify(self.frame(spark, rows), **options)
        return [r["t"] for r in px.withColumn("t", raster.tier(F.col("new_water") & F.col("plausible"))).orderBy("col").collect()]

    def test_tiers(self, spark):
        rows = [(0.95, 0.1, 1.0, 1.0, -4.0, 0.0, True), (0.7, 0.1, 1.0, 1.0, -4.0, 0.0, True), (0.7, 0.4, 1.0, 1.0, 0.0, 0.0, True), (0.7, 0.1, 1.0, 1.0, 0.0, -4.0, True)]
        assert self.tiers(spark, rows) == [3, 2, 1, 2]

    def test_terrain_that_is_high_steep_or_unknown_is_excluded(self, spark):
        rows = [(0.9, 0.1, h, s, 0.0, 0.0, True) for h, s in ((16.0, 1.0), (1.0, 21.0), (None, 1.0), (1.0, None), (15.0, 20.0))]
        assert [r["excluded"] for r in raster.classify(self.frame(spark, rows)).orderBy("col").collect()] == [True, True, True, True, False]

    def test_water_before_the_flood_is_no_flood_and_invalid_is_nothing(self, spark):
        assert self.tiers(spark, [(0.9, 0.9, 1.0, 1.0, -4.0, 0.0, True), (0.9, 0.1, 1.0, 1.0, -4.0, 0.0, False), (None, 0.1, 1.0, 1.0, -4.0, 0.0, True)]) == [0, 0, 0]

    def test_decibels(self, spark):
        df = spark.createDataFrame([(x,) for x in (0.1, 1.0, 1e-6, 100.0, 0.0, -1.0, float("nan"), float("inf"))], "p double")
        assert [r[0] for r in df.select(raster.power_to_db(F.nanvl("p", F.lit(None)))).collect()] == [-10, 0, -35, 5, None, None, None, None]


class TestMorphology:
    def mask(self, spark, drawing):
        return spark.createDataFrame([(r, c) for r, line in enumerate(drawing) for c, x in enumerate(line) if x == "#"], "row int, col int")

    def test_diagonal_cells_are_one_component(self, spark):
        found = raster.remove_small(self.mask(spark, ["#..", ".#.", "...", "..#"]), 2)
        assert {(r["row"], r["col"]): r["kept"] for r in found.collect()} == {(0, 0): True, (1, 1): True, (3, 2): False}

    @pytest.mark.parametrize(("most", "filled"), [(2, {(2, 2)}), (1, set())])
    def test_a_hole_is_filled_if_it_is_smaller_than_the_limit(self, spark, most, filled):
        flood = self.mask(spark, [".....", ".###.", ".#.#.", ".###.", "....."])
        whole = spark.createDataFrame([(r, c, True) for r in range(5) for c in range(5)], "row int, col int, eligible boolean")
        found = raster.fill_holes(whole, flood, most)
        assert {(r["row"], r["col"]) for r in found.collect() if r["filled"]} == filled

    def test_a_hole_with_a_cell_that_may_not_fill_is_blocked(self, spark):
        flood = self.mask(spark, [".....", ".###.", ".#.#.", ".###.", "....."])
        whole = spark.createDataFrame([(r, c, (r, c) != (2, 2)) for r in range(5) for c in range(5)], "row int, col int, eligible boolean")
        assert [r["filled"] for r in raster.fill_holes(whole, flood, 9).collect()] == [False]

    def test_near(self, spark):
        assert {tuple(r) for r in raster.near(self.mask(spark, ["...", ".#."]), 1).collect()} == {(1, 1), (0, 1), (2, 1), (1, 0), (1, 2)}

    def test_near_equals_the_disks(self, spark):
        rng = random.Random(3)
        wet = {(rng.randrange(30), rng.randrange(30)) for _ in range(40)}
        df = spark.createDataFrame(sorted(wet), "row int, col int")
        for reach in (0, 1.5, 4.4, 5):
            found = [tuple(r) for r in raster.near(df, reach).select("row", "col").collect()]
            told = {(r + a, c + b) for r, c in wet for a in range(-5, 6) for b in range(-5, 6) if a * a + b * b <= reach * reach}
            assert len(found) == len(told) and set(found) == told

    def test_components_by_joins_equal_those_of_one_task(self, spark):
        rng = random.Random(5)
        edges = spark.createDataFrame([(k, k + 1) for k in range(80)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(70)], "u bigint, v bigint")
        nodes = spark.range(0, 310).withColumnRenamed("id", "node")
        one, joined = (sorted(tuple(r) for r in fixpoint.components(nodes, edges, local).collect()) for local in (1_000, 0))
        assert one == joined and len(one) == 310


class TestTerrain:
    def test_slope_of_a_tilted_plane(self, spark):
        out = raster.slope_degrees(cells(spark, [[c * 1.0 + r * 2.0 for c in range(4)] for r in range(4)]), "z", 10)
        assert all(math.isclose(v, math.degrees(math.atan(math.hypot(0.1, 0.2)))) for v in grid(out, "slope").values())

    def test_no_slope_in_and_beside_a_void(self, spark):
        z = [[c * 1.0 + r * 2.0 for c in range(6)] for r in range(5)]
        z[2][2] = None
        whole = cells(spark, z)
        for table in (whole, whole.where("z is not null")):
            found = grid(raster.slope_degrees(table, "z", 10), "slope")
            assert {k for k, v in found.items() if v is None} - {(2, 2)} == {(1, 2), (3, 2), (2, 1), (2, 3)}
            assert math.isclose(found[(2, 0)], math.degrees(math.atan(math.hypot(0.1, 0.2))))

    def test_valley(self, spark):
        z = [[abs(c - 5) * 5 + (12 - r) * 0.1 for c in range(11)] for r in range(13)]
        out = hydrology.height_above_drainage(cells(spark, z), 13)
        heights, stream = grid(out, "hand"), grid(out, "stream")
        assert {c for (_, c), s in stream.items() if s} == {5}
        assert math.isclose(heights[(9, 5)], 0) and math.isclose(heights[(9, 3)], 10, abs_tol=0.5) and math.isclose(heights[(9, 1)], 20, abs_tol=0.7)

    def test_no_stream_gives_no_height(self, spark):
        assert set(grid(hydrology.height_above_drainage(cells(spark, [[3.0, 2.0], [2.0, 1.0]]), 100), "hand").values()) == {None}

    def test_a_pit_is_filled_to_its_outlet(self, spark):
        z = [[9.0, 9.0, 9.0, 9.0], [9.0, -100.0, 5.0, 4.0], [9.0, 9.0, 9.0, 9.0]]
        assert grid(hydrology.fill_pits(cells(spark, z)), "fill")[(1, 1)] == 5.0

    def test_small_enclosed_voids_continue_a_plane_and_others_stay(self, spark):
        z = [[2.0 * r + 3.0 * c for c in range(14)] for r in range(12)]
        gone = {(2, 2), (4, 9), (4, 10), (5, 10), (0, 5), (11, 13)} | {(r, c) for r in range(6, 11) for c in range(1, 6)}
        told = {(r, c): v for r, row in enumerate(z) for c, v in enumerate(row)}
        found = grid(raster.fill_voids(cells(spark, [[None if (r, c) in gone else v for c, v in enumerate(row)] for r, row in enumerate(z)]), "z"), "z")
        assert all(math.isclose(found[p], told[p], abs_tol=1e-9) for p in told if p not in gone or p in {(2, 2), (4, 9), (4, 10), (5, 10)})
        assert sum(v is None for v in found.values()) == 27

    def test_lee_filter_leaves_a_constant_grid(self, spark):
        assert set(grid(raster.lee_filter(cells(spark, [[2.0] * 6] * 6), "z"), "z").values()) == {2.0}


class TestExposure:
    """Cells of 10 m; row 5 is flooded in the columns 5 to 14."""

    def flood(self, spark, tier=3):
        return spark.createDataFrame([(5, c, tier) for c in range(5, 15)], "row int, col int, tier int")

    def line(self, spark, x0, y0, x1, y1, kind=""):
        return spark.createDataFrame([(1, float(x0), float(y0), float(x1), float(y1), kind == "bridge", kind == "tunnel", kind == "ford")], "seg_id int, x0 double, y0 double, x1 double, y1 double, is_bridge boolean, is_tunnel boolean, is_ford boolean")

    @pytest.mark.parametrize(
        ("ends", "kind", "reach", "hit", "tier"),
        [
            ((0, 55, 200, 55), "", 0, True, 3), ((0, 80, 200, 80), "", 30, False, 0), ((0, 80, 200, 80), "bridge", 30, True, 3), ((0, 55, 200, 55), "tunnel", 10, False, 0),
            ((60, 55, 400, 55), "tunnel", 10, True, 3), ((0, 55, 200, 55), "ford", 0, True, 1), ((0, 200, 9, 200), "", 0, False, 0),
        ],
    )
    def test_rules_for_lines(self, spark, ends, kind, reach, hit, tier):
        row = damage.line_damage(self.line(spark, *ends, kind), self.flood(spark), 10, reach).first()
        assert (row["hit"], row["damage_tier"]) == (hit, tier)

    def test_length_share_and_limits(self, spark):
        row = damage.line_damage(self.line(spark, 0, 55, 200, 55), self.flood(spark), 10).first()
        assert (row["length"], row["flooded"]) == (200, 100)
        short = self.line(spark, 0, 55, 60, 55)
        assert not damage.line_damage(short, self.flood(spark), 10, 0, 30, 0.6).first()["hit"] and damage.line_damage(short, self.flood(spark), 10, 0, 30, 0.1).first()["hit"]

    def test_candidates_never_raise_the_tier_of_flood_evidence(self, spark):
        rows = "seg_id int, flooded double, hit boolean, damage_tier int"
        flood = spark.createDataFrame([(1, 50.0, True, 3), (2, 0.0, False, 0), (3, 0.0, False, 0)], rows)
        other = spark.createDataFrame([(1, 9.0, True, 1), (2, 9.0, True, 1)], rows)
        found = {r["seg_id"]: (r["hit"], r["damage_tier"], r["evidence_source"]) for r in damage.merged_evidence(flood, other).collect()}
        assert found == {1: (True, 3, "flood"), 2: (True, 1, "debris_candidate"), 3: (False, 0, "none")}

    def test_boxes(self, spark):
        boxes = spark.createDataFrame([(1, 51.0, 51.0, 55.0, 55.0), (2, 0.0, 0.0, 9.0, 9.0)], "box_id int, x0 double, y0 double, x1 double, y1 double")
        assert {r["box_id"]: r["tier"] for r in exposure.box_tier(boxes, self.flood(spark), 10).collect()} == {1: 3, 2: 0}

    def test_hundred_thousand_boxes(self, spark):
        boxes = spark.range(100_000).selectExpr("id as box_id", "cast(id % 400 as double) as x0", "cast(id div 400 as double) as y0").withColumn("x1", F.col("x0") + 4).withColumn("y1", F.col("y0") + 4)
        found = {r["tier"]: r["n"] for r in exposure.box_tier(boxes, self.flood(spark), 10).groupBy("tier").agg(F.count(F.lit(1)).alias("n")).collect()}
        assert set(found) == {0, 3} and sum(found.values()) == 100_000

    def test_polygons_equal_the_even_odd_rule_cell_by_cell(self, spark):
        rng = random.Random(9)
        px = spark.createDataFrame([(r, c) for r in range(12) for c in range(12)], "row int, col int")
        edges = []
        for poly in range(12):
            at = [(float(rng.randrange(-20, 140)), float(rng.randrange(-20, 140))) for _ in range(rng.randint(3, 8))]
            edges += [(poly, *a, *b) for a, b in zip(at, at[1:] + at[:1], strict=True)]
        told = set()
        for poly, r, c in ((p, r, c) for p in range(12) for r in range(12) for c in range(12)):
            x, y = c * 10 + 5, r * 10 + 5
            right = sum(1 for p, x0, y0, x1, y1 in edges if p == poly and min(y0, y1) <= y < max(y0, y1) and x0 + (y - y0) / (y1 - y0) * (x1 - x0) > x)
            if right % 2:
                told.add((poly, r, c))
        found = [tuple(r) for r in damage.inside_polygons(px, spark.createDataFrame(edges, "poly_id int, x0 double, y0 double, x1 double, y1 double"), 10).collect()]
        assert len(found) == len(told) and set(found) == told

    def test_a_polygon_holds_the_cells_whose_centre_it_holds(self, spark):
        px = spark.createDataFrame([(r, c) for r in range(6) for c in range(6)], "row int, col int")
        square = [(1, 10.0, 10.0, 30.0, 10.0), (1, 30.0, 10.0, 30.0, 40.0), (1, 30.0, 40.0, 10.0, 40.0), (1, 10.0, 40.0, 10.0, 10.0)]
        edges = spark.createDataFrame(square, "poly_id int, x0 double, y0 double, x1 double, y1 double")
        assert {(r["row"], r["col"]) for r in damage.inside_polygons(px, edges, 10).collect()} == {(r, c) for r in (1, 2, 3) for c in (1, 2)}


MEMBER = "u bigint, v bigint, member_id bigint, highway string, length_m bigint, travel_ms bigint, hit boolean, tier int, is_bridge boolean"


class TestNetwork:
    """Town 1 - bridge - 2 - 3 - 4; the hospital and a town are at 1, a village at 3 and a hamlet at 4."""

    def members(self, spark, tier=3, more=()):
        rows = [(1, 2, 10, "primary", 200, 200, True, tier, True), (2, 3, 11, "primary", 200, 200, False, 0, False), (3, 4, 12, "primary", 100, 100, False, 0, False), *more]
        return spark.createDataFrame(rows, MEMBER)

    def places(self, spark):
        subjects = spark.createDataFrame([("v", 3, "village"), ("h", 4, "hamlet"), ("t", 1, "town")], "osm_id string, at bigint, place string")
        return subjects, spark.createDataFrame([("hosp", 1, "hospital"), ("t", 1, "town")], "osm_id string, at bigint, class string")

    def status(self, spark, members):
        return {r["osm_id"]: r["status"] for r in network.isolation(*self.places(spark), members).collect()}

    def test_strong_evidence_cuts_off(self, spark):
        found = self.status(spark, self.members(spark))
        assert (found["v"], found["h"]) == ("CUT OFF", "CUT OFF")

    def test_uncertain_evidence_never_cuts_off(self, spark):
        assert set(self.status(spark, self.members(spark, tier=1)).values()) == {"UNCERTAIN"}

    def test_a_town_is_not_its_own_destination(self, spark):
        row = network.isolation(*self.places(spark), self.members(spark)).where("osm_id = 't'").first()
        assert row["baseline_hospital"] and not row["baseline_town"]

    def test_a_parallel_member_keeps_the_link(self, spark):
        m = self.members(spark, more=[(2, 1, 20, "track", 900, 900, False, 0, False)])
        assert self.status(spark, m)["v"] == "CONNECTED"
        link = network.surviving(m, 2).where("a = 1").first()
        assert (link["members"], link["fastest"]) == (1, 20)

    def test_parallel_members_are_one_link(self, spark):
        link = network.build_links(self.members(spark, more=[(2, 1, 20, "track", 200, 100, False, 0, False)])).where("a = 1").first()
        assert (link["members"], link["member_ids"], link["fastest"], link["is_bridge"], link["lost_likely"]) == (2, [10, 20], 20, True, False)

    def test_restoring_the_bridge_gives_both_places_back(self, spark):
        m = self.members(spark)
        subjects, dest = self.places(spark)
        links = network.build_links(m)
        nodes = network.nodes_of(links)
        base, likely = network.component_of(nodes, links), network.component_of(nodes, network.surviving(m, 2))
        row = network.restored(subjects, dest, links, likely, network.access(subjects, dest, base), network.access(subjects, dest, likely)).first()
        assert (row["link_id"], row["count"], row["hospital"], row["town"]) == ("1-2", 2, 2, 2)

    def test_a_sound_bridge_is_latent(self, spark):
        m = self.members(spark).withColumn("hit", F.lit(False))
        subjects, dest = self.places(spark)
        links = network.build_links(m)
        row = paths.latent_losses(links, network.component_of(network.nodes_of(links), links), subjects, dest).collect()
        assert [(r["link_id"], r["count"], r["hospital"], r["town"]) for r in row] == [("1-2", 2, 2, 2)]

    @pytest.mark.parametrize("seed", range(3))
    def test_graph_bridges_equal_removal_of_each_link(self, spark, seed):
        rng = random.Random(seed)
        pairs = sorted({tuple(sorted(rng.sample(range(24), 2))) for _ in range(24)})
        links = spark.createDataFrame(pairs, "a bigint, b bigint")

        def parts(some):
            up = {n: n for p in pairs for n in p}

            def root(n):
                while up[n] != n:
                    n = up[n]
                return n

            for a, b in some:
                up[root(a)] = root(b)
            return len({root(n) for n in up})

        told = {p for p in pairs if parts([q for q in pairs if q != p]) > parts(pairs)}
        comp = network.component_of(network.nodes_of(links), links)
        assert {(r["a"], r["b"]) for r in paths.graph_bridges(links, paths.spanning_tree(links, comp)).collect()} == told

    def test_routes_take_the_quicker_way(self, spark):
        m = self.members(spark, more=[(1, 4, 30, "primary", 50, 450, False, 0, False)])
        found = {r["node"]: r["cost"] for r in network.routes(spark.createDataFrame([("hosp", 1, "hospital")], "osm_id string, at bigint, class string"), {"baseline": network.build_links(m)}).collect()}
        assert found == {1: 0, 2: 200, 3: 400, 4: 450}

    def test_ways_are_cut_where_they_share_a_vertex_and_not_where_they_cross(self, spark):
        rows = [("w", 0, 0, 0), ("w", 1, 100, 0), ("w", 2, 100, 0), ("w", 3, 200, 0), ("x", 0, 100, 0), ("x", 1, 100, 100), ("y", 0, 50, -100), ("y", 1, 50, 100)]
        found = {(r["way"], r["u"], r["v"]) for r in paths.way_pieces(spark.createDataFrame(rows, "way string, idx int, x int, y int")).collect()}
        assert found == {("w", "0:0", "100:0"), ("w", "100:0", "200:0"), ("x", "100:0", "100:100"), ("y", "50:-100", "50:100")}

    def test_snapping_takes_the_nearest_and_the_least_on_ties(self, spark):
        points = spark.createDataFrame([("p", 10.0, 0.0), ("q", 500.0, 500.0)], "osm_id string, x double, y double")
        nodes = spark.createDataFrame([(2, 0.0, 0.0), (1, 20.0, 0.0)], "node bigint, x double, y double")
        assert {r["osm_id"]: (r["node"], r["distance"]) for r in network.snap(points, nodes, 50).collect()} == {"p": (1, 10.0), "q": (None, None)}


class TestScenes:
    def passes(self, spark, rows):
        return spark.createDataFrame([(s, o, dt.date(2020, 8, d), i, 1, c) for s, o, d, i, c in rows], "orbit_state string, relative_orbit int, day date, ids string, scenes int, coverage double")

    @pytest.mark.parametrize(("coverage", "n"), [(0.49, 0), (0.5, 1)])
    def test_coverage_limit(self, spark, coverage, n):
        found = self.passes(spark, [("ascending", 1, 9, "a", 1.0), ("ascending", 1, 11, "b", coverage)])
        assert scenes.rank_pairs(found, dt.date(2020, 8, 10)).count() == n

    def test_other_orbits_do_not_pair_and_good_coverage_goes_before_nearness(self, spark):
        found = self.passes(spark, [("ascending", 1, 9, "a", 1.0), ("descending", 1, 11, "x", 1.0), ("ascending", 1, 12, "near", 0.6), ("ascending", 1, 15, "far", 1.0)])
        assert [r["post_ids"] for r in scenes.rank_pairs(found, dt.date(2020, 8, 10)).orderBy("rank").collect()] == ["far", "near"]


class TestMetrics:
    def rows(self, spark):
        nan = None
        return spark.createDataFrame([("Ghana", 1, 0.9), ("Ghana", 1, 0.1), ("Ghana", 0, 0.8), ("Ghana", None, nan), ("Bolivia", 1, 0.9), ("Bolivia", 0, 0.1), ("Bolivia", 0, 0.1)], "region string, label int, prob double")

    def test_confusion(self, spark):
        found = {r["region"]: r for r in metrics.confusion(self.rows(spark), 0.5, ["region"]).collect()}
        assert [found[None][c] for c in ("tp", "fp", "fn", "tn", "iou")] == [2, 1, 1, 2, 0.5] and math.isclose(found[None]["f1"], 2 / 3)
        assert math.isclose(found["Ghana"]["iou"], 1 / 3) and found["Bolivia"]["iou"] == 1

    def test_no_pixels_have_no_ratio(self, spark):
        assert metrics.confusion(self.rows(spark).where("false"), 0.5).first()["iou"] is None

    def test_best_threshold(self, spark):
        rows = spark.createDataFrame([(0, 0.2), (1, 0.4), (1, 0.7)], "label int, prob double")
        row = metrics.best_threshold(metrics.sweep(rows, [0.3, 0.5, 0.8])).first()
        assert (row["threshold"], row["f1"]) == (0.3, 1.0)

    def test_standardisation_clips_first(self, spark):
        row = metrics.standardisation(spark.createDataFrame([("vv", v) for v in (-50.0, -10.0, -20.0, 50.0)], "band string, v double"), F.col("v"), -35, 5, "band").first()
        assert row["mean"] == -15 and math.isclose(row["std"], math.sqrt((20**2 + 5**2 + 5**2 + 20**2) / 4))

    def test_agreement(self, spark):
        pred, ref = {(0, 0), (0, 1), (1, 0), (2, 2)}, {(0, 0), (1, 0), (1, 1), (2, 2)}
        rows = [(r, c, (r, c) in pred, (r, c) in ref, (r, c) != (2, 2)) for r in range(3) for c in range(3)]
        df = spark.createDataFrame(rows, "row int, col int, pred boolean, ref boolean, valid boolean")
        row = agreement.strict(df).first()
        assert [row[c] for c in ("tp", "fp", "fn", "tn", "iou")] == [2, 1, 1, 4, 0.5]
        assert agreement.tolerant(df, 0).first()["precision"] == row["precision"]


class TestRules:
    def test_tags(self, spark):
        df = spark.createDataFrame([("1,234", "no"), ("unknown", "yes"), ("-3", None)], "population string, bridge string")
        assert [tuple(r) for r in df.select(elements.population(F.col("population")), elements.flag(F.col("bridge"))).collect()] == [(1234, False), (None, True), (None, False)]

    def test_boxes(self, spark):
        rows = [(0.0, 0.0, 1.0, 1.0), (1.0, 0.0, 1.0, 1.0), (-181.0, 0.0, 1.0, 1.0), (0.0, 0.0, float("nan"), 1.0), (0.0, None, 1.0, 1.0)]
        df = spark.createDataFrame(rows, "w double, s double, e double, n double")
        assert [r[0] for r in df.select(areas.valid_box(*(F.col(c) for c in "wsen"))).collect()] == [True, False, False, False, False]

    def test_zones_of_times(self, spark):
        df = spark.createDataFrame([("2020-01-01T00:00:00Z",), ("2020-01-01T00:00:00",), ("soon",), (None,)], "t string")
        assert [tuple(r) for r in df.select(areas.zoned_time(F.col("t"), False), areas.zoned_time(F.col("t"), True)).collect()] == [(1577836800, 1577836800), (None, 1577836800), (None, None), (None, None)]

    def test_number_texts(self, spark):
        df = spark.createDataFrame([(1.5,), (100.0,), (0.00001,), (-2.0,), (None,)], "x double")
        assert [r[0] for r in df.select(facts.number_text(F.col("x"))).collect()] == ["1.5", "100", "0", "-2", "not available"]

    def test_script_texts_hold_nothing_that_ends_a_script_or_a_line(self, spark):
        text = '{"a":"</script>&amp; \u2028x\u2029 \\\\u003c"}'
        shown = spark.createDataFrame([(text,), (None,)], "t string").select(facts.safe_script(F.col("t"))).collect()
        assert not set("<>&\u2028\u2029") & set(shown[0][0]) and json.loads(shown[0][0]) == json.loads(text) and shown[1][0] is None

    def test_equal_scores_rank_by_id(self, spark):
        df = spark.createDataFrame([("b", 1), ("a", 1), ("c", 9)], "id string, v int")
        found = scoring.explained(df, {"v": F.col("v")}, {"v": 2.0}, "id").orderBy("rank").collect()
        assert [(r["id"], r["score"], r["why"]) for r in found] == [("c", 18.0, "v=9 contributes 18.000"), ("a", 2.0, "v=1 contributes 2.000"), ("b", 2.0, "v=1 contributes 2.000")]

    def test_ranks_of_many_equal_scores(self, spark):
        df = spark.range(3_000).selectExpr("id", "id % 3 as v").repartition(7)
        found = scoring.explained(df, {"v": F.col("v")}, {"v": 2.0}, "id").orderBy("rank").collect()
        assert [r["rank"] for r in found] == list(range(1, 3_001))
        assert [r["id"] for r in found] == sorted(range(3_000), key=lambda k: (-(k % 3), k))

    def test_the_largest_blocks_are_dropped_first(self, spark):
        df = spark.createDataFrame([("p", "a", 10), ("p", "b", 50), ("p", "c", 30)], "page string, name string, size int")
        assert {r["name"] for r in facts.within_budget(df, 45).collect() if r["kept"]} == {"a", "c"}


def test_shortest_paths_along_a_deep_chain(spark):
    """More hops than any number of rounds one would fix, with a dear short cut."""
    n = 120
    steps = [(k, k + 1, 3) for k in range(n)] + [(0, n, 1_000)]
    edges = spark.createDataFrame(steps + [(v, u, c) for u, v, c in steps], "u bigint, v bigint, cost bigint")
    seeds = spark.createDataFrame([("x", 0, "t"), ("x", n // 2, "s")], "class string, node bigint, target string")
    found = {r["node"]: (r["cost"], r["target"]) for r in fixpoint.shortest_paths(seeds, edges, ["class"]).collect()}
    assert found == {k: min((3 * k, "t"), (3 * abs(k - n // 2), "s")) for k in range(n + 1)}


def test_cells_beyond_a_million_columns_stay_apart(spark):
    cells = spark.createDataFrame([(0, 1_000_000), (1, 0), (-1, -5), (-1, -4)], "row int, col int")
    found = {(r["row"], r["col"]): r["comp"] for r in raster.label_components(cells).collect()}
    assert len(set(found.values())) == 3 and found[-1, -5] == found[-1, -4]
