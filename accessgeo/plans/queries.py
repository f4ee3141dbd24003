"""The library's own queries over the domain tables, each over its whole tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accessgeo.operators import agreement, elements, exposure, hydrology, metrics, network, raster, scenes
from accessgeo.session import checkpointed, read
from accessgeo.sources import adapters

FLOOD_DAY = dt.date(1998, 6, 1)
LEAST_PIXELS = 2
Query = Callable[[SparkSession, str], DataFrame]


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = raster.classify(adapters.pixels(spark, sf_dir))
    return px.withColumn("tier", raster.tier(F.col("new_water") & F.col("plausible")))


def flood_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _cells(spark, sf_dir).groupBy("tier").agg(F.count(F.lit(1)).alias("pixels"))
    return out.select("tier", "pixels", (F.col("pixels") * 100 / 1e6).alias("km2"))


def flood_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.flood_statistics(_cells(spark, sf_dir))


def flood_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).select("row", "col", "water_post", "water_pre", "preexisting", "new_water", "plausible", "excluded", "support", "tier")


def flood_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.remove_small(_cells(spark, sf_dir).where("tier > 0"), LEAST_PIXELS).select("row", "col", "comp", "size", "kept")


def component_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = _cells(spark, sf_dir).where("tier > 0")
    found = raster.label_components(px).join(px.select("row", "col", "tier"), ["row", "col"])
    return found.groupBy("comp").agg(F.count(F.lit(1)).alias("size"), F.max("tier").alias("max_tier"), F.expr("percentile(tier, 0.5)").alias("median_tier"))


def hole_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = _cells(spark, sf_dir).withColumn("eligible", F.col("valid") & F.col("plausible") & ~F.col("water_pre"))
    # a denser mask than the flood itself, so that there are holes
    return raster.fill_holes(px.select("row", "col", "eligible"), px.where("p_post >= 0.3").select("row", "col"), 4)


def debris_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = _cells(spark, sf_dir)
    raw = px.where("valid and not water_post and tier = 0 and (abs(dvv) >= 3 or abs(dvh) >= 3) and slope between 0 and 15")
    return raw.join(raster.near(px.where("stream"), 2), ["row", "col"], "left_semi").select("row", "col", "dvv", "dvh")


def lee_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = adapters.pixels(spark, sf_dir).select("row", "col", F.when(F.col("valid"), F.col("p_post") + 0.01).alias("power"))
    return raster.lee_filter(px, "power").select("row", "col", F.round("power", 6).alias("power"))


def terrain_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = adapters.pixels(spark, sf_dir).select("row", "col", F.col("hand").alias("z"))
    return raster.slope_degrees(px, "z", 10).select("row", "col", F.round("slope", 6).alias("slope"))


def flow_receivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.receivers(adapters.pixels(spark, sf_dir).select("row", "col", F.col("hand").alias("z")), "z")


def filled_pits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hydrology.fill_pits(adapters.pixels(spark, sf_dir).select("row", "col", F.col("hand").alias("z"))).select("row", "col", "z", "fill")


def drainage_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hydrology.height_above_drainage(adapters.pixels(spark, sf_dir).select("row", "col", F.col("hand").alias("z")), 5)


def backscatter_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = adapters.pixels(spark, sf_dir)
    return px.select("row", "col", F.round(raster.power_to_db((F.col("dvv") + 6) / 4), 6).alias("db"), F.round((raster.power_to_db((F.col("dvv") + 6) / 4) + 15) / 5, 6).alias("scaled"))


def quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = raster.flood_statistics(_cells(spark, sf_dir))
    rules = [
        ("mountain_valley_hand_caution", "caution", F.try_divide("excluded_px", "new_water_px") > 0.3), ("low_valid_fraction", "caution", F.col("valid_fraction") < 0.9), ("low_valid_fraction_limiting", "limiting", F.col("valid_fraction") < 0.6),
        ("no_valid_pixels", "limiting", F.col("valid_px") == 0), ("pre_post_water_overlap_high", "caution", F.try_divide("preexisting_px", "water_post_px") > 0.5), ("no_flood_detected", "info", F.col("flood_px") == 0), ("debris_is_candidate_only", "info", F.lit(True)), ("domain_gap", "caution", F.lit(True)),
    ]
    found = s.select(F.explode(F.array_compact(F.array(*[F.when(c, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for code, severity, c in rules]))).alias("f"))
    return found.select("f.code", "f.severity")


def trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda s: F.coalesce(F.sum((F.col("severity") == s).cast("long")), F.lit(0))
    out = quality_flags(spark, sf_dir).agg(n("limiting").alias("limiting"), n("caution").alias("caution"))
    return out.withColumn("trust", F.when(F.col("limiting") > 0, "uncertain").when(F.col("caution") >= 2, "uncertain").when(F.col("caution") == 1, "probable").otherwise("strong"))


def scene_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenes.passes(adapters.scenes(spark, sf_dir)).withColumn("day", F.col("day").cast("string"))


def scene_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenes.rank_pairs(scenes.passes(adapters.scenes(spark, sf_dir)), FLOOD_DAY)


def element_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements.deduplicate(adapters.elements(spark, sf_dir))


def snapshot_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements.audit(adapters.elements(spark, sf_dir), F.lit("2024-01-20 00:00:00").cast("timestamp"))


def element_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = adapters.elements(spark, sf_dir)
    k = F.get_json_object("props", "$.k")
    return e.select("event_id", elements.flag(F.when(F.col("id") % 5 == 0, "no").when(F.col("id") % 5 < 3, "yes")).alias("bridge"), elements.population(F.when(F.col("id") % 7 == 0, "unknown").otherwise(F.concat(F.lit(" 1,"), k))).alias("population"))


def polygon_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = _cells(spark, sf_dir)
    boxes = px.select(F.col("id").alias("box_id"), (F.col("col") * 10 + F.col("id") % 9).cast("double").alias("x0"), (F.col("row") * 10 + F.col("id") % 7).cast("double").alias("y0")).withColumn("x1", F.col("x0") + 3 + F.col("box_id") % 11).withColumn("y1", F.col("y0") + 2 + F.col("box_id") % 5)
    return exposure.box_tier(boxes, px.where("tier > 0"), 10)


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = adapters.pixels(spark, sf_dir)
    long = (F.col("id") % 13) * 10 + 15
    return px.select(F.col("id").alias("seg_id"), (F.col("col") * 10 + 5).cast("double").alias("x0"), (F.col("row") * 10 + 5).cast("double").alias("y0"), long.alias("n")).selectExpr(
        "seg_id", "x0", "y0", "case when seg_id % 3 <> 1 then x0 + n else x0 end as x1", "case when seg_id % 3 <> 0 then y0 + n else y0 end as y1")


def line_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exposure.flooded_length(_segments(spark, sf_dir), _cells(spark, sf_dir).where("tier > 0"), 10)
    return out.select("seg_id", F.round("length", 6).alias("length"), F.round("flooded", 6).alias("flooded"), "tier", exposure.hit(F.col("length"), F.round("flooded", 6)).alias("hit"))


def line_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exposure.line_samples(_segments(spark, sf_dir), _cells(spark, sf_dir).where("tier > 0"), 10)


def road_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.build_links(adapters.road_members(spark, sf_dir)).withColumn("member_ids", F.array_join("member_ids", ","))


def scenario_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = adapters.road_members(spark, sf_dir)
    return network.surviving(m, 2).withColumn("scenario", F.lit("likely")).unionByName(network.surviving(m, 1).withColumn("scenario", F.lit("possible")))


def road_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.road_components(None, adapters.road_members(spark, sf_dir)).select("node", "comp")


def road_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = adapters.road_members(spark, sf_dir)
    return network.graph_summary(network.link_lengths(m), checkpointed(network.road_components(None, m).select("node", "comp")))


def _isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.isolation(adapters.subjects(spark, sf_dir), adapters.destinations(spark, sf_dir), adapters.road_members(spark, sf_dir))


def settlement_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access in each scenario, and the status by access alone; `settlement_access` has the final one."""
    return _isolated(spark, sf_dir).select("osm_id", "snapped", *[f"{s}_{k}" for s in ("baseline", "likely", "possible") for k in network.CLASSES], F.col("status").alias("status_by_access"))


def isolated_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = adapters.road_members(spark, sf_dir)
    links = network.build_links(m)
    likely = checkpointed(network.component_of(network.nodes_of(links), network.surviving(m, 2)))
    return network.clusters(_isolated(spark, sf_dir), links, likely)


def damaged_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, s, d = adapters.road_members(spark, sf_dir), adapters.subjects(spark, sf_dir), adapters.destinations(spark, sf_dir)
    gone = checkpointed(network.build_links(m).where("lost_likely").select("link_id", "a", "b", "evidence_tier", "lost_likely"))
    places = network.places_of(s, d)
    base = checkpointed(network.road_components(places, m).where("linked"))
    likely = checkpointed(network.road_components(places.unionByName(network.nodes_of(gone)), m, 2))
    return network.restored(s, d, gone, likely, network.access(s, d, base), network.access(s, d, likely))


def _routes(spark: SparkSession, sf_dir: str, destinations: DataFrame) -> DataFrame:
    m = adapters.road_members(spark, sf_dir)
    graphs = {"baseline": network.member_links(m), "likely": network.member_links(m, 2)}
    return network.routes(destinations, graphs, graphs["baseline"])


def nearest_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routes(spark, sf_dir, adapters.destinations(spark, sf_dir))


def detours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _routes(spark, sf_dir, adapters.destinations(spark, sf_dir).where("class = 'hospital'")).groupBy("node").agg(F.min(F.when(F.col("scenario") == "baseline", F.col("cost"))).alias("before"), F.min(F.when(F.col("scenario") == "likely", F.col("cost"))).alias("after"))
    ratio = F.when(F.col("before").isNull() | F.col("after").isNull(), None).when(F.col("before") == 0, 1.0).otherwise(F.col("after") / F.col("before"))
    return found.withColumn("ratio", F.round(ratio, 9)).withColumn("detail", F.when(F.col("before").isNull(), "unmapped").when(F.col("after").isNull(), "none").when(ratio > 1.5, "degraded").otherwise("full"))


def snapped_settlements(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = adapters.subjects(spark, sf_dir).selectExpr("osm_id", "x + 37 as x", "y - 21 as y")
    nodes = network.nodes_of(network.build_links(adapters.road_members(spark, sf_dir))).selectExpr("node", "(node % 100) * 100 as x", "(node div 100) * 100 as y")
    return network.snap(points, nodes, 120).select("osm_id", "node", F.round("distance", 6).alias("distance"))


def buildings_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    houses = read(spark, sf_dir, "orders").selectExpr("concat('b', o_orderkey) as osm_id", "(o_custkey % 100) * 100 + o_orderkey % 90 as x", "(o_custkey div 100) * 100 + o_orderkey % 70 as y")
    places = adapters.subjects(spark, sf_dir).select(F.col("at").alias("node"), "x", "y")
    counted = network.snap(houses, places, 150).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    return adapters.subjects(spark, sf_dir).select("osm_id", F.col("at").alias("node")).join(counted, "node", "left").select("osm_id", F.coalesce("n", F.lit(0)).alias("buildings"))


def confusion_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(adapters.scored_labels(spark, sf_dir), 0.5, ["region"])


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.sweep(adapters.scored_labels(spark, sf_dir), [k / 20 for k in range(1, 20)])


def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.best_threshold(threshold_sweep(spark, sf_dir))


def reliability_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.reliability(adapters.scored_labels(spark, sf_dir))


def calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.calibration_error(adapters.scored_labels(spark, sf_dir))


def class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.class_balance(adapters.scored_labels(spark, sf_dir), "region")


def channel_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.standardisation(adapters.pixels(spark, sf_dir).where("valid").withColumn("band", F.col("col") % 4), F.col("dvv") * 5 - 10, -35, 5, "band")
    return out.select("band", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def training_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.log_loss(adapters.scored_labels(spark, sf_dir), 1.5)
    return out.select(F.round("bce", 6).alias("bce"), F.round("dice", 6).alias("dice"))


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = _cells(spark, sf_dir)
    return px.select("row", "col", "valid", (F.col("tier") > 0).alias("pred"), (F.col("new_water") & (F.col("id") % 3 > 0)).alias("ref"))


def extent_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.strict(_compared(spark, sf_dir))


def tolerant_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.tolerant(_compared(spark, sf_dir), 1.5)


def area_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    return e.select("o_orderkey", F.date_sub("d", 60).cast("string").alias("pre_start"), F.date_sub("d", 1).cast("string").alias("pre_end"), F.least(F.date_add("d", 12), F.lit(FLOOD_DAY)).cast("string").alias("post_end"), F.least(F.lit(60), F.floor((F.col("o_orderkey") % 360) / 6) + 1).cast("int").alias("utm_zone"))


def area_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").selectExpr("n_nationkey", "n_nationkey * 5 % 60 as lat", "0.1D + n_nationkey % 4 * 0.1D as side")
    n = n.withColumn("nx", F.greatest(F.ceil(F.col("side") * 111.32 * F.cos(F.radians(F.col("lat").cast("double"))) / 10), F.lit(1)).cast("int")).withColumn("ny", F.greatest(F.ceil(F.col("side") * 111.32 / 10), F.lit(1)).cast("int"))
    return n.select("n_nationkey", "nx", "ny", F.explode(F.sequence(F.lit(0), F.col("nx") * F.col("ny") - 1)).alias("tile")).select("n_nationkey", "nx", "ny", "tile", F.floor(F.col("tile") / F.col("nx")).cast("int").alias("iy"), (F.col("tile") % F.col("nx")).alias("ix"))


def number_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of the documents' texts that no document's length explains."""
    d = read(spark, sf_dir, "documents")
    said = d.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b[0-9]{1,6}\b"), F.lit(0)))).alias("number"))
    known = d.select(F.col("n_chars").cast("string").alias("number")).distinct()
    return said.join(known, "number", "left_anti").select("doc_id", "number")


def content_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").select("n_nationkey", F.sha2(F.concat_ws("|", "n_nationkey", "n_name", "n_regionkey"), 256).alias("key"))


def queries() -> dict[str, Query]:
    named = [
        flood_tiers, flood_statistics, flood_pixels, flood_components, component_statistics, hole_filling, debris_candidates, lee_filtered, terrain_slope, flow_receivers, filled_pits, drainage_height, backscatter_db, quality_flags, trust,
        scene_passes, scene_pairs, element_duplicates, snapshot_audit, element_tags, polygon_exposure, line_exposure, line_samples, road_links, scenario_links, road_components, road_summary, settlement_status, isolated_clusters, damaged_links, nearest_routes, detours,
        snapped_settlements, buildings_near, confusion_by_region, threshold_sweep, best_threshold, reliability_bins, calibration_error, class_balance, channel_statistics, training_loss, extent_agreement, tolerant_agreement, area_windows, area_tiles, number_trace, content_keys,
    ]
    return {f.__name__: f for f in named}
