"""Queries on areas, catalogues, mosaics, chips and grids, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accessgeo.operators import areas, elements, metrics, raster, scenes
from accessgeo.plans.oracles import PIXELS, SCENES, SEGMENTS, _q
from accessgeo.plans.queries import _segments
from accessgeo.session import read
from accessgeo.sources import adapters


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").selectExpr("n_nationkey as id", "cast(n_nationkey * 37 % 360 - 180 as double) as w", "cast(n_nationkey * 13 % 170 - 85 as double) as s", "n_nationkey as k")
    return n.selectExpr("id", "w", "s", "case when k % 6 = 0 then w - 1 else w + k % 5 * 0.4D + 0.1D end as e", "s + k % 4 * 0.3D + 0.1D as n")


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 8) for c in ("w", "s", "e", "n")})


def area_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _boxes(spark, sf_dir)
    sound = boxes.where(areas.valid_box(*(F.col(c) for c in "wsen")))
    out = areas.clamped(sound).withColumn("epsg", areas.utm_epsg((F.col("w") + F.col("e")) / 2, (F.col("s") + F.col("n")) / 2))
    return _rounded(out).withColumn("area_km2", F.round("area_km2", 6))


def area_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(areas.expanded(_boxes(spark, sf_dir).where("e > w"), 10))


def raster_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").selectExpr("n_nationkey as id", "n_nationkey * 137.5D as x0", "n_nationkey * 91.0D as y0", "n_nationkey * 4137.5D as x1", "n_nationkey * 1791.0D + 7 as y1")
    return areas.grids(n).select("id", "step", "left", "top", "width", "height")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.selectExpr(
        "concat('i', o_orderkey % 700) as id", "o_orderkey as seq", "o_orderdate as time", "case when o_orderkey % 9 = 0 then 'EW' else 'IW' end as mode", "case when o_orderkey % 7 = 0 then array('VV') else array('VV', 'VH') end as polarisations",
        "case o_custkey % 3 when 0 then ' Ascending' when 1 then 'DESCENDING' else 'up' end as orbit_state", "case when o_orderkey % 11 = 0 then 'x' else cast(o_custkey % 13 as string) end as relative_orbit",
        "case when o_orderkey % 5 = 0 then map('vv', 1) else map('vv', 1, 'vh', 2) end as assets")


def catalogue_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return areas.usable_items(_items(spark, sf_dir)).select("id", F.to_date("time").cast("string").alias("day"), "orbit_state", "relative_orbit", F.size("assets").alias("assets"))


def pass_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = areas.matching_items(scenes.passes(adapters.scenes(spark, sf_dir)), areas.usable_items(_items(spark, sf_dir)))
    return out.where("items > 0").withColumn("day", F.col("day").cast("string"))


def elevation_mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = adapters.pixels(spark, sf_dir).selectExpr("row", "col", "id", "explode(array(0, 1, 2)) as k")
    return areas.mosaic(px.selectExpr("row", "col", "concat('t', 2 - k) as item", "case when (id + k) % 4 > 0 then (id * 7 + k * 3) % 50 end as value"), ["row", "col"])


def endpoint_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").selectExpr("o_orderkey div 3 as tile", "cast(o_orderkey % 3 as int) as rank", "concat('e', o_orderkey % 3) as endpoint", "o_custkey % 3 <> 0 as ok")
    return areas.first_answer(o, "tile")


def chip_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors are the images, pages and conversations the two splits."""
    of = lambda table, key: read(spark, sf_dir, table).select(F.col(key).alias("doc_id"))
    return areas.pairing(of("embeddings", "vec_id"), of("labels", "doc_id"), of("pages", "page_id").unionByName(of("conversations", "conv_id").distinct()), "doc_id")


def chip_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.inspection(adapters.scored_labels(spark, sf_dir), "prob_pct", "region")


def stopped_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = read(spark, sf_dir, "orders").selectExpr("o_custkey % 25 as run", "o_orderkey as epoch", "o_orderkey * 7919 % 1009 as score")
    return areas.early_stopping(log, 7)


def clipped_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = areas.clip_segments(_segments(spark, sf_dir), 101, 12, 403, 331)
    return out.withColumns({c: F.round(c, 6) for c in ("x0", "y0", "x1", "y1", "length")})


def blended_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = adapters.pixels(spark, sf_dir).selectExpr("row", "col", "p_post", "explode(array(0, 4)) as i").selectExpr("*", "explode(array(0, 4)) as j")
    tiles = px.selectExpr("row", "col", "p_post", "row - row % 4 - i as tile_row", "col - col % 4 - j as tile_col")
    return areas.blended(tiles.selectExpr("tile_row", "tile_col", "row - tile_row as r", "col - tile_col as c", "p_post + pmod(tile_row + tile_col, 3) * 0.01D as value"), 8).withColumn("value", F.round("value", 8))


def resampled_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = adapters.pixels(spark, sf_dir)
    return areas.resampled(px, px.selectExpr("id", "col + id % 4 * 0.25D as fx", "row + id % 2 * 0.5D as fy"), "hand").withColumn("hand", F.round("hand", 8))


def filled_voids(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = adapters.pixels(spark, sf_dir).select("row", "col", F.when(F.col("valid"), F.col("hand")).alias("hand"))
    return raster.fill_voids(grid, "hand").withColumn("hand", F.round("hand", 8))


def zoned_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").selectExpr("event_id", "concat('2024-01-', lpad(1 + event_id % 28, 2, '0'), 'T', lpad(event_id % 24, 2, '0'), ':00:00', element_at(array('Z', '+02:00', '', 'x'), cast(event_id % 4 + 1 as int))) as t")
    return e.select("event_id", areas.zoned_time(F.col("t"), False).alias("strict"), areas.zoned_time(F.col("t"), True).alias("assumed"))


def element_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements.quality(adapters.elements(spark, sf_dir), F.lit("2024-02-01").cast("date"), 5)


BOXES = "bx0 AS (SELECT n_nationkey AS id, n_nationkey AS k, (n_nationkey * 37 % 360 - 180)::DOUBLE AS w, (n_nationkey * 13 % 170 - 85)::DOUBLE AS s FROM nation), bx AS (SELECT id, w, s, CASE WHEN k % 6 = 0 THEN w - 1 ELSE w + k % 5 * 0.4::DOUBLE + 0.1::DOUBLE END AS e, s + k % 4 * 0.3::DOUBLE + 0.1::DOUBLE AS n FROM bx0)"
ITEMS = """
it0 AS (SELECT 'i' || (o_orderkey % 700) AS id, o_orderkey AS seq, o_orderdate AS t, o_orderkey AS k, CASE o_custkey % 3 WHEN 0 THEN 'ascending' WHEN 1 THEN 'descending' END AS orbit_state, CASE WHEN o_orderkey % 11 <> 0 AND o_custkey % 13 > 0 THEN (o_custkey % 13)::INT END AS relative_orbit FROM orders),
it AS (SELECT id, arg_max(t, (t, seq))::DATE AS day, arg_max(orbit_state, (t, seq)) AS orbit_state, arg_max(relative_orbit, (t, seq)) AS relative_orbit, arg_max(CASE WHEN k % 5 = 0 THEN 1 ELSE 2 END, (t, seq)) AS assets FROM it0 WHERE k % 9 <> 0 AND k % 7 <> 0 AND orbit_state IS NOT NULL AND relative_orbit IS NOT NULL GROUP BY id)
"""
DEG = "111.32::DOUBLE * cos(radians((s + n) / 2))"
SQL = {
    "area_boxes": _q(BOXES + f", v AS (SELECT *, (w + e) / 2 AS cx, (s + n) / 2 AS cy, 25 / ({DEG}) AS fx, 25 / 111.32::DOUBLE AS fy FROM bx WHERE w >= -180 AND w < e AND e <= 180 AND s >= -90 AND s < n AND n <= 90), h AS (SELECT *, least((e - w) / 2, fx) AS hx, least((n - s) / 2, fy) AS hy, e - w > 2 * fx OR n - s > 2 * fy AS clamped FROM v)",
        "SELECT id, round(cx - hx, 8) AS w, round(cy - hy, 8) AS s, round(cx + hx, 8) AS e, round(cy + hy, 8) AS n, clamped, round(2 * hx * 111.32::DOUBLE * cos(radians(cy)) * 2 * hy * 111.32::DOUBLE, 6) AS area_km2, (CASE WHEN cy >= 0 THEN 32600 ELSE 32700 END + least(60, floor((cx + 180) / 6)::INT + 1))::INT AS epsg FROM h"),
    "area_context": _q(BOXES, f"SELECT id, round(greatest(w - 10 / ({DEG}), -180), 8) AS w, round(greatest(s - 10 / 111.32::DOUBLE, -90), 8) AS s, round(least(e + 10 / ({DEG}), 180), 8) AS e, round(least(n + 10 / 111.32::DOUBLE, 90), 8) AS n FROM bx WHERE e > w"),
    "raster_grids": """
WITH g AS (SELECT n_nationkey AS id, n_nationkey * 137.5::DOUBLE AS x0, n_nationkey * 91.0::DOUBLE AS y0, n_nationkey * 4137.5::DOUBLE AS x1, n_nationkey * 1791.0::DOUBLE + 7 AS y1 FROM nation),
p AS (SELECT *, CASE WHEN greatest(ceil(x1 / 10) - floor(x0 / 10), ceil(y1 / 10) - floor(y0 / 10)) <= 4000 THEN 10 WHEN greatest(ceil(x1 / 20) - floor(x0 / 20), ceil(y1 / 20) - floor(y0 / 20)) <= 4000 THEN 20 END AS step FROM g)
SELECT id, step, (floor(x0 / step) * step)::BIGINT AS "left", (ceil(y1 / step) * step)::BIGINT AS top, (ceil(x1 / step) - floor(x0 / step))::INT AS width, (ceil(y1 / step) - floor(y0 / step))::INT AS height FROM p
""",
    "catalogue_items": _q(ITEMS, "SELECT id, day::VARCHAR AS day, orbit_state, relative_orbit, assets FROM it"),
    "pass_items": _q(SCENES + "," + ITEMS, "SELECT p.orbit_state, p.relative_orbit, p.day::VARCHAR AS day, count(*) AS items, min(it.id) AS first_item FROM passes p JOIN it ON it.orbit_state = p.orbit_state AND it.relative_orbit = p.relative_orbit AND it.day = p.day AND it.assets = 2 GROUP BY 1, 2, 3"),
    "elevation_mosaic": _q(PIXELS + ", l AS (SELECT row, col, 't' || (2 - k) AS item, CASE WHEN (id + k) % 4 > 0 THEN (id * 7 + k * 3) % 50 END AS value FROM px, range(3) r(k))", "SELECT row, col, arg_min(value, item) FILTER (value IS NOT NULL) AS value, count(value) AS valid, count(*) AS layers FROM l GROUP BY 1, 2"),
    "endpoint_choice": "WITH a AS (SELECT o_orderkey // 3 AS tile, (o_orderkey % 3)::INT AS rank, o_custkey % 3 <> 0 AS ok FROM orders), b AS (SELECT tile, min(rank) FILTER (ok) AS best FROM a GROUP BY 1) SELECT tile, 'e' || best AS endpoint, count(*) AS attempts, (count(*) FILTER (NOT ok AND rank < coalesce(best, 99)))::INT AS failed_before FROM a JOIN b USING (tile) GROUP BY tile, best",
    "chip_pairing": """
WITH a AS (SELECT vec_id AS doc_id, 1 AS i, 0 AS l, 0 AS s FROM embeddings UNION ALL SELECT doc_id, 0, 1, 0 FROM labels UNION ALL SELECT page_id, 0, 0, 1 FROM pages UNION ALL SELECT DISTINCT conv_id, 0, 0, 1 FROM conversations),
b AS (SELECT doc_id, sum(i) AS i, sum(l) AS l, sum(s) AS s FROM a GROUP BY 1)
SELECT doc_id, CASE WHEN i = 0 THEN 'no image' WHEN l = 0 THEN 'no label' WHEN s = 0 THEN 'unassigned' ELSE 'assigned twice' END AS state FROM b WHERE i = 0 OR l = 0 OR s <> 1
""",
    "chip_inspection": "WITH r AS (SELECT lang AS region, n_chars % 101 AS v, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE quality END AS y FROM documents JOIN labels USING (doc_id)) SELECT region, count(*) AS n, min(v) AS low, max(v) AS high, count(*) FILTER (y = 1) AS ones, count(*) FILTER (y = 0) AS zeros, count(*) FILTER (y IS NULL) AS no_data FROM r GROUP BY 1",
    "stopped_epochs": """
WITH l AS (SELECT o_custkey % 25 AS run, o_orderkey AS epoch, o_orderkey * 7919 % 1009 AS score FROM orders),
m AS (SELECT *, coalesce(score > max(score) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS better FROM l),
k AS (SELECT *, sum(better) OVER (PARTITION BY run ORDER BY epoch) AS streak FROM m),
t AS (SELECT *, row_number() OVER (PARTITION BY run, streak ORDER BY epoch) - 1 AS stale FROM k),
z AS (SELECT run, min(epoch) FILTER (stale >= 7) AS till FROM t GROUP BY 1)
SELECT run, max(epoch) AS last_epoch, arg_max(epoch, (score, -epoch)) AS best_epoch, max(score) AS best_score FROM t JOIN z USING (run) WHERE till IS NULL OR epoch <= till GROUP BY 1
""",
    "clipped_segments": _q(PIXELS + "," + SEGMENTS + """, ct AS (SELECT seg_id, unnest(list_distinct([0, 1, (101 - x0) / nullif(x1 - x0, 0), (403 - x0) / nullif(x1 - x0, 0), (12 - y0) / nullif(y1 - y0, 0), (331 - y0) / nullif(y1 - y0, 0)])) AS t FROM sg),
tw AS (SELECT seg_id, t AS t0, lead(t) OVER (PARTITION BY seg_id ORDER BY t) AS t1 FROM ct WHERE t BETWEEN 0 AND 1),
md AS (SELECT sg.*, t0, t1 FROM tw JOIN sg USING (seg_id) WHERE t1 > t0 AND x0 + (t0 + t1) / 2 * (x1 - x0) BETWEEN 101 AND 403 AND y0 + (t0 + t1) / 2 * (y1 - y0) BETWEEN 12 AND 331)""",
        "SELECT seg_id, round(x0 + t0 * (x1 - x0), 6) AS x0, round(y0 + t0 * (y1 - y0), 6) AS y0, round(x0 + t1 * (x1 - x0), 6) AS x1, round(y0 + t1 * (y1 - y0), 6) AS y1, round((t1 - t0) * sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2), 6) AS length FROM md"),
    "blended_patches": _q(PIXELS + """, p AS (SELECT row, col, p_post, row - row % 4 - i AS tr, col - col % 4 - j AS tc FROM px, (VALUES (0), (4)) a(i), (VALUES (0), (4)) b(j)),
w AS (SELECT row, col, p_post + (((tr + tc) % 3) + 3) % 3 * 0.01::DOUBLE AS v, greatest(sin(pi() * (row - tr + 0.5) / 8) ** 2, 0.001) * greatest(sin(pi() * (col - tc + 0.5) / 8) ** 2, 0.001) AS w FROM p)""", "SELECT row, col, round(sum(v * w) / sum(w), 8) AS value, count(*) AS patches FROM w GROUP BY 1, 2"),
    "resampled_heights": _q(PIXELS + """, n AS (SELECT p.id, q.hand, CASE WHEN a = 1 THEN p.id % 4 * 0.25 ELSE 1 - p.id % 4 * 0.25 END * CASE WHEN b = 1 THEN p.id % 2 * 0.5 ELSE 1 - p.id % 2 * 0.5 END AS w FROM px p CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(a, b) LEFT JOIN px q ON q.row = p.row + b AND q.col = p.col + a)""", "SELECT id, CASE WHEN count(hand) = count(*) THEN round(sum(hand * w)::DOUBLE, 8) END AS hand FROM n WHERE w > 0 GROUP BY 1"),
    "filled_voids": _q(PIXELS + ", g AS (SELECT row, col, CASE WHEN valid THEN hand END AS z FROM px)", "SELECT a.row, a.col, round(coalesce(any_value(a.z), CASE WHEN count(b.z) = 4 THEN avg(b.z) END), 8) AS hand FROM g a LEFT JOIN g b ON abs(a.row - b.row) + abs(a.col - b.col) = 1 GROUP BY 1, 2"),
    "zoned_times": "WITH e AS (SELECT event_id, event_id % 4 AS z, (epoch(TIMESTAMP '2024-01-01') + (event_id % 28) * 86400 + (event_id % 24) * 3600)::BIGINT AS t FROM events) SELECT event_id, CASE z WHEN 0 THEN t WHEN 1 THEN t - 7200 END AS strict, CASE z WHEN 0 THEN t WHEN 1 THEN t - 7200 WHEN 2 THEN t END AS assumed FROM e",
    "element_quality": "WITH n AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'node' ELSE 'way' END AS type, event_id % 400 AS id, max(ts) AS ts FROM events GROUP BY 1, 2), a AS (SELECT type, DATE '2024-02-01' - ts::DATE AS age FROM n) SELECT type, count(*) AS elements, quantile_cont(age, 0.5)::DOUBLE AS median_age, avg((age > 5)::INT::DOUBLE) AS stale_share FROM a GROUP BY 1",
}
QUERIES = {f.__name__: f for f in (area_boxes, area_context, raster_grids, catalogue_items, pass_items, elevation_mosaic, endpoint_choice, chip_pairing, chip_inspection, stopped_epochs, clipped_segments, blended_patches, resampled_heights, filled_voids, zoned_times, element_quality)}
