"""Exploded tables are never broadcast, whatever Spark takes their size to be."""

from __future__ import annotations

import re

from accessgeo.operators import damage, exposure, raster


def test_exploded_tables_are_not_broadcast(spark):
    ids = spark.range(50)
    segments = ids.selectExpr("id as seg_id", "id * 10D as x0", "5D as y0", "id * 10D + 40 as x1", "25D as y1", "true as is_bridge", "false as is_tunnel", "false as is_ford")
    cells = ids.selectExpr("cast(id div 10 as int) as row", "cast(id % 10 as int) as col", "1 as tier", "id % 7 * 1D as z")
    edges = segments.selectExpr("seg_id as poly_id", "x0", "y0", "x1", "y1")
    found = [
        exposure.flooded_length(segments, cells, 10), damage.approach_tier(segments, cells, 10, 12), damage.inside_polygons(cells, edges, 10),
        exposure.line_samples(segments, cells, 10), raster.receivers(cells, "z"), raster.shifted(cells, raster.EIGHT, ["tier"]).join(cells.select("row", "col"), ["row", "col"]),
    ]
    for out in found:
        assert "SortMergeJoin" in out._jdf.queryExecution().executedPlan().toString()


def test_the_test_of_cells_near_a_bridge_is_small_enough_to_be_compiled(spark, capsys):
    """Java runs methods of more than 8,000 bytes without compiling them."""
    px = spark.range(50).selectExpr("id", "cast(id div 10 as int) as row", "cast(id % 10 as int) as col", "1 as tier")
    segments = px.selectExpr("id as seg_id", "col * 10D as x0", "row * 10D as y0", "id % 13 * 10 as n").selectExpr("seg_id", "x0", "y0", "case when seg_id % 3 <> 1 then x0 + n else x0 end as x1", "case when seg_id % 3 <> 0 then y0 + n else y0 end as y1", "seg_id % 2 = 0 as is_bridge", "seg_id % 2 = 1 as is_tunnel")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        damage.approach_tier(segments, px, 10, 12).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8_000
