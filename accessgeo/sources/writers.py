"""Sinks: tiled pixel tables, GeoJSON, receipts. All go through Spark's own committers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accessgeo.operators.facts import point_features


def write_tiles(pixels: DataFrame, path: str, side: int = 512) -> None:
    """A pixel table in folders of `side` rows and columns, so that a window reads few of them. A tile's rows meet in one task, and are at most side * side."""
    tiled = pixels.withColumn("tile_row", F.floor(F.col("row") / side).cast("int")).withColumn("tile_col", F.floor(F.col("col") / side).cast("int"))
    tiled.repartition("tile_row", "tile_col").sortWithinPartitions("tile_row", "tile_col", "row", "col").write.partitionBy("tile_row", "tile_col").parquet(path)


def write_features(points: DataFrame, path: str, properties: list[str]) -> None:
    """One GeoJSON feature a line; a file of lines needs no task that holds all of them."""
    point_features(points, properties).select("feature").write.text(path)


def write_receipt(facts: DataFrame, path: str) -> None:
    """A small table of facts as JSON with null fields kept, under a key of its content, so that an equal receipt has an equal key."""
    body = F.to_json(F.struct(*[F.col(c) for c in sorted(facts.columns)]), {"ignoreNullFields": "false"})
    facts.select(F.sha2(body, 256).alias("key"), body.alias("body")).write.json(path)
