"""Readers of the file formats: element and scene JSON, split lists, dates in XML, pixel tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POINT = "struct<lon:double,lat:double>"
ELEMENTS = f"type string, id bigint, version int, timestamp string, tags map<string,string>, geometry array<{POINT}>, center {POINT}, lon double, lat double"
SCENES = "id string, geometry struct<type:string,coordinates:array<array<array<double>>>>, properties map<string,string>, assets map<string,struct<href:string>>"
PIXELS = "row int, col int, pre_vv float, pre_vh float, post_vv float, post_vh float, valid boolean, elevation float, slope_deg float, hand_m float, stream boolean"


def map_elements(spark: SparkSession, path: str) -> DataFrame:
    """Map elements of JSON answers ({"elements": [...]}), one row per element; a point is its own place or its centre."""
    raw = spark.read.schema(f"elements array<struct<{ELEMENTS.replace(' ', ':').replace(',:', ',')}>>").option("multiLine", True).json(path)
    e = raw.select(F.explode("elements").alias("e")).select("e.*")
    return e.withColumn("x", F.coalesce("lon", "center.lon")).withColumn("y", F.coalesce("lat", "center.lat"))


def scene_items(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue items of JSON answers ({"features": [...]}): id, time, mode, polarisations, orbit and the box of the footprint."""
    raw = spark.read.schema(f"features array<struct<{SCENES.replace(', ', ',').replace('id string', 'id:string').replace('geometry struct', 'geometry:struct').replace('properties map', 'properties:map').replace('assets map', 'assets:map')}>>").option("multiLine", True).json(path)
    i = raw.select(F.explode("features").alias("i")).select("i.*")
    ring = F.col("geometry.coordinates")[0]
    side = lambda f, k: f(F.transform(ring, lambda p: p[k]))
    p = F.col("properties")
    out = i.select("id", F.try_to_timestamp(p["datetime"]).alias("time"), p["sar:instrument_mode"].alias("mode"), F.from_json(p["sar:polarizations"], "array<string>").alias("polarisations"), p["sat:orbit_state"].alias("orbit_state"), p["sat:relative_orbit"].alias("relative_orbit"),
                   side(F.array_min, 0).alias("w"), side(F.array_min, 1).alias("s"), side(F.array_max, 0).alias("e"), side(F.array_max, 1).alias("n"), F.map_keys("assets").alias("assets"))
    return out.where("e > w and n > s")


def splits(spark: SparkSession, path: str) -> DataFrame:
    """Lists without header of image,label file names: chip, split (the file's name)."""
    rows = spark.read.schema("image string, label string").csv(path)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1)
    return rows.select(F.regexp_replace(F.element_at(F.split("image", "/"), -1), r"_S1[^_]*\.tif$", "").alias("chip"), name.alias("split"))


def acquisition_dates(spark: SparkSession, path: str) -> DataFrame:
    """Distinct acquisition dates of XML metadata with any name space; several dates of one file are ambiguous and give null.

    A date stamp of the record itself is no acquisition date.
    """
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    found = F.array_distinct(F.regexp_extract_all("value", F.lit(r"<(?:\w+:)?(?:acquisition\w*|temporal\w*|timePosition|beginPosition)\b[^>]*>\s*(\d{4}-\d\d-\d\d)"), F.lit(1)))
    return text.select("file", F.when(F.size(found) == 1, F.to_date(found[0])).alias("date"), F.size(found).alias("dates"))


def pixels(spark: SparkSession, path: str, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None) -> DataFrame:
    """A pixel table; a window of rows and columns is pushed down to the files. NaN and infinite values become null."""
    df = spark.read.schema(PIXELS).parquet(path)
    for name, span in (("row", rows), ("col", cols)):
        if span:
            df = df.where(F.col(name).between(*span))
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
    floats = [f.name for f in df.schema.fields if f.dataType.simpleString() == "float"]
    return df.withColumns({n: finite(F.col(n)) for n in floats})


def tag_flag(tags: Column, key: str) -> Column:
    return F.coalesce(F.lower(tags[key]) != "no", F.lit(False))


def road_table(elements: DataFrame) -> DataFrame:
    """Ways with a highway tag and their flags."""
    t = F.col("tags")
    return elements.where(F.col("type") == "way").where(t["highway"].isNotNull()).select("id", t["highway"].alias("highway"), t["name"].alias("name"), tag_flag(t, "bridge").alias("is_bridge"), tag_flag(t, "tunnel").alias("is_tunnel"), (tag_flag(t, "ford") | F.coalesce(t["highway"] == "ford", F.lit(False))).alias("is_ford"), "geometry")
