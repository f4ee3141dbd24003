"""Facts, flags and layers for reports: ordering, caps, budgets, texts, GeoJSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEVERITIES = ("limiting", "caution", "info")


def ordered_flags(flags: DataFrame) -> DataFrame:
    """Distinct (code, severity, message), limiting first, then by their first place."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    few = flags.groupBy("code", "severity", "message").agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("times"))
    return few.withColumn("place", F.row_number().over(Window.orderBy(rank, "pos", "code"))).select("place", "code", "severity", "message", "times")


def capped(layers: DataFrame, most: int) -> DataFrame:
    """The `most` largest features of each layer by (-size, id), with the number that the layer leaves out."""
    w = Window.partitionBy("layer").orderBy(F.desc("size"), "id")
    counts = layers.groupBy("layer").agg(F.greatest(F.count(F.lit(1)) - most, F.lit(0)).alias("omitted"))
    return layers.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).join(counts, "layer").select("layer", "id", "size", "place", "omitted")


def within_budget(blocks: DataFrame, budget: int) -> DataFrame:
    """Blocks that stay when the largest, by (size, name), are dropped one after the other until the rest fits."""
    up = Window.partitionBy("page").orderBy("size", "name").rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("total", F.sum("size").over(up)).select("page", "name", "size", (F.col("total") <= budget).alias("kept"))


def number_text(x: Column, percent: bool = False) -> Column:
    """At most four decimals without trailing zeros; a share in percent; null reads 'not available'."""
    v = F.round(x * 100 if percent else x, 4)
    plain = F.regexp_replace(F.format_string("%.4f", v), r"\.?0+$", "")
    plain = F.when(plain.isin("-0", ""), "0").otherwise(plain)
    return F.when(x.isNull() | F.isnan(x), "not available").otherwise(F.concat(plain, F.lit("%")) if percent else plain)


def safe_markup(text: Column) -> Column:
    """Text that is safe inside markup: the five characters that have a meaning there are written as references."""
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def safe_script(json: Column) -> Column:
    """JSON that is safe inside a script block: what could end the block or a line there is written as an escape of a JSON string."""
    for old, new in (("&", "0026"), ("<", "003c"), (">", "003e"), ("\u2028", "2028"), ("\u2029", "2029")):
        json = F.replace(json, F.lit(old), F.lit("\\u" + new))
    return json


def point_features(points: DataFrame, properties: list[str]) -> DataFrame:
    """One GeoJSON feature per point (x, y rounded to six decimals), properties sorted, NaN as null."""
    number = lambda c: F.when(~F.isnan(c), F.round(c, 6))
    props = F.struct(*[F.col(p).alias(p) for p in sorted(properties)])
    shape = F.struct(F.lit("Point").alias("type"), F.array(number(F.col("x").cast("double")), number(F.col("y").cast("double"))).alias("coordinates"))
    return points.select("id", F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), props.alias("properties")), {"ignoreNullFields": "false"}).alias("feature"))


def widened_windows(notes: DataFrame, text: str) -> DataFrame:
    """Days before and after that a note on a widened search tells, null where it tells none."""
    days = lambda word: F.regexp_extract(text, rf"(?i)\b{word}[^0-9]*(\d+)\s*day", 1).try_cast("int")
    return notes.select("id", days("before").alias("before"), days("after").alias("after"))
