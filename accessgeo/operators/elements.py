"""Map elements: duplicates, age audit, tag rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def deduplicate(elements: DataFrame) -> DataFrame:
    """One row per (type, id): the newest version wins; `conflict` if timestamps or versions differ."""
    newest = F.max(F.struct("ts", "version", "event_id")).alias("n")
    out = elements.groupBy("type", "id").agg(newest, F.count(F.lit(1)).alias("copies"), F.countDistinct(F.struct("ts", "version")).alias("kinds"))
    return out.select("type", "id", F.col("n.ts").alias("ts"), F.col("n.version").alias("version"), F.col("n.event_id").alias("event_id"), "copies", (F.col("kinds") > 1).alias("conflict"))


def merged_copies(elements: DataFrame, fields: list[str], order: str) -> DataFrame:
    """One row per (type, id) with the fields of its newest (ts, version): of that version's copies the last by `order` that has a field gives it.

    Copies are merged per version before versions meet, so an element with many copies is merged where they lie. A null `ts` or `version` is the
    oldest; a field that no copy of the version has is null.
    """
    kept = [F.max_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields]
    one = elements.groupBy("type", "id", "ts", "version").agg(*kept, F.count(F.lit(1)).alias("copies"))
    newest = F.max(F.struct("ts", "version", *fields, F.col("copies").alias("merged"))).alias("n")
    return one.groupBy("type", "id").agg(newest, F.sum("copies").alias("copies"), (F.count(F.lit(1)) > 1).alias("conflict")).select("type", "id", "n.*", "copies", "conflict")


def audit(elements: DataFrame, snapshot: Column) -> DataFrame:
    """Missing, newer and known timestamps; verified if some are known and none is missing or newer."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    out = elements.agg(F.count(F.lit(1)).alias("elements"), n(F.col("ts").isNull()).alias("missing"), n(F.col("ts") > snapshot).alias("newer"), n(F.col("ts").isNotNull()).alias("known"), F.min("ts").alias("oldest"), F.max("ts").alias("newest"))
    return out.withColumn("verified", (F.col("known") > 0) & (F.col("missing") == 0) & (F.col("newer") == 0))


def flag(tag: Column) -> Column:
    """A tag counts if it is there and does not say no."""
    return F.coalesce(F.lower(tag) != "no", F.lit(False))


def population(tag: Column) -> Column:
    """Whole non-negative number without separators, else null."""
    n = F.regexp_replace(F.trim(tag), "[, ]", "").try_cast("long")
    return F.when(n >= 0, n)


def care_tier(amenity: Column, healthcare: Column) -> Column:
    return F.when((amenity == "hospital") | (healthcare == "hospital"), "hospital").when(amenity.isin("clinic", "doctors") | healthcare.isin("clinic", "doctor"), "clinic")


def quality(elements: DataFrame, day: Column, stale_days: int) -> DataFrame:
    """Per type: distinct elements, median age in days at `day`, and the share older than `stale_days`; an element's newest time counts."""
    newest = elements.groupBy("type", "id").agg(F.max("ts").alias("ts"))
    aged = newest.withColumn("age", F.datediff(day, F.to_date("ts")))
    return aged.groupBy("type").agg(F.count(F.lit(1)).alias("elements"), F.expr("percentile(age, 0.5)").alias("median_age"), F.avg((F.col("age") > stale_days).cast("double")).alias("stale_share"))
