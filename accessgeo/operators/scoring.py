"""Explained rankings of settlements and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accessgeo.session import checkpointed


def chosen_weights(defaults: dict[str, float], own: dict[str, float] | None = None) -> dict[str, float]:
    """The defaults with those that the user sets: known names, finite and not negative."""
    out = defaults | (own or {})
    if set(out) - set(defaults) or any(not (0 <= v < float("inf")) for v in out.values()):
        raise ValueError("weights have known names and are finite and not negative")
    return out


def settlement_scores(rows: DataFrame, points: dict[str, float], weights: dict[str, float], detour_cap: float = 10, building_log_cap: float = 3) -> DataFrame:
    """Ranking of the attributable settlements (see settlements.attributed) by status, lost classes, buildings, evidence and detour: osm_id, score, rank, why, confidence."""
    if not (1 <= detour_cap < float("inf") and 0 <= building_log_cap < float("inf")):
        raise ValueError("the detour cap is 1 or more, the cap on the logarithm of buildings 0 or more")
    state = F.when((F.col("status") == "CONNECTED") & (F.col("access_detail") == "degraded"), "degraded").otherwise(F.col("status"))
    values = {
        "status": F.element_at(F.create_map(*[F.lit(x) for kv in points.items() for x in kv]), state), "hospital": F.col("lost_likely_hospital").cast("int"), "town": F.col("lost_likely_town").cast("int"),
        "buildings": F.least(F.log10(F.col("cluster_buildings") + 1), F.lit(float(building_log_cap))), "evidence": F.col("tier"), "detour": F.greatest(F.least("detour", F.lit(float(detour_cap))) - 1, F.lit(0.0))}
    shown = {"status": state, "buildings": F.col("cluster_buildings"), "detour": F.format_string("%.3f", F.col("detour"))}
    ranked = explained(rows.where("attributable"), values, weights, "osm_id", shown)
    return ranked.select("osm_id", "score", "rank", "why", F.when(F.col("tier") == 3, "strong").when(F.col("tier") == 2, "probable").otherwise("uncertain").alias("confidence"))


def explained(df: DataFrame, values: dict[str, Column], weights: dict[str, float], id_col: str, shown: dict[str, Column] | None = None) -> DataFrame:
    """score, rank and `why` over transformed values; equal scores go by id. `why` tells each value, from `shown` where it was transformed,
    and what it contributes.

    Rows are dealt by ranges of (score, id), so that no task orders all rows however many share a score; a rank is a row's place in its
    range behind the rows of the ranges before it.
    """
    parts = {k: v.cast("double") * weights[k] for k, v in values.items()}
    score = sum(parts.values(), F.lit(0.0))
    why = F.array(*[F.format_string(f"{k}=%s contributes %.3f", (shown or {}).get(k, values[k]).cast("string"), v) for k, v in parts.items()])
    scored = df.withColumn("score", F.round(score, 6)).withColumn("why", F.array_join(why, "; "))
    order = [F.desc("score"), F.col(id_col)]
    dealt = checkpointed(checkpointed(scored).repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    sizes = dealt.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return dealt.join(F.broadcast(before), "range").withColumn("rank", F.col("before") + inside).drop("range", "before")
