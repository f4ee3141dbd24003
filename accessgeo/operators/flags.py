"""Quality flags of incidents and impacts from tables of rules, trust in a run, and what its inputs may be."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accessgeo.operators.areas import zoned_time
from accessgeo.session import shuffled

#: Code, stage, severity, condition and message, the last three as SQL over an incident's row. A value that is not known raises no flag.
Rule = tuple[str, str, str, str, str]
INCIDENT_RULES: list[Rule] = [
    ("no_same_orbit_pair", "s1_search", "'limiting'", "pair_status in ('no_same_orbit_pair', 'no_scenes')", "reason"),
    ("widened_post_window", "s1_search", "'caution'", "widened", "'scenes were searched beyond the window after the flood'"),
    ("acquisition_gap_long", "s1_search", "'caution'", "days_after > 6", "concat('the scene was taken ', days_after, ' days after the flood')"),
    ("post_on_flood_date", "s1_search", "'caution'", "days_after = 0", "'the scene was taken on the day of the flood, perhaps before it'"),
    ("s1_low_valid_fraction", "preprocess", "if(valid_fraction < 0.6D, 'limiting', 'caution')", "valid_fraction < 0.9D", "format_string('%.4f of the cells are valid in both scenes', valid_fraction)"),
    ("s1_grd_fallback", "preprocess", "'limiting'", "s1_source = 'grd_fallback'", "'scenes are without radiometric and terrain correction'"),
    ("dem_surface_model", "terrain", "'info'", "dem_source = 'cop-dem-glo-30'", "'heights include buildings and trees'"),
    ("dem_resampled_30m", "terrain", "'info'", "dem_source = 'cop-dem-glo-30' and resolution < 30", "'heights of 30 m cells stand on a finer grid'"),
    ("hand_nan_present", "terrain", "'caution'", "hand_nan_fraction > 0.02D", "format_string('%.2f %% of the cells have no height above drainage', hand_nan_fraction * 100)"),
    ("osm_sparse_network", "osm", "'caution'", "road_density < 0.3D", "format_string('%.3f km of road a km2', road_density)"),
    ("osm_no_hospitals", "osm", "'limiting'", "hospitals = 0", "'no hospital or clinic is mapped in the area'"),
    ("osm_no_settlements", "osm", "'limiting'", "settlements = 0", "'no settlement is mapped in the area'"),
    ("osm_stale", "osm", "'caution'", "stale_share > 0.5D", "format_string('%.1f %% of the roads were last edited over five years before', stale_share * 100)"),
    ("osm_snapshot_unverified", "osm", "'limiting'", "road_density is not null and not coalesce(snapshot_verified, false)", "'the age of the map is not verified'"),
    ("buildings_deferred", "osm", "'info'", "not with_buildings", "'buildings are not read yet'"),
]
IMPACT_RULES: list[Rule] = [
    ("road_graph_ignores_oneway_and_vehicle_type", "impact", "'info'", "true", "'roads are passable both ways for every vehicle'"),
    ("travel_time_heuristic", "impact", "'info'", "true", "'times come from one speed per class of road'"),
    ("damage_is_inundation_not_structural", "impact", "'caution'", "true", "'a flooded road may be whole; its loss is a scenario'"),
    ("debris_candidate_input", "impact", "'caution'", "with_debris", "'debris candidates are not confirmed'"),
    ("buildings_deferred", "impact", "'info'", "not with_buildings", "'buildings are not read yet'"),
    ("osm_sparse_network", "impact", "'caution'", "road_density < 0.3D", "'under 0.3 km of road a km2'"),
    ("osm_stale", "impact", "'caution'", "stale_share > 0.5D", "'over half of the roads were last edited over five years before'"),
    ("osm_no_hospitals", "impact", "'limiting'", "hospitals_snapped = 0", "'no hospital is near a road'"),
    ("only_clinics_no_hospitals", "impact", "'caution'", "hospitals_snapped = 0 and clinics_snapped > 0", "'clinics do not stand in for hospitals'"),
    ("osm_no_settlements", "impact", "'limiting'", "subjects = 0", "'no settlement is mapped in the area'"),
    ("no_flood_detected", "impact", "'info'", "flood_px = 0", "'no cell is flooded'"),
    ("road_graph_empty", "impact", "'limiting'", "links = 0", "'no road is mapped'"),
]
#: The sources that inputs may come from, and the inputs that a finished run has.
SOURCES = ("sentinel-1-rtc", "sentinel-1-grd", "sentinel-2", "cop-dem-glo-30", "pre-event-openstreetmap", "permitted-training-datasets")
ROLES = ("s1_pre", "s1_post", "dem", "osm")
#: What may be wrong with an input, first things first.
PROBLEMS = ("source not allowed", "training data not registered", "map not verified", "time not readable", "map younger than the flood")
#: Inputs that one task sorts at most, about.
PART_ROWS = 500_000
FLAG = ["incident", "code", "stage", "severity", "message"]


def flagged(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Every rule that holds in a row: incident, code, stage, severity and message. All rules are looked at in one pass."""
    found = [F.when(F.coalesce(F.expr(test), F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(stage).alias("stage"), F.expr(severity).alias("severity"), F.expr(message).alias("message"))) for code, stage, severity, test, message in rules]
    return rows.select("incident", F.explode(F.array_compact(F.array(*found))).alias("f")).select("incident", "f.*")


def incident_flags(incidents: DataFrame, stages: DataFrame) -> DataFrame:
    """Flags of incidents, and one for each of their stages (incident, stage, status, error) that failed."""
    failed = stages.where("status = 'failed'").select("incident", F.lit("stage_failed").alias("code"), "stage", F.lit("limiting").alias("severity"), F.col("error").alias("message"))
    return flagged(incidents, INCIDENT_RULES).unionByName(failed)


def impact_flags(impacts: DataFrame, before: DataFrame) -> DataFrame:
    """Flags handed on, each code, severity and message once, and those of the impact rules whose code an incident does not have yet."""
    known = before.groupBy("incident", "code", "severity", "message").agg(F.min("stage").alias("stage")).select(*FLAG)
    return known.unionByName(flagged(impacts, IMPACT_RULES).join(known.select("incident", "code"), ["incident", "code"], "left_anti").select(*FLAG))


def trust(incidents: DataFrame, flags: DataFrame, insufficient: Column) -> DataFrame:
    """Limiting and cautioning flags of every incident, with none of them too, and its trust. `insufficient` may use the column `limiting`."""
    n = lambda s: F.sum((F.col("severity") == s).cast("long")).alias(s)
    out = incidents.join(flags.groupBy("incident").agg(n("limiting"), n("caution")), "incident", "left").fillna(0, ["limiting", "caution"])
    told = F.when(F.coalesce(insufficient, F.lit(False)), "insufficient").when((F.col("limiting") > 0) | (F.col("caution") >= 2), "uncertain").when(F.col("caution") == 1, "probable").otherwise("strong")
    return out.select("incident", "limiting", "caution", told.alias("trust"))


def _moment(text: Column) -> Column:
    """Seconds since 1970 of a day, which starts at midnight UTC, or of a time with its zone; else null."""
    return zoned_time(F.when(F.length(text) == 10, F.concat(text, F.lit("T00:00:00Z"))).otherwise(text), False)


def provenance_problems(inputs: DataFrame, incidents: DataFrame, training: Sequence[str] = ()) -> DataFrame:
    """What keeps an incident from being used: incident, place of the input (null: the whole) and problem.

    `inputs` are (incident, place, source, collection, role, snapshot_verified, snapshot), `incidents` (incident, status, flood_date). An input has
    its first problem only. A map must be verified and not younger than the start of the flood's day; a ready incident has all roles.

    All texts are looked at before the shuffles: of the inputs only those that may have a problem travel, with its number and the time of a map, and a bit
    per role is ORed for each incident. Rows are dealt to as many tasks as hold PART_ROWS inputs each, as narrow rows pack so well that parts of a
    size in bytes hold very many.
    """
    parts = max(2, -(-inputs.count() // PART_ROWS))
    dealt = lambda rows: shuffled(rows.repartition(parts, "incident"))
    osm, allowed = F.col("source") == "pre-event-openstreetmap", F.coalesce(F.col("source").isin(*SOURCES), F.lit(False))
    registered = F.coalesce(F.col("collection").isin(*training), F.lit(False)) if training else F.lit(False)
    alone = F.when(~allowed, 0).when((F.col("source") == "permitted-training-datasets") & ~registered, 1).when(osm & ~F.coalesce("snapshot_verified", F.lit(False)), 2).cast("tinyint")
    # what the input alone does not settle are verified maps: their time is compared with the flood's
    judged = inputs.select("incident", "place", alone.alias("alone"), F.when(osm & alone.isNull(), _moment(F.col("snapshot"))).alias("moment"), osm.alias("osm")).where("alone is not null or osm").drop("osm")
    met = dealt(judged).join(dealt(incidents.select("incident", _moment(F.col("flood_date")).alias("till"))), "incident")
    number = F.when(F.col("alone").isNotNull(), F.col("alone")).when(F.col("moment").isNull() | F.col("till").isNull(), 3).when(F.col("moment") > F.col("till"), 4)
    texts = F.array(*[F.lit(x) for x in PROBLEMS])
    each = met.select("incident", "place", number.cast("int").alias("number")).where("number is not null").select("incident", "place", F.get(texts, F.col("number")).alias("problem"))

    bit = F.coalesce(*[F.when(F.col("role") == r, 1 << k) for k, r in enumerate(sorted(ROLES))])
    has = dealt(inputs.select("incident", bit.alias("bit")).where("bit is not null")).groupBy("incident").agg(F.bit_or("bit").alias("has"))
    ready = dealt(incidents.where("status = 'ready'").select("incident")).join(shuffled(has), "incident", "left").withColumn("has", F.coalesce("has", F.lit(0))).where(F.col("has") < (1 << len(ROLES)) - 1)
    missing = F.array_compact(F.array(*[F.when(F.col("has").bitwiseAND(1 << k) == 0, r) for k, r in enumerate(sorted(ROLES))]))
    return each.unionByName(ready.select("incident", F.lit(None).cast("int").alias("place"), F.concat(F.lit("missing "), F.array_join(missing, ", ")).alias("problem")))
