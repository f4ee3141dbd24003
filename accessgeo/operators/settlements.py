"""Routes of settlements that leave their own town out, the rule on uncertain evidence, and what restoring a link would do for a cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accessgeo.operators import paths
from accessgeo.session import checkpointed

MAIN, CLASSES = ("hospital", "town"), ("hospital", "town", "clinic")
#: Counts of the hit links on a way: all, and those with evidence of tier 1 and 2.
HITS = ["responsible", "ones", "twos"]
#: A detour of more than this many times the time before is degraded access.
DEGRADED = 1.5


def both_ways(graph: DataFrame, scenario: str) -> DataFrame:
    """scenario, u, v, cost, link_id of the links (a, b, travel_ms) of a scenario, in both directions."""
    name, link = F.lit(scenario).alias("scenario"), F.concat_ws("-", "a", "b").alias("link_id")
    ahead = graph.select(name, F.col("a").alias("u"), F.col("b").alias("v"), F.col("travel_ms").alias("cost"), link)
    return ahead.unionByName(graph.select(name, F.col("b").alias("u"), F.col("a").alias("v"), F.col("travel_ms").alias("cost"), link))


def other_towns(found: DataFrame, edges: DataFrame, towns: DataFrame) -> DataFrame:
    """Nearest other town of each town: scenario, osm_id, cost, target, and the link (u, v, link_id) at which the way leaves its region.

    `found` has the nearest town of every node (scenario, node, cost, target), `towns` osm_id and at. Nodes whose nearest town is the same are
    that town's region. The way to another town leaves the region over one link, and behind it the nearest town of its
    far end is at least as near, so one join over the links finds it, whatever the number of towns. Ties go to the least target. Towns that
    share a node are at cost 0 of one another. A town alone in its component has no cost and target.
    """
    side = found.select("scenario", "node", "cost", "target")
    left = side.select("scenario", F.col("node").alias("u"), F.col("cost").alias("cu"), F.col("target").alias("town"))
    right = side.select("scenario", F.col("node").alias("v"), F.col("cost").alias("cv"), "target")
    leaving = edges.withColumnRenamed("cost", "w").join(left, ["scenario", "u"]).join(right, ["scenario", "v"]).where("town <> target")
    best = leaving.groupBy("scenario", "town").agg(F.min(F.struct((F.col("cu") + F.col("w") + F.col("cv")).alias("cost"), "target", "u", "v", "link_id")).alias("b"))
    least = towns.groupBy("at").agg(F.min("osm_id").alias("first"))
    second = towns.join(least, "at").where("osm_id <> first").groupBy("at").agg(F.min("osm_id").alias("second"))
    here = towns.join(least, "at").join(second, "at", "left").select("osm_id", F.col("at").alias("node"), F.when(F.col("osm_id") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("here"))
    known = side.where("cost = 0").select("scenario", "node").join(here, "node").join(best.withColumnRenamed("town", "osm_id"), ["scenario", "osm_id"], "left")
    away = F.col("here").isNull()
    return known.select("scenario", "osm_id", F.when(away, F.col("b.cost")).otherwise(F.lit(0).cast("long")).alias("cost"), F.when(away, F.col("b.target")).otherwise(F.col("here")).alias("target"), *[F.when(away, F.col(f"b.{c}")).alias(c) for c in ("u", "v", "link_id")])


def route_hits(found: DataFrame, edges: DataFrame, links: DataFrame) -> DataFrame:
    """class, node, `responsible` (links on the way to the nearest destination whose fastest member is hit), `ones` and `twos` (those of evidence tier 1 and 2).

    `found`: class, node, cost, target of one scenario. A way keeps to the region of its destination; the least next node wins among equal ways.
    """
    keys = ["class", "target"]
    ahead = paths.route_pointers(found.select(*keys, "node", "cost"), edges.select("u", "v", "cost", "link_id"), keys).join(links.select("link_id", *_hits()), "link_id", "left")
    valued = ahead.select(*keys, "node", "next", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in HITS])
    return paths.sums_along(valued, HITS, keys).drop("target")


def _hits() -> list[Column]:
    return [F.col("fastest_hit").cast("long").alias("responsible"), *[(F.col("fastest_hit") & (F.col("evidence_tier") == k)).cast("long").alias(c) for k, c in ((1, "ones"), (2, "twos"))]]


def settled(isolated: DataFrame, found: DataFrame, others: DataFrame, hits: DataFrame, links: DataFrame) -> DataFrame:
    """Final status, reason and access detail of each subject of `isolated` (see network.isolation).

    A connected subject becomes UNCERTAIN if its baseline ways to a hospital and a town meet hit links and all of them are of evidence tier 1. Times
    before and after are those of the baseline and likely graphs; a town's own place is no destination of it.
    """
    here = isolated.select("osm_id", "place", F.col("at").alias("node"))
    wanted = [(s, k) for s in ("baseline", "likely") for k in CLASSES]
    direct = here.join(found, "node").where("class <> 'town' or place <> 'town'").select("osm_id", "scenario", "class", "cost")
    to_town = others.select("osm_id", "scenario", F.lit("town").alias("class"), "cost")
    costs = direct.unionByName(to_town).groupBy("osm_id").agg(*[F.min(F.when((F.col("scenario") == s) & (F.col("class") == k), F.col("cost"))).alias(f"{s}_{k}_ms") for s, k in wanted])

    own = here.join(hits, "node").where("class = 'hospital' or place <> 'town'").select("osm_id", *HITS)
    way = others.where("scenario = 'baseline' and u is not null")
    ends = way.select("osm_id", F.explode(F.array("u", "v")).alias("node")).join(hits.where("class = 'town'"), "node").select("osm_id", *HITS)
    between = way.select("osm_id", "link_id").join(links.select("link_id", *_hits()), "link_id").select("osm_id", *HITS)
    met = own.unionByName(ends).unionByName(between).groupBy("osm_id").agg(*[F.sum(c).alias(c) for c in HITS])

    out = isolated.join(costs, "osm_id", "left").join(met, "osm_id", "left").fillna(0, HITS)
    for k in CLASSES:
        before, after = F.col(f"baseline_{k}_ms"), F.col(f"likely_{k}_ms")
        out = out.withColumn(f"detour_{k}", F.when(before.isNull() | after.isNull(), None).when(before == 0, 1.0).otherwise(after / before))
    doubtful = (F.col("status") == "CONNECTED") & (F.col("responsible") > 0) & (F.col("responsible") == F.col("ones"))
    lost = {s: F.col(f"lost_{s}_hospital") | F.col(f"lost_{s}_town") for s in ("likely", "possible")}
    missing = ~F.col("baseline_hospital") | ~F.col("baseline_town")
    lacks = F.array_join(F.array_compact(F.array(*[F.when(~F.col(f"baseline_{k}"), k) for k in MAIN])), ", ")
    reason = F.when(~F.col("snapped"), "not on the network").when(lost["likely"], "lost in the likely scenario").when(lost["possible"], "lost only in the possible scenario").when(missing, F.concat(F.lit("no baseline road access: "), lacks)).when(doubtful, "way hit by uncertain evidence only").otherwise("access kept")
    slow = F.coalesce(F.greatest(*[F.col(f"detour_{k}") for k in MAIN]) > DEGRADED, F.lit(False))
    detail = F.when(~F.col("snapped"), "unmapped").when(lost["likely"], "none").when(missing, "unmapped").when(slow, "degraded").otherwise("full")
    return out.withColumns({"status": F.when(doubtful, "UNCERTAIN").otherwise(F.col("status")), "reason": reason, "access_detail": detail})


def restoration(isolated: DataFrame, destinations: DataFrame, links: DataFrame, likely: DataFrame, buildings: DataFrame) -> DataFrame:
    """comp, buildings, link_id, sufficient: the removed links on the boundary of each cluster of cut-off subjects, and whether one alone gives every member
    back all that it lost.

    A restored link unites two components, and a lost class has no other destination at home, so the other side's counts decide. Members are
    summed by component before any join with links. `buildings` has osm_id and buildings; a cluster without a boundary gives
    one row without a link.
    """
    there = destinations.join(likely, destinations["at"] == likely["node"]).groupBy(F.col("comp").alias("other")).agg(*[F.bool_or(F.col("class") == k).alias("has_" + k) for k in MAIN])
    cut = isolated.where("status = 'CUT OFF'").join(buildings, "osm_id", "left").groupBy(F.col("likely_comp").alias("comp")).agg(F.sum(F.coalesce("buildings", F.lit(0))).alias("buildings"), *[F.bool_or(f"lost_likely_{k}").alias(k) for k in MAIN])
    gone = links.where("lost_likely").join(likely.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a").join(likely.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b").where("ca <> cb")
    sides = gone.select("link_id", F.explode(F.array(F.struct(F.col("ca").alias("comp"), F.col("cb").alias("other")), F.struct(F.col("cb").alias("comp"), F.col("ca").alias("other")))).alias("s")).select("link_id", "s.*")
    enough = [~F.col(k) | F.coalesce("has_" + k, F.lit(False)) for k in MAIN]
    found = cut.join(sides, "comp", "left").join(there, "other", "left")
    return found.select("comp", "buildings", "link_id", F.when(F.col("link_id").isNotNull(), enough[0] & enough[1]).alias("sufficient"))


def analysed(isolated: DataFrame, destinations: DataFrame, graphs: dict[str, DataFrame], routes: DataFrame) -> DataFrame:
    """`settled` over the graphs `baseline` (links) and `likely`; `routes` are those of network.routes over both."""
    found = checkpointed(routes)
    edges = checkpointed(both_ways(graphs["baseline"], "baseline").unionByName(both_ways(graphs["likely"], "likely")))
    others = checkpointed(other_towns(found.where("class = 'town'"), edges, destinations.where("class = 'town'").select("osm_id", "at")))
    hits = checkpointed(route_hits(found.where("scenario = 'baseline' and class <> 'clinic'"), edges.where("scenario = 'baseline'"), graphs["baseline"]))
    return settled(isolated, found, others, hits, graphs["baseline"])


def attributed(final: DataFrame, buildings: DataFrame, links: DataFrame, likely: DataFrame) -> DataFrame:
    """`final` (see settled) with cluster_buildings, tier, detour, degraded, attributable and gap.

    tier: the least evidence tier of the hit links on a settlement's ways and, if it is cut off, of the removed links around its component of the likely graph
    (`likely`: node, comp); 0 without any. cluster_buildings: of a cut-off settlement all buildings of those in its component. detour: the greatest
    over the classes, 1 if none is known. A settlement is attributable to the flood if it is cut off; or on the network with a hit way and a degraded one; or uncertain with a hit way and either a
    loss in the possible scenario or complete access before and evidence of tier 1. An uncertain one that is not, without a place on the network
    or without hospital and town before, is a gap in the data. Buildings and tiers are summed by component before they meet settlements.
    """
    c = F.col
    cut, complete = c("status") == "CUT OFF", c("baseline_hospital") & c("baseline_town")
    own = final.join(buildings, "osm_id", "left").withColumn("buildings", F.coalesce("buildings", F.lit(0)))
    totals = own.where(cut).groupBy("likely_comp").agg(F.sum("buildings").alias("total"))
    sides = links.where("lost_likely").select("a", "b", "evidence_tier").join(likely.select(c("node").alias("a"), c("comp").alias("ca")), "a").join(likely.select(c("node").alias("b"), c("comp").alias("cb")), "b").where("ca <> cb")
    around = sides.select(F.explode(F.array("ca", "cb")).alias("likely_comp"), "evidence_tier").groupBy("likely_comp").agg(F.min("evidence_tier").alias("around"))
    rows = own.join(totals, "likely_comp", "left").join(around, "likely_comp", "left")
    on_way = F.when(c("ones") > 0, 1).when(c("twos") > 0, 2).when(c("responsible") > 0, 3)
    slow = F.greatest(*[F.coalesce(f"detour_{k}", F.lit(1.0)) for k in CLASSES])
    rows = rows.withColumns({
        "cluster_buildings": F.when(cut, F.greatest("buildings", F.coalesce("total", F.lit(0)))).otherwise(c("buildings")), "tier": F.coalesce(F.least(on_way, F.when(cut, c("around"))), F.lit(0)),
        "detour": F.greatest(*[F.col(f"detour_{k}") for k in CLASSES]), "degraded": (c("access_detail") == "degraded") | (slow > DEGRADED)})
    hit = c("snapped") & (c("responsible") > 0)
    loss = c("lost_possible_hospital") | c("lost_possible_town")
    rows = rows.withColumn("detour", F.coalesce("detour", F.lit(1.0))).withColumn("attributable", cut | (hit & c("degraded")) | ((c("status") == "UNCERTAIN") & hit & (loss | (complete & (c("ones") > 0)))))
    return rows.withColumn("gap", ~c("attributable") & (c("status") == "UNCERTAIN") & (~c("snapped") | ~complete)).drop("total", "around", "buildings")
