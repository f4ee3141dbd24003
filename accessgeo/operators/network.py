"""Road links with parallel members, scenarios, access, isolation and chokepoints.

Members are rows (u, v, member_id, travel_ms, hit, tier, is_bridge, ...); a link is all members between two nodes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accessgeo.operators.fixpoint import LOCAL_EDGES, components, shortest_paths
from accessgeo.session import checkpointed, shuffled

CLASSES = ("hospital", "town", "clinic")


def build_links(members: DataFrame) -> DataFrame:
    """One row per unordered pair of nodes: a < b, its fastest member, and what its members share."""
    m = members.where("u <> v").withColumn("a", F.least("u", "v")).withColumn("b", F.greatest("u", "v"))
    fastest = F.min(F.struct("travel_ms", "member_id", "hit", "length_m", "highway"))
    out = m.groupBy("a", "b").agg(
        fastest.alias("f"), F.count(F.lit(1)).alias("members"), F.array_sort(F.collect_set("member_id")).alias("member_ids"), F.bool_or("is_bridge").alias("is_bridge"), F.max("tier").alias("tier_max"),
        F.bool_and("hit").alias("all_hit"), F.bool_or("hit").alias("any_hit"), F.coalesce(F.min(F.when(F.col("hit"), F.col("tier"))), F.lit(0)).alias("evidence_tier"),
        F.bool_and(F.col("hit") & (F.col("tier") >= 2)).alias("lost_likely"), F.bool_and(F.col("hit") & (F.col("tier") >= 1)).alias("lost_possible"))
    return out.select(F.concat_ws("-", "a", "b").alias("link_id"), "a", "b", F.col("f.travel_ms").alias("travel_ms"), F.col("f.member_id").alias("fastest"), F.col("f.length_m").alias("length_m"), F.col("f.hit").alias("fastest_hit"), "members", "member_ids", "is_bridge", "tier_max", "all_hit", "any_hit", "evidence_tier", "lost_likely", "lost_possible")


def surviving(members: DataFrame, least_tier: int) -> DataFrame:
    """Links of a scenario: members that are hit with at least `least_tier` are gone, the fastest survivor counts."""
    left = left_by(members, least_tier).where("u <> v")
    a, b = F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")
    return left.select(a, b, "travel_ms", "member_id").groupBy("a", "b").agg(F.min(F.struct("travel_ms", "member_id")).alias("f"), F.count(F.lit(1)).alias("members")).select("a", "b", F.col("f.travel_ms").alias("travel_ms"), F.col("f.member_id").alias("fastest"), "members")


def nodes_of(links: DataFrame) -> DataFrame:
    return links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()


def component_of(nodes: DataFrame, links: DataFrame) -> DataFrame:
    return components(nodes, links.select(F.col("a").alias("u"), F.col("b").alias("v")))


def left_by(members: DataFrame, least_tier: int | None) -> DataFrame:
    """Members that a scenario leaves: all (None), or without those that are hit with at least `least_tier`."""
    return members if least_tier is None else members.where(~(F.col("hit") & (F.col("tier") >= least_tier)))


def road_components(places: DataFrame | None, members: DataFrame, least_tier: int | None = None) -> DataFrame:
    """(node, comp, linked) of `places` (node; None: of all nodes on the network) over the members of a scenario (None: before the flood).

    Members are read several times, as they are: parallel ones need no merging for components.
    """
    return components(places, left_by(members, least_tier), written=True, linked=True)


def places_of(subjects: DataFrame, destinations: DataFrame) -> DataFrame:
    return subjects.select(F.col("at").alias("node")).unionByName(destinations.select(F.col("at").alias("node")))


def access(subjects: DataFrame, destinations: DataFrame, comp: DataFrame) -> DataFrame:
    """(osm_id, hospital, town, clinic): whether the subject's component holds another destination of the class.

    Destinations are counted by component and class before the join, so a large component is one row.
    """
    there = destinations.join(comp, destinations["at"] == comp["node"]).groupBy("comp").agg(*[F.sum((F.col("class") == k).cast("long")).alias("n_" + k) for k in CLASSES])
    here = subjects.join(comp, subjects["at"] == comp["node"], "left").join(there, "comp", "left")
    own = {"town": (F.col("place") == "town").cast("long")}
    return here.select("osm_id", *[(F.coalesce(F.col("n_" + k), F.lit(0)) - own.get(k, F.lit(0)) > 0).alias(k) for k in CLASSES], F.col("comp"))


def status(snapped: Column, likely: list[Column], possible: list[Column], missing: list[Column]) -> Column:
    """The first rule that holds, before the rule on uncertain-tier evidence."""
    def some(cs: list[Column]) -> Column:
        out = cs[0]
        for c in cs[1:]:
            out = out | c
        return out

    return F.when(~snapped, "UNCERTAIN").when(some(likely), "CUT OFF").when(some(possible), "UNCERTAIN").when(some(missing), "UNCERTAIN").otherwise("CONNECTED")


def isolation(subjects: DataFrame, destinations: DataFrame, members: DataFrame) -> DataFrame:
    """Status of every subject over the baseline, likely (tier 2 and up) and possible (tier 1 and up) graphs.

    Components are asked for the places of subjects and destinations on the network alone, and links need no merging of parallel members for them.
    Members are read several times: they should be a plain read or checkpointed.
    """
    roads = members.where("u <> v").select("u", "v", "hit", "tier")
    ends = roads.select(F.col("u").alias("node")).unionByName(roads.select(F.col("v").alias("node")))
    nodes = checkpointed(places_of(subjects, destinations).where("node is not null").distinct().join(ends, "node", "left_semi"))
    out = subjects.join(nodes.withColumnRenamed("node", "at").withColumn("snapped", F.lit(True)), "at", "left").withColumn("snapped", F.coalesce("snapped", F.lit(False)))
    for name, least_tier in (("baseline", None), ("likely", 2), ("possible", 1)):
        comp = checkpointed(components(nodes, left_by(roads, least_tier), LOCAL_EDGES, True))
        found = access(subjects, destinations, comp).select("osm_id", *[F.col(k).alias(f"{name}_{k}") for k in CLASSES], F.col("comp").alias(f"{name}_comp"))
        out = out.join(found, "osm_id")
    c = F.col
    for s in ("likely", "possible"):
        for k in ("hospital", "town"):
            out = out.withColumn(f"lost_{s}_{k}", c(f"baseline_{k}") & ~c(f"{s}_{k}"))
    main = ("hospital", "town")
    return out.withColumn("status", status(c("snapped"), [c(f"lost_likely_{k}") for k in main], [c(f"lost_possible_{k}") for k in main], [~c(f"baseline_{k}") for k in main]))


def clusters(isolated: DataFrame, links: DataFrame, likely: DataFrame) -> DataFrame:
    """Cut-off subjects by component of the likely graph (`likely`: node, comp), with the removed links on its boundary."""
    cut = isolated.where("status = 'CUT OFF'").groupBy(F.col("likely_comp").alias("comp")).agg(F.array_sort(F.collect_set("osm_id")).alias("subjects"), F.bool_or("lost_likely_hospital").alias("hospital"), F.bool_or("lost_likely_town").alias("town"))
    gone = links.where("lost_likely").select("link_id", "a", "b")
    sides = gone.join(likely.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a").join(likely.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b").where("ca <> cb")
    bound = sides.select("link_id", F.explode(F.array("ca", "cb")).alias("comp")).groupBy("comp").agg(F.array_sort(F.collect_set("link_id")).alias("boundary"))
    return cut.join(bound, "comp", "left").select("comp", F.size("subjects").alias("n_subjects"), "hospital", "town", F.array_join("subjects", ",").alias("subjects"), F.coalesce(F.array_join("boundary", ","), F.lit("")).alias("boundary"))


def restored(subjects: DataFrame, destinations: DataFrame, links: DataFrame, likely: DataFrame, base: DataFrame, after: DataFrame) -> DataFrame:
    """For each link that the likely scenario removes: subjects that would get back a hospital or a town if it alone were restored.

    Restoring a link only unites its two components, so no graph is searched again.
    """
    there = destinations.join(likely, destinations["at"] == likely["node"]).groupBy("comp").agg(*[F.sum((F.col("class") == k).cast("long")).alias("n_" + k) for k in ("hospital", "town")])
    gone = links.where("lost_likely").join(likely.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a").join(likely.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b")
    # what each side gains is what the other side holds
    sides = gone.select("link_id", F.explode(F.array(F.struct(F.col("ca").alias("comp"), F.col("cb").alias("other")), F.struct(F.col("cb").alias("comp"), F.col("ca").alias("other")))).alias("s")).select("link_id", "s.comp", "s.other").where("comp <> other")
    gains = sides.join(there.withColumnRenamed("comp", "other"), "other", "left").fillna(0, ["n_hospital", "n_town"])
    lost = subjects.select("osm_id", "at").join(likely, F.col("at") == F.col("node")).select("osm_id", "comp").join(base.select("osm_id", F.col("hospital").alias("h0"), F.col("town").alias("t0")), "osm_id").join(after.select("osm_id", F.col("hospital").alias("h1"), F.col("town").alias("t1")), "osm_id")
    # a lost class has no other destination at home, so the other side's count decides
    lost = lost.withColumn("lh", F.col("h0") & ~F.col("h1")).withColumn("lt", F.col("t0") & ~F.col("t1")).groupBy("comp").agg(*[F.sum(x.cast("long")).alias(n) for n, x in (("both", F.col("lh") & F.col("lt")), ("only_h", F.col("lh") & ~F.col("lt")), ("only_t", ~F.col("lh") & F.col("lt")))])
    won = gains.join(lost, "comp").select("link_id", ((F.col("n_hospital") > 0).cast("long") * (F.col("both") + F.col("only_h"))).alias("h"), ((F.col("n_town") > 0).cast("long") * (F.col("both") + F.col("only_t"))).alias("t"), (((F.col("n_hospital") > 0) | (F.col("n_town") > 0)).cast("long") * F.col("both") + (F.col("n_hospital") > 0).cast("long") * F.col("only_h") + (F.col("n_town") > 0).cast("long") * F.col("only_t")).alias("n"))
    total = won.groupBy("link_id").agg(F.sum("h").alias("hospital"), F.sum("t").alias("town"), F.sum("n").alias("count"))
    return links.where("lost_likely").select("link_id", "evidence_tier").join(total, "link_id", "left").fillna(0, ["hospital", "town", "count"])


def routes(destinations: DataFrame, graphs: dict[str, DataFrame], whole: DataFrame | None = None) -> DataFrame:
    """Least travel time from every node to the nearest destination of each class in each graph: scenario, class, node, cost, target.

    Graphs are a, b, travel_ms, each pair of nodes in one order; parallel members need no merging. `whole`, if given, is one that holds all others, and all are plain reads or checkpointed.
    """
    edges = reduce(DataFrame.unionByName, [g.select(F.lit(name).alias("scenario"), F.col("a").alias("u"), F.col("b").alias("v"), F.col("travel_ms").alias("cost")) for name, g in graphs.items()])
    scenarios = F.explode(F.array(*[F.lit(name) for name in graphs])).alias("scenario")
    seeds = destinations.select("class", F.col("at").alias("node"), F.col("osm_id").alias("target"), scenarios)
    return shortest_paths(seeds, edges, ["scenario", "class"], mirrored=True, linked=True, whole=whole and whole.select(F.col("a").alias("u"), F.col("b").alias("v")))


def member_links(members: DataFrame, least_tier: int | None = None) -> DataFrame:
    """a < b and travel_ms of each member that a scenario leaves, parallel ones too."""
    return left_by(members, least_tier).where("u <> v").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "travel_ms")


def snap(points: DataFrame, nodes: DataFrame, reach: float) -> DataFrame:
    """Nearest node within `reach` of each point (least node on ties), null if there is none.

    Nodes are met through a grid of cells of size `reach`: a point looks into nine cells. Coordinates are x and y.
    """
    def cell(x: str) -> Column:
        return F.floor(F.col(x) / reach).cast("long")

    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    asked = points.select("osm_id", "x", "y", around.alias("d")).select("osm_id", "x", "y", (cell("x") + F.col("d.i")).alias("cx"), (cell("y") + F.col("d.j")).alias("cy"))
    placed = nodes.select("node", F.col("x").alias("nx"), F.col("y").alias("ny"), F.floor(F.col("x") / reach).cast("long").alias("cx"), F.floor(F.col("y") / reach).cast("long").alias("cy"))
    square = (F.col("x") - F.col("nx")) * (F.col("x") - F.col("nx")) + (F.col("y") - F.col("ny")) * (F.col("y") - F.col("ny"))
    best = asked.join(placed, ["cx", "cy"]).withColumn("d2", square).where(F.col("d2") <= reach * reach).groupBy("osm_id").agg(F.min(F.struct("d2", "node")).alias("b"))
    return points.select("osm_id").join(best, "osm_id", "left").select("osm_id", F.col("b.node").alias("node"), F.sqrt(F.col("b.d2").cast("double")).alias("distance"))


def link_lengths(members: DataFrame) -> DataFrame:
    """a, length_m of the fastest member and the number of members of each link: what `graph_summary` needs of them, dealt by a."""
    m = members.where("u <> v").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "travel_ms", "member_id", "length_m")
    return m.repartition("a").groupBy("a", "b").agg(F.min(F.struct("travel_ms", "member_id", "length_m")).alias("f"), F.count(F.lit(1)).alias("members")).select("a", F.col("f.length_m").alias("length_m"), "members")


def graph_summary(links: DataFrame, comp: DataFrame) -> DataFrame:
    """Nodes, links, components, parallel links and the largest component's share of the length."""
    n = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sizes = links.join(shuffled(comp), links["a"] == comp["node"]).groupBy("comp").agg(F.sum("length_m").alias("m"), F.count(F.lit(1)).alias("links"), F.sum((F.col("members") > 1).cast("long")).alias("parallel"))
    counts = sizes.agg(n("links").alias("links"), F.sum("parallel").alias("parallel_links"), (F.max("m") / F.sum("m")).alias("largest_share"))
    # a component is named after one of its nodes
    return comp.agg(F.count(F.lit(1)).alias("nodes"), F.count(F.when(F.col("node") == F.col("comp"), 1)).alias("components")).join(F.broadcast(counts)).select("nodes", "components", "links", "parallel_links", "largest_share")
