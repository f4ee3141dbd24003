"""Road pieces from way geometry, routes as pointers, and graph bridges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from accessgeo.operators.fixpoint import SHARD_EDGES, doubled, sent, shortest_paths
from accessgeo.session import checkpointed, shuffled


def way_pieces(vertices: DataFrame) -> DataFrame:
    """Pieces of ways between junctions: way, piece, u, v, points, length.

    `vertices` are (way, idx, x, y) with integer coordinates. Vertices that repeat the one before are dropped; a
    junction is a place that more than one way has, or an end of a way. The places meet by a grouping on
    coordinates, taken before the shuffle, so a place that very many ways share is one row.
    """
    along = Window.partitionBy("way").orderBy("idx")
    before = F.struct(F.lag("x").over(along).alias("x"), F.lag("y").over(along).alias("y"))
    kept = vertices.withColumn("b", before).where("not (b.x <=> x and b.y <=> y)").select("way", "idx", "x", "y")
    shared = kept.groupBy("x", "y").agg(F.min("way").alias("lo"), F.max("way").alias("hi")).where("lo <> hi").select("x", "y", F.lit(True).alias("shared"))
    marked = kept.join(shared, ["x", "y"], "left")
    step = F.hypot(F.col("x") - F.lag("x").over(along), F.col("y") - F.lag("y").over(along))
    ends = F.lag("x").over(along).isNull() | F.lead("x").over(along).isNull()
    marked = marked.select("way", "idx", "x", "y", (F.coalesce("shared", F.lit(False)) | ends).alias("cut"), F.coalesce(step, F.lit(0.0)).alias("step"))
    # a vertex belongs to the piece that ends in it or passes through it
    number = F.sum(F.col("cut").cast("int")).over(along.rowsBetween(Window.unboundedPreceding, -1))
    inner = marked.withColumn("piece", number - 1).withColumn("name", F.concat_ws(":", "x", "y"))
    starts = F.lag(F.when(F.col("cut"), F.col("name"))).over(along)
    inner = inner.withColumn("from", starts)
    pieces = inner.where("piece >= 0").groupBy("way", "piece").agg(F.min_by("from", "idx").alias("u"), F.max_by("name", "idx").alias("v"), (F.count(F.lit(1)) + 1).alias("points"), F.sum("step").alias("length"))
    return pieces.where("length > 0")


def route_pointers(costs: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """The next node and link on the way to the seed: keys, node, next, link_id (null at seeds).

    `costs` are (keys, node, cost) of shortest_paths; the least (node, link) wins among equal routes.
    """
    on = [k for k in keys if k in edges.columns]
    ahead = costs.select(*keys, F.col("node").alias("v"), F.col("cost").alias("after"))
    step = costs.where("cost > 0").join(edges.select(*on, F.col("u").alias("node"), "v", F.col("cost").alias("w"), "link_id"), [*on, "node"]).join(ahead, [*keys, "v"])
    best = step.where("after + w = cost").groupBy(*keys, "node").agg(F.min(F.struct("v", "link_id")).alias("b"))
    return costs.select(*keys, "node").join(best, [*keys, "node"], "left").select(*keys, "node", F.col("b.v").alias("next"), F.col("b.link_id").alias("link_id"))


def sums_along(pointers: DataFrame, values: list[str], keys: list[str]) -> DataFrame:
    """Sum of `values` from each node to the end of its pointers, itself included. The reach doubles each round."""
    start = pointers.select(*keys, "node", F.col("next").alias("to"), *values)

    def step(now: DataFrame) -> DataFrame:
        there = now.select(*keys, F.col("node").alias("to"), F.col("to").alias("to2"), *[F.col(v).alias(v + "2") for v in values])
        return now.join(there, [*keys, "to"], "left").select(*keys, "node", F.col("to2").alias("to"), *[(F.col(v) + F.coalesce(v + "2", F.lit(0))).alias(v) for v in values])

    return doubled(start, step, "to is not null").select(*keys, "node", *values)


def spanning_tree(links: DataFrame, comp: DataFrame, shard_edges: int = SHARD_EDGES) -> DataFrame:
    """A tree by breadth of each component, rooted in its least node: node, next (null at roots)."""
    e = links.select("a", "b")
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v"))).withColumn("cost", F.lit(1).cast("long"))
    roots = comp.select(F.col("comp").alias("node")).distinct().withColumn("key", F.lit("tree")).withColumn("target", F.lit(0))
    depth = shortest_paths(roots, both, ["key"], shard_edges).select("node", F.col("cost").alias("depth"))
    up = both.select("u", "v").join(depth.select(F.col("node").alias("u"), F.col("depth").alias("du")), "u").join(depth.select(F.col("node").alias("v"), F.col("depth").alias("dv")), "v").where("dv = du - 1")
    return checkpointed(depth.select("node").join(up.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("next")), "node", "left"))


def sums_below(tree: DataFrame, sums: list[str], xors: list[str] = ()) -> DataFrame:
    """Sum (or XOR) over the nodes below each node of `tree` (node, next and the columns), itself included, by doubling reach."""
    names = [*sums, *xors]
    start = tree.select("node", F.col("next").alias("to"), *names)

    def step(now: DataFrame) -> DataFrame:
        more = [F.sum(c).alias(c + "2") for c in sums] + [F.expr(f"bit_xor({c})").alias(c + "2") for c in xors]
        arrived = now.where("to is not null").groupBy(F.col("to").alias("node")).agg(*more)
        ahead = now.select(F.col("node").alias("to"), F.col("to").alias("to2"))
        none = F.lit(0).cast("long")
        both = [(F.col(c) + F.coalesce(c + "2", none)).alias(c) for c in sums] + [F.col(c).bitwiseXOR(F.coalesce(c + "2", none)).alias(c) for c in xors]
        return now.join(arrived, "node", "left").join(ahead, "to", "left").select("node", F.col("to2").alias("to"), *both)

    return doubled(start, step, "to is not null").select("node", *names)


def graph_bridges(links: DataFrame, tree: DataFrame) -> DataFrame:
    """Links whose loss would cut their component in two: a, b and `below`, the node on the far side from the root.

    A link of the tree is a bridge if no other link spans it. Each link outside the tree gets a 64-bit hash; the XOR
    of the hashes at the nodes below a tree link holds just the links that span it, and is zero if there are none
    (hashes cancel with a chance of 2 ** -64). The reach below doubles in each round of joins and sums.
    """
    e = links.select("a", "b", F.xxhash64("a", "b").alias("h"))
    in_tree = tree.where("next is not null").select(F.least("node", "next").alias("a"), F.greatest("node", "next").alias("b"))
    spare = e.join(in_tree, ["a", "b"], "left_anti")
    at = spare.select(F.explode(F.array("a", "b")).alias("node"), "h").groupBy("node").agg(F.expr("bit_xor(h)").alias("x"))
    marked = tree.join(at, "node", "left").select("node", "next", F.coalesce("x", F.lit(0).cast("long")).alias("x"))
    found = tree.where("next is not null").join(sums_below(marked, [], ["x"]), "node").where("x = 0")
    return found.select(F.least("node", "next").alias("a"), F.greatest("node", "next").alias("b"), F.col("node").alias("below"))


def _bridges_within(sums: list[str]):
    """Nodes with a value and links of whole components -> a, b of each graph bridge, with sums over the nodes on one side of it and over its component.

    One search in depth numbers the nodes; a tree link is a bridge if nothing below it reaches back above it.
    """

    def search(nodes: pa.Table, links: pa.Table) -> pa.Table:
        ends = [links.column(c).to_numpy() for c in ("a", "b")]
        valued = nodes.column("node").to_numpy()
        names = np.unique(np.concatenate([valued, *ends]))
        below = np.zeros((len(names), len(sums)), np.int64)
        below[np.searchsorted(names, valued)] = np.stack([nodes.column(c).to_numpy() for c in sums], 1)
        a, b = (np.searchsorted(names, x) for x in ends)
        tail, head = np.concatenate([a, b]), np.concatenate([b, a])
        by = np.argsort(tail, kind="stable")
        first, near = np.searchsorted(tail[by], np.arange(len(names) + 1)).tolist(), head[by].tolist()
        at, seen, low, up, met, root = first[:-1], [-1] * len(names), [0] * len(names), [-1] * len(names), [], np.zeros(len(names), np.int64)
        for top in range(len(names)):
            if seen[top] >= 0:
                continue
            stack = [top]
            while stack:
                n = stack[-1]
                if seen[n] < 0:
                    seen[n] = low[n] = len(met)
                    met.append(n)
                    root[n] = top
                if at[n] == first[n + 1]:
                    stack.pop()
                    if up[n] >= 0:
                        low[up[n]] = min(low[up[n]], low[n])
                    continue
                m = near[at[n]]
                at[n] += 1
                if seen[m] < 0:
                    up[m] = n
                    stack.append(m)
                elif m != up[n]:
                    low[n] = min(low[n], seen[m])
        for n in reversed(met):
            if up[n] >= 0:
                below[up[n]] += below[n]
        cut = np.array([n for n in met if up[n] >= 0 and low[n] > seen[up[n]]], np.int64)
        over = np.array([up[n] for n in cut.tolist()], np.int64)
        ends = [names[np.minimum(cut, over)], names[np.maximum(cut, over)]]
        return pa.table([*ends, *below[cut].T, *below[root[cut]].T], names=["a", "b", *sums, *["all_" + c for c in sums]])

    return search


def bridge_sums(links: DataFrame, valued: DataFrame, sums: list[str], shard_edges: int = SHARD_EDGES, comp: DataFrame | None = None) -> DataFrame:
    """Graph bridges a, b with `sums` over the nodes on one side of them, and all_... over their component.

    `valued`: node, comp and the columns to add up, of all nodes; or, with `comp` (node, comp of all nodes, checkpointed), at least of those with a value. Components of at most `shard_edges` links are searched whole, several in a task; the links of
    larger ones go through a spanning tree and sums that double their reach.
    """
    comp = valued.select("node", "comp") if comp is None else comp
    sized = checkpointed(links.select("a", "b").join(shuffled(comp.select(F.col("node").alias("a"), "comp")), "a"))
    sizes = checkpointed(sized.groupBy("comp").agg(F.count(F.lit(1)).alias("links")))
    large = checkpointed(sizes.where(F.col("links") > shard_edges).select("comp"))
    bins = max(1, -(-(sizes.where(F.col("links") <= shard_edges).agg(F.sum("links").alias("n")).first()["n"] or 0) // shard_edges))
    bin_ = F.pmod(F.xxhash64("comp"), F.lit(bins)).alias("bin")
    out = ["a", "b", *sums, *["all_" + c for c in sums]]
    gone = sent(large)
    small_nodes, small_links = valued.join(gone, "comp", "left_anti").select(bin_, "node", *sums), sized.join(gone, "comp", "left_anti").select(bin_, "a", "b")
    found = small_nodes.groupBy("bin").cogroup(small_links.groupBy("bin")).applyInArrow(_bridges_within(sums), ", ".join(f"{c} bigint" for c in out))
    if large.isEmpty():
        return found
    nodes = comp.join(gone, "comp", "left_semi").join(valued.select("node", *sums), "node", "left").fillna(0, sums)
    own = sized.join(gone, "comp", "left_semi").select("a", "b")
    tree = spanning_tree(own, nodes.select("node", "comp"), shard_edges)
    below = sums_below(tree.join(nodes.select("node", *sums), "node"), sums)
    whole = nodes.groupBy("comp").agg(*[F.sum(c).alias("all_" + c) for c in sums])
    far = graph_bridges(own, tree).join(below.withColumnRenamed("node", "below"), "below").join(nodes.select(F.col("node").alias("below"), "comp"), "below")
    return found.unionByName(far.join(whole, "comp").select(*out))


def latent_losses(links: DataFrame, comp: DataFrame, subjects: DataFrame, destinations: DataFrame, shard_edges: int = SHARD_EDGES) -> DataFrame:
    """For each sound road bridge that is also a bridge of the graph: subjects that would lose their hospital or town with it.

    Both sides are known from sums over them, so no graph is searched again and no number of candidates is a limit.
    A town is no destination of itself.
    """
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    care = destinations.groupBy(F.col("at").alias("node")).agg(n(F.col("class") == "hospital").alias("hospitals"), n(F.col("class") == "town").alias("towns"))
    homes = subjects.groupBy(F.col("at").alias("node")).agg(n(F.col("place") != "town").alias("villages"), n(F.col("place") == "town").alias("town_subjects"))
    names = ["hospitals", "towns", "villages", "town_subjects"]
    # places are few beside nodes, so only they carry values
    valued = checkpointed(shuffled(comp).join(care.join(homes, "node", "full").fillna(0, names), "node"))
    both = links.where("is_bridge and not lost_possible and not any_hit").select("link_id", "a", "b").join(bridge_sums(links, valued, names, shard_edges, comp), ["a", "b"])
    sides = both.select("link_id", F.explode(F.array(*[F.struct(*[(F.col(c) if k == 0 else F.col("all_" + c) - F.col(c)).alias(c) for c in names], *[F.col("all_" + c) for c in names[:2]]) for k in (0, 1)])).alias("s")).select("link_id", "s.*")
    no_hospital = (F.col("hospitals") == 0) & (F.col("all_hospitals") > 0)
    no_town, no_other = (F.col("towns") == 0) & (F.col("all_towns") > 0), (F.col("towns") == 1) & (F.col("all_towns") > 1)
    v, t = F.col("villages"), F.col("town_subjects")
    lost = sides.groupBy("link_id").agg(
        F.sum(no_hospital.cast("long") * (v + t)).alias("hospital"), F.sum(no_town.cast("long") * v + no_other.cast("long") * t).alias("town"),
        F.sum((no_hospital | no_town).cast("long") * v + (no_hospital | no_other).cast("long") * t).alias("count"))
    return lost
