"""Iterated DataFrame operators: components, shortest paths, pointer jumping.

Each round is joins and minima with a lineage cut after it, so no group of rows is held by a task and a lost
executor costs one round.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accessgeo.session import checkpointed, shuffled


def fixpoint(start: DataFrame, step: Callable[[DataFrame], DataFrame], sign: str) -> DataFrame:
    """Apply `step`, which only ever lowers or only ever raises values, until the aggregate `sign` (an SQL expression) no longer changes."""
    now, before = checkpointed(start), None
    while True:
        after = now.agg(F.expr(sign).alias("s")).first()["s"]
        if after == before:
            return now
        before, now = after, checkpointed(step(now))


def doubled(start: DataFrame, step: Callable[[DataFrame], DataFrame], going: str) -> DataFrame:
    """Apply `step`, which doubles the reach of pointers (node, to), until no row is `going` (an SQL condition) any more.

    A pointer that still goes on when its reach is longer than the table runs in a circle, and then stands on a node of it: ValueError names one.
    """
    now = checkpointed(start)
    rounds = now.count().bit_length() + 1
    for _ in range(rounds):
        if now.where(going).isEmpty():
            return now
        now = checkpointed(step(now))
    lost = now.where(going).agg(F.min("to").alias("n")).first()["n"]
    if lost is not None:
        raise ValueError(f"pointers run in a circle, for one through node {lost}")
    return now


#: Edges that one task settles at once. Edges of a shard of shortest paths, and rows that are broadcast at most.
LOCAL_EDGES, SHARD_EDGES, SENT_ROWS = 250_000, 50_000, 50_000
#: Edges of a part that a task contracts; a part with more gives the stars of several.
PART_EDGES = 250_000
#: Bits of a node's mark in a part: other parts may have it, it is asked for, an edge links it to another node.
SHARED, ASKED, LINKED = 1, 2, 4


def _stars(batches: list[pa.RecordBatch], every: bool, shared: bool) -> pa.RecordBatch:
    """(node, comp, mark) of each node of the edges u <= v: the least node reachable over them. An edge from a node to itself only asks for it.

    Parts are ranges of (u, v), so a node strictly between the least and the greatest u of a part is another part's only where it lies above all u of that part.
    """
    table = pa.Table.from_batches(batches)
    u, v = table.column("u").to_numpy(), table.column("v").to_numpy()
    names, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = np.concatenate([place[: len(u)], place[len(u) :]]), np.concatenate([place[len(u) :], place[: len(u)]])
    low, before = np.arange(len(names)), None
    while before is None or (low != before).any():
        before = low.copy()
        # a root takes the least label next to any of its nodes, and labels of labels follow
        np.minimum.at(low, before[a], before[b])
        np.minimum.at(low, a, before[b])
        low = low[low]
    mark = np.where((names <= u.min()) | (names >= u.max()) | shared, SHARED, 0).astype(np.int32)
    mark[a[a != b]] |= LINKED
    mark[slice(None) if every else a[a == b]] |= ASKED
    return pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[low]), pa.array(mark)], ["node", "comp", "mark"])


def _contracted(every: bool, whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The stars of a part's edges, of 2 * PART_EDGES or so at a time or of all at once (`whole`)."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        several = False
        for batch in batches:
            if not whole and sum(x.num_rows for x in held) >= 2 * PART_EDGES:
                several = True
                yield _stars(held, every, several)
                held = []
            if batch.num_rows:
                held.append(batch)
        if held:
            yield _stars(held, every, several)

    return contract


def components(nodes: DataFrame | None, edges: DataFrame, local: int = LOCAL_EDGES, written: bool = False, linked: bool = False) -> DataFrame:
    """(node, comp): comp is the least node reachable. `nodes` has node (None: the nodes that edges link to others), `edges` u and v in any direction, all
    bigint. `written` tells that both cost little to read several times: they are checkpointed or plain reads. With `linked` also whether an edge links the node to another.

    The edges are counted first, and each node that is asked for as an edge to itself. Up to `local` of them go through one task. Of more, ranges of node numbers are
    contracted, each in a task, to stars around their least nodes. Nodes strictly inside a range are done with it, unless another range reached up to them. Where stars of
    several ranges share a node, their centres are linked, and these links, few if near nodes have near numbers, are settled
    in the same way. So only edges travel, once, and what ranges share. Links that contraction does not halve are settled by joins.
    """
    links = edges.select("u", "v").where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    if nodes is not None:
        links = links.unionByName(nodes.where("node is not null").select(F.col("node").alias("u"), F.col("node").alias("v")))
    links = links if written else checkpointed(links)
    count, stars_of = links.count(), "node bigint, comp bigint, mark int"

    def named(stars: DataFrame) -> DataFrame:
        more = [((F.col("mark").bitwiseAND(LINKED)) > 0).alias("linked")] if linked else []
        return stars.where(F.col("mark").bitwiseAND(ASKED) > 0).select("node", "comp", *more)

    if count <= local:
        return named(links.repartition(1).mapInArrow(_contracted(nodes is None, True), stars_of))
    # both ends order the rows, so that the edges of one node with very many are dealt too
    stars = checkpointed(links.repartitionByRange(max(2, -(-count // PART_EDGES)), "u", "v").mapInArrow(_contracted(nodes is None, False), stars_of))
    border = checkpointed(stars.where(F.col("mark").bitwiseAND(SHARED) > 0).select("node").distinct())
    few = border.limit(SENT_ROWS + 1).count() <= SENT_ROWS
    touched = stars.join(F.broadcast(border), "node", "left_semi") if few else stars
    # dealt first, as the sets of a part are larger than its rows and each node is there once
    met = touched.repartition("node").groupBy("node").agg(F.min("comp").alias("comp"), F.collect_set("comp").alias("all"), F.bit_or("mark").alias("mark"))
    met = checkpointed(met.select("node", "comp", "mark", F.when(F.size("all") > 1, F.array_remove("all", F.col("comp"))).alias("others")))
    open_ = checkpointed(met.where("others is not null").select(F.col("comp").alias("u"), F.explode("others").alias("v")).distinct())
    found, left = named(met), open_.count()
    if few:
        found = found.unionByName(named(stars.join(F.broadcast(border), "node", "left_anti")))
    if not left:
        return found
    joined = checkpointed((components(None, open_, local, True) if 2 * left <= count else _by_joins(open_)).select(F.col("node").alias("comp"), F.col("comp").alias("least")).where("comp <> least"))
    return found.join(sent(joined), "comp", "left").select("node", F.coalesce("least", "comp").alias("comp"), *(["linked"] if linked else []))


def _by_joins(edges: DataFrame) -> DataFrame:
    """`components` of all nodes of the edges by joins alone: a node takes the least label around it, then the label of its label, so long chains take logarithmically many rounds."""
    both = checkpointed(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct())

    def step(now: DataFrame) -> DataFrame:
        near = both.join(now.select(F.col("node").alias("v"), "comp"), "v").groupBy(F.col("u").alias("node")).agg(F.min("comp").alias("near"))
        low = now.join(near, "node", "left").select("node", F.least("comp", F.coalesce("near", "comp")).alias("low"))
        # the label of the label, and a root takes the least label that any of its nodes saw
        jump = low.select(F.col("node").alias("low"), F.col("low").alias("next"))
        moved = low.join(jump, "low", "left").select("node", F.coalesce("next", "low").alias("c"))
        hook = moved.join(now.select("node", "comp"), "node").groupBy(F.col("comp").alias("node")).agg(F.min("c").alias("h"))
        return moved.join(hook, "node", "left").select("node", F.least("c", F.coalesce("h", "c")).alias("comp"))

    return fixpoint(both.select(F.col("u").alias("node"), F.col("u").alias("comp")).distinct(), step, "sum(cast(comp as decimal(38,0)))")


def sent(df: DataFrame, rows: int = SENT_ROWS) -> DataFrame:
    """`df` (checkpointed), broadcast only if it has at most `rows` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def sharded(edges: DataFrame, shard_edges: int = SHARD_EDGES, whole: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Parts of a graph of edges u, v with about `shard_edges` edges each, the fewer edges between parts the better: (node, shard), the
    edges inside a shard with `shard`, and those between two, if there are any.

    `edges` are read once if there is `whole`, edges u, v between the same nodes at least, which are read several times; else they should be checkpointed.

    Components that fit into a shard stay whole, and many small ones share one; larger ones are cut by ranges of their node numbers. So only the edges
    of larger ones look up both their ends.
    """
    comp = checkpointed(components(None, edges if whole is None else whole, written=True))
    placed = checkpointed(edges.join(shuffled(comp.withColumnRenamed("node", "u")), "u"))
    sizes = checkpointed(placed.groupBy("comp").agg(F.count(F.lit(1)).alias("edges")))
    large = checkpointed(sizes.where(F.col("edges") > shard_edges).select("comp", F.lit(True).alias("large")))
    count = sizes.agg(F.sum(F.when(F.col("edges") <= shard_edges, F.col("edges"))).alias("small"), F.sum(F.when(F.col("edges") > shard_edges, F.col("edges"))).alias("large")).first()
    bins = -(-(count["small"] or 0) // shard_edges)
    dealt = F.pmod(F.xxhash64("comp"), F.lit(max(1, bins))).cast("int").alias("shard")
    if not count["large"]:
        return comp.select("node", dealt), placed.select(*edges.columns, dealt), None
    marked, gone = comp.join(sent(large), "comp", "left"), sent(large.select("comp"))
    cut = checkpointed(marked.where("large").repartitionByRange(-(-count["large"] // shard_edges), "comp", "node").select("node", (F.spark_partition_id() + bins + 1).alias("shard")))
    split = placed.join(gone, "comp", "left_semi").select(*edges.columns)
    both = checkpointed(split.join(cut.select(F.col("node").alias("u"), "shard"), "u").join(cut.select(F.col("node").alias("v"), F.col("shard").alias("to")), "v"))
    inner = placed.join(gone, "comp", "left_anti").select(*edges.columns, dealt).unionByName(both.where("shard = to").select(*edges.columns, "shard"))
    return checkpointed(marked.where("large is null").select("node", dealt).unionByName(cut)), inner, checkpointed(both.where("shard <> to").select(*edges.columns))


def shards(edges: DataFrame, shard_edges: int = SHARD_EDGES) -> DataFrame:
    """(node, shard) of `sharded` alone."""
    return sharded(checkpointed(edges), shard_edges)[0]


def _settled(at: int, highest: bool, mirrored: bool, linked: bool) -> Callable[..., pa.Table]:
    """Labels of a shard and its edges -> the labels that fell. The first columns of the labels are the keys, `at` of them, then node, cost, target, fresh. Edges
    also lead back if `mirrored`; with `linked`, fresh labels of nodes without an edge go."""

    def settle(labels: pa.Table, edges: pa.Table) -> pa.Table:
        u, v, w = (edges.column(c).to_numpy() for c in ("u", "v", "w"))
        if mirrored:
            u, v, w = np.concatenate([u, v]), np.concatenate([v, u]), np.concatenate([w, w])
        node = labels.column("node").to_numpy()
        names, place = np.unique(np.concatenate([node, u, v]), return_inverse=True)
        here, u, v = place[: len(node)], place[len(node) : len(node) + len(u)], place[len(node) + len(u) :].tolist()
        by = np.argsort(u, kind="stable")
        first = np.searchsorted(u[by], np.arange(len(names) + 1)).tolist()
        ahead, weight = [v[k] for k in by.tolist()], w[by].tolist()
        keys = list(zip(*[labels.column(k).to_pylist() for k in range(at)], strict=True)) if at else [()] * len(here)
        known: dict[tuple, dict[int, tuple]] = {}
        heaps: dict[tuple, list[tuple]] = {}
        for key, n, cost, target, fresh in zip(keys, here.tolist(), labels.column("cost").to_pylist(), labels.column("target").to_pylist(), labels.column("fresh").to_pylist(), strict=True):
            if fresh and linked and first[n] == first[n + 1]:
                continue
            if fresh:
                heaps.setdefault(key, []).append((cost, target, n))
            else:
                known.setdefault(key, {})[n] = (cost, target)
        out = []
        for key, heap in heaps.items():
            best, fell = known.get(key, {}), set()
            heapq.heapify(heap)
            while heap:
                cost, target, n = heapq.heappop(heap)
                if n in best and best[n] <= (cost, target):
                    continue
                best[n] = (cost, target)
                fell.add(n)
                for k in range(first[n], first[n + 1]):
                    more = (max(cost, weight[k]) if highest else cost + weight[k], target)
                    if ahead[k] not in best or more < best[ahead[k]]:
                        heapq.heappush(heap, (*more, ahead[k]))
            out += [(*key, names[n], *best[n]) for n in fell]
        fields = [labels.schema.field(k) for k in [*range(at), "node", "cost", "target"]]
        columns = list(zip(*out, strict=True)) or [[] for _ in fields]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], names=[f.name for f in fields])

    return settle


def shortest_paths(seeds: DataFrame, edges: DataFrame, keys: list[str], shard_edges: int = SHARD_EDGES, highest: bool = False, mirrored: bool = False, linked: bool = False, whole: DataFrame | None = None) -> DataFrame:
    """Least cost from the seeds of each key to every node that they reach.

    `seeds`: keys, node, target and perhaps a cost to begin with; `edges`: keys that the edges depend on (a subset of `keys`), u, v, cost, in
    both directions, or if `mirrored` in one of them, as each leads back at the same cost. Returns keys, node, cost, target; equal costs go to the least target. A way costs
    the sum of its edges, or with `highest` its dearest edge (then of several targets at one cost any may be told). With `linked` seeds without an edge give no row.

    A task settles a shard of the graph at once, with a heap; only what crosses from one shard to another takes a further round, in which
    the shards that it reaches are settled anew from what fell. So rounds grow with the shards that a cheapest path crosses, and a graph of
    components that fit into shards takes one. `whole`, if given, has edges u, v between all nodes that `edges` link, and both are plain reads or checkpointed.
    """
    on = [k for k in keys if k in edges.columns]
    keys = [*on, *[k for k in keys if k not in on]]
    rows = edges
    if whole is not None:
        # dealt by u alone, edges meet the components of their nodes where they are; parts are counted, as Spark would join them to one for each core
        count = edges.count()
        rows = edges.repartition(max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count // PART_EDGES)), "u")
    merged = rows.groupBy(*on, F.col("u"), F.col("v")).agg(F.min("cost").alias("w"))
    merged = checkpointed(merged) if whole is None else merged
    at, group = [*keys, "node"], [*on, "shard"]

    def best(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*at).agg(F.min(F.struct("cost", "target")).alias("b")).select(*at, "b.cost", "b.target")

    start = best(seeds.select(*at, F.col("cost") if "cost" in seeds.columns else F.lit(0).cast("long").alias("cost"), "target"))
    if (merged.limit(shard_edges + 1).count() if whole is None else count) <= shard_edges:
        where, cross, inner = None, None, merged.withColumn("shard", F.lit(0))
    else:
        where, inner, cross = sharded(merged, shard_edges, whole)
    if cross is not None:
        if linked:
            some = [x.select(*on, F.col(c).alias("node")) for x in (inner, cross) for c in (("u", "v") if mirrored else ("u",))]
            start = start.join(reduce(DataFrame.unionByName, some), [*on, "node"], "left_semi")
        cross = cross.unionByName(cross.select(*on, F.col("v").alias("u"), F.col("u").alias("v"), "w")) if mirrored else cross
        cross = cross.withColumnRenamed("u", "node")
    plain = start.select(*at, "cost", "target").schema
    settle = _settled(len(keys), highest, mirrored, linked and cross is None)
    near = inner.select(*[F.col(k).alias(k + "_") for k in group], "u", "v", "w")  # other names, as both sides may come from one table

    def settled(labels: DataFrame) -> DataFrame:
        placed = labels.withColumn("shard", F.lit(0)) if where is None else labels.join(where, "node", "left").withColumn("shard", F.coalesce("shard", F.lit(0)))
        placed = placed.select(*at, "cost", "target", "fresh", "shard")
        return checkpointed(placed.groupBy(*group).cogroup(near.groupBy(*[k + "_" for k in group])).applyInArrow(settle, plain))

    now = fell = settled(start.withColumn("fresh", F.lit(True)))
    if cross is None or cross.isEmpty():
        return now
    while True:
        arrived = best(fell.join(cross, [*on, "node"]).select(*keys, F.col("v").alias("node"), (F.greatest("cost", "w") if highest else F.col("cost") + F.col("w")).alias("cost"), "target"))
        old = now.select(*at, F.struct("cost", "target").alias("old"))
        fresh = checkpointed(arrived.join(old, at, "left").where(F.col("old").isNull() | (F.struct("cost", "target") < F.col("old"))).drop("old"))
        if fresh.isEmpty():
            return now
        reached = checkpointed(fresh.join(where, "node").select(*on, "shard").distinct())
        labels = now.join(where, "node").join(sent(reached), group, "left_semi").select(*at, "cost", "target", F.lit(False).alias("fresh"))
        fell = settled(labels.unionByName(fresh.withColumn("fresh", F.lit(True))))
        now = checkpointed(now.join(sent(fell.select(*at)), at, "left_anti").unionByName(fell).repartition(*[F.col(k) for k in at]))


def jump_to_marked(pointers: DataFrame) -> DataFrame:
    """(node, root): follow `next` from each node to the first node with `marked`, null if there is none.

    Pointers double their length in each round. A node without `next` that is not marked leads nowhere; a circle without a marked node raises ValueError.
    """
    start = pointers.select("node", F.when(F.col("marked"), F.col("node")).otherwise(F.col("next")).alias("to"), F.col("marked").alias("done"))

    def step(now: DataFrame) -> DataFrame:
        there = now.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("done").alias("done2"))
        return now.join(there, "to", "left").select("node", F.when(F.col("done"), F.col("to")).otherwise(F.col("to2")).alias("to"), F.coalesce(F.col("done") | F.col("done2"), F.lit(False)).alias("done"))

    end = doubled(start, step, "not done and to is not null")
    return end.select("node", F.when(F.col("done"), F.col("to")).alias("root"))
