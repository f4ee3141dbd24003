"""Graphs that are settled shard by shard, and pointers that run in circles."""

from __future__ import annotations

import heapq
import random

import pytest
from pyspark.sql import functions as F

from accessgeo.operators import fixpoint, hydrology, network, paths


def least(seeds, edges, highest):
    """Plain search over all keys: (key, node) -> (cost, target)."""
    out, heap = {}, [(c, t, k, n) for k, n, c, t in seeds]
    heapq.heapify(heap)
    while heap:
        c, t, k, n = heapq.heappop(heap)
        if (k, n) in out:
            continue
        out[k, n] = (c, t)
        for v, w in edges.get(n, []):
            heapq.heappush(heap, (max(c, w) if highest else c + w, t, k, v))
    return out


@pytest.mark.parametrize(("highest", "shard"), [(False, 12), (True, 12), (False, 10_000)])
def test_paths_over_many_shards_equal_a_plain_search(spark, highest, shard):
    rng = random.Random(shard)
    pairs = [(k, k + 1) for k in range(60)] + [tuple(rng.sample(range(60), 2)) for _ in range(15)] + [(100 + 2 * k, 101 + 2 * k) for k in range(20)]
    rows = [(u, v, rng.randint(1, 9)) for u, v in pairs]
    rows += [(v, u, c) for u, v, c in rows]
    seeds = [("x", 3, 0, 7), ("x", 50, 0, 5), ("y", 20, 4, 1), ("y", 20, 4, 0), ("x", 100, 0, 2), ("y", 999, 1, 1)]
    edges = {}
    for u, v, c in rows:
        edges.setdefault(u, []).append((v, c))
    found = fixpoint.shortest_paths(spark.createDataFrame(seeds, "class string, node bigint, cost bigint, target int"), spark.createDataFrame(rows, "u bigint, v bigint, cost bigint"), ["class"], shard, highest)
    got, told = {(r["class"], r["node"]): (r["cost"], r["target"]) for r in found.collect()}, least(seeds, edges, highest)
    assert (got == told) if not highest else ({k: v[0] for k, v in got.items()} == {k: v[0] for k, v in told.items()})


def test_shards_keep_small_components_whole_and_cut_large_ones(spark):
    rows = [(k, k + 1) for k in range(100)] + [(1_000 + 10 * k, 1_001 + 10 * k) for k in range(50)]
    where = {r["node"]: r["shard"] for r in fixpoint.shards(spark.createDataFrame(rows, "u bigint, v bigint"), 20).collect()}
    assert all(where[u] == where[v] for u, v in rows[100:])
    sizes = [sum(1 for u, v in rows[:100] if where[u] == s) for s in {where[k] for k in range(101)}]
    assert 4 <= len(sizes) and max(sizes) <= 45 and not {where[k] for k in range(101)} & {where[v] for _, v in rows[100:]}


@pytest.mark.parametrize("shard", [2, 9, 10_000])
def test_bridges_and_their_sides_equal_removal(spark, shard):
    rng = random.Random(4)
    pairs = sorted({tuple(sorted((b + x, b + y))) for b, n in ((0, 14), (100, 7), (200, 3)) for x, y in (rng.sample(range(n), 2) for _ in range(n + 2))})
    links = spark.createDataFrame(pairs, "a bigint, b bigint")
    nodes = sorted({n for p in pairs for n in p})
    comp = network.component_of(network.nodes_of(links), links)

    def side(start, gone):
        seen, todo = {start}, [start]
        while todo:
            n = todo.pop()
            for p in pairs:
                if p != gone and n in p and (m := p[0] + p[1] - n) not in seen:
                    seen.add(m)
                    todo.append(m)
        return seen

    told = {}
    for a, b in pairs:
        near = side(a, (a, b))
        if b not in near:
            told[a, b] = {sum(near), sum(side(b, (a, b)))}
    found = paths.bridge_sums(links, comp.withColumn("value", F.col("node")), ["value"], shard).collect()
    assert {(r["a"], r["b"]) for r in found} == set(told) and all(r["value"] in told[r["a"], r["b"]] and r["all_value"] == sum(told[r["a"], r["b"]]) for r in found)
    assert set(nodes) >= {r["a"] for r in found}


@pytest.mark.parametrize("ring", [[1, 2], [1, 2, 3]])
def test_circles_of_pointers_are_told(spark, ring):
    rows = [(a, b, False, 1) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)] + [(9, 1, False, 1), (20, 21, False, 1), (21, None, True, 1)]
    pointers = spark.createDataFrame(rows, "node bigint, next bigint, marked boolean, v bigint").withColumn("key", F.lit("k"))
    for run in (lambda: fixpoint.jump_to_marked(pointers), lambda: hydrology.accumulation(pointers), lambda: paths.sums_along(pointers, ["v"], ["key"])):
        with pytest.raises(ValueError, match="circle"):
            run()
    fine = pointers.where("node >= 20")
    assert {r["node"]: r["root"] for r in fixpoint.jump_to_marked(fine).collect()} == {20: 21, 21: 21}


def test_components_by_contraction_of_ranges(spark, monkeypatch):
    """Ranges of few edges, a hub that meets them all, links from end to end, and nodes without links; no round of joins is needed."""
    monkeypatch.setattr(fixpoint, "PART_EDGES", 40)
    monkeypatch.setattr(fixpoint, "_by_joins", lambda edges: 1 / 0)
    rng = random.Random(11)
    links = [(k, k + rng.randint(1, 7)) for k in range(0, 2_000) if k % 50 < 40] + [(2_100, 2_101 + k) for k in range(90)] + [(3, 1_990), (1_990, 3), (5, 5)]
    nodes = list(range(2_400))
    low = dict.fromkeys(nodes)
    near = {}
    for u, v in links:
        near.setdefault(u, []).append(v)
        near.setdefault(v, []).append(u)
    for start in nodes:
        stack = [start] if low[start] is None else []
        while stack:
            n = stack.pop()
            if low[n] is None:
                low[n] = start
                stack += near.get(n, [])
    asked = spark.createDataFrame([(n,) for n in nodes], "node bigint")
    found = fixpoint.components(asked, spark.createDataFrame(links, "u bigint, v bigint"), 100)
    assert {r["node"]: r["comp"] for r in found.collect()} == low


@pytest.mark.parametrize("most_sent", [0, 50_000])
def test_nodes_inside_a_range_are_done_with_it(spark, monkeypatch, most_sent):
    """Only nodes that ranges share meet in a shuffle; with more of them than are broadcast all do. Nodes may be asked for twice."""
    monkeypatch.setattr(fixpoint, "PART_EDGES", 100)
    monkeypatch.setattr(fixpoint, "SENT_ROWS", most_sent)
    real, met = fixpoint.checkpointed, []

    def spy(df):
        out = real(df)
        if "others" in df.columns:
            met.append(out.count())
        return out

    monkeypatch.setattr(fixpoint, "checkpointed", spy)
    rng = random.Random(3)
    links = spark.createDataFrame([(k, k + rng.randint(1, 7)) for k in range(3_000) if k % 60 < 50], "u bigint, v bigint")
    asked = spark.createDataFrame([(n,) for n in [*range(0, 3_100, 9), 0, 9, 9, 3_050, None]], "node bigint")
    one = {r["node"]: (r["comp"], r["linked"]) for r in fixpoint.components(asked, links, 100_000, linked=True).collect()}
    many = fixpoint.components(asked, links, 100, linked=True).collect()
    assert {r["node"]: (r["comp"], r["linked"]) for r in many} == one and len(many) == len(one) and one[3_050] == (3_050, False) and one[0][1]
    all_of_them = fixpoint.components(None, links, 100).collect()
    assert {r["node"]: r["comp"] for r in all_of_them} == {r["node"]: r["comp"] for r in fixpoint.components(None, links, 100_000).collect()} and len({r["node"] for r in all_of_them}) == len(all_of_them)
    assert met[0] < 1_000 if most_sent else met[0] > 2_000


@pytest.mark.parametrize("shard", [12, 10_000])
def test_mirrored_edges_given_once_equal_both_directions(spark, shard):
    """Also with a graph that holds all others, several scenarios, parallel edges, and seeds without an edge, which give no row."""
    rng = random.Random(shard)
    once = [(k, k + 1, rng.randint(1, 9)) for k in range(60)] + [(3, 4, 1)] + [(100 + 2 * k, 101 + 2 * k, 4) for k in range(20)]
    rows = [(s, u, v, c) for s in ("x", "y") for u, v, c in once if s == "x" or u not in (10, 20, 104)]
    seeds = [("x", 3, 7), ("x", 50, 5), ("y", 20, 1), ("y", 104, 2), ("y", 105, 3), ("x", 104, 2), ("x", 999, 1)]
    edges = spark.createDataFrame(rows, "scenario string, u bigint, v bigint, cost bigint")
    labels = spark.createDataFrame(seeds, "scenario string, node bigint, target int")
    whole = spark.createDataFrame(once, "u bigint, v bigint, cost bigint").select("u", "v")
    told = {}
    for s in ("x", "y"):
        near = {}
        for _, u, v, c in (r for r in rows if r[0] == s):
            near.setdefault(u, []).append((v, c))
            near.setdefault(v, []).append((u, c))
        told |= least([(s, n, 0, t) for k, n, t in seeds if k == s and n in near], near, False)
    for held in (None, whole):
        found = fixpoint.shortest_paths(labels, edges, ["scenario"], shard, mirrored=True, linked=True, whole=held).collect()
        assert {(r["scenario"], r["node"]): (r["cost"], r["target"]) for r in found} == told and len(found) == len(told)
