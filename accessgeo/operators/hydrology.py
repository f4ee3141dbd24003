"""Filled elevation, routes over flats, flow accumulation and height above the nearest drainage."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accessgeo.operators.fixpoint import SHARD_EDGES, doubled, jump_to_marked, shortest_paths
from accessgeo.operators.raster import EIGHT, cell_number, receivers, shifted
from accessgeo.session import checkpointed, shuffled

#: Cells on a side of a tile.
TILE = 256


def tiled(cells: DataFrame, keep: list[str], tile: int = TILE, halo: int = 1) -> DataFrame:
    """The cells with their tile (tr, tc) and `own`; cells within `halo` of another tile also go there, not as its own."""
    def around(x: str):
        places = F.array(*[F.floor((F.col(x) + d) / tile).cast("int") for d in (-halo, 0, halo)])
        return F.explode(F.array_distinct(places))

    spread = cells.select("row", "col", *keep, around("row").alias("tr")).select("*", around("col").alias("tc"))
    return spread.withColumn("own", (F.col("tr") == F.floor(F.col("row") / tile)) & (F.col("tc") == F.floor(F.col("col") / tile)))


def _flooded(tile: int) -> Callable[..., pa.Table]:
    """A tile with its halo -> its cells with the level to which they fill from the tile's rim, and the heights at which water passes on.

    Water enters over the cells of the rim, each under its own name, and over outlets inside, which have no name. Rows of cells have row; rows
    of passages have u, the name that can pass on, and v, the name it passes to (null: out) at height w.
    """
    side = tile + 2
    steps = [a * side + b for a, b in EIGHT]

    def flood(key: tuple, cells: pa.Table) -> pa.Table:
        r0, c0 = key[0].as_py() * tile - 1, key[1].as_py() * tile - 1
        at = (cells.column("row").to_numpy() - r0) * side + cells.column("col").to_numpy() - c0
        z = np.full(side * side, np.nan)
        z[at] = cells.column("z").to_numpy()
        valid = np.isfinite(z).reshape(side, side)
        own = np.zeros((side, side), bool)
        own[1:-1, 1:-1] = valid[1:-1, 1:-1]
        whole = valid.copy()
        for a, b in EIGHT:
            near = np.zeros((side, side), bool)
            near[1:-1, 1:-1] = valid[1 + a : side - 1 + a, 1 + b : side - 1 + b]
            whole &= near
        outlet = (own & ~whole).ravel()
        rim = np.zeros((side, side), bool)
        rim[1:-1, 1:-1] = own[1:-1, 1:-1]
        rim[2:-2, 2:-2] = False
        rim, inside = rim.ravel(), own.ravel().tolist()
        level, label, heights = z.tolist(), [None] * (side * side), z.tolist()
        heap = []
        for k in np.flatnonzero(rim | outlet).tolist():
            label[k] = k if rim[k] else -1
            heap.append((level[k], k))
        passes = {(k, -1): level[k] for k in np.flatnonzero(rim & outlet).tolist()}
        heapq.heapify(heap)
        while heap:
            high, k = heapq.heappop(heap)
            mine = label[k]
            for s in steps:
                n = k + s
                if not inside[n]:
                    continue
                if label[n] is None:
                    label[n], level[n] = mine, max(high, heights[n])
                    heapq.heappush(heap, (level[n], n))
                elif label[n] != mine:
                    over = max(high, level[n])
                    for way in ((mine, label[n]), (label[n], mine)):
                        if way[0] >= 0 and over < passes.get(way, np.inf):
                            passes[way] = over
        for k in np.flatnonzero(rim).tolist():
            for s in steps:
                if not inside[k + s] and valid.flat[k + s]:
                    passes[k, k + s] = max(heights[k], heights[k + s])

        def name(k: np.ndarray) -> np.ndarray:
            return (k // side + r0) * np.int64(2**32) + k % side + c0

        mine, ways = np.flatnonzero(own.ravel()), np.array(list(passes), np.int64).reshape(-1, 2)
        labels = np.array([label[k] for k in mine.tolist()], np.int64)
        n, m = len(mine), len(ways)
        none = [None] * max(n, m)
        columns = {
            "row": pa.array((mine // side + r0).tolist() + none[:m], pa.int32()), "col": pa.array((mine % side + c0).tolist() + none[:m], pa.int32()),
            "z": pa.array(z[mine].tolist() + none[:m], pa.float64()), "level": pa.array([level[k] for k in mine.tolist()] + none[:m], pa.float64()), "outlet": pa.array(outlet[mine].tolist() + none[:m], pa.bool_()),
            "label": pa.array([x if k >= 0 else None for x, k in zip(name(labels).tolist(), labels.tolist(), strict=True)] + none[:m], pa.int64()),
            "u": pa.array(none[:n] + name(ways[:, 0]).tolist(), pa.int64()), "v": pa.array(none[:n] + [x if k >= 0 else None for x, k in zip(name(ways[:, 1]).tolist(), ways[:, 1].tolist(), strict=True)], pa.int64()),
            "w": pa.array(none[:n] + list(passes.values()), pa.float64()),
        }
        return pa.table(columns)

    return flood


def fill_pits(cells: DataFrame, z: str = "z", tile: int = TILE, shard_edges: int = SHARD_EDGES) -> DataFrame:
    """The lowest surface over `z` from which every cell drains to an outlet: row, col, z, fill, outlet. Levels are those of a priority flood.

    An outlet is a cell with a void (null or absent) among its eight neighbours, so also one on the border of the grid; cells without `z` give
    no row. Each tile is flooded by itself from its rim. What passes between rims, inside tiles and across their borders, is a graph with
    about a 60th of the cells as nodes; the level of a rim cell is the least of the dearest passages to an outlet, and
    the cells behind it are filled to that level at least.
    """
    known = cells.where(F.col(z).isNotNull() & ~F.isnan(F.col(z).cast("double"))).select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col(z).cast("double").alias("z"))
    found = checkpointed(tiled(known, ["z"], tile).groupBy("tr", "tc").applyInArrow(_flooded(tile), "row int, col int, z double, level double, outlet boolean, label bigint, u bigint, v bigint, w double"))
    ways = found.where("u is not null")
    outs = ways.where("v is null").select(F.col("u").alias("node"), F.col("w").alias("cost"), F.lit(0).alias("target"))
    # a cost belongs to a way from the outlet inwards
    passages = ways.where("v is not null").select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("w").alias("cost"))
    levels = shortest_paths(outs, passages, [], shard_edges, highest=True).select(F.col("node").alias("label"), "cost")
    rows = found.where("row is not null")
    behind = rows.where("label is not null").join(levels, "label", "left").select("row", "col", "z", F.greatest("level", "cost").alias("fill"), "outlet")
    return behind.unionByName(rows.where("label is null").select("row", "col", "z", F.col("level").alias("fill"), "outlet"))


def drained(cells: DataFrame, z: str = "z", tile: int = TILE, shard_edges: int = SHARD_EDGES) -> DataFrame:
    """Routes by which every cell of the filled surface reaches an outlet: row, col, z, fill, outlet, to_row, to_col, layer.

    A cell drains to its steepest lower neighbour (layer 0). One without a lower neighbour, if it is no outlet, goes over its flat to the
    nearest cell that has one or is an outlet: its layer is the number of steps over cells of one height, all flats at once, and it drains to the first of its eight
    neighbours with a layer less. Outlets without a lower neighbour drain out: null.
    """
    filled = checkpointed(fill_pits(cells, z, tile, shard_edges))
    down = receivers(filled.select("row", "col", "fill"), "fill")
    state = checkpointed(filled.join(shuffled(down), ["row", "col"]).select("row", "col", "z", "fill", "outlet", "to_row", "to_col", cell_number("row", "col").alias("node"), (F.col("to_row").isNull() & ~F.col("outlet")).alias("flat")))
    around = shifted(state.select("row", "col", "node", "fill", "flat"), EIGHT, ["node", "fill", "flat"]).select("row", "col", "k", F.col("node").alias("near"), F.col("fill").alias("same"), F.col("flat").alias("near_flat"))
    pairs = checkpointed(state.where("flat").select("row", "col", "node", "fill").join(around, ["row", "col"]).where("fill = same").select("node", "near", "near_flat", "k"))
    exits = pairs.where("not near_flat").select(F.col("near").alias("node"), F.lit(0).alias("target")).distinct()
    layers = shortest_paths(exits, pairs.select(F.col("near").alias("u"), F.col("node").alias("v"), F.lit(1).cast("long").alias("cost")), [], shard_edges).select("node", F.col("cost").alias("layer"))
    layers = checkpointed(layers)
    ahead = pairs.join(layers, "node").join(layers.select(F.col("node").alias("near"), F.col("layer").alias("after")), "near").where("after = layer - 1").groupBy("node", "layer").agg(F.min_by("near", "k").alias("near"))
    out = state.join(ahead, "node", "left")
    to_row, to_col = F.floor((F.col("near") + 2**31) / F.lit(2**32)).cast("int"), F.col("near")
    return out.select("row", "col", "z", "fill", "outlet", F.coalesce("to_row", to_row).alias("to_row"), F.coalesce("to_col", (to_col - to_row.cast("long") * 2**32).cast("int")).alias("to_col"), F.coalesce("layer", F.lit(0)).cast("long").alias("layer"))


def accumulation(links: DataFrame) -> DataFrame:
    """(node, cells): how many cells drain through each node of `links` (node, next), itself included.

    Doubles the reach in each round: what arrives from 2 ** k steps away is added to what has arrived. Links in a circle raise ValueError.
    """
    start = links.select("node", F.col("next").alias("to"), F.lit(1).cast("long").alias("cells"))

    def step(now: DataFrame) -> DataFrame:
        arrived = now.where("to is not null").groupBy(F.col("to").alias("node")).agg(F.sum("cells").alias("more"))
        ahead = now.select(F.col("node").alias("to"), F.col("to").alias("to2"))
        return now.join(arrived, "node", "left").join(ahead, "to", "left").select("node", F.col("to2").alias("to"), (F.col("cells") + F.coalesce("more", F.lit(0))).alias("cells"))

    return doubled(start, step, "to is not null").select("node", "cells")


def height_above_drainage(cells: DataFrame, least_cells: int, z: str = "z", filled: bool = False) -> DataFrame:
    """row, col, cells (accumulated), stream and hand (null where no stream is reached) over a surface with receivers.

    With `filled`, water runs over the filled surface (see `drained`), while heights are those of `z`, 0 at least.
    """
    down = (drained(cells, z) if filled else receivers(cells, z)).select("row", "col", cell_number("row", "col").alias("node"), cell_number("to_row", "to_col").alias("next"))
    down = checkpointed(down)
    total = accumulation(down.select("node", "next"))
    marked = down.join(shuffled(total), "node").withColumn("marked", F.col("cells") >= least_cells)
    root = jump_to_marked(marked.select("node", "next", "marked"))
    heights = cells.select(cell_number("row", "col").alias("root"), F.col(z).alias("z0"))
    out = marked.join(shuffled(root), "node").join(shuffled(cells.select("row", "col", F.col(z).alias("z1"))), ["row", "col"]).join(shuffled(heights), "root", "left")
    return out.select("row", "col", "cells", F.col("marked").alias("stream"), F.when(F.col("z0").isNotNull(), F.greatest(F.col("z1") - F.col("z0"), F.lit(0.0))).alias("hand"))
