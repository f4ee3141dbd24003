"""Scores of a grid by overlapping tiles with a halo around each, blended with Hann weights."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Channels x rows x columns in, rows x columns out.
Scorer = Callable[[np.ndarray], np.ndarray]
FLIPS = [(), (2,), (1,), (1, 2)]


def window(tile: int) -> np.ndarray:
    """Weights of a tile's rows or columns, none of them zero."""
    return np.hanning(tile + 2)[1:-1]


def _places(at: Column, length: int, tile: int, stride: int, halo: int) -> Column:
    """Numbers of the tiles along one axis whose core or halo holds `at`. The last tile may reach over the end."""
    last = -(-max(length - tile, 0) // stride)
    first = F.greatest(F.ceil((at - tile - halo + 1) / stride), F.lit(0))
    return F.sequence(first.cast("int"), F.least(F.floor((at + halo) / stride), F.lit(last)).cast("int"))


def scored_by_tiles(cells: DataFrame, channels: Sequence[str], scorer: Scorer, tile: int = 512, overlap: int = 128, flips: bool = False) -> DataFrame:
    """row, col, value, weight and tiles of every cell (row and col from 0, valid, channels).

    A task scores one tile: its cells and a halo of half the overlap, mirrored at the border of the grid without repeating the border (a
    grid of one row or column repeats it). Cells that are absent or not valid, or have a null or non-finite channel, are 0 for the scorer and
    null in the result. With `flips` a value is the mean over the tile and its three mirror images. So a scorer that looks no farther than the
    halo gives what it would give over the whole grid, and a task's memory depends on the tile alone.
    """
    if tile < 2 or not 0 <= overlap < tile:
        raise ValueError("a tile has 2 cells or more, and an overlap below its size")
    size = cells.agg(F.max("row") + 1, F.max("col") + 1, F.min("row"), F.min("col")).first()
    height, width = int(size[0] or 1), int(size[1] or 1)
    if min(size[2] or 0, size[3] or 0) < 0:
        raise ValueError("rows and columns are counted from 0")
    stride, halo = tile - overlap, max(1, overlap // 2)
    known = F.coalesce("valid", F.lit(False))
    for c in channels:
        known = known & F.coalesce(F.abs(F.col(c).cast("double")) < float("inf"), F.lit(False))
    names = [f"channel{k}" for k in range(len(channels))]
    kept = cells.select("row", "col", known.alias("known"), *[F.when(known, F.col(c).cast("double")).otherwise(0.0).alias(n) for c, n in zip(channels, names, strict=True)])
    dealt = kept.withColumn("ty", F.explode(_places(F.col("row"), height, tile, stride, halo))).withColumn("tx", F.explode(_places(F.col("col"), width, tile, stride, halo)))

    def one(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        y, x = int(key[0]) * stride, int(key[1]) * stride
        top, left, bottom, right = max(0, y - halo), max(0, x - halo), min(height, y + tile + halo), min(width, x + tile + halo)
        rows, cols = group["row"].to_numpy(), group["col"].to_numpy()
        patch = np.zeros((len(names), bottom - top, right - left))
        patch[:, rows - top, cols - left] = group[names].to_numpy().T
        beyond = ((0, 0), (top - y + halo, y + tile + halo - bottom), (left - x + halo, x + tile + halo - right))
        patch = np.pad(patch, beyond, mode="reflect" if min(patch.shape[1:]) > 1 else "edge")
        turned = FLIPS if flips else FLIPS[:1]
        value = sum(np.flip(scorer(np.flip(patch, axes)), [a - 1 for a in axes]) for axes in turned) / len(turned)
        core = (rows >= y) & (rows < y + tile) & (cols >= x) & (cols < x + tile)
        rows, cols = rows[core], cols[core]
        weight = window(tile)[rows - y] * window(tile)[cols - x]
        return pd.DataFrame({"row": rows, "col": cols, "known": group["known"].to_numpy()[core], "weighted": value[rows - y + halo, cols - x + halo] * weight, "weight": weight})

    scored = dealt.groupBy("ty", "tx").applyInPandas(one, "row int, col int, known boolean, weighted double, weight double")
    sums = scored.groupBy("row", "col").agg(F.sum(F.when(F.col("known"), F.col("weighted"))).alias("sum"), F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("tiles"))
    return sums.select("row", "col", (F.col("sum") / F.col("weight")).alias("value"), "weight", "tiles")
