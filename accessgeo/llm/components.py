"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def least_reachable(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least number reachable from each of n nodes by the links a - b."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(list(batches), pa.schema([("u", pa.int64()), ("v", pa.int64())]))
    u, v = table.column("u").to_numpy(), table.column("v").to_numpy()
    names, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    low = least_reachable(place[: len(u)], place[len(u) :], len(names)) if len(u) else place
    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[low])], ["node", "component"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of u moves to the least of u and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours move to the least of them. Here u > v in every row."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u <> v").unionByName(least.select("u", F.col("m").alias("v")))


#: Links that one task settles; more are settled by joins.
LOCAL_LINKS = 100_000


def components(links: DataFrame, most_rounds: int = 60, local: int = LOCAL_LINKS) -> DataFrame:
    """(node, component) for every node of `links` (columns a, b, bigint): component is its least node.

    At most `local` links, which are counted first, go through one task. Otherwise steps are joins and minima, so a node with very many links is no group of its own in any task.
    Nodes without links are absent; an empty table gives no rows.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialise(edges, "cc")
    if edges.limit(local + 1).count() <= local:
        return materialise(edges.coalesce(1).mapInArrow(_together, "node bigint, component bigint"), "cc")
    before = None
    for _ in range(most_rounds):
        edges = materialise(_small_star(_large_star(edges).where("u <> v")).distinct(), "cc")
        state = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
