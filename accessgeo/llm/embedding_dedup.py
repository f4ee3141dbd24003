"""Near-duplicate embeddings by product quantisation.

Vectors on the unit sphere lie in coarse inverted lists; the residual to the list's centroid is stored as
one code per subspace, with the length of what the codes miss. A vector looks into each list that is likely to hold one as near
as the threshold asks (see SPREAD); neighbouring lists form groups, and a vector is sent once to each group it looks into. Its inner product with each decoded code errs by no more than the stored length, and what
that bound leaves is ranked by the exact cosine. Lists and codebooks are fitted on a bounded sample;
every vector is indexed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_side
from .components import components, least_reachable

THRESHOLD, SUBSPACES, CODES = 0.9, 8, 128
#: How far a near vector may lie towards another list, in standard deviations of one component of a random step as long as the threshold
#: allows. In few dimensions that is more than the step itself, and no list that can hold a near vector is left out.
SPREAD = 4.5
#: Vectors the index is fitted on at most, and the most lists; rows of a block of a group of lists, and of vectors that look into it;
#: inner products that are held at once.
FIT_ROWS, MOST_LISTS, BLOCK, QUERY_BLOCK, AT_ONCE = 16_384, 4_096, 12_000, 32_000, 2_000_000
#: More than single precision errs in the inner product of two vectors of about unit length.
ROUNDED = 1e-3


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centres, 1)[:, 0]
        n = np.bincount(near, minlength=len(centres))
        for d in range(x.shape[1]):
            centres[:, d] = np.where(n > 0, np.bincount(near, x[:, d], len(centres)) / np.maximum(n, 1), centres[:, d])
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    """The k nearest centres of each row, nearest first."""
    out = []
    for a in range(0, len(x), 4096):
        d = (centres * centres).sum(1) - 2 * x[a : a + 4096] @ centres.T
        if k == 1:
            out.append(d.argmin(1)[:, None])
            continue
        part = np.argpartition(d, k - 1, axis=1)[:, :k] if k < len(centres) else np.tile(np.arange(len(centres)), (len(d), 1))
        out.append(np.take_along_axis(part, np.argsort(np.take_along_axis(d, part, 1), axis=1, kind="stable"), 1))
    return np.concatenate(out) if out else np.zeros((0, k), np.int64)


@dataclass
class Index:
    lists: np.ndarray
    books: list[np.ndarray]
    edges: list[int]
    group: np.ndarray
    reach: float = 0.0

    def home(self, x: np.ndarray) -> np.ndarray:
        return nearest(x, self.lists, 1)[:, 0]

    def looks(self, x: np.ndarray, home: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Whether the rows of x look into the lists `which`. What lies nearer to list l than to the row's list h is beyond the plane
        between them, which is (d(x, l)^2 - d(x, h)^2) / (2 d(l, h)) away."""
        size = (self.lists * self.lists).sum(1)
        own, inverse = np.unique(home, return_inverse=True)
        apart = np.sqrt(np.maximum(size[own][:, None] + size[which] - 2 * self.lists[own] @ self.lists[which].T, 0))[inverse]
        near = size[which] - 2 * x @ self.lists[which].T - (size[home] - 2 * np.einsum("ij,ij->i", x, self.lists[home]))[:, None]
        return (near <= 2 * apart * self.reach + 1e-9) | (which == home[:, None])

    def encode(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One code per subspace of the residuals, and the length of what they miss."""
        left = x - self.lists[home]
        codes = np.zeros((len(x), len(self.books)), np.uint8)
        for m, book in enumerate(self.books):
            a, b = self.edges[m], self.edges[m + 1]
            codes[:, m] = nearest(left[:, a:b], book, 1)[:, 0]
            left[:, a:b] -= book[codes[:, m]]
        return codes, np.sqrt((left * left).sum(1))

    def decode(self, codes: np.ndarray, home: np.ndarray) -> np.ndarray:
        """What the codes hold: the list's centroid and one codeword per subspace."""
        return self.lists[home] + np.concatenate([book[codes[:, m]] for m, book in enumerate(self.books)], axis=1)


def fit(sample: np.ndarray, vectors: int) -> Index:
    """About the square root of `vectors` lists, and CODES codewords for each of SUBSPACES subspaces."""
    k = int(min(MOST_LISTS, max(1, 2 ** round(math.log2(max(math.sqrt(vectors), 1)))), len(sample)))
    lists = kmeans(sample, k, 8, 3)
    left = sample - lists[nearest(sample, lists, 1)[:, 0]]
    edges = np.linspace(0, sample.shape[1], min(SUBSPACES, sample.shape[1]) + 1).astype(int).tolist()
    books = [kmeans(left[:, a:b], CODES, 6, 5 + m) for m, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))]
    near = kmeans(lists, max(1, math.ceil(vectors / BLOCK)), 8, 4)
    return Index(lists, books, edges, nearest(lists, near, 1)[:, 0])


def unit_rows(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(float)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _index_rows(sent, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit_rows(batch.column("vector").to_pylist(), kind)
            home = index.home(x)
            codes, missed = index.encode(x, home)
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("copies"), pa.array(home.astype(np.int32)), pa.array(index.group[home].astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(missed), batch.column("vector")], ["node", "copies", "home", "group", "codes", "missed", "vector"])
    return run


def _look_rows(sent, kind: str):
    """A row for each vector and group that it looks into."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = sent.value
        order = np.argsort(index.group, kind="stable")
        begin = np.flatnonzero(np.diff(index.group[order], prepend=-1))
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                looks = index.looks(unit_rows(part.column("vector").to_pylist(), kind), part.column("home").to_numpy(), order)
                row, group = np.nonzero(np.logical_or.reduceat(looks, begin, axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(index.group[order][begin][group].astype(np.int32)), *[part.column(c).take(pa.array(row)) for c in ("node", "home", "vector")]], ["group", "node", "home", "vector"])
    return run


def _match(sent, kind: str, threshold: float):
    """One block of a group's vectors against one block of those that look into the group, list by list."""
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("reach", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        index: Index = sent.value
        inside, asking = table.filter(pc.invert(table.column("query"))), table.filter(table.column("query"))
        if not inside.num_rows or not asking.num_rows:
            return schema.empty_table()
        x, y = unit_rows(inside.column("vector").to_pylist(), kind), unit_rows(asking.column("vector").to_pylist(), kind)
        codes, missed = np.frombuffer(b"".join(inside.column("codes").to_pylist()), np.uint8).reshape(len(x), -1), inside.column("missed").to_numpy()
        nodes_in, nodes_q = inside.column("node").to_numpy(), asking.column("node").to_numpy()
        home_in, home_q = inside.column("home").to_numpy(), asking.column("home").to_numpy()
        # products with the decoded codes in single precision, ROUNDED more than which no product errs
        decoded, asked = index.decode(codes, home_in).astype(np.float32), y.astype(np.float32)
        lists = np.unique(home_in)
        looks = index.looks(y, home_q, lists)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for k, home in enumerate(lists.tolist()):
            d, asks = np.flatnonzero(home_in == home), np.flatnonzero(looks[:, k])
            step, least = max(1, AT_ONCE // len(d)), (threshold - ROUNDED - missed[d]).astype(np.float32)
            for at in range(0, len(asks), step):
                q = asks[at : at + step]
                i, j = np.nonzero(asked[q] @ decoded[d].T >= least)
                i, j = q[i], d[j]
                for a in range(0, len(i), AT_ONCE // 16):
                    u, v = i[a : a + AT_ONCE // 16], j[a : a + AT_ONCE // 16]
                    keep = (nodes_q[u] != nodes_in[v]) & (np.einsum("ij,ij->i", y[u], x[v]) >= threshold)
                    found.append((u[keep], v[keep]))
        q, d = (np.concatenate(f) for f in zip(*found, strict=True))
        # a link counts if each end looks into the other's list, so that both ends count it, each in the other's block
        kept = np.zeros(len(q), bool)
        for home in np.unique(home_q[q]).tolist():
            at = np.flatnonzero(home_q[q] == home)
            kept[at] = index.looks(x, home_in, np.array([home]))[d[at], 0]
        q, d = q[kept], d[kept]
        if not len(q):
            return schema.empty_table()
        of_q = np.bincount(q, inside.column("copies").to_numpy()[d], len(y)).astype(np.int64)
        names, place = np.unique(np.concatenate([nodes_q, nodes_in]), return_inverse=True)
        low = names[least_reachable(place[q], place[len(y) + d], len(names))]
        use_q, use_d = np.unique(q), np.unique(d)
        return pa.table([np.concatenate([nodes_q[use_q], nodes_in[use_d]]), np.concatenate([of_q[use_q], np.zeros(len(use_d), np.int64)]), np.concatenate([low[place[use_q]], low[place[len(y) + use_d]]])], schema=schema)
    return run


def _links(vectors: DataFrame, kind: str, threshold: float, length: int) -> DataFrame:
    """(node, n, reach) for distinct vectors of one length; `reach` spans what blocks have found."""
    spark = vectors.sparkSession
    total = vectors.count()
    drawn = vectors.orderBy(F.xxhash64("node", F.lit(7)), "node").limit(FIT_ROWS).select("vector").toPandas()["vector"].tolist()
    index = fit(unit_rows(drawn, kind), total)
    index.reach = (math.sqrt(max(2 - 2 * threshold, 0)) + 1e-6) * min(1.0, SPREAD / math.sqrt(length))
    sent = spark.sparkContext.broadcast(index)
    inside = materialise(vectors.mapInArrow(_index_rows(sent, kind), "node bigint, copies bigint, home int, group int, codes binary, missed double, vector binary"), "indexed")
    looks = inside.select("node", "home", "vector").mapInArrow(_look_rows(sent, kind), "group int, node bigint, home int, vector binary")
    sizes = inside.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    asked = looks.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("turns"))
    plan = small_side(materialise(sizes.join(asked, "group"), "groups"), MOST_LISTS)
    # a block of a group meets each block of the vectors that look into it; neither grows with the group
    here = inside.join(plan, "group").select(F.lit(False).alias("query"), "group", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns").cast("long") - 1)).alias("turn"), "node", "home", "copies", "codes", "missed", "vector")
    none = [F.lit(None).cast("bigint").alias("copies"), F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("missed")]
    there = looks.join(plan, "group").select(F.lit(True).alias("query"), "group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("block"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("turns")).alias("turn"), "node", "home", *none, "vector")
    return here.unionByName(there).groupBy("group", "block", "turn").applyInArrow(_match(sent, kind, threshold), "node bigint, n bigint, reach bigint")


def near_vectors(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id for every row of (vec_id, embedding).

    Two rows link if their cosine, in double precision, is `threshold` or more; equal vectors always do. Vectors
    that are null, empty, zero or hold null or non-finite components link with nothing and are their own
    component; vectors of different lengths do not link. component_id is the least vec_id reachable. Rows of one vec_id are
    separate rows. An empty table gives no rows. The work of a task is bounded by BLOCK * QUERY_BLOCK pairs;
    what it returns by the number of its vectors, however many of them link.
    """
    double = rows.schema["embedding"].dataType.elementType.simpleString() == "double"
    kind, width = ("<f8", 8) if double else ("<f4", 4)
    e = F.col("embedding")
    sound = e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    kept = materialise(rows.select("vec_id", F.when(sound, e).alias("embedding")).withColumn("node", F.when(F.col("embedding").isNotNull(), F.xxhash64(F.transform("embedding", lambda x: x + F.lit(0).cast("double" if double else "float"))))), "vectors")
    nodes = materialise(kept.where("node is not null").groupBy("node").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding")), "nodes")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column("embedding")
            raw, ends = listed.flatten().to_numpy(zero_copy_only=False).astype(kind).tobytes(), np.concatenate([[0], np.cumsum(listed.value_lengths().to_numpy(zero_copy_only=False))]) * width
            cut = [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("copies"), pa.array(cut, pa.binary())], ["node", "copies", "vector"])

    found = None
    for (length,) in nodes.select(F.size("embedding")).distinct().collect():
        part = materialise(nodes.where(F.size("embedding") == length).select("node", "copies", "embedding").mapInArrow(packed, "node bigint, copies bigint, vector binary"), "packed")
        links = _links(part, kind, threshold, length)
        found = links if found is None else found.unionByName(links)
    if found is None:
        return kept.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    found = materialise(found, "found")
    placed = components(found.select(F.col("node").alias("a"), F.col("reach").alias("b")))
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    named = nodes.select("node", "rep", "copies").join(placed, "node", "left").join(counts, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    info = named.join(least, "component").select("node", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    return kept.select("vec_id", "node").join(info, "node", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
