"""Benchmark decontamination by q-gram counts in diagonal bands and banded alignment.

An item of m characters that stands in a text with at most e edits shares at least m - q + 1 - q * e
q-grams with it (the q-gram lemma), on diagonals at most e apart. Positions of shared q-grams are counted in
bands of 2 (e + 1) diagonals, each overlapping the next by half, so that one band holds all of them.
Bands that reach the bound are aligned with the item. Case and the amount of white space do not count. Items of fewer than Q bytes
have no q-gram: they are looked for exactly, as whole words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .alignment import best_inside, ends_inside
from .arrays import mix64, plain_text, ragged, slices
from .common import bound_batches

Q, BUDGET, BITMAP_BITS, BLOCK_CHARS = 10, 0.08, 22, 4_000_000
#: Shared q-grams that are counted at once.
AT_ONCE = 2_000_000
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def normalised(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 of all texts in lower case with single spaces, each text followed by Q bytes 255; the start
    and end of each text in it; and the code point of its text at which each byte stands."""
    low = pc.utf8_lower(text)
    size = pc.binary_length(low).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = np.frombuffer(b"".join(low.cast(pa.binary()).to_pylist()), np.uint8)
    ends = np.cumsum(size)
    point = np.cumsum((raw & 0xC0) != 0x80) - 1
    full = np.flatnonzero(size)
    white = _WHITE[raw]
    keep = np.ones(len(raw), bool)
    keep[1:] = ~(white[1:] & white[:-1])
    first = (ends - size)[full]
    keep[first] = True
    origin = np.zeros(len(size), np.int64)
    origin[full] = point[first]
    clean = np.where(white, np.uint8(32), raw)
    before = np.concatenate([[0], np.cumsum(keep)])
    starts = before[ends - size] + Q * np.arange(len(size))
    stops = before[ends] + Q * np.arange(len(size))
    out, points = np.full(before[-1] + Q * len(size), 255, np.uint8), np.zeros(before[-1] + Q * len(size), np.int32)
    doc = np.repeat(np.arange(len(size)), size)
    kept = np.flatnonzero(keep)
    to = np.arange(len(kept)) + Q * doc[kept]
    out[to], points[to] = clean[kept], (point[kept] - origin[doc[kept]]).astype(np.int32)
    return out, starts, stops, points


def grams(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the Q bytes from each position."""
    if len(data) < Q:
        return np.zeros(0, np.uint64)
    x = data.astype(np.uint64)
    for k in (1, 2, 4):
        x = x[:-k] | (x[k:] << np.uint64(8 * k))
    n = len(data) - Q + 1
    return mix64(x[:n] * np.uint64(0x9E3779B97F4A7C15) ^ x[Q - 8 : Q - 8 + n])


@dataclass
class Index:
    """Distinct item texts with the ids of each, their edit budgets and bounds, where each q-gram stands in them, and the short
    ones by length: their first eight bytes as one number, sorted, and their places in `texts`."""

    ids: list[list]
    texts: list[bytes]
    budget: np.ndarray
    bound: np.ndarray
    keys: np.ndarray
    first: np.ndarray
    count: np.ndarray
    item: np.ndarray
    at: np.ndarray
    bitmap: np.ndarray
    short: dict[int, tuple[np.ndarray, np.ndarray]]


def packed(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The first `length` bytes, at most eight, from each place as one number."""
    out = np.zeros(len(at), np.uint64)
    for k in range(min(length, 8)):
        out |= data[at + k].astype(np.uint64) << np.uint64(8 * k)
    return out


def build_index(ids: list, texts: list[str]) -> Index:
    """The budget of an item is BUDGET of its bytes, less if its bound would fall below 1. Items that are equal but for case and
    white space are one; empty ones match nothing."""
    data, starts, stops, _ = normalised(pa.array(texts, pa.string()))
    named: dict[bytes, list] = {}
    for k, (a, b) in enumerate(zip(starts, stops, strict=True)):
        named.setdefault(data[a:b].tobytes().strip(b" "), []).append(ids[k])
    named.pop(b"", None)
    ordered = sorted(named, key=lambda t: (len(t) < Q, t))
    data, starts, stops, _ = normalised(pa.array([t.decode() for t in ordered], pa.string()))
    keep = np.flatnonzero(stops - starts >= Q)
    short = {}
    for n in sorted({len(t) for t in ordered if len(t) < Q}):
        which = np.array([k for k, t in enumerate(ordered) if len(t) == n])
        values = packed(data, starts[which], n)
        order = np.argsort(values, kind="stable")
        short[n] = (values[order], which[order])
    length = (stops - starts)[keep]
    budget = np.minimum(np.floor(BUDGET * length), np.maximum((length - Q) // Q, 0)).astype(np.int64)
    n = length - Q + 1
    item = np.repeat(np.arange(len(keep)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    g = grams(data)[np.repeat(starts[keep], n) + at] if len(item) else np.zeros(0, np.uint64)
    order = np.argsort(g, kind="stable")
    keys, first, count = np.unique(g[order], return_index=True, return_counts=True)
    bitmap = np.zeros(1 << BITMAP_BITS, bool)
    bitmap[keys >> np.uint64(64 - BITMAP_BITS)] = True
    return Index([sorted(set(named[t]), key=lambda x: (x is not None, x)) for t in ordered], ordered, budget, np.maximum(n - Q * budget, 1), keys, first, count, item[order], at[order], bitmap, short)


#: Scripts that are written without spaces, as ranges of code points.
UNSPACED = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x312F), (0x31A0, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)]
_WORDLIKE = np.array([chr(k).isalnum() and k < 128 for k in range(256)])


def _joins(c: str) -> bool:
    """Whether a letter or digit beside `c` would belong to its word."""
    return c.isalnum() and not any(a <= ord(c) <= b for a, b in UNSPACED)


def _character(data: np.ndarray, at: int, step: int) -> str:
    """The character of which the byte at `at` is the first (step 1) or the last (step -1), '' between texts."""
    end = at
    if step > 0:
        while end + 1 < len(data) and data[end + 1] & 0xC0 == 0x80:
            end += 1
    else:
        while at > 0 and data[at] & 0xC0 == 0x80:
            at -= 1
    return data[at : end + 1].tobytes().decode() if 0 <= at < len(data) and data[at] != 255 else ""


def _is_whole(data: np.ndarray, at: int, item: bytes) -> bool:
    """Whether no letter or digit beside the place goes on with the item's first or last word."""
    text, end = item.decode(), at + len(item)
    before = _character(data, at - 1, -1) if at else ""
    after = _character(data, end, 1) if end < len(data) else ""
    return not (_joins(text[0]) and before and _joins(before)) and not (_joins(text[-1]) and after and _joins(after))


def _short_places(data: np.ndarray, index: Index) -> Iterator[tuple[int, int]]:
    """(item, start) of each place where a short item stands as whole words."""
    begin = np.flatnonzero(((data & 0xC0) != 0x80) & (data != 255) & (data != 32)) if index.short else np.zeros(0, np.int64)
    word = np.concatenate([[False], _WORDLIKE[data], np.zeros(Q, bool)])  # the byte before each place
    for n, (values, which) in index.short.items():
        at = begin[begin + n <= len(data)]
        at = at[~(word[at] & word[at + 1]) & ~(word[at + n] & word[at + n + 1])]
        found = packed(data, at, n)
        lo, hi = np.searchsorted(values, found, "left"), np.searchsorted(values, found, "right")
        for place, a, b in zip(at[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
            for k in which[a:b].tolist():
                if data[place : place + n].tobytes() == index.texts[k] and _is_whole(data, place, index.texts[k]):
                    yield k, place


def _band_counts(at: np.ndarray, place: np.ndarray, index: Index, span: int, low: int) -> tuple[np.ndarray, np.ndarray]:
    """Item and band as one number, and how many places of the text share a q-gram there: one that stands twice in an item counts once."""
    kinds, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in _pieces(index.count[place]):
        n = index.count[place[a:b]]
        item, inside = ragged(index.item, index.first[place[a:b]], n), ragged(index.at, index.first[place[a:b]], n)
        where = np.repeat(at[a:b], n)
        band = (where - inside) // (index.budget[item] + 1)
        # places in an item ascend, so the bands of one place of the text and one item descend, equal ones side by side
        fresh = np.ones(len(band), bool)
        fresh[1:] = (band[1:] != band[:-1]) | (item[1:] != item[:-1]) | (where[1:] != where[:-1])
        item, band, where = item[fresh], band[fresh], where[fresh]
        again = np.zeros(len(band), bool)
        again[:-1] = (band[1:] == band[:-1] - 1) & (item[1:] == item[:-1]) & (where[1:] == where[:-1])
        key = item * (2 * span) + (band - low)
        some, many = np.unique(np.concatenate([key, key[~again] - 1]), return_counts=True)
        kinds.append(some)
        counts.append(many)
    kinds, inverse = np.unique(np.concatenate(kinds), return_inverse=True)
    return kinds, np.bincount(inverse, np.concatenate(counts), len(kinds)).astype(np.int64)


def _pieces(n: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows whose numbers sum to about AT_ONCE."""
    piece = (np.cumsum(n) - n) // AT_ONCE
    edges = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(n)]
    return zip(edges[:-1], edges[1:], strict=True)


def _regions(kinds: np.ndarray, span: int, low: int) -> Iterator[tuple[int, int, int]]:
    """(item, first band, last band) of runs of neighbouring bands, so that each region is aligned once."""
    edges = [0, *(np.flatnonzero(np.diff(kinds) > 1) + 1).tolist(), len(kinds)] if len(kinds) else [0]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(kinds[a]) // (2 * span), int(kinds[a]) % (2 * span) + low, int(kinds[b - 1]) % (2 * span) + low


def find(text: pa.Array, index: Index) -> list[tuple[int, int, int, int, int]]:
    """(text, item, start, end, edits) of each place, start and end in code points of the text."""
    if not index.texts or not len(text):
        return []
    data, starts, stops, points = normalised(text)
    short = [(int(np.searchsorted(stops, at, "right")), k, int(points[at]), int(points[at + len(index.texts[k]) - 1]) + 1, 0) for k, at in _short_places(data, index)]
    if not len(index.keys):
        return short
    g = grams(data)
    at = np.flatnonzero(index.bitmap[g >> np.uint64(64 - BITMAP_BITS)])
    place = np.minimum(np.searchsorted(index.keys, g[at]), len(index.keys) - 1)
    same = index.keys[place] == g[at]
    at, place = at[same], place[same]
    span = len(data) + 2
    low = -(len(data) + 2)
    kinds, counts = _band_counts(at, place, index, span, low)
    enough = counts >= index.bound[kinds // (2 * span)]
    out: dict[tuple[int, int, int], tuple[int, int]] = {}
    for k, b, c in _regions(kinds[enough], span, low):
        e, m = int(index.budget[k]), len(index.texts[k])
        begin, stop = b * (e + 1) - e, (c + 2) * (e + 1) + m + e
        for d in range(max(int(np.searchsorted(stops, begin, "right")), 0), len(starts)):
            if starts[d] >= stop:
                break
            lo, hi = max(begin, int(starts[d])), min(stop, int(stops[d]))
            if hi - lo < m - e:
                continue
            part = data[lo:hi].tobytes()
            for edits, end in ends_inside(index.texts[k], part, e):
                back = best_inside(index.texts[k][::-1], part[max(end - m - e, 0) : end][::-1])[1]
                span_key = (d, k, lo + end)
                out[span_key] = min(out.get(span_key, (edits + 1, 0)), (edits, lo + end - back))
    best: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for (d, k, end), (edits, begin) in sorted(out.items()):
        runs = best.setdefault((d, k), [])
        if runs and begin < runs[-1][1]:
            if edits < runs[-1][2]:
                runs[-1] = (begin, end, edits)
        else:
            runs.append((begin, end, edits))
    return short + [(d, k, int(points[a]), int(points[b - 1]) + 1, e) for (d, k), runs in best.items() for a, b, e in runs]


def _blocks(items: DataFrame) -> Iterator[Index]:
    """Indexes over about BLOCK_CHARS characters of items each: what is sent to the tasks at once is bounded."""
    items = items.where(F.col("text").isNotNull()).select("item_id", "text").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_CHARS))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        yield build_index([r["item_id"] for r in rows], [r["text"] for r in rows])


def contaminated_places(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, start, end, edits: each place where an item stands in a text within its budget.

    All texts are searched whole; null texts hold nothing. Null and empty items match nothing, items of fewer than Q
    bytes only as whole words without edits. All distinct texts of one item_id count. Repeated rows give repeated
    places. Empty tables give no rows. No shuffle of the documents.
    """
    bound_batches(docs.sparkSession)
    spark, kind, item_kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    out = None
    for index in _blocks(items):
        sent = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, most=2_000_000):
                found = [(d, i, *rest) for d, k, *rest in find(plain_text(batch.column("text")), sent.value) for i in sent.value.ids[k]]
                rows = pa.array([d for d, *_ in found], pa.int64())
                named = pa.array([i for _, i, *_ in found])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), named.cast(pa.string()) if item_kind == "string" else named.cast(pa.int64()), *[pa.array([f[j] for f in found], pa.int64()) for j in (2, 3, 4)]], ["doc_id", "item_id", "start", "end", "edits"])

        part = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, item_id {'string' if item_kind == 'string' else 'bigint'}, start bigint, end bigint, edits bigint")
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, in which no item stands (see contaminated_places)."""
    bound_batches(docs.sparkSession)
    for index in _blocks(items):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, most=2_000_000):
                clean = np.ones(batch.num_rows, bool)
                clean[[d for d, *_ in find(plain_text(batch.column("text")), sent.value)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
