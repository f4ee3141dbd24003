"""Removal of repeated passages with prefix-partitioned suffix trees.

A passage is repeated where WINDOW consecutive words of a document also begin in a document with a smaller
id. Suffixes are dealt out by prefixes of variable length, so that a task holds small groups only:

1.  Of the ANCHOR-word grams in each window the least by hash is the window's anchor (winnowing), so equal
    windows have equal anchors. Anchors that stand in one document only are dropped: no repeat goes
    through them.
2.  The suffixes that begin in the windows of a repeated anchor form its subtree. A subtree of at most
    GROUP words is built in one task: its suffixes are sorted by their first WINDOW words (ranks of runs of 1, 2, 4, ... words, each from
    the ranks of two shorter ones, so without hashes), those that agree in all of them hang below one internal node of that depth, and a
    node's least document keeps the passage.
3.  An anchor of more words is split by longer prefixes, the whole WINDOW words: such a prefix, named by two hashes of its words beside the
    anchor's (192 bits; they are not compared with the words), is a node itself, and its least document comes from a minimum that is taken before the shuffle.

The anchor may stand anywhere in the window, so groups are not those of a suffix tree's prefixes: dealing each suffix by its own first words would
send every word WINDOW times.

Windows of the documents are judged on the input, not on what is left of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import coded, mix64, plain_text, ragged, slices, word_hashes, word_lists
from .common import bound_batches, materialise, small_side

WINDOW, ANCHOR, GROUP = 50, 25, 500_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> np.ndarray:
    """_BASE ** k for k < n, modulo 2 ** 64."""
    out = np.full(n, _BASE, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def run_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` words from each place of `h`; the same words give the same hash wherever they stand."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    inverse = pow(int(_BASE), -1, 2**64)
    back = np.full(len(h), np.uint64(inverse), np.uint64)
    back[0] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _powers(len(h)), dtype=np.uint64)])
    return mix64((sums[size:] - sums[:-size]) * np.multiply.accumulate(back)[: len(h) - size + 1])


def sliding(x: np.ndarray, size: int, least: bool) -> np.ndarray:
    """Minimum or maximum of x[i : i + size] for each i."""
    f, done = (np.minimum if least else np.maximum), 1
    while done < size:
        step = min(done, size - done)
        x = f(x[:-step], x[step:])
        done += step
    return x


def window_anchors(words: pa.Array, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, starts of all windows, and the anchor of each."""
    codes, distinct = coded(words)
    h = word_hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    n = np.maximum(np.diff(ends) - WINDOW + 1, 0)
    at = np.repeat(ends[:-1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    if not len(at):
        return h, at, np.zeros(0, np.int64)
    return h, at, sliding(run_hashes(h, ANCHOR), WINDOW - ANCHOR + 1, True)[at].view(np.int64)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        words, ends = word_lists(plain_text(batch.column("text")))
        _, at, anchor = window_anchors(words, ends)
        doc = np.searchsorted(ends, at, "right") - 1
        fresh = np.ones(len(at), bool)
        fresh[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(fresh)
        words_of = np.diff(np.append(first, len(at))) + WINDOW - 1
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc[first])), pa.array(anchor[first]), pa.array(words_of)], ["doc_id", "anchor", "n"])


def _suffix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each run of windows with one repeated anchor: its start, number of windows and words; for an anchor of
    many words a row per window with two hashes of the window instead."""
    names = ["doc_id", "anchor", "start", "n", "words", "window", "check"]
    for batch in slices(batches):
        words, ends = word_lists(plain_text(batch.column("text")))
        h, at, anchor = window_anchors(words, ends)
        doc = np.searchsorted(ends, at, "right") - 1
        listed = batch.column("anchors")
        owner = np.repeat(np.arange(batch.num_rows), pc.list_value_length(listed).to_numpy(zero_copy_only=False).astype(np.int64))
        inner = listed.flatten()
        known, many = inner.field("anchor").to_numpy(zero_copy_only=False), inner.field("many").to_numpy(zero_copy_only=False)

        def tag(d: np.ndarray, a: np.ndarray) -> np.ndarray:
            return mix64(a.view(np.uint64) ^ mix64(d.astype(np.uint64)))

        pairs, here = tag(owner, np.ascontiguousarray(known)), tag(doc, anchor)
        hot, cold = np.isin(here, pairs[many]), np.isin(here, pairs[~many])
        change = np.ones(len(at), bool)
        change[1:] = (here[1:] != here[:-1]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(change & cold)
        bound = np.append(np.flatnonzero(change), len(at))
        n = bound[np.searchsorted(bound, first, "right")] - first if len(first) else first
        spread = ragged(np.arange(len(words)), at[first], n + WINDOW - 1) if len(first) else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n + WINDOW - 1)]).astype(np.int32)), words.take(pa.array(spread)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc[first])), pa.array(anchor[first]), pa.array(at[first] - ends[doc[first]]), pa.array(n.astype(np.int64)), pc.binary_join(lists, " "), *[pa.nulls(len(first), pa.int64())] * 2], names)
        one = np.flatnonzero(hot)
        if len(one):
            whole, check = (run_hashes(mix64(h + np.uint64(k)), WINDOW)[at[one]].view(np.int64) for k in (1, 2))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc[one])), pa.array(anchor[one]), pa.array(at[one] - ends[doc[one]]), pa.array(np.ones(len(one), np.int64)), pa.nulls(len(one), pa.string()), pa.array(whole), pa.array(check)], names)


def window_ranks(codes: np.ndarray, size: int) -> np.ndarray:
    """Rank of the `size` words from each place among all such runs, in the order of their codes; equal runs have equal ranks."""
    rank, done = codes, 1
    while done < size:
        step = min(done, size - done)
        rank = np.unique(rank[:-step] * (rank.max() + 1) + rank[step:], return_inverse=True)[1]
        done += step
    return rank


def _repeats(table: pa.Table) -> pa.Table:
    """Windows of whole groups that also begin in a smaller document of their group, as (doc_id, start, n)."""
    words, ends = word_lists(plain_text(table.column("words").combine_chunks()))
    codes, _ = coded(words)
    n = table.column("n").to_numpy()
    row = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    # suffixes of one rank share their first WINDOW words: a node of that depth
    node = window_ranks(codes, WINDOW)[ends[:-1][row] + step] if len(row) else row
    doc = np.unique(table.column("doc_id").to_numpy(), return_inverse=True)[1][row]
    order = np.lexsort((doc, node))
    head = np.ones(len(order), bool)
    head[1:] = node[order][1:] != node[order][:-1]
    begin = np.flatnonzero(head)
    least = np.empty(len(order), np.int64)
    least[order] = np.repeat(doc[order][begin], np.diff(np.append(begin, len(order))))
    gone = np.flatnonzero(doc > least)
    cut = np.ones(len(gone), bool)
    cut[1:] = (np.diff(gone) != 1) | (row[gone][1:] != row[gone][:-1])
    a = np.flatnonzero(cut)
    return pa.table({"doc_id": table.column("doc_id").take(pa.array(row[gone[a]])), "start": table.column("start").to_numpy()[row[gone[a]]] + step[gone[a]], "n": np.diff(np.append(a, len(gone))).astype(np.int64)})


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor; a group that a batch cuts is completed by the next one."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None else table
        last = int(np.searchsorted(table.column("anchor").to_numpy(), table.column("anchor")[-1].as_py(), "left"))
        held = table.slice(last).combine_chunks()
        if last:
            yield from _repeats(table.slice(0, last).combine_chunks()).to_batches()
    if held is not None and held.num_rows:
        yield from _repeats(held).to_batches()


def _kept_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        words, ends = word_lists(plain_text(batch.column("text")))
        listed = pc.fill_null(batch.column("gone"), [])
        owner = np.repeat(np.arange(batch.num_rows), pc.list_value_length(listed).to_numpy(zero_copy_only=False).astype(np.int64))
        inner = listed.flatten()
        start, n = ends[:-1][owner] + inner.field("start").to_numpy(zero_copy_only=False), inner.field("n").to_numpy(zero_copy_only=False)
        depth = np.zeros(len(words) + 1, np.int64)
        np.add.at(depth, start, 1)
        np.add.at(depth, start + n + WINDOW - 1, -1)
        keep = np.cumsum(depth)[:-1] == 0
        before = np.concatenate([[0], np.cumsum(keep)])[ends]
        lists = pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), words.filter(pa.array(keep, pa.bool_())))
        left = pc.binary_join(lists, " ")
        total = np.diff(ends)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total), pa.array(total - np.diff(before)), left], ["doc_id", "n_words", "n_removed", "kept"])


def repeated_windows(docs: DataFrame) -> DataFrame:
    """doc_id, start, n: the windows that begin at words start .. start + n - 1 of the document also begin in
    one with a smaller doc_id."""
    bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    known = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"))
    anchors = materialise(known.mapInArrow(_anchor_rows, f"doc_id {kind}, anchor bigint, n bigint"), "anchors")
    repeated = anchors.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.sum("n").alias("words")).where("lo < hi").select("anchor", (F.col("words") > GROUP).alias("many"))
    lists = materialise(anchors.join(repeated, "anchor").groupBy("doc_id").agg(F.collect_set(F.struct("anchor", "many")).alias("anchors")), "lists")
    # at most two million anchors in 200,000 rows are sent to all tasks; more are joined by a shuffle
    size = lists.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("anchors")), F.lit(0))).first()
    if size[0] <= 200_000 and size[1] <= 2_000_000:
        lists = F.broadcast(lists)
    suffixes = materialise(known.join(lists, "doc_id").mapInArrow(_suffix_rows, f"doc_id {kind}, anchor bigint, start bigint, n bigint, words string, window bigint, check bigint"), "suffixes")
    grouped = suffixes.where("window is null").select("doc_id", "anchor", "start", "n", "words").repartition("anchor").sortWithinPartitions("anchor")
    small = grouped.mapInArrow(_subtrees, f"doc_id {kind}, start bigint, n bigint")
    name = ["anchor", "window", "check"]
    single = suffixes.where("window is not null").select("doc_id", "start", *name)
    nodes = single.groupBy(*name).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select(*name, "lo")
    nodes = small_side(materialise(nodes, "nodes"), 200_000)  # else both sides are dealt anew, and Spark splits a passage of very many documents
    large = single.join(nodes, name).where("doc_id > lo").select("doc_id", "start", F.lit(1).cast("long").alias("n"))
    return small.unionByName(large)


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space) for every row of `docs`.

    Words are `[^\\x20\\x09-\\x0D]+` of the whole text, unchanged; a null text has none. A word goes if a window
    that covers it also begins in a document with a smaller doc_id; repeats inside one document stay, and so do
    rows of one doc_id among themselves. A row with a null doc_id keeps its words and takes none from others. An
    empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    # a document's windows come as runs, and overlapping runs are merged when it is read again
    gone = materialise(repeated_windows(docs).groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("gone")), "gone")
    size = gone.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()
    if size[0] <= 200_000 and size[1] <= 4_000_000:
        gone = F.broadcast(gone)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(gone, "doc_id", "left")
    return rows.mapInArrow(_kept_words, f"doc_id {kind}, n_words bigint, n_removed bigint, kept string")


def digest(kept: F.Column) -> F.Column:
    return F.sha2(kept.cast("binary"), 256)
