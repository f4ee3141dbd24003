"""Runs (maximal periodic stretches) of words, by the runs theorem.

Each run holds a root that is the longest Lyndon word from its place under the order of words or under the reverse
order. The longest Lyndon word from i ends at the next suffix that is smaller than suffix i, that is at the next smaller value of the inverse
suffix array; so each place gives two candidates, and a candidate is a run if the equal stretches before and behind it, found as
minima of LCP arrays (of the texts and of the texts read backwards) by sparse tables, make it long enough.

The documents of a piece are indexed together, each with an end that is smaller than any word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import coded, plain_text, ragged, slices, word_lists
from .common import bound_batches

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def suffix_ranks(codes: np.ndarray, ends: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rank of each suffix among all (a suffix stops at its document's end; documents in order), by prefix doubling of what is still tied.

    `ends` is the end of the document of each place. With `keep`, also the ranks by the first 1, 2, 4, ... words.
    """
    n = len(codes)
    key = ends * np.int64(codes.max() + 1 if n else 1) + codes
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    head = np.empty(n, bool)
    head[:1] = True
    head[1:] = sorted_key[1:] != sorted_key[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    alone = head & np.append(head[1:], True)
    tied, width, levels = order[~alone], 1, []
    while True:
        if keep:
            levels.append(rank.astype(np.int32))
        if not len(tied):
            return rank, levels
        behind = tied + width
        inside = behind < ends[tied]
        key = rank[tied] * np.int64(n + 1)
        key[inside] += rank[behind[inside]] + 1
        by = np.argsort(key, kind="stable")
        key, tied = key[by], tied[by]
        old = rank[tied]
        at = np.arange(len(tied))
        head = np.ones(len(tied), bool)
        head[1:] = key[1:] != key[:-1]
        group = np.ones(len(tied), bool)
        group[1:] = old[1:] != old[:-1]
        rank[tied] = old + np.maximum.accumulate(np.where(head, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        tied = tied[~(head & np.append(head[1:], True))]
        width *= 2


def next_smaller(key: np.ndarray) -> np.ndarray:
    """For each place the next one with a smaller key, or the end. Pointers jump over what is known to be larger."""
    n = len(key)
    after, key = np.arange(1, n + 2), np.append(key, np.iinfo(np.int64).min)
    open_ = np.flatnonzero(key[after[:n]] > key[:n])
    while len(open_):
        after[open_] = after[after[open_]]
        open_ = open_[key[after[open_]] > key[open_]]
    return after[:n]


class Stretches:
    """Lengths of the common stretch of words from two places of one document."""

    def __init__(self, codes: np.ndarray, ends: np.ndarray):
        self.rank, levels = suffix_ranks(codes, ends, keep=True)
        order = np.empty(len(codes), np.int64)
        order[self.rank] = np.arange(len(codes))
        lcp = np.zeros(len(codes), np.int64)
        at = 1 + np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]])  # else 0: other words or documents
        a, b = order[at - 1].copy(), order[at].copy()
        for k in range(len(levels) - 1, -1, -1):
            inside = (a < ends[order[at - 1]]) & (b < ends[order[at]])
            same = np.flatnonzero(inside)
            same = same[levels[k][a[same]] == levels[k][b[same]]]
            a[same] += 1 << k
            b[same] += 1 << k
        lcp[at] = a - order[at - 1]
        self.least = [lcp.astype(np.int32)]

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        low, high = np.minimum(self.rank[i], self.rank[j]) + 1, np.maximum(self.rank[i], self.rank[j]) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        for k in range(len(self.least), int(level.max(initial=0)) + 1):
            last = self.least[-1]
            self.least.append(np.minimum(last[: -(1 << k - 1)], last[1 << k - 1 :]))
        out = np.empty(len(i), np.int64)
        for k in np.unique(level):
            of = level == k
            out[of] = np.minimum(self.least[k][low[of]], self.least[k][high[of] - (1 << k)])
        return out


def _spans(at: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the documents `at` joined, and each place's own start and end in the joined text."""
    n = ends[at] - starts[at]
    past = np.cumsum(n)
    return ragged(np.arange(ends[-1] if len(ends) else 0), starts[at], n), np.repeat(past - n, n), np.repeat(past, n)


def find_runs(codes: np.ndarray, edges: np.ndarray, least: int, exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length, period) of all runs of at least `least` words and `exponent` periods, by document, start and period.

    `edges` are the offsets of the documents in `codes`; `exponent` is 2 or more.
    """
    none = np.zeros(0, np.int64)
    starts, ends = edges[:-1], edges[1:]
    full = np.flatnonzero(ends > starts)
    if not len(full):
        return none, none, none, none
    size = ends - starts
    start, end = np.repeat(starts, size), np.repeat(ends, size)
    rank, _ = suffix_ranks(codes, end)
    owner = np.repeat(np.arange(len(size)), size)
    below = owner * np.int64(len(codes) + 1)  # a later document's suffixes count as smaller, so none is passed
    here = np.arange(len(codes))
    forth = next_smaller(rank - 2 * below)
    back = next_smaller(-rank - 2 * below)
    reverse = back < end  # under the reverse order the end is the largest: such a word holds the end and cannot be repeated
    i, j = np.concatenate([here, here[reverse]]), np.concatenate([forth, back[reverse]])
    p = j - i
    fits = exponent * p <= size[owner[i]]
    i, j, p = i[fits], j[fits], p[fits]
    # (exponent - 1) p words are equal before and behind, so half of them on one side; look at two of those first
    deep = np.where((exponent - 1) * p > 2, 2, 1)
    last = len(codes) - 1

    def equal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        inside = (x >= start[i]) & (y < end[i])
        return inside & (codes[np.clip(x, 0, last)] == codes[np.clip(y, 0, last)])

    likely = (equal(i, j) & ((deep < 2) | equal(i + 1, j + 1))) | (equal(i - 1, j - 1) & ((deep < 2) | equal(i - 2, j - 2)))
    i, j, p = i[likely], j[likely], p[likely]
    if not len(i):
        return none, none, none, none
    at = np.unique(owner[i])
    place, low, high = _spans(at, starts, ends)
    shift = np.zeros(len(size), np.int64)
    shift[at] = np.cumsum(size[at]) - size[at] - starts[at]
    i, j = i + shift[owner[i]], j + shift[owner[j - 1]]
    own = codes[place]
    n = len(own)
    after, before = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    some = j < high[i]
    after[some] = Stretches(own, high)(i[some], j[some])
    some = i > low[i]
    before[some] = Stretches(own[::-1].copy(), (n - low)[::-1].copy())(n - i[some], n - j[some])
    begin, length = i - before, p + before + after
    runs = (length >= exponent * p) & (length >= least)
    begin, length, p = begin[runs], length[runs], p[runs]
    _, once = np.unique(begin * np.int64(n + 1) + p, return_index=True)  # by place, then period
    begin, length, p = begin[once], length[once], p[once]
    doc = at[np.searchsorted(np.cumsum(size[at]), begin, "right")]
    return doc, begin - shift[doc] - starts[doc], length, p


def collapse_runs(docs: DataFrame, least: int = 6, exponent: int = 4) -> DataFrame:
    """(doc_id, n_words, runs, collapsed), one row per row of `docs`.

    runs: start, length and period, in words, of every run of at least `least` words and `exponent` periods, by start, then period.
    collapsed: the words joined by one space, without those that a run holds behind its first period. Words are maximal stretches without the ASCII white space of space and \\t to \\r;
    a null text has none, a text without words gives no runs and an empty collapsed text. A null doc_id stays null; repeated rows
    are treated each by itself. Other columns are ignored. A text of any length is indexed whole.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words, edges = word_lists(plain_text(batch.column("text")))
            codes, _ = coded(words)
            doc, start, length, period = find_runs(codes, edges, least, exponent)
            covered = np.zeros(len(codes) + 1, np.int64)
            np.add.at(covered, edges[doc] + start + period, 1)
            np.add.at(covered, edges[doc] + start + length, -1)
            keep = np.cumsum(covered[:-1]) == 0
            kept = np.concatenate([[0], np.cumsum(keep)])[edges].astype(np.int32)
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept), words.filter(pa.array(keep))), " ")
            found = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], ["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(edges))).astype(np.int32)), found)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(edges)), lists, texts], ["doc_id", "n_words", "runs", "collapsed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_words bigint, runs {RUNS}, collapsed string")
