"""Small Arrow and numpy helpers used inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def give_back() -> None:
    """Freed memory goes back to the system: workers outlive their tasks, and what an idle one holds is missing beside the next tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about `most` bytes of text, whole rows only: bounds a task's arrays."""
    try:
        for batch in batches:
            if not batch.num_rows:
                continue
            size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            piece = (np.cumsum(size) - size) // most
            edges = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(size)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                yield batch.slice(a, b - a)
    finally:
        give_back()


def plain_text(column: pa.Array) -> pa.Array:
    """Null text counts as empty."""
    return pc.fill_null(column.cast(pa.string()), "")


def word_lists(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words `[^\\x20\\x09-\\x0D]+` of the texts in one array, and the offsets of each text in it."""
    spaced = text
    for c in "\t\n\x0b\x0c\r":
        if pc.any(pc.match_substring(spaced, c)).as_py():
            spaced = pc.replace_substring(spaced, c, " ")
    lists = pc.split_pattern(spaced, " ")
    words, ends = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    ends = ends - ends[0]
    full = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(full)])
    return words.filter(pa.array(full)), before[ends]


def coded(words: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Codes of the words and the distinct words."""
    found = words.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary.to_pylist()


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[starts[0]:starts[0] + lengths[0]], values[starts[1]:...], ... joined."""
    ends = np.cumsum(lengths)
    return values[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; `x` is uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of the words, the same in each process."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
