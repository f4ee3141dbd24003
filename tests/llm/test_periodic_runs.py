"""Runs beside a search of all periods at all places."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from accessgeo.llm import periodic_runs, queries

from .conftest import SF_DIR


def brute_runs(words, least=6, exponent=4):
    n, out = len(words), []
    for p in range(1, n // exponent + 1):
        start = None
        for k in range(n - p + 1):
            same = k < n - p and words[k] == words[k + p]
            if same and start is None:
                start = k
            elif not same and start is not None:
                length = k - start + p
                if length >= max(least, exponent * p) and not any(all(words[x] == words[x + q] for x in range(start, start + length - q)) for q in range(1, p)):
                    out.append((start, length, p))
                start = None
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    return " ".join(w for k, w in enumerate(words) if not any(s + p <= k < s + n for s, n, p in runs))


@pytest.mark.parametrize("least,exponent", [(6, 4), (2, 2), (1, 3)])
def test_runs_of_short_words_equal_the_search(least, exponent):
    rng = random.Random(least)
    for _ in range(300):
        docs = []
        for _ in range(rng.randint(0, 4)):
            n, letters = rng.choice([0, 1, 2, 7, 20, 50]), rng.choice([1, 2, 2, 3, 6])
            doc = [rng.randrange(letters) for _ in range(n)]
            cut, p = rng.randrange(n + 1), rng.randint(1, 6)
            docs.append(doc if rng.random() < 0.5 else [x if k < cut else doc[min(n - 1, cut + (k - cut) % p)] for k, x in enumerate(doc)])
        codes, edges = np.array([x for d in docs for x in d], np.int64), np.cumsum([0, *map(len, docs)]).astype(np.int64)
        found = list(zip(*[x.tolist() for x in periodic_runs.find_runs(codes, edges, least, exponent)], strict=True))
        assert found == [(k, *r) for k, d in enumerate(docs) for r in brute_runs(d, least, exponent)]


def test_nulls_repeated_rows_long_texts_and_white_space(spark, documents):
    line = "one two three four five six seven"
    texts = ["", None, "   \t\n", "a", "a a a a a", "a a a a a a", "é é é é é é é é é é é é x", f"\n{line}\x0b" * 5, (line + " ") * 30_000, "a b " * 20 + "c " * 9]
    out = {}
    for r in periodic_runs.collapse_runs(documents([(k, t) for k, t in enumerate(texts)] + [(None, "z " * 8), (9, texts[9])])).collect():
        out.setdefault(r["doc_id"], []).append((r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]))
    assert len(out[9]) == 2 and out[9][0] == out[9][1] and out[None] == [(8, [(0, 8, 1)], "z")]
    assert out[8] == [(210_000, [(0, 210_000, 7)], line)]
    for k in (*range(8), 9):
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[k] or "")
        runs = brute_runs(words)
        assert out[k][0] == (len(words), runs, collapsed(words, runs))
    assert periodic_runs.collapse_runs(documents([])).count() == 0


def test_query_equals_the_search_on_planted_texts(spark):
    told = {}
    for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        n, h = len(words), zlib.crc32(str(r["doc_id"]).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        if n > 1_500:  # the plain search is quadratic
            continue
        runs = brute_runs(words)
        top = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        digest = [hashlib.sha256(t.encode()).hexdigest() for t in ("".join(f"{s},{m},{q}\n" for s, m, q in runs), collapsed(words, runs))]
        told[r["doc_id"]] = (len(runs), *top, 1000 * top[1] // top[2] if runs else None, *digest)
    got = {r[0]: tuple(r)[1:] for r in queries.op12_periodic_runs(spark, SF_DIR).collect()}
    assert any(t[0] for t in told.values()) and {d: got[d] for d in told} == told
