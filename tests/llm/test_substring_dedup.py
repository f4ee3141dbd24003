"""Repeated passages beside a brute-force pass over all windows."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import re

import pytest

from accessgeo.llm import queries, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window=50):
    least, words = {}, {k: WORD.findall(t or "") for k, (_, t) in enumerate(rows)}
    for k, (doc, _) in enumerate(rows):
        for a in range(len(words[k]) - window + 1):
            key = tuple(words[k][a : a + window])
            if doc is not None and (key not in least or doc < least[key]):
                least[key] = doc
    out = []
    for k, (doc, _) in enumerate(rows):
        gone = set()
        for a in range(len(words[k]) - window + 1):
            if doc is not None and least[tuple(words[k][a : a + window])] < doc:
                gone.update(range(a, a + window))
        left = [w for j, w in enumerate(words[k]) if j not in gone]
        out.append((doc, len(words[k]), len(gone), hashlib.sha256(" ".join(left).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(docs):
    out = substring_dedup.without_repeats(docs)
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["h"]) for r in out.withColumn("h", substring_dedup.digest(out["kept"])).collect()), key=repr)


@pytest.mark.parametrize("most", [500_000, 300])
def test_equals_brute_force(documents, prose, monkeypatch, most):
    """The second case sends anchors of more than 300 words through longer prefixes."""
    monkeypatch.setattr(substring_dedup, "GROUP", most)
    rng = random.Random(3)
    texts, passages = prose(40, 150, 1), prose(5, 75, 2)
    rows = []
    for k, t in enumerate(texts):
        w = t.split()
        for p in passages:
            if rng.random() < 0.4:
                a, q = rng.randint(0, len(w)), p.split()
                cut = rng.randint(0, 20)
                w[a:a] = q[cut : cut + rng.randint(45, 75)]
        rows.append((k, rng.choice([" ", "\n", " \t "]).join(w)))
    rows += [(50, rows[3][1]), (51, rows[3][1]), (51, rows[3][1]), (60, "a b " * 80), (61, "a b " * 60), (62, "same " * 200)]
    assert found(documents(rows)) == brute(rows)


def test_nulls_empty_short_long_and_no_id(documents, prose):
    (long,) = prose(1, 20_000, 4)
    rows = [(1, None), (2, ""), (3, " \n"), (4, " ".join(["w"] * 49)), (5, " ".join(["w"] * 50)), (6, "é ß " * 60), (7, long), (8, "x " + long), (None, long)]
    assert found(documents(rows)) == brute(rows)


@pytest.mark.parametrize("most", [500_000, 5_000])
def test_periodic_texts(documents, monkeypatch, most):
    """All windows of a repeated line have one anchor."""
    monkeypatch.setattr(substring_dedup, "GROUP", most)
    line = "one line that is told again and again "
    rows = [(k, line * (200 + 7 * k) + ("end " * k)) for k in range(12)] + [(20, "other " + line * 30), (21, "a b c " * 300)]
    assert found(documents(rows)) == brute(rows)


def test_empty_table(documents):
    assert substring_dedup.without_repeats(documents([])).count() == 0


def test_query_over_its_whole_table(spark):
    from .conftest import SF_DIR

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    got = queries.op7_substring_dedup(spark, SF_DIR).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got), key=repr) == brute(rows)


@pytest.mark.parametrize("size", [1, 2, 7, 50])
def test_ranks_are_those_of_sorted_suffixes(size):
    codes = np.random.default_rng(size).integers(0, 2, 300)
    runs = [tuple(codes[k : k + size]) for k in range(len(codes) - size + 1)]
    order = {r: k for k, r in enumerate(sorted(set(runs)))}
    assert substring_dedup.window_ranks(codes, size).tolist() == [order[r] for r in runs]
