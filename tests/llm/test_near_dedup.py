"""Near duplicates beside a brute-force comparison of all pairs."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from accessgeo.llm import alignment, components, near_dedup


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_classes(rows):
    """Least id of each row's class, classes being components over all pairs at or above the similarity."""
    words = [(t or "").lower().split() for _, t in rows]
    up = list(range(len(rows)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            a, b = words[i], words[j]
            if a and b and (a == b or edits(a, b) <= int((1 - near_dedup.SIMILARITY) * max(len(a), len(b)) + 1e-9)):
                up[root(i)] = root(j)
    return {k: min(d for m, (d, _) in enumerate(rows) if root(m) == root(k)) for k in range(len(rows))}


def varied(rng, text, share):
    w = text.split()
    for k in rng.sample(range(len(w)), int(share * len(w))):
        w[k] = rng.choice([w[k] + "x", w[k - 1], "new"])
    return " ".join(w)


def test_classes_equal_brute_force(documents, prose):
    rng = random.Random(4)
    texts = prose(12, 90, 1)
    rows = [(k, t) for k, t in enumerate(texts)]
    for k, t in enumerate(texts[:8]):
        rows += [(100 + 10 * k + j, varied(rng, t, 0.02 * (j + 1))) for j in range(4)]
    rng.shuffle(rows)
    found = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicate_classes(documents(rows)).collect()}
    told = brute_classes(rows)
    assert found == {rows[k][0]: c for k, c in told.items()}


def test_order_of_words_matters(documents, prose):
    (text,) = prose(1, 120, 7)
    w = text.split()
    found = near_dedup.near_duplicate_classes(documents([(1, text), (2, " ".join(w[60:] + w[:60])), (3, " ".join(sorted(w)))])).collect()
    assert {r["doc_id"]: r["class_id"] for r in found} == {1: 1, 2: 2, 3: 3}


def test_nulls_empty_long_and_repeated_rows(documents, prose):
    long = " ".join(prose(1, 30_000, 3))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "word"), (5, "word"), (5, "word"), (6, long), (7, long + " end"), (None, long), (8, "w " * 5_000), (9, "w " * 5_001)]
    found = near_dedup.near_duplicate_classes(documents(rows)).collect()
    assert len(found) == len(rows)
    assert sorted((r["doc_id"] or 0, r["class_id"] or 0) for r in found) == [(0, 6), (1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (5, 4), (6, 6), (7, 6), (8, 8), (9, 8)]


def test_one_of_each_class_stays_with_all_columns(documents, prose):
    a, b = prose(2, 60, 9)
    docs = documents([(3, a), (1, a + " end"), (2, b), (4, None), (5, None)])
    kept = near_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 4, 5]


def test_repeated_rows_leave_one_and_no_other_document_goes(documents, prose):
    a, b, c, d = prose(4, 60, 10)
    docs = documents([(1, a), (1, a), (2, b), (2, c), (None, d), (None, a), (None, "")])
    assert sorted((r["doc_id"] or 0, r["text"]) for r in near_dedup.deduplicate(docs).collect()) == sorted([(1, a), (2, b), (2, c), (0, d), (0, "")])


def test_empty_table(documents):
    assert near_dedup.near_duplicate_classes(documents([])).count() == 0
    assert near_dedup.deduplicate(documents([])).count() == 0


def test_large_group_of_copies_and_near_copies(documents, prose):
    rng = random.Random(5)
    (text,) = prose(1, 80, 11)
    rows = [(k, text if k % 3 else varied(rng, text, 0.03)) for k in range(1, 400)]
    assert {r["class_id"] for r in near_dedup.near_duplicate_classes(documents(rows)).collect()} == {1}


def test_each_pair_of_a_bucket_of_unlike_texts_is_compared(documents, prose, monkeypatch):
    """200 unlike holders of one passage; the copies share keys with their originals in that passage only."""
    monkeypatch.setattr(near_dedup, "BLOCK", 60)
    (passage,) = prose(1, 100, 20)
    own = [[f"w{k}n{j}" for j in range(30)] for k in range(200)]
    rows = [(k, f"{passage} {' '.join(w)}") for k, w in enumerate(own)]
    for k in range(0, 200, 25):
        edited = [f"e{k}n{j}" if j % 5 in (1, 3) else x for j, x in enumerate(own[k])]
        rows.append((1_000 + k, f"{passage} {' '.join(edited)}"))
    found = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicate_classes(documents(rows)).collect()}
    assert found == {k: k % 1_000 for k, _ in rows}


def key_recall(bases, share):
    """Share of texts that have a key in common with a copy of which every 1 / share-th word was replaced."""
    copies = []
    for t in bases:
        w = t.split()
        many = int(share * len(w) + 1e-9)
        for j in range(many):
            w[(2 * j + 1) * len(w) // (2 * many)] = f"edit{j}"
        copies.append(" ".join(w).upper())
    keys, n, _ = near_dedup.sketches(pa.array([*bases, *copies], pa.string()))
    lists = [set(x.tolist()) for x in np.split(keys, np.cumsum(n)[:-1])]
    return sum(bool(a & b) for a, b in zip(lists[: len(bases)], lists[len(bases) :], strict=True)) / len(bases)


@pytest.mark.parametrize("share", [0.1, 0.12, 0.15, 0.2])
def test_similar_texts_share_a_key(prose, share):
    assert all(key_recall(prose(200, words, words), share) >= 0.97 for words in (30, 60, 100, 300))


def test_short_similar_texts_share_a_key(prose):
    assert all(key_recall(prose(200, words, words), 0.2) >= 0.99 for words in range(5, 25))


def test_short_texts_are_classed_as_by_brute_force(documents, prose):
    rows = []
    for words in range(4, 21):
        for k, t in enumerate(prose(2, words, 40 + words)):
            w = t.split()
            edited = w[: words // 2] + ["edit"] + w[words // 2 + 1 :]
            rows += [(1_000 * words + 10 * k + j, x) for j, x in enumerate([t, " ".join(edited), t + " end"])]
    found = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicate_classes(documents(rows)).collect()}
    assert found == {rows[k][0]: c for k, c in brute_classes(rows).items()}


@pytest.mark.parametrize("seed", range(6))
def test_banded_distance_is_exact(seed):
    rng = random.Random(seed)
    for _ in range(60):
        a = [rng.choice("abc") for _ in range(rng.randint(0, 14))]
        b = [rng.choice("abc") for _ in range(rng.randint(0, 14))]
        most = rng.randint(0, 14)
        assert alignment.banded_distance(a, b, most) == min(edits(a, b), most + 1)


def test_components_by_joins_equal_those_of_one_task(spark):
    rng = random.Random(2)
    pairs = [(k, k + 1) for k in range(0, 60)] + [(100 + rng.randint(0, 80), 100 + rng.randint(0, 80)) for _ in range(60)] + [(500, 500 + k) for k in range(1, 200)]
    links = spark.createDataFrame(pairs, "a bigint, b bigint")
    one = {tuple(r) for r in components.components(links).collect()}
    assert one == {tuple(r) for r in components.components(links, local=0).select("node", "component").collect()}
