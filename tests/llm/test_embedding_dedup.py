"""Links between vectors beside the cosine of all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from accessgeo.llm import embedding_dedup as e
from accessgeo.llm import queries


def brute(rows, least=0.9):
    """(n_links, component_id) of each row; rows of one id are separate."""
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v) for _, v in rows]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if g else None for (_, v), g in zip(rows, good, strict=True)]
    up, links = list(range(len(rows))), [0] * len(rows)

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if good[i] and good[j] and len(unit[i]) == len(unit[j]) and (rows[i][1] == rows[j][1] or unit[i] @ unit[j] >= least):
                links[i] += 1
                links[j] += 1
                up[root(i)] = root(j)
    low = {}
    for k, (vec, _) in enumerate(rows):
        low[root(k)] = min(low.get(root(k), vec), vec)
    return sorted((v, links[k], low[root(k)]) for k, (v, _) in enumerate(rows))


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(*r, 3, "x") for r in rows], f"vec_id bigint, embedding array<{kind}>, node int, list string")


def clustered(n, size, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (n // 5, size))
    return [(k, [float(np.float32(x)) for x in centres[k % len(centres)] + rng.normal(0, rng.choice([0.1, 0.3, 0.5]), size)]) for k in range(n)]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_links_equal_brute_force(spark, kind):
    rows = clustered(500, 24, 1)
    rows += [(1_000 + k, rows[3][1]) for k in range(30)] + [(2_000, [2 * x for x in rows[3][1]])]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in e.near_vectors(frame(spark, rows, kind)).collect())
    told = brute(rows)
    assert sum(g == t for g, t in zip(got, told, strict=True)) / len(told) >= 0.99
    assert all(g[1] <= t[1] for g, t in zip(got, told, strict=True))


def test_a_list_that_is_cut_into_blocks_loses_no_link(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.normal(0, 1, 16)
    rows = [(k, [float(np.float32(x)) for x in base + rng.normal(0, 0.25, 16)]) for k in range(400)]

    def found():
        return sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in e.near_vectors(frame(spark, rows)).collect())

    whole = found()
    monkeypatch.setattr(e, "BLOCK", 40)
    monkeypatch.setattr(e, "QUERY_BLOCK", 60)
    assert found() == whole
    told = brute(rows)
    assert sum(g[1] for g in whole) >= 0.95 * sum(t[1] for t in told) and [g[2] for g in whole] == [t[2] for t in told]


def test_no_pair_just_above_the_threshold_is_lost(spark):
    """Without clusters, so that the ends of a link lie in lists far down each other's order."""
    rng = np.random.default_rng(5)
    x, z = rng.normal(0, 1, (2, 1_500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.901 * x + np.sqrt(1 - 0.901**2) * z
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(10_000 + k, v.tolist()) for k, v in enumerate(y)]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in e.near_vectors(frame(spark, rows)).collect())
    assert got == [(k, 1, k % 10_000) for k, _ in rows]


def test_nulls_zeros_odd_lengths_and_repeats(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 0.0]), (8, [1.0, 0.01]), (9, [1.0, 0.0, 0.0]), (10, [1e30, 0.0]), (7, [1.0, 0.0]), (11, [0.0, -1.0]), (12, [-0.0, -1.0])]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in e.near_vectors(frame(spark, rows)).collect())
    assert got == brute(rows)


def test_empty_table(spark):
    assert e.near_vectors(frame(spark, [])).count() == 0


def test_recall_over_the_whole_table(spark):
    from .conftest import SF_DIR

    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in queries.op9_embedding_dedup(spark, SF_DIR).collect())
    told = brute(rows)
    assert len(got) == len(told) and sum(g[1] for g in got) >= 0.9 * sum(t[1] for t in told)
    assert all(g[1] <= t[1] for g, t in zip(got, told, strict=True))


def test_products_with_decoded_codes_err_by_no_more_than_is_stored():
    rng = np.random.default_rng(9)
    x = e.unit_rows([v.tobytes() for v in rng.normal(size=(3_000, 24))], "<f8")
    index = e.fit(x, 20_000)
    home = index.home(x)
    codes, missed = index.encode(x, home)
    decoded = index.decode(codes, home)
    assert np.allclose(np.sqrt(((x - decoded) ** 2).sum(1)), missed)
    exact, single = x[:500] @ x.T, x[:500].astype(np.float32) @ decoded.astype(np.float32).T
    assert (np.abs(exact - single) <= missed + e.ROUNDED).all()
