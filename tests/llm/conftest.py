"""Small tables for the corpus operators."""

from __future__ import annotations

import random

import pytest

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    """rows -> DataFrame of (doc_id, text, source) and columns whose names the operators use themselves."""

    def make(rows):
        rows = [(*r, None)[:3] for r in rows]
        return spark.createDataFrame([(*r, "x", 1, None, 2) for r in rows], "doc_id bigint, text string, source string, lang string, node int, anchor string, n bigint")

    return make


def invented(n: int, words: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    return [" ".join(rng.choice(vocabulary) for _ in range(words)) for _ in range(n)]


@pytest.fixture(scope="session")
def prose():
    return invented
