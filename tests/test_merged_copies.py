"""Copies of one element put together."""

from __future__ import annotations

from accessgeo.operators import elements

TYPES = "type string, id int, ts string, version int, seq int, centre string, shape string"


def test_copies_of_the_newest_version_are_merged(spark):
    rows = [
        ("way", 1, "2024-01-02", 3, 1, "a", None), ("way", 1, "2024-01-02", 3, 2, None, "s"), ("way", 1, "2024-01-02", 3, 3, "b", None),  # equal versions: the later centre, the only shape
        ("way", 1, "2024-01-01", 9, 4, "old", "old"), ("node", 1, None, None, 1, "n", None), ("node", 1, None, None, 1, "n", None), ("node", 2, None, 5, 1, "x", "y"), ("node", 2, "2024-01-01", 1, 0, None, None),
    ]
    found = {(r.type, r.id): tuple(r)[2:] for r in elements.merged_copies(spark.createDataFrame(rows, TYPES), ["centre", "shape"], "seq").collect()}
    assert found == {("way", 1): ("2024-01-02", 3, "b", "s", 3, 4, True), ("node", 1): (None, None, "n", None, 2, 2, False), ("node", 2): ("2024-01-01", 1, None, None, 1, 2, True)}


def test_no_elements(spark):
    assert elements.merged_copies(spark.createDataFrame([], TYPES), ["centre", "shape"], "seq").count() == 0
