"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from accessgeo.plans import access, acquisition, extracts, footprints, grids, impact, oracles, predictions, reporting, shapes, streams, terrain, trust
from accessgeo.plans import queries as first

PARTS = (acquisition, impact, reporting, streams, access, terrain, shapes, footprints, grids, extracts, trust, predictions)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = first.queries()
    for part in PARTS:
        found |= part.QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found = oracles.oracle_sql()
    for part in PARTS:
        found |= part.SQL
    return found
