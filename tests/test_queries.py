"""Each query beside its SQL in DuckDB over the smallest test tables."""

from __future__ import annotations

import math
import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from accessgeo.plans import registry

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are absent")


def plain(value):
    if isinstance(value, (float, Decimal)):
        return "nan" if math.isnan(value) else f"{float(value):.9g}"
    if isinstance(value, (list, tuple)):
        return [plain(x) for x in value]
    return value if value is None or isinstance(value, bool) else str(value)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_its_sql(spark, con, name):
    df = registry.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    found = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    told = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in told.description]
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    assert found == sorted(repr([plain(r[k]) for k in place]) for r in told.fetchall())


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 4


def test_registry_holds_the_library_queries():
    assert set(registry.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
