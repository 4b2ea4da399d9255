"""The driver contract on the smallest tables: entry runs, and every query agrees with its SQL."""

from __future__ import annotations

import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as contract  # noqa: E402
from pageloom.plans import catalog  # noqa: E402

SF_DIR = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"

pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return round(value, 9)
    return value


def _table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["site", "total_pages", "avg_seo_score", "issue_rank", "issue", "issue_pages"]
    assert df.count() > 0


def test_every_query_has_sql():
    # The queries for training data have their own tests, beside their operators.
    assert set(catalog.QUERIES) <= set(contract.queries())
    assert set(catalog.QUERIES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = contract.queries()[name](spark, str(SF_DIR))
    got = _table(df.columns, df.collect())
    result = duck.execute(contract.oracle_sql()[name])
    want = _table([c[0] for c in result.description], result.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]
    assert got[1], "an empty result proves nothing"
