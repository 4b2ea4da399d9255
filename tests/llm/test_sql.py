"""Operators that SQL expresses agree with DuckDB on the smallest tables."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import pytest
from helpers import HERE, SF, rows

from pageloom.llm.oracle import SQL
from pageloom.llm.queries import QUERIES

pytestmark = pytest.mark.skipif(not HERE, reason="driver tables are not here")


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in Path(SF).glob("*.parquet"):
        con.execute(f"create view {file.stem} as select * from '{file}'")
    got = QUERIES[name](spark, SF)
    result = con.execute(SQL[name])
    names = [c[0] for c in result.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    assert sorted(got.columns) == sorted(names)
    assert rows(got) == Counter(tuple(r[i] for i in order) for r in result.fetchall())
