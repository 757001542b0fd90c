"""Every registered query of the engine gives the same rows in DuckDB, or has a brute-force test of its rows."""

from __future__ import annotations

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(__file__))

import test_whole  # noqa: E402
from rigvane.plans import catalog  # noqa: E402

SF = "/root/testdata/sf0.001"
#: Queries without SQL, and the brute-force test of each one's own rows.
BRUTE = {"e08_components": "test_components_of_whole_masks", "c12_small_components": "test_components_of_whole_masks", "j04_global_ids": "test_ids_of_whole_tables"}


def _norm(v):
    return round(v, 9) + 0.0 if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_same_rows_as_sql(spark, name):
    if name not in catalog.SQL:
        assert hasattr(test_whole, BRUTE[name]), f"{name} has neither SQL nor a brute-force test"
        return
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in os.listdir(SF):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{SF}/{t}'")
    cur = con.execute(catalog.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert sorted((tuple(_norm(r[i]) for i in at) for r in cur.fetchall()), key=repr) == got
