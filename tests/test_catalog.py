"""Each query of the catalog against its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb
import pytest

from larkspur.plans.catalog import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def plain(value):
    return round(value, 4) + 0.0 if isinstance(value, float) and math.isfinite(value) else value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, name):
    got = QUERIES[name](spark, DATA)
    base = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        base.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    said = base.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(said.columns)
    order = sorted(got.columns)
    ours = sorted((tuple(plain(r[c]) for c in order) for r in got.collect()), key=repr)
    theirs = sorted((tuple(plain(v) for v in r) for r in said.select(", ".join(f'"{c}"' for c in order)).fetchall()), key=repr)
    assert ours == theirs and ours
