"""The queries that SQL can express against DuckDB."""

import math

import duckdb
import pytest

from larkspur.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def plain(value):
    return round(value, 4) + 0.0 if isinstance(value, float) and math.isfinite(value) else value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    got = QUERIES[name](spark, DATA)
    base = duckdb.connect()
    for table in ("documents", "embeddings"):
        base.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    said = base.sql(ORACLES[name])
    order = sorted(got.columns)
    assert order == sorted(said.columns)
    kinds = {"BIGINT": "bigint", "BOOLEAN": "boolean", "DOUBLE": "double", "VARCHAR": "string", "INTEGER": "int"}
    assert dict(got.dtypes) == {c: kinds[str(t)] for c, t in zip(said.columns, said.types, strict=True)}
    ours = sorted((tuple(plain(r[c]) for c in order) for r in got.collect()), key=repr)
    theirs = sorted((tuple(plain(v) for v in r) for r in said.select(", ".join(order)).fetchall()), key=repr)
    assert ours == theirs and ours
