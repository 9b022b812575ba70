"""Statistics of odd values against the SQL of their query in DuckDB."""

import math

import duckdb

from larkspur.plans.catalog import ORACLES, QUERIES

GROUPS = {
    "zero": [0.0, 2.0, 3.5, 8.0, 1.0],
    "minus zero": [-0.0, 2.0, 3.5, None],
    "negative": [-1.0, 2.0, 3.5, 8.0, 1.0],
    "both": [-1.0, 0.0, 3.5, 8.0, 1.0],
    "zeros": [0.0, 0.0],
    "nulls": [None, None],
    "equal": [4.0, 4.0, 4.0, 4.0, 4.0],
    "plain": [1.0, 2.0, 4.0, None, 9.0],
}


def test_shape_of_zeros_negatives_and_nulls(spark, tmp_path):
    rows = [(kind, v) for kind, values in GROUPS.items() for v in values]
    spark.createDataFrame(rows, "event_type string, value double").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    base = duckdb.connect()
    base.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    plain = lambda r: tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in r)
    got = {r[0]: r[1:] for r in map(plain, QUERIES["value_shape"](spark, str(tmp_path)).collect())}
    assert got == {r[0]: r[1:] for r in map(plain, base.sql(ORACLES["value_shape"]).fetchall())}
    assert got["zero"][2] == got["minus zero"][2] == got["zeros"][2] == 0.0 and got["both"][2] == "nan" and got["nulls"][2] is None
