"""Registered operator queries against their DuckDB oracles."""

import duckdb
import pytest

from navspark.llm.oracles import ORACLES
from navspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["op11_importance", "op12_vector_codes"])
def test_oracle(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = duck.execute(ORACLES[name])
    got = QUERIES[name](spark, SF)
    assert got.columns == [d[0] for d in want.description]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)
