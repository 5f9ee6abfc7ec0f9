"""Every registered catalog query against its DuckDB oracle, and the streaming rollup against the batch one."""

import duckdb
import pytest
from pyspark.sql import functions as F

from navspark import queries as Q
from navspark import views as V
from navspark.operators.learn import EventLog, pick_counts
from navspark.store import CatalogStore
from navspark.streaming.rollup import rollup_stream

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in ("part", "events", "documents", "pages"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c


def rows(columns, found):
    return sorted(tuple("" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v) for _, v in sorted(zip(columns, r, strict=True))) for r in found)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_oracle(spark, duck, name):
    got = Q.QUERIES[name](spark, SF)
    want = duck.execute(Q.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


@pytest.mark.parametrize("within", [None, "3650 days"])
def test_stream_equals_batch(spark, tmp_path, within):
    symbols = V.stored(spark, SF)
    events = V.view(spark, SF, V.EVENTS).withColumn("branch", F.lit(None).cast("string"))
    path, log = f"file://{tmp_path}/events", EventLog(CatalogStore(spark, f"file://{tmp_path}/log"), lambda repos: symbols.read("symbols", repos))
    for part in (0, 1, 1, 2):  # the second part is delivered twice
        events.filter(F.col("id") % 3 == part).coalesce(1).write.mode("append").parquet(path)
        rollup_stream(spark, path, log, f"file://{tmp_path}/check", within=within, files_per_trigger=1).awaitTermination()
    columns = ["repository_id", "query_norm", "file", "name", "selections", "last_selected_at"]
    want = pick_counts(events, symbols.read("symbols")).select(columns).collect()
    assert sorted(map(str, log.picks().select(columns).collect())) == sorted(map(str, want))
