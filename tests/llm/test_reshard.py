import itertools
import random
import zlib

from pyspark.sql import functions as F

from navspark.llm import queries
from navspark.llm.reshard import capacities, file_row, min_cost_flow, moved_bytes, reshard, rewrite_affected, solve


def cheapest(supply, demand, cost):
    """All ways, one unit at a time."""
    units = [i for i, n in enumerate(supply) for _ in range(n)]
    seats = [j for j, n in enumerate(demand) for _ in range(n)]
    return min(sum(cost(i, j) for i, j in zip(units, p, strict=True)) for p in set(itertools.permutations(seats)))


def test_flow_costs_least():
    random.seed(2)
    for _ in range(40):
        n, m = random.randint(1, 3), random.randint(1, 3)
        supply = [random.randint(0, 2) for _ in range(n)]
        demand = [0] * m
        for _ in range(sum(supply)):
            demand[random.randrange(m)] += 1
        table = {(i, j): random.randint(0, 4) for i in range(n) for j in range(m)}
        flow = min_cost_flow(supply, demand, lambda i, j: table[i, j])
        assert [sum(f for (i, _), f in flow.items() if i == k) for k in range(n)] == supply
        assert [sum(f for (_, j), f in flow.items() if j == k) for k in range(m)] == demand
        assert sum(f * table[k] for k, f in flow.items()) == cheapest(supply, demand, lambda i, j: table[i, j])


def test_fewest_bytes_move():
    random.seed(3)
    for _ in range(50):
        old = {k: random.randint(0, 10**6) for k in range(random.randint(1, 12))}
        shards = random.randint(1, 14)
        room = capacities(sum(old.values()), shards)
        stay = sum(min(b, room[k]) for k, b in old.items() if k < shards)
        assert moved_bytes(solve(old, shards)) == sum(old.values()) - stay


def check(rows, shards):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    assert all(0 <= k < shards for k in by)
    for group in by.values():
        assert sorted(r.slot for r in group) == list(range(len(group)))
    sizes = [sum(r.size for r in by.get(k, [])) for k in range(shards)]
    assert sum(sizes) == sum(r.size for r in rows)
    return sizes


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op4_reshard(spark, sf).collect()
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.size == len(docs[r.doc_id]) + 16 and r.text_crc32 == zlib.crc32(docs[r.doc_id]) and r.law == "bytes" for r in rows)
    sizes = check(rows, 40)
    assert max(sizes) - min(sizes) < 0.05 * sum(sizes) / 40


def test_moves_hardly_more_than_the_flow(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    placed, transfers = reshard(docs, F.pmod(F.xxhash64("doc_id"), F.lit(32)), 40, file_row())
    moved = placed.filter("old_shard <> shard").agg(F.sum("size").alias("n")).first().n
    assert moved_bytes(transfers) <= moved <= 1.01 * moved_bytes(transfers)
    sizes = check(placed.collect(), 40)
    assert max(sizes) - min(sizes) < 0.02 * sum(sizes) / 40


def stored(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def test_odd_rows(spark, tmp_path):
    rows = [(k, "x" * (k % 50), k % 3) for k in range(3000)] + [(5, None, 7), (5, None, 7), (None, "", None), (None, "y" * 100_000, 9)]
    docs = stored(spark, f"{tmp_path}/d", rows, "doc_id long, text string, old int")
    got, transfers = reshard(docs, F.col("old"), 6, file_row(), block_rows=64)
    got = got.collect()
    assert len(got) == len(rows)
    sizes = check(got, 6)
    assert max(sizes) >= 100_000  # one row larger than a shard
    small = stored(spark, f"{tmp_path}/s", [r for r in rows if len(r[1] or "") < 100], "doc_id long, text string, old int")
    got, _ = reshard(small, F.col("old"), 6, file_row(), block_rows=64)
    sizes = check(got.collect(), 6)
    assert max(sizes) - min(sizes) < 300
    got, transfers = reshard(docs.limit(0).select("*", F.lit(0).alias("row")), F.col("old"), 6, F.col("row"))
    assert got.count() == 0 and transfers == []


def test_only_affected_files_are_rewritten_and_no_row_is_lost(spark, tmp_path):
    rows = [(k, "x" * 84, k % 2 if k < 200 else 2) for k in range(300)] + [(None, "z" * 84, 0), (None, None, 1), (7, "w" * 84, 2), (7, "w" * 84, 2)]
    docs = stored(spark, f"{tmp_path}/in", rows, "doc_id long, text string, slot int")
    path = f"{tmp_path}/d"
    docs.select("doc_id", "text", F.col("slot").alias("_slot"), F.lit(0).cast("long").alias("slot"), F.col("slot").alias("shard")).write.partitionBy("shard").parquet(path)
    placed, _ = reshard(docs, F.col("slot"), 4, file_row())
    changed = rewrite_affected(docs, placed, path, file_row(), file_rows=20)
    assert changed == {0, 1, 2, 3}
    got = spark.read.parquet(path)
    assert sorted(got.columns) == ["_slot", "doc_id", "shard", "slot", "text"]
    assert sorted(str((r.doc_id, r.text, r["_slot"])) for r in got.collect()) == sorted(str(r) for r in rows)
    by_shard = {r.shard: (r.n, r.top) for r in got.groupBy("shard").agg(F.countDistinct("slot").alias("n"), F.max("slot").alias("top")).collect()}
    assert sorted(by_shard) == [0, 1, 2, 3] and all(n == top + 1 for n, top in by_shard.values()) and sum(n for n, _ in by_shard.values()) == len(rows)
