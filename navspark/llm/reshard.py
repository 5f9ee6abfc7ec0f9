"""Resharding by minimum-cost flow.

Given the bytes of the old shards and the capacities of the new ones, the bytes to move form a transport
problem: bytes that stay where they are cost nothing, each byte moved to another shard costs one. The flow
of least cost says how much each old shard hands to each new one. Rows of an old shard are laid on a line by
block and hash, and the flow's amounts cut that line into intervals; large rows come first, in the part
that stays, so that cuts fall on small rows. A second, much smaller flow from the sizes so reached evens out what whole rows
left over, by moving rows that have moved already or else the smallest. Only shards that give or take rows are rewritten, as
several files each; rows are told by the file and place they come from, so none is lost or doubled.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from navspark.llm.common import LARGEST_ID, fresh, hash128, materialize

#: Bytes that a row counts beside its text.
ROW_BYTES = 16
#: Rows that a block of an old shard is meant to hold; positions within a block come from one task's window.
BLOCK_ROWS = 8192
#: Rows of more than this part of a new shard's capacity are large.
LARGE_PART = 64
#: Rows of a written file.
FILE_ROWS = 65536
#: Codec of the written files; what is rewritten is every byte of the shards that change, once.
FILE_CODEC = "zstd"


@dataclass(frozen=True)
class Transfer:
    old: int
    new: int
    amount: int


def capacities(total: int, shards: int) -> list[int]:
    """Bytes per new shard, at most one apart."""
    return [total // shards + (k < total % shards) for k in range(shards)]


def min_cost_flow(supply: list[int], demand: list[int], cost) -> dict[tuple[int, int], int]:
    """The cheapest way to send supply i to demand j, by successive shortest paths with potentials.

    The graph has one node per old and per new shard, so its size does not depend on the data.
    cost(i, j) is not negative; the sums of supply and demand are equal.
    """
    n, m = len(supply), len(demand)
    flow: dict[tuple[int, int], int] = {}
    left, need = list(supply), list(demand)
    prices = [0] * (n + m)
    while True:
        dist: list[float] = [0 if k < n and left[k] else float("inf") for k in range(n + m)]
        back: list[int | None] = [None] * (n + m)
        heap = [(0, k) for k in range(n) if left[k]]
        if not heap:
            return flow
        done = set()
        while heap:
            d, u = heapq.heappop(heap)
            if u in done:
                continue
            done.add(u)
            if u < n:
                ways = ((n + j, cost(u, j)) for j in range(m))
            else:
                ways = ((i, -cost(i, u - n)) for i in range(n) if flow.get((i, u - n)))
            for v, c in ways:
                reduced = d + c + prices[u] - prices[v]
                if reduced < dist[v]:
                    dist[v], back[v] = reduced, u
                    heapq.heappush(heap, (reduced, v))
        end = min((k for k in range(n, n + m) if need[k - n]), key=lambda k: (dist[k], k))
        far = dist[end]
        path, v = [], end
        while back[v] is not None:
            path.append((back[v], v))
            v = back[v]
        room = min([left[v], need[end - n], *(flow[(w, u - n)] for u, w in path if u >= n)])
        for u, w in path:
            if u < n:
                flow[(u, w - n)] = flow.get((u, w - n), 0) + room
            else:
                flow[(w, u - n)] -= room
        left[v] -= room
        need[end - n] -= room
        prices = [p + min(d, far) for p, d in zip(prices, dist, strict=True)]


def solve(old_bytes: dict[int, int], shards: int) -> list[Transfer]:
    """The transfers, bytes that stay included, that move the fewest bytes."""
    olds = sorted(old_bytes)
    flow = min_cost_flow([old_bytes[o] for o in olds], capacities(sum(old_bytes.values()), shards), lambda i, j: int(olds[i] != j))
    return [Transfer(olds[i], j, amount) for (i, j), amount in sorted(flow.items()) if amount]


def moved_bytes(transfers: list[Transfer]) -> int:
    return sum(t.amount for t in transfers if t.old != t.new)


def affected(placed: DataFrame) -> set[int]:
    """Shards whose files change: those that give or take rows. At most old times new pairs are gathered."""
    pairs = placed.filter("old_shard <> shard").select("old_shard", "shard").distinct().collect()
    return {s for pair in pairs for s in pair}


def _intervals(spark: SparkSession, transfers: list[Transfer]) -> DataFrame:
    """(old, new, begin, end) on each old shard's line, what stays first. As many rows as transfers: old + new shards at most."""
    rows, at = [], {}
    for t in sorted(transfers, key=lambda t: (t.old, t.old != t.new, t.new)):
        begin = at.get(t.old, 0)
        rows.append((t.old, t.new, begin, begin + t.amount))
        at[t.old] = begin + t.amount
    last = {r[0]: k for k, r in enumerate(rows)}
    rows = [r[:3] + (LARGEST_ID if last[r[0]] == k else r[3],) for k, r in enumerate(rows)]
    rows = [(o, n, -1 if b == 0 else b, e) for o, n, b, e in rows]
    return spark.createDataFrame(rows, "from int, new int, begin long, end long")


def _running(column: str, partition: list[str], order: list) -> Column:
    """The sum over the rows before."""
    window = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(window), F.lit(0))


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus `ROW_BYTES`."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def _cut(rows: DataFrame, old: str, shards: int, block_rows: int, by_size: bool) -> tuple[list[Transfer], DataFrame]:
    """(transfers, rows with shard): lays the rows of each old shard on a line and cuts it by the flow's amounts.

    The line starts with what stays: large rows, then the rest by hash; with ``by_size``, all rows from large to small, those
    that are not in their old shard any more last, so that these are the first to go on.
    """
    # two numbers per old shard
    olds = rows.groupBy(old).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()
    transfers = solve({r[old]: r.bytes for r in olds}, shards)
    blocks = max(1, -(-max((r.rows for r in olds), default=0) // block_rows))
    if by_size:
        tier, order = 64 - F.floor(F.log2("size")) + F.when(F.col("old") == F.col(old), 0).otherwise(64), [F.col("size").desc(), F.col("hash")]
    else:
        large = sum(r.bytes for r in olds) // shards // LARGE_PART + 1
        tier, order = F.when(F.col("size") > large, 0).otherwise(1), [F.col("hash")]
    part = (tier * blocks + F.pmod(F.col("hash"), F.lit(blocks))).cast("long")
    rows = rows.withColumn("part", part)
    sums = rows.groupBy(old, "part").agg(F.sum("size").alias("bytes"))
    before = sums.select(old, "part", _running("bytes", [old], ["part"]).alias("before"))
    rows = rows.join(before, [old, "part"]).withColumn(
        "middle", F.col("before") + _running("size", [old, "part"], [*order, "row"]) + F.floor(F.col("size") / 2)
    )
    # a row goes where its middle is; there are no more intervals than shards, old and new
    to = F.broadcast(_intervals(rows.sparkSession, transfers))
    here = (F.col(old) == F.col("from")) & (F.col("middle") >= F.col("begin")) & (F.col("middle") < F.col("end"))
    placed = rows.join(to, here).select("row", "size", "crc", "old", "hash", F.pmod("hash", F.lit(blocks)).alias("block"), F.col("new").alias("shard"))
    return transfers, materialize(placed, "reshard-placed")


def file_row() -> Column:
    """Tells the rows of a DataFrame that is read from Parquet files: a 128-bit hash of the file's path, which is shorter, and the place in it."""
    one, two = hash128(F.col("_metadata.file_path"))
    return F.struct(one.alias("one"), two.alias("two"), F.col("_metadata.row_index").alias("at"))


def reshard(docs: DataFrame, old_shard: Column, shards: int, row: Column, text_col: str = "text", block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, list[Transfer]]:
    """(one row per input row: row, size, text_crc32, old_shard, shard, slot; the transfers).

    old_shard: the number of the shard that a row is in now. row: what tells a row from all others and is the same whenever the
    table is read, such as `file_row`. New shards are 0 to ``shards`` - 1; their
    sizes in bytes differ by a small row or two unless single rows are larger than a shard. slot numbers a
    shard's rows from 0 without gaps. An old shard that holds a third of all rows is worked on by block, and
    the number of rows of a block does not grow with the table.

    Defined cases: a null text has no bytes beside the row's own; ids are not looked at, so null and repeated ones are laid
    out one by one; a null old shard counts as 0; an empty table gives no rows and no transfers.
    """
    rows = materialize(
        docs.select(
            row.alias("row"),
            text_size(F.col(text_col)).alias("size"),
            F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("crc"),
            F.coalesce(old_shard.cast("int"), F.lit(0)).alias("old"),
        ).withColumn("hash", F.xxhash64("row")),
        "reshard-rows",
    )
    transfers, placed = _cut(rows, "old", shards, block_rows, by_size=False)
    # what the rows at the cuts left uneven is a few rows per shard
    placed = placed.withColumnRenamed("shard", "cut")
    _, placed = _cut(placed, "cut", shards, block_rows, by_size=True)
    counts = placed.groupBy("shard", "old", "block").agg(F.count(F.lit(1)).alias("rows"))
    first = counts.select("shard", "old", "block", _running("rows", ["shard"], ["old", "block"]).alias("first"))
    number = F.row_number().over(Window.partitionBy("shard", "old", "block").orderBy("hash", "row")) - 1
    out = placed.join(first, ["shard", "old", "block"]).select(
        "row", "size", F.col("crc").alias("text_crc32"), F.col("old").alias("old_shard"), "shard", (F.col("first") + number).cast("long").alias("slot")
    )
    return out, transfers


def rewrite_affected(docs: DataFrame, placed: DataFrame, path: str, row: Column, file_rows: int = FILE_ROWS, codec: str = FILE_CODEC) -> set[int]:
    """Writes the files of the shards that change, below ``path``/shard=k, and leaves those of the others alone.

    ``placed`` comes from `reshard` with the same ``row``. The files hold the columns of ``docs`` and the slot, a range of ``file_rows`` slots
    each, in order; columns of ``docs`` that are named shard or slot get a leading underscore. Returns the rewritten shards.
    """
    spark = docs.sparkSession
    changed = affected(placed)
    shard, slot = fresh(docs, "shard", "slot")
    key, file = fresh(docs, "_row", "_file")
    docs = docs.select("*", row.alias(key)).withColumnsRenamed({c: {"shard": shard, "slot": slot}[c.lower()] for c in docs.columns if c.lower() in ("shard", "slot")})
    into = placed.filter(F.col("shard").isin(sorted(changed))).select(F.col("row").alias(key), "shard", "slot")
    moved = docs.join(into, key).drop(key).withColumn(file, F.floor(F.col("slot") / file_rows))
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        dealt = moved.repartition("shard", file).sortWithinPartitions("shard", "slot").drop(file)
        dealt.write.partitionBy("shard").mode("overwrite").parquet(path, compression=codec)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
    return changed
