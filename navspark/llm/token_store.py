"""Token ids as binary shards with minimal perfect hash indexes from document ids to places.

A store is a table of blocks, written by Spark, so it can be in any store that Spark writes, and a task
that is run again writes the same. Shard k holds the documents of the k-th range of ids, in ascending order, in
blocks of about BLOCK_DOCS documents or BLOCK_BYTES of ids. Each block is read by itself:

====== =================================================================================
name   data
====== =================================================================================
head   int64 x 5: documents, keys, tokens, bytes per id, documents without an id (the last ones)
keys   int64 per document: its id, ascending (a null id is the largest number)
places int64 per document and one more: where its ids begin, in ids from the block's first
disp   int32 per bucket: the displacements of the perfect hash
slots  per slot: uint32 fingerprint of the key, uint32 its first document, uint32 how many
ids    raw ids, little-endian, all documents one after the other
====== =================================================================================
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from navspark.llm import perfect_hash
from navspark.llm.common import LARGEST_ID, integer_ids, materialize, release, small_batches
from navspark.llm.tokens import encoder

#: Documents of a shard at least, where that keeps all cores busy, and at most; documents and bytes of ids from which a block is full.
SHARD_DOCS, LARGE_SHARD_DOCS = 8192, 65536
BLOCK_DOCS, BLOCK_BYTES = 1024, 1 << 21
#: Characters of a text that tell which shard it goes to among those of equal ids; ranges are found from a sample of these, not of whole texts.
HEAD_CHARS = 32
#: Keys that one row of a lookup asks a block for; more are dealt to several rows.
ASKED_KEYS = 65536
SECTIONS = ("head", "keys", "places", "disp", "slots", "ids")
STORE_SCHEMA = "shard int, block int, first long, last long, " + ", ".join(f"{n} binary" for n in SECTIONS)
_SLOT = np.dtype([("mark", "<u4"), ("first", "<u4"), ("count", "<u4")])


def make_block(shard: int, block: int, keys: list[int], counts: list[int], ids: bytes, width: int, missing: int) -> pa.RecordBatch:
    """One row of the table: the index of the keys, which are in ascending order, and the ids."""
    key = np.array(keys, "<i8")
    places = np.concatenate([[0], np.cumsum(counts)]).astype("<i8")
    distinct, first, count = np.unique(key, return_index=True, return_counts=True)
    displace, slot = perfect_hash.build(distinct)
    slots = np.zeros(len(distinct), _SLOT)
    slots["mark"][slot], slots["first"][slot], slots["count"][slot] = perfect_hash.fingerprint(distinct), first, count
    head = np.array([len(key), len(distinct), places[-1], width, missing], "<i8")
    sections = [*(x.tobytes() for x in (head, key, places, displace.astype("<i4"), slots)), ids]
    columns = [pa.array([x], pa.int32()) for x in (shard, block)] + [pa.array([int(x)], pa.int64()) for x in (key[0], key[-1])]
    return pa.RecordBatch.from_arrays([*columns, *(pa.array([x], pa.binary()) for x in sections)], ["shard", "block", "first", "last", *SECTIONS])


def write_shard(tokenizer_path: str, end_id: int):
    """For ``mapInArrow`` over one shard's (key, missing, text), ascending: the blocks of the shard."""

    def run(batches):
        from pyspark import TaskContext

        shard, block = TaskContext.get().partitionId(), 0
        enc = encoder(tokenizer_path, True)
        width = enc.dtype.itemsize
        end = np.array([end_id], enc.dtype).tobytes()
        keys, counts, held, missing = [], [], bytearray(), 0
        for batch in batches:
            flat, sizes = enc.encode_column(batch.column("text"))
            raw, ends = memoryview(flat).cast("B"), (np.cumsum(sizes) * width).tolist()
            for key, none, size, last in zip(batch.column("key").to_pylist(), batch.column("missing").to_pylist(), sizes.tolist(), ends, strict=True):
                if len(keys) >= BLOCK_DOCS or len(held) >= BLOCK_BYTES:  # rows that repeat an id may go on in the next block
                    yield make_block(shard, block, keys, counts, bytes(held), width, missing)
                    keys, counts, held, missing, block = [], [], bytearray(), 0, block + 1
                keys.append(key)
                missing += none
                counts.append(size + 1)
                held += raw[last - size * width : last]
                held += end
        if keys:
            yield make_block(shard, block, keys, counts, bytes(held), width, missing)
        release()

    return run


def write_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_docs: int | None = None) -> None:
    """Encodes whole texts, appends ``end_id`` to each and writes the store at ``path``, in ascending order of id.

    Ids are integers; a TypeError tells of others. Ranges of ids are dealt to shards of ``shard_docs`` documents or, unless that is given, of
    `SHARD_DOCS` to `LARGE_SHARD_DOCS`. Null texts count as empty; a null id comes after all others; rows that repeat an id
    are all stored, in order of their text, over as many blocks and shards as they need (only equal texts of equal ids are one task's); an empty table gives an empty store; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    integer_ids(docs, id_col)
    slim = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(LARGEST_ID)).alias("key"), F.col(id_col).isNull().alias("missing"), F.col(text_col).cast("string").alias("text")
    )
    count = docs.count()
    busy = min(-(-count // SHARD_DOCS), 4 * docs.sparkSession.sparkContext.defaultParallelism)
    shards = -(-count // shard_docs) if shard_docs else max(busy, -(-count // LARGE_SHARD_DOCS))
    dealt = slim.repartitionByRange(max(1, shards), "key", "missing", F.substring("text", 1, HEAD_CHARS)).sortWithinPartitions("key", "missing", "text")
    dealt.mapInArrow(write_shard(tokenizer_path, end_id), STORE_SCHEMA).write.mode("overwrite").parquet(path)


class BlockIndex:
    """The index of one block."""

    def __init__(self, row: dict[str, bytes]):
        self.docs, self.n_keys, self.tokens, self.width, self.missing = np.frombuffer(row["head"], "<i8").tolist()
        self.keys, self.places = np.frombuffer(row["keys"], "<i8"), np.frombuffer(row["places"], "<i8")
        self.displace, self.slots = np.frombuffer(row["disp"], "<i4"), np.frombuffer(row["slots"], _SLOT)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first document, number of documents) of each key; a key whose stored fingerprint differs has none."""
        slot = self.slots[perfect_hash.slots_of(keys, self.displace, self.n_keys)]
        return slot["first"].astype(np.int64), np.where(slot["mark"] == perfect_hash.fingerprint(keys), slot["count"].astype(np.int64), 0)


def _rows_of(batches):
    """The rows of ``mapInArrow`` batches as dictionaries, one at a time."""
    for batch in batches:
        for n in range(batch.num_rows):
            yield {name: batch.column(k)[n].as_py() for k, name in enumerate(batch.schema.names)}


def _read_blocks(batches):
    """For ``mapInArrow`` over blocks: one row per document, found through the index."""
    for row in _rows_of(batches):
        index = BlockIndex(row)
        distinct = np.unique(index.keys)
        first, count = index.find(distinct)
        keys = np.repeat(distinct, count)
        doc = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(len(keys))
        begins, ends = index.places[doc], index.places[doc + 1]
        wide = memoryview(np.frombuffer(row["ids"], f"<u{index.width}").astype("<u4")).cast("B")
        crc = [zlib.crc32(wide[4 * x : 4 * y]) for x, y in zip(begins.tolist(), ends.tolist(), strict=True)]
        places = [np.full(len(keys), row[c], np.int32) for c in ("shard", "block")]
        ids = pa.array(keys, mask=doc >= index.docs - index.missing)
        columns = [*(pa.array(x) for x in places), ids, pa.array(begins), pa.array(ends - begins), pa.array(crc, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["shard", "block", "key", "begin", "n_tokens", "crc"])


def read_store(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id column, start, n_tokens, ids_crc32) of every document, from the files alone.

    start counts the ids of all documents before it; ids_crc32 is over the ids as little-endian unsigned
    32-bit integers. Each id is looked up in its block's perfect hash and its fingerprint compared. Blocks are read where they lie.
    """
    small_batches(spark)
    store = spark.read.schema(STORE_SCHEMA).parquet(path)
    docs = store.drop("first", "last").mapInArrow(_read_blocks, "shard int, block int, key long, begin long, n_tokens long, crc long")
    head = store.select("shard", "block", _long("head", 2).alias("tokens"))
    shards = head.groupBy("shard").agg(F.sum("tokens").alias("tokens"))
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("tokens").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # the first window has one row per shard, of thousands of documents each
    starts = head.select("shard", "block", inside.alias("inside")).join(shards.select("shard", before.alias("before")), "shard")
    return docs.join(starts, ["shard", "block"]).select(
        F.col("key").alias(id_col),
        (F.col("before") + F.col("inside") + F.col("begin")).alias("start"),
        "n_tokens",
        F.col("crc").alias("ids_crc32"),
    )


def _find_keys(batches):
    """For ``mapInArrow`` over blocks with the keys asked of them (column wanted, null for documents without an id): (key, ids) of those that are there."""
    for row in _rows_of(batches):
        index = BlockIndex(row)
        wanted = [k for k in row["wanted"] if k is not None]
        keys = np.unique(np.array(wanted, np.int64))
        first, count = index.find(keys)
        named = index.docs - index.missing
        found = [(k, d) for k, f, n in zip(keys.tolist(), first.tolist(), count.tolist(), strict=True) for d in range(f, min(f + n, named))]
        found += [(None, d) for d in range(named, index.docs) if len(wanted) < len(row["wanted"])]
        ids = np.frombuffer(row["ids"], f"<u{index.width}")
        values = [ids[index.places[d] : index.places[d + 1]].astype(np.int64).tolist() for _, d in found]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array(values, pa.list_(pa.int64()))], ["key", "ids"])


def _carry_blocks(batches):
    """For ``mapInArrow`` over one range of blocks (their first keys) and asked keys, sorted: each key with the last block at or
    before it, null if that is in an earlier range; and, with asked null, the last block of the range."""
    from pyspark import TaskContext

    part, held = TaskContext.get().partitionId(), (None, None, None)
    for batch in batches:
        rows = []
        for at, asked, missing, *place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if asked:
                rows.append((part, True, at, missing, *held))
            else:
                held = tuple(place)
        yield _routed(rows)
    yield _routed([(part, None, None, None, *held)])


_ROUTED = "part int, asked boolean, key long, missing boolean, last long, shard int, block int"


def _routed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32()]
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in _ROUTED.split(", ")])


def _route(store: DataFrame, asked: DataFrame) -> DataFrame:
    """(key, missing, shard, block): the blocks that each key has to be in if it is there at all.

    A key that a block begins or ends with may be in several blocks and is joined to all of these; others are in one block only. Blocks and keys are sorted together by ranges; a range is told the last block before it by a table of one row per range.
    """
    blocks = store.select(F.col("first").alias("at"), F.lit(False).alias("asked"), F.lit(False).alias("missing"), "last", "shard", "block")
    ends = store.select(F.explode(F.array_distinct(F.array("first", "last"))).alias("key"), "shard", "block")
    several = asked.join(ends, "key")
    asked = asked.join(ends, "key", "left_anti")
    keys = asked.select(F.col("key").alias("at"), F.lit(True).alias("asked"), "missing", *(F.lit(None).cast(t).alias(c) for c, t in (("last", "long"), ("shard", "int"), ("block", "int"))))
    sorted_ = blocks.unionByName(keys).repartitionByRange("at").sortWithinPartitions("at", "asked")
    routed = materialize(sorted_.mapInArrow(_carry_blocks, _ROUTED), "lookup-route")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per shuffle partition
    last = F.last(F.when(F.col("block").isNotNull(), F.struct("last", "shard", "block")), ignorenulls=True).over(earlier)
    before = routed.filter("asked IS NULL").select("part", last.alias("before"))
    place = F.when(F.col("block").isNotNull(), F.struct("last", "shard", "block")).otherwise(F.col("before"))
    found = routed.filter("asked").join(F.broadcast(before), "part").select("key", "missing", place.alias("p"))
    return found.filter("key <= p.last").select("key", "missing", "p.shard", "p.block").unionByName(several.select("key", "missing", "shard", "block"))


def lookup(spark: SparkSession, path: str, keys: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id column, ids) of the documents asked for. Only blocks whose range holds a key are opened; ids that are not in the store give no row.

    A null id asks for the documents without one.
    """
    small_batches(spark)
    integer_ids(keys, id_col)
    store = spark.read.schema(STORE_SCHEMA).parquet(path)
    asked = keys.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LARGEST_ID)).alias("key"), F.col(id_col).isNull().alias("missing")).distinct()
    routed = _route(store, asked)
    shares = routed.groupBy("shard", "block").agg(F.ceil(F.count(F.lit(1)) / F.lit(ASKED_KEYS)).cast("int").alias("shares"))
    dealt = routed.join(shares, ["shard", "block"]).withColumn("share", F.pmod(F.xxhash64("key"), F.col("shares")))
    wanted = dealt.groupBy("shard", "block", "share").agg(F.collect_list(F.struct(F.when(~F.col("missing"), F.col("key")).alias("k"))).alias("wanted"))
    wanted = wanted.withColumn("wanted", F.transform("wanted", lambda w: w["k"]))
    found = store.drop("first", "last").join(wanted, ["shard", "block"]).mapInArrow(_find_keys, "key long, ids array<long>")
    return found.withColumnRenamed("key", id_col)


def _long(data: str, number: int):
    """The n-th int64 of a binary column: its bytes in hexadecimal, turned round. Values are not negative."""
    hexed = [F.hex(F.substring(data, number * 8 + k, 1)) for k in range(8, 0, -1)]
    return F.conv(F.concat(*hexed), 16, 10).cast("long")
