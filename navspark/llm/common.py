"""What the operators of this subpackage share: tables, scratch space, row keys."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space as character class and as the set for trim functions.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of Arrow data that a Python worker is handed at once.
BATCH_BYTES = 2 << 20
LARGEST_ID = (1 << 63) - 1
#: Bits of a `bit_filter`, 2**25: 4 MB.
FILTER_BITS = 1 << 25

_owned: list[list[str]] = []
#: Scratch paths that a table of the catalog stands for.
_tables: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that the cluster names in spark.checkpoint.dir. Only a local session may leave that unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all nodes share")
        shared = f"file://{tempfile.gettempdir()}/navspark-scratch"
    path = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _owned:
        _owned[-1].append(path)
    return path


@contextlib.contextmanager
def owned_scratch(spark: SparkSession):
    """Scratch paths that are given out inside are deleted at the end. Results that still read them have to be written before."""
    _owned.append([])
    try:
        yield
    finally:
        for path in _owned.pop():
            drop_path(spark, path)


def materialize(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Writes a DataFrame to shared scratch space and reads it again.

    This cuts the lineage, and what is read again is the same after an executor is lost even
    where the rows came from something that is not deterministic.
    """
    path = scratch(df.sparkSession, name)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    schema = df.schema
    for field in schema.fields:
        field.nullable = True
    read = df.sparkSession.read.schema(schema).parquet(path)
    return read.select(df.columns) if by else read


def write_bucketed(df: DataFrame, name: str, by: list[str], buckets: int) -> str:
    """Writes scratch data bucketed and sorted by its keys; gives the path. `read_bucketed` reads it so that a join on the keys moves no row of it."""
    path = scratch(df.sparkSession, name)
    _tables[path] = path.rsplit("/", 1)[-1].replace("-", "_")
    df.write.bucketBy(buckets, *by).sortBy(*by).option("path", path).format("parquet").saveAsTable(_tables[path])
    return path


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    return spark.table(_tables[path])


def drop_table(spark: SparkSession, path: str) -> None:
    """Forgets the table of a path of `write_bucketed`, whose files stay."""
    if path in _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop(path)}")


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a scratch path through Hadoop's file system, whatever store it is in."""
    drop_table(spark, path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches are limited in rows only by default; very long texts need a limit in bytes."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).rstrip("bB") == str((1 << 31) - 1):  # the default: no limit
        spark.conf.set(key, str(BATCH_BYTES))


def release() -> None:
    """Gives memory that a Python worker no longer uses back to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such function
        ctypes.CDLL(None).malloc_trim(0)


def bit_filter(keys: DataFrame, columns: list[str]) -> DataFrame:
    """A bit table of keys, written to scratch space: 1,024 bitmaps of 4 KB at most, however many keys there are."""
    bit = F.pmod(F.xxhash64(*columns), F.lit(FILTER_BITS)) + 1
    marked = keys.select(bit.alias("_bit")).groupBy(F.bitmap_bucket_number("_bit").alias("_number"))
    return materialize(marked.agg(F.bitmap_construct_agg(F.bitmap_bit_position("_bit")).alias("_bits")), "bit-filter")


def maybe_in(df: DataFrame, columns: list[str], bits: DataFrame, name: str) -> DataFrame:
    """Adds a boolean: false where the key is certainly not among those of the `bit_filter`, whose size allows a broadcast. Other columns may have any names."""
    bit = F.pmod(F.xxhash64(*columns), F.lit(FILTER_BITS)) + 1
    place = F.bitmap_bit_position(bit)
    number, table = fresh(df, "_number", "_bits")
    byte = F.conv(F.hex(F.substring(table, (place / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    held = F.coalesce(F.bit_get(byte, (place % 8).cast("int")) == 1, F.lit(False))
    named = bits.select(F.col("_number").alias(number), F.col("_bits").alias(table))
    return df.join(F.broadcast(named), F.bitmap_bucket_number(bit) == F.col(number), "left").withColumn(name, held).drop(number, table)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def hash128(*parts: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes with different seeds, together a 128-bit key."""
    return F.xxhash64(*parts), F.xxhash64(F.lit(7), *parts)


def binary_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null counts as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def integer_ids(docs: DataFrame, id_col: str) -> None:
    """A TypeError for ids that are no integers; number such documents first."""
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"ids have to be integers; {id_col} is {kind.simpleString()}")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns that clash with none of the DataFrame's own, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
