"""Vector compression by product quantisation over whole numbers, with codebooks from delta-maintained Lloyd rounds.

A vector is cut into parts, and each part is coded as the nearest entry of its position's codebook. The table of a round holds each
vector's codes and those of the round before; a codebook entry is the mean of its parts, from a running count and running sums. After the
first round only parts whose code changed are shuffled: minus what they gave their old entry, plus what they give the new one. All sums and
distances are exact whole numbers, so that neither order nor partitions matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navspark.llm.common import drop_path, materialize, release, scratch, small_batches

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Largest whole number that a component may become: squares of differences then fit 64 bits.
LIMIT = 1 << 26
#: Rows whose distances to a codebook are worked out at once.
ROWS = 4096


def whole_vectors(rows: DataFrame, vector_col: str) -> DataFrame:
    """Adds v, the vector as floor(`SCALE` * component), and drops rows whose vector is null or holds a null or a component that is not finite."""
    x = F.col(vector_col).cast("array<double>")
    unfit = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    scaled = F.transform(x, lambda c: F.floor(c * SCALE))
    too_large = F.raise_error(F.lit(f"a component is beyond {LIMIT // SCALE}"))
    v = F.when(F.exists(x, lambda c: F.abs(c) > LIMIT // SCALE), too_large).otherwise(scaled).cast("array<int>")
    return rows.filter(F.col(vector_col).isNotNull() & ~F.exists(x, unfit)).withColumn("v", v)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def nearest(v: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, squared distance) of the entry nearest to each row, of equally near ones the first. Exact: in doubles while all terms are below 2**53, else in 64-bit integers."""
    place, distance = np.empty(len(v), np.uint8), np.empty(len(v), np.int64)
    for at in range(0, len(v), ROWS):
        rows = v[at : at + ROWS].astype(np.int64)
        largest = int(max(np.abs(rows).max(initial=0), np.abs(book).max(initial=0)))
        if 4 * max(1, v.shape[1]) * largest * largest < 1 << 53:
            x, c = rows.astype(float), book.astype(float)
            d = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]
        else:
            d = np.stack([((rows - entry) ** 2).sum(axis=1) for entry in book], axis=1)
        place[at : at + ROWS] = d.argmin(axis=1)
        distance[at : at + ROWS] = d.min(axis=1)
    return place, distance


def assign(table: DataFrame, books: np.ndarray, kinds: str) -> DataFrame:
    """(id, label, v, code, old, error): each vector coded with the codebooks, and the code it had. books: part, entry, component."""
    parts, _, width = books.shape

    def run(batches):
        for batch in batches:
            v = matrix(batch.column("v"), parts * width)
            found = [nearest(v[:, p * width : (p + 1) * width], books[p]) for p in range(parts)]
            code = np.stack([place for place, _ in found], axis=1)
            error = sum((d for _, d in found), np.zeros(len(v), np.int64))
            new = pa.array([c.tobytes() for c in code], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "label", "v")), new, batch.column("code"), pa.array(error)], ["id", "label", "v", "code", "old", "error"])
        release()

    return table.select("id", "label", "v", "code").mapInArrow(run, f"{kinds}, v array<int>, code binary, old binary, error long")


def changes(table: DataFrame, books: np.ndarray) -> np.ndarray:
    """What is to be added to each entry's count and component sums (part, entry, 1 + component), from parts whose code changed.

    A partition adds its changes up before it sends them: a row for each cell of the result at most, of which the driver gets the sums."""
    parts, entries, width = books.shape

    def run(batches):
        delta = np.zeros((parts, entries, 1 + width), np.int64)
        for batch in batches:
            v = matrix(batch.column("v"), parts * width).astype(np.int64)
            new = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, parts)
            had = np.array([o is not None for o in batch.column("old").to_pylist()], bool)
            old = np.frombuffer(b"".join(o or bytes(parts) for o in batch.column("old").to_pylist()), np.uint8).reshape(-1, parts)
            for p in range(parts):
                moved = ~had | (new[:, p] != old[:, p])
                left = moved & had
                part = np.concatenate([np.ones((len(v), 1), np.int64), v[:, p * width : (p + 1) * width]], axis=1)
                np.add.at(delta[p], new[moved, p], part[moved])
                np.subtract.at(delta[p], old[left, p], part[left])
        flat = delta.ravel()
        held = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(flat[held])], ["cell", "value"])

    moved = table.filter(~F.col("code").eqNullSafe(F.col("old"))).select("v", "code", "old")
    out = np.zeros(parts * entries * (1 + width), np.int64)
    for row in moved.mapInArrow(run, "cell long, value long").groupBy("cell").agg(F.sum("value").alias("value")).collect():
        out[row.cell] = row.value
    return out.reshape(parts, entries, 1 + width)


def updated(books: np.ndarray, running: np.ndarray) -> np.ndarray:
    """Each entry as the floored mean of its parts; one that has none stays."""
    count, sums = running[:, :, :1], running[:, :, 1:]
    return np.where(count > 0, np.floor_divide(sums, np.maximum(count, 1)), books)


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components as decimal numbers, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress_vectors(
    rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> tuple[DataFrame, np.ndarray]:
    """(one row per vector: the id column, code, error, label_error; the codebooks as part x entry x component).

    The codebooks begin as the parts of the ``entries`` vectors with the smallest ids; the driver holds them and the running sums, whose
    size depends on the parameters alone. code: one byte for each part; error: squared distances summed over the parts; label_error: error
    summed over rows of the same label. Vectors are written once for each round, and the table of the round before goes then.

    Defined cases: vectors that are null or hold null, NaN or infinity are left out, as are those of another length than that with the
    smallest id; a component beyond `LIMIT` / `SCALE` is an error, and so is a length that ``parts`` does not divide; null ids
    are larger than every other, equal ids are ordered by their vectors; rows that repeat count each; rows without a label belong together;
    equally near entries: the first; with fewer rows than ``entries`` the codebooks are as short; an empty table gives no rows; other columns
    are ignored.
    """
    spark = rows.sparkSession
    small_batches(spark)
    if not 1 <= entries <= 256:
        raise ValueError("an entry's number has to fit a byte")
    slim = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("x"))
    kinds = f"id {slim.schema['id'].dataType.simpleString()}, label {slim.schema['label'].dataType.simpleString()}"
    whole = whole_vectors(slim, "x").select("id", "label", "v")
    first = [r.v for r in whole.orderBy(F.col("id").isNull(), "id", "v").limit(entries).collect()]
    if not first:
        none = spark.createDataFrame([], f"{id_col} {kinds.split()[1].rstrip(',')}, code binary, error long, label_error long")
        return none, np.zeros((parts, 0, 0), np.int64)
    size = len(first[0])
    if size % parts:
        raise ValueError(f"vectors of {size} components can't be cut into {parts} equal parts")
    books = np.array([v for v in first if len(v) == size], np.int64).reshape(-1, parts, size // parts).transpose(1, 0, 2)
    table, before = whole.filter(F.size("v") == size).withColumn("code", F.lit(None).cast("binary")), None
    running = np.zeros((parts, books.shape[1], 1 + size // parts), np.int64)
    for n in range(rounds):
        path = scratch(spark, f"codes-{n}")
        coded = assign(table, books, kinds)
        coded.write.parquet(path)
        table = spark.read.schema(coded.schema).parquet(path)
        if before:
            drop_path(spark, before)
        before = path
        running += changes(table, books)
        books = updated(books, running)
    final = materialize(assign(table, books, kinds).select("id", "label", "code", "error"), "codes")
    if before:
        drop_path(spark, before)
    by_label = materialize(final.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"), "code-errors")
    joined = final.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error"), books
