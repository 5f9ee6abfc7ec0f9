"""Packing token sequences into windows by minimum bin slack.

Documents longer than a window are cut into full windows and a remainder. How many pieces there are of each
length is a histogram of at most ``window`` numbers, however many documents there are. For each window to
fill, the largest remaining length is set and a bitset subset-sum program finds the multiset of the
other lengths that fills what is left most closely; stepping back through its stages gives the multiset. A
multiset is used as often as the histogram allows. Pieces are then matched to places by their rank within their length.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from navspark.llm.common import materialize, release, small_batches
from navspark.llm.tokens import encoder

WINDOW = 4096
PIECE_SCHEMA = "length int, start long, ids binary, ids_crc32 long, doc_tokens long, block int, rank long"


@dataclass(frozen=True)
class Layout:
    """Runs of places for pieces, ordered by (length, rank of the first piece): ``copies`` pieces of the
    length in each window from ``window`` on, the first at ``offset``."""

    length: np.ndarray
    rank: np.ndarray
    window: np.ndarray
    copies: np.ndarray
    offset: np.ndarray
    windows: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, offset) of the rank-th piece of a length."""
        run = np.empty(len(length), np.int64)
        for size in np.unique(length):
            lo, hi = np.searchsorted(self.length, [size, size + 1])
            of = length == size
            run[of] = lo + np.searchsorted(self.rank[lo:hi], rank[of], "right") - 1
        nth = rank - self.rank[run]
        copies = self.copies[run]
        return self.window[run] + nth // copies, self.offset[run] + nth % copies * length


def fill(counts: dict[int, int], lengths: list[int], space: int) -> dict[int, int]:
    """How many of each length (descending) to take so that their sum is as large as it can be within ``space``."""
    stages: list[tuple[int, int, int]] = []  # (length, copies, sums that can be reached without them)
    reach, within = 1, (1 << space + 1) - 1
    for length in lengths:
        if length > space or not counts[length]:
            continue
        left, copies = min(counts[length], space // length), 1
        while left:
            copies = min(copies, left)
            stages.append((length, copies, reach))
            reach |= reach << length * copies & within
            left -= copies
            copies *= 2
        if reach >> space & 1:
            break
    total, taken = reach.bit_length() - 1, {}
    for length, copies, without in reversed(stages):
        if not without >> total & 1:
            taken[length] = taken.get(length, 0) + copies
            total -= length * copies
    return taken


def plan(histogram: dict[int, int], window: int) -> Layout:
    """The layout of pieces of the lengths that ``histogram`` counts. Deterministic; its size depends on ``window`` alone."""
    counts = {k: v for k, v in histogram.items() if v}
    used = dict.fromkeys(counts, 0)
    runs, windows = [], 0
    lengths = sorted(counts, reverse=True)
    while lengths:
        largest = lengths[0]
        counts[largest] -= 1
        taken = fill(counts, lengths, window - largest)
        counts[largest] += 1
        taken[largest] = taken.get(largest, 0) + 1
        times = min(counts[k] // n for k, n in taken.items())
        offset = 0
        for length, copies in sorted(taken.items(), reverse=True):
            runs.append((length, used[length], windows, copies, offset))
            used[length] += copies * times
            counts[length] -= copies * times
            offset += copies * length
        windows += times
        lengths = [k for k in lengths if counts[k]]
    columns = np.array(sorted(runs), np.int64).reshape(-1, 5).T
    return Layout(*columns, windows)


def _ranks(length: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """How many pieces of its length came before each; ``seen`` counts those of earlier calls and is brought up to date."""
    order = np.argsort(length, kind="stable")
    ordered = length[order]
    first = np.searchsorted(ordered, ordered, "left")
    out = np.empty(len(length), np.int64)
    out[order] = seen[ordered] + np.arange(len(ordered)) - first
    seen += np.bincount(length, minlength=len(seen))
    return out


def cut_pieces(tokenizer_path: str, end_id: int, window: int):
    """For ``mapInArrow`` over (text, others): the pieces of each text with their rank among those of the same length in the task."""

    def run(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId()
        enc = encoder(tokenizer_path, False)
        width = enc.dtype.itemsize
        seen = np.zeros(window + 1, np.int64)
        for batch in batches:
            flat, counts = enc.encode_column(batch.column("text"))
            counts = counts + 1
            ends = np.cumsum(counts)
            whole = np.full(int(ends[-1]) if len(ends) else 0, end_id, enc.dtype)
            kept = np.ones(len(whole), bool)
            kept[ends - 1] = False
            whole[kept] = flat
            pieces = -(-counts // window)
            row = np.repeat(np.arange(len(counts)), pieces)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * window
            total = counts[row]
            length = np.minimum(window, total - start)
            at = (ends - counts)[row] + start
            wide, narrow = memoryview(whole.astype("<u4")).cast("B"), memoryview(whole).cast("B")
            spans = list(zip(at.tolist(), (at + length).tolist(), strict=True))
            crc = [zlib.crc32(wide[4 * a : 4 * b]) for a, b in spans]
            ids = [narrow[width * a : width * b] for a, b in spans]
            rest = [c for c in batch.schema.names if c != "text"]
            columns = [
                *(batch.column(c).take(pa.array(row)) for c in rest),
                pa.array(length, pa.int32()), pa.array(start), pa.array(ids, pa.binary()), pa.array(crc, pa.int64()), pa.array(total),
                pa.array(np.full(len(row), block, np.int32)), pa.array(_ranks(length, seen)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [*rest, "length", "start", "ids", "ids_crc32", "doc_tokens", "block", "rank"])
        release()

    return run


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: the id column, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset.

    ids are little-endian, two bytes each if the vocabulary allows it, else four; ids_crc32 is over them as
    unsigned 32-bit integers. doc_tokens counts the document's ids with ``end_id``. A sequence is to be
    padded to ``window``; its pieces lie one after the other from offset 0.

    Texts are encoded once, in the scan; only counts by length are shuffled and one number per length is
    gathered. Null texts count as empty and give a piece of one id; ids of documents are carried along whatever they are, null
    or repeated; an empty table gives no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    pieces = materialize(slim.mapInArrow(cut_pieces(tokenizer_path, end_id, window), f"id {kind}, {PIECE_SCHEMA}"), "pieces")
    counts = materialize(pieces.groupBy("length", "block").count(), "piece-counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most `window` rows
    layout = plan(histogram, window)
    earlier = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "block", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("base"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = layout.place(length.to_numpy(np.int64), rank.to_numpy(np.int64))
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    ranked = pieces.join(bases, ["length", "block"]).withColumn("at", place(F.col("length").cast("long"), F.col("base") + F.col("rank")))
    return ranked.select(
        F.col("id").alias(id_col), "start", F.col("length").cast("long").alias("length"), "ids", "ids_crc32", "doc_tokens", "at.sequence_id", "at.offset"
    )
