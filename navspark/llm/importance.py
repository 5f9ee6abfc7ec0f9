"""Importance resampling towards a target: documents are drawn by how much their n-grams look like the target's.

Features are runs of words, hashed by CRC-32 into buckets. Each partition counts its runs in a trie of words whose nodes
hold counts and CRC states, so that a longer run's hash goes on from the shorter one's; only bucket totals leave a partition. Documents
are then scored by walking the paths of a second trie whose nodes have the gains of their buckets attached, and drawn by Gumbel noise,
which depends on the id alone.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from navspark.llm.common import binary_texts, materialize, release, small_batches

BUCKETS, SEED, PERCENT, MIN_WORDS = 10_000, 2024, 10, 20
#: Nodes of a partition's trie at most (counts go to the bucket totals and a new trie begins) and bytes of text that are cut into words at once.
NODES, SLICE = 100_000, 1 << 20
#: A-Z lowered; of the ASCII characters only letters and digits belong to words.
_LETTERS = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()


def word_lists(raw: bytes, longest: int) -> Iterator[tuple[list[bytes], int]]:
    """(words, how many of them begin a run) of a text, a slice at a time: the last ones of a slice begin theirs in the next."""
    text, at, words = raw.translate(_LETTERS), 0, []
    while at < len(text):
        end = text.find(b" ", at + SLICE) if at + SLICE < len(text) else -1
        end = len(text) if end < 0 else end
        words += text[at:end].split()
        starts = len(words) if end == len(text) else max(0, len(words) - longest + 1)
        yield words, starts
        words, at = words[starts:], end


class Node:
    """A run of words: how often it was met, the CRC-32 of its bytes, the gain of its bucket, and the runs that go on from it."""

    __slots__ = ("children", "count", "crc", "gain")

    def __init__(self, crc: int, gain: int = 0):
        self.count, self.crc, self.gain, self.children = 0, crc, gain, {}


class WordTrie:
    """Runs of ``shortest`` to ``longest`` words in bounded memory; with ``gains``, one for each bucket, for scoring."""

    def __init__(self, shortest: int, longest: int, buckets: int, gains: list[int] | None = None, nodes: int = NODES):
        self.shortest, self.longest, self.buckets, self.gains, self.nodes = shortest, longest, buckets, gains, nodes
        self.totals = np.zeros(buckets, np.int64)
        self.clear()

    def clear(self) -> None:
        self.root, self.size = Node(0), 0

    def grow(self, node: Node, word: bytes) -> Node:
        crc = zlib.crc32(word, node.crc if node is self.root else zlib.crc32(b" ", node.crc))
        new = node.children[word] = Node(crc, self.gains[crc % self.buckets] if self.gains else 0)
        self.size += 1
        return new

    def add(self, raw: bytes) -> None:
        for words, starts in word_lists(raw, self.longest):
            for k in range(starts):
                if self.size >= self.nodes:
                    self.drain()
                node = self.root
                for word in words[k : k + self.longest]:
                    node = node.children.get(word) or self.grow(node, word)
                    node.count += 1

    def drain(self) -> None:
        """Adds the nodes' counts to the bucket totals and forgets the nodes."""
        level = [self.root]
        for depth in range(1, self.longest + 1):
            level = [child for node in level for child in node.children.values()]
            if depth >= self.shortest:
                for node in level:
                    self.totals[node.crc % self.buckets] += node.count
        self.clear()

    def score(self, raw: bytes) -> tuple[int, int, int]:
        """(words, runs, sum of the runs' gains) of a text."""
        n_words = runs = total = 0
        for words, starts in word_lists(raw, self.longest):
            n_words += starts
            for k in range(starts):
                if self.size >= self.nodes:
                    self.clear()
                node = self.root
                for depth, word in enumerate(words[k : k + self.longest], 1):
                    node = node.children.get(word) or self.grow(node, word)
                    if depth >= self.shortest:
                        runs += 1
                        total += node.gain
        return n_words, runs, total


def bucket_totals(texts: DataFrame, text_col: str, shortest: int, longest: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket. A partition sends a row for each bucket at most, and so does the driver get."""

    def run(batches):
        trie = WordTrie(shortest, longest, buckets)
        for batch in batches:
            for raw in binary_texts(batch.column(0)):
                trie.add(raw)
        trie.drain()
        held = np.flatnonzero(trie.totals)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(trie.totals[held])], ["bucket", "n"])
        release()

    counts = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in counts.collect():
        out[row.bucket] = row.n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> list[int]:
    """1000 times the log of target over source frequency of each bucket, with one added to each, floored."""
    buckets, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return [math.floor(1000 * math.log((float(t) + 1) * (s_all + buckets) / ((float(s) + 1) * (t_all + buckets)))) for s, t in zip(source, target, strict=True)]


def gumbel(h: int) -> int:
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score_documents(docs: DataFrame, gains: list[int], shortest: int, longest: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    """(id, words, n_features, weight, score) of each document, in the scan, without a shuffle."""
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10)
    slim = docs.select(F.col(id_col).alias("id"), noise.cast("long").alias("h"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        trie = WordTrie(shortest, longest, len(gains), gains)
        for batch in batches:
            found = [trie.score(raw) for raw in binary_texts(batch.column("text"))]
            weight = [total // runs if runs else 0 for _, runs, total in found]
            score = [w + gumbel(h) for w, h in zip(weight, batch.column("h").to_pylist(), strict=True)]
            counts = [pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *counts, pa.array(weight, pa.int64()), pa.array(score, pa.int64())], ["id", "words", "n_features", "weight", "score"])
        release()

    kind = docs.schema[id_col].dataType.simpleString()
    return slim.mapInArrow(run, f"id {kind}, words long, n_features long, weight long, score long")


def draw(scored: DataFrame, percent: int, min_words: int) -> DataFrame:
    """Adds rank, 1 for the highest score, to ``percent`` in a hundred of the rows with ``min_words`` words or more; null to all others.

    A count of rows by score tells from which score rows are drawn and how many are before each score. There are some hundred thousand
    scores at most, whatever the number of rows: gains and noise are logarithms. Only rows that can be drawn are shuffled, and a score's
    rows are put in order by id; rows that repeat are counted first, and each count becomes that many ranks.
    """
    spark = scored.sparkSession
    able = F.col("words") >= min_words
    rows_of = {r.score: r["count"] for r in scored.filter(able).groupBy("score").count().collect()}
    wanted, before, offsets = sum(rows_of.values()) * percent // 100, 0, []
    for score in sorted(rows_of, reverse=True):
        if before >= wanted:
            break
        offsets.append((score, before))
        before += rows_of[score]
    columns, none = ["id", "n_features", "weight", "score"], F.lit(None).cast("long").alias("rank")
    if not offsets:
        return scored.select(*columns, none)
    near = able & (F.col("score") >= offsets[-1][0])
    alike = scored.filter(near).groupBy(*columns, F.spark_partition_id().alias("part")).count()
    earlier = Window.partitionBy("score").orderBy(F.col("id").isNull(), "id", "part", "n_features", "weight").rowsBetween(Window.unboundedPreceding, -1)
    placed = alike.withColumn("prior", F.coalesce(F.sum("count").over(earlier), F.lit(0)))
    first = F.col("before") + F.col("prior")
    ranked = placed.join(F.broadcast(spark.createDataFrame(offsets, "score long, before long")), "score").select(*columns, F.explode(F.sequence(first + 1, first + F.col("count"))).alias("rank"))
    return ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank"))).unionByName(scored.filter(~near).select(*columns, none))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, shortest: int = 1, longest: int = 1, buckets: int = BUCKETS, seed: int = SEED,
    min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
) -> DataFrame:
    """One row per input row: the id column, n_features, weight, score, rank.

    weight is the floored mean of the gains of a document's features (runs of ``shortest`` to ``longest`` words, repeats counted), score adds
    noise that depends on seed and id. Of the documents with ``min_words`` words or more, ``percent`` in a hundred (rounded down)
    with the highest scores are drawn, ties to the smaller id; rank is null for the others.

    Defined cases: null texts count as empty and have weight 0; a null id has the noise of an empty one and is larger than every other; rows
    that repeat an id get ranks of their own; an empty target has equal frequencies; an empty table gives no rows; texts of any
    length are read whole, a slice at a time; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    source = bucket_totals(docs, text_col, shortest, longest, buckets)
    gains = bucket_gains(source, bucket_totals(target, target_text, shortest, longest, buckets))
    scored = materialize(score_documents(docs, gains, shortest, longest, seed, id_col, text_col), "importance")
    return draw(scored, percent, min_words).withColumnRenamed("id", id_col)
