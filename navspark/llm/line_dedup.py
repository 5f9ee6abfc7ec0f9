"""Line deduplication against levelled sorted runs of line hashes.

An index of line keys seen so far is kept as sorted runs, in levels. Runs are bucketed by key, all into the same number of
buckets. The keys of a batch are merge-joined to one run after the other, for which no row of a run is moved; those that no
run holds (the anti side of these joins) become a new run of level 0, and a level that holds ``fanout`` runs is merged into one
run of the next, bucket by bucket. Only built-in Spark functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from navspark.llm.common import (
    LARGEST_ID,
    SPACE_CHARS,
    ascii_lower,
    drop_path,
    drop_table,
    fresh,
    hash128,
    integer_ids,
    read_bucketed,
    scratch,
    write_bucketed,
)

MIN_CHARS = 10
#: Batches, of ascending ids, that one call cuts its input into; runs of a level before they are merged.
BATCHES = 4
FANOUT = 3
KEY = ["k1", "k2"]
PROBE_SCHEMA = "k1 long, k2 long, low long, high long, first long"


def line_key(line: Column) -> Column:
    """The line stripped of ASCII white space at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACE_CHARS)))


@dataclass
class LineRuns:
    """The runs of an index: (k1, k2) is the 128-bit hash of a line key, ``first`` the smallest id that holds it. A key is in one run only.

    There are as many buckets as the session has shuffle partitions when the index is made, so that a batch's keys
    come out of their own grouping where the runs' buckets are.
    """

    spark: SparkSession
    fanout: int = FANOUT
    levels: list[list[str]] = field(default_factory=list)
    compactions: int = 0
    buckets: int = 0

    def __post_init__(self):
        self.buckets = self.buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def runs(self) -> list[DataFrame]:
        return [read_bucketed(self.spark, path) for level in self.levels for path in level]

    def read(self) -> DataFrame | None:
        """All runs as one table."""
        every = self.runs()
        return reduce(DataFrame.unionByName, every) if every else None

    def probe(self, keys: DataFrame) -> DataFrame:
        """``keys`` (k1, k2 and others) with ``first`` of the run that holds them, null if none does."""
        every = self.runs()
        for number, run in enumerate(every):
            keys = keys.join(run.withColumnRenamed("first", f"first{number}").hint("merge"), KEY, "left")
        names = [f"first{n}" for n in range(len(every))]
        return keys.withColumn("first", F.coalesce(*names, F.lit(None).cast("long"))).drop(*names)

    def add(self, keys: DataFrame) -> None:
        """Adds new keys as a sorted run of level 0 and merges full levels upwards. Bucketed keys stay where they are."""
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(write_bucketed(keys.select(*KEY, "first"), "line-run", KEY, self.buckets))
        at = 0
        while at < len(self.levels) and len(self.levels[at]) >= self.fanout:
            full = self.levels[at]
            merged = reduce(_merge, (read_bucketed(self.spark, path) for path in full))
            if at + 1 == len(self.levels):
                self.levels.append([])
            self.levels[at + 1].append(write_bucketed(merged, "line-run", KEY, self.buckets))
            self.levels[at] = []
            self.compactions += 1
            for path in full:
                drop_path(self.spark, path)
            at += 1

    def drop(self) -> None:
        """Deletes all runs."""
        for path in (p for level in self.levels for p in level):
            drop_path(self.spark, path)
        self.levels = []


def _merge(one: DataFrame, other: DataFrame) -> DataFrame:
    """Two runs as one: a merge join of buckets, both sorted, that moves no row of either."""
    both = one.hint("merge").join(other.withColumnRenamed("first", "second"), KEY, "full")
    return both.select(*KEY, F.coalesce("first", "second").alias("first"))


def _bounds(docs: DataFrame, id_col: str, batches: int) -> list[int]:
    """Ids at which the batches end; reads the id column alone."""
    cuts = [k / batches for k in range(1, batches)]
    found = docs.select(F.percentile_approx(F.col(id_col), cuts, 1000).alias("p")).first()
    return sorted(set((found.p if found else None) or []))


def repeated_lines(docs: DataFrame, runs: LineRuns, id_col: str, text_col: str, min_chars: int, batches: int) -> DataFrame:
    """(_did, _hash, drop): the 0-based numbers of the lines that each document loses. Adds all keys to ``runs``."""
    spark = docs.sparkSession
    bounds = _bounds(docs, id_col, batches)
    did = F.coalesce(F.col(id_col).cast("long"), F.lit(LARGEST_ID))
    k1, k2 = hash128(F.col("key"))
    staged = scratch(spark, "lines")
    (
        docs.select(did.alias("did"), _text_hash(F.col(text_col)).alias("hash"), F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n")).alias("pos", "line"))
        .select("did", "hash", "pos", line_key(F.col("line")).alias("key"))
        .filter(F.length("key") >= min_chars)
        .select(_batch_of(bounds).alias("batch"), "did", "hash", "pos", k1.alias("k1"), k2.alias("k2"))
        .write.partitionBy("batch")
        .parquet(staged)
    )
    lines = spark.read.schema("did long, hash long, pos int, k1 long, k2 long, batch int").parquet(staged)
    drops = []
    for number in range(len(bounds) + 1):
        part = lines.filter(F.col("batch") == number)
        keys = part.groupBy("k1", "k2").agg(F.min("did").alias("low"), F.max("did").alias("high"))
        path = write_bucketed(runs.probe(keys), "line-probe", KEY, runs.buckets)
        runs.add(read_bucketed(spark, path).filter("first IS NULL").select(*KEY, F.col("low").alias("first")))
        drop_table(spark, path)
        # read without its buckets, so that the hottest line's rows below can be split over several tasks
        probed = spark.read.schema(PROBE_SCHEMA).parquet(path)
        keep = F.least("low", "first")
        repeats = probed.filter(F.col("high") > keep).select("k1", "k2", keep.alias("keep"))
        drops.append(part.join(repeats, ["k1", "k2"]).filter("did > keep").select("did", "hash", "pos"))
    every = drops[0]
    for more in drops[1:]:
        every = every.unionByName(more)
    return every.groupBy(F.col("did").alias("_did"), F.col("hash").alias("_hash")).agg(F.collect_set("pos").alias("drop"))


def _batch_of(bounds: list[int]) -> Column:
    return sum((F.when(F.col("did") > b, 1).otherwise(0) for b in bounds), F.lit(0)).cast("int")


def _text_hash(text: Column) -> Column:
    return F.coalesce(F.xxhash64(text), F.lit(0))


def dedup_lines(
    docs: DataFrame,
    runs: LineRuns | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    batches: int = BATCHES,
) -> DataFrame:
    """The rows of ``docs`` with repeated lines cut from the text, and n_lines and n_dropped added.

    A line whose key (see `line_key`) has ``min_chars`` code points or more and is in more than one
    document stays only in the document with the smallest id, there as often as it occurs. With ``runs``
    of earlier calls, their documents count as coming first: pass batches in ascending order of id.

    Defined cases: ids are integers, a TypeError tells of others; a null text is one empty line and comes back as empty; a null id is larger than every
    other; rows that repeat an id are the same document, so they don't take lines from each other; an
    empty table gives no rows; columns of other names pass through, and n_lines or n_dropped of the
    input get a leading underscore in front of the new ones.
    """
    integer_ids(docs, id_col)
    index = runs or LineRuns(docs.sparkSession)
    drops = repeated_lines(docs, index, id_col, text_col, min_chars, batches)
    if runs is None:
        index.drop()  # what is read later are the batches' lines and probes
    did, row_hash, drop, all_lines = fresh(docs, "did_", "hash_", "drop_", "lines_")
    n_lines, n_dropped = fresh(docs, "n_lines", "n_dropped")
    drops = drops.select(F.col("_did").alias(did), F.col("_hash").alias(row_hash), F.col("drop").alias(drop))
    keyed = docs.withColumn(did, F.coalesce(F.col(id_col).cast("long"), F.lit(LARGEST_ID))).withColumn(row_hash, _text_hash(F.col(text_col)))
    joined = keyed.join(drops, [did, row_hash], "left").withColumn(all_lines, F.split(F.coalesce(text_col, F.lit("")), "\n"))
    kept = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col(drop)))
    text = F.when(F.col(drop).isNull(), F.coalesce(text_col, F.lit(""))).otherwise(
        F.array_join(F.transform(kept, lambda i: F.element_at(F.col(all_lines), i + 1)), "\n")
    )
    return joined.select(
        *(text.alias(c) if c == text_col else F.col(c) for c in docs.columns),
        F.size(all_lines).cast("long").alias(n_lines),
        F.when(F.col(drop).isNull(), 0).otherwise(F.size(drop)).cast("long").alias(n_dropped),
    )
