"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

Only built-in Spark functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navspark.llm.common import SPACE_CHARS, bit_filter, materialize, maybe_in

#: Code points of the prefix that the second level hashes.
PREFIX_CHARS = 256


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null counts as empty. Plain replacements first, as most texts have no runs."""
    out = F.coalesce(text, F.lit(""))
    for c in SPACE_CHARS[1:]:
        out = F.replace(out, F.lit(c), F.lit(" "))
    return F.when(F.contains(out, F.lit("  ")), F.regexp_replace(out, "\\x20{2,}", " ")).otherwise(out)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False) -> DataFrame:
    """One row per input row: the id column, keep_id, group_size, kept, digest.

    Rows are equal when their texts are identical after `normalised`. The row with the smallest id stays. Level 1 counts rows by
    length; level 2 hashes the prefix of rows whose length another row has, and counts by both; level 3 hashes the full content, with
    SHA-256, of rows whose length and prefix another row has, and groups those. What survives a level goes to the next as
    a table of bits of bounded size: a bit that two groups share only lets rows through, and the last level is exact. Text is never shuffled.

    digest: SHA-256 of the normalised text, null for rows that never needed it; with ``digest_all`` the
    caller asks for it on every row. Which rows enter the last grouping is the same either way.

    Defined cases: null text counts as empty; a null id is larger than every other; of rows that repeat
    the smallest id of their group exactly one stays; an empty table gives no rows; other columns are ignored.
    """
    slim = docs.select(F.col(id_col).alias("_id"), normalised(F.col(text_col).cast("string")).alias("_norm"))
    sized = slim.withColumn("_len", F.length("_norm"))
    lengths = bit_filter(sized.groupBy("_len").count().filter("count > 1"), ["_len"])
    prefix = F.when(F.col("_long"), F.xxhash64(F.substring("_norm", 1, PREFIX_CHARS)))
    prefixed = maybe_in(sized, ["_len"], lengths, "_long").withColumn("_prefix", prefix)
    counted = prefixed.filter("_long").groupBy("_len", "_prefix").count().filter("count > 1")
    survivors = bit_filter(counted, ["_len", "_prefix"])
    flagged = maybe_in(prefixed, ["_len", "_prefix"], survivors, "_full").withColumn("_full", F.col("_full") & F.col("_long"))
    full_hash = F.unhex(F.sha2(F.col("_norm"), 256))
    slim = materialize(
        flagged.select(
            "_id",
            F.monotonically_increasing_id().alias("_row"),
            "_len",
            "_prefix",
            "_full",
            (full_hash if digest_all else F.when(F.col("_full"), full_hash)).alias("_sha"),
        ),
        "dedup-rows",
    )
    order = F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("id"), F.col("_row").alias("row"))
    groups = (
        slim.filter("_full")
        .groupBy("_len", "_prefix", "_sha")
        .agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_size"))
        .filter("_size > 1")
    )
    groups = materialize(groups, "dedup-groups")  # so that the join below has exchanges of its own, which can be split at a hot group
    grouped = F.col("_size").isNotNull()
    return slim.join(groups, ["_len", "_prefix", "_sha"], "left").select(
        F.col("_id").alias(id_col),
        F.when(grouped, F.col("_first.id")).otherwise(F.col("_id")).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(grouped, F.col("_first.row") == F.col("_row")).otherwise(F.lit(True)).alias("kept"),
        F.col("_sha").alias("digest"),
    )
