"""Connected components of a link table, by large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navspark.llm.common import fresh, materialize


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links each node's larger neighbours (large), or its smaller ones and itself (small), to its smallest neighbour."""
    near = _both_ways(links) if large else links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = near.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    low = materialize(low, "cc-low")  # so that the join below has exchanges of its own, which can be split at a hub
    joined = near.join(low, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(low.select("u", F.col("low").alias("v")))
    return out.filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(u, low): each node that has a link, with the smallest node that it reaches. links: (u, v) longs, either way round.

    A round keeps at most one link for each old one and node, and a hub's links are only ever reduced to
    a minimum per key, so nothing is gathered by component. Each round is written to shared scratch space.
    """
    now = materialize(links.filter("u <> v").select("u", "v").distinct(), "cc")
    mark = None
    while True:
        now = materialize(_star(_star(now, True), False), "cc")
        then = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if mark == (then.n, then.s):
            return now.select("u", F.col("v").alias("low")).unionByName(now.select(F.col("v").alias("u"), F.col("v").alias("low")).distinct())
        mark = (then.n, then.s)


def keep_first(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that come first in their group, columns unchanged: exactly one row of each group.

    rows: (id, text_hash, component) of every row, text_hash as of `text_hash`. First is the smallest id, null being larger than all
    others, then the smallest hash; of rows equal in both any one stays.
    """
    order = F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")
    counted = rows.groupBy("component", "id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    first = counted.groupBy("component").agg(F.min_by(F.struct("id", "text_hash", "n"), order).alias("f")).select("f.*").distinct()
    first = materialize(first, "first-rows")
    key, held, mark, n = fresh(docs, "text_hash_", "id_", "mark_", "n_")
    first = first.select(F.col("id").alias(held), F.col("text_hash").alias(mark), F.col("n").alias(n))
    keyed = docs.withColumn(key, text_hash(F.col(text_col)))
    kept = keyed.join(first, F.col(id_col).eqNullSafe(F.col(held)) & (F.col(key) == F.col(mark)))
    once = kept.filter(F.col(n) == 1).select(docs.columns)
    return once.unionByName(kept.filter(F.col(n) > 1).dropDuplicates([held, mark]).select(docs.columns))


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))
