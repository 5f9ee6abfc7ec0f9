"""Candidates that cannot be among a query's best k go before the matcher sees them.

Every part of the score but the matcher's is known from native columns. Of the matcher's part two bounds are: what an alignment of so
many letters in a text with so many word beginnings can be worth at most, and what one is worth at least if the letters stand there in one
run. The k-th largest lower bound of a query is a score that its k best hits reach, so rows whose upper bound is below it are dropped
and the hits stay the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from navspark import schemas as S
from navspark.functions.matcher import may_match
from navspark.functions.textcols import ascii_lower, path_stem
from navspark.operators.score import FEATURES, feature_columns

#: Parts of the score that need the matcher, and how far sums of doubles in another order may lie apart.
MATCHED, SLACK = ("fuzzy", "wildcard", "path"), 1e-6


def letters(leaf: Column) -> Column:
    """The lowered query without ASCII signs: the letters that are looked for if the query is ASCII, else no fewer than those."""
    return F.regexp_replace(ascii_lower(leaf), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]", "")


def plain(leaf: Column) -> Column:
    """Whether the letters are known exactly: an ASCII query without wildcards."""
    return F.regexp_like(leaf, F.lit(r"^[\x00-\x7F]*$")) & ~F.regexp_like(leaf, F.lit(r"[*?.]"))


def at_most(leaf: Column, text: Column) -> Column:
    """No match of the query in the text is worth more. Each word beginning but the first has its own capital, or sign before it."""
    wanted, low = letters(leaf), ascii_lower(text)
    n = F.length(wanted)
    begins = F.regexp_count(text, F.lit("[^a-z0-9]")) + 1
    start = F.when(plain(leaf) & ~F.startswith(low, F.left(wanted, F.lit(1))), 0).otherwise(S.START)
    broken = F.when(plain(leaf) & ~F.contains(low, wanted), S.CONTIGUOUS + S.GAP).otherwise(0)
    return n * S.MATCH + F.least(n, begins) * S.BOUNDARY + F.greatest(n - 1, F.lit(0)) * S.CONTIGUOUS + start - broken


def at_least(leaf: Column, text: Column) -> Column:
    """What the query is surely worth in the text, null if that is not known without the matcher: its letters stand there in one run."""
    wanted, low = letters(leaf), ascii_lower(text)
    n = F.length(wanted)
    value = n * S.MATCH + (n - 1) * S.CONTIGUOUS + F.when(F.startswith(low, wanted), S.START + S.BOUNDARY).otherwise(0)
    return F.when(plain(leaf) & (n > 0) & F.contains(low, wanted), value)


def add_bounds(pairs: DataFrame) -> DataFrame:
    """Adds _lower, null if it is not sure that the row is a hit, and _upper, null if it is sure that it is none. Input as for `score_values`."""
    rows = pairs.withColumn("name_low", ascii_lower(F.col("name"))).withColumn("_stem", path_stem(F.col("file")))
    leaf, name, stem = F.col("leaf"), F.col("name"), F.col("_stem")
    begins = ~F.col("wild") & F.startswith("name_low", F.col("leaf_low"))
    parts = feature_columns()
    known = sum((F.coalesce(parts[f].cast("double"), F.lit(0.0)) for f in FEATURES if f not in MATCHED), F.lit(0.0))
    in_path = F.when(may_match(leaf, stem), at_most(leaf, stem).cast("double"))
    beside = F.coalesce(F.least(in_path * S.PATH_WITH_NAME, F.lit(S.PATH_WITH_NAME_CAP) + in_path * 0), F.lit(0.0))
    alone = F.when(F.col("kind").isin(*S.PATH_ALONE_KINDS) & in_path.isNotNull(), F.least(in_path * S.PATH_ALONE, F.lit(S.PATH_ALONE_CAP)))
    by_name = F.when(may_match(leaf, name), F.least(at_most(leaf, name).cast("double"), F.lit(S.FUZZY_CAP)) + beside)
    sure = F.least(at_least(leaf, name).cast("double"), F.lit(S.FUZZY_CAP) + at_least(leaf, name) * 0)
    lower = known + F.when(begins, 0.0).otherwise(F.when(sure.isNotNull(), sure))
    upper = known + F.when(begins, beside).otherwise(F.greatest(by_name, alone))
    return rows.withColumn("_lower", lower).withColumn("_upper", upper).drop("_stem", "name_low")


def thresholds(bounded: DataFrame, k: int) -> DataFrame:
    """(query_id, _least): a whole number that the k-th best hit reaches; queries with fewer sure hits have no row.

    Lower bounds are counted by whole numbers before the shuffle, so a query with very many candidates is not one task."""
    counted = bounded.filter("_lower IS NOT NULL").groupBy("query_id", F.floor("_lower").alias("_least")).agg(F.count(F.lit(1)).alias("_n"))
    down = Window.partitionBy("query_id").orderBy(F.desc("_least"))
    enough = counted.withColumn("_sum", F.sum("_n").over(down)).filter(F.col("_sum") >= k)
    return enough.groupBy("query_id").agg(F.max("_least").alias("_least"))


def prune(pairs: DataFrame, k: int, sure: DataFrame | None = None) -> DataFrame:
    """The candidates that may be among the best k of their query.

    sure: the same rows without what picks are worth, if those are joined to them: boosts only add, so the bounds hold and that join is made once."""
    bounded = add_bounds(pairs)
    least = thresholds(bounded if sure is None else add_bounds(sure.withColumn("learned_value", F.lit(None).cast("double"))), k)
    judged = bounded.join(least, "query_id", "left")
    return judged.filter(F.col("_least").isNull() | (F.col("_upper") + SLACK >= F.col("_least"))).drop("_lower", "_upper", "_least")
