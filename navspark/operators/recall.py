"""Candidate recall: exact, prefix, first character, trigram and path layers.

All layers are equi-joins of the queries' grams with the postings of `gram_index`, so a batch of queries against a large catalog is
never a cross product and no name is taken apart at query time. The strong layers (exact and prefix) decide for a query whether the broad ones run at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navspark.functions.matcher import subsequence_pattern
from navspark.functions.textcols import ascii_lower, has_wildcard, path_stem, query_leaf, query_trigrams, strip_wildcards
from navspark.operators.gram_index import HEAD, PATH, broad_grams, strong_grams
from navspark.schemas import PATH_ALONE_KINDS, PATH_RECALL_KINDS


def is_exact(name_lower: Column, query: Column) -> Column:
    return name_lower == ascii_lower(query)


def is_prefix(name_lower: Column, query: Column) -> Column:
    return F.startswith(name_lower, ascii_lower(query))


def is_first_char(name_lower: Column, query: Column) -> Column:
    return F.startswith(name_lower, F.substring(ascii_lower(query), 1, 1))


def has_trigram(name_lower: Column, query: Column) -> Column:
    """Whether the name holds any trigram of the query; never with fewer than three usable characters."""
    return F.exists(query_trigrams(ascii_lower(query)), lambda g: F.contains(name_lower, g))


def in_path(path: Column, kind: Column, query: Column) -> Column:
    return kind.isin(*PATH_RECALL_KINDS) & F.contains(ascii_lower(path), ascii_lower(query))


def recall_queries(queries: DataFrame) -> DataFrame:
    """Adds leaf, key (what recall looks for: the leaf without wildcards, A-Z lowered), force_fuzzy and fits (see `subsequence_pattern`). Empty queries go."""
    leaf = query_leaf(F.col("query"))
    return (
        queries.withColumn("leaf", leaf)
        .withColumn("force_fuzzy", has_wildcard(F.col("leaf")))
        .withColumn("key", ascii_lower(strip_wildcards(F.col("leaf"))))
        .withColumn("fits", subsequence_pattern(F.col("leaf")))
        .filter("query <> '' AND leaf <> ''")
    )


def recall_one(symbols: DataFrame, key: str, force_fuzzy: bool = False) -> DataFrame:
    """Candidates of one lowered key as filters on literals, which reach the scan of stored symbols."""
    q = F.lit(key)
    strong = symbols.filter(F.startswith("name_lower", q))
    if not force_fuzzy and not strong.isEmpty():
        return strong
    return symbols.filter(is_prefix(F.col("name_lower"), q) | is_first_char(F.col("name_lower"), q) | has_trigram(F.col("name_lower"), q) | in_path(F.col("file"), F.col("kind"), q))


def _asked(queries: DataFrame, grams: Column, scoped: bool) -> DataFrame:
    """(query_id, key, gram) of queries, and the repository that each is about."""
    keys = queries.filter("key <> ''").select("query_id", "key", F.explode(F.array_distinct(grams)).alias("gram"), *(["current_repo_id"] if scoped else []))
    return keys.withColumnRenamed("current_repo_id", "repository_id")


def strong_pairs(index: DataFrame, queries: DataFrame, scoped: bool = False) -> DataFrame:
    """(query_id, id) of exact and prefix matches: index postings and keys are joined by their first letters, then the whole key is compared.

    index: `gram_index.postings`, stored or of symbols that are not; ``scoped``: only of each query's current_repo_id."""
    keys = _asked(queries, strong_grams(F.col("key")), scoped)
    on = ["gram", "repository_id"] if scoped else ["gram"]
    return index.join(keys, on).filter((F.length("key") < HEAD) | F.startswith("text", F.col("key"))).select("query_id", "id")


def broad_pairs(index: DataFrame, queries: DataFrame, scoped: bool = False) -> DataFrame:
    """(query_id, id) of the first-character, trigram and path layers, one join by gram. A path has to hold the whole key."""
    keys = _asked(queries, broad_grams(F.col("key")), scoped)
    on = ["gram", "repository_id"] if scoped else ["gram"]
    pairs = index.join(keys, on).filter(~F.startswith("gram", F.lit(PATH)) | F.contains("text", F.col("key")))
    return pairs.select("query_id", "id").distinct()


def recall_many(index: DataFrame, queries: DataFrame, scoped: bool = False) -> DataFrame:
    """(query_id, id) of all candidates. queries: output of `recall_queries`. A query with a strong match, and no wildcard, has only those."""
    strong = strong_pairs(index, queries, scoped)
    settled = strong.select("query_id").distinct().withColumn("settled", F.lit(True))
    open_ = queries.join(settled, "query_id", "left").filter("settled IS NULL OR force_fuzzy")
    return strong.unionByName(broad_pairs(index, open_, scoped)).distinct()


def grams_of(queries: DataFrame) -> list[str]:
    """All grams that a few queries are looked up by, for a filter that reaches the scan."""
    key = F.col("key")
    rows = queries.filter("key <> ''").select(F.explode(F.concat(strong_grams(key), broad_grams(key))).alias("gram")).distinct().collect()
    return sorted(r.gram for r in rows)


def fitting(rows: DataFrame) -> DataFrame:
    """Candidates that can score at all: the name, or a type's file name, holds the query's letters in order."""
    stem = F.when(F.col("kind").isin(*PATH_ALONE_KINDS), ascii_lower(path_stem(F.col("file"))))
    begins = F.startswith("name_lower", F.col("key"))
    return rows.filter(begins | F.regexp_like(ascii_lower(F.col("name")), F.col("fits")) | F.regexp_like(stem, F.col("fits")))
