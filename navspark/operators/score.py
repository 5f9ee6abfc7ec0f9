"""The additive, explainable relevance score as column expressions.

Every feature is a nullable double; those that apply make up the features array and their sum the score. The
only Python is the subsequence matcher, behind a native test, and only for rows that need it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navspark import schemas as S
from navspark.functions.matcher import may_match, pair_scores
from navspark.functions.textcols import ascii_lower, ends_with_segments, has_wildcard, kind_bonus, parent_dir, path_stem, query_qualifier, segments

#: In the order in which equal values are listed.
FEATURES = ("exact", "case", "prefix", "fuzzy", "wildcard", "path", "private", "kind", "parent", "current_repo", "learned", "recency", "branch")
NAME_FEATURES = ("exact", "prefix", "fuzzy", "wildcard")


def capped(value: Column, cap: float) -> Column:
    """At most ``cap``; null stays null, which least() alone would not do."""
    return F.when(value.isNotNull(), F.least(value, F.lit(cap)))


def exact(name: Column, leaf: Column) -> Column:
    return F.when(~has_wildcard(leaf) & (ascii_lower(name) == ascii_lower(leaf)), S.EXACT)


def case_match(name: Column, leaf: Column) -> Column:
    """A query with capitals that matches to the letter."""
    return F.when(exact(name, leaf).isNotNull() & (ascii_lower(leaf) != leaf) & (name == leaf), S.CASE)


def prefix(name: Column, leaf: Column) -> Column:
    low, q = ascii_lower(name), ascii_lower(leaf)
    tail = F.least(F.length(name) - F.length(leaf), F.lit(S.PREFIX_TAIL))
    return F.when(~has_wildcard(leaf) & F.startswith(low, q) & (low != q), F.lit(S.PREFIX) - tail)


def private(visibility: Column) -> Column:
    return F.when(visibility.isin("private", "protected"), S.PRIVATE)


def current_repo(repository: Column, current: Column) -> Column:
    return F.when(repository == current, S.CURRENT_REPO)


def recency(git_ts: Column, mtime: Column, now: Column) -> Column:
    """120 halved every 14 days since the later of commit and edit; nothing below 1 or without either."""
    latest = F.greatest(git_ts, F.floor(mtime / F.lit(1_000_000_000)))
    days = F.greatest(now - latest, F.lit(0)) / F.lit(86400.0)
    value = F.lit(S.RECENCY) * F.pow(F.lit(0.5), days / F.lit(S.RECENCY_HALF_DAYS))
    return F.when(latest.isNotNull() & (value >= 1), value)  # greatest() skips nulls


def learned(selections: Column, last: Column, now: Column) -> Column:
    """260 for five picks or more, in proportion below, halved every 30 days."""
    days = F.greatest(now - last, F.lit(0)) / F.lit(86400.0)
    share = F.least(selections, F.lit(S.LEARNED_FULL)) / F.lit(float(S.LEARNED_FULL))
    return F.when(selections > 0, F.lit(S.LEARNED) * share * F.pow(F.lit(0.5), days / F.lit(S.LEARNED_HALF_DAYS)))


def branch(file: Column, changed: Column) -> Column:
    """180 if the branch changed the file, 60 if it changed one in the same folder; changed: array of paths."""
    folders = F.filter(F.transform(changed, parent_dir), lambda d: d.isNotNull())
    return F.when(F.array_contains(changed, file), S.BRANCH_FILE).when(F.array_contains(folders, parent_dir(file)), S.BRANCH_DIR)


def learned_boosts(stats: DataFrame, queries: DataFrame, now: Column) -> DataFrame:
    """(query_id, repository_id, file, name, learned): the most that picks for a beginning of the query are worth.

    A stored query counts for every query that starts with it: each query's beginnings are joined to the stored ones by equality.
    """
    whole = ascii_lower(F.col("query"))
    heads = F.transform(F.sequence(F.lit(1), F.length(whole)), lambda n: F.substring(whole, F.lit(1), n))
    begun = queries.filter("query <> ''").select("query_id", F.explode(heads).alias("query_norm"))
    worth = learned(F.col("selections"), F.col("last_selected_at"), now)
    return stats.join(begun, "query_norm").groupBy("query_id", "repository_id", "file", "name").agg(F.max(worth).alias("learned"))


def asked_columns(queries: DataFrame) -> DataFrame:
    """Adds what scoring needs of each query, so that it is worked out once per query and not per pair."""
    changed = F.col("changed_files")
    return queries.select(
        "*",
        ascii_lower(F.col("leaf")).alias("leaf_low"),
        has_wildcard(F.col("leaf")).alias("wild"),
        segments(query_qualifier(F.col("query"))).alias("scope"),
        F.filter(F.transform(changed, parent_dir), lambda d: d.isNotNull()).alias("changed_dirs"),
    )


def add_matches(pairs: DataFrame) -> DataFrame:
    """Adds name_low, name_score (where no exact or prefix match settles it) and path_score of each (query, symbol) row."""
    rows = pairs.withColumn("name_low", ascii_lower(F.col("name"))).withColumn("stem", path_stem(F.col("file")))
    settled = ~F.col("wild") & F.startswith("name_low", F.col("leaf_low"))
    by_name = F.when(~settled & may_match(F.col("leaf"), F.col("name")), F.col("name"))
    by_path = F.when(may_match(F.col("leaf"), F.col("stem")), F.col("stem"))
    scored = rows.withColumn("_match", pair_scores(F.col("leaf"), by_name, by_path))
    return scored.select(*(c for c in rows.columns if c != "stem"), F.col("_match.name").alias("name_score"), F.col("_match.path").alias("path_score"))


def feature_columns() -> dict[str, Column]:
    """The feature expressions over a row of `add_matches` with symbol columns, current_repo_id, learned_value, changed_files, now."""
    name, leaf, low, asked, wild = (F.col(c) for c in ("name", "leaf", "name_low", "leaf_low", "wild"))
    begins = ~wild & F.startswith(low, asked)
    is_exact = ~wild & (low == asked)
    by_name = {
        "exact": F.when(is_exact, S.EXACT),
        "prefix": F.when(begins & (low != asked), F.lit(S.PREFIX) - F.least(F.length(name) - F.length(leaf), F.lit(S.PREFIX_TAIL))),
        "fuzzy": F.when(~wild & ~begins, capped(F.col("name_score"), S.FUZZY_CAP)),
        "wildcard": F.when(wild, capped(F.col("name_score"), S.FUZZY_CAP)),
    }
    named = is_exact | begins | F.col("name_score").isNotNull()
    path = F.when(named, capped(F.col("path_score") * S.PATH_WITH_NAME, S.PATH_WITH_NAME_CAP)).when(
        F.col("kind").isin(*S.PATH_ALONE_KINDS), capped(F.col("path_score") * S.PATH_ALONE, S.PATH_ALONE_CAP)
    )
    by_dir = F.array_contains("changed_dirs", parent_dir(F.col("file")))
    every = by_name | {
        "case": F.when(is_exact & (asked != leaf) & (name == leaf), S.CASE),
        "path": path,
        "private": private(F.col("visibility")),
        "kind": kind_bonus(F.col("kind")),
        "parent": ends_with_segments(F.col("scope"), F.col("parent")),
        "current_repo": current_repo(F.col("repository_id"), F.col("current_repo_id")),
        "learned": F.when(F.col("learned_value") > 0, F.col("learned_value")),
        "recency": recency(F.col("git_ts"), F.col("mtime"), F.col("now")),
        "branch": F.when(F.array_contains("changed_files", F.col("file")), S.BRANCH_FILE).when(by_dir, S.BRANCH_DIR),
    }
    return {f: every[f] for f in FEATURES}


def score_values(pairs: DataFrame) -> DataFrame:
    """Adds score and a column f_<name> for each feature; rows that match neither by name nor, for type kinds, by path go.

    pairs: candidates with the columns of their symbol and, from `asked_columns`, of their query."""
    scored = add_matches(pairs).select("*", *(c.cast("double").alias(f"f_{f}") for f, c in feature_columns().items()))
    found = F.coalesce(*(F.col(f"f_{f}") for f in (*NAME_FEATURES, "path"))).isNotNull()
    total = sum((F.coalesce(F.col(f"f_{f}"), F.lit(0.0)) for f in FEATURES), F.lit(0.0))
    return scored.filter(found).withColumn("score", total).drop("name_score", "path_score", "name_low")


def list_features(scored: DataFrame) -> DataFrame:
    """Turns the columns f_<name> into features (name and value, largest first). Best done after the top hits are taken."""
    every = F.array(*(F.struct(F.col(f"f_{f}").alias("value"), F.lit(-k).alias("place"), F.lit(f).alias("name")) for k, f in enumerate(FEATURES)))
    held = F.sort_array(F.filter(every, lambda s: s["value"].isNotNull()), asc=False)
    return scored.withColumn("features", F.transform(held, lambda s: F.struct(s["name"], s["value"]))).drop(*(f"f_{f}" for f in FEATURES))


def score_pairs(pairs: DataFrame) -> DataFrame:
    """`score_values` and `list_features` of all rows."""
    return list_features(score_values(pairs))


def prepare_pairs(symbols: DataFrame, queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """Joins candidates to their query's and symbol's columns. queries also has current_repo_id and, to be scored, changed_files."""
    asked = asked_columns(queries) if "changed_files" in queries.columns else queries
    return pairs.join(asked, "query_id").join(symbols, "id")
