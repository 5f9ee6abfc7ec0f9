"""Ranking: top k, gates, filters, confidence, merging of result sets. Everything is per query_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from navspark.functions.textcols import under_any


def ranking() -> list[Column]:
    """Score, then shorter names in bytes, then name, file and line: a total order but for equal rows."""
    return [F.col("score").desc(), F.octet_length("name").asc(), F.col("name").asc(), F.col("file").asc(), F.col("line").asc()]


def top_k(hits: DataFrame, k: int | Column) -> DataFrame:
    """The k best hits of each query, with their rank from 1."""
    window = Window.partitionBy("query_id").orderBy(*ranking())
    return hits.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def has_feature(*names: str) -> Column:
    return F.exists("features", lambda s: s["name"].isin(*names))


def _gate(hits: DataFrame, flag: Column) -> DataFrame:
    """If the flag holds for any hit of a query, its other hits go."""
    window = Window.partitionBy("query_id")
    return hits.withColumn("_flag", flag).withColumn("_any", F.max("_flag").over(window)).filter(F.col("_flag") | ~F.col("_any")).drop("_flag", "_any")


def relevance_gate(hits: DataFrame) -> DataFrame:
    """Exact and prefix matches drive out the others."""
    return _gate(hits, has_feature("exact", "prefix"))


def scope_gate(hits: DataFrame) -> DataFrame:
    """For a qualified query, hits in the scope drive out the others; a scope that fits none is a hint only."""
    return _gate(hits, has_feature("parent"))


def post_filter(hits: DataFrame, paths: list[str] = (), kinds: list[str] = (), langs: list[str] = ()) -> DataFrame:
    out = hits.filter(under_any(F.col("file"), list(paths)))
    if kinds:
        out = out.filter(F.col("kind").isin(*kinds))
    return out.filter(F.col("language").isin(*langs)) if langs else out


def headroom(want: int, filtered: bool) -> int:
    """How many hits to rank if some may be filtered out afterwards."""
    return max(20 * want, 200) if filtered else want


def match_quality() -> Column:
    """How good the kind of match is by itself, from the features."""
    value = lambda name: F.element_at(F.filter("features", lambda s: s["name"] == name), 1)["value"]
    fuzzy = F.least(F.greatest(F.lit(0.30) + F.lit(0.35) * value("fuzzy") / F.lit(600.0), F.lit(0.30)), F.lit(0.65))
    return F.when(has_feature("exact"), 1.0).when(has_feature("prefix"), 0.9).when(has_feature("wildcard"), 0.7).when(has_feature("fuzzy"), fuzzy).otherwise(0.25)


def round2(value: Column) -> Column:
    return F.floor(value * 100 + 0.5) / 100


def lead(score: Column, other: Column) -> Column:
    """How far a hit is ahead of its best rival, 0 to 1; 1 without one."""
    ahead = F.least(F.greatest(F.lit(0.5) + F.lit(3.0) * (score - other) / score, F.lit(0.0)), F.lit(1.0))
    return F.when(other.isNull(), 1.0).when(score <= 0, 0.5).otherwise(ahead)


def attach_confidence(hits: DataFrame) -> DataFrame:
    """Adds confidence. The best hit's rival is the second, every other hit's is the best."""
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, second = F.nth_value("score", 1).over(best), F.nth_value("score", 2).over(best)
    rival = F.when(F.col("score") == F.col("_first"), F.col("_second")).otherwise(F.col("_first"))
    staged = hits.withColumn("_first", first).withColumn("_second", second)
    return staged.withColumn("confidence", round2(match_quality() * lead(F.col("score"), rival))).drop("_first", "_second")


def merge(left: DataFrame, right: DataFrame, k: int | None = None) -> DataFrame:
    """Both result sets, of hits with the same file, line and name the better one, ranked again; the best ``k`` if that is given. The repository doesn't count."""
    names = [c for c in left.columns if c != "rank"]
    both = left.select(names).unionByName(right.select(names))
    window = Window.partitionBy("query_id", "file", "line", "name").orderBy(*ranking())
    best = both.withColumn("_n", F.row_number().over(window)).filter("_n = 1").drop("_n")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*ranking()))) if k is None else top_k(best, k)


def miss_status(complete: Column, interrupted: Column) -> Column:
    """What a query without hits means: interrupted, warming (not all files are known yet) or no_match."""
    return F.when(interrupted, "interrupted").when(~complete, "warming").otherwise("no_match")


def exit_code(hits: Column, status: Column) -> Column:
    """0 with hits, 1 for a definitive miss, 2 while the catalog is incomplete."""
    return F.when(hits > 0, 0).when(status == "no_match", 1).otherwise(2)


def hit_json(columns: list[str]) -> Column:
    """A hit as a JSON object; fields that are null are left out, features are names only."""
    return F.to_json(F.struct(*(F.transform("features", lambda s: s["name"]).alias(c) if c == "features" else F.col(c) for c in columns)))


def hit_text() -> Column:
    """path:line  kind name and, if there is one, the parent."""
    place = F.concat(F.col("file"), F.lit(":"), F.col("line").cast("string"))
    return F.concat(place, F.lit("  "), F.col("kind"), F.lit(" "), F.col("name"), F.coalesce(F.concat(F.lit(" · "), F.col("parent")), F.lit("")))
