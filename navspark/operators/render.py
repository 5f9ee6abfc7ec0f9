"""Hits as people and programs read them: marked text, an explaining line, rows of JSON. All native columns but the places of a match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navspark.functions.matcher import positions_column
from navspark.functions.textcols import path_stem
from navspark.operators.rank import hit_json

#: What begins and ends a mark in a terminal; the color goes in between.
ESCAPE, RESET = "\x1b[", "\x1b[0m"


def marked(text: Column, places: Column, color: str, offset: Column | None = None) -> Column:
    """The text with its places (0-based from the offset, rising) in a color, neighbouring ones in one run. Null or no places leave it as it is.

    places is a column that is there already: Python functions can't stand below the native ones used here."""
    offset = F.lit(0) if offset is None else offset
    begins = F.filter(places, lambda p: ~F.array_contains(places, p - 1))
    ends = F.filter(places, lambda p: ~F.array_contains(places, p + 1))
    after = lambda i: F.coalesce(F.get(ends, i - 1) + offset + 1, F.lit(0))  # noqa: E731  where the text goes on after the run before
    run = lambda b, i: F.concat(
        F.substring(text, after(i) + 1, b + offset - after(i)), F.lit(f"{ESCAPE}{color}m"), F.substring(text, b + offset + 1, F.get(ends, i) - b + 1), F.lit(RESET)
    )
    rest = F.substring(text, after(F.size(ends)) + 1, F.length(text))
    return F.when(F.size(places) > 0, F.concat(F.array_join(F.transform(begins, run), ""), rest)).otherwise(text)


def folders(path: Column) -> Column:
    """How long a path is before its file's name."""
    return F.length(F.regexp_extract(path, r"(?s)^(.*/)?", 0))


def explanation() -> Column:
    """confidence 0.97 · score 1015 = exact 1000 + kind 15; halves go to the even neighbour."""
    whole = lambda value: F.bround(value, 0).cast("long").cast("string")
    parts = F.array_join(F.transform("features", lambda s: F.concat(s["name"], F.lit(" "), whole(s["value"]))), " + ")
    return F.concat(F.lit("confidence "), F.format_string("%.2f", F.col("confidence")), F.lit(" · score "), whole(F.col("score")), F.lit(" = "), parts)


def add_text(hits: DataFrame, query: Column, color: str | None = None, explain: bool = False) -> DataFrame:
    """Adds text: path:line  kind name · parent, below it the line of the definition if the hits have a signature, and why it is there if that is wanted.

    With a color what the query matched is marked in names, definition lines and the stems of file names; folders and extensions are not
    what a query is about. A null signature gives no line."""
    shown = {"name": F.col("name"), "file": F.col("file")} | ({"signature": F.col("signature")} if "signature" in hits.columns else {})
    rows = hits
    if color is not None:
        rows = rows.select("*", *(positions_column(query, path_stem(c) if n == "file" else c).alias(f"_places_{n}") for n, c in shown.items()))
        shown = {n: marked(c, F.col(f"_places_{n}"), color, folders(c) if n == "file" else None) for n, c in shown.items()}
    place = F.concat(shown["file"], F.lit(":"), F.col("line").cast("string"), F.lit("  "), F.col("kind"), F.lit(" "), shown["name"])
    first = F.concat(place, F.coalesce(F.concat(F.lit(" · "), F.col("parent")), F.lit("")))
    below = [F.concat(F.lit("    "), c) for c in (*(shown[n] for n in shown if n == "signature"), *([explanation()] if explain else []))]
    return rows.withColumn("text", F.concat_ws("\n", first, *below)).drop(*(f"_places_{n}" for n in shown))


def rows_json(hits: DataFrame, columns: list[str]) -> DataFrame:
    """One compact object a row, in a column `value` as the text sink takes it; fields that are null are left out."""
    return hits.select(hit_json(columns).alias("value"))


def write_rows(hits: DataFrame, path: str, columns: list[str]) -> None:
    """Rows of JSON, one a line, written by all tasks; what lies at the path is replaced."""
    rows_json(hits, columns).write.mode("overwrite").text(path)


def page_json(hits: DataFrame, columns: list[str]) -> DataFrame:
    """(query_id, json): each query's page as one indented array in the order of rank. For ranked pages, whose size the limit of the search bounds."""
    fields = F.struct(*(F.transform("features", lambda s: s["name"]).alias(c) if c == "features" else F.col(c) for c in columns))
    page = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", fields.alias("hit")))).alias("page"))
    return page.select("query_id", F.to_json(F.transform("page", lambda r: r["hit"]), {"pretty": "true"}).alias("json"))


def miss_json(query: Column, status: Column) -> Column:
    """What is said of a query without hits."""
    return F.to_json(F.struct(query.alias("query"), status.alias("status")))
