"""Catalog maintenance as pure table-to-table operations: what a table becomes, for the store to write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from navspark.functions.textcols import ascii_lower, content_hash, shares_gram


#: Lines of a commit log that are put in order together.
LOG_BLOCK = 10_000


def next_ids(new: DataFrame, old: DataFrame, order: list[str]) -> DataFrame:
    """Adds an id column above all ids of ``old``, in the order given. For repositories and checkouts, of which there are few."""
    top = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first().top
    return new.withColumn("id", (F.row_number().over(Window.orderBy(*order)) + top).cast("long"))


def upsert_repositories(old: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """new: identity, default_branch. A known identity keeps its id and creation time; a null branch keeps the old one."""
    fresh = new.groupBy("identity").agg(F.max("default_branch").alias("branch"))
    kept = old.join(fresh.withColumn("_seen", F.lit(True)), "identity", "left").select(
        "id", "identity", F.coalesce("branch", "default_branch").alias("default_branch"), "created_at",
        F.when(F.col("_seen"), F.lit(now)).otherwise(F.col("updated_at")).cast("long").alias("updated_at"),
    )
    added = next_ids(fresh.join(old, "identity", "left_anti"), old, ["identity"])
    at = F.lit(now).cast("long")
    return kept.unionByName(added.select("id", "identity", F.col("branch").alias("default_branch"), at.alias("created_at"), at.alias("updated_at")))


def upsert_checkouts(old: DataFrame, new: DataFrame) -> DataFrame:
    """new: repository_id, root_path, current_branch. A path's last writer wins and keeps the path's id."""
    kept = old.select("id", "root_path").join(new, "root_path", "left_semi")
    changed = new.join(kept, "root_path")
    added = next_ids(new.join(old, "root_path", "left_anti"), old, ["root_path"])
    columns = ["id", "repository_id", "root_path", "current_branch"]
    return old.join(new, "root_path", "left_anti").select(columns).unionByName(changed.select(columns)).unionByName(added.select(columns))


def path_key(*tables: DataFrame) -> list[str]:
    """What tells files apart: their path, within a repository where all tables name one."""
    return ["repository_id", "path"] if all("repository_id" in t.columns for t in tables) else ["path"]


def to_parse(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """Files seen whose time differs from the stored one, or that have none stored. Both: path, mtime and, for several repositories, repository_id."""
    key = path_key(stored, seen)
    known = stored.select(*key, F.col("mtime").alias("_known"))
    return seen.join(known, key, "left").filter("_known IS NULL OR mtime IS NULL OR _known <> mtime").drop("_known")


def changed_files(stored: DataFrame, parsed: DataFrame) -> DataFrame:
    """Parsed files with status: new, changed or same, by content hash. Both: path, content_hash and, for several repositories, repository_id."""
    key = path_key(stored, parsed)
    known = stored.select(*key, F.col("content_hash").alias("_known"))
    status = F.when(F.col("_known").isNull(), "new").when(F.col("_known") == F.col("content_hash"), "same").otherwise("changed")
    return parsed.join(known, key, "left").withColumn("status", status).drop("_known")


def replace_files(files: DataFrame, symbols: DataFrame, parsed: DataFrame, parsed_symbols: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """The files and symbols after parsed files replace those of the same repository and path.

    A file whose hash is as stored keeps its symbols; its times are touched. parsed: repository_id, path, language, mtime,
    content_hash; parsed_symbols: path, repository_id and the symbol columns. New ids are hashes of what makes a row one of its own,
    so that none has to be numbered.
    """
    judged = changed_files(files, parsed)
    at, key = F.lit(now).cast("long"), ["repository_id", "path"]
    old = files.select(*key, "id", "git_ts")
    known = judged.join(old, key, "left").withColumn("id", F.coalesce("id", F.xxhash64(*key)))
    columns = ["id", "repository_id", "path", "language", "mtime", "git_ts", "content_hash", "indexed_at"]
    written = known.withColumn("indexed_at", at)
    new_files = files.join(parsed, key, "left_anti").select(columns).unionByName(written.select(columns))
    replaced = written.filter("status <> 'same'").select(*key, F.col("id").alias("file_id"))
    kept = symbols.join(replaced.select("file_id"), "file_id", "left_anti")
    fresh = parsed_symbols.join(replaced, key).withColumn("name_lower", F.lower("name"))
    fresh = fresh.withColumn("id", F.xxhash64("file_id", "line", "name", "kind", "parent"))
    return new_files, kept.unionByName(fresh.select([c for c in kept.columns if c in fresh.columns]), allowMissingColumns=True)


def reconcile(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """Stored files that a finished sweep has not seen: to be forgotten."""
    key = path_key(stored, seen)
    return stored.select(key).join(seen.select(key), key, "left_anti")


def forget_files(files: DataFrame, symbols: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    key = path_key(files, paths)
    gone = files.join(paths, key, "left_semi").select(F.col("id").alias("file_id"))
    return files.join(paths, key, "left_anti"), symbols.join(gone, "file_id", "left_anti")


def set_git_times(files: DataFrame, times: DataFrame) -> DataFrame:
    """times: path, ts and, for several repositories, repository_id. Other files keep theirs."""
    columns, key = files.columns, path_key(files, times)
    return files.join(times.select(*key, F.col("ts").alias("_ts")), key, "left").withColumn("git_ts", F.coalesce("_ts", "git_ts")).select(columns)


def drop_repository(tables: dict[str, DataFrame], repository_id: int) -> dict[str, DataFrame]:
    """All tables without a repository's rows."""
    return {n: t.filter(F.col("id" if n == "repositories" else "repository_id") != repository_id) for n, t in tables.items()}


def sweep_outcome(completed: Column, whole_repo: Column, seen_empty: Column, had_stored: Column, budgeted: Column) -> Column:
    """struct(finalize, status) of a sweep.

    Only a completed sweep of the whole repository is final, and an empty one that had stored files is not
    trusted when it ran on a budget. A final one is complete, every other warming.
    """
    trusted = ~(seen_empty & had_stored & budgeted)
    final = completed & whole_repo & trusted
    return F.struct(final.alias("finalize"), F.when(final, "complete").otherwise("warming").alias("status"))


def settle_status(status: Column, total_files: Column) -> Column:
    """A repository without files is never complete."""
    return F.when((status == "complete") & (total_files == 0), "warming").otherwise(status)


def coverage_overview(repositories: DataFrame, coverage: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """repo, status, files, symbols of each repository, by identity; counts are aggregated before the joins."""
    n_files = files.groupBy("repository_id").agg(F.count(F.lit(1)).alias("files"))
    n_symbols = symbols.groupBy("repository_id").agg(F.count(F.lit(1)).alias("symbols"))
    full = coverage.filter("scope = 'full'").select("repository_id", "status")
    repos = repositories.select(F.col("id").alias("repository_id"), F.col("identity").alias("repo"))
    out = repos.join(full, "repository_id", "left").join(n_files, "repository_id", "left").join(n_symbols, "repository_id", "left")
    zero = F.lit(0)
    return out.select("repo", F.coalesce("status", F.lit("never")).alias("status"), F.coalesce("files", zero).alias("files"), F.coalesce("symbols", zero).alias("symbols")).orderBy("repo")


def outline(symbols: DataFrame, repository_id: int, path: str, path_column: str = "file") -> DataFrame:
    return symbols.filter((F.col("repository_id") == repository_id) & (F.col(path_column) == path)).orderBy("line", "name")


def prioritized(paths: DataFrame, query: Column, active: list[str] = ()) -> DataFrame:
    """Paths (path, ordinal), the active ones first, then those whose stem shares a gram with the query, otherwise in the order given."""
    ranked = paths.withColumn("first", shares_gram(F.col("path"), query))
    return ranked.orderBy(*([F.col("path").isin(list(active)).desc()] if active else []), F.col("first").desc(), "ordinal")


def content_prefilter(text: Column, needle: Column) -> Column:
    """Substring test that ignores the case of A-Z."""
    return F.contains(ascii_lower(text), ascii_lower(needle))


def hashed(text: Column) -> Column:
    return content_hash(text)


def latest_commit_times(log: DataFrame, block: int = LOG_BLOCK) -> DataFrame:
    """path, ts of a commit log (n, line), newest first: whole-number lines are times, others paths; the first time of a path counts.

    Lines are taken in blocks of ``block``; a block is told the last time before it by a table of one row per block."""
    stamp = F.when(F.col("line").rlike("^[0-9]+$"), F.col("line").cast("long"))
    lines = log.select("n", "line", F.floor(F.col("n") / block).alias("block"), stamp.alias("stamp"))
    last = lines.groupBy("block").agg(F.max_by("stamp", F.when(F.col("stamp").isNotNull(), F.col("n"))).alias("last"))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("block", F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    before = Window.partitionBy("block").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    timed = lines.join(carried, "block").withColumn("ts", F.coalesce(F.last("stamp", ignorenulls=True).over(before), "carried"))
    paths = timed.filter(F.col("stamp").isNull() & (F.trim("line") != "") & F.col("ts").isNotNull())
    return paths.groupBy(F.col("line").alias("path")).agg(F.min_by("ts", "n").alias("ts"))


def located(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Symbols with the path and times of their files as these are now, so that a search needs no other table."""
    at = files.select(F.col("id").alias("file_id"), F.col("path").alias("file"), "mtime", "git_ts")
    return symbols.drop("file", "mtime", "git_ts").join(at, "file_id")
