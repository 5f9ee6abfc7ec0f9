"""Sources: which files there are, what they hold, and what git knows about them.

Listing, reading, filtering and extraction are Spark jobs; what git says about commits and branches is asked on the driver.
"""

from __future__ import annotations

import json
import os
import subprocess
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from navspark.functions.textcols import content_hash, language_of, shares_gram
from navspark.plans.query import jobs
from navspark.sources.extract import extract
from navspark.sources.tree import NAME, SourceTree, file_mtime

TRUNKS = ("main", "master", "trunk")
LISTED = "path string, ordinal long, mtime long"
#: Bytes of texts that are sent on at once.
BATCH_BYTES = 4 << 20
PARSED_SYMBOL = "repository_id long, path string, name string, kind string, language string, line long, end_line long, parent string, visibility string"


def git(root: str, *args: str) -> str | None:
    """What a git command prints, None if it fails or there is no git."""
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, timeout=30)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout.decode("utf-8", "surrogateescape") if done.returncode == 0 else None


def list_files(spark: SparkSession, root: str, under: list[str] = (), use_git: bool = True) -> DataFrame:
    """(path, ordinal, mtime): the source files of a checkout, as git tracks them or, outside a work tree or for parts of it, as they lie there."""
    spark.dataSource.register(SourceTree)
    by_git = use_git and not under and git(root, "rev-parse", "--is-inside-work-tree") is not None
    options = {"root": os.path.abspath(root), "under": json.dumps(list(under)), "git": str(by_git).lower(), "parts": str(jobs(spark.conf.get("spark.navspark.jobs", None), spark.sparkContext.defaultParallelism))}
    listed = spark.read.format(NAME).options(**options).load()
    return listed.select("path", F.col("path").alias("ordinal"), "mtime")


def read_files(spark: SparkSession, root: str, listed: DataFrame, repository_id: int, needle: str | None = None) -> DataFrame:
    """(repository_id, path, language, mtime, content_hash, text) of listed files, opened where they are read, by their literal names; those that
    are gone, aren't UTF-8 or lack the needle, in any case of A-Z, go."""
    base, sought = os.path.abspath(root), (needle or "").encode().lower()

    def run(batches):
        for batch in batches:
            held, size = [], 0
            for path, mtime in zip(batch.column("path").to_pylist(), batch.column("mtime").to_pylist(), strict=True):
                try:
                    with open(os.path.join(base, path), "rb") as f:
                        raw = f.read()
                    text = raw.decode()
                except (OSError, UnicodeDecodeError):
                    continue
                if sought in raw.lower():
                    held.append((path, mtime, text))
                    size += len(raw)
                if size > BATCH_BYTES:
                    yield _batch(held)
                    held, size = [], 0
            yield _batch(held)

    found = listed.select("path", "mtime").mapInArrow(run, "path string, mtime long, text string")
    return found.select(F.lit(repository_id).cast("long").alias("repository_id"), "path", language_of(F.col("path")).alias("language"), "mtime", content_hash(F.col("text")).alias("content_hash"), "text")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["path", "mtime", "text"])


def extract_symbols(files: DataFrame) -> DataFrame:
    """The definitions of files (repository_id, path, language, text), by Arrow batch on the executors."""

    def run(batches):
        for batch in batches:
            rows = [
                (repo, path, s.name, s.kind, language, s.line, s.end_line, s.parent, s.visibility)
                for repo, path, language, text in zip(batch.repository_id, batch.path, batch.language, batch.text, strict=True)
                for s in extract(language, text)
            ]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PARSED_SYMBOL.split(", ")])

    return files.select("repository_id", "path", "language", "text").mapInPandas(run, PARSED_SYMBOL)


def live_symbols(spark: SparkSession, root: str, needle: str | None = None, skip: DataFrame | None = None, cap: int | None = None, query: str = "") -> DataFrame:
    """Definitions of files as they are now, nothing stored; paths in ``skip`` are left out. With ``cap`` only so many files are read."""
    listed = list_files(spark, root)
    listed = listed.join(skip.select("path"), "path", "left_anti") if skip is not None else listed
    listed = listed if cap is None else keep_under_cap(listed, shares_gram(F.col("path"), F.lit(query)), cap)
    return extract_symbols(read_files(spark, root, listed, -1, needle))


# ---- git


def repo_root(path: str) -> str | None:
    """The nearest folder at or above the path with .git in it."""
    for folder in (Path(path).resolve(), *Path(path).resolve().parents):
        if (folder / ".git").exists():
            return str(folder)
    return None


def git_head(root: str) -> str | None:
    return (git(root, "rev-parse", "HEAD") or "").strip() or None


def head_branch(root: str) -> str | None:
    """The branch that is checked out, None if HEAD is detached."""
    return (git(root, "symbolic-ref", "--short", "-q", "HEAD") or "").strip() or None


def is_trunk(branch: str | None) -> bool:
    return branch in TRUNKS


def trunk_ref(root: str) -> str:
    return "main" if git(root, "rev-parse", "--verify", "-q", "main") else "master"


def is_dirty(root: str) -> bool:
    return bool((git(root, "status", "--porcelain", "--untracked-files=no") or "").strip())


def branch_changed_files(root: str) -> list[str]:
    """Files that differ from the trunk on this branch, committed or not; none on a trunk or a detached HEAD."""
    branch = head_branch(root)
    if branch is None or is_trunk(branch):
        return []
    found = f"{git(root, 'diff', '--name-only', f'{trunk_ref(root)}...HEAD') or ''}\n{git(root, 'diff', '--name-only', 'HEAD') or ''}"
    return sorted({x for x in found.splitlines() if x})


def branch_stamp(root: str) -> str:
    """Changes when HEAD or the index do."""
    folder = (git(root, "rev-parse", "--absolute-git-dir") or "").strip()
    return ":".join(str((file_mtime(os.path.join(folder, f)) or 0) // 10**9) for f in ("HEAD", "index"))


def commit_log(spark: SparkSession, root: str, since: str | None = None) -> DataFrame:
    """(n, line) of the log of commit times and paths, newest first; all of the last 1,000 commits without ``since``."""
    span = [f"{since}..HEAD"] if since else []
    found = git(root, "log", "-n1000", "--name-only", "--pretty=format:%ct", *span) or ""
    return spark.createDataFrame(list(enumerate(found.splitlines())), "n long, line string")


def remote_url(root: str) -> str | None:
    for name in ("origin", "upstream"):
        url = (git(root, "remote", "get-url", name) or "").strip()
        if url:
            return url
    return None


def head_changed(stored: str | None, root: str) -> bool:
    return git_head(root) != stored


def keep_under_cap(listed: DataFrame, first: Column, cap: int) -> DataFrame:
    """The files of a bounded pass: those that ``first`` holds for, then the others in order."""
    return listed.orderBy(first.desc(), "ordinal").limit(cap)
