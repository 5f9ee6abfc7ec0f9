"""A data source over a folder of source files: each partition lists a share of the tree.

The driver looks at so many folders only as it needs to deal the tree out; names reach the plan from the partitions, and files are
opened by their literal names. The tree has to lie on a mount that all nodes have.
"""

from __future__ import annotations

import json
import os
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from navspark.schemas import LANGUAGES
from navspark.sources.ignore import Rule, fits_last, rules_of

NAME, SCHEMA = "navspark_tree", "path string, mtime long"
#: Rows of a batch.
ROWS = 4096
_EXTENSIONS = {e for many in LANGUAGES.values() for e in many}


def wanted(path: str) -> bool:
    """A file of a known language with a name that UTF-8 can hold."""
    try:
        path.encode()
    except UnicodeEncodeError:
        return False
    return path.rpartition(".")[2] in _EXTENSIONS and "." in os.path.basename(path)


def file_mtime(path: str) -> int | None:
    """Nanoseconds since 1970, None if the file is gone."""
    try:
        return os.stat(path).st_mtime_ns
    except OSError:
        return None


def entries(root: str, folder: str, rules: list[Rule]) -> tuple[list[str], list[str], list[Rule]]:
    """(files, folders, rules that hold below) of a folder, without hidden ones and those that ignore files name."""
    here = os.path.join(root, folder)
    try:
        found = sorted(os.scandir(here), key=lambda e: e.name)
    except OSError:
        return [], [], rules
    if any(e.name == ".gitignore" and e.is_file() for e in found):
        with open(os.path.join(here, ".gitignore"), errors="replace") as f:
            rules = rules + rules_of(f.read(), folder)
    files, folders = [], []
    for e in found:
        path = f"{folder}/{e.name}" if folder else e.name
        is_folder = e.is_dir(follow_symlinks=False)
        if e.name.startswith(".") or fits_last(rules, path, is_folder):
            continue
        if is_folder:
            folders.append(path)
        elif e.is_file() and wanted(path):
            files.append(path)
    return files, folders, rules


def walk(root: str, folder: str, rules: list[Rule]) -> Iterator[str]:
    pending = [(folder, rules)]
    while pending:
        files, folders, below = entries(root, *pending.pop())
        yield from files
        pending += [(f, below) for f in folders]


def tracked(root: str, folder: str) -> list[str]:
    """What git's index holds below a folder."""
    done = subprocess.run(["git", "-C", root, "ls-files", "-z", "--cached", "--", *([f":(literal){folder}/"] if folder else [])], capture_output=True)
    if done.returncode:  # an empty listing would make the catalog forget the files
        raise RuntimeError(f"git can't list {root}: {done.stderr.decode(errors='replace')}")
    return [p for p in dict.fromkeys(done.stdout.decode("utf-8", "surrogateescape").split("\0")) if p and wanted(p)]


@dataclass
class Share(InputPartition):
    """(folder, with all below it, rules from above) of the folders that a partition lists."""

    folders: list[tuple[str, bool, list[Rule]]]


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.git = options["root"], options.get("git") == "true"
        self.under, self.parts = json.loads(options.get("under", "[]")), int(options.get("parts", 8))

    def _folders(self, folder: str, rules: list[Rule]) -> tuple[list[str], list[Rule]]:
        if not self.git:
            return entries(self.root, folder, rules)[1:]
        try:  # git may track what is hidden or ignored
            return [f"{folder}/{e.name}" if folder else e.name for e in os.scandir(os.path.join(self.root, folder)) if e.is_dir(follow_symlinks=False) and e.name != ".git"], rules
        except OSError:
            return [], rules

    def partitions(self) -> list[Share]:
        starts = [os.path.relpath(u, self.root) if os.path.isabs(u) else u for u in self.under] or [""]
        deep: list[tuple[str, list[Rule]]] = [("" if s in (".", "") else s.rstrip("/"), []) for s in dict.fromkeys(starts)]
        out: list[tuple[str, bool, list[Rule]]] = []
        while deep and len(deep) < self.parts and len(out) < self.parts:
            folder, rules = deep.pop(0)
            out.append((folder, False, rules))
            folders, below = self._folders(folder, rules)
            deep += [(f, below) for f in folders]
        out += [(folder, True, rules) for folder, rules in deep]
        return [Share(out[k :: self.parts]) for k in range(min(self.parts, len(out)))] or [Share([])]

    def _paths(self, share: Share) -> Iterator[str]:
        for folder, deep, rules in share.folders:
            if self.git:
                yield from (p for p in tracked(self.root, folder) if deep or os.path.dirname(p) == folder)
            elif deep:
                yield from walk(self.root, folder, rules)
            else:
                yield from entries(self.root, folder, rules)[0]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        names, times = [], []
        for path in self._paths(partition):
            if (at := file_mtime(os.path.join(self.root, path))) is not None:
                names.append(path)
                times.append(at)
            if len(names) == ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(times, pa.int64())], ["path", "mtime"])
                names, times = [], []
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(times, pa.int64())], ["path", "mtime"])


class SourceTree(DataSource):
    """Options: root; under, a JSON list of parts of it; git, "true" to list what git tracks; parts, how many partitions to deal to."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))
