"""Table schemas, enumerations and scoring constants of the definition catalog."""

from __future__ import annotations

from pyspark.sql import types as T


def _table(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


#: Times are whole numbers: mtime in nanoseconds, everything else in seconds since 1970 (a TIMESTAMP would lose the nanoseconds).
TABLES: dict[str, str] = {
    "repositories": "id long, identity string, default_branch string, created_at long, updated_at long",
    "checkouts": "id long, repository_id long, root_path string, current_branch string",
    "files": "id long, repository_id long, path string, language string, mtime long, git_ts long, content_hash string, indexed_at long",
    "symbols": "id long, repository_id long, file_id long, name string, name_lower string, kind string, language string, line long, end_line long, parent string, visibility string, file string, mtime long, git_ts long",
    "grams": "repository_id long, gram string, text string, id long, file_id long, seq long",
    "coverage": "id long, repository_id long, scope string, files_seen long, files_indexed long, status string, last_indexed_at long",
    "events": "id long, type string, query string, repository_id long, path string, line long, branch string, ts long",
    "selection_stats": "repository_id long, query_norm string, file string, name string, selections long, last_selected_at long",
}
#: What the rows of a table's folder are sorted by.
SORTED_BY: dict[str, tuple[str, ...]] = {
    "repositories": ("identity",), "checkouts": ("root_path",), "files": ("path",), "symbols": ("name_lower",), "grams": ("gram",), "coverage": ("scope",), "events": ("id",),
    "selection_stats": ("query_norm",),
}
#: What an extractor gives for one file, and the row that recall and scoring work on.
SYMBOL = "name string, kind string, language string, file string, line int, end_line int, parent string, visibility string"
CANDIDATE = "id long, name string, name_lower string, kind string, language string, file string, line long, end_line long, parent string, repository_id long, mtime long, git_ts long, visibility string"
SCHEMA_VERSION = 10

KINDS = ("class", "module", "method", "function", "struct", "enum", "trait")
VISIBILITIES = ("public", "crate", "private", "protected")
#: In the order in which a prefix of a language name expands, with file extensions.
LANGUAGES: dict[str, tuple[str, ...]] = {
    "ruby": ("rb",),
    "rust": ("rs",),
    "go": ("go",),
    "python": ("py",),
    "typescript": ("ts", "mts", "cts", "tsx"),
    "javascript": ("js", "mjs", "cjs", "jsx"),
}
COVERAGE = ("never", "warming", "complete")
EVENT_TYPES = ("search", "open", "select")

#: Fixed values of the additive score.
EXACT, CASE, PREFIX, PREFIX_TAIL, FUZZY_CAP = 1000.0, 150.0, 700.0, 100, 600.0
PATH_WITH_NAME, PATH_WITH_NAME_CAP, PATH_ALONE, PATH_ALONE_CAP = 0.2, 50.0, 0.6, 300.0
PATH_ALONE_KINDS = ("class", "module", "struct", "enum", "trait")
PATH_RECALL_KINDS = ("class", "module")
PRIVATE, CURRENT_REPO = -15.0, 200.0
KIND_BONUS = {"class": 15.0, "struct": 15.0, "trait": 15.0, "module": 12.0, "enum": 12.0}
PARENT_BASE, PARENT_STEP, PARENT_CAP = 120.0, 60.0, 300.0
RECENCY, RECENCY_HALF_DAYS = 120.0, 14.0
LEARNED, LEARNED_FULL, LEARNED_HALF_DAYS = 260.0, 5, 30.0
BRANCH_FILE, BRANCH_DIR = 180.0, 60.0
SHOW_FROM = 0.85
#: Fixed values of the subsequence matcher.
MATCH, BOUNDARY, START, CONTIGUOUS, GAP, MAX_GAP = 10, 15, 20, 10, 3, 2


def struct(name: str) -> T.StructType:
    return _table(TABLES[name])
