"""The catalog's logical inputs over the benchmark tables, as SQL that Spark and DuckDB both run.

The tables hold no source code, so names, kinds, paths and so on are made from `part` and others by rule.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navspark.operators import gram_index
from navspark.store import CatalogStore

NOW = 1_700_000_000
_CAMEL = "concat(upper(substr(split_part(p_name, ' ', 1), 1, 1)), substr(split_part(p_name, ' ', 1), 2), upper(substr(split_part(p_name, ' ', 2), 1, 1)), substr(split_part(p_name, ' ', 2), 2))"
_TYPE = "concat(upper(substr(p_type, 1, 1)), lower(substr(p_type, 2)))"

SYMBOLS = f"""
SELECT id, name, lower(name) AS name_lower, kind, language, file, line, line + 5 AS end_line, parent, visibility, repository_id,
  CASE WHEN id % 4 = 1 THEN NULL ELSE ({NOW} - (id % 97) * 86400) * 1000000000 END AS mtime,
  CASE WHEN id % 3 = 1 THEN NULL ELSE {NOW} - (id % 61) * 86400 END AS git_ts
FROM (
  SELECT p_partkey AS id,
    CASE p_partkey % 3 WHEN 0 THEN replace(p_name, ' ', '_') WHEN 1 THEN {_CAMEL} ELSE concat({_CAMEL}, {_TYPE}) END AS name,
    CASE p_size % 7 WHEN 0 THEN 'class' WHEN 1 THEN 'module' WHEN 2 THEN 'method' WHEN 3 THEN 'function' WHEN 4 THEN 'struct' WHEN 5 THEN 'enum' ELSE 'trait' END AS kind,
    CASE p_size % 6 WHEN 0 THEN 'ruby' WHEN 1 THEN 'rust' WHEN 2 THEN 'go' WHEN 3 THEN 'python' WHEN 4 THEN 'typescript' ELSE 'javascript' END AS language,
    concat(CASE WHEN p_partkey % 11 = 0 THEN '' ELSE concat('src/', lower(p_type), '/') END, replace(p_name, ' ', '_'), '.',
      CASE p_size % 6 WHEN 0 THEN 'rb' WHEN 1 THEN 'rs' WHEN 2 THEN 'go' WHEN 3 THEN 'py' WHEN 4 THEN 'ts' ELSE 'js' END) AS file,
    CAST(p_size AS BIGINT) AS line,
    CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE concat('Mod', substr(p_brand, 7), '::', {_TYPE}) END AS parent,
    CASE p_partkey % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'private' WHEN 2 THEN 'protected' ELSE NULL END AS visibility,
    CAST(substr(p_brand, 7) AS BIGINT) AS repository_id
  FROM {{part}}
) t
"""
QUERIES = """
SELECT CAST(query_id AS BIGINT) AS query_id, query, CAST(repo AS BIGINT) AS current_repo_id FROM (VALUES
  (1, 'red', 3), (2, 'widget', 17), (3, 'RedWidget', 17), (4, 'Mod3::hotGear', 3), (5, 'r*d', 1), (6, 'rdwdg', 5), (7, 'small_ring', 2), (8, 'zzzqq', 2),
  (9, 'Mod17::Small::SmallRing', 17), (10, 'blt', 4), (11, 'Economy#BlueBolt', 4), (12, 'gea?', 9), (13, 'GIZMO', 25), (14, '::Ring', 8), (15, 'Foo::', 8), (16, 'hotgeareco', 3)
) AS v(query_id, query, repo)
"""
REPOSITORIES = """
SELECT DISTINCT CAST(substr(p_brand, 7) AS BIGINT) AS id, concat('github.com/acme/brand', substr(p_brand, 7)) AS identity, 'main' AS default_branch,
  CAST(1600000000 AS BIGINT) AS created_at, CAST(1600000000 AS BIGINT) AS updated_at FROM {part}
"""
FILES = """
SELECT min(id) AS id, repository_id, file AS path, min(language) AS language, max(mtime) AS mtime, max(git_ts) AS git_ts, md5(file) AS content_hash, CAST(1600000000 AS BIGINT) AS indexed_at
FROM ({symbols}) s GROUP BY repository_id, file
"""
#: Events of the catalog: clicks select, views open, all else searches; about every part in turn, whose keys are 1 to their number.
EVENTS = f"""
SELECT e.event_id + 1 AS id, CASE e.event_type WHEN 'click' THEN 'select' WHEN 'view' THEN 'open' ELSE 'search' END AS type,
  CASE WHEN e.event_id % 29 = 0 THEN NULL ELSE lower(substr(s.name, 1, CAST(2 + e.event_id % 6 AS INT))) END AS query,
  s.repository_id, s.file AS path, CASE WHEN e.event_id % 3 = 0 THEN NULL ELSE s.line + e.event_id % 4 - 1 END AS line, {NOW} - e.event_id * 600 AS ts
FROM (SELECT *, 1 + event_id % (SELECT count(*) FROM {{part}}) AS about FROM {{events}}) e JOIN ({{symbols}}) s ON e.about = s.id
"""

_C, _M = f"concat({_CAMEL}, CAST(p_partkey AS STRING))", "replace(p_name, ' ', '_')"
#: For each language a small file with a type and a function or two; %C is the type's name, %M the function's, %N a line's end.
TEMPLATES = {
    "ruby": "class %C%N  def %M%N    1%N  end%N%N  private%N%N  def %M_x%N  end%Nend%N",
    "python": "class %C:%N    def %M(self):%N        return 1%N%N%Ndef _%M():%N    pass%N",
    "go": "package p%N%Ntype %C struct {%N N int%N}%N%Nfunc (c *%C) Do%C() int {%N return 1%N}%N%Nfunc %M() {}%N",
    "rust": "pub struct %C {%N    n: u8,%N}%N%Nimpl %C {%N    pub fn %M(&self) -> u8 {%N        1%N    }%N}%N",
    "typescript": "export interface %C {%N  n: number;%N}%N%Nexport function %M(): number {%N  return 1;%N}%N",
    "javascript": "class %C {%N  %M() {%N    return 1;%N  }%N}%N%Nfunction %M_x() {}%N",
}
#: What is defined in them: name, kind, line, end_line, whether the type is its parent, visibility.
DEFINED = {
    "ruby": [("%C", "class", 1, 10, False, "public"), ("%M", "method", 2, 4, True, "public"), ("%M_x", "method", 8, 9, True, "private")],
    "python": [("%C", "class", 1, 3, False, "public"), ("%M", "method", 2, 3, True, "public"), ("_%M", "function", 6, 7, False, "private")],
    "go": [("%C", "struct", 3, 5, False, "public"), ("Do%C", "method", 7, 9, True, "public"), ("%M", "function", 11, 11, False, "private")],
    "rust": [("%C", "struct", 1, 3, False, "public"), ("%M", "method", 6, 8, True, "public")],
    "typescript": [("%C", "trait", 1, 3, False, "public"), ("%M", "function", 5, 7, False, "public")],
    "javascript": [("%C", "class", 1, 5, False, "private"), ("%M", "method", 2, 4, True, "public"), ("%M_x", "function", 7, 7, False, "private")],
}


def filled(template: str) -> str:
    """SQL for a template with a part's names in it."""
    return f"replace(replace(replace('{template}', '%C', {_C}), '%M', {_M}), '%N', chr(10))"


def sources(language: str) -> str:
    """One source file of a language for each part: repository_id, path, language, text."""
    return f"SELECT CAST(1 AS BIGINT) AS repository_id, CAST(p_partkey AS STRING) AS path, '{language}' AS language, {filled(TEMPLATES[language])} AS text FROM {{part}}"


def sql_of(view: str) -> str:
    """A view's SQL over the plain table names, for DuckDB."""
    return _fill(view, {"part": "part", "events": "events"})


def _fill(view: str, names: dict[str, str]) -> str:
    symbols = SYMBOLS.replace("{part}", names["part"])
    return view.replace("{symbols}", symbols).replace("{part}", names["part"]).replace("{events}", names["events"])


def view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A view as a DataFrame over the Parquet tables of ``sf_dir``."""
    names = {n: f"parquet.`{sf_dir}/{n}.parquet`" for n in ("part", "events")}
    return spark.sql(_fill(text, names))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that the cluster names in spark.checkpoint.dir, which only a local session may leave unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all nodes share")
        shared = f"file://{tempfile.gettempdir()}/navspark-scratch"
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_stores: dict[tuple, CatalogStore] = {}


def stored(spark: SparkSession, sf_dir: str) -> CatalogStore:
    """The catalog over the tables of ``sf_dir`` as a store, with its gram index; built once in an application, anew if the tables change."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/part.parquet")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    key = (spark.sparkContext.applicationId, sf_dir, fs.getFileStatus(at).getModificationTime(), fs.getContentSummary(at).getLength())
    if key not in _stores:
        store = CatalogStore(spark, scratch(spark, "catalog"))
        files = view(spark, sf_dir, FILES)
        ids = files.select("repository_id", F.col("path").alias("file"), F.col("id").alias("file_id"))
        symbols = view(spark, sf_dir, SYMBOLS).join(ids, ["repository_id", "file"])
        store.write({"repositories": view(spark, sf_dir, REPOSITORIES), "files": files, "symbols": symbols, "grams": gram_index.bulk(symbols)})
        _stores[key] = store
    return _stores[key]
