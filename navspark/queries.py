"""The registered catalog queries and their DuckDB oracles, side by side."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navspark import schemas as S
from navspark import views as V
from navspark.functions import textcols as X
from navspark.functions.matcher import match_column, positions_column
from navspark.operators import gram_index, learn, maintain, rank, recall, render
from navspark.operators import score as SC
from navspark.operators.prune import prune
from navspark.sources import files as files_source
from navspark.sources.ignore import is_ignored, rules_of
from navspark.store import CatalogStore

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Common table expressions that oracles build on.
_CTE = f"""
WITH syms AS ({V.sql_of(V.SYMBOLS)}), qs AS ({V.QUERIES}), repos AS ({V.sql_of(V.REPOSITORIES)}), files AS ({V.sql_of(V.FILES)}),
qp AS (SELECT *, CASE WHEN regexp_full_match(query, '.+(::|#).+', 's') AND NOT regexp_matches(query, '(::|#)$') THEN regexp_extract(query, '^(.+)(::|#)(.+)$', 3) ELSE query END AS leaf,
  CASE WHEN regexp_full_match(query, '.+(::|#).+', 's') AND NOT regexp_matches(query, '(::|#)$') THEN regexp_extract(query, '^(.+)(::|#)(.+)$', 1) END AS qualifier FROM qs),
qk AS (SELECT *, regexp_matches(leaf, '[*?.]') AS wild, {_LOWER.format("translate(leaf, '*?.', '')")} AS key FROM qp),
pairs AS (SELECT k.*, s.*, s.name_lower = key AS exact, starts_with(s.name_lower, key) AS prefix, starts_with(s.name_lower, substr(key, 1, 1)) AS first,
  coalesce(list_bool_or(list_transform(list_filter(list_transform(range(1, greatest(length(regexp_replace(key, '[^A-Za-z0-9_]', '', 'g')) - 1, 1)), lambda i: substr(regexp_replace(key, '[^A-Za-z0-9_]', '', 'g'), i, 3)), lambda g: length(g) = 3), lambda g: contains(s.name_lower, g))), false) AS tri,
  s.kind IN ('class', 'module') AND contains({_LOWER.format("s.file")}, key) AS inpath
  FROM qk k, syms s),
recalled AS (SELECT * FROM (SELECT *, bool_or(prefix) OVER (PARTITION BY query_id) AND NOT wild AS settled FROM pairs) t WHERE CASE WHEN settled THEN prefix ELSE prefix OR first OR tri OR inpath END)
"""


def query(sql: str | None = None):
    """Registers a query under its function's name, with the oracle's SQL if there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = _CTE + sql
        return f

    return add


#: The subsequence matcher as layered joins: for each letter of the query the best score at each place of the text.
_MATCH = f"""
, stems AS (SELECT *, regexp_replace(regexp_extract(file, '[^/]*$'), '^(.+)\\.[^.]*$', '\\1') AS stem FROM {{source}}),
texts AS (SELECT leaf, name AS t FROM stems UNION SELECT leaf, stem FROM stems),
ch AS (SELECT *, CAST(sum(b) OVER (PARTITION BY t ORDER BY i) AS BIGINT) AS ord FROM (SELECT t, i, {_LOWER.format("cur")} AS c,
    CASE WHEN i = 0 OR NOT regexp_matches(prev, '[A-Za-z0-9]') OR (regexp_matches(cur, '[A-Z]') AND (regexp_matches(prev, '[a-z]') OR (regexp_matches(prev, '[A-Z]') AND regexp_matches(nxt, '[a-z]')))) THEN 1 ELSE 0 END AS b
  FROM (SELECT t, i, substr(t, i + 1, 1) AS cur, substr(t, i, 1) AS prev, substr(t, i + 2, 1) AS nxt FROM (SELECT t, CAST(unnest(range(length(t))) AS INT) AS i FROM (SELECT DISTINCT t FROM texts) x) y) z) w),
al AS (SELECT leaf, t, {_LOWER.format("regexp_replace(leaf, '[^A-Za-z0-9]', '', 'g')")} AS wanted FROM texts WHERE NOT regexp_matches(leaf, '[*?.]')),
step AS (
  SELECT leaf, t, 1 AS k, i, 10 + 15 * b + CASE WHEN i = 0 THEN 20 ELSE 0 END AS s, ord, [i] AS places FROM al JOIN ch USING (t) WHERE c = substr(wanted, 1, 1)
  UNION ALL
  SELECT r.leaf, r.t, r.k + 1, h.i, max(r.s + CASE WHEN h.i = r.i + 1 THEN 10 ELSE -3 * (h.i - r.i - 1) END) + 10 + 15 * any_value(h.b), any_value(h.ord),
    arg_max(list_append(r.places, h.i), (r.s + CASE WHEN h.i = r.i + 1 THEN 10 ELSE -3 * (h.i - r.i - 1) END) * 1000 - r.i)
  FROM step r JOIN al USING (leaf, t) JOIN ch h ON h.t = r.t AND h.c = substr(al.wanted, r.k + 1, 1) AND h.i > r.i
    AND (h.i = r.i + 1 OR (h.ord - h.b - r.ord = 0 AND (h.i - r.i - 1 <= 2 OR h.b = 1)))
  GROUP BY r.leaf, r.t, r.k, h.i),
aligned AS (SELECT leaf, t, greatest(max(s), 0)::DOUBLE AS m, arg_max(places, s * 1000 + i) AS places FROM step JOIN al USING (leaf, t) WHERE k = length(wanted) GROUP BY ALL),
globs AS (
  SELECT leaf, t, CASE leaf WHEN 'r*d' THEN [length(regexp_extract(low, '^(.*?)r.*?d', 1)), length(regexp_extract(low, '^(.*?r.*?)d', 1))]
    ELSE list_transform(range(3), lambda x: length(regexp_extract(low, '^(.*?)gea.', 1)) + x) END AS places
  FROM (SELECT *, {_LOWER.format("t")} AS low FROM texts WHERE leaf IN ('r*d', 'gea?')) x WHERE regexp_matches(low, CASE leaf WHEN 'r*d' THEN 'r.*d' ELSE 'gea.' END)),
globbed AS (SELECT g.leaf, g.t, (sum(10 + 15 * h.b + CASE WHEN list_contains(g.places, h.i - 1) THEN 10 ELSE 0 END) + CASE WHEN min(h.i) = 0 THEN 20 ELSE 0 END)::DOUBLE AS m
  FROM globs g JOIN ch h ON h.t = g.t AND list_contains(g.places, h.i) GROUP BY g.leaf, g.t),
matched AS (SELECT leaf, t, m FROM aligned UNION ALL SELECT * FROM globbed)
"""
_ONE_LEAF = "(SELECT id, name, file, '{0}' AS leaf FROM syms)"


def _recursive(name: str, sql: str) -> None:
    """Registers an oracle with the matcher in it."""
    ORACLES[name] = _CTE.replace("WITH syms", "WITH RECURSIVE syms", 1) + sql


def _syms(spark, d):
    return V.view(spark, d, V.SYMBOLS)


def _stored(spark, d):
    """The symbols as a search reads them: stored, with their files' paths and times."""
    return V.stored(spark, d).read("symbols")


def _index(spark, d):
    return gram_index.searchable(V.stored(spark, d))


def _queries(spark, d):
    return recall.recall_queries(V.view(spark, d, V.QUERIES))


def _files(spark, d):
    return V.view(spark, d, V.FILES)


def _table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _now():
    return F.lit(V.NOW)


def _scored(spark, d, best: int | None = None):
    """The whole search: recall, boosts, score. Without files changed on a branch."""
    symbols, asked = _stored(spark, d), _queries(spark, d)
    boosts = SC.learned_boosts(_stats(spark, d), V.view(spark, d, V.QUERIES), _now()).withColumnRenamed("learned", "learned_value")
    asked = asked.withColumn("changed_files", F.array(F.lit("src/small/hot_gear.rb")))
    bare = recall.fitting(SC.prepare_pairs(symbols, asked, recall.recall_many(_index(spark, d), asked))).withColumn("now", _now())
    pairs = bare.join(boosts, ["query_id", "repository_id", "file", "name"], "left")
    return SC.score_values(pairs if best is None else prune(pairs, best, bare))


def _stats(spark, d):
    return learn.pick_counts(V.view(spark, d, V.EVENTS), _syms(spark, d))


# ---- recall


@query("SELECT query_id, id FROM pairs WHERE exact")
def recall_exact(spark, d):
    pairs = recall.strong_pairs(_index(spark, d), _queries(spark, d))
    both = SC.prepare_pairs(_syms(spark, d), _queries(spark, d), pairs)
    return both.filter(F.col("name_lower") == F.col("key")).select("query_id", "id")


@query("SELECT query_id, id FROM pairs WHERE prefix")
def recall_prefix(spark, d):
    return recall.strong_pairs(_index(spark, d), _queries(spark, d))


@query("SELECT id, name FROM syms WHERE starts_with(name_lower, 'h')")
def recall_first_char(spark, d):
    return _syms(spark, d).filter(recall.is_first_char(F.col("name_lower"), F.lit("Hot"))).select("id", "name")


@query("SELECT id, name FROM syms WHERE contains(name_lower, 'wid') OR contains(name_lower, 'idg') OR contains(name_lower, 'dge')")
def recall_trigram(spark, d):
    return _syms(spark, d).filter(recall.has_trigram(F.col("name_lower"), F.lit("Wi-dge"))).select("id", "name")


@query("SELECT id, file FROM syms WHERE kind IN ('class', 'module') AND contains(lower(file), 'small/')")
def recall_path(spark, d):
    return _syms(spark, d).filter(recall.in_path(F.col("file"), F.col("kind"), F.lit("Small/"))).select("id", "file")


@query("SELECT query_id, id FROM pairs WHERE key <> '' AND (first OR tri OR inpath)")
def recall_union(spark, d):
    return recall.broad_pairs(_index(spark, d), _queries(spark, d))


@query("SELECT query_id, id FROM recalled")
def recall_short_circuit(spark, d):
    return recall.recall_many(_index(spark, d), _queries(spark, d))


@query(
    "SELECT id, name FROM syms WHERE CASE WHEN (SELECT bool_or(starts_with(name_lower, 'redw')) FROM syms) THEN starts_with(name_lower, 'redw')"
    " ELSE starts_with(name_lower, 'r') OR contains(name_lower, 'red') OR contains(name_lower, 'edw') OR (kind IN ('class', 'module') AND contains(lower(file), 'redw')) END"
)
def recall_one_literal(spark, d):
    return recall.recall_one(_syms(spark, d), "redw").select("id", "name")


_SCOPED = "SELECT query_id, id FROM (SELECT *, bool_or(prefix) OVER (PARTITION BY query_id) AND NOT wild AS sure FROM pairs WHERE repository_id = current_repo_id) t WHERE CASE WHEN sure THEN prefix ELSE prefix OR first OR tri OR inpath END"


@query(_SCOPED)
def repo_scope(spark, d):
    """A search in one repository: what is a strong match elsewhere settles nothing here."""
    return recall.recall_many(_index(spark, d), _queries(spark, d), scoped=True)


@query("SELECT DISTINCT substr(name_lower, CAST(i AS INT), 3) AS gram, id FROM (SELECT *, unnest(range(1, length(name_lower) - 1)) AS i FROM syms) t")
def trigram_index(spark, d):
    held = _index(spark, d).filter(F.startswith("gram", F.lit(gram_index.ANYWHERE)))
    return held.select(F.substring("gram", 2, 3).alias("gram"), "id")


@query(
    "SELECT DISTINCT substr(low, CAST(i AS INT), 3) AS gram, id FROM (SELECT *, unnest(range(1, length(low) - 1)) AS i FROM"
    " (SELECT s.id, CASE WHEN f.id % 3 = 0 THEN concat(name_lower, '_new') ELSE name_lower END AS low FROM syms s JOIN files f ON f.repository_id = s.repository_id AND f.path = s.file WHERE f.id % 5 <> 0) x) t"
)
def gram_segments(spark, d):
    """The index after a later pass: every third file edited, every fifth one gone. Its segment holds those files' postings and tombstones only."""
    store = V.stored(spark, d)
    symbols, files = store.read("symbols"), store.read("files")
    edit = (F.col("id") % 3 == 0) & (F.col("id") % 5 != 0)
    after = files.filter("id % 5 <> 0").withColumn("content_hash", F.when(edit, F.md5("path")).otherwise(F.col("content_hash")))
    after = after.withColumn("content_hash", F.when(edit, F.concat("content_hash", F.lit("!"))).otherwise(F.col("content_hash")))
    changes = gram_index.changed(files, after)
    fresh = symbols.join(changes.filter("fresh"), "file_id", "left_semi").withColumn("name_lower", F.concat("name_lower", F.lit("_new")))
    none = F.lit(None).cast("string")
    dead = changes.filter("dead").select(F.lit(None).cast("long").alias("repository_id"), none.alias("gram"), none.alias("text"), F.lit(None).cast("long").alias("id"), "file_id")
    later = gram_index.postings(fresh).unionByName(dead).withColumn("seq", F.lit(1))
    held = gram_index.alive(store.read("grams").unionByName(later)).filter(F.startswith("gram", F.lit(gram_index.ANYWHERE)))
    return held.select(F.substring("gram", 2, 3).alias("gram"), "id")


# ---- text functions


#: What users type for a symbol: its name, or its scope and name, with a separator that ends or begins the query in some.
_TYPED = "CASE id % 5 WHEN 0 THEN name WHEN 1 THEN concat(parent, '::', name) WHEN 2 THEN concat(parent, '#', name) WHEN 3 THEN concat(name, '::') ELSE concat('#', name) END"


@query(
    "SELECT id, CASE WHEN parent IS NULL AND id % 5 IN (1, 2) THEN NULL WHEN id % 5 < 3 THEN name WHEN id % 5 = 3 THEN concat(name, '::') ELSE concat('#', name) END AS leaf,"
    " CASE WHEN id % 5 IN (1, 2) THEN parent END AS qualifier FROM syms"
)
def qualified_parse(spark, d):
    q = F.expr(_TYPED)
    return _syms(spark, d).select("id", X.query_leaf(q).alias("leaf"), X.query_qualifier(q).alias("qualifier"))


@query("SELECT id, array_to_string(list_filter(string_split_regex(lower(parent), '::|#'), lambda x: x <> ''), '|') AS parts FROM syms WHERE parent IS NOT NULL")
def scope_segments(spark, d):
    return _syms(spark, d).filter("parent IS NOT NULL").select("id", F.array_join(X.segments(F.col("parent")), "|").alias("parts"))


@query(
    "SELECT query_id, id, CASE WHEN lower(parent) = lower(replace(qualifier, '#', '::')) OR ends_with(lower(parent), '::' || lower(qualifier)) THEN least(120.0 + 60 * len(string_split(qualifier, '::')), 300.0)::DOUBLE END AS boost FROM qp, syms WHERE qualifier IS NOT NULL AND boost IS NOT NULL"
)
def parent_boost(spark, d):
    asked = V.view(spark, d, V.QUERIES).select("query_id", X.query_qualifier(F.col("query")).alias("q")).filter("q IS NOT NULL")
    last = lambda scope: F.element_at(X.segments(scope), -1)
    inside = _syms(spark, d).filter("parent IS NOT NULL").select("id", "parent", last(F.col("parent")).alias("last"))
    pairs = inside.join(asked.withColumn("last", last(F.col("q"))), "last")  # a parent that ends with the qualifier shares its last part
    return pairs.select("query_id", "id", X.parent_boost(F.col("q"), F.col("parent")).alias("boost")).filter("boost IS NOT NULL")


@query("SELECT page_id, regexp_replace(regexp_extract(url, '[^/\\\\]*$'), '^(.+)\\.[^.]*$', '\\1') AS stem, nullif(regexp_extract(url, '^(.*)/[^/]*$', 1, 's'), '') AS dir FROM pages")
def path_stem_and_dir(spark, d):
    url = F.col("url")
    return _table(spark, d, "pages").select("page_id", X.path_stem(url).alias("stem"), X.parent_dir(url).alias("dir"))


@query("SELECT id, file FROM syms WHERE starts_with(file, 'src/small/') OR file = 'hot_gear.rb'")
def path_filter(spark, d):
    return _syms(spark, d).filter(X.under_any(F.col("file"), ["./src/small/", "hot_gear.rb"])).select("id", "file")


@query("SELECT page_id, CASE WHEN contains(url, '://') THEN nullif(regexp_replace(concat(regexp_extract(url, '://([^/:@]+)', 1), '/', regexp_extract(url, '://[^/]+/+(.+)$', 1)), '(/+)$', ''), '/') END AS identity FROM pages")
def normalize_remote(spark, d):
    return _table(spark, d, "pages").select("page_id", X.normalize_remote(F.col("url")).alias("identity"))


_KINDS = "['f', 'Interface', 'type', 'mod', 'CLASS', 'widget', 'fn']", "['function', 'trait', 'struct', 'module', 'class', 'widget', 'function']"


@query(f"SELECT event_id, ({_KINDS[0]})[CAST(event_id % 7 AS INT) + 1] AS token, ({_KINDS[1]})[CAST(event_id % 7 AS INT) + 1] AS kind FROM events")
def kind_canonical(spark, d):
    tokens = F.array(*(F.lit(t) for t in ("f", "Interface", "type", "mod", "CLASS", "widget", "fn")))
    typed = _table(spark, d, "events").select("event_id", F.element_at(tokens, (F.col("event_id") % 7 + 1).cast("int")).alias("token"))
    return typed.select("event_id", "token", X.canonical_kind(F.col("token")).alias("kind"))


_LANGS = "[['ruby', 'rust'], ['typescript'], ['javascript'], ['cobol'], ['python'], ['go']]"


@query(f"SELECT event_id, unnest(({_LANGS})[CAST(event_id % 6 AS INT) + 1]) AS language FROM events")
def lang_expand(spark, d):
    tokens = F.array(*(F.lit(t) for t in ("r", "ts", "jsx", "COBOL", "py", "go")))
    typed = _table(spark, d, "events").select("event_id", F.element_at(tokens, (F.col("event_id") % 6 + 1).cast("int")).alias("token"))
    return typed.select("event_id", F.explode(X.canonical_langs(F.col("token"))).alias("language"))


@query("SELECT path, language FROM files")
def language_route(spark, d):
    return _files(spark, d).select("path", X.language_of(F.col("path")).alias("language"))


@query("SELECT doc_id, nullif(trim(string_split_regex(text, '\\r?\\n')[2], ' '), '') AS signature, array_to_string(string_split_regex(regexp_replace(text, '\\r?\\n$', ''), '\\r?\\n')[2:3], chr(10)) AS body FROM documents WHERE len(string_split_regex(regexp_replace(text, '\\r?\\n$', ''), '\\r?\\n')) >= 2")
def signature_and_body(spark, d):
    text = F.col("text")
    docs = _table(spark, d, "documents").select("doc_id", X.signature(text, F.lit(2)).alias("signature"), X.body_span(text, F.lit(2), F.lit(3)).alias("body"))
    return docs.filter("body IS NOT NULL")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'tion an')")
def content_prefilter(spark, d):
    return _table(spark, d, "documents").filter(maintain.content_prefilter(F.col("text"), F.lit("TION an"))).select("doc_id")


@query("SELECT path, regexp_matches(path, 'ring|gear|inge') AS first FROM files")
def path_priority(spark, d):
    files = _files(spark, d).withColumn("ordinal", F.col("id"))
    return maintain.prioritized(files, F.lit("ring_gear")).select("path", F.col("first"))


ORACLES["path_priority"] = _CTE + (
    "SELECT path, len(list_filter(['ring','ingg','ngge','ggea','gear'], lambda g: contains(replace(regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', ''), '_', ''), g))) > 0 AS first FROM files"
)


# ---- sources


def _extraction(language: str) -> None:
    """Registers a language's extractor over one file for each part."""

    def extracted(spark, d):
        return files_source.extract_symbols(V.view(spark, d, V.sources(language))).select("path", "name", "kind", "language", "line", "end_line", "parent", "visibility")

    QUERIES[f"extract_{language}"] = extracted
    ORACLES[f"extract_{language}"] = " UNION ALL ".join(
        f"SELECT CAST(p_partkey AS STRING) AS path, {V.filled(n)} AS name, '{k}' AS kind, '{language}' AS language, {a} AS line, {b} AS end_line, {V.filled('%C') if inside else 'NULL'} AS parent, '{v}' AS visibility FROM part"
        for n, k, a, b, inside, v in V.DEFINED[language]
    )


for _language in S.LANGUAGES:
    _extraction(_language)

#: Paths of the tree that `source_tree` writes, by a document's number: names that look like patterns, blanks, names that Spark's own readers hide, and what an ignore file names.
_ODD = "['[id]', '{a,b}', 'a b', '__init__', '*', 'é?']", "['tsx', 'rb', 'py', 'py', 'go', 'rs']"
_TREE_PATH = "concat(CASE WHEN doc_id % 11 = 0 THEN 'build/' WHEN doc_id % 13 = 0 THEN '.hidden/' ELSE concat('pages ', CAST(doc_id % 7 AS STRING), '/[lang]/') END, {0}, CAST(doc_id AS STRING), '.', {1})"


@query(
    "SELECT " + _TREE_PATH.format(*(f"({x})[CAST(doc_id % 6 AS INT) + 1]" for x in _ODD)) + " AS path, md5(coalesce(text, '')) AS content_hash,"
    " (['typescript', 'ruby', 'python', 'python', 'go', 'rust'])[CAST(doc_id % 6 AS INT) + 1] AS language FROM documents WHERE doc_id % 11 <> 0 AND doc_id % 13 <> 0 AND doc_id % 17 <> 0"
)
def source_tree(spark, d):
    """Documents written as source files, then listed and read by literal names. Every 17th is no UTF-8."""
    pick = lambda values: f"element_at(array({values[1:-1]}), CAST(doc_id % 6 AS INT) + 1)"
    root = V.scratch(spark, "tree").removeprefix("file://")
    rows = _table(spark, d, "documents").select(F.expr(_TREE_PATH.format(*map(pick, _ODD))).alias("path"), F.coalesce("text", F.lit("")).alias("text"), (F.col("doc_id") % 17 == 0).alias("broken"))

    def write(batches):
        for batch in batches:
            for path, text, broken in zip(*(batch.column(c).to_pylist() for c in ("path", "text", "broken")), strict=True):
                os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
                with open(f"{root}/{path}", "wb") as f:
                    f.write((b"\xff" if broken else b"") + text.encode())
            yield batch.select(["broken"])

    rows.mapInArrow(write, "broken boolean").write.format("noop").mode("overwrite").save()
    with open(f"{root}/.gitignore", "w") as f:
        f.write("build/\n")
    return files_source.read_files(spark, root, files_source.list_files(spark, root, use_git=False), 1).select("path", "content_hash", "language")


_RULES = "# comment\n*.py\n!src/small/**/red_*.py\n/src/standard*/\nsrc/**/hot_gear.*\n!blue_*\nsrc/promo/\n!src/promo/red_bolt.rb\n[g-h]*_ring.rs\n"


@query(
    """SELECT path, CASE WHEN starts_with(path, 'src/standard') OR starts_with(path, 'src/promo/') THEN true
  WHEN regexp_matches(base, '^[gh].*_ring[.]rs$') THEN true WHEN starts_with(base, 'blue_') THEN false
  WHEN starts_with(path, 'src/') AND starts_with(base, 'hot_gear.') THEN true
  WHEN starts_with(path, 'src/small/') AND starts_with(base, 'red_') AND ends_with(base, '.py') THEN false
  ELSE ends_with(base, '.py') END AS ignored FROM (SELECT *, regexp_extract(path, '[^/]*$') AS base FROM files) f"""
)
def ignored_paths(spark, d):
    """A file in a folder that is ignored stays so, whatever later rules say of it."""
    return _files(spark, d).select("path", is_ignored(F.col("path"), rules_of(_RULES)).alias("ignored"))


# ---- scoring


@query(
    "SELECT query_id, id, CASE WHEN NOT wild AND lower(name) = lower(leaf) THEN 1000.0::DOUBLE END AS exact, CASE WHEN NOT wild AND lower(name) = lower(leaf) AND name = leaf AND lower(leaf) <> leaf THEN 150.0::DOUBLE END AS case_match,"
    " CASE WHEN NOT wild AND starts_with(lower(name), lower(leaf)) AND lower(name) <> lower(leaf) THEN (700 - least(length(name) - length(leaf), 100))::DOUBLE END AS prefix,"
    " CASE WHEN visibility IN ('private', 'protected') THEN -15.0::DOUBLE END AS private, CASE WHEN kind IN ('class','struct','trait') THEN 15.0::DOUBLE WHEN kind IN ('module','enum') THEN 12.0::DOUBLE END AS kind_bonus,"
    " CASE WHEN repository_id = current_repo_id THEN 200.0::DOUBLE END AS current_repo FROM recalled"
)
def score_static(spark, d):
    symbols, asked = _stored(spark, d), _queries(spark, d)
    both = SC.prepare_pairs(symbols, asked, recall.recall_many(_index(spark, d), asked))
    name, leaf = F.col("name"), F.col("leaf")
    columns = {
        "exact": SC.exact(name, leaf), "case_match": SC.case_match(name, leaf), "prefix": SC.prefix(name, leaf), "private": SC.private(F.col("visibility")),
        "kind_bonus": X.kind_bonus(F.col("kind")), "current_repo": SC.current_repo(F.col("repository_id"), F.col("current_repo_id")),
    }
    return both.select("query_id", "id", *(c.cast("double").alias(n) for n, c in columns.items()))


_LATEST = "CASE WHEN git_ts IS NULL THEN mtime // 1000000000 WHEN mtime IS NULL THEN git_ts ELSE greatest(git_ts, mtime // 1000000000) END"
_RECENCY = f"120::DOUBLE * pow(0.5::DOUBLE, ({V.NOW} - {_LATEST}) / 86400::DOUBLE / 14::DOUBLE)"


@query(f"SELECT id, CASE WHEN {_RECENCY} >= 1 THEN round({_RECENCY}, 6) END AS recency FROM syms")
def recency(spark, d):
    return _syms(spark, d).select("id", F.round(SC.recency(F.col("git_ts"), F.col("mtime"), _now()), 6).alias("recency"))


@query("SELECT id, CASE WHEN file IN ('src/small/hot_gear.rb', 'red_ring.go') THEN 180.0::DOUBLE WHEN regexp_matches(file, '^src/small/[^/]*$') THEN 60.0::DOUBLE END AS boost FROM syms")
def branch_boost(spark, d):
    changed = F.array(F.lit("src/small/hot_gear.rb"), F.lit("red_ring.go"))
    return _syms(spark, d).select("id", SC.branch(F.col("file"), changed).alias("boost"))


@query()
def align_score(spark, d):
    pairs = _syms(spark, d).select("id", F.lit("rdwdg").alias("q"), "name")
    return pairs.select("id", match_column(F.col("q"), F.col("name"))["score"].alias("score")).filter("score IS NOT NULL")


_recursive("align_score", _MATCH.replace("{source}", _ONE_LEAF.format("rdwdg")) + "SELECT id, m AS score FROM syms JOIN aligned ON t = name")


@query("SELECT id, name FROM syms WHERE regexp_matches(lower(name), 'r.*d.g')")
def glob_match(spark, d):
    found = _syms(spark, d).withColumn("m", match_column(F.lit("r*d?g"), F.col("name")))
    native = F.regexp_like(X.ascii_lower(F.col("name")), X.glob_regex(F.lit("r*d?g")))
    return found.filter(F.col("m.score").isNotNull() & native).select("id", "name")


@query()
def highlight(spark, d):
    """Places that are worth showing, as text."""
    found = _syms(spark, d).select("id", positions_column(F.lit("RedWidget"), F.col("name")).alias("places")).filter(F.size("places") > 0)
    return found.select("id", F.array_join(F.transform("places", lambda x: x.cast("string")), ",").alias("places"))


_recursive(
    "highlight",
    _MATCH.replace("{source}", _ONE_LEAF.format("RedWidget"))
    + ", shown AS (SELECT s.id, list_filter(a.places, lambda x: list_contains(a.places, x - 1) OR list_contains(a.places, x + 1) OR list_contains(h.begins, x)) AS p"
    " FROM syms s JOIN aligned a ON a.t = s.name JOIN (SELECT t, list(i) FILTER (b = 1) AS begins FROM ch GROUP BY t) h ON h.t = s.name)"
    " SELECT id, array_to_string(p, ',') AS places FROM shown WHERE len(p) > 0",
)

#: A text with its places marked, told letter by letter.
_MARKED = "array_to_string(list_transform(range(length({t})), lambda i: concat(CASE WHEN list_contains({p}, i) AND NOT list_contains({p}, i - 1) THEN chr(27) || '[1m' ELSE '' END, substr({t}, i + 1, 1), CASE WHEN list_contains({p}, i) AND NOT list_contains({p}, i + 1) THEN chr(27) || '[0m' ELSE '' END)), '')"


@query()
def hit_marked(spark, d):
    """The text of every symbol with the places of a query in its name and file name marked."""
    return render.add_text(_syms(spark, d), F.lit("RedWidget"), "1").select("id", "text")


_recursive(
    "hit_marked",
    _MATCH.replace("{source}", _ONE_LEAF.format("RedWidget"))
    + ", shown AS (SELECT a.t, list_filter(a.places, lambda x: list_contains(a.places, x - 1) OR list_contains(a.places, x + 1) OR list_contains(h.begins, x)) AS p"
    " FROM aligned a JOIN (SELECT t, list(i) FILTER (b = 1) AS begins FROM ch GROUP BY t) h ON h.t = a.t),"
    " placed AS (SELECT s.*, coalesce(n.p, []) AS np, list_transform(coalesce(f.p, []), lambda x: x + length(s.file) - length(regexp_extract(s.file, '[^/]*$'))) AS fp"
    " FROM syms s JOIN stems st ON st.id = s.id LEFT JOIN shown n ON n.t = s.name LEFT JOIN shown f ON f.t = st.stem)"
    f" SELECT id, concat({_MARKED.format(t='file', p='fp')}, ':', line, '  ', kind, ' ', {_MARKED.format(t='name', p='np')}, CASE WHEN parent IS NULL THEN '' ELSE concat(' · ', parent) END) AS text FROM placed",
)


# ---- events


_ATTRIBUTED = f"""
, ev AS ({V.sql_of(V.EVENTS)}), att AS (
  SELECT e.*, (SELECT s.name FROM syms s WHERE s.repository_id = e.repository_id AND s.file = e.path AND
      CASE WHEN e.line IS NULL THEN s.kind IN ('class', 'module') ELSE s.line <= e.line END
    ORDER BY CASE WHEN e.line IS NULL THEN s.line ELSE -s.line END, s.name LIMIT 1) AS name
  FROM ev e WHERE e.type IN ('open', 'select') AND e.query IS NOT NULL AND e.repository_id IS NOT NULL AND e.path IS NOT NULL),
stats AS (SELECT repository_id, query AS query_norm, path AS file, name, count(*) AS selections, max(ts) AS last_selected_at FROM att WHERE name IS NOT NULL GROUP BY ALL)
"""


@query(_ATTRIBUTED + "SELECT id, name FROM att WHERE name IS NOT NULL")
def event_attribution(spark, d):
    return learn.attribute(V.view(spark, d, V.EVENTS).filter("type IN ('open', 'select')"), _syms(spark, d)).select("id", "name")


@query(_ATTRIBUTED + "SELECT * FROM stats")
def event_rollup(spark, d):
    return _stats(spark, d)


@query(_ATTRIBUTED + "SELECT repository_id, query_norm, file, name, selections * 2 AS selections, last_selected_at FROM stats")
def rollup_merge(spark, d):
    return learn.merge_counts(_stats(spark, d), _stats(spark, d))


@query(_ATTRIBUTED + "SELECT query_id, file, name, selections FROM qs JOIN stats ON starts_with(lower(query), query_norm)")
def selections_for(spark, d):
    return learn.selections_for(_stats(spark, d), V.view(spark, d, V.QUERIES)).select("query_id", "file", "name", "selections")


_WORTH = f"260::DOUBLE * least(selections, 5) / 5::DOUBLE * pow(0.5::DOUBLE, ({V.NOW} - last_selected_at) / 86400::DOUBLE / 30::DOUBLE)"


@query(_ATTRIBUTED + f"SELECT query_id, repository_id, file, name, round(max({_WORTH}), 6) AS learned FROM qs JOIN stats ON starts_with(lower(query), query_norm) GROUP BY ALL")
def learned(spark, d):
    boosts = SC.learned_boosts(_stats(spark, d), V.view(spark, d, V.QUERIES), _now())
    return boosts.select("query_id", "repository_id", "file", "name", F.round("learned", 6).alias("learned"))


@query(_ATTRIBUTED + "SELECT id FROM ev WHERE id > least(400, (SELECT max(id) FROM ev) - 100)")
def prune_events(spark, d):
    return learn.prune_events(V.view(spark, d, V.EVENTS), 400, 100).select("id")


@query(_ATTRIBUTED + "SELECT id, count(*) OVER () AS taken, max(id) OVER () AS mark FROM (SELECT id FROM ev WHERE id > 10 AND type IN ('open', 'select') ORDER BY id LIMIT 50) t")
def event_batch(spark, d):
    batch, taken, mark = learn.next_batch(V.view(spark, d, V.EVENTS), 10, 50)
    return batch.select("id", F.lit(taken).cast("long").alias("taken"), F.lit(mark).cast("long").alias("mark"))


@query(_ATTRIBUTED + "SELECT * FROM stats")
def event_fold(spark, d):
    """All events in three appended batches, the second of which is sent twice, folded batch by batch: each event counts once."""
    base = V.stored(spark, d)
    store = CatalogStore(spark, V.scratch(spark, "events"))
    fold = learn.EventLog(store, lambda repos: base.read("symbols", repos))
    events = V.view(spark, d, V.EVENTS).withColumn("branch", F.lit("main"))
    for number in (0, 1, 1, 2):
        fold.append(events.filter(F.col("id") % 3 == number), source="feed", version=number)
        fold.roll_up(size=None)
    return fold.picks()


# ---- maintenance


@query(
    "SELECT identity, CASE WHEN id <= 3 THEN 'dev' ELSE default_branch END AS default_branch, id FROM repos UNION ALL SELECT 'github.com/acme/new', NULL, (SELECT max(id) FROM repos) + 1"
)
def upsert_repository(spark, d):
    old = V.view(spark, d, V.REPOSITORIES)
    new = old.filter("id <= 5").select("identity", F.when(F.col("id") <= 3, "dev").alias("default_branch"))
    new = new.unionByName(spark.createDataFrame([("github.com/acme/new", None)], "identity string, default_branch string"))
    return maintain.upsert_repositories(old, new, V.NOW).select("identity", "default_branch", "id")


@query("SELECT id, id % 2 AS repository_id, concat('/src/', id) AS root_path, CASE WHEN id <= 4 THEN 'dev' ELSE 'main' END AS current_branch FROM repos")
def upsert_checkout(spark, d):
    old = V.view(spark, d, V.REPOSITORIES).select("id", (F.col("id") % 2).alias("repository_id"), F.concat(F.lit("/src/"), "id").alias("root_path"), F.lit("main").alias("current_branch"))
    return maintain.upsert_checkouts(old, old.filter("id <= 4").drop("id").withColumn("current_branch", F.lit("dev")))


def _parsed(spark, d):
    """All repositories' files as a later sweep would find them: every third one edited, every fifth one gone, one new."""
    files = _files(spark, d)
    later = files.filter("id % 5 <> 0").select(
        "repository_id", "path", "language", F.lit(1).cast("long").alias("mtime"), F.when(F.col("id") % 3 == 0, F.md5(F.concat("path", F.lit("!")))).otherwise(F.col("content_hash")).alias("content_hash")
    )
    return later.unionByName(spark.createDataFrame([(1, "new.rb", "ruby", 1, "x")], later.schema))


@query("SELECT repository_id, path, CASE WHEN id % 3 = 0 THEN 'changed' ELSE 'same' END AS status FROM files WHERE id % 5 <> 0 UNION ALL SELECT 1, 'new.rb', 'new'")
def incremental_diff(spark, d):
    return maintain.changed_files(_files(spark, d), _parsed(spark, d)).select("repository_id", "path", "status")


@query("SELECT repository_id, path FROM files WHERE mtime IS NULL OR id % 2 = 1")
def mtime_skip(spark, d):
    files = _files(spark, d)
    seen = files.select("repository_id", "path", (F.col("mtime") + F.col("id") % 2).alias("mtime"))
    return maintain.to_parse(files, seen).select("repository_id", "path")


@query("SELECT repository_id, path FROM files WHERE id % 5 = 0")
def reconcile_deletes(spark, d):
    return maintain.reconcile(_files(spark, d), _parsed(spark, d))


@query(
    "SELECT s.repository_id, s.file AS path, s.name, s.line, f.id AS file_id, CASE WHEN f.id % 5 = 0 THEN f.indexed_at ELSE 1700000000 END AS indexed_at"
    " FROM syms s JOIN files f ON f.repository_id = s.repository_id AND f.path = s.file WHERE f.id % 3 <> 0 OR f.id % 5 = 0"
    " UNION ALL SELECT 1, 'new.rb', 'Fresh', 7, NULL, 1700000000"
)
def replace_files(spark, d):
    files, symbols = _files(spark, d), _syms(spark, d)
    ids = files.select("repository_id", F.col("path").alias("file"), F.col("id").alias("file_id"))
    stored = symbols.join(ids, ["repository_id", "file"]).select(*(f.name for f in S.struct("symbols").fields))
    fresh = spark.createDataFrame([(1, "new.rb", "Fresh", "class", "ruby", 7, 9, None, None)], "repository_id long, path string, name string, kind string, language string, line long, end_line long, parent string, visibility string")
    new_files, new_symbols = maintain.replace_files(files, stored, _parsed(spark, d), fresh, V.NOW)
    both = new_symbols.drop("repository_id").join(new_files.select(F.col("id").alias("file_id"), "repository_id", "path", "indexed_at"), "file_id")
    file_id = F.when(F.col("path") != "new.rb", F.col("file_id")).alias("file_id")  # a new file's id is a hash
    return both.select("repository_id", "path", "name", "line", file_id, "indexed_at")


@query("SELECT f.repository_id, f.path, CASE WHEN f.id % 2 = 0 THEN 5 ELSE f.git_ts END AS git_ts FROM files f")
def set_git_times(spark, d):
    files = _files(spark, d)
    return maintain.set_git_times(files, files.filter("id % 2 = 0").select("repository_id", "path", F.lit(5).cast("long").alias("ts"))).select("repository_id", "path", "git_ts")


@query("SELECT repository_id, path FROM files WHERE id % 5 <> 0")
def forget_files(spark, d):
    files = _files(spark, d)
    symbols = _syms(spark, d).withColumn("file_id", F.col("id"))
    return maintain.forget_files(files, symbols, files.filter("id % 5 = 0").select("repository_id", "path"))[0].select("repository_id", "path")


@query("SELECT 'repositories' AS name, (SELECT count(*) FROM repos WHERE id <> 7) AS n UNION ALL SELECT 'symbols', (SELECT count(*) FROM syms WHERE repository_id <> 7) UNION ALL SELECT 'files', (SELECT count(*) FROM files WHERE repository_id <> 7)")
def drop_repository(spark, d):
    left = maintain.drop_repository({"repositories": V.view(spark, d, V.REPOSITORIES), "symbols": _syms(spark, d), "files": _files(spark, d)}, 7)
    counts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n, t in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query(
    "SELECT k AS event_id, a, b, c, d, e, (a AND b AND NOT (c AND d AND e)) AS finalize, CASE WHEN a AND b AND NOT (c AND d AND e) THEN 'complete' ELSE 'warming' END AS status FROM"
    " (SELECT k, k % 2 = 1 AS a, k // 2 % 2 = 1 AS b, k // 4 % 2 = 1 AS c, k // 8 % 2 = 1 AS d, k // 16 % 2 = 1 AS e FROM (SELECT event_id AS k FROM events) t)"
)
def sweep_outcome(spark, d):
    """All combinations, as the bits of an event's number."""
    bits = _table(spark, d, "events").select("event_id", *((F.floor(F.col("event_id") / (1 << k)) % 2 == 1).alias(n) for k, n in enumerate("abcde")))
    return bits.select("*", maintain.sweep_outcome(*(F.col(n) for n in "abcde")).alias("o")).select("event_id", *"abcde", "o.finalize", "o.status")


def _coverage(spark, d):
    repos = V.view(spark, d, V.REPOSITORIES).filter("id % 3 <> 0")
    return repos.select("id", F.col("id").alias("repository_id"), F.lit("full").alias("scope"), F.when(F.col("id") % 3 == 1, "complete").otherwise("warming").alias("status"))


@query(
    "SELECT identity AS repo, CASE id % 3 WHEN 0 THEN 'never' WHEN 1 THEN 'complete' ELSE 'warming' END AS status, (SELECT count(*) FROM files f WHERE f.repository_id = r.id) AS files, (SELECT count(*) FROM syms s WHERE s.repository_id = r.id) AS symbols FROM repos r"
)
def coverage_overview(spark, d):
    return maintain.coverage_overview(V.view(spark, d, V.REPOSITORIES), _coverage(spark, d), _files(spark, d), _syms(spark, d))


@query("SELECT (SELECT count(*) FROM files WHERE repository_id = 4) AS files, (SELECT count(*) FROM syms WHERE repository_id = 4) AS symbols")
def repo_totals(spark, d):
    which = lambda t, files: t.filter("repository_id = 4").select(F.lit(files).alias("of_files"))
    both = which(_files(spark, d), 1).unionByName(which(_syms(spark, d), 0))
    return both.agg(F.coalesce(F.sum("of_files"), F.lit(0)).alias("files"), F.coalesce(F.sum(1 - F.col("of_files")), F.lit(0)).alias("symbols"))


@query("SELECT name, line, kind FROM syms WHERE repository_id = 3 AND starts_with(file, 'src/small/') AND file = (SELECT min(file) FROM syms WHERE repository_id = 3 AND starts_with(file, 'src/small/'))")
def outline(spark, d):
    symbols = _syms(spark, d)
    path = symbols.filter("repository_id = 3 AND file LIKE 'src/small/%'").agg(F.min("file").alias("f")).first().f
    return maintain.outline(symbols, 3, path).select("name", "line", "kind")


@query("SELECT doc_id, md5(text) AS content_hash FROM documents")
def content_hash(spark, d):
    return _table(spark, d, "documents").select("doc_id", maintain.hashed(F.col("text")).alias("content_hash"))


@query(
    "SELECT file AS path, max(ts) AS ts FROM (SELECT file, 1000000 - 10 * (id % 50) AS ts FROM syms) t GROUP BY file"
)
def git_log_latest(spark, d):
    """A log of 50 commits, each with a line for its time and one for each of its files, blocks of lines apart."""
    rows = _syms(spark, d).select("file", (F.col("id") % 50).alias("commit"), "id")
    size = rows.agg(F.max("id").alias("n")).first().n + 2
    times = rows.select("commit").distinct().select((F.col("commit") * size).alias("n"), (1_000_000 - 10 * F.col("commit")).cast("string").alias("line"))
    paths = rows.select((F.col("commit") * size + F.col("id")).alias("n"), F.col("file").alias("line"))
    return maintain.latest_commit_times(times.unionByName(paths))


# ---- ranking


_STATIC = """, feats AS (
  SELECT r.*, CASE WHEN lower(name) = lower(leaf) THEN 1000 ELSE 700 - least(length(name) - length(leaf), 100) END
    + CASE WHEN name = leaf AND lower(leaf) <> leaf THEN 150 ELSE 0 END + CASE WHEN visibility IN ('private', 'protected') THEN -15 ELSE 0 END
    + CASE WHEN kind IN ('class', 'struct', 'trait') THEN 15 WHEN kind IN ('module', 'enum') THEN 12 ELSE 0 END + CASE WHEN repository_id = current_repo_id THEN 200 ELSE 0 END AS score,
    lower(name) = lower(leaf) AS is_exact
  FROM recalled r WHERE prefix AND NOT wild),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, strlen(name), name, file, line, id) AS rank FROM feats)
"""


def _static_hits(spark, d):
    """Strong candidates with the features that need no matcher."""
    symbols, asked = _stored(spark, d), _queries(spark, d).filter("NOT force_fuzzy")
    both = SC.prepare_pairs(symbols, asked, recall.strong_pairs(_index(spark, d), asked))
    name, leaf = F.col("name"), F.col("leaf")
    values = {
        "exact": SC.exact(name, leaf), "prefix": SC.prefix(name, leaf), "case": SC.case_match(name, leaf), "private": SC.private(F.col("visibility")),
        "kind": X.kind_bonus(F.col("kind")), "current_repo": SC.current_repo(F.col("repository_id"), F.col("current_repo_id")),
    }
    features = F.array(*(F.struct(F.lit(n).alias("name"), c.cast("double").alias("value")) for n, c in values.items()))
    total = sum((F.coalesce(c, F.lit(0.0)) for c in values.values()), F.lit(0.0))
    return both.withColumn("features", F.filter(features, lambda s: s["value"].isNotNull())).withColumn("score", total)


@query(_STATIC + "SELECT query_id, rank, name, file, line, score::DOUBLE AS score FROM ranked WHERE rank <= 10")
def rank_topk(spark, d):
    return rank.top_k(_static_hits(spark, d), 10).select("query_id", F.col("rank").cast("long").alias("rank"), "name", "file", "line", "score")


@query(_STATIC + "SELECT query_id, id, is_exact FROM (SELECT *, bool_or(is_exact) OVER (PARTITION BY query_id) AS any_in FROM feats) t WHERE is_exact OR NOT any_in")
def relevance_gate(spark, d):
    hits = _static_hits(spark, d)
    exact_only = hits.withColumn("features", F.filter("features", lambda s: s["name"] != "prefix"))
    return rank.relevance_gate(exact_only).select("query_id", "id", rank.has_feature("exact").alias("is_exact"))


@query(
    _STATIC + "SELECT query_id, id FROM (SELECT *, starts_with(coalesce(parent, ''), 'Mod17') AS inside, bool_or(starts_with(coalesce(parent, ''), 'Mod17')) OVER (PARTITION BY query_id) AS any_in FROM feats) t WHERE inside OR NOT any_in"
)
def scope_gate(spark, d):
    inside = F.startswith(F.coalesce("parent", F.lit("")), F.lit("Mod17"))
    hits = _static_hits(spark, d).withColumn("features", F.when(inside, F.array(F.struct(F.lit("parent").alias("name"), F.lit(180.0).alias("value")))).otherwise(F.filter("features", lambda s: s["name"] != "parent")))
    return rank.scope_gate(hits).select("query_id", "id")


@query(_STATIC + "SELECT query_id, id FROM feats WHERE starts_with(file, 'src/small/') AND kind IN ('class', 'method') AND language IN ('ruby', 'go', 'rust')")
def post_filters(spark, d):
    return rank.post_filter(_static_hits(spark, d), ["src/small"], ["class", "method"], ["ruby", "go", "rust"]).select("query_id", "id")


_CONFIDENCE = """SELECT query_id, id, floor(CASE WHEN is_exact THEN 1::DOUBLE ELSE 0.9::DOUBLE END *
  CASE WHEN other IS NULL THEN 1::DOUBLE WHEN score <= 0 THEN 0.5::DOUBLE ELSE least(greatest(0.5::DOUBLE + 3::DOUBLE * (score - other) / score, 0::DOUBLE), 1::DOUBLE) END * 100::DOUBLE + 0.5::DOUBLE) / 100::DOUBLE AS confidence
FROM (SELECT *, CASE WHEN score = nth_value(score, 1) OVER w THEN nth_value(score, 2) OVER w ELSE nth_value(score, 1) OVER w END AS other FROM feats
  WINDOW w AS (PARTITION BY query_id ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) t"""


@query(_STATIC + _CONFIDENCE)
def confidence(spark, d):
    return rank.attach_confidence(_static_hits(spark, d)).select("query_id", "id", "confidence")


@query(_STATIC + f"SELECT query_id, id, confidence >= 0.85 AS shown FROM ({_CONFIDENCE}) t")
def show_gate(spark, d):
    return rank.attach_confidence(_static_hits(spark, d)).select("query_id", "id", (F.col("confidence") >= S.SHOW_FROM).alias("shown"))


@query(
    _STATIC + "SELECT query_id, file, line, name, max(score + CASE WHEN part = 2 THEN 5 ELSE 0 END)::DOUBLE AS score FROM (SELECT *, 1 AS part FROM feats WHERE id % 3 <> 0 UNION ALL SELECT *, 2 FROM feats WHERE id % 3 <> 1) t GROUP BY ALL"
)
def merge_results(spark, d):
    hits = _static_hits(spark, d)
    second = hits.filter("id % 3 <> 1").withColumn("score", F.col("score") + 5)
    return rank.merge(hits.filter("id % 3 <> 0"), second).select("query_id", "file", "line", "name", "score")


@query(_STATIC + "SELECT query_id, id, concat(file, ':', line, '  ', kind, ' ', name, CASE WHEN parent IS NULL THEN '' ELSE concat(' · ', parent) END) AS text FROM feats")
def hit_text(spark, d):
    return _static_hits(spark, d).select("query_id", "id", rank.hit_text().alias("text"))


@query(
    _STATIC + """SELECT query_id, concat('{"name":"', name, '","kind":"', kind, '","language":"', language, '","file":"', file, '","line":', line, ',"end_line":', end_line,
  CASE WHEN parent IS NULL THEN '' ELSE concat(',"parent":"', parent, '"') END, CASE WHEN visibility IS NULL THEN '' ELSE concat(',"visibility":"', visibility, '"') END, ',"features":[',
  array_to_string(list_filter([CASE WHEN is_exact THEN '"exact"' ELSE '"prefix"' END, CASE WHEN name = leaf AND lower(leaf) <> leaf THEN '"case"' END, CASE WHEN visibility IN ('private', 'protected') THEN '"private"' END,
    CASE WHEN kind IN ('class', 'struct', 'trait', 'module', 'enum') THEN '"kind"' END, CASE WHEN repository_id = current_repo_id THEN '"current_repo"' END], lambda x: x IS NOT NULL), ','), ']}') AS json FROM feats"""
)
def hit_json(spark, d):
    return _static_hits(spark, d).select("query_id", rank.hit_json(["name", "kind", "language", "file", "line", "end_line", "parent", "visibility", "features"]).alias("json"))


@query(
    _STATIC + f"""SELECT f.query_id, f.id, concat('confidence ', printf('%.2f', c.confidence), ' · score ', f.score::BIGINT, ' = ', array_to_string(list_filter([
    CASE WHEN is_exact THEN 'exact 1000' ELSE concat('prefix ', 700 - least(length(name) - length(leaf), 100)) END, CASE WHEN name = leaf AND lower(leaf) <> leaf THEN 'case 150' END,
    CASE WHEN visibility IN ('private', 'protected') THEN 'private -15' END, CASE WHEN kind IN ('class', 'struct', 'trait') THEN 'kind 15' WHEN kind IN ('module', 'enum') THEN 'kind 12' END,
    CASE WHEN repository_id = current_repo_id THEN 'current_repo 200' END], lambda x: x IS NOT NULL), ' + ')) AS text FROM feats f JOIN ({_CONFIDENCE}) c USING (query_id, id)"""
)
def hit_explain(spark, d):
    order = {n: k for k, n in enumerate(("exact", "prefix", "case", "private", "kind", "current_repo"))}
    place = lambda s: F.create_map(*(F.lit(x) for pair in order.items() for x in pair))[s["name"]]
    listed = F.array_sort("features", lambda a, b: place(a) - place(b))
    return rank.attach_confidence(_static_hits(spark, d)).withColumn("features", listed).select("query_id", "id", render.explanation().alias("text"))


@query(
    _STATIC + """SELECT query_id, count(*) AS hits, concat('[', string_agg(concat(' {', chr(10), '  "name" : "', name, '",', chr(10), '  "file" : "', file, '",', chr(10), '  "line" : ', line,
    CASE WHEN parent IS NULL THEN '' ELSE concat(',', chr(10), '  "parent" : "', parent, '"') END, chr(10), '}'), ',' ORDER BY rank), ' ]') AS json FROM ranked WHERE rank <= 10 GROUP BY query_id"""
)
def hit_page(spark, d):
    """Each query's page as one array of JSON."""
    page = rank.top_k(_static_hits(spark, d), 10)
    return render.page_json(page, ["name", "file", "line", "parent"]).join(page.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits")), "query_id")


@query(
    "SELECT query_id, hits, CASE WHEN query_id % 5 = 0 THEN 'interrupted' WHEN query_id % 2 = 0 THEN 'warming' ELSE 'no_match' END AS status,"
    " CASE WHEN hits > 0 THEN 0 WHEN query_id % 5 <> 0 AND query_id % 2 = 1 THEN 1 ELSE 2 END AS code FROM (SELECT q.query_id, count(r.id) AS hits FROM qs q LEFT JOIN recalled r USING (query_id) GROUP BY ALL) t"
)
def miss_status(spark, d):
    found = recall.recall_many(_index(spark, d), _queries(spark, d)).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    rows = V.view(spark, d, V.QUERIES).join(found, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("hits"))
    status = rank.miss_status(F.col("query_id") % 2 != 0, F.col("query_id") % 5 == 0)
    return rows.select("query_id", "hits", status.alias("status"), rank.exit_code(F.col("hits"), status).alias("code"))


#: The score of each candidate from its parts, in the order in which they are added up.
_SCORED = f"""
, parts AS (SELECT st.*, n.m AS name_score, p.m AS path_score, lower(st.name) = lower(st.leaf) AND NOT wild AS is_exact, NOT wild AND starts_with(lower(st.name), lower(st.leaf)) AS begins,
    coalesce(nullif(regexp_extract(file, '^(.*)/[^/]*$', 1), ''), '') AS dir, {_LATEST} AS latest
  FROM stems st LEFT JOIN matched n ON n.leaf = st.leaf AND n.t = st.name LEFT JOIN matched p ON p.leaf = st.leaf AND p.t = st.stem),
valued AS (SELECT *, CASE WHEN is_exact THEN 1000::DOUBLE END AS f1, CASE WHEN is_exact AND name = leaf AND lower(leaf) <> leaf THEN 150::DOUBLE END AS f2,
  CASE WHEN begins AND NOT is_exact THEN (700 - least(length(name) - length(leaf), 100))::DOUBLE END AS f3, CASE WHEN NOT wild AND NOT begins AND name_score IS NOT NULL THEN least(name_score, 600) END AS f4, CASE WHEN wild AND name_score IS NOT NULL THEN least(name_score, 600) END AS f5,
  CASE WHEN begins OR name_score IS NOT NULL THEN CASE WHEN path_score IS NOT NULL THEN least(path_score * 0.2::DOUBLE, 50) END
    WHEN kind IN ('class', 'module', 'struct', 'enum', 'trait') AND path_score IS NOT NULL THEN least(path_score * 0.6::DOUBLE, 300) END AS f6,
  CASE WHEN visibility IN ('private', 'protected') THEN -15::DOUBLE END AS f7, CASE WHEN kind IN ('class', 'struct', 'trait') THEN 15::DOUBLE WHEN kind IN ('module', 'enum') THEN 12::DOUBLE END AS f8,
  CASE WHEN lower(parent) = lower(replace(qualifier, '#', '::')) OR ends_with(lower(parent), '::' || lower(qualifier)) THEN least(120 + 60 * len(string_split(qualifier, '::')), 300)::DOUBLE END AS f9,
  CASE WHEN repository_id = current_repo_id THEN 200::DOUBLE END AS f10, {{boosts}}
  FROM parts p {{learned}}),
found AS (SELECT *, {" + ".join(f"coalesce(f{k}, 0::DOUBLE)" for k in range(1, 14))} AS score FROM valued WHERE coalesce(f1, f3, f4, f5, f6) IS NOT NULL)
"""
_BOOSTS = f"""CASE WHEN boost.learned > 0 THEN boost.learned END AS f11,
  CASE WHEN 120::DOUBLE * pow(0.5::DOUBLE, ({V.NOW} - latest) / 86400::DOUBLE / 14::DOUBLE) >= 1 THEN 120::DOUBLE * pow(0.5::DOUBLE, ({V.NOW} - latest) / 86400::DOUBLE / 14::DOUBLE) END AS f12,
  CASE WHEN file = 'src/small/hot_gear.rb' THEN 180::DOUBLE WHEN dir = 'src/small' THEN 60::DOUBLE END AS f13"""
_LEARNED = f"LEFT JOIN (SELECT query_id, repository_id, file, name, max({_WORTH}) AS learned FROM qs JOIN stats ON starts_with(lower(query), query_norm) GROUP BY ALL) boost USING (query_id, repository_id, file, name)"
_PLACE = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, strlen(name), name, file, line)"


@query()
def search_many(spark, d):
    """The flagship: a batch of queries through recall, score, top 10, gates and confidence."""
    return _answers(_scored(spark, d))


@query()
def search_pruned(spark, d):
    """The same answers, with candidates that cannot be among the ten best dropped before the matcher."""
    return _answers(_scored(spark, d, 10))


def _answers(scored):
    hits = rank.attach_confidence(rank.scope_gate(rank.relevance_gate(SC.list_features(rank.top_k(scored, 10)))))
    features = F.array_join(F.transform("features", lambda s: s["name"]), ",").alias("features")
    return hits.select("query_id", F.col("rank").cast("long").alias("rank"), "name", "kind", "file", "line", F.round("score", 6).alias("score"), "confidence", features)


_recursive(
    "search_many",
    _ATTRIBUTED
    + _MATCH.replace("{source}", "recalled")
    + _SCORED.replace("{boosts}", _BOOSTS).replace("{learned}", _LEARNED)
    + f""", ten AS (SELECT * FROM (SELECT *, {_PLACE} AS rank FROM found) t WHERE rank <= 10),
near AS (SELECT * FROM (SELECT *, bool_or(begins) OVER (PARTITION BY query_id) AS any_near FROM ten) t WHERE begins OR NOT any_near),
scoped AS (SELECT * FROM (SELECT *, bool_or(f9 IS NOT NULL) OVER (PARTITION BY query_id) AS any_in FROM near) t WHERE f9 IS NOT NULL OR NOT any_in),
rivals AS (SELECT *, CASE WHEN score = nth_value(score, 1) OVER w THEN nth_value(score, 2) OVER w ELSE nth_value(score, 1) OVER w END AS other FROM scoped
  WINDOW w AS (PARTITION BY query_id ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT query_id, rank, name, kind, file, line, round(score, 6) AS score,
  floor(CASE WHEN f1 IS NOT NULL THEN 1::DOUBLE WHEN f3 IS NOT NULL THEN 0.9::DOUBLE WHEN f5 IS NOT NULL THEN 0.7::DOUBLE WHEN f4 IS NOT NULL THEN least(greatest(0.3::DOUBLE + 0.35::DOUBLE * f4 / 600::DOUBLE, 0.3::DOUBLE), 0.65::DOUBLE) ELSE 0.25::DOUBLE END
    * CASE WHEN other IS NULL THEN 1::DOUBLE WHEN score <= 0 THEN 0.5::DOUBLE ELSE least(greatest(0.5::DOUBLE + 3::DOUBLE * (score - other) / score, 0::DOUBLE), 1::DOUBLE) END * 100::DOUBLE + 0.5::DOUBLE) / 100::DOUBLE AS confidence,
  array_to_string(list_transform(list_sort(list_filter([{", ".join(f"{{'v': f{k}, 'k': -{k}, 'n': '{n}'}}" for k, n in enumerate(SC.FEATURES, 1))}], lambda x: x.v IS NOT NULL), 'DESC'), lambda x: x.n), ',') AS features
FROM rivals""",
)

ORACLES["search_pruned"] = ORACLES["search_many"]


@query()
def live_search(spark, d):
    """Rows that are in no catalog through the same scorer, without boosts, after the content test."""
    none = F.lit(None).cast("long")
    symbols = _syms(spark, d).filter(maintain.content_prefilter(F.col("name"), F.lit("gear"))).withColumns({"repository_id": F.lit(-1).cast("long"), "git_ts": none, "mtime": none})
    asked = recall.recall_queries(spark.createDataFrame([(1, "hotgear", -1, [])], "query_id long, query string, current_repo_id long, changed_files array<string>"))
    pairs = SC.prepare_pairs(symbols, asked, symbols.select(F.lit(1).cast("long").alias("query_id"), "id"))
    ready = pairs.withColumn("learned_value", F.lit(None).cast("double")).withColumn("now", _now())
    return rank.top_k(SC.score_values(ready), 10).select(F.col("rank").cast("long").alias("rank"), "name", "file", "line", "score")


_LIVE = "(SELECT 1 AS query_id, 'hotgear' AS leaf, NULL::VARCHAR AS qualifier, false AS wild, -1 AS current_repo_id, -1 AS repository_id, s.* EXCLUDE (repository_id) FROM syms s WHERE contains(lower(name), 'gear'))"
_recursive(
    "live_search",
    _MATCH.replace("{source}", _LIVE)
    + _SCORED.replace("{boosts}", "NULL::DOUBLE AS f11, NULL::DOUBLE AS f12, NULL::DOUBLE AS f13").replace("{learned}", "")
    + f"SELECT * FROM (SELECT {_PLACE} AS rank, name, file, line, score FROM found) t WHERE rank <= 10",
)
