"""URL filtering by a sort-merge range join of host and path rules.

A rule (host, path) fits the host, its subdomains, and paths that start with the rule's. The canonical
key of a host and path is the reversed host labels, a separator and the path. For each suffix of a
url's host there is one key, and a rule fits if its key is a prefix of one of them: the rule is the
interval of all keys that start with it. Distinct keys and rule intervals are cut into ranges by key, and each range is
swept once in key order with a stack of the rules that are open at that point. What the sweep finds is joined back to the urls by key.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from navspark.llm.common import ascii_lower, materialize

#: Between the labels of a reversed host, and between host and path. Neither can be in a host label.
LABEL_END, HOST_END = ".", "/"
#: Keys that one range is meant to hold, and ranges at most: a sweep streams through its range, so larger ones only mean longer tasks.
URLS_PER_RANGE, MAX_RANGES = 200_000, 4096
DEFAULT_VERDICT = "allow"


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return f"{self.host}{self.path}"


def parse_rule(action: str, text: str) -> Rule:
    """``example.org/es/`` is the host up to the first slash and the path from it on."""
    host, slash, path = text.partition("/")
    return Rule(action, host, slash + path)


def url_host(url: Column) -> Column:
    """What is after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: str) -> str:
    return LABEL_END.join(reversed(host.split(".")))


def _keys(hosts: DataFrame) -> DataFrame:
    """One row per (host, path) and suffix of the host: key. A host of n labels has n suffixes."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda n: F.array_join(F.slice(F.reverse(labels), F.lit(1), n), LABEL_END),
    )
    return hosts.select("host", "path", F.explode(suffixes).alias("suffix")).select(
        "host", "path", F.concat("suffix", F.lit(HOST_END), "path").alias("key")
    )


def _bounds(keys: DataFrame, ranges: int) -> list[str]:
    """Keys at which the ranges begin; at most ``ranges`` of them, from a sample of 32 keys for each range."""
    if ranges < 2:
        return []
    wanted = 32 * ranges
    sample = sorted(r.key for r in keys.select("key").orderBy(F.xxhash64("key")).limit(wanted).collect())
    if not sample:
        return []
    return sorted({sample[len(sample) * k // ranges] for k in range(1, ranges)})


def sweep(rows):
    """Yields (row, rule) for rows of one range in order of key: rules open as their key begins, and close when left.

    rows: (key, is_key, payload) sorted by (key, is_key), so that a rule comes before the keys equal to it.
    A row with an empty key closes every rule but those with an empty key.
    """
    stack: list[tuple[str, object]] = []
    for key, is_key, payload in rows:
        while stack and not key.startswith(stack[-1][0]):
            stack.pop()
        if not is_key:
            stack.append((key, payload))
        elif stack and payload is not None:
            yield payload, stack[-1][1]


def _ranged_rules(rules: list[Rule], bounds: list[str]) -> list[tuple[int, str, str, str]]:
    """(range, key, rule, action): each rule in the range where its interval begins and in each where it is still open at the start."""
    out = []
    for key, rule in {host_key(r.host) + HOST_END + r.path: r for r in rules}.items():
        n = bisect.bisect_right(bounds, key)
        out.append((n, key, rule.text, rule.action))
        while n < len(bounds) and bounds[n].startswith(key):
            n += 1
            out.append((n, key, rule.text, rule.action))
    return out


def _into_ranges(bounds: list[str]):
    """For ``mapInArrow``: adds the number of the range that a key is in."""

    def run(batches):
        for batch in batches:
            at = [bisect.bisect_right(bounds, key) for key in batch.column("key").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *batch.columns], ["range", *batch.schema.names])

    return run


def _sweep_range(batches):
    """For ``mapInArrow``: (key, rule, action) of each key that has a rule, for rows (range, key, is_key, rule, action) sorted by the first three."""

    def rows():
        last = None
        for batch in batches:
            for at, key, is_key, *payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != last:  # another range in the same task: nothing stays open
                    yield "", True, None
                    last = at
                yield key, is_key, (key, *payload)

    found = []
    for (key, _, _), (_, rule, action) in sweep(rows()):
        found.append((key, rule, action))
        if len(found) == 8192:
            yield _batch(found)
            found = []
    yield _batch(found)


def match_hosts(hosts: DataFrame, rules: list[Rule], urls_per_range: int = URLS_PER_RANGE) -> DataFrame:
    """(host, path, rule, action) for each distinct (host, path) that a rule fits, with the longest of the rules that do."""
    spark = hosts.sparkSession
    keys = materialize(_keys(hosts), "url-keys")
    distinct = materialize(keys.select("key").distinct(), "url-distinct-keys")
    ranges = min(MAX_RANGES, max(1, -(-distinct.count() // urls_per_range)))
    bounds = _bounds(distinct, ranges)
    opened = spark.createDataFrame(_ranged_rules(rules, bounds), "range int, key string, rule string, action string").select(
        "range", "key", F.lit(False).alias("is_key"), "rule", "action"
    )
    wanted = distinct.mapInArrow(_into_ranges(bounds), "range int, key string").select(
        "range", "key", F.lit(True).alias("is_key"), F.lit("").alias("rule"), F.lit("").alias("action")
    )
    swept = (
        wanted.unionByName(opened)
        .repartition(len(bounds) + 1, "range")
        .sortWithinPartitions("range", "key", "is_key")
        .mapInArrow(_sweep_range, "key string, rule string, action string")
    )
    swept = materialize(swept, "url-swept")
    best = F.max_by(F.struct("rule", "action"), F.struct(F.length("rule"), "rule")).alias("best")
    return keys.join(swept, "key").groupBy("host", "path").agg(best).select("host", "path", "best.rule", "best.action")


def _batch(found: list[tuple[str, str, str]]) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["key", "rule", "action"])


def filter_urls(
    pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT_VERDICT, urls_per_range: int = URLS_PER_RANGE
) -> DataFrame:
    """One row per input row: the id column, host, path, rule, verdict.

    The longest rule that fits decides; without one the verdict is ``default``. Urls are judged once per
    distinct (host, path), so a url that a third of all rows hold is one row of the sweep.

    Defined cases: a null url, or one without ``://``, has an empty host and path, which only a rule
    with an empty host can fit; ids are carried along whatever they are; repeated rows stay repeated; an
    empty table or no rules at all are fine; other columns are ignored.
    """
    judged = pages.select(F.col(id_col), url_host(F.col(url_col)).alias("_host"), url_path(F.col(url_col)).alias("_path"))
    hosts = judged.select(F.col("_host").alias("host"), F.col("_path").alias("path")).distinct()
    found = match_hosts(hosts, rules, urls_per_range).select(F.col("host").alias("_host"), F.col("path").alias("_path"), F.col("rule").alias("_rule"), "action")
    return judged.join(found, ["_host", "_path"], "left").select(
        F.col(id_col),
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("_rule").alias("rule"),
        F.coalesce("action", F.lit(default)).alias("verdict"),
    )
