"""Exact, line and near deduplication, URL rules: odd rows against plain versions."""

import hashlib
import random
import re

import pytest
from brute import near_duplicates as brute_near
from pyspark.sql import functions as F

from navspark.llm.components import components
from navspark.llm.exact_dedup import exact_dedup
from navspark.llm.line_dedup import LineRuns, _merge, dedup_lines
from navspark.llm.near_dedup import drop_near_duplicates, near_duplicates
from navspark.llm.shingle_dedup import drop_similar
from navspark.llm.url_filter import filter_urls, parse_rule

TEXTS = [None, "", " ", "\t\n ", "a b", "a  b", "a\nb", "a\xa0b", "A b", "x" * 300 + "1", "x" * 300 + "2", "x" * 300 + "1", "word " * 20000, "é", "a b", "🙂\x0b🙂"]


def table(spark, rows, extra=True):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, keep_id string, n_lines long").repartition(3)


def test_exact_dedup_odd_rows(spark):
    rows = list(enumerate(TEXTS)) + [(4, "a b"), (4, "a b"), (None, "a b"), (None, "alone")]
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for d, t in rows:
        groups.setdefault(norm(t), []).append(d)
    got = exact_dedup(table(spark, rows), digest_all=True).collect()
    by_digest = {hashlib.sha256(k.encode()).digest(): v for k, v in groups.items()}
    assert len(got) == len(rows)
    for r in got:
        ids = by_digest[bytes(r.digest)]
        assert r.group_size == len(ids) and r.keep_id == min((i for i in ids if i is not None), default=None)
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    lazy = exact_dedup(table(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.group_size, r.kept) for r in lazy) == sorted((str(r.doc_id), r.group_size, r.kept) for r in got)
    assert exact_dedup(table(spark, rows).limit(0)).count() == 0
    named = table(spark, rows).withColumnsRenamed({"text": "_id", "doc_id": "_norm"})
    assert exact_dedup(named, id_col="_norm", text_col="_id").filter("kept").count() == len(groups)


def plain_lines(rows, min_chars=10):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    rank = lambda d: (d is None, d or 0)
    first = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                first[key(x)] = min(first.get(key(x), rank(d)), rank(d))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or first[key(x)] == rank(d)]
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(map(str, out))


@pytest.mark.parametrize("batches", [1, 4, 7])
def test_line_dedup_odd_rows(spark, batches):
    random.seed(batches)
    pool = ["short", "", "  A Longer Line of text ", "a longer line of text", "another shared line", "\tanother shared line\r", "ünïcode line é", "ten chars!", "ten chars"]
    rows = [(k, "\n".join(random.choice([*pool, f"own line {k}-{j}"]) for j in range(random.randint(0, 9)))) for k in range(120)]
    rows += [(None, "another shared line\nx"), (7, rows[7][1]), (7, "a longer line of text\nonly here, in seven"), (500, None), (501, "big shared line\n" * 3000), (502, "big shared line")]
    docs = table(spark, rows)
    got = dedup_lines(docs, batches=batches)
    assert got.columns == ["doc_id", "text", "keep_id", "n_lines", "_n_lines", "n_dropped"]
    assert sorted(str((r.doc_id, r.text, r["_n_lines"], r.n_dropped)) for r in got.collect()) == plain_lines(rows)
    assert dedup_lines(docs.limit(0)).count() == 0


def test_line_runs_carry_over_and_compact(spark):
    runs = LineRuns(spark, fanout=2)
    for n in range(5):
        docs = spark.createDataFrame([(n, f"a line that all hold\nline number {n} only")], "doc_id long, text string")
        (row,) = dedup_lines(docs, runs, batches=1).collect()
        assert row.n_dropped == (n > 0)
    assert runs.compactions >= 3 and runs.read().count() == 6 and [len(x) for x in runs.levels] == [1, 0, 1]


def test_line_runs_stay_where_they_are(spark):
    runs = LineRuns(spark, fanout=3)
    for n in range(2):
        dedup_lines(spark.createDataFrame([(n, f"line number {n} alone\nthe line they share")], "doc_id long, text string"), runs, batches=1).count()
    assert len(runs.runs()) == 2
    keys = spark.range(50).select(F.xxhash64("id").alias("k1"), F.xxhash64(F.lit(7), "id").alias("k2"), "id").groupBy("k1", "k2").agg(F.min("id").alias("low"))
    plan = runs.probe(keys)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("SortMergeJoin") == 2  # the one is the keys' own grouping
    merged = _merge(*runs.runs())._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in merged and "SortMergeJoin" in merged
    runs.drop()
    with pytest.raises(TypeError):
        dedup_lines(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def near_rows():
    random.seed(11)
    word = lambda: random.choice("abcdefghij") + random.choice("klmnop") + str(random.randint(0, 60))
    rows = []
    for g in range(12):
        base = [word() for _ in range(150)]
        for c in range(random.randint(1, 14)):
            copy = list(base)
            for _ in range(random.randint(0, 2)):
                copy[random.randrange(150)] = word()
            rows.append((len(rows) * 3, " ".join(copy)))
    rows += [(9001, None), (9002, ""), (9003, " \n"), (9004, "one two"), (9005, "ONE two"), (9006, "one"), (9007, rows[0][1].upper()), (9008, "é É"), (9009, "word " * 20000)]
    return rows


@pytest.mark.parametrize(("distance", "bucket"), [(4, 2048), (4, 4), (8, 2048), (8, 6), (0, 2048), (1, 2048)])
def test_near_duplicates_against_all_pairs(spark, distance, bucket):
    rows = near_rows()
    want = brute_near([(d, t) for d, t in rows], 4, distance)
    got = near_duplicates(table(spark, rows), distance=distance, bucket=bucket).collect()
    assert {r.doc_id: (r.fp % 2**64, r.component_id) for r in got} == want


def test_near_duplicates_nulls_and_repeats(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "z y x w v u"), (2, "q q q q q")]
    got = near_duplicates(table(spark, rows)).collect()
    assert sorted(str((r.doc_id, r.component_id)) for r in got) == sorted(map(str, [(1, 1), (1, 1), (None, 1), (None, None), (2, 2)]))
    for drop in (drop_near_duplicates, drop_similar):
        odd = [*rows, (3, "q q q q q"), (3, None), (4, ""), (3, "other text of this id"), (5, "x" * 100_000), (5, "x" * 100_000)]
        kept = drop(table(spark, odd).withColumnRenamed("n_lines", "leader_"))
        assert kept.columns == ["doc_id", "text", "keep_id", "leader_"]
        assert sorted(str((r.doc_id, (r.text or "")[:9])) for r in kept.collect()) == sorted(
            map(str, [(1, "a b c d e"), (None, "z y x w v"), (2, "q q q q q"), (3, ""), (3, "other tex"), (5, "x" * 9)])
        )
        assert drop(table(spark, odd).limit(0)).count() == 0
    assert near_duplicates(table(spark, rows).limit(0)).count() == 0


def test_components_of_long_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(100, 160)] + [(5, k) for k in range(200, 300)] + [(250, 7), (400, 400)]
    got = {r.u: r.low for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert all(got[k] == 100 for k in range(100, 161)) and all(got[k] == 5 for k in [5, 7, *range(200, 300)])


def plain_verdict(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best.action if best else "allow"


@pytest.mark.parametrize("per_range", [200_000, 5, 1])
def test_url_rules(spark, per_range):
    random.seed(per_range)
    rules = [parse_rule(*r) for r in [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/es/1"), ("allow", "a.example.org/es/12"), ("block", "com/fr/"), ("block", "example.com/fr"), ("allow", "net")]]
    hosts = ["example.org", "a.example.org", "A.Example.ORG", "myexample.org", "org", "com", "x.com", "example.com", "net", "internet", "", "b.net.", ".."]
    paths = ["", "/", "/es/", "/es/1", "/es/12/x", "/fr", "/fr/", "/fr/y?q=://z", "#f", "?q", "//", "/é"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme", "a://b://c", "http:/x", "x\ny://example.org/es/\nz", "http://example.org/" + "a" * 5000] + ["http://example.org/es/1"] * 50
    pages = spark.createDataFrame([(n if n % 9 else None, u, "x") for n, u in enumerate(urls)], "page_id long, url string, host string").repartition(4)
    got = filter_urls(pages, rules, urls_per_range=per_range).collect()
    want = [(n if n % 9 else None, *plain_verdict(u, rules)) for n, u in enumerate(urls)]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    assert filter_urls(pages, []).filter("rule IS NULL AND verdict = 'allow'").count() == len(urls)
    assert filter_urls(pages.limit(0), rules).count() == 0
