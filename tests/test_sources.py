"""Listing and reading source trees, and ignore rules by their published meaning."""

import os
import subprocess

import pytest
from pyspark.sql import functions as F

from navspark.engine import NavEngine
from navspark.plans.query import jobs
from navspark.sources.files import list_files, read_files
from navspark.sources.ignore import fits_last, is_ignored, rule_of, rules_of
from navspark.sources.tree import Share, TreeReader, tracked

ODD = ["pages/[id].tsx", "{a,b}.rb", "with blanks/x y.py", "__init__.py", "*.go", "a?b.rs", "é/日本.py", "deep/a/b/c/d/e.py", "[/].rb/].py", "quote'\".js", "back\\slash.rb"]


@pytest.fixture
def tree(tmp_path):
    for name in [*ODD, ".hidden/h.py", ".dot.py", "build/out.py", "notes.txt", "noext", "py"]:
        (tmp_path / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / name).write_text(f"# {name}\n")
    (tmp_path / "t/latin.py").write_bytes(b"# \xe9\n")
    (tmp_path / "t/.gitignore").write_text("build/\n")
    return str(tmp_path / "t")


def listed(spark, tree, **options):
    return sorted(r.path for r in list_files(spark, tree, **options).collect())


def test_odd_names_are_listed_and_read_literally(spark, tree):
    assert listed(spark, tree) == sorted([*ODD, "latin.py"])
    found = list_files(spark, tree)
    read = read_files(spark, tree, found, 3)
    assert {r.path: r.text for r in read.collect()} == {p: f"# {p}\n" for p in ODD}  # without what is no UTF-8
    assert "[id]" not in read._jdf.queryExecution().toString()  # no names in the plan
    assert [r.path for r in read_files(spark, tree, found, 3, "# PAGES").collect()] == ["pages/[id].tsx"]
    os.remove(f"{tree}/__init__.py")
    assert read_files(spark, tree, found.cache(), 3).count() == len(ODD) - 1
    assert listed(spark, tree, under=["deep/a", f"{tree}/with blanks"]) == ["deep/a/b/c/d/e.py", "with blanks/x y.py"]
    assert listed(spark, tree, under=["nowhere"]) == []


def test_odd_names_are_indexed(spark, tree, tmp_path):
    with open(f"{tree}/pages/[id].tsx", "w") as f:
        f.write("export class RoutePage {}\n")
    engine = NavEngine(spark, f"file://{tmp_path}/store")
    engine.index(tree)
    assert [(r.name, r.file) for r in engine.search("routepage", tree).collect()] == [("RoutePage", "pages/[id].tsx")]


def test_what_git_tracks(spark, tree):
    subprocess.run(["git", "init", "-q", tree], check=True)
    assert listed(spark, tree) == []  # a work tree without tracked files is not walked
    subprocess.run(["git", "-C", tree, "add", "-f", "pages", "build", ".hidden", "é", "[/].rb"], check=True)
    assert listed(spark, tree) == sorted(["pages/[id].tsx", "build/out.py", ".hidden/h.py", "é/日本.py", "[/].rb/].py"])
    assert listed(spark, tree, use_git=False) == sorted([*ODD, "latin.py"])
    with pytest.raises(RuntimeError):
        tracked("/nowhere", "")


@pytest.mark.parametrize("parts", [1, 2, 5, 100])
@pytest.mark.parametrize("git", ["false", "true"])
def test_partitions_cover_the_tree_once(tree, parts, git):
    subprocess.run(["git", "init", "-q", tree], check=True)
    subprocess.run(["git", "-C", tree, "add", "."], check=True)
    reader = TreeReader({"root": tree, "parts": str(parts), "git": git})
    shares = reader.partitions()
    found = [p for s in shares for b in reader.read(s) for p in b.column("path").to_pylist()]
    want = [*ODD, "latin.py"] + ([".hidden/h.py", ".dot.py"] if git == "true" else [])
    assert sorted(found) == sorted(want) and len(shares) <= parts
    assert list(reader.read(Share([]))) == []


#: (lines, path, whether it is ignored), from the published description of the format.
GOLDEN = [
    ("foo", "foo", True), ("foo", "a/foo", True), ("foo", "a/foo/b.py", True), ("foo", "food", False), ("/foo", "foo", True), ("/foo", "a/foo", False),
    ("foo/", "a/foo", False), ("foo/", "a/foo/b", True), ("doc/frotz", "doc/frotz", True), ("doc/frotz", "a/doc/frotz", False), ("doc/frotz/", "a/doc/frotz/x", False),
    ("frotz/", "a/frotz/x", True), ("*.py", "a/b.py", True), ("*.py", "b.pyc", False), ("a*b", "axxb", True), ("a*b", "ax/b", False), ("a?b", "axb", True), ("/a?b", "a/b", False),
    ("[a-c]x", "bx", True), ("[a-c]x", "dx", False), ("[!a-c]x", "dx", True), ("[!a-c]x", "bx", False), ("[^a]x", "bx", True), ("[]]x", "]x", True), ("[ab", "[ab", True),
    ("[a-]x", "-x", True), ("/[!b]x", "a/x", False), ("**/foo", "foo", True), ("**/foo", "a/b/foo", True), ("**/foo/bar", "x/foo/bar", True), ("abc/**", "abc/x/y", True), ("abc/**", "abc", False),
    ("a/**/b", "a/b", True), ("a/**/b", "a/x/b", True), ("a/**/b", "a/x/y/b", True), ("a/**/b", "ab", False), ("a**b", "axxb", True), ("/a**b", "ax/b", False), ("**", "x/y", True),
    ("# foo", "# foo", False), ("\\#foo", "#foo", True), ("\\!foo", "!foo", True), ("", "x", False), ("foo   ", "foo", True), ("foo\\ ", "foo ", True), ("foo\r", "foo", True),
    ("*.py\n!keep.py", "a/keep.py", False), ("!keep.py\n*.py", "keep.py", True), ("dir/\n!dir/keep.py", "dir/keep.py", True), ("dir/*\n!dir/keep.py", "dir/keep.py", False),
    ("dir/*\n!dir/keep.py", "dir/x.py", True), ("/*\n!/foo\n/foo/*\n!/foo/bar", "foo/bar/x", False), ("/*\n!/foo\n/foo/*\n!/foo/bar", "foo/baz", True), ("!", "!", False), ("/", "x", False),
    ("a.b", "axb", False), ("a+b(c)", "a+b(c)", True), ("\\*.py", "*.py", True), ("\\*.py", "a.py", False), ("é*", "été", True),
]


@pytest.mark.parametrize(("lines", "path", "want"), GOLDEN)
def test_rules_by_their_meaning(lines, path, want):
    rules, parts = rules_of(lines), path.split("/")
    above = any(fits_last(rules, "/".join(parts[:k]), True) for k in range(1, len(parts)))
    assert (above or fits_last(rules, path, False)) == want


def test_rules_in_a_plan_mean_the_same(spark):
    for lines in {g[0] for g in GOLDEN}:
        pairs = [(p, w) for x, p, w in GOLDEN if x == lines]
        got = spark.createDataFrame(pairs, "path string, want boolean").select("want", is_ignored(F.col("path"), rules_of(lines)).alias("got")).collect()
        assert all(r.got == r.want for r in got), lines


def test_rules_of_nested_folders(spark, tree):
    with open(f"{tree}/deep/.gitignore", "w") as f:
        f.write("/a/b\n")
    with open(f"{tree}/pages/.gitignore", "w") as f:
        f.write("!*\n/deep\n")
    assert "deep/a/b/c/d/e.py" not in listed(spark, tree) and "pages/[id].tsx" in listed(spark, tree)
    assert rule_of("x/y", "a.b").pattern.startswith("^a\\.b/") and rule_of("#") is None


def test_in_how_many_parts_a_tree_is_read(spark, tmp_path, monkeypatch):
    monkeypatch.delenv("NAVSPARK_JOBS", raising=False)
    assert [jobs(t, 6) for t in (None, "", "0", "-2", "many", "3")] == [6, 6, 6, 6, 6, 3] and jobs(None, 0) == 1
    monkeypatch.setenv("NAVSPARK_JOBS", "5")
    assert jobs(None, 6) == 5 and jobs("2", 6) == 2
    for k in range(6):
        (tmp_path / f"d{k}").mkdir()
        (tmp_path / f"d{k}/a.py").write_text("x = 1\n")
    spark.conf.set("spark.navspark.jobs", "3")
    listed = list_files(spark, str(tmp_path))
    assert listed.rdd.getNumPartitions() == 3 and sorted(r.path for r in listed.collect()) == [f"d{k}/a.py" for k in range(6)]
    spark.conf.unset("spark.navspark.jobs")
