import json
import re

import pytest
from pyspark.sql import functions as F

from navspark.engine import NavEngine
from navspark.functions.matcher import match_positions
from navspark.functions.textcols import path_stem
from navspark.operators import render
from navspark.store import default_path

HIT = "query_id long, query string, name string, kind string, file string, line long, parent string, signature string, confidence double, score double, rank int, features array<struct<name: string, value: double>>"
ROWS = [
    (1, "lamp", "Lamp", "class", "van/lamp.lamp", 3, None, "class Lamp", 0.97, 1015.0, 1, [("exact", 1000.0), ("kind", 15.0)]),
    (1, "lamp", "HeadLämp_lamp", "method", "lamp/Lam_Post.rb", 9, "Pier", None, 0.5, 212.5, 2, [("fuzzy", 212.5)]),
    (2, "l*m?", "Lamp", "class", "lampé/äLamp", 1, "", "", 1.0, -0.5, 1, []),
    (3, "zz", "Lamp", "class", "", 1, None, "x lamp", 1.0, 1.5, 1, [("path", 2.5), ("private", -15.0)]),
]


@pytest.fixture(scope="module")
def hits(spark):
    return spark.createDataFrame(ROWS, HIT)


def by_hand(text, places, color):
    """The text with each marked letter by itself, neighbouring marks then made one."""
    out = "".join(f"\x1b[{color}m{c}\x1b[0m" if i in places else c for i, c in enumerate(text))
    return out.replace(f"\x1b[0m\x1b[{color}m", "")


def test_marks_are_where_the_query_matched(spark, hits):
    got = render.add_text(hits, F.col("query"), "1;32").select("query_id", "rank", "text")
    seen = {(r.query_id, r.rank): r.text for r in got.collect()}
    stems = {r.file: r.s for r in hits.select("file", path_stem(F.col("file")).alias("s")).collect()}
    for qid, q, name, kind, file, line, parent, signature, *_, place, _f in ROWS:
        head = len(file) - len(file.rpartition("/")[2])
        path = by_hand(file, [p + head for p in match_positions(q, stems[file])], "1;32")
        want = f"{path}:{line}  {kind} {by_hand(name, match_positions(q, name), '1;32')}" + (f" · {parent}" if parent is not None else "")
        want += "" if signature is None else "\n    " + by_hand(signature, match_positions(q, signature), "1;32")
        assert seen[qid, place] == want
    assert "\x1b" in seen[1, 1] and "\x1b" not in seen[3, 1]
    assert seen[1, 1].count("\x1b[0m") == 3  # the name, the stem but not the extension, the definition's line
    plain = {(r.query_id, r.rank): r.text for r in render.add_text(hits, F.col("query")).collect()}
    assert {k: re.sub(r"\x1b\[[0-9;]*m", "", t) for k, t in seen.items()} == plain


def test_runs_of_any_places(spark):
    rows = [(t, p) for t in ("", "a", "abc", "äℵcdef") for p in ([], [0], [0, 1], [0, 2], [1], [0, 1, 2], [0, 2, 3, 5]) if not p or p[-1] < len(t)] + [("abc", None), (None, [0])]
    got = spark.createDataFrame(rows, "t string, p array<int>").select("t", "p", render.marked(F.col("t"), F.col("p"), "1").alias("m")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.m == (r.t if r.t is None or not r.p else by_hand(r.t, r.p, "1"))


def test_explaining_line(hits):
    texts = {(r.query_id, r.rank): r.text for r in render.add_text(hits, F.col("query"), explain=True).collect()}
    assert texts[1, 1].split("\n")[-1] == "    confidence 0.97 · score 1015 = exact 1000 + kind 15"
    assert texts[1, 2].split("\n")[-1] == "    confidence 0.50 · score 212 = fuzzy 212"
    assert texts[3, 1].split("\n")[-1] == "    confidence 1.00 · score 2 = path 2 + private -15"


def test_rows_and_pages_of_json(spark, hits, tmp_path):
    columns = ["query", "name", "file", "line", "parent", "score", "features"]
    render.write_rows(hits, f"file://{tmp_path}/out", columns)
    lines = [json.loads(r.value) for r in spark.read.text(f"file://{tmp_path}/out").collect()]
    want = [{"query": r[1], "name": r[2], "file": r[4], "line": r[5], "parent": r[6], "score": r[9], "features": [f[0] for f in r[11]]} for r in ROWS]
    want = [{k: v for k, v in row.items() if v is not None} for row in want]
    order = lambda row: (row["query"], -row["score"], row["file"])
    assert sorted(lines, key=order) == sorted(want, key=order)
    render.write_rows(hits.limit(0), f"file://{tmp_path}/out", columns)
    assert spark.read.text(f"file://{tmp_path}/out").count() == 0
    pages = {r.query_id: r.json for r in render.page_json(hits, columns).collect()}
    assert [row["file"] for row in json.loads(pages[1])] == ["van/lamp.lamp", "lamp/Lam_Post.rb"] and "\n" in pages[1]
    assert json.loads(hits.select(render.miss_json(F.lit('a"b'), F.lit("warming")).alias("m")).first().m) == {"query": 'a"b', "status": "warming"}


def test_where_a_store_lies(spark, monkeypatch):
    monkeypatch.delenv("NAVSPARK_STORE", raising=False)
    assert default_path(spark) == spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/navspark"
    spark.conf.set("spark.navspark.store", "hdfs:///one")
    assert default_path(spark) == "hdfs:///one"
    monkeypatch.setenv("NAVSPARK_STORE", "hdfs:///two")
    assert default_path(spark) == "hdfs:///two"
    spark.conf.unset("spark.navspark.store")


def test_text_and_files_of_a_search(spark, tmp_path):
    (tmp_path / "yard").mkdir()
    (tmp_path / "yard/lamp.rb").write_text("class LampPost\n  def light\n  end\nend\n")
    root = str(tmp_path / "yard")
    engine = NavEngine.open(spark, f"file://{tmp_path}/store", clock=lambda: 1_700_000_000)
    engine.index(root)
    found = engine.search("lamppost", root).cache()
    first = engine.text(found, "lamppost", root, color="1", explain=True).first().text.split("\n")
    assert first[0] == "lamp.rb:1  class \x1b[1mLampPost\x1b[0m"  # the file's name does not hold the query
    assert first[1] == "    class \x1b[1mLampPost\x1b[0m" and first[2].startswith("    confidence 1.00 · score ")
    engine.write(found, f"file://{tmp_path}/hits")
    assert json.loads(spark.read.text(f"file://{tmp_path}/hits").first().value)["name"] == "LampPost"
    asked = spark.createDataFrame([(1, "lamppost"), (2, "lght")], "query_id long, query string")
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(engine.search_many(asked, pruned=True)) == rows(engine.search_many(asked)) != []
