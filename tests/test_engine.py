"""The engine from end to end over a small lending library's sources."""

import os
import subprocess

import pytest

from navspark.engine import NavEngine
from navspark.operators.rank import hit_json

DESK = "module Library\n  class LoanDesk\n    def check_out(item)\n      item\n    end\n  end\n  class Loan\n  end\nend\n"
MEMBERS = "class Member\n  def loans_due\n    []\n  end\nend\nclass CourierEast\nend\n"
DEPOT = "class CourierWest:\n    def dispatch(self, parcel):\n        return parcel\n"


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "shelf"
    for folder in ("lib/desk", "drafts"):
        (root / folder).mkdir(parents=True)
    (root / "lib/desk/counter.rb").write_text(DESK)
    (root / "lib/people.rb").write_text(MEMBERS)
    (root / "depot.py").write_text(DEPOT)
    (root / "drafts/plan.rb").write_text("class Unseen\nend\n")
    (root / ".gitignore").write_text("drafts/\n")
    (root / "broken.rb").write_bytes(b"class \xff\xfe\nend\n")
    return str(root)


@pytest.fixture
def engine(spark, tmp_path):
    return NavEngine(spark, f"file://{tmp_path}/store", clock=lambda: 1_700_000_000)


def names(hits):
    return [r.name for r in hits.collect()]


def write(tree, path, text):
    with open(f"{tree}/{path}", "w") as f:
        f.write(text)


def test_a_catalog_follows_its_files(engine, tree):
    first = engine.index(tree)
    assert (first["status"], first["symbols"]) == ("complete", 9)
    found = names(engine.search("loandsk", tree))
    assert found[0] == "LoanDesk" and "Member" not in found
    assert engine.search("loan", tree).first().name == "Loan"
    assert names(engine.search("Unseen", tree)) == []
    assert [r.repo for r in engine.status().collect()] == [f"local:{tree}"]
    second = engine.index(tree)
    assert (second["files_indexed"], second["symbols"]) == (0, 9)
    write(tree, "lib/people.rb", "class Patron\nend\n")
    os.remove(f"{tree}/depot.py")
    assert engine.index(tree)["symbols"] == 5
    assert names(engine.search("patron", tree)) == ["Patron"]
    assert names(engine.search("CourierWest", tree)) == [] and names(engine.search("Member", tree)) == []


def test_narrowing_and_showing(engine, tree):
    engine.index(tree)
    assert names(engine.search("class loan", tree, kinds=["c"])) == ["Loan", "LoanDesk"]
    assert names(engine.search("loan", tree, paths=["lib/desk"], langs=["rb"])) == ["Loan", "LoanDesk"]
    assert names(engine.search("Library::Loan", tree))[0] == "Loan"
    assert names(engine.outline(tree, "lib/desk/counter.rb")) == ["Library", "LoanDesk", "check_out", "Loan"]
    assert names(engine.outline(tree, "lib/desk/counter.rb", kinds=["method"])) == ["check_out"]
    shown = engine.show("CourierWest", tree).first()
    assert shown.signature == "class CourierWest:" and shown.body.splitlines()[1].strip().startswith("def dispatch")
    text = engine.search("Loan", tree).select(hit_json(["name", "parent", "visibility", "features"]).alias("j")).first().j
    assert text.startswith('{"name":"Loan","parent":"Library"')


def test_picks_lift_later_results(engine, tree):
    engine.index(tree)
    # equal in all but the name, since neither file's name says anything
    assert names(engine.search("courier", tree)) == ["CourierEast", "CourierWest"]
    assert engine.record("select", "Courier", tree, f"{tree}/depot.py", 1) == 1
    best = engine.search("courier", tree).first()
    assert best.name == "CourierWest" and "learned" in [f.name for f in best.features]
    with pytest.raises(ValueError):
        engine.record("search", "x", tree, "y")


def test_a_bounded_pass_leaves_the_catalog_warming(engine, tree):
    assert engine.index(tree, cap=1, query="depot")["status"] == "warming"
    assert names(engine.search("CourierWest", tree)) == ["CourierWest"]
    assert engine.miss(tree) == ("warming", 2)
    assert engine.index(tree, under=["lib"])["status"] == "warming"
    assert engine.index(tree)["status"] == "complete"
    assert engine.miss(tree) == ("no_match", 1)


def test_dropping_and_searching_files_as_they_lie(engine, tree):
    engine.index(tree)
    assert [engine.drop(tree)["dropped"] for _ in range(2)] == [True, False]
    assert engine.status().count() == 0 and names(engine.search("loan")) == []
    assert names(engine.live_search("dispatch", tree)) == ["dispatch"]
    assert names(engine.live_search("lndsk", tree))[0] == "LoanDesk"
    assert names(engine.live_search("dispatch", tree, cap=0)) == []


def test_commits_give_times_and_an_edited_hit_is_parsed_again(engine, tree):
    env = os.environ | {"GIT_AUTHOR_DATE": "1690000000 +0000", "GIT_COMMITTER_DATE": "1690000000 +0000"}
    who = ["-c", "user.name=t", "-c", "user.email=t@t"]
    for args in (["init", "-q", "-b", "main"], ["add", "."], [*who, "commit", "-qm", "x"], ["remote", "add", "origin", "git@example.com:town/library.git"]):
        subprocess.run(["git", "-C", tree, *args], check=True, env=env)
    engine.index(tree)
    assert [r.repo for r in engine.status().collect()] == ["example.com/town/library"]
    assert {r.git_ts for r in engine.store.read("files").collect()} == {1690000000}
    assert not engine.refresh(tree, ["depot.py"])
    write(tree, "depot.py", "class Warehouse:\n    pass\n")
    assert engine.refresh(tree, ["depot.py", "gone.py"])
    assert names(engine.search("Warehouse", tree)) == ["Warehouse"]
    # a hit whose file has changed is parsed again before it is shown
    write(tree, "depot.py", "\n\nclass Warehouse:\n    floor = 2\n")
    assert engine.search("Warehouse", tree, fresh=True).first().line == 3
    write(tree, "depot.py", "class Elsewhere:\n    pass\n")
    assert names(engine.search("Warehouse", tree, fresh=True)) == []


def test_a_table_of_queries(engine, tree, spark):
    engine.index(tree)
    queries = spark.createDataFrame([(1, "loan"), (2, "courier"), (3, "zzyzx")], "query_id long, query string")
    best = {r.query_id: r.name for r in engine.search_many(queries).filter("rank = 1").collect()}
    assert best == {1: "Loan", 2: "CourierEast"}
