"""Gates before the walk, cached branch files, passes on a budget, live rows beside stored ones."""

import os
import subprocess
import threading

import pytest

from navspark import engine as engine_module
from navspark.engine import NavEngine
from navspark.plans.freshness import TTL, BranchFiles, worktree_changed
from navspark.sources import files as SRC
from navspark.store import CatalogStore


def git(tree, *args):
    subprocess.run(["git", "-C", tree, "-c", "user.name=t", "-c", "user.email=t@t", *args], check=True, capture_output=True)


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "harbour"
    (root / "lib").mkdir(parents=True)
    for k in range(6):
        (root / f"lib/pier{k}.rb").write_text(f"class Pier{k}\n  def moor\n  end\nend\n")
    git(str(root), "init", "-q", "-b", "main")
    git(str(root), "add", ".")
    git(str(root), "commit", "-qm", "x")
    return str(root)


@pytest.fixture
def engine(spark, tmp_path):
    return NavEngine(spark, f"file://{tmp_path}/store", clock=lambda: 1_700_000_000)


def write(tree, path, text):
    with open(f"{tree}/{path}", "w") as f:
        f.write(text)


def answer(hits):
    return [(r.name, r.file, r.line, r.score, r.confidence) for r in hits.collect()]


def test_an_unchanged_repository_is_neither_walked_nor_read(engine, tree, monkeypatch):
    asked = []
    for name in ("list_files", "read_files"):
        monkeypatch.setattr(SRC, name, lambda *a, f=getattr(SRC, name), n=name, **k: asked.append(n) or f(*a, **k))
    assert not engine.is_current(tree)
    assert engine.warm(f"{tree}/lib", 600)["files_indexed"] == 6 and asked == ["list_files", "read_files"]
    asked.clear()
    assert engine.is_current(tree) and engine.warm(f"{tree}/lib")["status"] == "complete" and asked == []
    write(tree, "lib/pier0.rb", "class Jetty\nend\n")
    assert not engine.is_current(tree) and engine.warm(tree, 600)["files_indexed"] == 1
    git(tree, "commit", "-qam", "y")
    assert worktree_changed(tree, None) and not engine.is_current(tree)
    assert engine.warm(tree, 600)["files_indexed"] == 0 and engine.is_current(tree)


def test_branch_files_are_served_while_they_are_worked_out(spark, tmp_path, tree):
    now, calls, gate = [1000], [], threading.Event()

    def compute(root):
        calls.append(root)
        if len(calls) > 1:
            gate.wait(20)
        return SRC.branch_changed_files(root)

    git(tree, "checkout", "-qb", "topic")
    write(tree, "lib/pier1.rb", "class Pier1\nend\n")
    store = CatalogStore(spark, f"file://{tmp_path}/store")
    cache = BranchFiles(store, lambda: now[0], compute)
    assert cache.get(tree, "r") == ["lib/pier1.rb"] and len(calls) == 1
    assert cache.get(tree, "r") == ["lib/pier1.rb"] and len(calls) == 1
    write(tree, "lib/pier2.rb", "class Pier2\nend\n")
    now[0] += TTL
    assert cache.get(tree, "r") == ["lib/pier1.rb"]  # aged: served, and worked out beside it
    gate.set()
    cache.settle()
    assert cache.get(tree, "r") == ["lib/pier1.rb", "lib/pier2.rb"] and len(calls) == 2
    again = BranchFiles(CatalogStore(spark, f"file://{tmp_path}/store"), lambda: now[0], compute)
    assert again.get(tree, "r") == ["lib/pier1.rb", "lib/pier2.rb"] and len(calls) == 2  # another engine finds them in the store


def test_passes_on_a_budget_go_on_where_the_last_one_ended(engine, tree, spark, tmp_path, monkeypatch):
    monkeypatch.setattr(engine_module, "SLICE", 1)
    assert engine.index(tree, budget=0)["status"] == "warming" and engine.miss(tree) == ("warming", 2)
    assert engine.index(tree, cap=2)["status"] == "warming"
    got = engine.index(tree, budget=600)
    assert got["status"] == "complete" and got["files_indexed"] == 4
    whole = NavEngine(spark, f"file://{tmp_path}/whole", clock=lambda: 1_700_000_000)
    whole.index(tree)
    for table in ("files", "symbols"):
        assert sorted(map(str, engine.store.read(table).collect())) == sorted(map(str, whole.store.read(table).collect()))
    assert answer(engine.search("pier", tree)) == answer(whole.search("pier", tree))


def test_jobs_at_work_are_cancelled_when_the_time_is_up(engine, tree, monkeypatch):
    def slow(files):
        def run(batches):
            import time

            for batch in batches:
                time.sleep(60)
                yield batch

        return files.select("path").mapInPandas(run, "path string").selectExpr(
            "1L repository_id", "path", "'X' name", "'class' kind", "'ruby' language", "1L line", "1L end_line", "CAST(NULL AS STRING) parent", "CAST(NULL AS STRING) visibility"
        )

    with monkeypatch.context() as m:
        m.setattr(SRC, "extract_symbols", slow)
        assert engine.index(tree, budget=8)["status"] == "warming"
    assert engine.store.read("files").count() == 0
    assert engine.index(tree)["status"] == "complete"


def test_live_rows_stand_for_stored_ones(engine, tree, spark, tmp_path):
    engine.index(tree)
    write(tree, "lib/pier0.rb", "class Wharf\n  def moor_all\n  end\nend\n")
    write(tree, "lib/quay.rb", "class Pier9\nend\n")
    os.remove(f"{tree}/lib/pier1.rb")
    git(tree, "add", "-A")
    fresh = NavEngine(spark, f"file://{tmp_path}/fresh", clock=lambda: 1_700_000_000)
    fresh.index(tree)
    commits = {r.path: r.git_ts for r in fresh.store.read("files").collect()}
    assert commits["lib/quay.rb"] is None
    before = engine.store.current.number
    for target in ("pier", "pr9"):
        assert answer(engine.search(target, tree, live=True)) == answer(fresh.search(target, tree)), target
    assert engine.store.current.number == before and answer(engine.search("wharf", tree)) == []


def test_hits_are_fresh_and_roots_known(engine, tree, tmp_path):
    assert [r.name for r in engine.search("pier3", tree, wait="60s").collect()] == ["Pier3"]
    write(tree, "lib/pier3.rb", "\n\nclass Pier3\nend\n")
    assert engine.search("Pier3", tree).first().line == 1 and engine.show("Pier3", tree).first().line == 3
    with pytest.raises(ValueError):
        engine.search("x", tree, wait="soon")
    repo = engine.repository_id(tree)
    assert engine.roots(repo) == [tree] and engine.readable_root(repo, "lib/pier3.rb") == tree
    assert engine.readable_root(repo, "nowhere.rb", str(tmp_path)) is None and engine.repository_id(str(tmp_path)) is None
