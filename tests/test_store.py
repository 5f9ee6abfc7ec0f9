"""The store: writers side by side, jobs that die, migration, expiry; the gram index's segments; the event log; as-of attribution."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from navspark.engine import NavEngine
from navspark.operators import gram_index, learn
from navspark.schemas import SCHEMA_VERSION
from navspark.store import KEPT, CatalogStore, Conflict

FILE = "id long, repository_id long, path string, language string, mtime long, git_ts long, content_hash string, indexed_at long"
SYMBOL = "id long, repository_id long, file_id long, name string, name_lower string, kind string, file string"


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/store"


def files(spark, repo, *paths):
    return spark.createDataFrame([(k, repo, p, "ruby", 1, None, p, 1) for k, p in enumerate(paths)], FILE)


def paths(store, *repos):
    return sorted(r.path for r in store.read("files", repos or None).collect())


def test_two_writers_of_different_repositories_both_survive(spark, path):
    a, b = CatalogStore(spark, path), CatalogStore(spark, path)
    one, two = a.begin(), b.begin()
    one.replace("files", [one.stage("files", files(spark, 1, "x"))], 1)
    two.replace("files", [two.stage("files", files(spark, 2, "y"))], 2)
    one.commit()
    two.commit()
    store = CatalogStore(spark, path)
    assert store.current.number == 1 and paths(store) == ["x", "y"] and paths(store, 1) == ["x"] and paths(store, 3) == []
    assert len(store.read("files", [2]).inputFiles()) == 1


def test_writers_of_one_repository_conflict_and_try_again(spark, path):
    a, b = CatalogStore(spark, path), CatalogStore(spark, path)
    one, two = a.begin(), b.begin()
    for tx, name in ((one, "x"), (two, "y")):
        tx.replace("files", [tx.stage("files", files(spark, 1, name))], 1)
    one.commit()
    with pytest.raises(Conflict):
        two.commit()
    tries = []

    def work(tx):
        tries.append(paths(b))
        tx.meta["n"] = str(len(tries))
        if len(tries) == 1:  # another writer is faster
            other = a.begin()
            other.meta["n"] = "other"
            other.commit()

    b.transact(work)
    assert len(tries) == 2 and CatalogStore(spark, path).meta["n"] == "2"


def test_appends_never_conflict_and_numbers_are_taken_once(spark, path):
    stores = [CatalogStore(spark, path) for _ in range(3)]
    row = spark.createDataFrame([(1, "select", "q", 1, "f", 1, None, 5)], "id long, type string, query string, repository_id long, path string, line long, branch string, ts long")
    open_ = [s.begin() for s in stores]
    for tx in open_:
        tx.append("events", [tx.stage("events", row)])
    for tx in open_:
        tx.commit()
    assert CatalogStore(spark, path).read("events").count() == 3
    assert not stores[0]._create(1, "{}") and stores[0]._create(99, "{}")


def test_what_a_dead_writer_leaves_counts_for_nothing(spark, path, tmp_path):
    store = CatalogStore(spark, path)
    store.write({"files": files(spark, 1, "x")})
    (tmp_path / "store/catalog/.5").write_text("{")
    (tmp_path / "store/catalog/draft").write_text("")
    orphan = store.begin().stage("files", files(spark, 1, "lost"))
    again = CatalogStore(spark, path)
    assert paths(again) == ["x"]
    again.write({"files": files(spark, 1, "y")})
    assert paths(CatalogStore(spark, path)) == ["y"]
    assert again.vacuum() == 0 and again.vacuum(older_than_seconds=-60) == 1
    assert not os.path.exists(tmp_path / "store" / orphan) and paths(CatalogStore(spark, path)) == ["y"]


def test_an_index_that_dies_leaves_the_catalog_as_it_was(spark, path, tmp_path, monkeypatch):
    tree = tmp_path / "src"
    tree.mkdir()
    (tree / "a.rb").write_text("class Amber\nend\n")
    engine = NavEngine(spark, path)
    engine.index(str(tree))
    (tree / "a.rb").write_text("class Beryl\nend\n")
    with monkeypatch.context() as m:
        m.setattr(gram_index, "add_segment", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            engine.index(str(tree))
    again = NavEngine(spark, path)
    assert [r.name for r in again.search("amber", str(tree)).collect()] == ["Amber"]
    again.index(str(tree))
    assert [r.name for r in again.search("beryl", str(tree)).collect()] == ["Beryl"]


def test_one_repository_is_written_and_old_manifests_go(spark, path, tmp_path):
    store = CatalogStore(spark, path)
    both = files(spark, 1, "x").unionByName(files(spark, 2, "y"))
    store.write({"files": both})
    before = store.current
    assert len(before.groups) == 1
    for n in range(KEPT + 2):
        tx = store.begin()
        tx.replace("files", [tx.stage("files", files(spark, 2, f"y{n}"))], 2)
        tx.commit()
    assert store.current.folders("files", 1) == before.folders("files", 1) and paths(store) == ["x", f"y{KEPT + 1}"]
    assert sorted(n for n in os.listdir(tmp_path / "store/catalog") if n.isdigit()) == [str(store.current.number - k) for k in (2, 1, 0)]
    assert len(os.listdir(tmp_path / "store/files")) == 1 + KEPT  # the bulk folder, of which one repository is alive, and those of the kept manifests


def test_older_schemas_are_migrated_and_newer_ones_refused(spark, path, tmp_path):
    repositories = spark.createDataFrame([(4, "local:/x", None, 1, 1)], "id long, identity string, default_branch string, created_at long, updated_at long")
    repositories.write.parquet(f"{path}/repositories/3")
    (tmp_path / "store/catalog").mkdir()
    (tmp_path / "store/catalog/7").write_text(json.dumps({"schema": 9, "versions": {"repositories": 3, "symbols": 2}, "meta": {"events_hwm": "5", "head:x": "abc"}}))
    store = CatalogStore(spark, path)
    assert [r.id for r in store.read("repositories").collect()] == [4] and store.read("symbols").count() == 0 and store.meta == {"events_hwm": "5"}
    store.write({"files": files(spark, 4, "x")})
    assert CatalogStore(spark, path).current.number == 8 and CatalogStore(spark, path).read("repositories").count() == 1
    (tmp_path / "store/catalog/9").write_text(json.dumps({"schema": SCHEMA_VERSION + 1}))
    with pytest.raises(ValueError, match="newer"):
        CatalogStore(spark, path)


# ---- segments


def symbols_of(spark, names):
    """names: file number to the names in it."""
    rows = [(hash((f, n)) % 10**9, 1, f, n, n.lower(), "class", f"f{f}.rb") for f, held in names.items() for n in held]
    return spark.createDataFrame(rows, SYMBOL)


def test_segments_hold_changed_files_only_and_levels_are_merged(spark, path):
    random.seed(3)
    store, names, written = CatalogStore(spark, path), {}, []
    for step in range(2 * gram_index.FULL + 1):
        before = dict(names)
        names[step] = {f"Name{step}x{k}" for k in range(3)}
        if step > 1:
            names[random.choice(sorted(names))] = {f"Edited{step}"}
            names.pop(random.choice(sorted(names)[:-1]))
        state = lambda held: spark.createDataFrame([(f, str(sorted(n))) for f, n in held.items()], "id long, content_hash string")
        symbols = symbols_of(spark, names)
        tx = store.begin()
        gram_index.add_segment(tx, 1, symbols, gram_index.changed(state(before), state(names)))
        tx.commit()
        folders = store.current.folders("grams", 1)
        written.append(sorted(gram_index.place(f) for f in folders))
        if max(gram_index.place(f)[1] for f in folders) == step + 1 and any(gram_index.place(f) == (0, step + 1) for f in folders):
            touched = {f for f in names if names[f] != before.get(f)} | (before.keys() - names.keys())
            newest = [f for f in folders if gram_index.place(f) == (0, step + 1)]
            assert {r.file_id for r in store.read_folders("grams", newest).select("file_id").distinct().collect()} == touched
        got = {(r.gram, r.id) for r in gram_index.searchable(store, [1]).collect()}
        assert got == {(r.gram, r.id) for r in gram_index.postings(symbols).collect()}
    assert all(sum(level == lv for lv, _ in places) < gram_index.FULL for places in written for level in range(3))
    assert any(len(places) == 1 and places[0][0] == 1 for places in written)


def test_an_index_pass_without_changes_adds_no_segment(spark, path):
    store = CatalogStore(spark, path)
    state = spark.createDataFrame([(1, "a")], "id long, content_hash string")
    tx = store.begin()
    assert gram_index.add_segment(tx, 1, symbols_of(spark, {1: {"X"}}), gram_index.changed(state, state)) == 0


def test_the_search_plan_reads_one_repository_and_takes_no_name_apart(spark, path, tmp_path):
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.rb").write_text(f"class Shared{name}\nend\n")
    engine = NavEngine(spark, path)
    for name in ("one", "two"):
        engine.index(str(tmp_path / name))
    hits = engine.search("shared", str(tmp_path / "two"))
    assert [r.name for r in hits.collect()] == ["Sharedtwo"]
    read = set(engine.store.current.folders("grams", 2) + engine.store.current.folders("symbols", 2))
    assert all(any(f in file for f in read) or "/repositories/" in file or "/selection_stats/" in file for file in hits.inputFiles())
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Generate" in line and "name_lower" in line for line in plan.splitlines()) and "gram" in plan


# ---- events


def events_of(spark, n):
    rows = [("select" if k % 3 else "search", f"q{k % 4}", 1, f"f{k % 2}.rb", k % 9 or None, None, k) for k in range(n)]
    return spark.createDataFrame(rows, "type string, query string, repository_id long, path string, line long, branch string, ts long")


def test_batches_are_numbered_on_and_taken_once(spark, path):
    store = CatalogStore(spark, path)
    symbols = spark.createDataFrame([(1, f"f{k % 2}.rb", f"N{k}", "class", k) for k in range(1, 9)], "repository_id long, file string, name string, kind string, line long")
    log = learn.EventLog(store, lambda repos: symbols)
    for version in (0, 1, 1, 0, 2):
        log.append(events_of(spark, 10).repartition(3), "feed", version)
        log.roll_up(None)
    log.append(events_of(spark, 0), "feed", 3)
    assert store.meta["events_hwm"] == "30" and store.meta["source:feed"] == "3"
    want = learn.pick_counts(events_of(spark, 10).withColumn("id", F.monotonically_increasing_id()), symbols).collect()
    got = {tuple(r[k] for k in learn.KEY): (r.selections, r.last_selected_at) for r in log.picks().collect()}
    assert got == {tuple(r[k] for k in learn.KEY): (3 * r.selections, r.last_selected_at) for r in want}
    assert log.roll_up(None) == 0


def test_ids_are_gapless_and_small_folders_become_one(spark, path, monkeypatch):
    monkeypatch.setattr(learn, "MANY", 3)
    store = CatalogStore(spark, path)
    log = learn.EventLog(store, lambda repos: spark.createDataFrame([], "repository_id long, file string, name string, kind string, line long"))
    for n in range(5):
        log.append(events_of(spark, 4).repartition(2))
    assert sorted(r.id for r in store.read("events").collect()) == list(range(1, 21)) and len(store.current.folders("events", "")) == 5
    while log.roll_up(5, keep=3):
        pass
    assert sorted(r.id for r in store.read("events").collect()) == [18, 19, 20] or len(store.current.folders("events", "")) == 1
    assert int(store.meta["events_hwm"]) == 20 and set(store.current.named()) >= set(store.current.folders("events", ""))
    assert all(f in store.current.named() for f in (k[7:] for k in store.meta if k.startswith("events:")))


@pytest.mark.parametrize("block", [3, 100_000])
def test_attribution_against_plain_version(spark, block):
    random.seed(9)
    defined = [(r, f"p{f}", random.choice("abcdef"), random.choice(["class", "method", "module"]), random.randint(1, 30)) for r in (1, 2) for f in range(3) for _ in range(8)]
    asked = [(k, "q", random.choice([1, 2, 3, None]), random.choice(["p0", "p0", "p0", "p1", "p7", None]), random.choice([None, *range(0, 35)])) for k in range(300)]
    want = {}
    for k, _, repo, path, line in asked:
        mine = [(at, name, kind) for r, p, name, kind, at in defined if (r, p) == (repo, path)]
        fit = [(-at, name) for at, name, _ in mine if line is not None and at <= line] or [(at, name) for at, name, kind in mine if line is None and kind != "method"]
        if fit:
            want[k] = min(fit)[1]
    events = spark.createDataFrame(asked, "id long, query string, repository_id long, path string, line long")
    symbols = spark.createDataFrame(defined, "repository_id long, file string, name string, kind string, line long")
    got = learn.attribute(events, symbols, block)
    assert {r.id: r.name for r in got.collect()} == want and got.count() == len(want)
    assert learn.attribute(events.limit(0), symbols).count() == 0 and learn.attribute(events, symbols.limit(0)).count() == 0
