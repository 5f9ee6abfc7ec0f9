import pytest
from pyspark.sql import functions as F

from navspark.functions import textcols as X
from navspark.operators import gram_index, rank, recall
from navspark.operators import score as SC

ROW = "id long, name string, kind string, file string, line long, parent string, visibility string, repository_id long, mtime long, git_ts long"
NOW = 1_700_000_000
DAY = 86_400


def hits(spark, rows, query, current=None, changed=(), learned=None):
    """Scored rows of one query, best first, without recall. rows: (name, kind, file, parent, visibility, repository, git_ts)."""
    full = [(n, name, kind, file, n + 1, parent, vis, repo, None, ts) for n, (name, kind, file, parent, vis, repo, ts) in enumerate(rows)]
    symbols = spark.createDataFrame(full, ROW).withColumn("name_lower", F.lower("name"))
    asked = recall.recall_queries(spark.createDataFrame([(1, query, current, list(changed))], "query_id long, query string, current_repo_id long, changed_files array<string>"))
    pairs = SC.prepare_pairs(symbols, asked, symbols.select(F.lit(1).cast("long").alias("query_id"), "id"))
    scored = SC.score_pairs(pairs.withColumn("learned_value", F.lit(learned).cast("double")).withColumn("now", F.lit(NOW)))
    return rank.attach_confidence(rank.top_k(scored, 100)).orderBy("rank").collect()


def sym(name, kind="class", file="q.rb", parent=None, vis=None, repo=1, ts=None):
    return (name, kind, file, parent, vis, repo, ts)


def test_values(spark):
    one = lambda row, q, **k: [r.score for r in hits(spark, [row], q, **k)]
    assert one(sym("Lamps"), "lamp") == [700 - 1 + 15]
    assert one(sym("Lamp"), "lamp") == [1000 + 15] and one(sym("Lamp"), "Lamp") == [1000 + 150 + 15] and one(sym("lamp"), "Lamp") == [1000 + 15]
    assert one(sym("Ledger", file="shop/oar.rb"), "oar") == [15 + 0.6 * (3 * 10 + 15 + 20 + 2 * 10)]
    assert one(sym("weigh", "method", "shop/oar.rb"), "oar") == [] and one(sym("Lamp"), "zzzzz") == []
    assert one(sym("mend", "method", vis="private"), "mend")[0] == one(sym("mend", "method", vis="public"), "mend")[0] - 15
    assert one(sym("Lamp"), "lamp", current=1)[0] == one(sym("Lamp"), "lamp", current=2)[0] + 200


def test_a_file_named_like_the_query_adds_a_fifth_of_its_alignment(spark):
    score = lambda file: hits(spark, [sym("CourierWest", file=file)], "courier")[0].score
    whole = 7 * 10 + 15 + 20 + 6 * 10
    assert score("van/courier.py") - score("van/depot.py") == pytest.approx(0.2 * whole) == pytest.approx(33)


def test_order_of_kinds_of_match(spark):
    got = hits(spark, [sym("LampShade"), sym("Lamps"), sym("Lamp"), sym("OldLaxmps")], "lamp")
    assert [r.name for r in got][:3] == ["Lamp", "Lamps", "LampShade"]
    assert hits(spark, [sym("HarborKeeper"), sym("Harbor"), sym("Quay")], "harborkeep")[0].name == "HarborKeeper"


def test_scope_and_parents(spark):
    got = hits(spark, [sym("Gauge", parent="Pump"), sym("Gauge", parent="Valve"), sym("Gauge", parent="Tank")], "Valve::Gauge")
    assert got[0].parent == "Valve" and "parent" in [f.name for f in got[0].features]
    rows = [("Pump", "Pump"), ("Pump", "Mill::Pump"), ("Mill", "Mill::Pump"), ("Pump", "Pump::Seal"), ("Pump", None), ("C::D", "W::C::D"), ("C::D::E", "C::D::E")]
    boosts = spark.createDataFrame(rows, "q string, p string").select(X.parent_boost(F.col("q"), F.col("p")).alias("b")).collect()
    assert [r.b for r in boosts] == [180, 180, None, None, None, 240, 300]


def test_boosts(spark):
    score = lambda **k: hits(spark, [sym("Lamp", file="a/x.rb", ts=k.pop("ts", None))], "lamp", **k)[0].score
    base = score()
    assert [score(ts=NOW - d * DAY) - base for d in (0, 14, 28, 97)] == [120, 60, 30, 0]
    assert [score(changed=[f]) - base for f in ("a/x.rb", "a/y.rb", "b/x.rb")] == [180, 60, 0]
    rows = [(1, NOW), (5, NOW), (9, NOW), (5, NOW - 30 * DAY), (0, NOW)]
    worth = spark.createDataFrame(rows, "n long, t long").select(SC.learned(F.col("n"), F.col("t"), F.lit(NOW)).alias("v")).collect()
    assert [r.v for r in worth] == [52, 260, 260, 130, None]


def test_confidence(spark):
    assert hits(spark, [sym("Lamp")], "lamp")[0].confidence == 1.0
    tied = hits(spark, [sym("Lamp", file="q1.rb"), sym("Lamp", file="q2.rb")], "lamp")
    assert [r.confidence for r in tied] == [0.5, 0.5]
    assert hits(spark, [sym("Lamp"), sym("Lampsx", "method")], "lamp")[0].confidence > 0.9
    assert 0.3 < hits(spark, [sym("HarborLitGate", "method")], "harlitgate")[0].confidence < 0.65


@pytest.mark.parametrize(("url", "want"), [
    ("git@example.com:town/pier.git", "example.com/town/pier"), ("https://example.com/town/pier.git", "example.com/town/pier"), ("https://example.com/town/pier/", "example.com/town/pier"),
    ("ssh://git@example.com:2222/town/pier.git", "example.com/town/pier"), ("", None), ("plain-words", None),
])
def test_remotes(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(X.normalize_remote(F.col("u")).alias("n")).first().n == want


def test_strong_matches_end_the_recall_of_a_query(spark):
    names = [f"brook{k:02d}" for k in range(50)] + ["brim", "Lamp", "Headlamp"]
    schema = "id long, name string, name_lower string, kind string, file string, repository_id long"
    symbols = spark.createDataFrame([(k, n, n.lower(), "class", "q.rb", k % 2) for k, n in enumerate(names)], schema)
    asked = spark.createDataFrame([(k, q, 1) for k, q in enumerate(("brim", "lamp", "lamp*", "x", "bk7"))], "query_id long, query string, current_repo_id long")
    asked, index = recall.recall_queries(asked), gram_index.postings(symbols)
    found = lambda rows: {k: {r.name for r in rows if r.query_id == k} for k in {r.query_id for r in rows}}
    got = recall.recall_many(index, asked).join(symbols, "id")
    every, fit = found(got.collect()), found(recall.fitting(got.join(asked, "query_id")).collect())
    assert every[0] == {"brim"} and every[1] == {"Lamp"} and every[2] == {"Lamp", "Headlamp"} and 3 not in every
    # only names that hold the query's letters in order can score
    assert len(every[4]) == 51 and len(fit[4]) == 5
    scoped = found(recall.recall_many(index, asked, scoped=True).join(symbols, "id").collect())
    assert scoped[1] == set() | {"Lamp"} and len(scoped[0]) == 25  # brim is in the other repository and settles nothing here
