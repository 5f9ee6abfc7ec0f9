import random

import pytest
from pyspark.sql import functions as F

from navspark.functions.matcher import match
from navspark.operators import prune as P
from navspark.operators import rank, recall
from navspark.operators import score as SC

PIECES = ["lamp", "Lamp", "LAMP", "la", "mp", "shade", "Pier", "_", "2", "é", "Ö", ".", "-", "x", "HTTPServer", "ℵ", "中"]


def words(seed, n, longest):
    draw = random.Random(seed)
    return ["".join(draw.choice(PIECES) for _ in range(draw.randint(1, longest))) for _ in range(n)]


def test_bounds_hold_for_any_texts(spark):
    leaves = words(1, 60, 3) + ["lamp", "l*p", "lam?", "?", "_", "é", "lmp", "LampShade"]
    rows = [(q, t, (match(q, t) or [None])[0]) for q in leaves for t in words(2, 300, 5)]
    df = spark.createDataFrame(rows, "q string, t string, s double")
    both = df.select("*", P.at_most(F.col("q"), F.col("t")).alias("most"), P.at_least(F.col("q"), F.col("t")).alias("least"))
    assert both.filter("s > most").count() == 0
    assert both.filter("least IS NOT NULL AND (s IS NULL OR s < least)").count() == 0
    assert both.filter("least IS NOT NULL").count() > 100 and both.filter("s = most").count() > 0


@pytest.fixture(scope="module")
def pairs(spark):
    draw = random.Random(3)
    kinds, files = ["class", "method", "module"], [f"{w}/{v}.rb" for w, v in zip(words(4, 40, 2), words(5, 40, 2), strict=True)]
    rows = [(k, n, n.lower(), draw.choice(kinds), draw.choice(files), k, draw.choice([None, "Pier", "Pier::Lamp"]), draw.choice([None, "private"]), k % 3, draw.choice([None, 20.0, 260.0])) for k, n in enumerate(words(6, 2000, 4))]
    symbols = spark.createDataFrame(rows, "id long, name string, name_lower string, kind string, file string, line long, parent string, visibility string, repository_id long, learned_value double")
    symbols = symbols.withColumns({"mtime": F.lit(None).cast("long"), "git_ts": F.when(F.col("id") % 4 == 0, F.col("id") * 1000)})
    asked = [(n, q, 1, ["a/b.rb", files[0]]) for n, q in enumerate(["lamp", "lmpsh", "Pier::lamp", "l*p", "pier_x", "zq", "é", "lamp2shade", "Lamp", "p"])]
    asked = recall.recall_queries(spark.createDataFrame(asked, "query_id long, query string, current_repo_id long, changed_files array<string>"))
    every = asked.select("query_id").crossJoin(symbols.select("id"))
    return recall.fitting(SC.prepare_pairs(symbols, asked, every)).withColumn("now", F.lit(2_000_000)).cache()


def page(rows, k):
    return sorted(tuple(r) for r in rank.top_k(SC.score_values(rows), k).select("query_id", "rank", "name", "file", "line", "score").collect())


@pytest.mark.parametrize("k", [1, 10, 5000])
def test_same_hits(pairs, k):
    want = page(pairs, k)
    assert want and page(P.prune(pairs, k), k) == want
    assert page(P.prune(pairs, k, pairs), k) == want  # bounds of rows without what picks are worth


def test_fewer_candidates_are_matched_and_ties_stay(pairs):
    plain = pairs.filter("NOT wild")
    assert P.prune(plain, 10).count() * 2 < plain.count()
    score = F.col("score")
    scored = SC.score_values(pairs)
    tenth = rank.top_k(scored, 10).groupBy("query_id").agg(F.min("score").alias("_tenth"), F.count("*").alias("_n")).filter("_n = 10")
    reach = scored.join(tenth, "query_id").filter(score >= F.col("_tenth")).select("query_id", "id")
    assert reach.join(P.prune(pairs, 10), ["query_id", "id"], "left_anti").count() == 0


def test_empty_and_few(pairs):
    assert P.prune(pairs.filter("false"), 10).count() == 0
    few = pairs.filter("id < 3")
    assert page(P.prune(few, 10), 10) == page(few, 10)
