"""Decontamination and toxicity: planted cases, odd rows, held-out accuracy."""

import math
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from navspark.llm import queries
from navspark.llm.common import table
from navspark.llm.decontaminate import contaminated, drop_contaminated
from navspark.llm.toxicity import drop_toxic, fit_cumulative_link, fit_severity, score_severity

SF = "/root/testdata/sf0.01"
ITEM = "A train leaves Boston at 60 miles per hour with 120 people while Alice Smith buys 3 tickets for 45 dollars and waits for 60 minutes near the old gate."
FILLER = "quick brown stories about distant harbours and lazy rivers under some pale moon "


def found(spark, texts, items=((7, ITEM),), **options):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, item_id string").repartition(2)
    bench = spark.createDataFrame(list(items), "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in contaminated(docs, bench, **options).collect()}


def test_verbatim_and_reparameterised_passages(spark):
    other = ITEM.replace("60", "75").replace("Boston", "Chicago").replace("Alice", "Bertha").replace("120", "90")
    broken = ITEM.replace("at 60", "at 75")  # 60 becomes 75 here and stays 60 there: no renaming, but 24 words are verbatim
    texts = [FILLER * 3 + ITEM + FILLER, FILLER + other + FILLER, FILLER + broken, FILLER * 9, ITEM.upper(), "\n".join(ITEM.split()), ITEM[:50], None, "", "60 45 3 120 " * 40]
    got = found(spark, texts)
    assert sorted(got) == [(0, 7), (1, 7), (2, 7), (4, 7), (5, 7)]
    assert got[0, 7].changed_slots == 0 and got[0, 7].matched_words >= len(ITEM.split()) - 1 and got[1, 7].changed_slots >= 3


def test_odd_items(spark):
    items = [(1, None), (2, ""), (3, "too short"), (4, ITEM), (5, FILLER), (6, FILLER * 4)]
    got = found(spark, [ITEM, FILLER * 2, "nothing at all", "this is too short."], items)
    assert {k for k in got} == {(0, 4), (1, 5), (1, 6), (3, 3)}
    assert found(spark, [ITEM], []) == {}


def test_whole_table_against_substrings(spark):
    got = {(r.doc_id, r.item_id) for r in queries.op6_decontaminate(spark, SF).collect()}
    flat = lambda t: f" {' '.join(re.sub(r'[*%$&]+', '', t or '').split())} "
    items = [(r.item_id, flat(r.text)) for r in table(spark, SF, "benchmark").collect()]
    docs = [(r.doc_id, flat(r.text)) for r in table(spark, SF, "documents").collect()]
    assert got == {(d, i) for d, t in docs for i, x in items if x in t}
    kept = {r.doc_id for r in drop_contaminated(table(spark, SF, "documents"), table(spark, SF, "benchmark")).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in got}


def labelled(spark, seed, n=600):
    random.seed(seed)
    bad = ["zorgish", "blatnik", "frumpous"]
    rows, labels = [], []
    for k in range(n):
        words = [random.choice("abcdefgh") * 2 + random.choice("ijkl") + str(random.randint(0, 99)) for _ in range(random.randint(5, 60))]
        toxic = k % 3 == 0
        for _ in range(random.randint(1, 12) if toxic else 0):
            words.insert(random.randrange(len(words)), random.choice(bad) + random.choice(["", "es", "."]))
        rows.append((k, " ".join(words), toxic))
        labels.append((k, int(toxic)))
    docs = spark.createDataFrame([(k, t, float(k)) for k, t, _ in rows], "doc_id long, text string, expected_severity double")
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_held_out(spark):
    train, labels = labelled(spark, 1)
    model = fit_severity(train, labels)
    assert (np.diff(model.thresholds) > 0).all()
    held, truth = labelled(spark, 2)
    got = score_severity(held, model).join(truth.withColumnRenamed("toxic", "y"), "doc_id")
    right = got.filter(F.col("toxic") == (F.col("y") == 1)).count()
    assert right >= 590
    means = {r.grade: r.m for r in got.groupBy("grade").agg(F.avg("expected_severity").alias("m")).collect()}
    assert list(means[g] for g in sorted(means)) == sorted(means.values()) and max(means) == 3
    assert {r.doc_id for r in drop_toxic(held, model).collect()} == {r.doc_id for r in got.filter("NOT toxic").collect()}
    assert drop_toxic(held, model).columns == held.columns


def test_toxicity_odd_rows(spark):
    train, labels = labelled(spark, 3)
    odd = spark.createDataFrame([(None, 1), (5, None), (999_999, 1), (0, 0), (0, 1)], "doc_id long, toxic int")
    model = fit_severity(train, labels.unionByName(odd))
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "zorgish blatnik zorgish"), (4, "zorgish " * 50_000), (4, "fine")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.toxic) for r in score_severity(docs, model).collect())
    assert got == [("1", False), ("2", False), ("4", False), ("4", True), ("None", True)]
    assert score_severity(docs.limit(0), model).count() == 0
    for few in (labels.limit(0), labels.filter("toxic = 0"), labels.filter("toxic = 1")):
        assert score_severity(docs, fit_severity(train, few)).filter("toxic").count() == 0


def plain_severity(text, model):
    """Expected severity, grade and verdict from the fitted numbers, one document at a time."""
    counts = {}
    for word in re.findall(r"\w+", (text or "").lower()):
        keys = [f"w{word}"] + [k for n in (4, 5) if len(word) > n for k in (f"b{word[:n]}", f"e{word[-n:]}")]
        for key in keys:
            h = xxhash.xxh64_intdigest(key.encode())
            h = h - 2**64 if h >= 2**63 else h
            if h in model.numbers:
                counts[model.numbers[h]] = counts.get(model.numbers[h], 0) + 1
    x = sum(model.weights[n] * math.log(1 + c) for n, c in counts.items())
    above = [1 / (1 + math.exp(t - x)) for t in model.thresholds]
    chances = [a - b for a, b in zip([1, *above], [*above, 0], strict=True)]
    return sum(above), max(range(len(chances)), key=lambda k: chances[k]), above[0] >= 0.5


def test_scores_of_the_whole_table_against_a_plain_recomputation(spark):
    docs = table(spark, SF, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    model = fit_severity(docs, table(spark, SF, "labels"))
    rows = queries.op8_toxicity(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        expected, grade, toxic = plain_severity(texts[r.doc_id], model)
        assert abs(r.expected_severity - expected) < 1e-9 and r.grade == grade and r.toxic == toxic
    assert {r.doc_id for r in drop_toxic(docs, model).collect()} == {r.doc_id for r in rows if not r.toxic}


def test_dropping_keeps_odd_rows(spark):
    train, labels = labelled(spark, 6)
    few = fit_severity(train, labels, features=2)
    assert len(few.numbers) == 2
    rows = [(None, None, 1), (1, "", 2), (1, "", 2), (2, "zorgish blatnik " * 9, 3), (2, "zorgish blatnik " * 9, 3), (3, ITEM, 4), (3, ITEM, 4), (None, FILLER * 2000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k1_ int")
    bench = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    for out, gone in ((drop_toxic(docs, fit_severity(train, labels)), 2), (drop_contaminated(docs, bench), 3)):
        assert out.columns == docs.columns
        assert sorted(map(str, out.collect())) == sorted(map(str, [r for r in docs.collect() if r.doc_id != gone]))
    assert drop_toxic(docs.limit(0), few).count() == 0 and drop_contaminated(docs.limit(0), bench).count() == 0


def test_recall_of_reparameterised_questions(spark):
    random.seed(12)
    names = ["Anna", "Boris", "Clara", "Dmitri", "Elena", "Farid", "Greta", "Hugo", "Ines", "Jonas"]
    units = ["kilometers", "miles", "pounds", "liters", "hours", "dollars", "grams", "minutes"]
    word = lambda: "".join(random.choice("aeioubdgklmnprst") for _ in range(random.randint(3, 8)))
    items, docs = [], []
    for n in range(150):
        frame = [random.choice(["NAME", "NUM", "UNIT"]) if random.random() < 0.25 else word() for _ in range(random.randint(16, 40))]

        def filled(slots):
            make = {"NAME": lambda: random.choice(names), "NUM": lambda: str(random.randint(2, 900)), "UNIT": lambda: random.choice(units)}
            return " ".join(slots.setdefault(k, make[w]()) if w in make else w for k, w in enumerate(frame))

        items.append((n, filled({})))
        docs.append((n, " ".join(word() for _ in range(60)) + " " + filled({}) + ". " + " ".join(word() for _ in range(60))))
    clean = [(1000 + n, " ".join(word() for _ in range(200))) for n in range(150)]
    got = {
        (r.doc_id, r.item_id)
        for r in contaminated(spark.createDataFrame(docs + clean, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    }
    right = {(n, n) for n in range(150)} & got
    assert len(right) >= 0.9 * 150 and got == right


def test_given_severities_are_used(spark):
    train, labels = labelled(spark, 4)
    graded = labels.withColumn("severity", F.when(F.col("toxic") == 1, 3).otherwise(0))
    grades = {r.grade for r in score_severity(train, fit_severity(train, graded)).collect()}
    assert grades == {0, 3}


def test_gradient_fits_an_ordinal_model():
    rng = np.random.default_rng(5)
    counts = rng.integers(0, 6, (2000, 2))
    eta = 2.0 * np.log1p(counts[:, 0]) - 1.0 * np.log1p(counts[:, 1])
    cuts = np.array([0.5, 2.0])
    grades = (rng.logistic(size=2000)[:, None] + eta[:, None] > cuts[None, :]).sum(axis=1)
    rows = [([k for k in range(2) if c[k]], [int(c[k]) for k in range(2) if c[k]]) for c in counts]
    weights, thresholds = fit_cumulative_link(rows, grades, 2, 3)
    assert np.allclose(weights, [2, -1], atol=0.25) and np.allclose(thresholds, cuts, atol=0.3)
