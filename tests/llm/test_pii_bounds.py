"""Candidates for personal data whose length has no bound, and texts with very many of them."""

import random
import time

from pyspark.sql import functions as F

from navspark.llm import pii
from navspark.llm.pii import find_candidates, find_pii, free_spans


def test_long_secrets_and_hidden_addresses_are_whole(spark):
    texts = {1: "api_key=" + "a1" * 300, 2: "x" * 90 + " (at) example (dot) org", 3: 'password: "' + "b" * 700 + '" next', 4: "token=short"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.found] for r in find_candidates(docs).collect()}
    assert got == {1: [(4, 0, 608)], 2: [(0, 0, 113)], 3: [(4, 0, 712)], 4: []}


def test_many_spans_in_one_text_take_no_longer_than_their_number(spark):
    text = " ".join(f"write to user{k} (at) example (dot) org or user{k}@example.org" for k in range(10_000))
    docs = spark.createDataFrame([(1, text), (2, "a@b.co")], "row long, text string")
    began = time.perf_counter()
    got = {r.row: [(s.kind, text[s.start : s.end], s.base) for s in r.spans] for r in find_pii(docs, id_col="row").collect()}
    assert time.perf_counter() - began < 120
    assert sum(base for _, _, base in got[1]) == 10_000 and got[1][-1] == (0, "user9999@example.org", True) and len(got[2]) == 1


def test_starts_against_plain_sums(spark):
    for n in (0, 1, pii.RUN - 1, pii.RUN, pii.RUN + 1, 3 * pii.RUN + 7):
        lengths = [random.randint(0, 9) for _ in range(n)]
        got = spark.createDataFrame([(lengths,)], "x array<int>").select(pii._starts(F.col("x")).alias("s")).first().s
        assert got == [sum(lengths[:k]) for k in range(n)]


def test_free_spans_against_all_pairs(spark):
    random.seed(2)
    spans = {(row, a, random.choice([0, 3, 4]), a + random.randint(1, 6), random.random() < 0.2) for row in range(40) for a in (random.randint(0, 40) for _ in range(random.randint(1, 14)))}
    rows = spark.createDataFrame([(r, (a, k, e, b)) for r, a, k, e, b in spans], "row long, s struct<start:int,kind:int,end:int,base:boolean>")
    got = {(r.row, s.start, s.kind, s.end) for r in free_spans(rows).collect() for s in r.added}
    over = lambda x, y: x[0] == y[0] and x[1] < y[3] and y[1] < x[3]
    wider = lambda x, y: x[1] < y[1] or (x[1] == y[1] and x[3] > y[3])
    likely, base = [s for s in spans if not s[4]], [s for s in spans if s[4]]
    assert got == {s[:4] for s in likely if not any(over(b, s) for b in base) and not any(over(o, s) and wider(o, s) for o in likely)}
