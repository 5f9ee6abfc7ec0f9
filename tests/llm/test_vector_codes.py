"""Product quantisation against a plain version, what a round shuffles, odd rows."""

import hashlib
import math
import random

import numpy as np
import pytest

from navspark.llm import vector_codes
from navspark.llm.vector_codes import books_digest, changes, compress_vectors, nearest

KIND = "vec_id long, embedding array<float>, label int"


def plain(rows, parts, entries, rounds):
    kept = [(i, [math.floor(1024 * np.float32(x).item()) for x in v], n) for i, v, n in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]

    def code(v, p):
        d = [sum((a - b) ** 2 for a, b in zip(cut(v, p), c, strict=True)) for c in books[p]]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        chosen = [[code(v, p)[0] for p in range(parts)] for _, v, _ in kept]
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [cut(v, p) for (_, v, _), c in zip(kept, chosen, strict=True) if c[p] == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    out = []
    for i, v, n in kept:
        found = [code(v, p) for p in range(parts)]
        out.append((i, bytes(c for c, _ in found).hex(), sum(d for _, d in found), n))
    by_label = {}
    for _, _, d, n in out:
        by_label[n] = by_label.get(n, 0) + d
    text = ",".join(str(x) for book in books for entry in book for x in entry)
    return sorted(((i, c, d, by_label[n]) for i, c, d, n in out), key=str), hashlib.sha256(text.encode()).hexdigest()


def check(spark, rows, parts=2, entries=4, rounds=3):
    found, books = compress_vectors(spark.createDataFrame(rows, KIND).repartition(3), parts, entries, rounds)
    got = sorted(((r.vec_id, bytes(r.code).hex(), r.error, r.label_error) for r in found.collect()), key=str)
    assert (got, books_digest(books)) == plain(rows, parts, entries, rounds)


def vectors(n, width=6, seed=3):
    random.seed(seed)
    return [(k, [random.gauss(k % 5, 0.4) for _ in range(width)], random.choice([None, 1, 2])) for k in range(n)]


def test_against_plain_version(spark):
    check(spark, vectors(80))
    check(spark, vectors(80), parts=3, entries=7, rounds=0)
    check(spark, vectors(9), entries=200, rounds=2)


def test_odd_rows(spark):
    odd = [(100, None, 1), (101, [1.0, None, 0.0], 1), (102, [float("nan")] * 6, 1), (103, [float("inf")] + [0.0] * 5, None)]
    same = [(5, [1.5] * 6, None)] * 30 + [(None, [-2.25] * 6, 3), (5, [0.0] * 6, 2)]
    check(spark, vectors(40) + odd + same)
    check(spark, same, entries=40)
    empty, books = compress_vectors(spark.createDataFrame(odd, KIND))
    assert empty.count() == 0 and empty.columns == ["vec_id", "code", "error", "label_error"] and books.size == 0
    short, _ = compress_vectors(spark.createDataFrame([*vectors(8), (200, [1.0] * 5, 1)], KIND), 2, 4, 1)
    assert short.count() == 8
    with pytest.raises(ValueError, match="equal parts"):
        compress_vectors(spark.createDataFrame(vectors(5), KIND), 4)


def test_large_components(spark):
    check(spark, [(k, [random.uniform(-60000, 60000) for _ in range(6)], k % 2) for k in range(30)])
    v = np.array([[1 << 26, -(1 << 26)], [3, 4]])
    assert [x.tolist() for x in nearest(v, np.array([[0, 0], [3, 4], [3, 4]]))] == [[0, 1], [2 * (1 << 52), 0]]


def test_only_parts_that_moved_are_sent(spark):
    table = spark.createDataFrame(
        [(0, [1, 2, 3, 4], bytearray([0, 1]), None), (1, [5, 6, 7, 8], bytearray([1, 1]), bytearray([0, 1])), (2, [9, 9, 9, 9], bytearray([0, 0]), bytearray([0, 0]))],
        "id long, v array<int>, code binary, old binary",
    )
    got = changes(table, np.zeros((2, 2, 2), np.int64))
    assert got.tolist() == [[[0, 1 - 5, 2 - 6], [1, 5, 6]], [[0, 0, 0], [1, 3, 4]]]


def test_running_sums_equal_fresh_ones(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(vector_codes, "changes", lambda table, books, f=changes: seen.append(table.filter("NOT code <=> old").count()) or f(table, books))
    check(spark, vectors(200), entries=5, rounds=5)
    assert seen[0] == 200 and seen[-1] < 100


def test_names_of_working_columns(spark):
    rows = spark.createDataFrame([(k, [float(k)] * 4, k % 2, "x", "y") for k in range(6)], "id long, v array<double>, label long, code string, old string")
    found, _ = compress_vectors(rows, 2, 3, 2, "id", "v")
    assert found.columns == ["id", "code", "error", "label_error"] and found.count() == 6
