"""Importance resampling against a plain version, the draw's ties, odd rows."""

import hashlib
import math
import random
import zlib

from navspark.llm import importance
from navspark.llm.importance import WordTrie, resample, word_lists


def plain_words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        c = chr(ord(c) + 32) if "A" <= c <= "Z" else c
        if ord(c) > 127 or "0" <= c <= "9" or "a" <= c <= "z":
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def plain_runs(text, shortest, longest):
    words = plain_words(text)
    return [" ".join(words[k : k + n]) for n in range(shortest, longest + 1) for k in range(len(words) - n + 1)]


def plain(docs, target, shortest=1, longest=1, buckets=10_000, percent=10, min_words=20):
    def totals(texts):
        out = [0] * buckets
        for text in texts:
            for run in plain_runs(text, shortest, longest):
                out[zlib.crc32(run.encode()) % buckets] += 1
        return out

    s, t = totals(x for _, x in docs), totals(target)
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t, strict=True)]
    rows = []
    for d, text in docs:
        runs = plain_runs(text, shortest, longest)
        weight = sum(gain[zlib.crc32(r.encode()) % buckets] for r in runs) // len(runs) if runs else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, len(runs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(plain_words(text))))
    able = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = [(*r[:4], k) for k, r in enumerate(able[: len(able) * percent // 100], 1)]
    return sorted(drawn) + sorted(((*r[:4], None) for r in rows), key=str)


def check(spark, docs, target, **options):
    got = [tuple(r) for r in resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame([(x,) for x in target], "text string"), **options).collect()]
    want = plain(docs, target, **options)
    drawn = [r for r in want if r[4] is not None]
    assert sorted(r for r in got if r[4] is not None) == drawn
    rest = [r for r in want if r[4] is None]
    for r in drawn:
        rest.remove((*r[:4], None))
    assert sorted((r for r in got if r[4] is None), key=str) == rest


def texts(n, seed=5):
    random.seed(seed)
    words = ["Zug", "straße", "naïve", "x9", "The", "OF", "gamma", "日本", "e-mail"] + [f"w{k}" for k in range(60)]
    return [" ".join(random.choice(words) + random.choice(["", ",", "!", "\x00", "\n"]) for _ in range(random.randint(0, 60))) for _ in range(n)]


def test_against_plain_version(spark):
    docs = list(enumerate([*texts(120), None, "", "...", "w1 " * 30, "w1 " * 30]))
    check(spark, docs, texts(15, 6))
    check(spark, docs, texts(15, 6), shortest=1, longest=3, buckets=97, percent=37, min_words=3)
    check(spark, docs, texts(15, 6), shortest=2, longest=2, percent=100, min_words=0)


def test_small_tries_and_slices_change_nothing(spark, monkeypatch):
    raw = " ".join(texts(40)).encode()
    whole = WordTrie(1, 3, 97)
    whole.add(raw)
    whole.drain()
    monkeypatch.setattr(importance, "SLICE", 64)
    cut = WordTrie(1, 3, 97, nodes=10)
    cut.add(raw)
    cut.drain()
    assert (whole.totals == cut.totals).all() and whole.totals.sum() == sum(len(plain_runs(raw.decode(), n, n)) for n in (1, 2, 3))
    gains = list(range(97))
    assert WordTrie(1, 3, 97, gains, nodes=10).score(raw) == WordTrie(1, 3, 97, gains).score(raw)
    assert sum(n for _, n in word_lists(raw, 3)) == len(plain_words(raw.decode()))
    assert list(word_lists(b"", 2)) == [] and [w for w, _ in word_lists(b"x" * 500, 2)] == [[b"x" * 500]]


def test_repeated_ids_nulls_and_empty_tables(spark):
    repeated = [(7, "w1 w2 w3 " * 10)] * 50 + [(None, "w1 w2 " * 12)] * 3 + [(k, t) for k, t in enumerate(texts(30))]
    check(spark, repeated, ["w1 w2"], percent=60)
    check(spark, repeated, [], percent=60)
    check(spark, repeated, [None, ""], percent=0)
    assert resample(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([("a",)], "text string")).count() == 0


def test_names_of_working_columns(spark):
    docs = spark.createDataFrame([("a", "w1 " * 25, 1, 2, 3), ("b", "w2 " * 25, 1, 2, 3)], "id string, body string, score int, rank int, words int")
    got = resample(docs, spark.createDataFrame([("w1",)], "text string"), percent=50, id_col="id", text_col="body")
    assert got.columns == ["id", "n_features", "weight", "score", "rank"] and sorted(r.rank or 0 for r in got.collect()) == [0, 1]
