import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from navspark.llm import perfect_hash, queries, tokens
from navspark.llm.common import scratch
from navspark.llm.packing import fill, pack, plan
from navspark.llm.token_store import STORE_SCHEMA, BlockIndex, lookup, read_store, write_store
from navspark.llm.tokens import Encoder

P = pytest.importorskip("public_tokenizers")
BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
ODD = ["", " ", "a", "  a", "a  ", "\na", "a \n b", "x\r\ny z", "don't  's", " 's b", "é ́a", "a\x1cb c", "a\xa0b c", "<|endoftext|> x", "İ. İi ΑΣ ΣΑΣ", "日本 語\n語", "🙂 🙂\n\n🙂", "a   b\n\n d\te", None, "word, " * 3000, "a<|startoftext|>b <|endoftext|>", "<|endoftext|>", "\u00a0 x", "tail \n\n", "H\u0331. x"]


def direct(path, texts):
    t = Tokenizer.from_file(path)
    return [x.ids + [2] for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize(("path", "spaced"), [(BYTE, True), (WORD, False)])
def test_cached_encoding_is_exact(path, spaced):
    random.seed(5)
    texts = [x or "" for x in ODD] + ["".join(random.choice(" \n\tab'sé1.,İΣ ́\x1c🙂") for _ in range(random.randint(0, 40))) for _ in range(1500)]
    enc = Encoder(path, spaced)
    for _ in range(2):
        got = [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode(texts)]
        assert got == [ids[:-1] for ids in direct(path, texts)]


@pytest.mark.parametrize(("path", "spaced"), [(BYTE, True), (WORD, False)])
def test_long_texts_and_little_memory(path, spaced, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PARTS", 50)
    monkeypatch.setattr(tokens, "STEP_BYTES", 1000)
    random.seed(6)
    words = ["".join(random.choice("abcdeé") for _ in range(random.randint(1, 9))) for _ in range(400)]
    texts = [" ".join(random.choice(words) for _ in range(random.randint(0, 60))) + random.choice(["", ".", "\n\n"]) for _ in range(60)]
    texts += ["x" * 200_000, " ".join(random.choice(words) for _ in range(600_000)), None]
    enc = Encoder(path, spaced)
    assert [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode(texts)] == [ids[:-1] for ids in direct(path, texts)]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 500, 5000])
def test_perfect_hash_is_minimal_and_perfect(n):
    keys = np.unique(np.random.default_rng(n).integers(-(1 << 62), 1 << 62, n))
    displace, slots = perfect_hash.build(keys)
    assert sorted(slots.tolist()) == list(range(len(keys)))
    assert perfect_hash.slots_of(keys, displace, len(keys)).tolist() == slots.tolist()


def test_unknown_keys_are_told_apart_by_fingerprint(spark, tmp_path):
    docs = spark.createDataFrame([(k * 7, f"text {k}") for k in range(300)], "doc_id long, text string")
    write_store(docs, f"file://{tmp_path}/s", BYTE, 2)
    (row,) = spark.read.schema(STORE_SCHEMA).parquet(f"file://{tmp_path}/s").collect()
    index = BlockIndex(row.asDict())
    first, count = index.find(np.arange(0, 2100, dtype=np.int64))
    assert count[::7].tolist() == [1] * 300 and first[::7].tolist() == list(range(300))
    assert count.sum() < 305  # about one in 2**32 strangers would pass


def test_store_round_trip_over_the_table(spark):
    rows = queries.op5_token_store(spark, SF).collect()
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    start, want = 0, []
    for (d, _), ids in zip(docs, direct(BYTE, [t for _, t in docs]), strict=True):
        want.append((d, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, rows)) == want


def test_store_odd_rows_and_many_shards(spark):
    rows = [(k, t, "x") for k, t in enumerate(ODD)] + [(3, "again", "y"), (3, "again", "y"), (None, "no id", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(3)
    path = scratch(spark, "t")
    write_store(docs, path, BYTE, 2, shard_docs=4)
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.start, r.n_tokens, r.ids_crc32) for r in read_store(spark, path).collect())
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    start, want = 0, []
    for (d, _, _), ids in zip(order, direct(BYTE, [r[1] for r in order]), strict=True):
        want.append(((d is None, d or 0), start, len(ids), crc(ids)))
        start += len(ids)
    assert got == want


def test_lookup_finds_ids_and_nothing_else(spark):
    docs = spark.createDataFrame([(k * 3, f"text number {k} " * (k % 5)) for k in range(4000)] + [(30, "again")], "doc_id long, text string")
    path = scratch(spark, "t")
    write_store(docs, path, BYTE, 2, shard_docs=1500)
    got = sorted((r.doc_id, r.ids) for r in lookup(spark, path, spark.createDataFrame([(k,) for k in (30, 31, 2999, 11997, -5, 99999, 600)], "doc_id long")).collect())
    odd = docs.unionByName(spark.createDataFrame([((1 << 63) - 1, "largest"), (None, "none"), (None, "none")], docs.schema))
    odd_path = scratch(spark, "t")
    write_store(odd, odd_path, BYTE, 2)
    ask = lambda *k: sorted(str(r.doc_id) for r in lookup(spark, odd_path, spark.createDataFrame([(x,) for x in k], "doc_id long")).collect())
    assert ask((1 << 63) - 1) == [str((1 << 63) - 1)] and ask(None) == ["None", "None"] and ask(None, (1 << 63) - 1, 3) == ["3", str((1 << 63) - 1), "None", "None"]
    assert read_store(spark, odd_path).filter("doc_id IS NULL").count() == 2
    with pytest.raises(TypeError):
        write_store(docs.withColumn("doc_id", F.col("doc_id").cast("string")), odd_path, BYTE, 2)
    texts = [(30, "again"), (30, ""), (600, ""), (11997, "text number 3999 " * 4)]
    assert got == sorted((k, ids) for (k, _), ids in zip(texts, direct(BYTE, [t for _, t in texts]), strict=True))


def test_one_key_over_many_blocks_and_shards(spark):
    rows = spark.range(100_000).select(F.when(F.col("id") % 5 == 0, F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 4000).alias("text"))
    rows = rows.unionByName(spark.range(3000).select(F.lit(35).alias("doc_id"), F.concat(F.lit("more "), F.col("id")).alias("text")))
    path = scratch(spark, "t")
    write_store(rows, path, BYTE, 2, shard_docs=20_000)
    blocks = spark.read.schema(STORE_SCHEMA).parquet(path).select("shard", "block", "first", "last").collect()
    hot = [b for b in blocks if b.first == b.last == (1 << 63) - 1]
    assert len(hot) > 60 and len({b.shard for b in hot}) > 2 and max(b.block for b in blocks) < 40
    read = read_store(spark, path).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("start").alias("starts")).filter("n > 1").collect()
    assert sorted((r.doc_id or -1, r.n, r.starts) for r in read) == [(-1, 80_000, 80_000), (35, 3001, 3001)]
    found = lookup(spark, path, spark.createDataFrame([(35,), (40,), (41,), (None,)], "doc_id long")).groupBy("doc_id").count().collect()
    assert sorted((r.doc_id or -1, r["count"]) for r in found) == [(-1, 80_000), (35, 3001), (40, 1)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    path = scratch(spark, "t")
    write_store(docs, path, BYTE, 2)
    assert read_store(spark, path).count() == 0
    assert pack(docs, WORD, 2).count() == 0


def check_packing(rows, want_ids, window):
    """rows: (doc, start, length, crc, doc_tokens, sequence, offset)."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r[0], []).append(r)
        by_seq.setdefault(r[5], []).append((r[6], r[2]))
    for doc, ids in want_ids.items():
        at = 0
        for _, start, length, c, total, _, _ in sorted(by_doc[doc], key=lambda r: r[1]):
            assert start == at and total == len(ids) and c == crc(ids[start : start + length])
            at += length
        assert at == len(ids)
    assert sorted(by_seq) == list(range(len(by_seq)))
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= window
    return sum(len(x) for x in want_ids.values()) / (window * len(by_seq))


def test_packing_over_the_table(spark):
    got = queries.op9_packing(spark, SF).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset").collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    full = check_packing(got, dict(zip([d for d, _ in docs], direct(WORD, [t for _, t in docs]), strict=True)), 4096)
    assert full > 0.98


def test_packing_odd_rows_small_window(spark):
    odd = spark.createDataFrame([(None, "no id here"), (None, None), (3, "twice"), (3, "twice")], "doc_id long, text string").withColumn("length", F.lit(1))
    assert sorted(str((r.doc_id, r.length)) for r in pack(odd, WORD, 2).collect()) == ["(3, 2)", "(3, 2)", "(None, 1)", "(None, 4)"]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(ODD)], "doc_id long, text string, length int").repartition(3)
    got = pack(docs, WORD, 2, window=16)
    ids = {r.doc_id: b"" for r in got.select("doc_id").collect()}
    for r in got.orderBy("doc_id", "start").collect():
        ids[r.doc_id] += bytes(r.ids)
    want = dict(enumerate(direct(WORD, ODD)))
    assert {k: np.frombuffer(v, "<u2").tolist() for k, v in ids.items()} == want
    check_packing(got.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset").collect(), want, 16)


def test_fill_is_the_best_subset():
    random.seed(3)
    for _ in range(200):
        counts = {random.randint(1, 30): random.randint(1, 3) for _ in range(random.randint(1, 5))}
        space = random.randint(0, 60)
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * m for s in sums for m in range(n + 1)}
        taken = fill(counts, sorted(counts, reverse=True), space)
        assert sum(k * n for k, n in taken.items()) == max(s for s in sums if s <= space)
        assert all(n <= counts[k] for k, n in taken.items())


def test_plan_places_every_piece_once():
    random.seed(4)
    histogram = {random.randint(1, 100): random.randint(1, 400) for _ in range(40)}
    layout = plan(histogram, 100)
    fills = {}
    for k, n in histogram.items():
        seq, off = layout.place(np.full(n, k), np.arange(n))
        for s, o in zip(seq.tolist(), off.tolist(), strict=True):
            fills.setdefault(s, []).append((o, k))
    assert sorted(fills) == list(range(layout.windows))
    for items in fills.values():
        at = 0
        for o, k in sorted(items):
            assert o == at
            at += k
        assert at <= 100
