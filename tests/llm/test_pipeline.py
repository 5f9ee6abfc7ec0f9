import re

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_shingle_dedup import leaders
from test_tokens import WORD, check_packing, direct

from navspark.llm.common import table

SF = "/root/testdata/sf0.001"


def lines_kept(docs):
    """Plain line deduplication: {id: text} to {id: text}."""
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    first = {}
    for d in sorted(docs):
        for line in (docs[d] or "").split("\n"):
            if len(key(line)) >= 10:
                first.setdefault(key(line), d)
    return {d: "\n".join(x for x in (t or "").split("\n") if len(key(x)) < 10 or first[key(x)] == d) for d, t in docs.items()}


def holds(text, items):
    flat = f" {' '.join(text.lower().split())} "
    return any(f" {' '.join(i.lower().split())} " in flat for i in items)


def test_each_stage_against_a_plain_version(spark):
    docs = table(spark, SF, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    columns = docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name == "packing":
            rows = out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset").collect()
            check_packing(rows, dict(zip(texts, direct(WORD, texts.values()), strict=True)), 4096)
            break
        assert out.columns == columns
        rows = out.collect()
        got = {r.doc_id: r.text for r in rows}
        assert all(r.n_chars == len(r.text or "") for r in rows)
        if name == "toxicity":
            assert set(got) <= set(texts) and all(texts[d] == t for d, t in got.items())
            gone = set(texts) - set(got)
            toxic = {r.doc_id for r in table(spark, SF, "labels").filter("toxic = 1").collect()}
            clean = {r.doc_id for r in table(spark, SF, "labels").filter("toxic = 0").collect()}
            assert len(gone & clean) <= 0.05 * len(clean)
            kept.append(len(gone & toxic))
        elif name == "line dedup":
            assert got == lines_kept(texts)
        elif name == "near dedup":
            assert set(got) == leaders(texts)
        else:
            items = [r.text for r in table(spark, SF, "benchmark").collect()]
            assert set(got) == {d for d, t in texts.items() if not holds(t, items)}
        docs = spark.createDataFrame(rows, docs.schema)
        texts = got


def test_run_gives_the_packed_pieces(spark):
    out = corpus_pipeline.run(spark, SF)
    rows = out.collect()
    assert rows and np.unique([r.sequence_id for r in rows]).tolist() == list(range(max(r.sequence_id for r in rows) + 1))


ROWS = [
    (None, None, "x"), (None, "a text without an id stands here alone", "x"), (1, "", "y"), (1, "", "y"), (2, None, "y"), (3, "word " * 30_000, "z"),
    (4, "the same line in two of them\nand one of its own here", "z"), (5, "the same line in two of them\nnothing else is like it", "z"), (6, "tie tie tie", "t"), (7, "tie tie tie", "t"),
]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, name):
    """Null ids and texts, repeated rows, ties, long texts, an empty table, columns that clash with working names."""
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.createDataFrame([(d, t, lang, lang, len(t or ""), 1, 2) for d, t, lang in ROWS], "doc_id long, text string, lang string, source string, n_chars long, leader_ int, k1_ int")
    docs = docs.withColumn("n_lines", F.lit(3)).withColumn("fp", F.lit(4))
    out = stage(spark, docs, SF)
    assert stage(spark, docs.limit(0), SF).count() == 0
    if name == "packing":
        assert sorted(str(r.doc_id) for r in out.filter("start = 0").collect()) == sorted(str(d) for d, _, _ in ROWS)
        return
    assert out.columns == docs.columns
    ids = sorted(str(r.doc_id) for r in out.collect())
    dropped = {"near dedup": ["1", "2", "7", "None"]}.get(name, [])
    want = [str(d) for d, _, _ in ROWS]
    for d in dropped:
        want.remove(d)
    assert ids == sorted(want)
