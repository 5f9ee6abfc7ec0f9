"""Tables whose columns have the names of working columns."""

from pyspark.sql import functions as F

from navspark.llm.common import bit_filter, maybe_in
from navspark.llm.decontaminate import drop_contaminated
from navspark.llm.exact_dedup import exact_dedup
from navspark.llm.importance import resample
from navspark.llm.pii import find_pii
from navspark.llm.reshard import file_row, reshard, rewrite_affected
from navspark.llm.secrets import find_secrets

NAMES = ["_number", "_bits", "_row", "_file", "row", "found", "base", "likely", "spans", "score", "rank", "words", "h", "_len", "_norm", "s", "id"]


def table(spark, n=6):
    docs = spark.createDataFrame([(k, f"some words of the text number {k % 4}") for k in range(n)], "doc_id long, text string")
    return docs.select("*", *(F.lit(f"own {c}").alias(c) for c in NAMES))


def own(rows):
    return all(r[c] == f"own {c}" for r in rows for c in NAMES)


def test_rows_pass_with_all_their_columns(spark):
    docs = table(spark)
    bits = bit_filter(docs.filter("doc_id < 2").select("doc_id"), ["doc_id"])
    marked = maybe_in(docs, ["doc_id"], bits, "maybe").collect()
    assert own(marked) and {r.doc_id for r in marked if r.maybe} == {0, 1}
    kept = drop_contaminated(docs, spark.createDataFrame([(1, "of the text number 2")], "item_id long, text string"))
    assert kept.columns == docs.columns and own(kept.collect())


def test_rewritten_files_hold_all_columns(spark, tmp_path):
    table(spark, 40).write.parquet(f"file://{tmp_path}/docs")
    docs = spark.read.parquet(f"file://{tmp_path}/docs")
    placed, _ = reshard(docs, F.lit(0), 2, file_row())
    rewrite_affected(docs, placed, f"file://{tmp_path}/shards", file_row())
    got = spark.read.parquet(f"file://{tmp_path}/shards").collect()
    assert len(got) == 40 and own(got)


def test_operators_take_such_tables(spark):
    docs = table(spark)
    assert exact_dedup(docs).filter("kept").count() == 4
    assert find_pii(docs).count() == find_secrets(docs).count() == 6
    assert resample(docs, spark.createDataFrame([("words",)], "text string"), min_words=1).count() == 6
