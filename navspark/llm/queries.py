"""The registered query of each operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navspark.llm.common import owned_scratch, scratch, table
from navspark.llm.decontaminate import contaminated
from navspark.llm.exact_dedup import exact_dedup
from navspark.llm.importance import resample
from navspark.llm.line_dedup import dedup_lines
from navspark.llm.near_dedup import near_duplicates
from navspark.llm.packing import pack
from navspark.llm.pii import BASE_KINDS, KINDS, find_pii, span_string
from navspark.llm.reshard import file_row, reshard, rewrite_affected, text_size
from navspark.llm.secrets import KINDS as SECRET_KINDS
from navspark.llm.secrets import find_secrets, secret_string
from navspark.llm.token_store import read_store, write_store
from navspark.llm.toxicity import fit_severity, score_severity
from navspark.llm.url_filter import filter_urls, parse_rule
from navspark.llm.vector_codes import books_digest, compress_vectors

URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
END_ID = 2
#: The layout that the resharding query starts from, by hash of the id, and the one it goes to.
OLD_SHARDS, NEW_SHARDS = 32, 40


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), [parse_rule(*r) for r in URL_RULES])


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(table(spark, sf_dir, "documents"), digest_all=True)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op4_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read back from the files of the shards that changed, and the plan's rows of shards that did not."""
    docs, path, plan = table(spark, sf_dir, "documents"), scratch(spark, "shards"), scratch(spark, "reshard-plan")
    old = F.pmod(F.xxhash64("doc_id"), F.lit(OLD_SHARDS))
    with owned_scratch(spark):  # what led to the plan goes before texts are rewritten
        placed, _ = reshard(docs, old, NEW_SHARDS, file_row())
        placed.write.parquet(plan)
    placed = spark.read.schema(placed.schema).parquet(plan)
    changed = sorted(rewrite_affected(docs.select("doc_id", "text"), placed, path, file_row()))
    columns = ["doc_id", "size", "text_crc32", "shard", "slot"]
    kept = docs.select("doc_id", file_row().alias("row")).join(placed.filter(~F.col("shard").isin(changed)), "row").select(columns)
    if changed:
        kind = docs.schema["doc_id"].dataType.simpleString()
        files = spark.read.schema(f"doc_id {kind}, text string, slot long, shard int").parquet(path)
        crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
        kept = kept.unionByName(files.select("doc_id", text_size(F.col("text")).alias("size"), crc.alias("text_crc32"), "shard", "slot"))
    return kept.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-store")
    write_store(table(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"), END_ID)
    return read_store(spark, path)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_severity(docs, fit_severity(docs, table(spark, sf_dir, "labels")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), END_ID).drop("ids")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [F.size(F.array_remove(kinds, k)) for k in range(BASE_KINDS)]
    counts = [(F.size(base) - n).cast("long").alias(f"n_{KINDS[k]}") for k, n in enumerate(counts)]
    found = find_pii(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *counts, F.sha2(span_string(base).cast("binary"), 256).alias("base_sha256"), span_string(F.col("spans")).alias("spans"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress_vectors(table(spark, sf_dir, "embeddings"))
    digest = F.lit(books_digest(books)).alias("codebooks_sha256")
    return coded.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", digest)


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = SECRET_KINDS.index("novel")
    base = F.filter("spans", lambda s: s["kind"] < added)
    # no second parameter for the kind: Spark hands a function of two parameters the place in the array
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size("spans") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{SECRET_KINDS[k]}") for k in range(added)]
    found = find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *counts, F.sha2(secret_string(base).cast("binary"), 256).alias("base_sha256"), secret_string(F.col("spans")).alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_simhash, op3_exact_dedup, op4_reshard, op5_token_store, op6_decontaminate, op7_line_dedup, op8_toxicity, op9_packing, op10_pii, op11_importance,
        op12_vector_codes, op13_secrets,
    )
}
