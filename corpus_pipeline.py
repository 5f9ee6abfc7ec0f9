"""The corpus pipeline: toxicity, line deduplication, near duplicates, benchmark decontamination, packing.

Each stage works on all that the one before kept. Its result is written as Parquet in the shared folder
and read again, so a stage is never computed twice and a lost executor costs at most the stage it was in.

Defined cases, for all stages: null texts count as empty; a null id is larger than every other and no id is relied on to be
unique; of rows that are equal in id and text one stays in near dedup, and all in the other stages; ties go to the smallest
id; empty tables give empty results; extra columns of any name pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navspark.llm.common import drop_path, owned_scratch, scratch, table
from navspark.llm.decontaminate import drop_contaminated
from navspark.llm.line_dedup import dedup_lines
from navspark.llm.packing import pack
from navspark.llm.queries import END_ID, tokenizer_path
from navspark.llm.shingle_dedup import drop_similar
from navspark.llm.toxicity import drop_toxic, fit_severity

#: Near duplicates here: sets of five-word shingles with a Jaccard similarity of 0.8 or more.
SHINGLE_WORDS, SIMILARITY = 5, 0.8


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model finds toxic go. It is fitted on labelled rows among the documents given."""
    return drop_toxic(docs, fit_severity(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; documents stay. n_chars follows the text."""
    cut = dedup_lines(docs)
    return cut.select(*(F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return drop_similar(docs, words=SHINGLE_WORDS, similarity=SIMILARITY)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, verbatim or with other values in it, go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of what is left."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"), END_ID)


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The severity model, XXH64 and the tokenizer are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents of ``sf_dir``. What a stage leaves in scratch space is deleted when its result is written,
    and that when the next one's is."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name.replace(' ', '-')}")
        with owned_scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            drop_path(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
