"""The training-text pipeline: STAGES over the documents table, each reading what the one before it wrote."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.decontamination import without_passages
from corpusmill.llm.line_dedup import dedup_lines, unused
from corpusmill.llm.ngram_join import one_of_each_class
from corpusmill.llm.packing import concat_and_cut, tokenized
from corpusmill.llm.quality import keep_quality
from corpusmill.session import materialize, ship_package

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality cascade rejects go."""
    return keep_quality(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-equal lines one stays; a document that has no word left goes."""
    ship_package(spark)
    total, taken = unused("_n_lines", docs.columns), unused("_n_gone", docs.columns)
    cut = dedup_lines(docs, n_lines=total, n_gone=taken).where((F.col(taken) == 0) | F.rlike("text", F.lit(r"\S")))
    changed = F.when(F.col(taken) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", changed).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of similar documents the first stays."""
    ship_package(spark)
    return one_of_each_class(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    ship_package(spark)
    return without_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows, one row per piece of a document."""
    ship_package(spark)
    return concat_and_cut(tokenized(docs, TOKENIZER))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]

# Near duplicates and alignment are not expressible in SQL; a test holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{k}")
    return docs
