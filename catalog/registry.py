"""Registration and the shared inputs of the queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.records import CPT, ITEM_BITS, as_records, metadata, position
from corpusmill.operators.structure import fold_turns

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function name, with its checking SQL."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def doc_of(ord_: Column) -> Column:
    """The source position packed in ``ord``."""
    return F.shiftright(ord_, ITEM_BITS)


def document_metadata() -> Column:
    return metadata(
        F.col("doc_id"), F.col("source"), F.sha2("text", 256), chunk_id=F.concat(F.col("doc_id").cast("string"), F.lit("-0"))
    )


def cpt_documents(spark: SparkSession, folder: str, *keep: str) -> DataFrame:
    """Every document as one text record, in doc_id order."""
    docs = table(spark, folder, "documents")
    return as_records(docs, CPT, *keep, ord=position(F.col("doc_id")), text=F.col("text"), metadata=document_metadata())


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with quality and toxic where they have labels."""
    return table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")


def conversations(spark: SparkSession, folder: str) -> DataFrame:
    """(conv_id, messages) in turn order."""
    return fold_turns(table(spark, folder, "conversations"), "conv_id", "turn")


def row_columns(ord_: Column, name: Column, row_id: Column) -> list[Column]:
    """The columns every structured row carries besides its fields."""
    return [
        ord_.alias("ord"),
        F.lit("d").alias("document_id"),
        name.alias("source_name"),
        F.sha2(name, 256).alias("source_hash"),
        row_id.cast("string").alias("row_id"),
    ]
