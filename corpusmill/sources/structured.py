"""CSV, JSON and JSONL files as rows of (path, row_no, row_id, data).

``data`` is MAP<STRING, VARIANT>: free-form keys, values with their JSON types.
One file is one source and stays under the upload ceiling, so a CSV or JSON
file, which cannot be split, is a bounded piece of work; JSONL is split freely.
"""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.functions.text import fail_unless, has_text, strip
from corpusmill.session import join_bounded

ROW_DATA = "map<string,variant>"


class UnsupportedFormat(ValueError):
    """The suffix names no structured format."""


class EmptySource(ValueError):
    """A structured source without a single row."""


def number_rows(df: DataFrame) -> DataFrame:
    """Add ``path`` and the 0-based ``row_no`` of every row within its file.

    Rows of one split are consecutive, so a row's number is its distance from
    the first row of its split plus the rows of the file's earlier splits.  The
    only lookup is one narrow row per split.
    """
    rows = df.select(
        "*",
        F.col("_metadata.file_path").alias("path"),
        F.xxhash64("_metadata.file_path", "_metadata.file_block_start").alias("_split"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
    )
    splits = rows.groupBy("path", "_start", "_split").agg(F.min("_id").alias("_first"), F.count("*").alias("_rows"))
    earlier = W.partitionBy("path").orderBy("_start").rowsBetween(W.unboundedPreceding, -1)
    offsets = splits.select(
        "_split", (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_offset")
    )
    return (
        join_bounded(rows, offsets, ["_split"])
        .withColumn("row_no", F.col("_id") + F.col("_offset"))
        .drop("_split", "_start", "_id", "_offset")
    )


def _finish(df: DataFrame, data: Column) -> DataFrame:
    return df.select("path", "row_no", F.col("row_no").cast("string").alias("row_id"), data.cast(ROW_DATA).alias("data"))


def read_csv_rows(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Header CSV; every value is a string, blank lines are skipped, quoted
    newlines and doubled quotes are kept, a short row has null cells."""
    raw = spark.read.csv(
        path,
        header=True,
        multiLine=True,
        escape='"',
        emptyValue="",
        nullValue="\u0000",
        inferSchema=False,
        enforceSchema=False,
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )
    cells = [part for name in raw.columns for part in (F.lit(name), F.col(f"`{name}`").cast("variant"))]
    return _finish(number_rows(raw), F.create_map(*cells))


_NO_ROWS = "no rows in "


def read_json_rows(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A JSON array gives one row per element, a JSON object one row; a malformed file fails the job, and
    so does an array without elements, which would leave no trace among other files."""
    text = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), strip(F.col("value")).alias("value")
    )
    items = F.when(F.startswith("value", F.lit("[")), F.from_json("value", "array<string>")).otherwise(F.array("value"))
    text = text.where(fail_unless(items.isNotNull(), F.concat(F.lit("malformed JSON array in "), F.col("path"))))
    text = text.where(fail_unless(F.size(items) > 0, F.concat(F.lit(_NO_ROWS), F.col("path"))))
    rows = text.select("path", F.posexplode(items).alias("row_no", "item"))
    return _finish(rows.withColumn("row_no", F.col("row_no").cast("bigint")), F.parse_json("item"))


def read_jsonl_rows(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One JSON object per line; blank lines are skipped but keep their number."""
    lines = number_rows(spark.read.text(path)).where(has_text(F.col("value")))
    return _finish(lines, F.parse_json("value"))


# Structured suffixes.
READERS = {".csv": read_csv_rows, ".json": read_json_rows, ".jsonl": read_jsonl_rows}


def suffix_of(path: Column) -> Column:
    """Lower-cased suffix of the last path segment, '' when there is none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def read_structured(spark: SparkSession, path: str) -> DataFrame:
    """Read one source by the suffix of its name; it must have a row."""
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    suffix = name[name.rfind(".") :] if "." in name[1:] else ""
    if suffix not in READERS:
        raise UnsupportedFormat(f"{name}: no structured format has the suffix {suffix!r}")
    rows = READERS[suffix](spark, path)
    try:
        empty = rows.isEmpty()
    except PySparkException as error:
        if _NO_ROWS not in str(error):
            raise
        empty = True
    if empty:
        raise EmptySource(f"{name}: no rows")
    return rows


def attach_sources(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Give rows the columns of their source, matched on ``path``."""
    return join_bounded(rows, sources, ["path"])
