"""Reading, listing, writing and checking accepted records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions.records import EXPORT_COLUMNS, RECORD_FIELDS
from corpusmill.functions.text import fail_unless
from corpusmill.session import materialize

# A row's part and its number there as one number, as monotonically_increasing_id() has it.
_ROWS_OF_A_PART = 33


class ReloadMismatch(RuntimeError):
    """What was read back is not what was written."""


def _schema(kind: str) -> str:
    return ", ".join(f"{name} {RECORD_FIELDS[column]}" for name, column in EXPORT_COLUMNS[kind].items())


def load_jsonl(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Records of one kind from JSONL; blank lines are skipped, a malformed line
    or a missing required field fails the job."""
    rows = spark.read.schema(_schema(kind)).option("mode", "FAILFAST").json(path)
    required = [*EXPORT_COLUMNS[kind], "metadata.document_id", "metadata.source_name", "metadata.source_hash"]
    for name in required:
        rows = rows.where(fail_unless(F.col(name).isNotNull(), F.lit(f"a record has no {name}")))
    return rows


def first_records(records: DataFrame, limit: int = 20) -> DataFrame:
    """The first ``limit`` records in order, each with the number of all."""
    total = records.agg(F.count("*").alias("total"))
    first = records.orderBy("ord").limit(limit)
    return first.withColumn("total", total.scalar())


def export_rows(records: DataFrame, kind: str) -> DataFrame:
    """The columns of an exported kind; an empty ``extra`` map becomes null."""
    columns = [F.col(column).alias(name) for name, column in EXPORT_COLUMNS[kind].items() if name != "metadata"]
    extra = F.when(F.size("metadata.extra") > 0, F.col("metadata.extra"))
    return records.where(F.col("kind") == kind).select(*columns, F.col("metadata").withField("extra", extra).alias("metadata"))


def fingerprint(df: DataFrame) -> tuple[Column, Column, Column]:
    """Row count and two order-free 64-bit sums over whole rows (maps included).

    One pass and no shuffle, where a set difference both ways would sort
    everything twice.
    """
    row = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    as_sum = lambda h: F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    return (
        F.count("*").alias("n"),
        as_sum(F.xxhash64(row)).alias("sum_a"),
        as_sum(F.xxhash64(F.reverse(row), F.lit(1))).alias("sum_b"),
    )


def reload_check(written: dict, reloaded: DataFrame) -> None:
    """Raise unless ``reloaded`` has the fingerprint in ``written``."""
    found = reloaded.agg(*fingerprint(reloaded)).first().asDict()
    if found != written:
        raise ReloadMismatch(f"wrote {written}, read back {found}")


def _with_places(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of written Parquet files with ``_part`` and ``_row``, where each of them lies."""
    part = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("bigint")
    return spark.read.schema(schema).parquet(path).select("*", part.alias("_part"), F.col("_metadata.row_index").alias("_row"))


def export_bundle(records: DataFrame, kind: str, folder: str) -> int:
    """Write train.parquet and train.jsonl below ``folder``, in the order of ``ord``; no records, no files.

    Records are computed once and sorted over range partitions, a part file each, so the files in the
    order of their numbers are the records in order.  The fingerprint, which holds the place of every row, is
    observed while the Parquet files are written; it is checked on what is read back, and the JSONL is
    written from that.  ``parts.parquet`` beside them has (part, rows, first, last), the positions
    of a part's rows among all.
    """
    spark = records.sparkSession
    # Sorting reads its input twice, to draw the bounds and to sort.
    chosen = materialize(records.where(F.col("kind") == kind), "export-records")
    if chosen.isEmpty():
        return 0
    rows = export_rows(chosen.orderBy("ord"), kind)
    placed = rows.withColumn("_at", F.monotonically_increasing_id())
    seen = Observation()
    path = f"{folder}/train.parquet"
    placed.observe(seen, *fingerprint(placed)).drop("_at").write.mode("overwrite").option("maxRecordsPerFile", 0).parquet(path)
    places = _with_places(spark, path, rows.schema)
    reloaded = places.withColumn("_at", F.shiftleft("_part", _ROWS_OF_A_PART) + F.col("_row")).drop("_part", "_row")
    reload_check(seen.get, reloaded)
    # A row per file.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = places.groupBy("_part").agg(F.count("*").alias("rows")).withColumn("first", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    parts = parts.select(F.col("_part").alias("part"), "rows", "first", (F.col("first") + F.col("rows") - 1).alias("last"))
    parts.write.mode("overwrite").parquet(f"{folder}/parts.parquet")
    reloaded.orderBy("_at").drop("_at").write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/train.jsonl")
    return int(seen.get["n"])


def read_bundle(spark: SparkSession, folder: str, first: int = 0, last: int | None = None) -> DataFrame:
    """Exported records with their ``position``, from ``first`` to ``last``; a bundle whose files
    have other rows than its ``parts.parquet`` tells fails the job.

    Positions come from the part and the row's number in it, without a sort.
    """
    parts = spark.read.parquet(f"{folder}/parts.parquet")
    schema = spark.read.parquet(f"{folder}/train.parquet").schema
    places = _with_places(spark, f"{folder}/train.parquet", schema)
    found = places.groupBy("_part").agg(F.count("*").alias("n"))
    other = parts.join(found, F.col("part") == F.col("_part"), "full").where("rows IS DISTINCT FROM n")
    if not other.isEmpty():
        raise ReloadMismatch(f"{folder} has other rows than its parts.parquet")
    wanted = F.col("position") >= first
    if last is not None:
        wanted &= F.col("position") <= last
        parts = parts.where(F.col("first") <= last)
    parts = parts.where(F.col("last") >= first).select(F.col("part").alias("_part"), F.col("first").alias("_first"))
    # As many rows as files.
    rows = places.join(F.broadcast(parts), "_part").withColumn("position", F.col("_first") + F.col("_row"))
    return rows.where(wanted).select("position", *schema.names)


def write_run(records: DataFrame, folder: str, run_id: str, part: str) -> None:
    """Replace one part ('generated', 'normalized') of one run.

    Writing the same part again changes nothing, so a repeated run needs no
    guard against merging twice.
    """
    records.write.mode("overwrite").parquet(f"{folder}/run_id={run_id}/part={part}")


def read_run(spark: SparkSession, folder: str, run_id: str) -> DataFrame:
    """All parts of one run."""
    schema = ", ".join(f"{name} {dtype}" for name, dtype in RECORD_FIELDS.items())
    return spark.read.schema(schema + ", part string").parquet(f"{folder}/run_id={run_id}")


