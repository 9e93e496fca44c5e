"""Run assembly: caps, merging generated and structured records, resuming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.plans.validation import Validation
from corpusmill.session import materialize
from corpusmill.sources.records_io import read_run, write_run

PREVIEW_ROWS = 10  # Fixed value: accepted rows of a preview run.

# Ranges of positions that are counted at a time.
RANGES = 4096


def target_rows(target: int | None, is_preview: bool = False, ceiling: int | None = None) -> int | None:
    """How many accepted rows a run wants; None for all of them."""
    wanted = [n for n in (PREVIEW_ROWS if is_preview else target, ceiling) if n is not None]
    return min(wanted) if wanted else None


def first_in_order(records: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` records by ``ord``.

    The last of them is found from counts of ``ord`` by range, which are combined
    before they are shuffled, so no task ever holds ``n`` rows; the records
    are then filtered where they lie.
    """
    if n is None:
        return records
    if n <= 0:
        return records.limit(0)
    last = nth_position(materialize(records.select("ord"), "positions"), n)
    return records if last is None else records.where(F.col("ord") <= last)


def nth_position(ords: DataFrame, n: int, ranges: int = RANGES) -> int | None:
    """The ``n``-th least ``ord``, None if there are not as many.

    Each pass counts the rows in ``ranges`` equal ranges, at most that many numbers,
    and goes on inside the range that holds the n-th row.
    """
    low, high, total = ords.agg(F.min("ord"), F.max("ord"), F.count("ord")).first()
    if total < n:
        return None
    while low < high:
        width = (high - low) // ranges + 1
        inside = ords.where(F.col("ord").between(low, high))
        for k, rows in sorted(map(tuple, inside.groupBy(F.expr(f"(ord - {low}L) div {width}L")).count().collect())):
            if n <= rows:
                low, high = low + k * width, min(high, low + (k + 1) * width - 1)
                break
            n -= rows
    return low


def remaining_capacity(written: DataFrame, n: int | None) -> int | None:
    """Rows a run may still take."""
    return None if n is None else max(0, n - written.count())


def merge_structured(
    generated: DataFrame,
    structured: DataFrame,
    target: int | None,
    validate: Callable[[DataFrame], Validation],
    cap: str = "before",
) -> DataFrame:
    """Accepted structured records that fit behind the generated ones.

    cap='before' cuts to the remaining capacity and then validates, without
    back-fill; cap='after' validates first and so fills the capacity.
    """
    left = remaining_capacity(generated, target)
    if cap == "before":
        return validate(first_in_order(structured, left)).accepted
    return first_in_order(_once(validate(structured).accepted, left), left)


def _once(accepted: DataFrame, n: int | None) -> DataFrame:
    """Written where it will be read twice, that is, where a cap applies."""
    return accepted if n is None else materialize(accepted, "accepted")


def assemble_run(
    generated: DataFrame,
    structured: DataFrame,
    folder: str,
    run_id: str,
    *,
    validate_generated: Callable[[DataFrame], Validation],
    validate_structured: Callable[[DataFrame], Validation],
    target: int | None = None,
    cap: str = "before",
) -> DataFrame:
    """Validate and write both parts of a run, generated records first."""
    spark = generated.sparkSession
    write_run(first_in_order(_once(validate_generated(generated).accepted, target), target), folder, run_id, "generated")
    written = read_run(spark, folder, run_id).where("part = 'generated'")
    write_run(merge_structured(written, structured, target, validate_structured, cap), folder, run_id, "normalized")
    return read_run(spark, folder, run_id)


def generate_to_target(
    sources: DataFrame,
    produce: Callable[[DataFrame], DataFrame],
    folder: str,
    run_id: str,
    target: int | None,
    wave: int,
    validate: Callable[[DataFrame, int], DataFrame] | None = None,
) -> DataFrame:
    """Work through ``sources`` in order, ``wave`` chunks at a time, and stop as
    soon as ``target`` accepted records are written, so that no model is asked
    for chunks that are not needed.

    ``produce`` turns chunks into records, and ``validate``, such as a
    :class:`~corpusmill.plans.waves.WaveValidator`, the records of a wave of the given number into accepted ones;
    a check that looks at one wave alone makes the result depend on ``wave``.  Every wave is one part of
    the run, followed by its checkpoint (last chunk, accepted rows).  A resumed
    run goes on behind the last checkpoint and replaces a wave that was written
    without one, so nothing is appended twice.  A run without any wave has no rows.
    """
    spark = sources.sparkSession
    ledger = f"{folder}/checkpoints/run_id={run_id}"
    done = _checkpoints(spark, ledger)
    number, last, total = len(done), max((c.last_ord for c in done), default=None), sum(c.accepted for c in done)
    while target is None or total < target:
        rest = sources if last is None else sources.where(F.col("ord") > last)
        chunks = first_in_order(rest, wave)
        upper = chunks.agg(F.max("ord").alias("ord")).first().ord
        if upper is None:
            break
        part = f"generated-{number:06d}"
        room = None if target is None else target - total
        records = produce(chunks) if validate is None else validate(materialize(produce(chunks), "records"), number)
        write_run(first_in_order(_once(records, room), room), folder, run_id, part)
        accepted = read_run(spark, folder, run_id).where(F.col("part") == part).count()
        row = spark.createDataFrame([(number, upper, accepted)], _CHECKPOINT)
        row.coalesce(1).write.mode("overwrite").parquet(f"{ledger}/wave={number}")
        number, last, total = number + 1, upper, total + accepted
    if number == 0:
        write_run(produce(sources.limit(0)), folder, run_id, "generated-000000")
    return read_run(spark, folder, run_id)


_CHECKPOINT = "sequence bigint, last_ord bigint, accepted bigint"


def _checkpoints(spark: SparkSession, ledger: str) -> list:
    """The checkpoints of a run, a row per wave; none for a new run."""
    try:
        return spark.read.schema(_CHECKPOINT).parquet(ledger).collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def unprocessed(chunks: DataFrame, done: DataFrame) -> DataFrame:
    """Chunks a resumed run still has to do; ``done`` lists attempted chunk ids."""
    return chunks.join(done.select("chunk_id"), "chunk_id", "left_anti")
