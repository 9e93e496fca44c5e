"""Incremental runs: a stream of chunk or record files into run output.

Each micro-batch replaces its own partition of the output, so a batch that is
replayed after a failure writes the same rows again and nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusmill.functions.text import normalized_hash
from corpusmill.operators.dedup import exact_buckets
from corpusmill.session import materialize
from corpusmill.streaming.ledger import KeyLedger


def read_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """Parquet files of ``path`` as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def process_stream(
    stream: DataFrame, output: str, checkpoint: str, process: Callable[[DataFrame, int], DataFrame], available_now: bool = True
) -> StreamingQuery:
    """Run ``process`` on every micro-batch and write its result below ``output``.

    The checkpoint remembers the files done, so a stopped query resumes there.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        process(batch, batch_id).write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def dedup_stream(
    stream: DataFrame, output: str, checkpoint: str, text: str = "text", scope: Sequence[str] = (), available_now: bool = True
) -> StreamingQuery:
    """Exact duplicates across micro-batches: the first arrival wins.

    Texts seen so far are a :class:`~corpusmill.streaming.ledger.KeyLedger` below ``output``, of which a
    batch opens the folders of its own keys' prefixes only; there is no streaming state to outgrow memory.
    A batch that is replayed looks at earlier batches alone, and writes the same again.
    """
    ledger = KeyLedger(f"{output}/_ledger")

    def fresh(batch: DataFrame, batch_id: int) -> DataFrame:
        keyed = exact_buckets(batch, scope, F.col(text))
        firsts = materialize(keyed.groupBy(F.col("bucket").alias("key")).agg(F.min("ord").alias("ord")), "first-texts")
        new = materialize(ledger.unknown(firsts, batch_id), "new-texts")
        ledger.add(new, batch_id)
        return batch.withColumn("text_hash", normalized_hash(F.col(text))).join(new.select("ord"), "ord", "left_semi")

    return process_stream(stream, output, checkpoint, fresh, available_now)
