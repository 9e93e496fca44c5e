"""Judge gates: requests for the surviving records, replies to verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import prompts
from corpusmill.functions.records import DPO
from corpusmill.functions.replies import lenient_object, number_at, score
from corpusmill.functions.text import let

# Least score of a good example, least lead of a preferred answer.
QUALITY_THRESHOLD = 6.0
PREFERENCE_MARGIN = 1.0


def quality_verdict(content: Column, threshold: float = QUALITY_THRESHOLD) -> Column:
    """Reject reason of a quality reply, null when the record passes."""
    return let(
        score(content),
        lambda value: F.when(value.isNull(), F.lit("judging_error")).when(
            ~(value >= threshold) | F.isnan(value), F.lit("quality_judged_insufficient")
        ),
    )


def preference_verdict(content: Column, margin: float = PREFERENCE_MARGIN) -> Column:
    """Reject reason of a preference reply, null when 'chosen' is confirmed."""
    lead = let(lenient_object(content), lambda reply: number_at(reply, "score_a") - number_at(reply, "score_b"))
    return let(
        lead,
        lambda value: F.when(value.isNull(), F.lit("judging_error")).when(
            ~(value >= margin) | F.isnan(value), F.lit("dpo_preference_not_confirmed")
        ),
    )


def judge_requests(records: DataFrame) -> DataFrame:
    """(request_id, kind, messages), one request per record."""
    return records.select(
        F.col("ord").cast("string").alias("request_id"),
        F.when(F.col("kind") == DPO, F.lit("preference")).otherwise(F.lit("quality")).alias("kind"),
        F.when(F.col("kind") == DPO, prompts.preference()).otherwise(prompts.quality()).alias("messages"),
    )


def verdicts(
    records: DataFrame,
    responses: DataFrame,
    threshold: float = QUALITY_THRESHOLD,
    margin: float = PREFERENCE_MARGIN,
) -> DataFrame:
    """Add ``judge_reason`` to records; a record without a reply is an error.

    ``responses`` is (request_id, content).  Both sides meet on the record id,
    which is unique, so the join is even.
    """
    replies = responses.select(F.col("request_id").cast("bigint").alias("ord"), "content")
    return (
        records.join(replies, "ord", "left")
        .withColumn(
            "judge_reason",
            F.when(F.col("kind") == DPO, preference_verdict(F.col("content"), margin)).otherwise(
                quality_verdict(F.col("content"), threshold)
            ),
        )
        .drop("content")
    )
