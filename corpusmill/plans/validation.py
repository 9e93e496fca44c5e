"""Validation of a record set: cheap checks first, judging last."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.minhash import NUM_PERM, THRESHOLD, band_keys
from corpusmill.functions.records import DPO, rendered
from corpusmill.functions.text import fail_unless
from corpusmill.functions.tokens import WORDS
from corpusmill.operators.dedup import bucket_memberships, exact_buckets, later_copies, resolve_first_wins
from corpusmill.operators.judging import PREFERENCE_MARGIN, QUALITY_THRESHOLD, judge_requests, verdicts
from corpusmill.operators.structure import flag_structure
from corpusmill.session import materialize


@dataclass(frozen=True)
class Validation:
    """``decided`` holds every input record with its ``reject_reason`` (null = accepted)."""

    decided: DataFrame
    assurance_level: str

    @property
    def accepted(self) -> DataFrame:
        return self.decided.where("reject_reason IS NULL").drop("reject_reason")

    @property
    def rejected(self) -> DataFrame:
        return self.decided.where("reject_reason IS NOT NULL")

    @property
    def report(self) -> DataFrame:
        return rejection_report(self.decided)


def rejection_report(decided: DataFrame) -> DataFrame:
    """(reject_reason, n) over the rejected records."""
    return decided.where("reject_reason IS NOT NULL").groupBy("reject_reason").agg(F.count("*").alias("n"))


def flag_duplicates(
    flagged: DataFrame,
    scope: Sequence[str] = (),
    threshold: float = THRESHOLD,
    num_perm: int = NUM_PERM,
) -> DataFrame:
    """Fill ``reject_reason`` with 'exact_duplicate' and 'near_duplicate'.

    Only the records without a reason take part.  Texts are read where they lie
    and only keys are shuffled to decide; signatures are made for the first of
    equal texts alone.  The records then meet the losers, which Spark
    broadcasts while they are few.
    """
    open_ = flagged.where("reject_reason IS NULL")
    copies = materialize(later_copies(materialize(exact_buckets(open_, scope, rendered()), "text-hashes")), "later-copies")
    bands = band_keys(rendered(), threshold, num_perm).alias("bands")
    signed = materialize(open_.join(copies, "ord", "left_anti").select("ord", *scope, bands), "bands")
    near = resolve_first_wins(bucket_memberships(signed, scope))
    losers = copies.select("ord", F.lit("exact_duplicate").alias("_lost")).unionByName(near.select("ord", F.lit("near_duplicate").alias("_lost")))
    return flagged.join(losers, "ord", "left").withColumn("reject_reason", F.coalesce("reject_reason", "_lost")).drop("_lost")


def validate(
    records: DataFrame,
    *,
    max_tokens: int | None,
    tokenizer=WORDS,
    scope: Sequence[str] = (),
    judge: Callable[[DataFrame], DataFrame] | None = None,
    judge_all: bool = False,
    quality_threshold: float = QUALITY_THRESHOLD,
    preference_margin: float = PREFERENCE_MARGIN,
    near_threshold: float = THRESHOLD,
) -> Validation:
    """Structure and length, exact duplicates, near duplicates, judging.

    ``judge`` maps request rows to (request_id, content) rows.  Preference pairs
    always need it: without a judge, a job that meets one fails.  Other kinds are
    judged only with ``judge_all``.  ``scope`` columns limit where duplicates
    are looked for; the default is the whole input.  ``records`` is read three times
    (keys, signatures, then the records themselves), so pass a written table when it is
    costly to compute.
    """
    if judge is None:
        needs_none = F.coalesce(F.col("kind") != DPO, F.lit(True))
        records = records.where(fail_unless(needs_none, F.lit("preference pairs cannot be validated without a judge")))
    decided = flag_duplicates(flag_structure(records, max_tokens, tokenizer), scope, near_threshold)
    judged = False
    if judge is not None:
        due = F.col("reject_reason").isNull() & (F.lit(judge_all) | (F.col("kind") == DPO))
        decided = materialize(decided, "deduplicated")
        judged = not decided.where(due).isEmpty()
        responses = judge(judge_requests(decided.where(due)))
        decided = verdicts(decided, responses, quality_threshold, preference_margin)
        decided = decided.withColumn("reject_reason", F.coalesce("reject_reason", F.when(due, F.col("judge_reason"))))
        decided = decided.drop("judge_reason")
    return Validation(decided, "standard_assurance" if judged else "lower_assurance")
