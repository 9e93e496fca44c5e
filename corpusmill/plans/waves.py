"""Validation of a run that grows wave by wave, with one result whatever the size of the waves."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.minhash import NUM_PERM, THRESHOLD, band_keys
from corpusmill.functions.records import rendered
from corpusmill.functions.tokens import WORDS
from corpusmill.operators.dedup import band_buckets, bucket_memberships, exact_buckets, resolve_first_wins
from corpusmill.operators.structure import flag_structure
from corpusmill.session import materialize
from corpusmill.streaming.ledger import PREFIXES, KeyLedger


@dataclass(frozen=True)
class WaveValidator:
    """Structure and length, exact and near duplicates, against the own wave and all earlier ones.

    Two ledgers below ``folder`` stay between waves: the texts met so far, and the bands of the records that
    near-duplicate removal kept.  Since the first record wins, a record depends on earlier ones
    alone: a later wave drops what has a text or a band of an earlier wave, and then decides among
    itself.  So waves of any size, and a run that is resumed, accept what one
    validation of everything accepts.  A wave that is repeated replaces its own entries.
    """

    folder: str
    max_tokens: int | None
    tokenizer: object = WORDS
    scope: Sequence[str] = ()
    threshold: float = THRESHOLD
    num_perm: int = NUM_PERM
    prefixes: int = PREFIXES

    def __call__(self, records: DataFrame, wave: int) -> DataFrame:
        """The accepted records of a wave, whose number counts from 0."""
        texts, bands = (KeyLedger(f"{self.folder}/{name}", self.prefixes) for name in ("texts", "bands"))
        flagged = flag_structure(records, self.max_tokens, self.tokenizer)
        sound = flagged.where("reject_reason IS NULL").drop("reject_reason")

        hashed = exact_buckets(sound, self.scope, rendered())
        firsts = materialize(hashed.groupBy(F.col("bucket").alias("key")).agg(F.min("ord").alias("ord")), "first-texts")
        new = materialize(texts.unknown(firsts, wave), "new-texts")
        texts.add(new, wave)

        keys = band_keys(rendered(), self.threshold, self.num_perm).alias("bands")
        signed = materialize(sound.join(new.select("ord"), "ord", "left_semi").select("ord", *self.scope, keys), "bands")
        members = materialize(band_buckets(signed, self.scope).withColumnRenamed("bucket", "key"), "band-keys")
        met = materialize(bands.known(members, wave).select("ord").distinct(), "met-earlier")
        fresh = signed.join(met, "ord", "left_anti")
        near = resolve_first_wins(bucket_memberships(materialize(fresh, "fresh-bands"), self.scope))
        kept = materialize(fresh.select("ord").join(near, "ord", "left_anti"), "kept")
        bands.add(members.join(kept, "ord", "left_semi"), wave)
        return sound.join(kept, "ord", "left_semi")
