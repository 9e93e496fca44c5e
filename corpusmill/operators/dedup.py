"""Exact and near duplicates; the first record in input order wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.minhash import NUM_PERM, THRESHOLD, band_keys
from corpusmill.functions.text import normalized_hash
from corpusmill.session import materialize

# Memberships from which a bucket counts as hot.  There are at most
# memberships / HOT_BUCKET hot buckets, which bounds their broadcast.
HOT_BUCKET = 1_000_000


def exact_first(records: DataFrame, scope: Sequence[str] = (), text: str = "text") -> DataFrame:
    """One row (*scope, text_hash, ord, copies) per distinct normalized text.

    The minimum is combined before the shuffle, so a text that makes up a third
    of the input costs one row per map task.
    """
    return (
        records.select("ord", *scope, normalized_hash(F.col(text)).alias("text_hash"))
        .groupBy(*scope, "text_hash")
        .agg(F.min("ord").alias("ord"), F.count("*").alias("copies"))
    )


def drop_exact_duplicates(records: DataFrame, scope: Sequence[str] = (), text: str = "text") -> DataFrame:
    """Keep the first record of every distinct normalized text within ``scope``.

    Full records move once, on their unique ``ord``, so that shuffle is even.
    """
    return records.join(exact_first(records, scope, text).select("ord"), "ord", "left_semi")


def later_copies(keyed: DataFrame) -> DataFrame:
    """``ord`` of every row of a written table (ord, bucket) that has an earlier one in its bucket."""
    first = keyed.groupBy("bucket").agg(F.min("ord").alias("first"), F.count("*").alias("n")).where("n > 1")
    return join_buckets(keyed, first, "inner").where("ord > first").select("ord")


def exact_buckets(records: DataFrame, scope: Sequence[str], value: Column) -> DataFrame:
    """(ord, bucket), a bucket being one normalized text within one scope."""
    key = F.to_json(F.struct(*scope, normalized_hash(value).alias("text_hash")), {"ignoreNullFields": "false"})
    return records.select("ord", F.unhex(F.md5(key)).alias("bucket"))


def near_duplicates(
    records: DataFrame,
    scope: Sequence[str] = (),
    text: str = "text",
    threshold: float = THRESHOLD,
    num_perm: int = NUM_PERM,
) -> DataFrame:
    """``ord`` of every record that collides with an earlier *kept* record."""
    keyed = materialize(records.select("ord", *scope, band_keys(F.col(text), threshold, num_perm).alias("bands")), "bands")
    return resolve_first_wins(bucket_memberships(keyed, scope))


def join_buckets(members: DataFrame, buckets: DataFrame, how: str, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """Join memberships with one row (bucket, n, ...) per bucket; ``how`` is inner, left or left_semi.

    Members of hot buckets meet a broadcast of those few and are never shuffled
    on their bucket; all others are joined as usual.
    """
    hot = F.broadcast(buckets.where(F.col("n") > hot_bucket).drop("n"))
    cold = buckets.where(F.col("n") <= hot_bucket).drop("n")
    rest = members.join(hot.select("bucket"), "bucket", "left_anti")
    return members.join(hot, "bucket", "left_semi" if how == "left_semi" else "inner").unionByName(rest.join(cold, "bucket", how))


def drop_near_duplicates(records: DataFrame, **options) -> DataFrame:
    """``records`` without :func:`near_duplicates`."""
    return records.join(near_duplicates(records, **options), "ord", "left_anti")


def band_buckets(keyed: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """(ord, bucket) of every band; a bucket is one band key within one scope."""
    key = F.concat_ws("|", F.hex("band_key"), "band", *[F.col(c).cast("string") for c in scope])
    spread = keyed.select("ord", *scope, F.posexplode("bands").alias("band", "band_key"))
    return spread.select("ord", F.unhex(F.md5(key)).alias("bucket"))


def bucket_memberships(keyed: DataFrame, scope: Sequence[str] = (), hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """(ord, bucket) for the buckets that hold more than one record.

    ``keyed`` is read twice, so pass a written table rather than a plan that computes signatures.
    """
    members = band_buckets(keyed, scope)
    shared = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    return join_buckets(members, shared, "left_semi", hot_bucket).select("ord", "bucket")


def resolve_first_wins(members: DataFrame, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """Greedy first-wins over bucket memberships, as a DataFrame of dropped ``ord``.

    A record that comes first in all its buckets is kept, and everything else in
    those buckets is dropped; then the same again for what is undecided, until
    nothing is.  The least undecided ``ord`` always leads, so every round decides
    something.  A round is a pre-aggregated minimum per bucket and joins against
    one row per bucket or record, linear in the memberships: no pairs are formed
    and no bucket is gathered.
    """
    undecided = materialize(members, "undecided")
    dropped = members.sparkSession.createDataFrame([], "ord bigint")
    while not undecided.isEmpty():
        first = materialize(undecided.groupBy("bucket").agg(F.min("ord").alias("first"), F.count("*").alias("n")), "firsts")
        led = join_buckets(undecided, first, "inner", hot_bucket)
        kept = led.groupBy("ord").agg(F.bool_and(F.col("ord") == F.col("first")).alias("leads")).where("leads")
        settled = materialize(first.join(kept.select(F.col("ord").alias("first")), "first", "left_semi"), "settled")
        met = materialize(join_buckets(undecided, settled, "left", hot_bucket), "met")
        losers = materialize(met.where("ord > first").select("ord").distinct(), "near-duplicates")
        dropped = dropped.unionByName(losers)
        undecided = materialize(met.where("first IS NULL").select("ord", "bucket").join(losers, "ord", "left_anti"), "undecided")
    return dropped
