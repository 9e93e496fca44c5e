import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.functions.minhash import MAX_HASH, PRIME, band_keys, band_shape, permutations, signatures, slices
from corpusmill.operators.dedup import bucket_memberships, drop_exact_duplicates, drop_near_duplicates, near_duplicates, resolve_first_wins
from tests.helpers import numbers, texts

SENTENCE = "the quick brown fox jumps over the lazy dog near the river bank"


def test_same_text_and_case_and_spacing_are_exact_duplicates(spark):
    records = texts(spark, ["Hello  World", "hello world", "Hello World", "other"])
    assert numbers(drop_exact_duplicates(records)) == [0, 3]


def test_first_in_order_wins_whatever_the_partitioning(spark):
    records = texts(spark, ["b", "A", "a", "B", "c"] * 20)
    for n in (1, 3, 7):
        assert numbers(drop_exact_duplicates(records.repartition(n))) == [0, 1, 4]


def test_scope_limits_exact_duplicates(spark):
    records = texts(spark, ["x", "x", "x"], scope=["p", "q", "p"])
    assert numbers(drop_exact_duplicates(records, scope=["scope"])) == [0, 1]


def test_one_changed_word_is_a_near_duplicate(spark):
    records = texts(spark, [SENTENCE, SENTENCE.replace("river", "water"), "something else entirely is written here"])
    assert numbers(near_duplicates(records, threshold=0.5)) == [1]
    assert numbers(drop_near_duplicates(records, threshold=0.5)) == [0, 2]


def test_distinct_sentences_are_all_kept(spark):
    records = texts(spark, ["alpha beta gamma", "delta epsilon zeta", "eta theta iota"])
    assert numbers(drop_near_duplicates(records)) == [0, 1, 2]


def test_near_duplicates_are_case_sensitive_sets(spark):
    upper = SENTENCE.upper()
    again = " ".join(reversed(SENTENCE.split()))
    assert numbers(drop_near_duplicates(texts(spark, [SENTENCE, upper, again]))) == [0, 1]


def test_scope_limits_near_duplicates(spark):
    again = " ".join(reversed(SENTENCE.split()))
    records = texts(spark, [SENTENCE, again, again], scope=["p", "q", "p"])
    assert numbers(drop_near_duplicates(records, scope=["scope"])) == [0, 1]


def test_default_bands():
    assert band_shape() == (8, 16)


def test_signature_is_the_published_formula():
    value = int.from_bytes(__import__("hashlib").sha1(b"word").digest()[:4], "little")
    a, b = permutations()
    expected = [((int(x) * value + int(y)) % 2**64 % PRIME) & MAX_HASH for x, y in zip(a, b)]
    assert signatures(["word word", "", None]).tolist() == [expected, [MAX_HASH] * 128, [MAX_HASH] * 128]


def sequential(memberships):
    by_record = {}
    for record, bucket in memberships:
        by_record.setdefault(record, set()).add(bucket)
    taken, dropped = set(), set()
    for record in sorted(by_record):
        if taken & by_record[record]:
            dropped.add(record)
        else:
            taken |= by_record[record]
    return dropped


@pytest.mark.parametrize("hot", [1_000_000, 3])
@pytest.mark.parametrize("seed", [1, 2])
def test_rounds_match_the_sequential_fold(spark, seed, hot):
    draw = random.Random(seed)
    pairs = sorted({(draw.randrange(60), draw.randrange(45)) for _ in range(150)})
    df = spark.createDataFrame([(r, str(b).encode()) for r, b in pairs], "ord bigint, bucket binary")
    found = {row.ord for row in resolve_first_wins(df, hot_bucket=hot).collect()}
    assert found == sequential(pairs)


def test_a_chain_keeps_what_is_only_near_a_dropped_record(spark):
    pairs = [(i, str(b).encode()) for i in range(7) for b in (i, i + 1)]
    df = spark.createDataFrame(pairs, "ord bigint, bucket binary")
    assert sorted(r.ord for r in resolve_first_wins(df).collect()) == [1, 3, 5]


def test_one_bucket_with_most_records(spark):
    df = spark.range(0, 30_000).select(F.col("id").alias("ord"), F.lit(b"hot").alias("bucket"))
    for hot in (1_000, 1_000_000):
        assert resolve_first_wins(df, hot_bucket=hot).count() == 29_999


def test_shared_buckets_are_the_same_with_hot_ones_split(spark):
    keyed = spark.range(50).select(F.col("id").alias("ord"), F.array(F.lit(b"all"), (F.col("id") % 20).cast("string").cast("binary"), F.col("id").cast("string").cast("binary")).alias("bands"))
    plain, split = (sorted((r.ord, bytes(r.bucket)) for r in bucket_memberships(keyed, hot_bucket=n).collect()) for n in (1_000, 10))
    assert plain == split and len(plain) == 100


def test_a_batch_is_signed_in_slices(spark, monkeypatch):
    # Before, all texts of an Arrow batch stood beside it as Python strings.
    given = ["aa", None, "", "b" * 50, "cc dd", "é" * 4, "e"] * 3
    parts = [part.to_pylist() for part in slices(pa.array(given)[1:], 10)]
    assert sum(parts, []) == given[1:] and list(slices(pa.array([], pa.string()))) == []
    assert all(len(part) == 1 or sum(len((t or "").encode()) for t in part) <= 10 for part in parts)
    assert ["cc dd"] in parts and ["b" * 50] in parts
    rows = texts(spark, ["one two", " ", "one two", "three"]).select("ord", band_keys(F.col("text")).alias("k")).orderBy("ord").collect()
    bands, _ = band_shape()
    assert [len(r.k) for r in rows] == [bands] * 4 and rows[0].k == rows[2].k and len({tuple(map(bytes, r.k)) for r in rows}) == 3
