import random
import re

import pytest
from pyspark.sql import functions as F

from corpusmill.functions.records import DPO, MESSAGES, SFT_CONVERSATION, SFT_PAIR, as_records, metadata, position, roles_alternate
from corpusmill.operators.structure import alternation_by_turn, flag_structure, fold_turns
from corpusmill.plans.validation import validate
from tests.helpers import numbers, texts



def where():
    return metadata(F.lit("d"), F.lit("n"), F.lit("h"))


def pairs(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n bigint, p string, c string")
    return as_records(df, SFT_PAIR, ord=position(F.col("n")), prompt=F.col("p"), completion=F.col("c"), metadata=where())


def chats(spark, rows):
    df = spark.createDataFrame(list(enumerate(rows)), f"n bigint, m {MESSAGES}")
    return as_records(df, SFT_CONVERSATION, ord=position(F.col("n")), messages=F.col("m"), metadata=where())


def preferences(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"n bigint, p {MESSAGES}, c {MESSAGES}, r {MESSAGES}")
    return as_records(df, DPO, ord=position(F.col("n")), dpo_prompt=F.col("p"), chosen=F.col("c"), rejected=F.col("r"), metadata=where())


def good(flagged):
    return numbers(flagged.where("reject_reason IS NULL"))


def replies(content):
    return lambda requests: requests.select("request_id", F.lit(content).alias("content"))


def test_blank_texts_and_fields(spark):
    assert good(flag_structure(texts(spark, ["ok", "  ", ""]))) == [0]
    assert good(flag_structure(pairs(spark, [("p", "c"), ("p", " "), ("", "c"), (None, "c")]))) == [0]


@pytest.mark.parametrize(
    "roles, ok",
    [
        ("user assistant", True), ("system user assistant user", True), ("user system assistant", True), ("system", False),
        ("", False), ("assistant user", False), ("user user", False), ("user system user", False), ("user", True),
    ],
)
def test_role_alternation(spark, roles, ok):
    messages = [(r, "x") for r in roles.split()]
    df = spark.createDataFrame([(messages,)], f"m {MESSAGES}")
    assert df.select(roles_alternate(F.col("m")).alias("ok")).first().ok is ok
    if messages:
        turns = spark.createDataFrame([(1, i, r, "x") for i, (r, _) in enumerate(messages)], "k int, turn int, role string, text string")
        assert alternation_by_turn(turns, "k", "turn").first().alternates is ok


def test_conversations_and_preferences(spark):
    u, a = ("user", "q"), ("assistant", "x")
    assert good(flag_structure(chats(spark, [[u, a], [u, ("assistant", " ")], [a, u], []]))) == [0]
    # Preference pairs need filled lists but no alternation.
    assert good(flag_structure(preferences(spark, [([u], [a], [a]), ([a], [a], [a]), ([u], [], [a]), ([u], [a], [("assistant", "")])]))) == [0, 1]


def test_length_counts_the_rendered_text(spark):
    assert good(flag_structure(pairs(spark, [("a b", "c"), ("a b", "c d")]), max_tokens=3)) == [0]


def test_folding_refuses_an_oversize_conversation(spark):
    turns = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, "user", "x" * 500)], "k int, turn int, role string, text string")
    rows = {r.k: r.messages for r in fold_turns(turns, "k", "turn", max_bytes=100).collect()}
    assert [tuple(m) for m in rows[1]] == [("user", "a"), ("assistant", "b")]
    assert rows[2] is None


@pytest.mark.parametrize("block", [1, 4, 4096])
def test_alternation_does_not_depend_on_the_blocks(spark, block):
    draw, rows, want = random.Random(block), [], {}
    for k in range(150):
        n = 1500 if k == 0 else draw.randrange(1, 14)
        roles = [("user", "assistant")[i % 2] for i in range(n)]
        for _ in range(draw.randrange(3)):
            roles.insert(draw.randrange(len(roles) + 1), "system")
        if k % 2:
            roles[draw.randrange(len(roles))] = draw.choice(("user", "assistant", "system"))
        at = sorted(draw.sample(range(-50, 6000), len(roles)))
        rows += [(k, i, r) for i, r in zip(at, roles)]
        spoken = [r for r in roles if r != "system"]
        want[k] = bool(spoken) and spoken[0] == "user" and all(a != b for a, b in zip(spoken, spoken[1:]))
    draw.shuffle(rows)
    turns = spark.createDataFrame(rows, "k int, turn int, role string")
    result = alternation_by_turn(turns, "k", "turn", block=block)
    assert {r.k: r.alternates for r in result.collect()} == want and len(set(want.values())) == 2
    # The turns are dealt out by conversation and block.
    assert re.search(r"hashpartitioning\(k#\d+, \w+#\d+L?, \d+\)", result._jdf.queryExecution().toString())


def test_reasons_in_order_and_everything_accounted_for(spark):
    long_text = " ".join(f"w{i}" for i in range(40))
    shuffled = " ".join(reversed(long_text.split()))
    records = texts(spark, [long_text, "", long_text.upper(), shuffled, "too long " * 50, "fine"])
    result = validate(records, max_tokens=60)
    assert {r.reject_reason: r.n for r in result.report.collect()} == {"structural": 2, "exact_duplicate": 1, "near_duplicate": 1}
    assert numbers(result.accepted) == [0, 5]
    assert result.assurance_level == "lower_assurance"
    assert result.accepted.count() + result.rejected.count() == 6


def test_validation_does_not_depend_on_partitions_and_is_repeatable(spark):
    words = [f"w{i}" for i in range(30)]
    values = [" ".join(words[i % 4 :] + [str(i % 9)]) for i in range(60)]
    results = [numbers(validate(texts(spark, values).repartition(n), max_tokens=None).accepted) for n in (1, 5, 5)]
    assert results[0] == results[1] == results[2]


def test_scope_keeps_duplicates_of_other_chunks(spark):
    records = texts(spark, ["same", "same", "same"], scope=["c1", "c2", "c1"])
    assert numbers(validate(records, max_tokens=None, scope=["scope"]).accepted) == [0, 1]


def test_optional_quality_judging(spark):
    records = texts(spark, ["good text", "another text"])
    assert numbers(validate(records, max_tokens=None, judge=replies('{"score": 6}'), judge_all=True).accepted) == [0, 1]
    low = validate(records, max_tokens=None, judge=replies('{"score": 5.9}'), judge_all=True)
    assert {r.reject_reason: r.n for r in low.report.collect()} == {"quality_judged_insufficient": 2}
    assert low.assurance_level == "standard_assurance"
    unclear = validate(records, max_tokens=None, judge=replies("no idea"), judge_all=True)
    assert {r.reject_reason for r in unclear.report.collect()} == {"judging_error"}
    # A judge that is not asked for leaves the level low.
    assert validate(records, max_tokens=None, judge=replies('{"score": 0}')).assurance_level == "lower_assurance"


def test_preference_judging_is_mandatory(spark):
    records = preferences(spark, [([("user", "q")], [("assistant", "a")], [("assistant", "b")])])
    with pytest.raises(Exception, match="without a judge"):
        validate(records, max_tokens=None).accepted.collect()
    assert numbers(validate(records, max_tokens=None, judge=replies('{"score_a": 7, "score_b": 6}')).accepted) == [0]
    close = validate(records, max_tokens=None, judge=replies('{"score_a": 7, "score_b": 6.5}'))
    assert [r.reject_reason for r in close.report.collect()] == ["dpo_preference_not_confirmed"]


def test_the_judge_only_sees_survivors(spark):
    asked = []

    def judge(requests):
        asked.extend(r.request_id for r in requests.collect())
        return replies('{"score": 9}')(requests)

    validate(texts(spark, ["a b c", "A B C", " ", "d e f"]), max_tokens=None, judge=judge, judge_all=True).accepted.count()
    assert sorted(int(i) >> 28 for i in asked) == [0, 3]


def test_scores_that_are_no_number_do_not_pass(spark):
    pair = preferences(spark, [([("user", "q")], [("assistant", "a")], [("assistant", "b")])])
    reply = replies('{"score_a": "nan", "score_b": 1}')
    assert numbers(validate(pair, max_tokens=None, judge=reply).accepted) == []
    record = texts(spark, ["some text"])
    assert numbers(validate(record, max_tokens=None, judge=replies('{"score": "nan"}'), judge_all=True).accepted) == []
