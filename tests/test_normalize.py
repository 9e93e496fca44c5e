import json

import pytest
from pyspark.sql import functions as F

from corpusmill.functions.records import position
from corpusmill.operators.detection import ColumnMappingError, detect_columns, detect_sources, map_columns, map_row_keys, preview
from corpusmill.operators.normalize import normalize_instruction, normalize_messages, normalize_rows, route_sources
from corpusmill.operators.urls import is_allowed


def rows(spark, *values):
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "row_no bigint, j string")
    return df.select(
        "row_no", F.parse_json("j").cast("map<string,variant>").alias("data"), position(F.lit(0), F.col("row_no")).alias("ord"),
        F.lit("d").alias("document_id"), F.lit("s").alias("source_name"), F.lit("h").alias("source_hash"), F.col("row_no").cast("string").alias("row_id"),
    )


@pytest.mark.parametrize(
    "first, shape",
    [
        ({"prompt": "", "completion": "", "chosen": "", "rejected": ""}, "prompt_chosen_rejected"),
        ({"messages": [], "text": "x"}, "messages"),
        ({"messages": "no", "text": "x"}, "text"),
        ({"conversations": [{}]}, "conversations"),
        ({"prompt": 1, "completion": None}, "prompt_completion"),
        ({"instruction": "", "output": ""}, "instruction_input_output"),
        ({"text": 5}, None),
        ({"Text": "x"}, None),
    ],
)
def test_detection_looks_at_the_first_row(spark, first, shape):
    found = detect_sources(rows(spark, first, {"text": "later"}).withColumn("path", F.lit("p"))).first()
    assert found.schema_name == shape and found.confidence == (1.0 if shape else 0.0)
    assert bool(found.matched_keys) == bool(shape)


def test_detection_of_typed_columns(spark):
    assert detect_columns(spark.createDataFrame([("a", ["x"])], "text string, messages array<string>")) == "messages"
    assert detect_columns(spark.createDataFrame([(1,)], "text int")) is None


def test_mapping(spark):
    df = spark.createDataFrame([("q", "a", "old")], "question string, answer string, prompt string")
    mapped = map_columns(df, {"question": "prompt", "answer": "completion"})
    assert sorted(mapped.columns) == ["completion", "prompt"] and mapped.first().prompt == "q"
    for bad in ({"nope": "prompt"}, {"question": "answer", "answer": "question"}, {"question": "x", "answer": "x"}):
        with pytest.raises(ColumnMappingError):
            map_columns(df, bad)
    keyed = map_row_keys(rows(spark, {"q": "a", "prompt": "old", "z": 1}, {"z": 1}), {"q": "prompt"})
    first, second = keyed.select(F.to_json("data").alias("d"), "reject_reason").collect()
    assert json.loads(first.d) == {"prompt": "a", "z": 1} and first.reject_reason is None
    assert second.reject_reason == "missing_column"


def outcome(spark, shape, *values):
    return [r.reject_reason for r in normalize_rows(rows(spark, *values), shape).orderBy("ord").collect()]


def test_reject_reasons(spark):
    assert outcome(spark, "text", {"text": "x"}, {"text": " "}, {"text": 5}, {}) == [None, "empty_text", "empty_text", "empty_text"]
    assert outcome(spark, "prompt_completion", {"prompt": "p", "completion": ""}) == ["empty_completion"]
    u, a = {"role": "user", "content": "q"}, {"role": "assistant", "content": ""}
    # A blank content is left for the structure check.
    assert outcome(spark, "messages", {"messages": [u, a]}, {"messages": []}, {"messages": [a]}, {"messages": [u, u]}, {"messages": [{"role": "user"}]}, {"messages": [{"role": "bot", "content": "x"}]}) == [
        None, "empty_messages", "roles_do_not_alternate", "roles_do_not_alternate", "bad_message", "bad_message",
    ]
    h, g = {"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}
    assert outcome(spark, "conversations", {"conversations": [{"from": "system", "value": "s"}, h, g]}, {"conversations": [{"from": "user", "value": "q"}]}) == [None, "bad_message"]
    assert outcome(spark, "prompt_chosen_rejected", {"prompt": "p", "chosen": "c", "rejected": "r"}, {"prompt": "p", "chosen": "c"}) == [None, "empty_rejected"]


def test_instruction_joins_the_input(spark):
    got = normalize_rows(rows(spark, {"instruction": "do ", "input": "it\n", "output": "x"}, {"instruction": "do ", "input": "", "output": "x"}, {"instruction": "do ", "output": "x"}), "instruction_input_output")
    assert [r.prompt for r in got.orderBy("ord").collect()] == ["do \n\nit", "do ", "do "]


def test_provenance_and_strict_mode(spark):
    record = normalize_rows(rows(spark, {"text": "x"}), "text", mode="strict").first()
    assert (record.metadata.source_kind, record.metadata.row_id, record.metadata.chunk_id) == ("structured", "0", None)
    with pytest.raises(Exception, match="row 1: empty_text"):
        normalize_rows(rows(spark, {"text": "x"}, {"text": ""}), "text", mode="strict").collect()
    with pytest.raises(Exception, match="row 1: empty_text"):
        normalize_rows(rows(spark, {"text": "x"}, {"text": ""}), "text", mode="strict").count()


def test_a_preview_ignores_later_bad_rows(spark):
    df = rows(spark, *[{"text": f"t{i}"} for i in range(5)], {"text": ""})
    assert [r.text for r in preview(df, lambda d: normalize_rows(d, "text", mode="strict"), limit=5).orderBy("ord").collect()] == [f"t{i}" for i in range(5)]


def test_routing_by_kind(spark):
    sources = spark.createDataFrame([("a", "text"), ("b", "prompt_completion"), ("c", None)], "source_id string, confirmed_schema string")
    kept, skipped = route_sources(sources, "sft_prompt_completion")
    assert [r.source_id for r in kept.collect()] == ["b"]
    assert [r.source_id for r in skipped.collect()] == ["a"]


@pytest.mark.parametrize(
    "url, ok",
    [
        ("https://docs.example.org", True), ("https://example.org/x", True), ("http://example.org/", False), ("https://evil-example.org/", False),
        ("https://example.org.evil.com/", False), ("https://user@EXAMPLE.org:443/", True), ("https://code.example.com/team/repo", True),
        ("https://code.example.com/other", False), ("https://evil.com/?https://example.org/", False), ("nonsense", False), (None, False),
    ],
)
def test_url_allow_list(spark, url, ok):
    allowed = (("example.org", "/"), ("code.example.com", "/team"))
    df = spark.createDataFrame([(url,)], "url string")
    assert df.select(is_allowed(F.col("url"), allowed).alias("ok")).first().ok is ok


def test_message_fields_are_taken_by_name(spark):
    rows = [("r0", [("hello", "ann", "user"), ("hi", "bot", "assistant")])]
    df = spark.createDataFrame(rows, "row_id string, messages array<struct<content:string,name:string,role:string>>")
    df = df.select(F.lit(1).cast("bigint").alias("ord"), F.lit("d").alias("document_id"), F.lit("s").alias("source_name"), F.lit("h").alias("source_hash"), "row_id", "messages")
    row = normalize_messages(df).first()
    assert row.reject_reason is None and [tuple(m) for m in row.messages] == [("user", "hello"), ("assistant", "hi")]


def test_inputs_that_are_no_strings_are_written_out(spark):
    df = spark.sql(
        """SELECT CAST(id AS BIGINT) AS ord, 'd' AS document_id, 's' AS source_name, 'h' AS source_hash, CAST(id AS STRING) AS row_id,
        map('instruction', parse_json('"Sum"'), 'input', parse_json(j), 'output', parse_json('"x"')) AS data
        FROM VALUES (0, '5'), (1, '0'), (2, 'null'), (3, '"0"'), (4, 'false') AS t(id, j)"""
    )
    got = {r.ord: r.prompt for r in normalize_instruction(df).collect()}
    assert got == {0: "Sum\n\n5", 1: "Sum", 2: "Sum", 3: "Sum\n\n0", 4: "Sum"}


def test_empty_containers_are_no_input(spark):
    df = rows(spark, *[{"instruction": "Sum", "input": v, "output": "x"} for v in ([], {}, [1], "[]")])
    got = normalize_rows(df, "instruction_input_output")
    assert [r.prompt for r in got.orderBy("ord").collect()] == ["Sum", "Sum", "Sum\n\n[1]", "Sum\n\n[]"]
