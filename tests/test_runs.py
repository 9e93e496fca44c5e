import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from catalog import runs
from corpusmill import session
from corpusmill.functions.records import CPT, SFT_PAIR, as_records, metadata, position
from corpusmill.operators.structure import flag_structure
from corpusmill.plans.run import assemble_run, first_in_order, generate_to_target, merge_structured, nth_position, target_rows, unprocessed
from corpusmill.plans.validation import Validation, validate
from corpusmill.plans.waves import WaveValidator
from corpusmill.sources import records_io as IO
from corpusmill.streaming.incremental import dedup_stream, process_stream, read_stream
from corpusmill.streaming.ledger import KeyLedger
from tests.helpers import numbers, texts


def shape_only(records):
    return Validation(flag_structure(records), "lower_assurance")


def test_targets():
    assert target_rows(500) == 500 and target_rows(500, is_preview=True) == 10
    assert target_rows(200_000, ceiling=100_000) == 100_000 and target_rows(200_000) == 200_000
    assert target_rows(None) is None


def test_first_in_order(spark):
    records = texts(spark, list("abcdef")).repartition(3)
    assert numbers(first_in_order(records, 4)) == [0, 1, 2, 3]
    assert first_in_order(records, 0).count() == 0
    assert numbers(first_in_order(records, None)) == list(range(6))


def test_nth_position_is_found_from_range_counts(spark):
    values = sorted((i * i * 977) % 100_003 + (i % 3) * 2**40 for i in range(500))
    ords = spark.createDataFrame([(v,) for v in values], "ord bigint")
    assert [nth_position(ords, n, ranges=7) for n in (1, 250, 500)] == [values[0], values[249], values[499]]
    assert nth_position(ords, 501) is None


def test_a_run_without_a_wave_is_empty(spark, tmp_path):
    chunks = texts(spark, ["a", "b"]).drop("scope")
    same = lambda batch: batch
    assert generate_to_target(chunks, same, str(tmp_path / "x"), "r", target=0, wave=1).count() == 0
    assert generate_to_target(chunks.limit(0), same, str(tmp_path / "y"), "r", target=None, wave=1).count() == 0
    assert generate_to_target(chunks, same, str(tmp_path / "x"), "r", target=None, wave=1).count() == 2


@pytest.mark.parametrize("source, item", [(2**35, 0), (-1, 0), (0, 2**28)])
def test_positions_that_do_not_fit_fail(spark, source, item):
    df = spark.createDataFrame([(source, item)], "s bigint, i bigint")
    with pytest.raises(Exception, match="out of range"):
        df.select(position(F.col("s"), F.col("i"))).collect()


def test_cap_before_and_after_validation(spark):
    generated, structured = texts(spark, ["a", "b"]), texts(spark, ["c", " ", "d", "e"])
    assert numbers(merge_structured(generated, structured, 4, shape_only)) == [0]
    assert numbers(merge_structured(generated, structured, 4, shape_only, cap="after")) == [0, 2]
    assert merge_structured(generated, structured, 2, shape_only).count() == 0


def test_running_again_changes_nothing(spark, tmp_path):
    generated, structured = texts(spark, ["a", "b", " "]).drop("scope"), texts(spark, ["c", "d"]).drop("scope")
    for _ in range(2):
        run = assemble_run(generated, structured, str(tmp_path), "r", validate_generated=shape_only, validate_structured=shape_only, target=3)
        assert sorted((r.part, r.text) for r in run.collect()) == [("generated", "a"), ("generated", "b"), ("normalized", "c")]


def test_waves_stop_at_the_target_and_resume_behind_the_last_checkpoint(spark, tmp_path):
    chunks = texts(spark, ["a", " ", "b", "c", "d", "e", "f"]).drop("scope")
    seen, fail = [], {"after": 1}

    def produce(batch):
        if len(seen) == fail["after"]:
            fail["after"] = -1
            raise RuntimeError("lost")
        seen.append(numbers(batch))
        return shape_only(batch).accepted

    run = lambda: generate_to_target(chunks, produce, str(tmp_path), "r", target=4, wave=2)
    with pytest.raises(RuntimeError):
        run()
    assert sorted(r.text for r in run().collect()) == ["a", "b", "c", "d"]
    assert seen == [[0, 1], [2, 3], [4, 5]]
    assert sorted(r.text for r in run().collect()) == ["a", "b", "c", "d"] and len(seen) == 3


def test_resume_skips_done_chunks(spark):
    chunks = spark.createDataFrame([("a",), ("b",)], "chunk_id string")
    assert [r.chunk_id for r in unprocessed(chunks, chunks.where("chunk_id = 'a'")).collect()] == ["b"]


def pair_records(spark):
    df = spark.createDataFrame([(0, "p", "c", {"supporting_quote": "c"}), (1, "q", "d", {})], "n bigint, p string, c string, x map<string,string>")
    where = metadata(F.lit("d"), F.lit("f"), F.lit("h"), extra=F.col("x"))
    return as_records(df, SFT_PAIR, ord=position(F.col("n")), prompt=F.col("p"), completion=F.col("c"), metadata=where)


def test_export_and_reload(spark, tmp_path):
    folder = str(tmp_path / "bundle")
    assert IO.export_bundle(pair_records(spark), SFT_PAIR, folder) == 2
    lines = [json.loads(x) for name in os.listdir(f"{folder}/train.jsonl") if name.endswith(".json") for x in open(f"{folder}/train.jsonl/{name}")]
    by_prompt = {x["prompt"]: x for x in lines}
    assert by_prompt["p"]["metadata"]["extra"] == {"supporting_quote": "c"}
    assert by_prompt["q"]["metadata"]["extra"] is None and "chunk_id" in by_prompt["q"]["metadata"]
    assert IO.load_jsonl(spark, f"{folder}/train.jsonl", SFT_PAIR).count() == 2
    assert spark.read.parquet(f"{folder}/train.parquet").count() == 2


def test_export_keeps_the_order(spark, tmp_path):
    folder = str(tmp_path / "bundle")
    df = spark.range(3000).select(((F.col("id") * 1301) % 3000).alias("n")).repartition(5)
    where = metadata(F.lit("d"), F.lit("f"), F.lit("h"))
    rows = as_records(df, CPT, ord=position(F.col("n")), text=F.col("n").cast("string"), metadata=where)
    # Small tables would be merged to one part.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert IO.export_bundle(rows, CPT, folder) == 3000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    names = sorted(name for name in os.listdir(f"{folder}/train.jsonl") if name.endswith(".json"))
    assert [json.loads(x)["text"] for name in names for x in open(f"{folder}/train.jsonl/{name}")] == [str(n) for n in range(3000)]
    assert sorted((r.position, r.text) for r in IO.read_bundle(spark, folder).collect()) == [(n, str(n)) for n in range(3000)]
    assert sorted(int(r.text) for r in IO.read_bundle(spark, folder, 700, 1900).collect()) == list(range(700, 1901))
    parts = sorted(map(tuple, spark.read.parquet(f"{folder}/parts.parquet").select("first", "last", "rows").collect()))
    assert len(parts) > 3 and parts[0][0] == 0 and parts[-1][1] == 2999 and all(b - a + 1 == n for a, b, n in parts)
    assert all(x[1] + 1 == y[0] for x, y in zip(parts, parts[1:]))
    gone = next(name for name in sorted(os.listdir(f"{folder}/train.parquet")) if name.endswith(".parquet"))
    os.remove(f"{folder}/train.parquet/{gone}")
    with pytest.raises(IO.ReloadMismatch):
        IO.read_bundle(spark, folder)


def test_no_records_no_files(spark, tmp_path):
    assert IO.export_bundle(pair_records(spark), CPT, str(tmp_path / "none")) == 0
    assert not (tmp_path / "none").exists()


def test_a_changed_reload_is_noticed(spark):
    rows = IO.export_rows(pair_records(spark), SFT_PAIR)
    written = rows.agg(*IO.fingerprint(rows)).first().asDict()
    IO.reload_check(written, rows.repartition(3))
    for other in (rows.withColumn("prompt", F.lit("p")), rows.limit(1), rows.unionByName(rows)):
        with pytest.raises(IO.ReloadMismatch):
            IO.reload_check(written, other)


def test_loading_fails_on_bad_lines(spark, tmp_path):
    good = json.dumps({"text": "x", "metadata": {"document_id": "d", "source_name": "n", "source_hash": "h"}})
    (tmp_path / "ok.jsonl").write_text(good + "\n\n" + good + "\n")
    assert IO.load_jsonl(spark, str(tmp_path / "ok.jsonl"), CPT).count() == 2
    (tmp_path / "no_text.jsonl").write_text('{"metadata": {"document_id": "d", "source_name": "n", "source_hash": "h"}}')
    with pytest.raises(Exception, match="no text"):
        IO.load_jsonl(spark, str(tmp_path / "no_text.jsonl"), CPT).select("metadata").collect()
    for n, bad in enumerate(["{not json", '{"text": "x"}', '{"metadata": {"document_id": "d", "source_name": "n", "source_hash": "h"}}']):
        (tmp_path / f"bad{n}.jsonl").write_text(good + "\n" + bad + "\n")
        with pytest.raises(Exception):
            IO.load_jsonl(spark, str(tmp_path / f"bad{n}.jsonl"), CPT).collect()


def test_listing_shows_the_first_and_the_total(spark):
    shown = IO.first_records(texts(spark, list("abcde")), limit=2).collect()
    assert [(r.text, r.total) for r in shown] == [("a", 5), ("b", 5)]


SCHEMA = "ord bigint, text string"


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_stream_resumes_and_first_arrival_wins(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    arrive(spark, folder, [(5, "A"), (6, "b"), (7, "a")])
    drain = lambda: dedup_stream(read_stream(spark, folder, SCHEMA), out, checkpoint).awaitTermination()
    drain()
    arrive(spark, folder, [(1, "a"), (2, "c")])
    drain()
    drain()
    assert sorted((r.ord, r.text) for r in spark.read.parquet(out).collect()) == [(2, "c"), (5, "A"), (6, "b")]


def test_stream_equals_batch(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(3):
        arrive(spark, folder, [(k * 10 + i, f"t{i}") for i in range(4)])
    upper = lambda batch, _: batch.withColumn("text", F.upper("text"))
    process_stream(read_stream(spark, folder, SCHEMA, files_per_batch=1), out, str(tmp_path / "cp"), upper).awaitTermination()
    batch = spark.read.schema(SCHEMA).parquet(folder).withColumn("text", F.upper("text"))
    assert sorted(map(tuple, spark.read.parquet(out).select("ord", "text").collect())) == sorted(map(tuple, batch.collect()))


def test_scratch_folder_comes_from_the_session(spark, tmp_path):
    assert session.scratch_path(spark, "x").startswith(session.shared_dir(spark))
    df = session.materialize(spark.range(5), "t")
    assert df.count() == 5 and any("corpusmill" in f for f in df.inputFiles())


def test_lookups_carry_no_broadcast_hint(spark):
    joined = session.join_bounded(spark.range(100), spark.range(10), ["id"])
    assert joined.count() == 10 and "ResolvedHint" not in joined._jdf.queryExecution().analyzed().toString()


def digest(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v string").select(F.unhex(F.md5("v")).alias("key"))


def test_a_batch_opens_its_own_prefixes_only(spark, tmp_path):
    ledger = KeyLedger(str(tmp_path), prefixes=64)
    for batch in range(3):
        ledger.add(digest(spark, *[f"{batch}-{k}" for k in range(200)]), batch)
    rows = digest(spark, "0-1", "2-5", "new")
    wanted = {r.p for r in rows.select(F.pmod(F.xxhash64("key"), F.lit(64)).alias("p")).collect()}
    # Files of other prefixes, and of the batch itself and later ones, cannot be read any more.
    for file in tmp_path.rglob("*.parquet"):
        prefix, batch = (int(p.split("=")[1]) for p in (file.parent.name, file.parent.parent.name))
        if prefix not in wanted or batch >= 2:
            file.write_bytes(b"no parquet at all")
    assert ledger.known(rows, 2).count() == 1 and ledger.unknown(rows, 2).count() == 2
    assert ledger.known(rows, 0).count() == 0


def test_a_repeated_batch_replaces_its_keys(spark, tmp_path):
    ledger = KeyLedger(str(tmp_path))
    assert ledger.unknown(digest(spark, "a"), 0).count() == 1
    for _ in range(2):
        ledger.add(digest(spark, "a", "a", "b"), 0)
    rows = digest(spark, "a", "c")
    assert ledger.unknown(rows, 0).count() == 2 and ledger.unknown(rows, 1).count() == 1
    ledger.add(digest(spark, "c").limit(0), 1)
    assert ledger.unknown(rows, 2).count() == 1


def test_waves_of_any_size_accept_the_same(spark, tmp_path):
    base = " ".join(f"w{k}" for k in range(120))
    values = [base, "other", base + " x", "OTHER ", "", base, "third thing", base + " x y", "third  thing", "last"]
    records = texts(spark, values)
    want = numbers(validate(records, max_tokens=None).accepted)
    assert 0 in want and 5 not in want and 3 not in want and 4 not in want
    for wave in (1, 3, 100):
        folder = str(tmp_path / str(wave))
        run = lambda: generate_to_target(
            records, lambda chunks: chunks, folder, "r", target=None, wave=wave, validate=WaveValidator(f"{folder}/ledgers", None)
        )
        assert numbers(run()) == want
        # The last wave was written but not checkpointed.
        shutil.rmtree(f"{folder}/checkpoints/run_id=r/wave={-(-10 // wave) - 1}")
        assert numbers(run()) == want


def test_files_of_a_stream_grow_in_number_with_the_table(spark, tmp_path, monkeypatch):
    folder, out = str(tmp_path / "tables"), str(tmp_path / "out")
    rows = spark.range(400).selectExpr("id AS doc_id", "concat('text ', id % 300, repeat(sha2(string(id % 300), 512), 4)) AS text", "'s' AS source")
    rows.repartition(12).write.parquet(f"{folder}/documents.parquet")
    monkeypatch.setattr(runs, "scratch_path", lambda spark, name: f"{out}/{name}")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        assert runs.streamed_dedup(spark, folder).where("n = 1").count() == 300
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    # Before, there were four files whatever the size of the table.
    assert len(list((tmp_path / "out/arrivals").glob("part-*.parquet"))) >= 12
    assert len(list((tmp_path / "out/stream").glob("batch=*"))) == 4
