import hashlib
import json
import shutil

import pytest
from pyspark.sql import functions as F

from catalog import documents
from corpusmill.sources import cache as C
from corpusmill.sources.documents import extract_blocks, flag_admission, hash_files, list_files, html_blocks
from corpusmill.sources.manifest import add_sources, confirm_mapping, latest, list_active, run_summary, split_confirmed
from corpusmill.sources.structured import EmptySource, UnsupportedFormat, read_csv_rows, read_json_rows, read_jsonl_rows, read_structured


def data(df):
    return [json.loads(r.d) for r in df.orderBy("row_no").select(F.to_json("data").alias("d")).collect()]


def test_csv(spark, tmp_path):
    path = tmp_path / "pairs.csv"
    path.write_bytes(b'prompt,completion\n"two\nlines","say ""hi"""\n\n"", b \nshort\n')
    rows = read_structured(spark, str(path))
    assert [r.row_id for r in rows.orderBy("row_no").collect()] == ["0", "1", "2"]
    assert data(rows) == [
        {"prompt": "two\nlines", "completion": 'say "hi"'}, {"prompt": "", "completion": " b "}, {"prompt": "short", "completion": None},
    ]


def test_json_array_and_object(spark, tmp_path):
    (tmp_path / "a.json").write_text('\n [{"text": "a"}, {"text": "b", "n": [1, null]}]')
    (tmp_path / "o.json").write_text('{"text": "one"}')
    rows = read_structured(spark, str(tmp_path / "a.json"))
    assert data(rows) == [{"text": "a"}, {"text": "b", "n": [1, None]}]
    assert [r.row_id for r in rows.orderBy("row_no").collect()] == ["0", "1"]
    assert data(read_structured(spark, str(tmp_path / "o.json"))) == [{"text": "one"}]


def test_jsonl_numbers_physical_lines(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"text": "a"}\n\n{"text": "b"}\n')
    rows = read_structured(spark, str(tmp_path / "r.jsonl"))
    assert [r.row_id for r in rows.orderBy("row_no").collect()] == ["0", "2"]


def test_row_numbers_over_many_splits(spark, tmp_path):
    for k in range(3):
        lines = ["" if i % 5 == 2 else json.dumps({"i": i, "pad": "x" * (i % 50)}) for i in range(400 + 60 * k)]
        (tmp_path / f"f{k}.jsonl").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        rows = read_jsonl_rows(spark, str(tmp_path)).select("row_no", F.try_variant_get(F.col("data")["i"], "$", "bigint").alias("i"))
        assert rows.rdd.getNumPartitions() > 3
        assert rows.where("row_no <> i").count() == 0
        assert rows.count() == sum(400 + 60 * k - (400 + 60 * k) // 5 for k in range(3))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_row_numbers_of_several_csv_files(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"f{k}.csv").write_text("i\n" + "\n".join(str(i) for i in range(50 + k)))
    rows = read_csv_rows(spark, str(tmp_path)).select("row_id", F.try_variant_get(F.col("data")["i"], "$", "string").alias("i"))
    assert rows.count() == 153 and rows.where("row_id <> i").count() == 0


def test_unknown_suffix_and_empty_files(spark, tmp_path):
    (tmp_path / "x.xlsx").write_text("a")
    with pytest.raises(UnsupportedFormat):
        read_structured(spark, str(tmp_path / "x.xlsx"))
    (tmp_path / "h.csv").write_text("prompt,completion\n")
    with pytest.raises(EmptySource):
        read_structured(spark, str(tmp_path / "h.csv"))


def test_an_empty_array_does_not_vanish_among_other_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"text": "x"}]')
    (tmp_path / "b.json").write_text(" [ ] ")
    with pytest.raises(Exception, match="no rows in .*b.json"):
        read_json_rows(spark, str(tmp_path)).collect()
    with pytest.raises(EmptySource):
        read_structured(spark, str(tmp_path / "b.json"))


def test_listing_admission_and_hashes(spark, tmp_path):
    for name, body in {"a.md": b"same", "b.TXT": b"same", "c.md": b"", "d.exe": b"x", "noext": b"x"}.items():
        (tmp_path / name).write_bytes(body)
    flagged = {r.path.rsplit("/", 1)[1]: r.reject_reason for r in flag_admission(list_files(spark, str(tmp_path))).collect()}
    assert flagged == {"a.md": None, "b.TXT": None, "c.md": "empty", "d.exe": "unsupported", "noext": "unsupported"}
    hashes = {r.path.rsplit("/", 1)[1]: r.source_hash for r in hash_files(spark, str(tmp_path)).collect()}
    assert hashes["a.md"] == hashes["b.TXT"] == hashlib.sha256(b"same").hexdigest()
    big = spark.createDataFrame([("x.pdf", 500 * 1024 * 1024), ("y.pdf", 500 * 1024 * 1024 + 1)], "path string, length bigint")
    assert [r.reject_reason for r in flag_admission(big).orderBy("path").collect()] == [None, "oversized"]


def blocks(spark, path, content):
    df = spark.createDataFrame([(path, content.encode())], "path string, content binary")
    row = extract_blocks(df).first()
    return None if row.blocks is None else [(b.level, b.text) for b in row.blocks]


def test_markdown_blocks(spark):
    text = "# T #\r\nintro\nmore\n\n## A\n```py\n# code\n\nx\n```\nafter\n\n\n####### not a heading\n#nor this\n"
    assert blocks(spark, "a.md", text) == [
        (1, "T"), (0, "intro\nmore"), (2, "A"), (0, "```py\n# code\n\nx\n```"), (0, "after"), (0, "####### not a heading\n#nor this"),
    ]
    assert blocks(spark, "a.txt", "  \n\n ") == []


def test_html_blocks(spark):
    page = (
        '<html><head><title>t</title></head><body><nav><a href="/">menu</a></nav><!-- <h1>no</h1> --><h1 class="x">Big &amp; <b>bold</b></h1>'
        '<script>var t="</p><h1>no</h1>";</script><p>one<br>two<p>three <i>it</i>al<ul><li>l1<li>l2</ul><h2>Sub</h2>5 &lt; 6 &#8217;'
        "<footer>foot</footer></body>"
    )
    assert blocks(spark, "a.html", page) == [
        (1, "Big & bold"), (0, "one two"), (0, "three ital"), (0, "l1"), (0, "l2"), (2, "Sub"), (0, "5 < 6 ’"),
    ]
    assert blocks(spark, "a.htm", "<p>no heading</p>tail") == [(0, "no heading"), (0, "tail")]


def test_a_reference_without_its_semicolon_is_text(spark):
    page = "<h1>a&&amp;b &amp</h1><p>&lt &nosuch; &notit; &ampamp; &amp;lt; &#65 &#x42; &eacute;&copy;"
    assert blocks(spark, "a.html", page) == [(1, "a&&b &amp"), (0, "&lt &nosuch; &notit; &ampamp; &lt; &#65 B é©")]


def test_cache_extracts_once_and_heals_a_fallback(spark, tmp_path):
    docs = spark.createDataFrame([("h1", "a.txt", b"one"), ("h1", "copy.txt", b"one"), ("h2", "b.txt", b"two")], "source_hash string, path string, content binary")
    calls = []

    def extract(df):
        calls.append(sorted(r.source_hash for r in df.select("source_hash").collect()))
        return extract_blocks(df)

    path = str(tmp_path / "cache")
    assert C.extract_cached(docs, path, "v1", extract).count() == 2
    assert C.extract_cached(docs, path, "v1", extract).count() == 2
    assert calls == [["h1", "h2"], []]
    # Another version starts anew; the remote fails for h2, which falls back.
    down = lambda df: df.withColumn("blocks", F.lit(None).cast("array<struct<level:int,text:string,page:int>>")).withColumn("reject_reason", F.when(F.col("source_hash") == "h2", "unavailable"))
    rows = C.extract_cached(docs, path, "v2", extract, down)
    assert {r.source_hash: r.variant for r in rows.collect()} == {"h1": "remote", "h2": "fallback"}
    up = lambda df: extract_blocks(df)
    healed = C.extract_cached(docs, path, "v2", extract, up)
    assert {r.source_hash: r.variant for r in healed.collect()} == {"h1": "remote", "h2": "remote"}
    assert calls[2:] == [["h2"], []]


def test_a_local_run_never_reads_a_fallback(spark):
    stored = spark.createDataFrame([("h", "v", "fallback"), ("h", "v", "remote")], "source_hash string, extractor_version string, variant string")
    assert C.best_variant(stored, "local").count() == 0
    assert C.best_variant(stored, "remote").first().variant == "remote"


UPLOADS = "project_id string, filename string, source_hash string, size_bytes bigint, ord bigint"


def test_manifest_keeps_the_first_name_of_a_content(spark):
    uploads = spark.createDataFrame([("p", "b.md", "h", 1, 2), ("p", "a.txt", "h", 1, 1), ("q", "b.md", "h", 1, 3), ("p", "c.csv", "k", 1, 4)], UPLOADS)
    manifest = add_sources(uploads)
    assert sorted((r.project_id, r.filename, r.relative_path) for r in manifest.collect()) == [
        ("p", "a.txt", "projects/p/sources/h.txt"), ("p", "c.csv", "projects/p/sources/k.csv"), ("q", "b.md", "projects/q/sources/h.md"),
    ]
    again = add_sources(spark.createDataFrame([("p", "z.txt", "h", 1, 9), ("p", "n.txt", "new", 1, 10)], UPLOADS), manifest)
    assert [r.filename for r in again.collect()] == ["n.txt"]


def test_confirming_and_splitting(spark):
    manifest = add_sources(spark.createDataFrame([("p", "a.csv", "h", 1, 1), ("p", "b.md", "k", 1, 2)], UPLOADS))
    row = manifest.where("filename = 'a.csv'").first()
    confirmed = spark.createDataFrame([(row.source_id, "text", {"body": "text"})], "source_id string, confirmed_schema string, column_mapping map<string,string>")
    structured, documents = split_confirmed(confirm_mapping(manifest, confirmed))
    assert [(r.filename, r.column_mapping) for r in structured.collect()] == [("a.csv", {"body": "text"})]
    assert [r.filename for r in documents.collect()] == ["b.md"]


def test_latest_active_and_summary(spark):
    checkpoints = spark.createDataFrame([("r", 5, 50), ("r", 12, 90), ("s", 1, 3)], "run_id string, sequence bigint, completed_rows bigint")
    assert {r.run_id: (r.sequence, r.completed_rows) for r in latest(checkpoints, "run_id", by="sequence", columns=("completed_rows",)).collect()} == {"r": (12, 90), "s": (1, 3)}
    projects = spark.createDataFrame([("b", 2, None), ("a", 1, None), ("c", 0, "x")], "name string, created_at int, deleted_at string")
    assert [r.name for r in list_active(projects).collect()] == ["a", "b"]
    records = spark.createDataFrame([("r", ("document",)), ("r", ("structured",)), ("r", ("document",))], "run_id string, metadata struct<source_kind:string>")
    runs = spark.createDataFrame([("r", "completed", False), ("e", "completed", True)], "run_id string, status string, is_preview boolean")
    found = {r.run_id: (r.accepted_generated, r.accepted_normalized, r.total_rows) for r in run_summary(records, runs).collect()}
    assert found == {"r": (2, 1, 3), "e": (0, 0, 0)}


def test_malformed_json_array_is_not_passed_over(spark, tmp_path):
    (tmp_path / "good.json").write_text('[{"x": 1}]')
    (tmp_path / "bad.json").write_text('[{"x": 1}, {"x"')
    with pytest.raises(Exception, match="malformed JSON array"):
        read_json_rows(spark, str(tmp_path)).collect()


def test_the_cache_depends_on_neither_order_nor_a_failed_append(spark, tmp_path):
    rows = [("h1", "a.pdf", b"same"), ("h1", "b.txt", b"same"), ("h2", "z.txt", b"two"), ("h2", "c.txt", b"two"), ("h3", "d.md", b"# t")]
    schema = "source_hash string, path string, content binary"
    told = []
    for turn, order in enumerate((rows, rows[::-1])):
        path = str(tmp_path / str(turn))
        docs = spark.createDataFrame(order, schema).repartition(turn + 1)
        first = C.extract_cached(docs, path, "v1", extract_blocks)
        told.append(sorted((r.source_hash, r.reject_reason) for r in first.collect()))
        # As if the run had ended before its commit: the files are there, the commit is not.
        (commit,) = (tmp_path / str(turn) / "commits").glob("batch=*")
        shutil.rmtree(commit)
        assert C.ExtractionCache(spark, path).stored().count() == 0
        again = C.extract_cached(docs, path, "v1", extract_blocks)
        told.append(sorted((r.source_hash, r.reject_reason) for r in again.collect()))
    # The least path is that of a kind without an extractor.
    assert told == [[("h1", "no_extractor"), ("h2", None), ("h3", None)]] * 4


def test_contents_beyond_the_limit_are_not_hashed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(b"12345")
    (tmp_path / "b.txt").write_bytes(b"1234567890")
    got = {r.path.rsplit("/", 1)[1]: (r.length, r.source_hash) for r in hash_files(spark, str(tmp_path), most_bytes=5).collect()}
    assert got == {"a.txt": (5, hashlib.sha256(b"12345").hexdigest()), "b.txt": (10, None)}


def test_a_page_is_cleaned_once(spark):
    # Before, the chain of replacements stood five times in the expression and was worked off as often.
    assert str(html_blocks(F.col("html"))).count("<noscript") == 1


def test_files_of_pages_share_folders(spark, tmp_path):
    # Before, every page had a folder of its own, made and moved by Spark's writer.
    pages = [(i, f"http://x/{i}" + ("?q" if i % 3 == 0 else ""), None if i == 7 else f"<p>é {i}</p>") for i in range(600)]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    path = documents._page_files(spark, str(tmp_path))
    listed = {r.path.rsplit("/", 1)[1]: r.length for r in list_files(spark, path).collect()}
    assert len(listed) == 600 and listed["page-8.txt"] == len("<p>é 8</p>\n".encode()) and listed["page-7.txt"] == 1
    assert {name.endswith(".gz") for name in listed} == {True, False}
    folders = {r.path.rsplit("/", 2)[1] for r in list_files(spark, path).collect()}
    assert len(folders) == documents.PAGE_FOLDERS
    assert hash_files(spark, path).where(F.col("source_hash") == hashlib.sha256("<p>é 8</p>\n".encode()).hexdigest()).count() == 1


def test_contents_that_the_cache_has_are_not_moved(spark, tmp_path, monkeypatch):
    from corpusmill.sources import cache

    written, plain = [], cache.materialize

    def watched(df, name):
        out = plain(df, name)
        if name == "contents-wanted":
            written.append((out.columns, out.count()))
        return out

    monkeypatch.setattr(cache, "materialize", watched)
    docs = spark.createDataFrame([(h, f"{p}.html", f"text of {h}") for h in "abc" for p in "yx"], "source_hash string, path string, content string")
    extract = lambda d: d.selectExpr("*", "CAST(NULL AS array<struct<level:int,text:string,page:int>>) AS blocks", "path AS reject_reason")
    for some in (docs.where("source_hash < 'c'"), docs, docs):
        found = cache.extract_cached(some, str(tmp_path / "cache"), "v1", extract)
    assert sorted((r.source_hash, r.reject_reason) for r in found.collect()) == [(h, "x.html") for h in "abc"]
    assert written == [(["source_hash", "_path"], n) for n in (2, 1, 0)]
