import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusmill.llm.decontamination import PassageIndex, normalized, with_passages, without_passages
from corpusmill.llm.packing import concat_and_cut, tokenized
from corpusmill.llm.toxicity import scored, train
from corpusmill.llm.warc import described, read_archive, read_warc_files, write_archive, write_warc_files
from corpusmill.session import scratch_path

FOLDER = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def test_pieces_are_the_documents_ids_without_gap(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame(
        [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "a\x1cb c’s ŁÓDŹ <|endoftext|> 日本 é"), (10**6 + 2, "again"), (None, "x " * 9000)],
        "doc_id long, text string",
    )
    docs = docs.union(odd)
    pieces = concat_and_cut(tokenized(docs.repartition(3), TOKENIZER), window=512).collect()
    tokenizer = Tokenizer.from_file(TOKENIZER)
    want = {}
    for r in docs.collect():
        want.setdefault(r.doc_id, []).append([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2])
    places = sorted((p.sequence_id * 512 + p.offset, p.length) for p in pieces)
    assert [a for a, _ in places] == [0, *np.cumsum([n for _, n in places])[:-1].tolist()]
    assert all(p.offset + p.length <= 512 for p in pieces)
    total = sum(len(ids) for lists in want.values() for ids in lists)
    assert sum(n for _, n in places) == total
    for p in pieces:
        texts = [ids for ids in want[p.doc_id] if len(ids) == p.doc_tokens]
        crcs = {zlib.crc32(np.array(ids[p.start : p.start + p.length], dtype="<u4").tobytes()) for ids in texts}
        assert p.ids_crc32 in crcs


def test_no_documents_no_pieces(spark):
    assert concat_and_cut(tokenized(spark.createDataFrame([], "doc_id long, text string"), TOKENIZER)).count() == 0


def test_archive_gives_the_records_back(spark):
    long, other = "<p>x</p>" * 200, "é" * 500
    rows = [(1, "http://a", long), (2, "http://b\r\nX: y", long), (3, None, other), (4, "u", other), (5, "u", "short"), (6, "u", "short"), (7, "u", None), (None, "u", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = scratch_path(spark, "warc-test")
    write_archive(pages, folder)
    got = {r.id: r for r in described(read_archive(spark, folder)).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {
        1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None),
        5: ("response", None), 6: ("response", None), 7: ("response", None), None: ("revisit", 2),
    }
    assert got[1].payload_bytes == 1600 and got[7].payload_bytes == 0 and got[3].payload_bytes == 1000
    assert spark.read.parquet(f"{folder}/payloads").count() == 4
    records = read_archive(spark, folder)
    write_warc_files(records, f"{folder}/files")
    assert sorted(bytes(r.record) for r in read_warc_files(spark, f"{folder}/files").collect()) == sorted(bytes(r.record) for r in records.collect())


def edits_of(passage, text):
    """Fewest edits with which the passage occurs anywhere in the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(passage, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_passages_equal_brute_force(spark):
    draw = random.Random(5)
    words = ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 8))) for _ in range(200)]
    passage = lambda n: " ".join(draw.choice(words) for _ in range(n))
    items = [(i, passage(draw.randint(6, 25))) for i in range(12)] + [(90, None), (91, "tiny"), (92, "")]

    def changed(text, n):
        for _ in range(n):
            at = draw.randrange(len(text))
            text = draw.choice([text[:at] + text[at + 1 :], text[:at] + "z" + text[at:], text[:at] + "z" + text[at + 1 :]])
        return text

    texts = [None, "", "x"]
    for i, t in items[:12]:
        for n in (0, 1, len(t) * 5 // 100, len(t) * 5 // 100 + 3, len(t) // 5):
            texts.append(passage(30) + "\n  " + changed(t, n).upper() + " " + passage(draw.randint(0, 60)))
    index = PassageIndex(items)
    want = []
    for t in texts:
        t = normalized(t)
        want.append({i: edits_of(p, t) for (i, p), e in zip(index.items, index.edits) if edits_of(p, t) <= e})
    got = [{i: e for i, (e, _) in found.items()} for found in index.find(texts)]
    assert got == want and sum(map(len, want)) >= 30
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (4_000_000, 500):
        rows = with_passages(docs, bench, slice_chars=size).collect()
        assert [{x.item_id: x.edits for x in r.passages} for r in sorted(rows, key=lambda r: r.doc_id)] == want
    kept = without_passages(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, w in enumerate(want) if not w}
    assert without_passages(docs.limit(0), bench).count() == 0
    assert without_passages(docs, bench.limit(0)).count() == len(texts)


def test_short_passages_stand_apart():
    index = PassageIndex([(1, "Ten chars!"), (2, "cat"), (3, "a passage of 21 chars"), (4, "x y"), (5, "日本語"), (6, " ")])
    found = index.find(["so ten  CHARS! end", "concatenate cats", "the cat.", "cat", "a passge of 21 chars", "a pssge of 21 chars", "xx y x y", "xx yy", "日本語", "日本語文", None])
    assert [sorted(f) for f in found] == [[1], [], [2], [2], [3], [], [4], [], [5], [], []]
    assert found[6][4] == (0, 8)


def test_a_common_opening_names_no_candidates():
    draw = random.Random(1)
    words = lambda n: " ".join("".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randrange(2, 9))) for _ in range(n))
    opening = "choose the best answer to the following question: "
    items = [(k, opening + words(25)) for k in range(3000)]
    index = PassageIndex(items)
    (group,) = index.groups
    texts = [opening + words(25) for _ in range(50)] + [words(30) + " " + items[7][1].replace("e", "", 3) + words(5)]
    starts = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le"), dtype="<u4").astype("uint64")
    assert {item for _, item, _ in group.bands(codes, starts)} == {7}
    assert [set(f) for f in index.find(texts)] == [set()] * 50 + [{7}]
    # Passages that differ in little still have their rarest q-grams looked up.
    alike = PassageIndex([(k, f"{opening}{k:04d} and then some more of it") for k in range(300)])
    assert set(alike.find([f"{opening}0042 and then some more of it"])[0]) >= {42}


def test_a_long_text_is_searched_whole():
    item = "the quick brown fox jumps over the lazy dog by the river bank"
    text = "lorem ipsum dolor " * 150_000 + item + " end " + "abc def " * 100_000
    assert PassageIndex([(1, item)]).find([text]) == [{1: (0, len("lorem ipsum dolor " * 150_000) + len(item))}]


def test_toxic_words_are_learned(spark):
    draw = random.Random(3)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for i in range(900):
        text = [draw.choice(words) for _ in range(draw.randint(3, 80))]
        if i % 5 == 0:
            text[draw.randrange(len(text))] = draw.choice(["Vile,", "rotten."])
        rows.append((i, " ".join(text), int(i % 5 == 0)))
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(900, None, "x"), (901, "", "x"), (None, "vile", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(900, None)], "doc_id long, toxic int")
    weights = train(docs, labels)
    assert len(weights) < 10_000
    held = {i for i in range(900) if zlib.crc32(str(i).encode()) % 4 == 2}
    got = {r.doc_id: r.score for r in scored(docs, weights).collect()}
    right = sum((got[i] >= 0.3) == bool(y) for i, _, y in rows if i in held)
    assert right / len(held) > 0.97
    assert 0 <= got[900] == got[901] < 0.3 <= got[None]
    assert train(docs, labels.limit(0)) == []


@pytest.mark.parametrize("name", ["op3_toxicity_ftrl", "op5_concat_and_cut", "op8_qgram_decontamination"])
def test_queries_cover_every_document(spark, name):
    from __spark_entry__ import queries

    ids = {r.doc_id for r in queries()[name](spark, FOLDER).select("doc_id").collect()}
    assert ids == {r.doc_id for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id").collect()}
