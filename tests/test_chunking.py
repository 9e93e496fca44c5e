import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusmill.functions.tokens import PORTION, ArrowTokenizer, SubwordTokenizer, portions
from corpusmill.operators.chunking import chunk_blocks, document_id, estimate_rows, sample_text, token_windows
from corpusmill.sources.documents import extract_blocks, html_blocks, markdown_blocks, unescape_blocks


def chunks(spark, text, **options):
    docs = spark.createDataFrame([("d", text)], "document_id string, text string").select("document_id", markdown_blocks(F.col("text")).alias("blocks"))
    return chunk_blocks(docs, **options).orderBy("chunk_no").collect()


def test_heading_without_body_makes_no_chunk(spark):
    got = chunks(spark, "# Company\n\n## Leave\n\nTwenty days.\n\n## Illness\n\nTen days.\n")
    assert [(c.heading, c.headings, c.text, c.chunk_id) for c in got] == [
        ("Leave", ["Company", "Leave"], "Twenty days.", "d-0"), ("Illness", ["Company", "Illness"], "Ten days.", "d-1"),
    ]


def test_no_heading(spark):
    (only,) = chunks(spark, "Just a paragraph.\n")
    assert only.heading is None and only.headings == [] and only.page is None


def test_levels_reset_deeper_ones(spark):
    got = chunks(spark, "# A\n\n### B\n\nx\n\n## C\n\ny\n\n# D\n\nz")
    assert [c.headings for c in got] == [["A", "B"], ["A", "C"], ["D"]]


def test_greedy_packing_and_windows(spark):
    got = chunks(spark, "a b\n\nc d\n\ne\n\n" + " ".join(f"w{i}" for i in range(7)) + "\n\nz", max_tokens=4)
    assert [c.text for c in got] == ["a b\nc d", "e", "w0 w1 w2 w3", "w4 w5 w6\nz"]


def test_page_is_the_first_known_one(spark):
    docs = spark.createDataFrame([("d", [(0, "a", None), (0, "b", 3), (0, "c", 4)])], "document_id string, blocks array<struct<level:int,text:string,page:int>>")
    assert chunk_blocks(docs).first().page == 3


def test_refused_documents_make_no_chunk(spark):
    files = spark.createDataFrame([("a.md", b"# H\n\nbody"), ("b.pdf", b"x"), ("c.md", b"")], "path string, content binary")
    docs = extract_blocks(files).withColumn("document_id", F.col("path"))
    for options in ({}, {"tokenizer": ArrowTokenizer(lambda: (str.split, " ".join))}):
        assert [(c.document_id, c.text) for c in chunk_blocks(docs, **options).collect()] == [("a.md", "body")]


def fold(blocks, limit):
    out, used, path, open_ = [], 0, [], False
    for level, text in blocks:
        if level:
            path, open_ = [p for p in path if p[0] < level] + [(level, text)], False
            continue
        tokens = text.split()
        pieces = [tokens] if len(tokens) <= limit else [tokens[i : i + limit] for i in range(0, len(tokens), limit)]
        for piece in pieces:
            if open_ and used + len(piece) <= limit:
                out[-1][1].extend(piece)
                used += len(piece)
            else:
                out.append(([t for _, t in path], list(piece)))
                used, open_ = len(piece), True
    return out


def test_against_a_sequential_fold_and_another_tokenizer(spark):
    draw = random.Random(3)
    docs = []
    for n in range(40):
        blocks = [(draw.choice([0, 0, 0, 0, 1, 2]), " ".join(f"w{draw.randrange(99)}" for _ in range(draw.randrange(1, 25))), None) for _ in range(draw.randrange(0, 12))]
        docs.append((str(n), blocks))
    df = spark.createDataFrame(docs, "document_id string, blocks array<struct<level:int,text:string,page:int>>")
    expected = [(d, i, h, w) for d, blocks in docs for i, (h, w) in enumerate(fold([b[:2] for b in blocks], 8))]

    def words():
        known = {}
        names = []

        def encode(text):
            for w in text.split():
                if w not in known:
                    known[w] = len(names)
                    names.append(w)
            return [known[w] for w in text.split()]

        return encode, lambda ids: " ".join(names[i] for i in ids)

    for options in ({}, {"tokenizer": ArrowTokenizer(words)}):
        got = chunk_blocks(df, max_tokens=8, **options).collect()
        assert sorted((c.document_id, c.chunk_no, c.headings, c.text.split()) for c in got) == sorted(expected)


def test_chunks_of_a_subword_tokenizer(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    file = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(file)
    encode = lambda text: plain.encode(text, add_special_tokens=False)
    draw = random.Random(8)
    words = ["extraordinary", "naïve", "hedgehogs", "日本語", "😀😀", "x1234567", "the", "of", "--", "\u00a0z"]
    texts = [" ".join(draw.choice(words) for _ in range(n)) for n in (1, 5, 60, 300)]
    texts += ["  spaces \n\n kept\t ", "é" * 50, None, " "]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    tokens = SubwordTokenizer(file, step=500)
    counted = {r.id: r.n for r in df.select("id", tokens.count(F.col("text")).alias("n")).collect()}
    assert counted == {i: None if t is None else len(encode(t).ids) for i, t in enumerate(texts)}
    windows = {}
    for row in token_windows(df, "id", size=16, tokenizer=tokens).orderBy("window_no").collect():
        windows.setdefault(row.id, []).append(row.text)
    for i, text in enumerate(texts):
        if text and text.strip():
            offsets = encode(text).offsets
            at = [0, *[o[0] for o in offsets[16::16]], len(text)]
            assert windows[i] == [text[a:b] for a, b in zip(at, at[1:])] and "".join(windows[i]) == text
    docs = spark.createDataFrame(
        [("d", [(1, "H"), (0, texts[2]), (0, None), (0, "short one"), (0, "and another")]), ("e", None)],
        "document_id string, b array<struct<level: int, text: string>>",
    ).withColumn("blocks", F.transform("b", lambda b: F.struct(b["level"].alias("level"), b["text"].alias("text"), F.lit(1).alias("page"))))
    got = chunk_blocks(docs, max_tokens=16, tokenizer=tokens).orderBy("chunk_no").collect()
    pieces = [*windows[2], "short one", "and another"]
    expected, used = [], 99
    for piece in pieces:
        n = len(encode(piece).ids)
        if used + n <= 16:
            expected[-1], used = f"{expected[-1]}\n{piece}", used + n
        else:
            expected.append(piece)
            used = n
    assert [c.text for c in got] == expected and {(c.heading, c.page) for c in got} == {("H", 1)}
    plan = chunk_blocks(docs, max_tokens=16, tokenizer=tokens)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_subword_tokens_are_those_of_the_text_though_words_are_tokenized_once(monkeypatch):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import tokenizers

    file = public_tokenizers.path("word_bpe_49k.json")
    plain = tokenizers.Tokenizer.from_file(file)
    seen = []

    class Watched:
        def __getattr__(self, name):
            return getattr(plain, name)

        def encode(self, text, **options):
            return self.encode_batch([text], **options)[0]

        def encode_batch(self, texts, **options):
            seen.append(sum(map(len, texts)))
            return plain.encode_batch(texts, **options)

    monkeypatch.setattr(tokenizers, "Tokenizer", type("Files", (), {"from_file": staticmethod(lambda _: Watched())}))
    counts, pieces = SubwordTokenizer(file).open()
    draw = random.Random(5)
    bits = ["extraordinary", "Naïve", "日本語", "😀", "x12", "İ", ",", ".", "'LL", "e\u0301", "\u0338", "\u0958", "<|endoftext|>", "\u00a0", "\x1c", "\x85", "\u3000", " ", " ", "\n", "\t", "\x0b"]
    texts = ["".join(draw.choice(bits) for _ in range(draw.randrange(60))) for _ in range(300)]
    encoded = [plain.encode(t, add_special_tokens=False) for t in texts]
    assert counts(texts) == [len(e.ids) for e in encoded]
    for size in (1, 3, 16):
        for text, e, (windows, tokens) in zip(texts, encoded, pieces(texts, size)):
            at = [0, *[o[0] for o in e.offsets[size::size]], len(text)]
            assert windows == [text[a:b] for a, b in zip(at, at[1:])]
            assert tokens == [len(plain.encode(w, add_special_tokens=False).ids) for w in windows]
    seen.clear()
    again = "extraordinary weather, hedgehogs "
    assert set(counts([again] * 20_000)) == {len(plain.encode(again, add_special_tokens=False).ids)}
    assert sum(seen) < 1000


def test_windows_of_plain_text(spark):
    df = spark.createDataFrame([(1, "a b\nc  d e"), (2, " ")], "id int, text string")
    assert [(r.id, r.window_no, r.text) for r in token_windows(df, "id", size=2).orderBy("window_no").collect()] == [(1, 0, "a b"), (1, 1, "c  d"), (1, 2, "e")]


def test_estimate_and_ids(spark):
    row = estimate_rows(spark.range(1), spark.range(2), capped_at=2).first()
    assert (row.total_rows, row.truncated, row.capped_at) == (3, True, 2)
    ids = spark.range(2).select(document_id(F.lit("p"), F.lit("h")).alias("x")).distinct()
    assert ids.count() == 1


def test_sample_takes_sources_in_order_within_the_budget(spark):
    draw = random.Random(5)
    rows = [("p" if i % 3 else "q", i, "" if i % 7 == 0 else chr(97 + i % 26) * draw.randrange(1, 9)) for i in range(90)]
    df = spark.createDataFrame(rows, "project_id string, ord bigint, text string")
    for salts in (1, 8):
        got = {r.project_id: (r.sample, r.n_chars) for r in sample_text(df, budget=50, salts=salts).collect()}
        for project in "pq":
            left, parts = 50, []
            for name, _, text in rows:
                piece = text[:left]
                if name == project and left > 0 and piece.strip():
                    parts.append(piece)
                    left -= len(piece)
            assert got[project] == ("\n\n---\n\n".join(parts), 50 - left)


def test_a_long_document_does_not_travel_with_its_chunks(spark):
    one = spark.range(1).selectExpr(
        "'d' AS document_id", "array(named_struct('level', 0, 'text', repeat('some word ', 800000), 'page', CAST(null AS INT))) AS blocks"
    )
    rows = chunk_blocks(one).selectExpr("count(*) AS n", "max(length(text)) AS longest", "count(headings) AS h").first()
    assert rows.n == 3125 and rows.longest < 512 * 6 and rows.h == 3125


def test_the_heading_of_a_page_keeps_a_reference_cut_short(spark):
    pages = spark.createDataFrame([("p", "<h1>Auf&amp;amp &amp</h1><p>one &lt; two &lt")], "document_id string, html string")
    blocks = unescape_blocks(pages.select("document_id", html_blocks(F.col("html")).alias("blocks")))
    chunk = chunk_blocks(blocks, max_tokens=8).first()
    assert (chunk.heading, chunk.text) == ("Auf&amp &amp", "one < two &lt")


def test_windows_are_made_a_portion_of_a_batch_at_a_time(spark):
    texts = ["a b", None, "", "c " * PORTION, "d", "e f g"]
    parts = [list(part) for part in portions(pd.Series(texts, dtype=object))]
    assert [len(part) for part in parts] == [4, 2] and [t for part in parts for t in part] == texts
    docs = spark.createDataFrame(list(enumerate(texts)), "n int, text string").coalesce(1)
    tokenizer = ArrowTokenizer(lambda: (str.split, " ".join))
    got = token_windows(docs, "n", size=PORTION, tokenizer=tokenizer).orderBy("n", "window_no").collect()
    assert [(r.n, r.window_no, r.text[:5]) for r in got] == [(0, 0, "a b"), (3, 0, "c c c"), (4, 0, "d"), (5, 0, "e f g")]
