import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions.tokens import WORDS, ArrowTokenizer

SAMPLES = [
    "plain words here", "  padded\t\n", "", "   　\x1c\x85", "zero​width stays", "a b\x1fc", "İI ß Σς", "one",
    "x" + " " * 5000 + "y ", "line\none\r\ntwo",
]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLES)], "i int, t string")


def test_whitespace_follows_python(table):
    rows = table.select("i", T.strip(F.col("t")).alias("strip"), T.words(F.col("t")).alias("words"), T.is_blank(F.col("t")).alias("blank"), T.word_count(F.col("t")).alias("n")).collect()
    for row in rows:
        value = SAMPLES[row.i]
        assert row.strip == value.strip()
        assert row.words == value.split()
        assert row.n == len(value.split())
        assert row.blank == (not value.strip())


def test_normalized_hash_follows_python(table):
    import hashlib

    for row in table.select("i", T.normalized_hash(F.col("t")).alias("h")).collect():
        assert row.h == hashlib.sha256(" ".join(SAMPLES[row.i].split()).lower().encode()).hexdigest()


def test_windows_keep_the_text_verbatim(table):
    for row in table.where("t <> ''").select("i", WORDS.windows(F.col("t"), 2).alias("w")).collect():
        value = SAMPLES[row.i]
        assert all(len(w.split()) <= 2 and w in value for w in row.w if w)
        assert " ".join(row.w).split() == value.split()


def _byte_tokenizer():
    return (lambda t: list(t.encode())), (lambda ids: bytes(ids).decode(errors="ignore"))


def test_any_tokenizer_can_count_and_cut(spark):
    df = spark.createDataFrame([("abcdefg",), (None,)], "t string")
    tokens = ArrowTokenizer(_byte_tokenizer)
    rows = df.select(tokens.count(F.col("t")).alias("n"), tokens.windows(F.col("t"), 3).alias("w")).collect()
    assert rows[0].n == 7 and rows[0].w == ["abc", "def", "g"]
    assert rows[1].n is None


def test_uuid_is_deterministic(spark):
    row = spark.range(1).select(T.uuid_from(F.lit("a"), F.lit("b")).alias("x"), T.uuid_from(F.lit("a"), F.lit("b")).alias("y")).first()
    assert row.x == row.y and len(row.x) == 36
