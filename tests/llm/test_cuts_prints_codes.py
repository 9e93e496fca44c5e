import hashlib
import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusmill.llm.fill_in_middle import SkipList, fill_in_middle, rearranged, restored, unit_widths
from corpusmill.llm.queries import op11_fill_in_middle, op12_winnowing, op13_active_lloyd
from corpusmill.llm.vector_codes import Codebooks, assigned, encoded_vectors, reassigned, with_label_errors
from corpusmill.llm.winnowing import GRAM, WINDOW, edited_and_next, fingerprinted, in_ranges

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


# Fill-in-middle


@pytest.mark.parametrize("text", ["", " ", "a", "a b ", "  x\ty\n", "é ü z 𝄞 w", " ".join("w" * (k % 7 + 1) for k in range(5000)) + "\n\n"])
def test_every_rank_is_found_exactly(text):
    units = UNIT.findall(text)
    widths = unit_widths(text)
    assert widths.tolist() == [len(u) for u in units]
    if units:
        lanes = SkipList(widths)
        assert len(lanes) == len(units)
        before = np.concatenate([[0], np.cumsum(widths)])
        for rank in range(0, len(units) + 1, max(1, len(units) // 300)):
            assert lanes.points_before(rank) == before[rank]
        assert lanes.points_before(len(units)) == len(text)


def plain_form(id, text):
    h = hashlib.sha256(f"42:{id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    units = UNIT.findall(text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_forms_equal_the_plain_ones_and_are_undone(spark):
    draw = random.Random(4)
    texts = [None, "", " \n", "one", "has <S> inside", "ends with <", "S> and <M", "𝄞 é x  y "]
    texts += ["".join(draw.choice("ab é\n\t<>PSM𝄞 ") for _ in range(draw.randrange(1, 200))) for _ in range(300)]
    rows = [(k, t, "x", 1) for k, t in enumerate(texts)] + [(20, texts[20], "y", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, n int").repartition(3)
    out = fill_in_middle(docs).withColumn("again", restored(F.col("output"), F.col("form")))
    got = sorted(map(tuple, out.collect()))
    assert got == sorted((k, *plain_form(k, t or ""), t or "") for k, t, *_ in rows)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_one_long_text_and_no_rows(spark):
    text = "wort \n" * 300_000
    n, form, first, middle, output = rearranged(text, [123_456_789, 250_007, 0, 0])
    assert n == 300_001 and form == "spm" and len(output) == len(text) + 9
    assert output == f"<S>{text[first + middle:]}<P>{text[:first]}<M>{text[first:first + middle]}"
    none = fill_in_middle(spark.createDataFrame([], "doc_id long, text string"))
    assert none.count() == 0
    assert fill_in_middle(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).count() == 1


# Winnowing


def plain_print(text):
    rol = lambda x, b: ((x << b) | (x >> (64 - b))) & (2**64 - 1)
    words = re.findall(r"[^\x20\x09-\x0D]{1,32}", text)
    hashes = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in words]
    if not words:
        return []
    size = min(GRAM, len(words))
    grams = []
    for k in range(len(words) - size + 1):
        value = 0
        for h in hashes[k : k + size]:
            value = rol(value, 1) ^ h
        grams.append(value)
    chosen = []
    for k in range(max(1, len(grams) - WINDOW + 1)):
        at = min(range(k, min(k + WINDOW, len(grams))), key=lambda i: (grams[i] >> 33, -i))
        if at not in chosen:
            chosen.append(at)
    return [(i, grams[i] - (1 << 64 if grams[i] >> 63 else 0)) for i in chosen]


def words_of(draw, n, size=40):
    return " ".join(f"w{draw.randrange(size)}" for _ in range(n))


def test_prints_equal_the_plain_ones(spark):
    draw = random.Random(7)
    texts = [None, "", " \n", "one", "a b c d", "a a a a a a a a a a a a a a a a", "x" * 1000, "two  words\tand\n\nmore é 𝄞"]
    texts += [words_of(draw, draw.randrange(1, 120)) for _ in range(60)] + [words_of(draw, 30_000, 9)]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(3, "one")], "doc_id long, text string").withColumn("hashes", F.lit(1)).withColumn("id", F.lit("x"))
    got = sorted((r.doc_id, list(zip(r.positions, r.hashes)) if r.hashes is not None else []) for r in fingerprinted(docs.withColumn("text", F.coalesce("text", F.lit("")))).collect())
    assert got == sorted([(k, plain_print(t or "")) for k, t in enumerate(texts)] + [(3, plain_print("one"))])


def test_shared_runs_of_the_guaranteed_length_share_a_hash(spark):
    draw = random.Random(9)
    shared = [words_of(draw, GRAM + WINDOW - 1, 10**6) for _ in range(50)]
    texts = [f"{words_of(draw, draw.randrange(60), 10**6)} {s} {words_of(draw, draw.randrange(60), 10**6)}" for s in shared for _ in range(2)]
    rows = {r.doc_id: set(r.hashes) for r in fingerprinted(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(rows[k] & rows[k + 1] for k in range(0, len(texts), 2))


def plain_pairs(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for k, (id, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        yield id, text, text[: len(text) - half] + after[:half], after


@pytest.mark.parametrize("ranges", [1, 3, 16])
def test_every_row_has_its_successor_in_its_range(spark, ranges):
    draw = random.Random(ranges)
    ids = [draw.randrange(-50, 1 << 60) if k % 3 else draw.randrange(10) for k in range(80)] + [None, None, 5, 5, 5]
    df = spark.createDataFrame([(k, i) for i, k in enumerate(ids)], "id long, n long").repartition(4)
    rows = in_ranges(df, "id", ranges).collect()
    assert sorted(r.n for r in rows if not r._after) == list(range(len(ids)))
    key = lambda r: (r.id is not None, r.id or 0)
    order, seen = sorted((r for r in rows if not r._after), key=key), []
    for number in range(max(r._range for r in rows) + 1):
        inside = sorted((r for r in rows if r._range == number), key=lambda r: (r._after, *key(r)))
        assert inside[-1]._after
        for a, b in zip(inside, inside[1:]):
            if not a._after:
                seen.append((a.id, b.id))
    want = [(a.id, b.id) for a, b in zip(order, order[1:] + order[:1])]
    assert sorted(map(repr, seen)) == sorted(map(repr, want))


def test_edited_texts_and_likeness(spark):
    draw = random.Random(11)
    rows = [(k * 7 % 101, words_of(draw, draw.randrange(0, 200), 10**6)) for k in range(60)] + [(3, "é𝄞x"), (1000, None), (1001, "x"), (None, "no id at all")]
    rows += [(14, "same id other text")]
    both = edited_and_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    got = sorted(((r.doc_id, r.text, r.edited, list(zip(r.edited_print.positions, r.edited_print.hashes)), list(r.next_hashes)) for r in both.collect()), key=repr)
    want = sorted(((i, t, e, plain_print(e), [h for _, h in plain_print(a)]) for i, t, e, a in plain_pairs(rows)), key=repr)
    assert got == want


def test_winnowing_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in op12_winnowing(spark, folder).collect()}
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert len(rows) == len(texts)
    for id, text, edited, after in plain_pairs(texts):
        r = rows[id]
        sets = [{h for _, h in plain_print(t)} for t in (text, edited, after)]
        like = [len(sets[0] & s) / len(sets[0] | s) if sets[0] | s else 1.0 for s in sets[1:]]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert math.isclose(r.near_edited, like[0]) and math.isclose(r.near_next, like[1])
        assert r.fingerprint == ",".join(f"{i:x}:{h & (2**64 - 1):x}" for i, h in plain_print(text))
    for a in rows.values():
        assert 0 <= a.near_next <= 1 and 0 <= a.near_edited <= 1


def test_winnowing_of_one_row_and_none(spark):
    one = edited_and_next(spark.createDataFrame([(4, "abcdef")], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.edited) for r in one] == [(4, "abcabc")]
    assert edited_and_next(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_winnowing_runs_no_python(spark):
    plan = op12_winnowing(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") <= 2


# Vector codes


def test_active_entries_give_the_full_scan():
    draw = np.random.default_rng(3)
    for turn in range(20):
        x = draw.integers(-6, 7, (200, 4, 3))
        book = x[:16].transpose(1, 0, 2).copy()
        entry, distance = assigned(x, Codebooks(book, np.zeros((4, 16), dtype=bool)))
        moved = draw.random((4, 16)) < (0.0, 0.1, 0.5, 1.0)[turn % 4]
        later = book + np.where(moved[:, :, None], draw.integers(-2, 3, book.shape), 0)
        moved = (later != book).any(axis=2)
        want = assigned(x, Codebooks(later, moved))
        got = reassigned(x, Codebooks(later, moved), entry, distance)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, v) for i, v, _ in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    width = len(kept[0][1]) // parts
    cut = [[[math.floor(256 * x) for x in v[p * width : (p + 1) * width]] for p in range(parts)] for _, v in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(c, p):
        return min((sum((a - b) ** 2 for a, b in zip(c[p], e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        at = [[nearest(c, p)[1] for p in range(parts)] for c in cut]
        for p in range(parts):
            for k in range(len(books[p])):
                own = [c[p] for c, a in zip(cut, at) if a[p] == k]
                if own:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own)]
    best = [[nearest(c, p) for p in range(parts)] for c in cut]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, [k for _, k in b], sum(d for d, _ in b)) for (i, _), b in zip(kept, best)], digest


def test_codes_equal_the_plain_ones(spark):
    draw = random.Random(5)
    rows = [(draw.randrange(10**9), [draw.choice([draw.uniform(-1, 1), 0.25, -0.5]) for _ in range(32)], draw.choice([1, 2, None])) for _ in range(150)]
    rows += [(1, None, 1), (2, [0.1] * 31 + [None], 1), (3, [0.1] * 31 + [float("nan")], 2), (4, [float("-inf")] * 32, None), (5, [], 1)]
    rows += [(None, [0.5] * 32, None), (rows[0][0], rows[0][1], 2)]
    vectors = spark.createDataFrame([(*r, 7, "x") for r in rows], "vec_id long, embedding array<float>, label int, error long, code string").repartition(3)
    exact = [(i, [float(np.float32(x)) if x is not None else None for x in v] if v is not None else None, lab) for i, v, lab in rows]
    want, digest = plain_codes(exact)
    coded, books = encoded_vectors(vectors)
    got = with_label_errors(coded).collect()
    assert books.digest() == digest
    assert sorted((repr(r.id), list(r.entry), r.error) for r in got) == sorted((repr(i), e, d) for i, e, d in want)
    total = {}
    for r in got:
        total[r.label] = total.get(r.label, 0) + r.error
    assert all(r.label_error == total[r.label] for r in got)


def test_few_vectors_and_none(spark):
    few = spark.createDataFrame([(1, [0.0] * 16, 1), (2, [1.0] * 16, 1), (3, [1.0] * 15, 1), (4, [1.0] * 32, 1)], "vec_id long, embedding array<float>, label int")
    coded, books = encoded_vectors(few)
    assert sorted((r.id, list(r.entry)) for r in coded.collect()) == [(1, [0] * 16), (2, [1] * 16)] and books.entries.shape == (16, 2, 1)
    none, books = encoded_vectors(few.limit(0))
    assert with_label_errors(none).count() == 0 and books is None


def test_queries_have_the_columns_of_the_contract(spark):
    folder = "/root/testdata/sf0.001"
    assert op11_fill_in_middle(spark, folder).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert op13_active_lloyd(spark, folder).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
