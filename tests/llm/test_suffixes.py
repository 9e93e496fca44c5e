import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm.suffix_dedup import LENGTH, _together, merged, repeated_spans, without_spans
from corpusmill.llm.suffixes import common_prefixes, suffix_array


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60))
def test_order_and_prefixes_equal_sorting(symbols):
    s = [*symbols, 0]
    order = suffix_array(np.array(s))
    assert order.tolist() == sorted(range(len(s)), key=lambda i: s[i:])
    shared = common_prefixes(np.array(s), order).tolist()
    for k in range(1, len(s)):
        a, b = s[order[k - 1] :], s[order[k] :]
        assert shared[k] == next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def brute_force(rows):
    """id -> removed spans, from every string's earliest place."""
    first = {}
    for i, data in rows:
        for p in range(len(data) - LENGTH + 1):
            place = first.get(data[p : p + LENGTH])
            if place is None or (i, p) < place:
                first[data[p : p + LENGTH]] = (i, p)
    return [
        merged([(p, p + LENGTH) for p in range(len(data) - LENGTH + 1) if first[data[p : p + LENGTH]] < (i, p)]) for i, data in rows
    ]


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(9)
    words = ["".join(draw.choice("abcdéfg") for _ in range(draw.randint(1, 9))) for _ in range(80)]
    prose = lambda n: " ".join(draw.choice(words) for _ in range(n))
    passages = [prose(n) for n in (12, 25, 40, 80)]
    out = [None, "", "a", "ab" * 40, "ab" * 400, "x" * 99, "x" * 100, "x" * 101, "x" * 500]
    for _ in range(40):
        out.append("".join(prose(draw.randint(0, 30)) + draw.choice(passages)[draw.randint(0, 9) :] for _ in range(draw.randint(1, 3))))
    base = prose(120)
    for _ in range(12):
        at = draw.randrange(len(base))
        out.append(base[:at] + "~" + base[at + 1 :])
    out += out[10:14]
    draw.shuffle(out)
    return out


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 3000}, {"hot": 2}])
def test_spans_equal_brute_force(spark, texts, options):
    rows = [(i - 20, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_force([(i, (t or "").encode()) for i, t in rows])
    got = {r.doc_id: r for r in without_spans(docs, repeated_spans(docs, **options)).collect()}
    for (i, t), spans in zip(rows, want):
        data = (t or "").encode()
        kept = b"".join(data[a:b] for a, b in zip([0, *[e for _, e in spans]], [*[s for s, _ in spans], len(data)]))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, bytes(got[i].kept)) == (len(data), len(data) - len(kept), len(spans), kept)


def test_rows_without_id_and_nothing(spark):
    odd = spark.createDataFrame([(None, "y" * 150), (1, "z" * 120), (1, "z" * 120)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed) for r in without_spans(odd, repeated_spans(odd)).collect())
    assert got == [(0, 0), (1, 119), (1, 119)]
    assert without_spans(odd.limit(0), repeated_spans(odd.limit(0))).count() == 0


def test_short_texts_are_hashed_a_few_at_a_time():
    rows = [(i, bytes([97 + i % 26]) * 3000) for i in range(400)] + [(400, b"x" * 1_000_000), (401, b"end")]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[k : k + 90])], names=["id", "text"]) for k in range(0, len(rows), 90)]
    texts = [b.set_column(1, "text", b.column(1).cast(pa.string())) for b in batches]
    lists = list(_together(texts))
    assert [(i, p) for some in lists for i, _, p in some] == rows
    assert all(sum(len(p) for _, _, p in some[:-1]) < 1 << 18 for some in lists) and len(lists) < 10
