import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import similarity
from corpusmill.operators.similarity import drop_similar, rare_first, similar_earlier, similar_to_kept, token_levels, token_sets
from tests.helpers import numbers, texts


def greedy(values, scopes=None, threshold=0.85):
    """{dropped: kept} by comparing each record with the kept ones in order."""
    kept, out = [], {}
    for k, value in enumerate(values):
        own = set((value or "").split())
        for e, other in kept:
            if scopes and scopes[e] != scopes[k]:
                continue
            if own == other or (own | other and len(own & other) >= threshold * len(own | other) - 1e-9):
                out[k] = e
                break
        else:
            kept.append((k, own))
    return out


def found(df):
    return {r.ord >> 28: r.kept_ord >> 28 for r in df.collect()}


def family(draw, n, size, changes):
    base = [f"f{draw.randrange(10**6)}" for _ in range(size)]
    for _ in range(n):
        row = list(base)
        for _ in range(draw.randrange(changes + 1)):
            row[draw.randrange(size)] = f"c{draw.randrange(10**6)}"
        yield " ".join(row)


@pytest.mark.parametrize("options", [{}, {"worthwhile": 1.1, "hot_key": 2, "longest_key": 3}])
def test_equals_the_greedy_fold(spark, options):
    draw = random.Random(8)
    values = ["", "  ", "a", "a", "b a", "a b a", "a b c d e f g", "a b c d e f g h"]
    for _ in range(12):
        values += family(draw, draw.randrange(2, 14), draw.randrange(6, 40), 4)
    values += [" ".join(draw.sample([f"w{k}" for k in range(14)], draw.randrange(6, 14))) for _ in range(160)]
    draw.shuffle(values)
    records = texts(spark, values).repartition(3)
    want = greedy(values)
    assert len(want) > 40
    assert found(similar_to_kept(records, **options)) == want
    assert numbers(drop_similar(records, **options)) == [k for k in range(len(values)) if k not in want]


def test_first_wins_is_not_carried_over_dropped_records(spark):
    # The second is like the first, the third like the second only.
    words = [f"w{k}" for k in range(24)]
    values = [" ".join(words[:20]), " ".join(words[:22]), " ".join(words[:24]) + " x"]
    assert greedy(values) == {1: 0}
    assert found(similar_to_kept(texts(spark, values))) == {1: 0}


def test_scopes_are_apart(spark):
    values, scopes = ["a b c", "c b a", "a b c", "", ""], ["s", "s", "t", "s", "t"]
    assert found(similar_to_kept(texts(spark, values, scope=scopes), scope=("scope",))) == {1: 0}
    assert found(similar_to_kept(texts(spark, values))) == {1: 0, 2: 0, 4: 3}


def test_no_records(spark):
    assert similar_to_kept(texts(spark, ["x"]).limit(0)).count() == 0


def test_a_common_word_makes_no_large_group(spark):
    # A third of the records hold the same word; it comes last in the order, so no key is made of it.
    draw = random.Random(2)
    values = [" ".join(["the"] * (k % 3 == 0) + [f"w{draw.randrange(400)}" for _ in range(30)]) for k in range(600)]
    sets = token_sets(texts(spark, values))
    ordered = sets.select("ord", rare_first(F.col("tokens"), token_levels(sets)).alias("tokens"))
    last = ordered.select(F.element_at("tokens", -1).alias("t")).groupBy("t").count().orderBy(F.desc("count")).first()
    assert last["count"] == 200
    pairs = similar_earlier(sets.select("ord"), sets.select("ord"), ordered, 0.85)
    assert pairs.count() == 0


def test_tokens_move_for_few_pairs_only(spark, monkeypatch):
    # All sets share some tokens of their prefixes, so nearly all of them meet; two are similar.
    draw = random.Random(3)
    values = [" ".join(f"w{k}" for k in draw.sample(range(300), 120)) for _ in range(60)]
    values.append(values[7] + " more")
    written = {}
    write = similarity.materialize

    def counted(df, name):
        written[name] = write(df, name)
        return written[name]

    monkeypatch.setattr(similarity, "materialize", counted)
    sets = token_sets(texts(spark, values))
    ordered = sets.select("ord", rare_first(F.col("tokens"), token_levels(sets)).alias("tokens"))
    found = similar_earlier(sets.select("ord"), sets.select("ord"), ordered, 0.85, hot_key=1000).collect()
    assert [(r.a >> 28, r.b >> 28) for r in found] == [(60, 7)]
    # Before, all of over a thousand pairs that met had both sets' tokens shuffled.
    assert written["candidates"].count() > 100 and written["near-pairs"].count() < 10


def test_rows_of_keys_grow_with_the_tokens(spark, monkeypatch):
    # Words are few, so every prefix is shared by many sets; keys of several tokens of it were 40 times as many as the tokens.
    draw = random.Random(5)
    vocabulary = [f"w{k}" for k in range(120)]
    values = [" ".join(draw.sample(vocabulary, draw.randrange(50, 80))) for _ in range(120)]
    values += [" ".join(draw.sample(v.split(), len(v.split()) - 2)) for v in values[:20]]
    tokens = sum(len(v.split()) for v in values)
    written = []
    write = similarity.materialize

    def counted(df, name):
        rows = write(df, name)
        written.append(rows.count())
        return rows

    monkeypatch.setattr(similarity, "materialize", counted)
    got = found(similar_to_kept(texts(spark, values), hot_key=8))
    assert got == greedy(values) and len(got) >= 20
    assert sum(written) < 3 * tokens


def test_sets_of_hot_keys_meet_by_further_ways(spark, monkeypatch):
    # One key of two rows is hot, so families use up what they can spare: rounds of larger groups, then prefixes, find their pairs.
    draw = random.Random(7)
    values = [v for _ in range(3) for v in family(draw, 14, draw.randrange(8, 60), 6)]
    draw.shuffle(values)
    monkeypatch.setattr(similarity, "HOTTER", 2)
    met = []
    by_prefixes = similarity.similar_earlier
    monkeypatch.setattr(similarity, "similar_earlier", lambda *a: met.append(1) or by_prefixes(*a))
    assert found(similar_to_kept(texts(spark, values), worthwhile=1.1, hot_key=1)) == greedy(values)
    assert met


@pytest.mark.parametrize("threshold", [0.5, 0.95])
def test_other_thresholds(spark, threshold):
    draw = random.Random(11)
    values = ["", "", "a", "a b"] + [v for _ in range(8) for v in family(draw, 6, draw.randrange(3, 50), 5)]
    values += [" ".join(f"l{k}" for k in range(n)) for n in range(1, 60, 3)]
    draw.shuffle(values)
    assert found(similar_to_kept(texts(spark, values), threshold=threshold)) == greedy(values, threshold=threshold)


def test_tokens_are_written_for_similar_sets_only(spark, monkeypatch):
    draw = random.Random(13)
    values = [" ".join(f"w{draw.randrange(3000)}" for _ in range(40)) for _ in range(80)]
    values += [values[3] + " more", values[3] + " more", values[60] + " other"]
    scopes = ["st"[k % 2] for k in range(80)] + ["t", "s", "s"]
    written = {}
    write = similarity.materialize

    def counted(df, name):
        rows = write(df, name)
        if "tokens" in rows.columns:
            written[name] = max(written.get(name, 0), rows.count())
        return rows

    monkeypatch.setattr(similarity, "materialize", counted)
    assert found(similar_to_kept(texts(spark, values, scope=scopes), scope=("scope",))) == greedy(values, scopes) == {80: 3, 82: 60}
    # Before, two tables of all sets were written.
    assert max(written.values()) < 10
