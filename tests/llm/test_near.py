import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from corpusmill.llm.line_dedup import SHINGLE, _line_rows, dedup_lines
from corpusmill.llm.links import components, key_groups, neighbouring_keys, only_wanted
from corpusmill.llm.ngram_join import DEPTH, TREES, depth_for, forest_pairs, ngram_classes, one_of_each_class
from corpusmill.llm.words import word_shingles


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def word_set(text):
    words = (text or "").split()
    n = min(5, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def char_set(line):
    line = " ".join(line.lower().split())
    n = min(SHINGLE, len(line))
    return {line[i : i + n] for i in range(len(line) - n + 1)} if line else set()


def groups_of(nodes, close):
    """Least member of the component of every node."""
    of = {n: n for n in nodes}

    def root(n):
        while of[n] != n:
            n = of[n]
        return n

    for a, b in combinations(nodes, 2):
        if close(a, b):
            x, y = root(a), root(b)
            of[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def near_texts(draw, words, count, length):
    base = [draw.choice(words) for _ in range(length)]
    for _ in range(count):
        text = list(base)
        text[draw.randrange(length)] = draw.choice(words)
        yield " ".join(text)


@pytest.fixture(scope="module")
def documents(spark):
    draw = random.Random(11)
    words = ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 9))) for _ in range(400)]
    texts = [None, "", " \n ", "one two", "one two", "one  two three four", "one two three four"]
    for length, count in ((60, 12), (200, 9), (25, 5), (90, 1)):
        texts += near_texts(draw, words, count, length)
    passage = " ".join(draw.choice(words) for _ in range(40))
    texts += [passage + " " + " ".join(draw.choice(words) for _ in range(draw.randint(10, 80))) for _ in range(15)]
    texts += texts[8:12] * 3
    draw.shuffle(texts)
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("node", F.lit("clash"))


def test_classes_and_links_equal_brute_force(documents):
    sets = {r.doc_id: word_set(r.text) for r in documents.collect()}
    close = lambda a, b: jaccard(sets[a], sets[b]) >= 0.8
    classes = groups_of(sets, close)
    for block in (128, 4):
        got = {r.doc_id: r for r in ngram_classes(documents, block=block).collect()}
        assert {i: r.class_id for i, r in got.items()} == classes
        for i, r in got.items():
            copies = [k for k in sets if sets[i] and sets[k] == sets[i]] or [i]
            others = {frozenset(sets[k]) for k in sets if close(i, k)} - {frozenset(sets[i])}
            assert (r.copy_of, r.n_links) == (min(copies), len(others))
    kept = one_of_each_class(documents)
    assert kept.columns == documents.columns and {r.doc_id for r in kept.collect()} == set(classes.values())


def test_join_of_nothing_and_of_rows_without_id(spark, documents):
    assert ngram_classes(documents.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, None)], "doc_id long, text string")
    rows = sorted(map(tuple, ngram_classes(odd).collect()), key=str)
    assert rows == [(1, 1, 1, 0), (1, 1, 1, 0), (2, 2, 2, 0), (None, None, None, None)]
    assert one_of_each_class(odd).count() == 4


def test_prefixes_are_shortened_until_the_recall_is_met():
    for similarity in (0.7, 0.8, 0.9):
        depth = depth_for(similarity)
        assert 1 - (1 - similarity**depth) ** 20 >= 0.999
        assert 1 - (1 - similarity ** (depth + 1)) ** 20 < 0.999 or depth == 12


def test_trie_nodes_are_met_at_every_depth_and_over_borders(spark):
    draw = random.Random(5)
    base = bytes(draw.randrange(256) for _ in range(TREES * DEPTH))
    labels = {}
    for node in draw.sample(range(1000), 120):
        label = bytearray(base if node % 3 else [draw.randrange(256) for _ in range(TREES * DEPTH)])
        for t in range(TREES):
            for k in range(draw.randint(2, DEPTH), DEPTH):
                label[t * DEPTH + k] = draw.randrange(4)
        labels[node] = bytes(label)
    floor = 5
    table = spark.createDataFrame(list(labels.items()), "node long, labels binary")
    wanted = set()
    for t in range(TREES):
        for depth in range(floor, DEPTH + 1):
            runs = {}
            for node, label in labels.items():
                runs.setdefault(label[t * DEPTH : t * DEPTH + depth], []).append(node)
            wanted |= {(n, min(run)) for run in runs.values() for n in run if n > min(run)}
    assert {tuple(r) for r in forest_pairs(table, floor).collect()} == wanted
    # Cut by borders, what shares a node is still joined up.
    joined = components(spark.createDataFrame(sorted(wanted), "a long, b long")).collect()
    cut = components(forest_pairs(table, floor, rows_of_a_task=100)).collect()
    assert {tuple(r) for r in cut} == {tuple(r) for r in joined}
    assert forest_pairs(table.limit(0), floor).count() == 0


def test_recall_of_the_forest(spark):
    draw = random.Random(7)
    words = ["".join(draw.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    shared = [draw.choice(words) for _ in range(60)]
    texts, pairs = [], []
    for k in range(150):
        base = shared + [draw.choice(words) for _ in range(150)]
        other = base[:-22] + [draw.choice(words) for _ in range(22)]
        pairs.append((2 * k, 2 * k + 1))
        texts += [" ".join(base), " ".join(other)]
    close = [(a, b) for a, b in pairs if jaccard(word_set(texts[a]), word_set(texts[b])) >= 0.8]
    assert len(close) > 100
    got = {r.doc_id: r.class_id for r in ngram_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert sum(got[a] == got[b] for a, b in close) >= 0.95 * len(close)


def test_only_wanted_texts(spark):
    texts = spark.range(2000).select(F.col("id").alias("node"), F.col("id").cast("string").alias("text"))
    wanted = spark.range(0, 5000, 7).select(F.col("id").alias("node"))
    assert sorted(r.node for r in only_wanted(texts, wanted).collect()) == list(range(0, 2000, 7))
    assert only_wanted(texts, wanted.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(200) if i != 77] + [(500, 3), (3, 500), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 if i <= 77 else 78 for i in range(201)}, 500: 0}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lines_equal_brute_force(spark):
    draw = random.Random(4)
    words = ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 9))) for _ in range(300)]
    pool = ["All rights reserved.", "  all  RIGHTS reserved.", "x", "}", "", "   "]
    for length, count in ((40, 14), (25, 8), (15, 6)):
        pool += near_texts(draw, words, count, length)
    pool += [" ".join(draw.choice(words) for _ in range(20)) for _ in range(10)]
    texts = [None, "", "\n\n"] + ["\n".join(draw.choice(pool) for _ in range(draw.randint(1, 9))) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, "s", 7) for i, t in enumerate(texts)], "doc_id long, text string, line string, n int")
    lines = {(i, k): char_set(line) for i, t in enumerate(texts) for k, line in enumerate((t or "").split("\n")) if line.strip()}
    same = {}
    for place, chars in sorted(lines.items()):
        same.setdefault(frozenset(chars), place)
    firsts = groups_of(sorted(same.values()), lambda a, b: jaccard(lines[a], lines[b]) >= 0.8)
    stays = {firsts[same[frozenset(c)]] for c in lines.values()}
    got = {r.doc_id: r for r in dedup_lines(docs).collect()}
    for i, t in enumerate(texts):
        rows = [] if t is None else t.split("\n")
        kept = [line for k, line in enumerate(rows) if (i, k) in stays or not line.strip()]
        assert (got[i].text, got[i]._n_lines, got[i]._n_gone) == (None if t is None else "\n".join(kept), len(rows), len(rows) - len(kept))
    assert dedup_lines(docs).columns[:4] == docs.columns
    assert dedup_lines(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "same old line"), (2**62, "same old line"), (-(2**62), "same old line")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in dedup_lines(odd).collect()) == [(-(2**62), "same old line"), (0, "same old line"), (2**62, "")]


def test_near_lines_meet_in_buckets_of_unlike_lines(spark, monkeypatch):
    # With one key, lines whose key comes from the phrase have no other to meet by.
    monkeypatch.setattr("corpusmill.llm.line_dedup.BANDS", 1)
    draw = random.Random(47)
    letters = lambda n: "".join(draw.choice("abcdefghij ") for _ in range(n))
    phrase, lines = letters(60), []
    for k in range(300):
        tail = letters(40)
        lines.append(f"{phrase}{k:03d}{tail}")
        if k % 2:
            lines.append(f"{phrase}{k:03d}{tail[:-4]}{letters(4)}")
    draw.shuffle(lines)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    keys = {r.id: {r.k0} for r in _line_rows(docs, "doc_id", "text", 1).collect()}
    sets = {i: char_set(line) for i, line in enumerate(lines)}
    of = groups_of(sorted(sets), lambda a, b: not keys[a].isdisjoint(keys[b]) and jaccard(sets[a], sets[b]) >= 0.8)
    assert len(set(of.values())) < len(lines) - 40
    assert {r.doc_id for r in dedup_lines(docs).collect() if not r._n_gone} == set(of.values())


def test_columns_of_any_name_stay(spark):
    rows = [(1, "one line of some length here\nother", "i", 5, "l"), (2, "one line of some length here", "j", 6, "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string, _n_lines int, _lines string")
    out = dedup_lines(docs, n_lines="before", n_gone="taken")
    assert out.columns == [*docs.columns, "before", "taken"]
    assert sorted(map(tuple, out.collect())) == [(1, rows[0][1], "i", 5, "l", 2, 0), (2, "", "j", 6, "m", 1, 1)]
    with pytest.raises(ValueError):
        dedup_lines(docs)


@pytest.mark.parametrize("rows_of_a_task", [4, 1 << 20])
def test_keys_of_several_nodes_stay_over_borders(spark, rows_of_a_task):
    rows = [(node, 7) for node in range(40)] + [(node, 100 + node) for node in range(60)] + [(node, 200 + node // 2) for node in range(20)]
    members = spark.createDataFrame(rows, "node long, key long")
    kept = neighbouring_keys(members, len(rows), rows_of_a_task)
    found = {tuple(r) for r in kept.select("node", "key").collect()}
    assert found <= set(rows) and kept.count() == len(found)
    assert {r for r in rows if r[1] == 7 or r[1] >= 200} <= found
    # Beyond those only the rows of the outermost keys of a task.
    tasks = -(-len(rows) // rows_of_a_task)
    assert len(found) <= 60 + 2 * tasks
    assert neighbouring_keys(members.limit(0), 0).count() == 0


def test_groups_decided_by_their_least_node_equal_tiles(spark):
    # Sets of numbers as texts: 0 and 1 loose, 10 to 12 all similar to 10, 20 to 22 a chain.
    base = [f"w{k}" for k in range(20)]
    texts = {0: base, 1: base[:12] + [f"x{k}" for k in range(8)]}
    texts |= {10: [f"a{k}" for k in range(20)], 11: [f"a{k}" for k in range(19)], 12: [f"a{k}" for k in range(18)]}
    texts |= {20: [f"b{k}" for k in range(20)], 21: [f"b{k}" for k in range(2, 22)], 22: [f"b{k}" for k in range(4, 24)]}
    rows = spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()], "node long, text string")
    members = spark.createDataFrame([(node, node // 10) for node in texts], "node long, key long")
    groups = {r.node: r.component for r in key_groups(members, rows, lambda t: word_shingles(t, 1), 0.8).collect()}
    assert groups == {10: 10, 11: 10, 12: 10, 20: 20, 21: 20, 22: 20}
