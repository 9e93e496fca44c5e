import re
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from corpusmill.llm.decontamination import PassageIndex
from corpusmill.llm.quality import RULES, judged, keep_quality, order_rules, quality_judgements
from tests.llm.test_near import char_set, groups_of, jaccard, word_set

FOLDER = "/root/testdata/sf0.001"


def base_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines = [s for s in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def kept_by_rules(text):
    n, chars, symbols, dup, covered = base_counts(text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [s for s in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
    return not (
        n < 20 or 100 * covered > 30 * n or 10 * symbols > 3 * n or chars < 2 * n or chars > 14 * n
        or 10 * sum(a == b for a, b in zip(words, words[1:])) > 3 * n
        or 2 * sum(c.isupper() for c in text) > chars or sum(c in "!?" for c in text) > n
        or 2 * sum(c in "0123456789" for c in text) > chars or 10 * dup > 7 * len(lines)
        or 10 * sum(s.rstrip(" ").endswith(("...", "…")) for s in lines) > 3 * len(lines)
        or 10 * sum(bool(re.match(r"\s*[-•*]\s", s)) for s in lines) > 9 * len(lines)
    )


ODD = [
    None, "", " \n\t", "a b c d e f g h " * 2, "a b c d e f g h i " * 3, "x\n\nx\n x\nx", "w" * 100_000, "w " * 30_000,
    "one two three four five six seven eight nine ten " * 2 + "eleven twelve thirteen fourteen",
    " ".join(f"word{k}" for k in range(40)), " ".join(f"{k}" * 5 for k in range(40)), "\n".join(f"- item {k} of it" for k in range(30)),
    "\n".join(f"so it goes{k}..." for k in range(30)), " ".join(f"HELLO{'ABCDEFGHIJ'[k % 10]}" for k in range(30)),
]


def test_judgements_equal_the_rules_as_worded(spark):
    texts = [*ODD, *ODD[:3], *[r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]]
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, kept string")
    rows = {r.doc_id: r for r in quality_judgements(docs).collect()}
    for k, t in enumerate(texts):
        r = rows[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_counts(t), t
        assert r.kept == kept_by_rules(t), (t, r.failed_rule)
    kept = keep_quality(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, r in rows.items() if r.kept}
    assert quality_judgements(docs.limit(0)).count() == 0


def test_order_of_rules_comes_from_the_sample_and_changes_no_verdict(spark):
    shouting = " ".join(f"LOUD{'ABCDEF'[k % 6]}{'GHIJK'[k % 5]}ER" for k in range(30))
    docs = spark.createDataFrame([(k, shouting if k % 2 else " ".join(f"plain{j}" for j in range(k, k + 30))) for k in range(40)], "doc_id long, text string")
    rules = order_rules(docs)
    assert rules[0].name == "capitals" and sorted(r.name for r in rules) == sorted(r.name for r in RULES)
    verdicts = [docs.select(judged(F.col("text"), order)["kept"]).collect() for order in (rules, RULES, tuple(reversed(RULES)))]
    assert verdicts[0] == verdicts[1] == verdicts[2]


@pytest.fixture(scope="module")
def stages(spark):
    """The rows between the stages, on the smallest tables."""
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        out.append(docs.collect())
        docs = spark.createDataFrame(stage(spark, docs, FOLDER).collect(), stage(spark, docs, FOLDER).schema)
    return [*out, docs.collect()]


def test_stages_equal_brute_force(spark, stages):
    start, good, lines, single, clean, pieces = stages
    by_id = lambda rows: {r.doc_id: tuple(r) for r in rows}
    assert by_id(good) == {r.doc_id: tuple(r) for r in start if kept_by_rules(r.text)}

    sets = {(r.doc_id, k): char_set(s) for r in good for k, s in enumerate(r.text.split("\n")) if s.strip()}
    same = {}
    for place in sorted(sets):
        same.setdefault(frozenset(sets[place]), place)
    firsts = groups_of(sorted(same.values()), lambda a, b: jaccard(sets[a], sets[b]) >= 0.8)
    stays = {firsts[same[frozenset(s)]] for s in sets.values()}
    want = {}
    for r in good:
        rows = r.text.split("\n")
        left = "\n".join(s for k, s in enumerate(rows) if (r.doc_id, k) in stays or not s.strip())
        if left == r.text or left.strip():
            want[r.doc_id] = left
    assert {r.doc_id: r.text for r in lines} == want and all(r.n_chars == len(r.text) for r in lines)

    words = {r.doc_id: word_set(r.text) for r in lines}
    classes = groups_of(words, lambda a, b: jaccard(words[a], words[b]) >= 0.8)
    assert {r.doc_id for r in single} == set(classes.values())

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    found = PassageIndex(items).find([r.text for r in single])
    exact = [{i for i, t in items if " ".join(t.lower().split()) in " ".join(r.text.lower().split())} for r in single]
    assert all(e <= set(f) for e, f in zip(exact, found))
    assert {r.doc_id for r in clean} == {r.doc_id for r, f in zip(single, found) if not f}

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = {r.doc_id: len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in clean}
    assert Counter({d: n for d, n in tokens.items()}) == sum((Counter({p.doc_id: p.length}) for p in pieces), Counter())


def test_run_gives_what_the_stages_give(spark, stages):
    rows = corpus_pipeline.run(spark, FOLDER)
    key = lambda r: (r.doc_id, r.start)
    got, want = sorted(rows.collect(), key=key), sorted(stages[-1], key=key)
    assert {r.doc_id for r in got} == {r.doc_id for r in want}
    assert sum(r.length for r in got) == sum(r.length for r in want)


def test_pipeline_of_nothing(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert docs.count() == 0
