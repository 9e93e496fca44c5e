"""Quality rules as a short-circuit cascade, in built-in functions only.

Every text gets a few base counts.  A text that passes the base test then meets
the rules one after the other and stops at the first that it fails.  The order
comes from a sample: each rule's work is added up there, and so is what it
rejects among the texts that the rules before it let pass; the rule with the most
rejections for its work goes next.  The verdict is the same in any order.

Defined cases: a null or empty text has zero counts and fails the base test; other
columns are ignored; repeated rows are judged each by itself; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import let

# What separates words, what counts as a symbol, and the base test.
SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"
VISIBLE = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]+"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

# Texts that are looked at for the order of the rules, and how much of each.
SAMPLE_ROWS = 500
SAMPLE_CHARS = 10_000


@dataclass(frozen=True)
class Parts:
    """A text and what was made of it, all computed once."""

    text: Column
    words: Column
    lines: Column
    base: Column

    def __getitem__(self, name: str) -> Column:
        return self.base[name]


@dataclass(frozen=True)
class Rule:
    """``fails`` of a text, and the characters, words or lines it has to visit for that."""

    name: str
    fails: Callable[[Parts], Column]
    work: Callable[[Parts], Column]


def _without(text: Column, pattern: str) -> Column:
    """Number of characters of ``text`` that match the pattern."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _share(lines: Column, pattern: str) -> Column:
    return F.size(F.filter(lines, lambda line: F.rlike(line, F.lit(pattern))))


def _breaks_off(line: Column) -> Column:
    end = F.rtrim(line)
    return F.endswith(end, F.lit("...")) | F.endswith(end, F.lit("…"))


def _nothing(_: Parts) -> Column:
    return F.lit(1)


def _characters(p: Parts) -> Column:
    return F.length(p.text)


RULES = (
    # More than three symbols for ten words.
    Rule("symbols", lambda p: 10 * p["n_symbols"] > 3 * p["n_words"], _nothing),
    # Words of under two or over fourteen characters on average.
    Rule(
        "word_length",
        lambda p: (p["word_chars"] < 2 * p["n_words"]) | (p["word_chars"] > 14 * p["n_words"]),
        _nothing,
    ),
    # More than three in ten words equal the word before them.
    Rule(
        "stutter",
        lambda p: 10 * F.size(F.filter(p.words, lambda w, i: w == F.get(p.words, i - 1))) > 3 * p["n_words"],
        lambda p: 2 * F.size(p.words),
    ),
    # More than half of the visible characters are capitals.
    Rule("capitals", lambda p: 2 * _without(p.text, r"\p{Lu}+") > p["word_chars"], _characters),
    # More exclamation and question marks than words.
    Rule("exclamations", lambda p: _without(p.text, "[!?]+") > p["n_words"], _characters),
    # More than half of the visible characters are digits.
    Rule("digits", lambda p: 2 * _without(p.text, "[0-9]+") > p["word_chars"], _characters),
    # More than seven in ten lines repeat an earlier one.
    Rule("repeated_lines", lambda p: 10 * p["n_dup_lines"] > 7 * F.size(p.lines), _nothing),
    # More than three in ten lines break off with dots; more than nine in ten are list items.
    Rule("ellipses", lambda p: 10 * F.size(F.filter(p.lines, _breaks_off)) > 3 * F.size(p.lines), lambda p: 5 * F.size(p.lines)),
    Rule("bullets", lambda p: 10 * _share(p.lines, r"^\s*[-•*]\s") > 9 * F.size(p.lines), lambda p: 2 * F.size(p.lines)),
)


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window of eight words found twice or more in the text.

    A window is known by a 64-bit hash of its words' hashes.  If no hash comes
    twice, as in most texts, that is all; else the windows are sorted by hash,
    those next to an equal one are put back in order, and the gaps between
    their starts, eight at most each, add up to the words that they cover.
    """

    def joined(keys: Column, step: int) -> Column:
        return F.zip_with(keys, F.slice(keys, F.lit(1 + step), F.size(keys)), lambda a, b: F.xxhash64(a, b))

    def windows(hashes: Column) -> Column:
        eights = let(joined(hashes, 1), lambda twos: let(joined(twos, 2), lambda fours: joined(fours, 4)))
        return F.slice(eights, F.lit(1), F.size(hashes) - (WINDOW - 1))

    def repeated(keys: Column) -> Column:
        pairs = F.sort_array(F.transform(keys, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(
            pairs,
            lambda s: F.sort_array(
                F.transform(
                    F.filter(s, lambda v, k: (v["h"] == F.get(s, k - 1)["h"]) | (v["h"] == F.get(s, k + 1)["h"])),
                    lambda v: v["i"],
                )
            ),
        )

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda at, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - at, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    def count(keys: Column) -> Column:
        same = F.size(F.array_distinct(keys)) == F.size(keys)
        return F.when(same, F.lit(0)).otherwise(let(repeated(keys), covered))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(let(hashed, lambda hashes: let(windows(hashes), count)))


def _base(text: Column, words: Column, lines: Column) -> Column:
    joined = F.array_join(words, "")
    long = lambda column: column.cast("long")
    return F.struct(
        long(F.size(words)).alias("n_words"),
        long(F.length(joined)).alias("word_chars"),
        long(_without(text, SYMBOLS)).alias("n_symbols"),
        long(F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
        long(_repeat_words(words)).alias("n_repeat_words"),
    )


def _of_parts(text: Column, body: Callable[[Parts], Column]) -> Column:
    """``body`` of a text's parts, each computed once."""
    words = lambda t: let(F.btrim(t, F.lit(BLANKS)), lambda s: F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, SPACE)))
    lines = lambda t: F.filter(F.split(t, "\n"), lambda line: F.rlike(line, F.lit(VISIBLE)))
    return let(
        F.coalesce(text, F.lit("")),
        lambda t: let(
            F.struct(words(t).alias("words"), lines(t).alias("lines")),
            lambda s: let(
                _base(t, s["words"], s["lines"]), lambda base: body(Parts(t, s["words"], s["lines"], base))
            ),
        ),
    )


def _base_failed(p: Parts) -> Column:
    return (p["n_words"] < LEAST_WORDS) | (100 * p["n_repeat_words"] > MOST_REPEATED * p["n_words"])


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    """The rules by rejections for their work, as a sample of the texts shows them.

    The sample is the first ``sample_rows`` texts that Spark finds, so few files are
    read for it.  One row for each combination of failed rules comes to the driver.
    """

    def looked_at(p: Parts) -> Column:
        failed = [F.when(rule.fails(p), 1 << k).otherwise(0) for k, rule in enumerate(rules)]
        return F.struct(
            _base_failed(p).alias("out"),
            sum(failed, F.lit(0)).alias("failed"),
            *[rule.work(p).cast("double").alias(f"work{k}") for k, rule in enumerate(rules)],
        )

    sample = docs.select(F.left(F.col(text), F.lit(SAMPLE_CHARS)).alias("t")).take(sample_rows)
    seen = docs.sparkSession.createDataFrame(sample, "t string").select(_of_parts(F.col("t"), looked_at).alias("s"))
    groups = (
        seen.where("NOT s.out")
        .groupBy("s.failed")
        .agg(F.count("*").alias("n"), *[F.sum(f"s.work{k}").alias(f"work{k}") for k in range(len(rules))])
        .collect()
    )
    ordered: list[int] = []
    while len(ordered) < len(rules):
        open_ = [g for g in groups if not any(g.failed >> k & 1 for k in ordered)]

        def worth(k: int) -> float:
            rejected = sum(g.n for g in open_ if g.failed >> k & 1)
            return rejected / max(1.0, sum(g[f"work{k}"] for g in open_))

        rest = [k for k in range(len(rules)) if k not in ordered]
        work = lambda k: sum(g[f"work{k}"] for g in groups)
        ordered.append(max(rest, key=lambda k: (worth(k), -work(k), -k)))
    return tuple(rules[k] for k in ordered)


def judged(text: Column, rules: tuple[Rule, ...]) -> Column:
    """STRUCT of the base counts, ``base_failed``, ``failed_rule`` (null if none) and ``kept``.

    CASE evaluates a rule only when all before it let the text pass.
    """

    def verdict(p: Parts) -> Column:
        case = F.when(_base_failed(p), F.lit("base"))
        for rule in rules:
            case = case.when(rule.fails(p), F.lit(rule.name))
        return let(
            F.struct(case.alias("rule")),
            lambda v: F.struct(
                *[p[name].alias(name) for name in BASE],
                _base_failed(p).alias("base_failed"),
                v["rule"].alias("failed_rule"),
                v["rule"].isNull().alias("kept"),
            ),
        )

    return _of_parts(text, verdict)


def quality_judgements(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(*keep, base counts, base_failed, failed_rule, kept), one row per input row.  No shuffle."""
    rules = order_rules(docs, text=text, sample_rows=sample_rows)
    return docs.select(*keep, judged(F.col(text), rules).alias("_q")).select(*keep, "_q.*")


def keep_quality(docs: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    return docs.where(judged(F.col(text), order_rules(docs, text=text, sample_rows=sample_rows))["kept"])
