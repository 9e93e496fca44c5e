"""Near duplicates by exact Jaccard similarity of token sets; the first record in input order wins.

Candidates come from parts.  Sets of some size are dealt into parts by their tokens' hashes, ``SPARE`` more parts than
similar sets may differ in tokens, and every part that holds tokens is a key.  Two similar sets have more equal parts
than one of them has spare ones; a set's parts without tokens and keys that too many sets have use up its spare ones.  Only
where two sets have none left do they meet by prefixes (:func:`similar_earlier`).  A key stands for
several tokens, so few sets share one by chance, however many there are, and a set has a key for some three of its tokens.

Prefixes: all tokens have one global order, rare ones first.  Two sets
with n and m tokens and a similarity of ``t`` share at least one token among the first
``n - ceil(t n) + 1`` and ``m - ceil(t m) + 1``, and in general their first k shared tokens lie among the first
``... + k``.  So sets are keyed by one token of that prefix, and where too many sets have a
key, by a further token behind it, until the groups are small.  Two sets meet only if what lies behind
their key in the shorter rest would still do.

Those that met are held against each other by their sketches,
whose different bits are no more than the tokens that one of them has alone; only pairs that pass move their tokens.
Tokens are not written for all records; those of such pairs are made from their texts again.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.minhash import THRESHOLD
from corpusmill.functions.text import words
from corpusmill.session import materialize, spread

# Cells of the sketch; sets of a key beyond which keys get longer; tokens of the longest key.
CELLS = 1 << 18
HOT_KEY = 64
LONGEST_KEY = 4

# 64-bit words of a set's sketch where it is made from ordered tokens.
SKETCH_WORDS = 8

# Share of key memberships that a round of leads has to settle for another round to follow, and share of all
# memberships up to which what is left goes without further rounds, each of which reads the texts.
WORTHWHILE = 0.25
FEW = 1 / 16

# One more spare part for so many tokens in which sets may differ; how much larger the largest sets of a class of sizes are.
SPARE = 8
CLASS_RATIO = 1.4

# Rounds in which sets with too many hot keys meet among themselves, and how many more rows a key may have in each.
HOT_ROUNDS, HOTTER = 2, 8

# Keys that are shuffled at a time, and portions at most; tokens dealt at a time.
PORTION = 1 << 22
PORTIONS = 8
_STEP = 1 << 19

# Rows of 64 bits that tell which records are wanted.
WANTED_WORDS = 1 << 18

_DRAWN = "ord bigint, size bigint, sum bigint, mixed bigint, sketch array<bigint>, info bigint, keys array<bigint>, next_info bigint, next_keys array<bigint>"


def token_sets(records: DataFrame, scope: Sequence[str] = (), text: str = "text") -> DataFrame:
    """(ord, tokens): hashes of the distinct tokens; tokens of different scopes differ."""
    scoped = F.xxhash64(*[F.col(c).cast("string") for c in scope]) if scope else F.lit(42).cast("long")
    return records.select("ord", F.transform(F.array_distinct(words(F.coalesce(F.col(text), F.lit("")))), lambda w: F.xxhash64(w, scoped)).alias("tokens"), scoped.alias("scope"))


def token_levels(sets: DataFrame, cells: int = CELLS) -> bytes:
    """For each cell of token hashes a byte that grows with the logarithm of how often its tokens occur."""
    cell = F.pmod(F.col("token"), F.lit(cells))
    counts = sets.select(F.explode("tokens").alias("token")).groupBy(cell.alias("cell")).count()
    levels = bytearray(cells)
    for at, n in counts.collect():
        levels[at] = min(255, round(8 * math.log2(1 + n)))
    return bytes(levels)


def rare_first(tokens: Column, levels: bytes) -> Column:
    """The tokens in the global order."""
    level = lambda t: F.substring(F.lit(levels), F.pmod(t, F.lit(len(levels))).cast("int") + 1, F.lit(1))
    ordered = F.array_sort(F.transform(tokens, lambda t: F.struct(level(t).alias("level"), t.alias("token"))))
    return F.transform(ordered, lambda t: t["token"])


def _needed(size: Column, threshold: float) -> Column:
    return F.ceil(size * threshold - 1e-9)


def _longer_keys(rows: DataFrame, sets: DataFrame, length: int, threshold: float) -> DataFrame:
    """Rows (ord, key, at) with every further token of the prefix for keys of ``length`` put behind their key;
    ``at`` is the place of a key's last token."""
    places = F.size("tokens") - _needed(F.size("tokens"), threshold) + length
    further = F.posexplode(F.slice("tokens", F.col("at") + 2, F.greatest(places - F.col("at") - 1, F.lit(0)).cast("int")))
    spread = rows.join(sets.select("ord", "tokens"), "ord").select("ord", "key", "at", F.size("tokens").alias("size"), further.alias("k", "token"))
    return spread.select("ord", "size", F.xxhash64("key", "token").alias("key"), (F.col("at") + 1 + F.col("k")).alias("at"))


def _start(ords: DataFrame) -> DataFrame:
    return ords.select("ord", F.lit(0).cast("long").alias("key"), F.lit(-1).alias("at"))


def sketch(tokens: Column) -> Column:
    """Bits that are set where an odd number of tokens fall."""

    def word(k: int) -> Column:
        bit = lambda t: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(t, 55).bitwiseAND(63).cast("int"))
        own = F.filter(tokens, lambda t: F.shiftrightunsigned(t, 61) == k)
        return F.aggregate(own, F.lit(0).cast("long"), lambda bits, t: bits.bitwiseXOR(bit(t)))

    return F.array(*[word(k) for k in range(SKETCH_WORDS)])


def _folded(sketch: Column, count: Column) -> Column:
    """The sketch with ``count`` words, fewer by a power of two or as many."""
    word = lambda i: F.aggregate(F.sequence(i, F.size(sketch) - 1, count), F.lit(0).cast("long"), lambda bits, j: bits.bitwiseXOR(F.get(sketch, j)))
    return F.when(F.size(sketch) == count, sketch).otherwise(F.transform(F.sequence(F.lit(0), count - 1), word))


def _near(pairs: DataFrame, drawn: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sketches, in ``drawn`` (ord, size, sketch), differ in no more bits than similar sets may differ in tokens."""
    both = pairs
    for side in ("a", "b"):
        both = both.join(drawn.select(F.col("ord").alias(side), F.col("size").alias(f"_n{side}"), F.col("sketch").alias(f"_s{side}")), side)
    count = F.least(F.size("_sa"), F.size("_sb"))
    different = F.zip_with(_folded(F.col("_sa"), count), _folded(F.col("_sb"), count), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    alone = (F.col("_na") + F.col("_nb")) * ((1 - threshold) / (1 + threshold))
    return both.where(F.aggregate(different, F.lit(0), lambda n, x: n + x) <= alone + 1e-6).select("a", "b")


def _similar(pairs: DataFrame, drawn: DataFrame, tokens_of: Callable[[DataFrame], DataFrame], threshold: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar; ``tokens_of`` gives (ord, tokens) for those in a table (ord)."""
    near = materialize(_near(pairs, drawn, threshold), "near-pairs")
    sets = tokens_of(near.select(F.explode(F.array("a", "b")).alias("ord")))
    both = near.join(sets.select(F.col("ord").alias("a"), F.col("tokens").alias("x")), "a").join(
        sets.select(F.col("ord").alias("b"), F.col("tokens").alias("y")), "b"
    )
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared >= threshold * (F.size("x") + F.size("y") - shared) - 1e-9).select("a", "b")


def _sizes_fit(a: Column, b: Column, threshold: float) -> Column:
    return F.least(a, b) >= threshold * F.greatest(a, b) - 1e-9


def _rest_fits(m: Column, n: Column, at: Column, bt: Column, length: int, threshold: float) -> Column:
    """Whether sets of m and n tokens may be similar that share ``length`` tokens up to the places ``at`` and ``bt``."""
    return length + F.least(m - at, n - bt) - 1 >= (m + n) * (threshold / (1 + threshold)) - 1e-6


def similar_earlier(later: DataFrame, earlier: DataFrame, sets: DataFrame, threshold: float, hot_key: int = HOT_KEY, longest_key: int = LONGEST_KEY) -> DataFrame:
    """All similar pairs (a, b) with a of ``later``, b of ``earlier`` and b < a.

    Keys that more than ``hot_key`` rows of ``earlier`` have are made longer rather than met.
    """
    left, right, found = _start(later), _start(earlier), None
    for length in range(1, longest_key + 1):
        left = materialize(_longer_keys(left, sets, length, threshold), "keys-later")
        right = materialize(_longer_keys(right, sets, length, threshold), "keys-earlier")
        counts = right.groupBy("key").agg(F.count("*").alias("n"))
        hot = materialize(counts.where(F.col("n") > hot_key).select("key").join(left.select("key").distinct(), "key", "left_semi"), "hot-keys")
        last = length == longest_key or hot.isEmpty()
        met = right if last else right.join(hot, "key", "left_anti")
        pairs = left.select(F.col("ord").alias("a"), "key", F.col("size").alias("m"), "at").join(
            met.select(F.col("ord").alias("b"), "key", F.col("size").alias("n"), F.col("at").alias("bt")), "key"
        )
        fit = _sizes_fit(F.col("m"), F.col("n"), threshold) & _rest_fits(F.col("m"), F.col("n"), F.col("at"), F.col("bt"), length, threshold)
        pairs = pairs.where((F.col("b") < F.col("a")) & fit).select("a", "b")
        found = pairs if found is None else found.unionByName(pairs)
        if last:
            break
        left, right = left.join(hot, "key", "left_semi"), right.join(hot, "key", "left_semi")
    drawn = sets.select("ord", F.size("tokens").alias("size"), F.col("sketch") if "sketch" in sets.columns else sketch(F.col("tokens")).alias("sketch"))
    return _similar(materialize(found.distinct(), "candidates"), drawn, lambda near: sets, threshold)


def _sizes(threshold: float, most: int) -> np.ndarray:
    """The largest size of every class of sizes, up to one that ``most`` and what is similar to it fall in."""
    ends, ratio = [0], max(CLASS_RATIO, 1 / threshold)
    while ends[-1] * threshold <= most:
        ends.append(int(ends[-1] * ratio) + 1)
    return np.array(ends)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sketched(tokens: np.ndarray, row: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, where each set's begin): bits that are set where an odd number of tokens fall, two to four for a token."""
    cells = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(2 * sizes, 1))).astype("int64"))
    starts = np.concatenate([[0], np.cumsum(cells)])
    at = starts[row] + (tokens & (cells[row] - 1).astype("uint64")).astype("int64")
    odd = (np.bincount(at, minlength=starts[-1]) & 1).astype("uint8")
    return np.packbits(odd, bitorder="little").view("<i8"), starts // 64


def _dealt(tokens: np.ndarray, row: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(info, keys, where each set's begin) of sets that are dealt like sets of up to ``ends`` tokens.

    ``info`` holds size, ``which`` and the spare parts left.  Who has more parts without tokens than spare ones has the
    tokens of a prefix, in the order of their hashes, as further keys, and none to spare.
    """
    sizes = np.diff(starts)
    differ = np.floor(2 * ends * ((1 - threshold) / (1 + threshold)) + 1e-6).astype("int64")
    spare = 1 + differ // SPARE
    # Where sets may not differ at all, equal ones are one already.
    parts = np.where((differ > 0) & (sizes > 0), differ + 1 + spare, 0)
    first = np.concatenate([[0], np.cumsum(parts)])
    if not first[-1]:
        return np.zeros(len(sizes), "int64"), np.empty(0, "int64"), np.zeros(len(sizes) + 1, "int64")
    used = parts[row] > 0
    tokens, row = tokens[used], row[used]
    low, high = tokens & np.uint64(0xFFFFFFFF), tokens >> np.uint64(32)
    part = first[row] + ((high * parts[row].astype("uint64")) >> np.uint64(32)).astype("int64")
    filled = np.bincount(part, minlength=first[-1]) > 0
    # Halves, since sums of floats are exact up to 53 bits only.
    sums = [np.bincount(part, weights=half, minlength=first[-1]).astype("uint64") for half in (low, high)]
    of = np.repeat(np.arange(len(sizes)), parts)
    spare -= parts - np.bincount(of[filled], minlength=len(sizes))
    salt = _mixed((ends[of].astype("uint64") << np.uint64(32)) + (np.arange(first[-1]) - first[of]).astype("uint64"))
    keys, owner = _mixed((sums[0] + (sums[1] << np.uint64(32))) ^ salt)[filled], of[filled]
    sparse = np.flatnonzero((spare < 0) & (parts > 0))
    if len(sparse):
        begin = np.searchsorted(row, sparse)
        prefixes = [np.sort(tokens[b : b + sizes[r]])[: sizes[r] - math.ceil(sizes[r] * threshold - 1e-9) + 1] + np.uint64(ends[r]) for r, b in zip(sparse, begin)]
        keys = np.concatenate([keys, _mixed(np.concatenate(prefixes))])
        owner = np.concatenate([owner, np.repeat(sparse, [len(p) for p in prefixes])])
        order = np.argsort(owner, kind="stable")
        keys, owner = keys[order], owner[order]
    info = (sizes << 16) + (which << 15) + np.clip(spare, 0, (1 << 15) - 1)
    return info, keys.view("int64"), np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(sizes)))])


def _draw(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def lists(values: np.ndarray, starts: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(starts.astype("int32")), pa.array(values, pa.int64()))

    def drawn(ords: pa.Array, scopes: pa.Array, tokens: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
        sizes = np.diff(starts)
        row = np.repeat(np.arange(len(sizes)), sizes)
        ends = _sizes(threshold, int(sizes.max()))
        own = np.searchsorted(ends, sizes)
        # Sets of the next class may be similar to the larger ones of this.
        reach = np.searchsorted(ends, np.floor(sizes / threshold + 1e-6).astype("int64"))
        scope = scopes.to_numpy(zero_copy_only=False).view("uint64")
        totals = []
        for values in (tokens, _mixed(tokens)):
            upto = np.concatenate([np.zeros(1, "uint64"), np.cumsum(values, dtype="uint64")])
            totals.append(_mixed(upto[starts[1:]] - upto[starts[:-1]] ^ _mixed(scope + sizes.astype("uint64"))).view("int64"))
        info, keys, at = _dealt(tokens, row, starts, ends[own], 0, threshold)
        next_info, next_keys, next_at = _dealt(tokens, row, starts, np.where(reach > own, ends[reach], 0), 1, threshold)
        return pa.RecordBatch.from_arrays(
            [ords, pa.array(sizes), *map(pa.array, totals), lists(*_sketched(tokens, row, sizes)), pa.array(info), lists(keys, at), pa.array(next_info), lists(next_keys, next_at)],
            names=["ord", "size", "sum", "mixed", "sketch", "info", "keys", "next_info", "next_keys"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ords, scopes, sets = batch.column(0), batch.column(1), batch.column(2)
            offsets, start = sets.offsets.to_numpy().astype("int64"), 0
            values = sets.values.to_numpy(zero_copy_only=False).view("uint64")
            while start < len(batch):
                stop = max(int(np.searchsorted(offsets, offsets[start] + _STEP, side="right")) - 1, start + 1)
                own = offsets[start : stop + 1]
                yield drawn(ords.slice(start, stop - start), scopes.slice(start, stop - start), values[own[0] : own[-1]], own - own[0])
                start = stop

    return run


def _likely(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose ``ord`` is in ``wanted``, and few others while there are far fewer of them than bits."""
    word = F.pmod(F.xxhash64("ord"), F.lit(WANTED_WORDS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64("ord", F.lit(1)), F.lit(64)).cast("int"))
    table = wanted.groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    told = rows.withColumn("_word", word).join(F.broadcast(table), "_word")
    return told.where(F.col("_bits").bitwiseAND(bit) != 0).drop("_word", "_bits")


def _size(info: str) -> Column:
    return F.shiftright(F.col(info), 16)


def _spare(info: str) -> Column:
    return F.col(info).bitwiseAND((1 << 15) - 1)


def _visits(info: str) -> Column:
    return F.col(info).bitwiseAND(1 << 15) != 0


def _meetings(rows: DataFrame) -> DataFrame:
    """(ord, info, key) of keys that several rows have, with the first of them as ``lead``."""
    same = Window.partitionBy("key")
    told = rows.select("ord", "info", "key", F.count("*").over(same).alias("n"), F.min(F.struct("ord", "info")).over(same).alias("lead"))
    return told.where("n > 1").drop("n")


def _members(drawn: DataFrame, firsts: DataFrame) -> DataFrame:
    """The meetings of the sets of ``firsts``, shuffled in portions."""
    total = drawn.agg(F.sum(F.size("keys") + F.size("next_keys"))).first()[0] or 0
    portions, found = max(1, min(PORTIONS, math.ceil(total / PORTION))), None
    kinds = F.explode(F.array(F.struct("info", "keys"), F.struct(F.col("next_info").alias("info"), F.col("next_keys").alias("keys"))))
    keyed = drawn.where("size > 0").select("ord", kinds.alias("of")).select("ord", F.col("of.info").alias("info"), F.explode("of.keys").alias("key"))
    for k in range(portions):
        met = _meetings(keyed.where(F.pmod("key", F.lit(portions)) == k))
        met = materialize(met.join(firsts.select(F.col("first").alias("ord")), "ord", "left_semi"), "members")
        found = met if found is None else found.unionByName(met)
    return found


def _lead_round(met: DataFrame, drawn: DataFrame, tokens_of: Callable[[DataFrame], DataFrame], threshold: float) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): the sets that come first in all their keys but as many as they can spare, and those that are similar
    to one of them.  Similar sets share more keys than that, so nothing earlier is similar to the former, and the latter met them as leads."""
    behind = met.groupBy("ord", "info").agg(F.count_if(F.col("lead.ord") < F.col("ord")).alias("behind"))
    kept = materialize(behind.groupBy("ord").agg(F.bool_and(F.col("behind") <= _spare("info")).alias("first")).where("first").select("ord"), "leads")
    pairs = met.where((F.col("ord") > F.col("lead.ord")) & ~(_visits("info") & _visits("lead.info")) & _sizes_fit(_size("info"), _size("lead.info"), threshold))
    pairs = pairs.select(F.col("ord").alias("a"), F.col("lead.ord").alias("b")).distinct()
    pairs = materialize(pairs.join(kept.select(F.col("ord").alias("b")), "b", "left_semi"), "candidates")
    return kept, materialize(_similar(pairs, drawn, tokens_of, threshold).select(F.col("a").alias("ord")).distinct(), "losers")


def _similar_members(
    later: DataFrame, earlier: DataFrame, members: DataFrame, drawn: DataFrame, tokens_of: Callable[[DataFrame], DataFrame],
    threshold: float, hot_key: int, longest_key: int, rounds: int = HOT_ROUNDS,
) -> DataFrame:
    """All similar pairs (a, b) with a of ``later``, b of ``earlier`` and b < a.

    Keys that more than ``hot_key`` rows of ``earlier`` have are not met, but used up from what a set can spare; a pair shares more
    of the others than either set has left.  Sets that have too many hot keys meet among themselves, where keys are
    less hot, and in the end by prefixes.
    """
    left, right = (materialize(members.join(side, "ord", "left_semi").select("ord", "info", "key"), "met") for side in (later, earlier))
    hot = materialize(right.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot_key).select("key"), "hot-keys")
    used = [materialize(rows.join(hot, "key", "left_semi").groupBy("ord", "info").agg(F.count("*").alias("n")), "used") for rows in (left, right)]
    pairs = left.select(F.col("ord").alias("a"), "key", F.col("info").alias("ia")).join(
        right.join(hot, "key", "left_anti").select(F.col("ord").alias("b"), "key", F.col("info").alias("ib")), "key"
    )
    pairs = pairs.where((F.col("b") < F.col("a")) & ~(_visits("ia") & _visits("ib")) & _sizes_fit(_size("ia"), _size("ib"), threshold))
    pairs = pairs.groupBy("a", "b", "ia", "ib").agg(F.count("*").alias("shared"))
    for side, rows in zip("ab", used):
        pairs = pairs.join(rows.select(F.col("ord").alias(side), F.col("info").alias(f"i{side}"), F.col("n").alias(f"n{side}")), [side, f"i{side}"], "left")
        pairs = pairs.where(F.col("shared") > _spare(f"i{side}") - F.coalesce(f"n{side}", F.lit(0)))
    similar = _similar(materialize(pairs.select("a", "b").distinct(), "candidates"), drawn, tokens_of, threshold)
    spent = [materialize(rows.where(F.col("n") > _spare("info")).select("ord").distinct(), "spent") for rows in used]
    if any(rows.isEmpty() for rows in spent):
        return similar
    if rounds:
        more = _similar_members(*spent, left.unionByName(right).distinct(), drawn, tokens_of, threshold, hot_key * HOTTER, longest_key, rounds - 1)
    else:
        tokens = tokens_of(spent[0].unionByName(spent[1]))
        ordered = tokens.select("ord", rare_first(F.col("tokens"), token_levels(tokens)).alias("tokens"), sketch(F.col("tokens")).alias("sketch"))
        more = similar_earlier(*spent, materialize(ordered, "ordered-sets"), threshold, hot_key, longest_key)
    return similar.unionByName(more).distinct()


def _greedy(edges: DataFrame) -> DataFrame:
    """``ord`` of what first-wins drops, from all similar pairs (a, b) with b < a.

    Who has no undecided or kept earlier neighbour is kept, who has a kept one is dropped.
    """
    spark, dropped = edges.sparkSession, None
    left = materialize(edges, "edges")
    while not left.isEmpty():
        kept = left.select(F.col("b").alias("ord")).distinct().join(left.select(F.col("a").alias("ord")), "ord", "left_anti")
        losers = materialize(left.join(kept.select(F.col("ord").alias("b")), "b", "left_semi").select(F.col("a").alias("ord")).distinct(), "losers")
        dropped = losers if dropped is None else dropped.unionByName(losers)
        gone = materialize(kept.unionByName(losers), "decided")
        rest = left.join(gone.select(F.col("ord").alias("a")), "a", "left_anti").join(gone.select(F.col("ord").alias("b")), "b", "left_anti")
        left = materialize(rest, "edges")
    return dropped if dropped is not None else spark.createDataFrame([], "ord bigint")


def similar_to_kept(
    records: DataFrame, scope: Sequence[str] = (), text: str = "text", threshold: float = THRESHOLD,
    hot_key: int = HOT_KEY, longest_key: int = LONGEST_KEY, worthwhile: float = WORTHWHILE,
) -> DataFrame:
    """(ord, kept_ord) of every record that first-wins drops, ``kept_ord`` being the first kept record whose token
    set has a Jaccard similarity of ``threshold`` or more to its own.  No pairs leave the operator.

    Records with one set of tokens are one; the first stands for them, and the others
    share its fate.  In rounds, sets that come first in their keys are kept, and
    what is similar to one of them is dropped, so a family of copies goes by one comparison a record.
    When rounds settle little, what is left has few similar pairs; these are found by all their
    keys and resolved.  Two records without tokens are alike.
    """
    texts = records.select("ord", *scope, text)
    drawn = token_sets(spread(texts, "ord"), scope, text).select("ord", "scope", "tokens").mapInArrow(_draw(threshold), _DRAWN)
    drawn = materialize(drawn, "drawn-sets")
    set_key = ["sum", "mixed", "size"]
    firsts = materialize(drawn.groupBy(*set_key).agg(F.min("ord").alias("first"), F.count("*").alias("n")), "first-sets")

    def tokens_of(wanted: DataFrame) -> DataFrame:
        return materialize(token_sets(_likely(texts, wanted), scope, text).select("ord", "tokens"), "tokens")

    members = met = _members(drawn, firsts)
    dropped, size = None, met.count()
    few = size * FEW
    while size:
        first, losers = _lead_round(met, drawn, tokens_of, threshold)
        dropped = losers if dropped is None else dropped.unionByName(losers)
        rest = met.join(first, "ord", "left_anti").join(losers, "ord", "left_anti")
        met = materialize(_meetings(rest), "members")
        before, size = size, met.count()
        if size > (1 - worthwhile) * before or size < few:
            break
    if size:
        open_ = materialize(met.select("ord").distinct(), "open")
        dropped = dropped.unionByName(_greedy(_similar_members(open_, open_, met, drawn, tokens_of, threshold, hot_key, longest_key)))
    none = records.sparkSession.createDataFrame([], "ord bigint")
    dropped = materialize(dropped if dropped is not None else none, "dropped-sets")
    stays = materialize(members.select("ord").distinct().join(dropped, "ord", "left_anti"), "kept-sets")
    kept_of = _similar_members(dropped, stays, members, drawn, tokens_of, threshold, hot_key, longest_key)
    kept_of = kept_of.groupBy(F.col("a").alias("first")).agg(F.min("b").alias("kept_first"))
    fate = materialize(firsts.join(kept_of, "first", "left").select(*set_key, "first", "kept_first", "n").where("n > 1 OR kept_first IS NOT NULL"), "fates")
    told = drawn.select("ord", *set_key).join(fate.drop("n"), set_key).withColumn("kept_ord", F.coalesce("kept_first", "first"))
    return told.where(F.col("ord") != F.col("kept_ord")).select("ord", "kept_ord")


def drop_similar(records: DataFrame, **options) -> DataFrame:
    """``records`` without those of :func:`similar_to_kept`."""
    return records.join(similar_to_kept(records, **options).select("ord"), "ord", "left_anti")
