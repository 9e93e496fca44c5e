"""Document fingerprints by winnowing, with built-in functions only.

A text's words are hashed and ``GRAM`` of them at a time are put together by a cyclic polynomial
hash, so that the hash of a gram comes from those of its shorter runs and no
word is hashed again as the gram rolls on.  Of every ``WINDOW`` neighbouring grams the one with
the least hash is chosen, the rightmost of equal ones, and kept with its position, the number
of words before it.  So any run of ``GRAM + WINDOW - 1`` words that two texts share
gives both a common hash, and nothing shorter than a gram does.  Words are runs of characters other
than white space, cut after ``LONGEST`` characters so that text without white space
has grams as well.

Hashes are compared by their upper 31 bits; equal ones count as a tie.

Defined cases: a text with fewer words than a gram is one gram, one with fewer grams than a window is
one window; a null, empty or blank text has an empty fingerprint; two empty fingerprints are alike; equal texts
have equal fingerprints; other columns are ignored; an empty table gives an empty result.  Rows
that share an id follow each other in the order of their texts, rows without an id come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import let

GRAM, WINDOW = 5, 8
LONGEST = 32

# Ranges of ids for each shuffle partition.
RANGES = 4

_LOW = (1 << 32) - 1


def _rotated(x: Column, bits: int) -> Column:
    return F.shiftleft(x, bits).bitwiseOR(F.shiftrightunsigned(x, 64 - bits)) if bits else x


def _shifted(values: Column, by: int, other: Column, join) -> Column:
    """``join`` of each value and the one ``by`` places on in ``other``, as far as there is one."""
    n = F.size(other) - by
    return F.zip_with(F.slice(values, 1, n), F.slice(other, by + 1, n), join)


def _grams(hashes: Column, length: int) -> Column:
    """Cyclic polynomial hashes of all runs of ``length`` values; there are as many values at least."""
    if length == 1:
        return hashes
    half = length // 2

    def doubled(part: Column) -> Column:
        return _shifted(part, half, part, lambda a, b: _rotated(a, half).bitwiseXOR(b))

    if length % 2 == 0:
        return let(_grams(hashes, half), doubled)
    longer = let(_grams(hashes, half), doubled)
    return let(longer, lambda part: _shifted(part, length - 1, hashes, lambda a, b: _rotated(a, 1).bitwiseXOR(b)))


def _least(values: Column, length: int) -> Column:
    """The least value of all windows of ``length``; there are as many values at least."""

    def step(part: Column, span: int) -> Column:
        if span == length:
            return part
        by = min(span, length - span)
        return let(_shifted(part, by, part, lambda a, b: F.least(a, b)), lambda wider: step(wider, span + by))

    return step(values, 1)


def fingerprint(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """STRUCT<hashes ARRAY<BIGINT>, positions ARRAY<INT>>, in the order of the positions."""
    words = F.regexp_extract_all(text, F.lit(rf"[^\x20\x09-\x0D]{{1,{LONGEST}}}"), F.lit(0))

    def chosen(grams: Column) -> Column:
        # The rightmost of equal hashes is the least, since its position is taken away.
        packed = F.transform(grams, lambda h, i: F.shiftleft(F.shiftrightunsigned(h, 33), 32).bitwiseOR(F.lit(_LOW) - i))
        least = let(packed, lambda p: F.when(F.size(p) <= window, F.array(F.array_min(p))).otherwise(_least(p, window)))
        positions = F.transform(F.array_distinct(least), lambda p: (F.lit(_LOW) - p.bitwiseAND(F.lit(_LOW))).cast("int"))
        return let(positions, lambda at: F.struct(F.transform(at, lambda i: F.get(grams, i)).alias("hashes"), at.alias("positions")))

    def of_words(hashes: Column) -> Column:
        short = F.array(F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: _rotated(a, 1).bitwiseXOR(h)))
        return let(F.when(F.size(hashes) < gram, short).otherwise(_grams(hashes, gram)), chosen)

    nothing = F.struct(F.lit(None).cast("array<bigint>").alias("hashes"), F.lit(None).cast("array<int>").alias("positions"))
    found = let(
        F.transform(words, lambda w: F.xxhash64(w)), lambda hashes: F.when(F.size(hashes) > 0, of_words(hashes)).otherwise(nothing)
    )
    return let(
        found,
        lambda f: F.struct(
            F.coalesce(f["hashes"], F.array().cast("array<bigint>")).alias("hashes"),
            F.coalesce(f["positions"], F.array().cast("array<int>")).alias("positions"),
        ),
    )


def written(print_: Column) -> Column:
    """A fingerprint as ``position:hash`` in hexadecimal, comma-joined."""
    pairs = F.zip_with(print_["positions"], print_["hashes"], lambda i, h: F.concat_ws(":", F.lower(F.hex(i)), F.lower(F.hex(h))))
    return F.array_join(pairs, ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of the hashes of two fingerprints."""
    both = F.size(F.array_intersect(a, b))
    all_ = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(all_ == 0, 1.0).otherwise(both / (all_ - both))


def fingerprinted(docs: DataFrame, id: str = "doc_id", text: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """(id, hashes, positions) per row of ``docs``."""
    return docs.select(id, fingerprint(F.col(text), gram, window).alias("print")).select(id, "print.hashes", "print.positions")


def _range_of(id: Column, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` are not over ``id``, by binary search."""
    steps = [1 << k for k in range(len(cuts).bit_length() - 1, -1, -1)]
    values = F.lit(cuts) if cuts else F.array().cast("array<bigint>")
    further = lambda at, s: F.when(F.get(values, at + s - 1) <= id, at + s).otherwise(at)
    return F.aggregate(F.lit(steps).cast("array<int>"), F.lit(0), further) if cuts else F.lit(0)


def in_ranges(docs: DataFrame, id: str, ranges: int) -> DataFrame:
    """The rows of ``docs`` with ``_range``, a number that grows with the id, and ``_after``.

    Ranges hold about as many rows each.  The rows with a range's least id are there a second time, with
    ``_after`` true, in the range before; those of the first range in the last one.
    So each row's successor, and the first row for the last, is in its own range.
    """
    shares = [k / ranges for k in range(1, ranges)]
    key = F.col(id).cast("long")
    cuts = docs.agg(F.percentile_approx(key, shares, 10 * ranges)).first()[0] if shares else None
    rough = _range_of(key, sorted(set(cuts or [])))
    # One number for each range.
    firsts = docs.groupBy(rough.alias("r")).agg(F.min(key).alias("first"), F.max(F.isnull(key)).alias("bare")).collect()
    least = sorted(r.first for r in firsts if r.first is not None)
    bare = any(r.bare for r in firsts)
    number = _range_of(key, least[1:])
    last = max(len(least) - 1, 0)
    starts = (F.isnull(key) if bare else key == F.lit(least[0] if least else None).cast("long")) | key.isin(least[1:])
    before = F.when(F.isnull(key) | (number == 0), F.lit(last)).otherwise(number - 1)
    once = F.struct(number.alias("_range"), F.lit(False).alias("_after"))
    twice = F.array(once, F.struct(before.alias("_range"), F.lit(True).alias("_after")))
    return docs.withColumn("_place", F.explode(F.when(starts, twice).otherwise(F.array(once)))).select(*docs.columns, "_place.*")


def edited_and_next(docs: DataFrame, id: str = "doc_id", text: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """(id, text, edited, print, edited_print, next_hashes) per row of ``docs``: the text, the text with
    its second half replaced by as many first code points of the next document, both fingerprints, and
    the hashes of the next document's.

    The texts move once, to their range of ids.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    placed = in_ranges(texts, "id", RANGES * partitions).repartition(partitions, "_range")
    placed = placed.withColumn("print", fingerprint(F.col("text"), gram, window))
    order = Window.partitionBy("_range").orderBy("_after", "id", "text")
    followed = placed.withColumns(
        {"next_text": F.lead("text").over(order), "next_hashes": F.lead("print.hashes").over(order)}
    ).where(~F.col("_after"))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    both = followed.select("id", "text", "print", "next_hashes", edited.alias("edited"))
    return both.withColumn("edited_print", fingerprint(F.col("edited"), gram, window)).withColumnRenamed("id", id)
