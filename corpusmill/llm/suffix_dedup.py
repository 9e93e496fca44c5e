"""Removal of byte strings that occurred before, by suffix arrays over shards.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts earlier: in a document
with a smaller id, or before in the same one.

Every such string is known by one of its grams of ``GRAM`` bytes, the one with the least
hash; neighbouring strings mostly share it, and make a run.  Equal strings have equal grams, so
only runs whose gram comes twice or more can repeat anything, and only runs with equal grams
have to meet.  Runs with equal bytes are combined before they are shuffled: all but the
first are removed whole.  Of the first ones, those that share a gram with the same bytes on one
side of it, as equal strings do, go into shards, each about ``SHARD`` bytes,
in which a suffix array is built by induced sorting; its permuted common prefixes show
which strings are equal, and all but the earliest are removed.  The strings of a gram with more
than ``HOT`` different runs are instead met by their digests, one row per string.

Defined cases: a null text is empty; texts under ``LENGTH`` bytes lose nothing; ids are expected
to be unique, rows that share an id share their places, so what both hold at the same place
does not repeat; rows without an id are left as they are; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.suffixes import common_prefixes, suffix_array
from corpusmill.llm.words import mixed
from corpusmill.session import materialize

LENGTH = 100
GRAM = 24
# Half of what a string has besides its gram.
SIDE = (LENGTH - GRAM) // 2
SHARD = 1 << 20
HOT = 2000

# Bytes that are looked at together; a place among them fits 24 bits.
_PIECE = 4 << 20
_PLACE_BITS = 24

# Bytes of short texts that are hashed together: few enough for a processor's cache.
_HASHED = 1 << 18


def _eights(data: np.ndarray) -> np.ndarray:
    """All runs of eight bytes as numbers."""
    eight = data.astype("uint64")
    for shift in (1, 2, 4):
        grown = eight[: len(eight) - shift].copy()
        grown |= eight[shift:] << np.uint64(8 * shift)
        eight = grown
    return eight


def _gram_hashes(eight: np.ndarray) -> np.ndarray:
    """64-bit hashes of all runs of GRAM = 24 bytes."""
    n = len(eight) + 8 - GRAM
    with np.errstate(over="ignore"):
        out = mixed(eight[:n] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
        out = mixed(out + eight[8 : 8 + n] * np.uint64(0xC2B2AE3D27D4EB4F))
        return mixed(out + eight[16 : 16 + n] * np.uint64(0x165667B19E3779F9))


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every window, by doubling."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def _digests(eight: np.ndarray, begin: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit keys of the byte strings, all their bytes and their size being mixed into either."""
    out = [mixed(size.astype("uint64") + np.uint64(seed)) for seed in (1, 2)]
    with np.errstate(over="ignore"):
        for k in range(0, int(size.max()), 8):
            # The last eight bytes of a string come again where it has no more.
            word = eight[begin + np.minimum(k, size - 8)]
            out = [mixed(h * np.uint64(m) + word) for h, m in zip(out, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))]
    return [h.view("int64") for h in out]


def string_runs(pieces: list[bytes], grams_only: bool = False) -> tuple[np.ndarray, ...]:
    """(piece, first start, number of starts, gram hash, sides, h1, h2) of the runs of strings with one gram, or
    their gram hashes alone.

    Of a string, SIDE bytes before its gram or SIDE bytes behind it belong to it as well, or both.
    ``sides`` has 32 bits for the gram with the bytes before it and 32 for that with those behind
    it, zero where no string of the run has them.  ``h1`` and ``h2`` stand for the run's bytes.
    """
    ends = np.cumsum([len(p) for p in pieces])
    data = np.frombuffer(b"".join(pieces), dtype="uint8")
    empty = np.empty(0, dtype="int64")
    nothing = (empty,) * (1 if grams_only else 7)
    if len(data) < LENGTH:
        return nothing
    eight = _eights(data)
    hashes = _gram_hashes(eight)
    low = np.uint64((1 << _PLACE_BITS) - 1)
    least = _window_minima((hashes & ~low) | np.arange(len(hashes), dtype="uint64"), LENGTH - GRAM + 1)
    chosen = (least & low).astype("int64")
    start = np.arange(len(chosen))
    piece = np.searchsorted(ends, start, "right")
    valid = start + LENGTH <= ends[piece]
    start, chosen, piece = start[valid], chosen[valid], piece[valid]
    if not len(start):
        return nothing
    opens = np.flatnonzero(np.append(True, (chosen[1:] != chosen[:-1]) | (piece[1:] != piece[:-1])))
    count = np.diff(np.append(opens, len(start)))
    first, begin, gram = piece[opens], start[opens], chosen[opens]
    if grams_only:
        return (hashes[gram].view("int64"),)

    def side(there: np.ndarray, *shifts: int) -> np.ndarray:
        out = np.zeros(len(gram), dtype="uint64")
        with np.errstate(over="ignore"):
            for shift in shifts:
                out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[np.clip(gram + shift, 0, len(hashes) - 1)])
        return np.where(there, (out >> np.uint64(32)) | np.uint64(1), np.uint64(0))

    before = side(begin <= gram - SIDE, -SIDE, -(SIDE - GRAM), 0)
    behind = side(begin + count - 1 >= gram - SIDE, 0, GRAM, SIDE)
    sides = ((before << np.uint64(32)) | behind).view("int64")
    return first, begin - (ends - [len(p) for p in pieces])[first], count, hashes[gram].view("int64"), sides, *_digests(eight, begin, count + LENGTH - 1)


def _pieces(value: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) that hold every string of a text."""
    for at in range(0, max(len(value) - LENGTH + 1, 1), _PIECE):
        yield at, value[at : at + _PIECE + LENGTH - 1]


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, int, bytes]]]:
    """(id, offset, bytes) of the pieces of all texts, about ``_HASHED`` bytes of them at a time; a larger one ends its list."""
    waiting, size = [], 0
    for batch in batches:
        for identifier, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for offset, piece in _pieces((value or "").encode("utf-8", "surrogatepass")):
                waiting.append((identifier, offset, piece))
                size += len(piece)
                if size >= _HASHED:
                    yield waiting
                    waiting, size = [], 0
    if waiting:
        yield waiting


def _runs(docs: DataFrame, id: str, text: str, grams_only: bool = False) -> DataFrame:
    """(gram, id, start, count, sides, h1, h2) of all documents, or (gram)."""
    names = ["gram"] if grams_only else ["gram", "id", "start", "count", "sides", "h1", "h2"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for waiting in _together(batches):
            pieces = [p for _, _, p in waiting]
            if grams_only:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in string_runs(pieces, True)], names=names)
                continue
            piece, start, count, gram, *rest = string_runs(pieces)
            ids = np.array([i for i, _, _ in waiting], dtype="int64")
            offsets = np.array([o for _, o, _ in waiting], dtype="int64")
            columns = [gram, ids[piece], start + offsets[piece], count, *rest]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c, dtype="int64")) for c in columns], names=names)

    rows = docs.select(F.col(id).cast("long"), text).where(F.col(id).isNotNull())
    return rows.mapInArrow(scan, ", ".join(f"{n} long" for n in names))


def _repeated(runs: DataFrame, grams: DataFrame) -> DataFrame:
    """The runs whose gram comes twice or more in ``grams``, a lighter scan of the same."""
    again = grams.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram")
    return runs.join(again, "gram")


def _with_equal_side(runs: DataFrame) -> DataFrame:
    """Of different runs, those whose gram another one has with the same bytes on one side."""
    before, behind = F.shiftrightunsigned("sides", 32), F.col("sides").bitwiseAND(F.lit((1 << 32) - 1))
    runs = runs.withColumns({"before": before, "behind": behind})
    for side in ("before", "behind"):
        same = runs.where(F.col(side) != 0).groupBy("gram", side).agg(F.count("*").alias(f"same_{side}"))
        runs = runs.join(same.where(F.col(f"same_{side}") > 1), ["gram", side], "left")
    return runs.where("same_before IS NOT NULL OR same_behind IS NOT NULL")


def _place(id: Column, start: Column) -> Column:
    """Document and byte as one number in their order."""
    return (id.cast("decimal(20,0)") * F.lit(1 << 40).cast("decimal(13,0)") + start.cast("decimal(13,0)")).cast("decimal(34,0)")


def _with_bytes(docs: DataFrame, runs: DataFrame, id: str, text: str) -> DataFrame:
    """(gram, kinds, id, start, count, bytes) of the runs."""
    lists = runs.groupBy("id").agg(F.collect_list(F.struct("gram", "kinds", "start", "count")).alias("runs"))
    names = ["gram", "kinds", "id", "start", "count"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, parts = [], []
            for identifier, value, runs in zip(*[c.to_pylist() for c in batch.columns]):
                data = (value or "").encode("utf-8", "surrogatepass")
                for run in runs:
                    part = data[run["start"] : run["start"] + run["count"] + LENGTH - 1]
                    # Rows that share an id: one whose text ends before is not the one with the run.
                    if len(part) == run["count"] + LENGTH - 1:
                        numbers.append((run["gram"], run["kinds"], identifier, run["start"], run["count"]))
                        parts.append(part)
            table = np.array(numbers, dtype="int64").reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays([*[pa.array(np.ascontiguousarray(c)) for c in table], pa.array(parts, pa.binary())], names=[*names, "bytes"])

    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.join(lists, "id").select("id", "text", "runs").mapInArrow(cut, ", ".join(f"{n} long" for n in names) + ", bytes binary")


def later_strings(shard: pd.DataFrame) -> pd.DataFrame:
    """(id, start, length) of the strings of a shard's runs that start earlier as well.

    ``shard`` has (id, start, count, bytes); neighbouring strings come out as one span.
    """
    shard = shard.sort_values(["id", "start"], kind="stable")
    parts = shard["bytes"].tolist()
    # A separator follows each run, and the least symbol ends the shard.
    text = np.ones(sum(len(p) + 1 for p in parts) + 1, dtype="int64")
    text[-1] = 0
    opens = np.cumsum([0, *[len(p) + 1 for p in parts]])[:-1]
    for at, part in zip(opens.tolist(), parts):
        text[at : at + len(part)] = np.frombuffer(part, dtype="uint8").astype("int64") + 2
    order = suffix_array(text)
    group_of_rank = np.cumsum(common_prefixes(text, order) < LENGTH)
    group = np.empty(len(text), dtype="int64")
    group[order] = group_of_rank
    counts = shard["count"].to_numpy()
    row = np.repeat(np.arange(len(parts)), counts)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    ids, starts = shard["id"].to_numpy()[row], shard["start"].to_numpy()[row] + offset
    group = group[opens[row] + offset]
    by = np.lexsort((starts, ids, group))
    leads = np.append(True, group[by][1:] != group[by][:-1])
    lead = by[np.maximum.accumulate(np.where(leads, np.arange(len(by)), 0))]
    later = np.zeros(len(by), dtype=bool)
    later[by] = (ids[by] != ids[lead]) | (starts[by] != starts[lead])
    ids, starts, row = ids[later], starts[later], row[later]
    if not len(ids):
        return pd.DataFrame({"id": ids, "start": starts, "length": starts})
    cut = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (starts[1:] != starts[:-1] + 1)))
    last = np.append(cut[1:], len(starts)) - 1
    return pd.DataFrame({"id": ids[cut], "start": starts[cut], "length": starts[last] - starts[cut] + LENGTH})


def _of_hot_grams(runs: DataFrame) -> DataFrame:
    """The same for the runs of grams that have too many for a shard: by the digests of their strings."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for identifier, start, count, data in zip(*[c.to_pylist() for c in batch.columns]):
                for k in range(count):
                    digest = hashlib.blake2b(data[k : k + LENGTH], digest_size=16).digest()
                    rows.append((identifier, start + k, *np.frombuffer(digest, dtype="<i8").tolist()))
            table = np.array(rows, dtype="int64").reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in table], names=["id", "start", "h1", "h2"])

    single = runs.select("id", "start", "count", "bytes").mapInArrow(strings, "id long, start long, h1 long, h2 long")
    single = materialize(single, "hot-strings")
    place = _place(F.col("id"), F.col("start"))
    firsts = single.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = single.join(firsts, ["h1", "h2"]).where(place > F.col("first"))
    return later.select("id", "start", F.lit(LENGTH).cast("long").alias("length"))


def repeated_spans(docs: DataFrame, id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD, hot: int = HOT) -> DataFrame:
    """(id, start, length) of byte spans that repeat earlier ones; spans may overlap."""
    runs = materialize(_repeated(_runs(docs, id, text), _runs(docs, id, text, grams_only=True)), "repeated-runs")
    first = F.min(F.struct("id", "start", "count", "sides"))
    groups = materialize(runs.groupBy("gram", "h1", "h2").agg(first.alias("first"), F.count("*").alias("copies")), "run-groups")
    copied = groups.where("copies > 1").select("gram", "h1", "h2", F.col("first.id").alias("_id"), F.col("first.start").alias("_start"))
    copies = runs.join(copied, ["gram", "h1", "h2"]).where("id > _id OR (id = _id AND start > _start)")
    whole = copies.select("id", "start", (F.col("count") + LENGTH - 1).alias("length"))
    several = groups.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1")
    firsts = materialize(groups.join(several, "gram").select("gram", "kinds", "first.*"), "different-runs")
    firsts = materialize(_with_bytes(docs, _with_equal_side(firsts), id, text), "first-runs")
    total = firsts.where(F.col("kinds") <= hot).agg(F.sum(F.length("bytes"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    columns = ["id", "start", "count", "bytes"]
    in_shards = (
        firsts.where(F.col("kinds") <= hot)
        .select(F.pmod(F.xxhash64("gram"), F.lit(shards)).alias("shard"), *columns)
        .groupBy("shard")
        .applyInPandas(lambda shard: later_strings(shard[columns]), "id long, start long, length long")
    )
    return whole.unionByName(in_shards).unionByName(_of_hot_grams(firsts.where(F.col("kinds") > hot)))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint, not touching (start, end) that cover the same bytes."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def without_spans(docs: DataFrame, spans: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) per row of ``docs``, ``kept`` being the bytes that are left."""
    lists = spans.groupBy("id").agg(F.collect_list(F.struct("start", "length")).alias("_spans"))
    lists = materialize(lists, "spans").withColumnRenamed("id", "_id")
    longs = [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")]
    schema = T.StructType([docs.schema[id], *longs, T.StructField("kept", T.BinaryType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, kept = [], []
            for value, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = (value or "").encode("utf-8", "surrogatepass")
                gone = merged([(s["start"], min(s["start"] + s["length"], len(data))) for s in spans or () if s["start"] < len(data)])
                places = [0, *[x for span in gone for x in span], len(data)]
                left = b"".join(data[a:b] for a, b in zip(places[::2], places[1::2]))
                rows.append((len(data), len(data) - len(left), len(gone)))
                kept.append(left)
            table = np.array(rows, dtype="int64").reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.ascontiguousarray(c)) for c in table], pa.array(kept, pa.binary())], names=schema.names)

    joined = docs.select(F.col(id), F.col(text)).join(lists, F.col(id).cast("long") == F.col("_id"), "left")
    return joined.select(id, text, "_spans").mapInArrow(cut, schema)
