"""Benchmark passages in documents, by the q-gram lemma and banded alignment.

Texts are compared in lower case with white space collapsed.  A passage of m characters
that occurs with at most e edits shares at least m - q + 1 - q * e of its q-grams, all on
diagonals (document position less passage position) that differ by at most e.  So shared
q-grams are counted in bands of diagonals that overlap by half, and only bands that reach
that count are aligned, within the band.  Of e + 1 q-grams of a passage that don't overlap one is left
by any e edits, so bands are counted only where one of the e + 1 rarest is found: an opening
that many passages share costs nothing.  No step loses an occurrence.

A passage may have an edit for every twenty characters, and q is ``Q`` or what e + 1
q-grams leave room for.  A passage shorter than ``Q`` has to stand between word boundaries.

The passages are taken in slices of at most ``SLICE_CHARS`` characters, each sent to all
tasks; further slices are further passes over the documents.

Defined cases: passages that are null or blank match nothing; a null or
empty text holds no passage; repeated rows are judged each by itself; all columns of the
documents are kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Q = 12
EDIT_PERCENT = 5
SLICE_CHARS = 4_000_000

# Characters that are looked at together.
_PIECE = 1 << 20
_FILTER_BITS = 22

# Meetings of rare q-grams that are held at a time.
_MEETINGS = 1 << 20

FOUND = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("edits", T.IntegerType()), T.StructField("end", T.LongType())]))


def normalized(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype("uint64")


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    """64-bit keys of all runs of ``q`` codes."""
    if len(codes) < q:
        return np.empty(0, dtype="uint64")
    n, out = len(codes) - q + 1, np.zeros(len(codes) - q + 1, dtype="uint64")
    with np.errstate(over="ignore"):
        for k in range(q):
            out *= np.uint64(0x9E3779B97F4A7C15)
            out += codes[k : k + n]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
    return out


def _rarest_apart(rarity: np.ndarray, q: int, wanted: int) -> list[int]:
    """``wanted`` starts of runs of ``q`` places that don't overlap, rare ones first; there is room for them."""
    chosen: list[int] = []
    free, end = np.ones(len(rarity) + q - 1, dtype=bool), len(rarity) + q - 1
    for at in np.lexsort((np.arange(len(rarity)), rarity)).tolist():
        if len(chosen) == wanted:
            break
        if not free[at] or not free[at + q - 1]:
            continue
        edges = sorted([*chosen, at])
        # The gaps must still hold the others.
        room = sum((b - a) // q for a, b in zip([0, *[e + q for e in edges]], [*edges, end]))
        if len(edges) + room >= wanted:
            chosen.append(at)
            free[at : at + q] = False
    return chosen


class _Passages:
    """Passages that have the same q, and the keys of their rarest q-grams."""

    def __init__(self, items: list[tuple[int, str]], q: int, edit_percent: int):
        self.q, self.items = q, items
        lengths = np.array([len(t) for _, t in items], dtype="int64")
        self.edits = lengths * edit_percent // 100
        self.least = lengths - q + 1 - q * self.edits
        self.longest = int((lengths + self.edits).max(initial=0))
        grams = [_grams(_codes(t), q) for _, t in items]
        known, times = np.unique(np.concatenate(grams), return_counts=True)
        rare = [_rarest_apart(times[np.searchsorted(known, g)], q, int(e) + 1) for g, e in zip(grams, self.edits)]
        self.item = np.repeat(np.arange(len(items)), [len(r) for r in rare])
        self.place = np.concatenate([np.array(r, dtype="int64") for r in rare])
        keys = np.concatenate([g[r] for g, r in zip(grams, rare)])
        order = np.argsort(keys, kind="stable")
        self.keys, self.item, self.place = keys[order], self.item[order], self.place[order]
        self.filter = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.filter[self.keys >> np.uint64(64 - _FILTER_BITS)] = True
        # All q-grams of a passage, sorted, with their places.
        orders = [np.argsort(g, kind="stable") for g in grams]
        self.grams = [(g[o], o) for g, o in zip(grams, orders)]

    def bands(self, codes: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int]]:
        """(piece, item, band) where a band holds enough shared q-grams; pieces begin at ``starts``."""
        keys = _grams(codes, self.q)
        at = np.flatnonzero(self.filter[keys >> np.uint64(64 - _FILTER_BITS)])
        low, high = np.searchsorted(self.keys, keys[at], "left"), np.searchsorted(self.keys, keys[at], "right")
        n = high - low
        at, low, n = at[n > 0], low[n > 0], n[n > 0]
        named: set[tuple[int, int, int]] = set()
        ends = np.cumsum(n)
        for first in range(0, int(ends[-1]) if len(ends) else 0, _MEETINGS):
            # The meetings of rare q-grams from number ``first`` on.
            number = np.arange(first, min(first + _MEETINGS, int(ends[-1])))
            of = np.searchsorted(ends, number, "right")
            hit = low[of] + number - (ends[of] - n[of])
            item, place = self.item[hit], at[of]
            piece = np.searchsorted(starts, place, "right") - 1
            # Shifted so that no diagonal is negative.
            band = (place - starts[piece] - self.place[hit] + self.longest) // np.maximum(self.edits[item], 1)
            both = np.stack([np.tile(piece, 2), np.tile(item, 2), np.concatenate([band, band - 1])])
            named.update(map(tuple, np.unique(both, axis=1).T.tolist()))
        return [x for x in sorted(named) if self._shared(keys, starts, *x) >= self.least[x[1]]]

    def _shared(self, keys: np.ndarray, starts: np.ndarray, piece: int, item: int, band: int) -> int:
        """Meetings of q-grams of a piece and a passage in a band of diagonals."""
        width = max(int(self.edits[item]), 1)
        grams, places = self.grams[item]
        least = band * width - self.longest
        low = max(int(starts[piece]) + least, int(starts[piece]))
        stop = int(starts[piece + 1]) if piece + 1 < len(starts) else len(keys)
        own = keys[low : max(low, min(int(starts[piece]) + least + 2 * width + len(grams), stop))]
        left, right = np.searchsorted(grams, own, "left"), np.searchsorted(grams, own, "right")
        n = right - left
        of = np.repeat(np.arange(len(own)), n)
        hit = np.repeat(left - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        diagonal = low - int(starts[piece]) + of - places[hit]
        return int(((diagonal >= least) & (diagonal < least + 2 * width)).sum())


class PassageIndex:
    """The q-grams of some passages, with their budgets of edits."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, edit_percent: int = EDIT_PERCENT):
        self.q, self.groups = q, []
        self.items = [(i, t) for i, t in ((i, normalized(t)) for i, t in items) if t]
        self.edits = [len(t) * edit_percent // 100 for _, t in self.items]
        of: dict[int, list[tuple[int, str]]] = {}
        for (i, t), edits in zip(self.items, self.edits):
            of.setdefault(min(q, len(t) // (edits + 1)), []).append((i, t))
        self.groups = [_Passages(group, q, edit_percent) for q, group in sorted(of.items())]
        self.longest = max((g.longest for g in self.groups), default=0)

    def find(self, texts: list[str | None]) -> list[dict[int, tuple[int, int]]]:
        """For each text, item_id -> (edits, end in the normalized text) of its best occurrence."""
        found: list[dict[int, tuple[int, int]]] = [{} for _ in texts]
        if not self.items:
            return found
        batch: list[tuple[int, int, str]] = []
        size = 0
        step = max(_PIECE - self.longest, self.longest + 1)
        for row, text in enumerate(texts):
            text = normalized(text)
            # A long text goes in pieces that overlap by more than a passage.
            for at in range(0, max(len(text) - self.longest, 1), step):
                piece = text[at : at + step + self.longest]
                batch.append((row, at, piece))
                size += len(piece)
                if size >= _PIECE:
                    self._search(batch, found)
                    batch, size = [], 0
        self._search(batch, found)
        return found

    def _search(self, batch: list[tuple[int, int, str]], found: list[dict[int, tuple[int, int]]]) -> None:
        if not batch:
            return
        # A line end separates the pieces; normalized passages have none.
        starts = np.cumsum([0, *[len(p) + 1 for _, _, p in batch[:-1]]])
        codes = _codes("\n".join(p for _, _, p in batch))
        for group in self.groups:
            for piece, item, band in group.bands(codes, starts):
                row, at, text = batch[piece]
                identifier, passage = group.items[item]
                edits = int(group.edits[item])
                first = band * max(edits, 1) - group.longest
                result = aligned(passage, text, first - edits, first + 2 * max(edits, 1) + edits, edits)
                if result and len(passage) < self.q and not _apart(text, result[1] - len(passage), result[1], at):
                    continue
                if result and (identifier not in found[row] or result < found[row][identifier]):
                    found[row][identifier] = (result[0], at + result[1])


def _apart(text: str, start: int, end: int, at: int) -> bool:
    """Whether a passage stands between word boundaries of a piece that begins at ``at``."""
    # A piece may begin within a word; what it cuts there, the piece before holds whole.
    opens = start > 0 and not (text[start - 1].isalnum() and text[start].isalnum()) or start == 0 and at == 0
    return opens and not (end < len(text) and text[end].isalnum() and text[end - 1].isalnum())


def aligned(passage: str, text: str, low: int, high: int, most: int) -> tuple[int, int] | None:
    """(edits, end) of the best occurrence of ``passage`` in ``text`` on the diagonals from
    ``low`` to ``high``; None if it takes more than ``most`` edits.  Only the band's cells are filled."""
    m, width = len(passage), high - low + 1
    exact = text.find(passage, max(low, 0), max(high + m, 0))
    if exact >= 0:
        return 0, exact + m
    if most == 0:
        return None
    far = m + width + len(text)
    codes, pattern = _codes(text).astype("int64"), _codes(passage).astype("int64")
    # padded[low + row + k + shift] is the character that cell k of a row compares.
    padded = np.full(len(text) + 2 * (m + width + abs(low) + abs(high)), -1, dtype="int64")
    shift = m + width + abs(low)
    padded[shift : shift + len(text)] = codes
    offsets = np.arange(width)
    columns = low + offsets
    cost = np.where((columns >= 0) & (columns <= len(text)), 0, far)
    for row in range(1, m + 1):
        columns = low + row + offsets
        seen = padded[shift + low + row - 1 : shift + low + row - 1 + width]
        best = cost + (seen != pattern[row - 1])
        best[:-1] = np.minimum(best[:-1], cost[1:] + 1)
        best[(columns < 0) | (columns > len(text))] = far
        cost = np.minimum.accumulate(best - offsets) + offsets
        cost[(columns < 0) | (columns > len(text))] = far
    k = int(cost.argmin())
    return (int(cost[k]), low + m + k) if cost[k] <= most else None


@lru_cache(maxsize=2)
def _index_of(items: tuple[tuple[int, str], ...], q: int, edit_percent: int) -> PassageIndex:
    return PassageIndex(list(items), q, edit_percent)


def with_passages(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    name: str = "passages", q: int = Q, edit_percent: int = EDIT_PERCENT, slice_chars: int = SLICE_CHARS,
) -> DataFrame:
    """``docs`` and a column ``name``: the passages that each document holds.  No shuffle."""
    if name in docs.columns:
        raise ValueError(f"documents have a column {name} already")
    spark = docs.sparkSession
    items = benchmark.select(F.col(item).cast("long").alias("i"), F.col(item_text).alias("t")).where("t IS NOT NULL AND i IS NOT NULL")
    chars = items.agg(F.sum(F.length("t"))).first()[0] or 0
    slices = max(1, -(-chars // slice_chars))
    schema = T.StructType([*docs.schema.fields, T.StructField(name, FOUND)])
    out, place = docs.withColumn(name, F.lit(None).cast(FOUND)), docs.columns.index(text)
    for k in range(slices):
        part = tuple(sorted(tuple(r) for r in items.where(F.pmod(F.xxhash64("i", "t"), F.lit(slices)) == k).collect()))
        sent = spark.sparkContext.broadcast(part)

        def search(batches: Iterator[pa.RecordBatch], sent=sent, place=place) -> Iterator[pa.RecordBatch]:
            index = _index_of(sent.value, q, edit_percent)
            for batch in batches:
                before = batch.column(batch.num_columns - 1).to_pylist()
                found = index.find(batch.column(place).to_pylist())
                rows = [
                    sorted([*(old or []), *({"item_id": i, "edits": e, "end": z} for i, (e, z) in new.items())], key=lambda x: x["item_id"])
                    for old, new in zip(before, found)
                ]
                kind = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, kind)], names=batch.schema.names)

        out = out.mapInArrow(search, schema)
    return out


def without_passages(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents that hold no passage, with all their columns."""
    name = "passages"
    while name in docs.columns:
        name = f"_{name}"
    return with_passages(docs, benchmark, text, name=name).where(F.size(name) == 0).drop(name)
