"""Vectors as short codes: product quantization by Lloyd rounds that look at active entries only.

Components become whole numbers, ``floor(SCALE * x)``, and a vector is cut into ``PARTS`` equal parts.
Each part position has a codebook, which starts as that part of the vectors with the least
ids.  A round assigns every part to its nearest entry, the lower index of equal ones, and moves each entry
to the floor of its parts' mean; entries without parts stay.

Assignments are written with their exact squared distances.  In the next round a part whose
entry stayed where it was keeps its distance, and only entries that moved can beat it, so it is
compared with these alone; a part whose entry moved scans the whole codebook.  All numbers
are whole, so the result is that of a full scan.

Each round is a pass over the written parts without a shuffle of them, and sums of
``PARTS * ENTRIES`` cells, combined in each task.  Only the codebooks, whose size is fixed, visit the driver.

Defined cases: a vector that is null, holds a null or a non-finite component, or whose length is not that of the
first kept vector, or no multiple of ``PARTS``, is dropped; components from 2**26 / SCALE up fail the
job, since distances would not fit; with fewer vectors than entries the codebooks are shorter; of equal
ids the lesser vector comes first, null ids come last; null labels are one label; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.session import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256

_LARGEST = 1 << 26
_STEP = 4096


@dataclass
class Codebooks:
    """``entries``: (parts, entries, length of a part); ``moved``: (parts, entries), since the last assignment."""

    entries: np.ndarray
    moved: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """(rows, entries) exact squared distances of whole numbers."""
    out = np.zeros((len(x), len(entries)), dtype="int64")
    for k in range(x.shape[1]):
        gap = x[:, k, None] - entries[None, :, k]
        out += gap * gap
    return out


def assigned(x: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """(entry, distance) of every part of ``x`` (rows, parts, length), by a scan of all entries."""
    entry, distance = np.empty(x.shape[:2], dtype="int64"), np.empty(x.shape[:2], dtype="int64")
    for p in range(x.shape[1]):
        far = distances(x[:, p], books.entries[p])
        entry[:, p] = far.argmin(axis=1)
        distance[:, p] = far.min(axis=1)
    return entry, distance


def reassigned(x: np.ndarray, books: Codebooks, entry: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same as :func:`assigned`, from the assignment before the entries moved."""
    entry, distance = entry.copy(), distance.copy()
    for p in range(x.shape[1]):
        moved = np.flatnonzero(books.moved[p])
        stays = ~books.moved[p][entry[:, p]]
        if len(moved) and stays.any():
            far = distances(x[stays, p], books.entries[p][moved])
            best, at, held = moved[far.argmin(axis=1)], far.min(axis=1), (entry[stays, p], distance[stays, p])
            wins = (at < held[1]) | ((at == held[1]) & (best < held[0]))
            entry[stays, p] = np.where(wins, best, held[0])
            distance[stays, p] = np.where(wins, at, held[1])
        if not stays.all():
            far = distances(x[~stays, p], books.entries[p])
            entry[~stays, p] = far.argmin(axis=1)
            distance[~stays, p] = far.min(axis=1)
    return entry, distance


def _rows(column: pa.Array, width: int) -> np.ndarray:
    """A list column whose lists all have ``width`` values, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype="int32") * width), pa.array(values.ravel(), kind))


def whole(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    scaled = np.floor(values.astype("float64") * scale)
    if len(scaled) and np.abs(scaled).max() >= _LARGEST:
        raise ValueError(f"a component is not under {_LARGEST // scale}")
    return scaled.astype("int64")


class _Assignment:
    """Tables (id, label, x, entry, distance) of parts and where they belong."""

    def __init__(self, kept: DataFrame, dims: int, parts: int):
        self.kept, self.dims, self.parts, self.table = kept, dims, parts, None

    def _schema(self) -> T.StructType:
        kinds = {"x": T.IntegerType(), "entry": T.ShortType(), "distance": T.LongType()}
        return T.StructType([*self.kept.schema.fields[:2], *[T.StructField(n, T.ArrayType(k)) for n, k in kinds.items()]])

    def update(self, books: Codebooks, scale: int, name: str) -> None:
        """Write the assignment to the entries of ``books``, from that before, if there is one."""
        dims, parts, first, names = self.dims, self.parts, self.table is None, self._schema().names

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, _STEP):
                    piece = batch.slice(start, _STEP)
                    values = _rows(piece.column(2), dims)
                    flat = whole(values, scale) if first else values.astype("int64")
                    x = flat.reshape(len(flat), parts, dims // parts)
                    if first:
                        entry, distance = assigned(x, books)
                    else:
                        held = [_rows(piece.column(k), parts).astype("int64") for k in (3, 4)]
                        entry, distance = reassigned(x, books, *held)
                    lists = [_lists(flat, pa.int32()), _lists(entry, pa.int16()), _lists(distance, pa.int64())]
                    yield pa.RecordBatch.from_arrays([*piece.columns[:2], *lists], names=names)

        source = self.kept if first else self.table
        self.table = materialize(source.mapInArrow(assign, self._schema()), name)

    def sums(self, entries: int) -> tuple[np.ndarray, np.ndarray]:
        """(parts of each entry, their sums): cells of each task, added up."""
        dims, parts = self.dims, self.parts
        width = dims // parts

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells = np.zeros((parts * entries, width + 1), dtype="int64")
            at = np.arange(parts)[None, :] * entries
            for batch in batches:
                x = _rows(batch.column(0), dims).astype("int64").reshape(-1, width)
                slot = (_rows(batch.column(1), parts).astype("int64") + at).ravel()
                np.add.at(cells, slot, np.concatenate([np.ones((len(x), 1), dtype="int64"), x], axis=1))
            slots = np.flatnonzero(cells[:, 0])
            cell = np.repeat(slots * (width + 1), width + 1) + np.tile(np.arange(width + 1), len(slots))
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(cells[slots].ravel())], names=["cell", "value"])

        added = self.table.select("x", "entry").mapInArrow(add, "cell long, value long").groupBy("cell").agg(F.sum("value").alias("value"))
        cells = np.zeros(parts * entries * (width + 1), dtype="int64")
        for cell, value in added.collect():
            cells[cell] = value
        cells = cells.reshape(parts, entries, width + 1)
        return cells[:, :, 0], cells[:, :, 1:]


def usable(vectors: DataFrame, vector: str, parts: int = PARTS) -> DataFrame:
    """The rows whose vector can be cut into parts and has finite components only."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & (F.size(vector) % parts == 0) & finite)


def encoded_vectors(
    vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", *,
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> tuple[DataFrame, Codebooks | None]:
    """(id, label, entry, distance) per kept row, a list of both for its parts, and the codebooks; None without any row."""
    kept = usable(vectors.select(F.col(id).alias("id"), F.col(label).alias("label"), F.col(vector).alias("x")), "x", parts)
    order = [F.asc_nulls_last("id"), "x"]
    first = kept.orderBy(*order).limit(1).collect()
    if not first:
        kinds = {"entry": "array<smallint>", "distance": "array<bigint>"}
        return kept.select("id", "label", *[F.lit(None).cast(k).alias(n) for n, k in kinds.items()]), None
    dims = len(first[0].x)
    kept = kept.where(F.size("x") == dims)
    seeds = np.array([r.x for r in kept.orderBy(*order).limit(entries).select("x").collect()], dtype="float64")
    book = whole(seeds, scale).reshape(len(seeds), parts, dims // parts).transpose(1, 0, 2).copy()
    books = Codebooks(book, np.zeros(book.shape[:2], dtype=bool))
    state = _Assignment(kept, dims, parts)
    for k in range(rounds):
        state.update(books, scale, f"codes-{k}")
        count, total = state.sums(len(seeds))
        book = np.where(count[:, :, None] > 0, total // np.maximum(count, 1)[:, :, None], books.entries)
        books = Codebooks(book, (book != books.entries).any(axis=2))
    state.update(books, scale, "codes")
    return state.table.select("id", "label", "entry", "distance"), books


def code(entry: str = "entry") -> Column:
    """Indexes in part order, two hexadecimal digits each."""
    return F.array_join(F.transform(entry, lambda e: F.lpad(F.lower(F.hex(e)), 2, "0")), "")


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with ``error``, its distances' sum, and ``label_error``, that of the errors of its label.

    The sums of labels are combined before they are shuffled, and written, so that Spark sees
    whether they are small enough to be broadcast.
    """
    errors = coded.withColumn("error", F.aggregate("distance", F.lit(0).cast("long"), lambda a, d: a + d))
    sums = errors.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return errors.join(materialize(sums, "label-errors"), F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
