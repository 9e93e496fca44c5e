"""MinHash band keys, computed on Arrow batches.

The published scheme: a token's 32-bit value is the first four bytes of its
SHA-1, little endian; permutation *i* maps ``v`` to
``((a_i * v + b_i) mod 2**64 mod (2**61 - 1)) & (2**32 - 1)``; a signature keeps
the minimum over the token set.  Bands are runs of signature rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Defaults that decide which records count as near duplicates.
THRESHOLD = 0.85
NUM_PERM = 128
SEED = 1
PRIME = (1 << 61) - 1
MAX_HASH = (1 << 32) - 1

# Token occurrences per vectorized step, token values a task remembers, and bytes of text that it has as
# Python strings at a time, since an Arrow batch holds thousands of texts of any length.
_STEP = 1 << 14
_REMEMBERED = 1 << 17
_SLICE = 1 << 22


@lru_cache(maxsize=8)
def permutations(num_perm: int = NUM_PERM) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and offsets, drawn pairwise from the seeded generator."""
    draw = np.random.RandomState(SEED)
    pairs = [
        (draw.randint(1, PRIME, dtype=np.uint64), draw.randint(0, PRIME, dtype=np.uint64)) for _ in range(num_perm)
    ]
    table = np.array(pairs, dtype=np.uint64)
    return table[:, 0].copy(), table[:, 1].copy()


@lru_cache(maxsize=32)
def band_shape(threshold: float = THRESHOLD, num_perm: int = NUM_PERM) -> tuple[int, int]:
    """(bands, rows) with the least equally weighted sum of the false-positive
    and false-negative area of the curve ``1 - (1 - s**rows)**bands``."""
    step = 0.001
    low = np.arange(0.0, threshold, step) + step / 2
    high = np.arange(threshold, 1.0, step) + step / 2
    best, shape = float("inf"), (1, num_perm)
    for bands in range(1, num_perm + 1):
        for rows in range(1, num_perm // bands + 1):
            false_hits = float((1 - (1 - low**rows) ** bands).sum()) * step
            misses = float(((1 - high**rows) ** bands).sum()) * step
            if 0.5 * false_hits + 0.5 * misses < best:
                best, shape = 0.5 * false_hits + 0.5 * misses, (bands, rows)
    return shape


def _token_value(token: str) -> int:
    return int.from_bytes(hashlib.sha1(token.encode("utf-8", "surrogatepass")).digest()[:4], "little")


def _minima(values: np.ndarray, starts: np.ndarray, num_perm: int) -> np.ndarray:
    """(texts, permutations) minima of permuted values; ``starts`` opens each text."""
    multipliers, offsets = permutations(num_perm)
    prime, mask, bits, one = np.uint64(PRIME), np.uint64(MAX_HASH), np.uint64(61), np.uint64(1)
    x, high = np.empty_like(values), np.empty_like(values)
    out = np.empty((num_perm, len(starts)), dtype=np.uint64)
    for i in range(num_perm):
        np.multiply(values, multipliers[i], out=x)
        np.add(x, offsets[i], out=x)
        # x mod (2**61 - 1) by folding the high bits twice; of the second fold
        # only its effect on the low 32 bits is needed.
        np.right_shift(x, bits, out=high)
        np.bitwise_and(x, prime, out=x)
        np.add(x, high, out=x)
        np.add(x, one, out=high)
        np.right_shift(high, bits, out=high)
        np.add(x, high, out=x)
        np.bitwise_and(x, mask, out=x)
        out[i] = np.minimum.reduceat(x, starts)
    return out.T


def signatures(texts: list[str | None], num_perm: int = NUM_PERM) -> np.ndarray:
    """One row of ``num_perm`` minima per text; no tokens gives the top value."""
    out = np.full((len(texts), num_perm), MAX_HASH, dtype=np.uint64)
    value_of: dict[str, int] = {}
    rows: list[int] = []
    starts: list[int] = []
    values: list[int] = []
    for i, text in enumerate(texts):
        tokens = set(text.split()) if text else set()
        if tokens:
            value_of.update((t, _token_value(t)) for t in tokens.difference(value_of))
            rows.append(i)
            starts.append(len(values))
            values.extend(map(value_of.__getitem__, tokens))
        if rows and (len(values) >= _STEP or i == len(texts) - 1):
            out[rows] = _minima(np.array(values, dtype=np.uint64), np.array(starts), num_perm)
            rows, starts, values = [], [], []
            if len(value_of) > _REMEMBERED:
                value_of.clear()
    return out


def slices(texts: pa.Array, size: int = _SLICE) -> Iterator[pa.Array]:
    """``texts`` in runs of some ``size`` bytes; one longer text is a run by itself."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype("int64"))
    start = 0
    while start < len(texts):
        done = ends[start - 1] if start else 0
        stop = max(int(np.searchsorted(ends, done + size, side="right")), start + 1)
        yield texts.slice(start, stop - start)
        start = stop


def _signed(texts: pa.Array, num_perm: int) -> Iterator[np.ndarray]:
    for part in slices(texts):
        yield signatures(part.to_pylist(), num_perm)


def signatures_of(text: Column, num_perm: int = NUM_PERM) -> Column:
    """ARRAY<BIGINT> signature of the text's token set."""

    @F.arrow_udf("array<bigint>")
    def signed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            table = np.concatenate([np.empty((0, num_perm), dtype="int64"), *[t.astype("int64") for t in _signed(batch, num_perm)]])
            yield pa.ListArray.from_arrays(np.arange(len(table) + 1, dtype="int32") * num_perm, table.ravel())

    return signed.asNondeterministic()(text)


def band_keys(text: Column, threshold: float = THRESHOLD, num_perm: int = NUM_PERM) -> Column:
    """ARRAY<BINARY> with one 16-byte key per band of the text's token set."""
    bands, rows = band_shape(threshold, num_perm)

    @F.arrow_udf("array<binary>")
    def keys(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found: list[bytes] = []
            for table in _signed(batch, num_perm):
                table = table[:, : bands * rows].astype(">u4").reshape(-1, rows)
                found += [hashlib.md5(band.tobytes()).digest() for band in table]
            yield pa.ListArray.from_arrays(np.arange(len(batch) + 1, dtype="int32") * bands, pa.array(found, pa.binary()))

    # So marked, the optimizer neither repeats nor inlines the call.
    return keys.asNondeterministic()(text)
