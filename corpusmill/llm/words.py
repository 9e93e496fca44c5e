"""Words and shingles of text batches as 64-bit numbers, and MinHash over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

# Words that a worker remembers the hash of.
_REMEMBERED = 1 << 20
_HASHES: dict[str, int] = {}

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def by_size(batch: pa.RecordBatch, text: int, step: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in pieces whose texts, column number ``text``, have about ``step`` bytes; at
    least one row each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + step, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(words: list[str]) -> np.ndarray:
    new = {w for w in words if w not in _HASHES}
    if len(_HASHES) + len(new) > _REMEMBERED:
        _HASHES.clear()
        new = set(words)
    _HASHES.update((w, xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))) for w in new)
    return np.fromiter(map(_HASHES.__getitem__, words), dtype="uint64", count=len(words))


def runs(values: np.ndarray, length: int) -> np.ndarray:
    """A key for every run of ``length`` values."""
    n = len(values) - length + 1
    if n <= 0:
        return np.empty(0, dtype="uint64")
    # Runs of 1, 2, 4, ... values, put together as the length has them in binary.
    part, span, factor, out, done = values, 1, _MULTIPLIER, np.zeros(n, dtype="uint64"), 0
    with np.errstate(over="ignore"):
        while True:
            if length & span:
                out *= factor
                out += part[done : done + n]
                done += span
            if span * 2 > length:
                return mixed(out)
            part = part[:-span] * factor + part[span:]
            factor, span = factor * factor, span * 2


def runs_within(values: np.ndarray, lengths: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the runs of ``length`` values within each of the sequences that ``values`` strings
    together, and how many each sequence has; a shorter sequence that has values is one run."""
    counts = np.where(lengths >= length, lengths - length + 1, np.minimum(lengths, 1))
    starts = np.cumsum(lengths) - lengths
    at = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    padded = np.concatenate([values, np.zeros(length, dtype="uint64")])
    out = runs(padded, length)[at]
    first = np.cumsum(counts) - counts
    for k in np.flatnonzero((lengths < length) & (lengths > 0)):
        short = values[starts[k] : starts[k] + lengths[k]]
        out[first[k]] = runs(short, len(short))[0]
    return out, counts


def word_shingles(text: str | None, length: int = 5) -> np.ndarray:
    """Sorted distinct keys of the word runs; a shorter text that has words is one run."""
    words = (text or "").split()
    if not words:
        return np.empty(0, dtype="uint64")
    return np.unique(runs(word_hashes(words), min(length, len(words))))


def char_shingles(text: str | None, length: int = 8) -> np.ndarray:
    """Sorted distinct keys of the character runs of the text in lower case with white space
    collapsed; a shorter text that has characters is one run."""
    text = " ".join((text or "").lower().split())
    if not text:
        return np.empty(0, dtype="uint64")
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype("uint64")
    return np.unique(runs(codes, min(length, len(codes))))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets; two empty sets have nothing in common."""
    if not len(a) or not len(b):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def minima(values: np.ndarray, counts: np.ndarray, count: int) -> np.ndarray:
    """(sets, count) MinHash values, 32 bits each, of the non-empty sets that ``values`` strings together."""
    starts = np.cumsum(counts) - counts
    values = (values >> np.uint64(32)).astype("uint32")
    draw = np.random.default_rng(20240229)
    multipliers = draw.integers(0, 1 << 31, count, dtype="uint32") * np.uint32(2) + np.uint32(1)
    offsets = draw.integers(0, 1 << 32, count, dtype="uint32")
    out, x = np.empty((count, len(counts)), dtype="uint32"), np.empty_like(values)
    with np.errstate(over="ignore"):
        for k in range(count):
            np.multiply(values, multipliers[k], out=x)
            np.add(x, offsets[k], out=x)
            out[k] = np.minimum.reduceat(x, starts)
    return out.T


def set_key(values: bytes) -> tuple[int, int]:
    """128 bits that stand for some bytes, as two signed numbers."""
    high, low = divmod(xxhash.xxh3_128_intdigest(values), 1 << 64)
    return high - (1 << 63), low - (1 << 63)
