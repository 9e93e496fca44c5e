"""Suffix arrays by induced sorting, and permuted common prefixes, of one bounded shard."""

from __future__ import annotations

import numpy as np

# Places for each symbol from which buckets are worth going through as arrays.
FEW = 200

# Symbols that are compared together.
WIDE = 16


def _types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last is smallest of all."""
    n = len(s)
    out = np.zeros(n, dtype=bool)
    out[-1] = True
    if n > 1:
        step = np.sign(s[1:] - s[:-1])
        # Equal neighbours take the type of the first place behind them where symbols differ.
        at = np.where(step != 0, np.arange(n - 1), n - 1)
        at = np.minimum.accumulate(at[::-1])[::-1]
        out[:-1] = np.append(step, 1)[at] > 0
    return out


def _induced(s: np.ndarray, smaller: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The order of all suffixes that follows from that of ``seeds``, suffix by suffix."""
    n, counts = len(s), np.bincount(s)
    tails = np.cumsum(counts)
    heads = tails - counts
    symbols, is_smaller = s.tolist(), smaller.tolist()
    out = [-1] * n
    free = tails.tolist()
    for i in reversed(seeds.tolist()):
        c = symbols[i]
        free[c] -= 1
        out[free[c]] = i
    free = heads.tolist()
    for at in range(n):
        i = out[at] - 1
        if i >= 0 and not is_smaller[i]:
            c = symbols[i]
            out[free[c]] = i
            free[c] += 1
    free = tails.tolist()
    for at in range(n - 1, -1, -1):
        i = out[at] - 1
        if i >= 0 and is_smaller[i]:
            c = symbols[i]
            free[c] -= 1
            out[free[c]] = i
    return np.array(out, dtype="int64")


def _induced_by_symbol(s: np.ndarray, smaller: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The same, a bucket of suffixes with one first symbol at a time.

    What a bucket induces in itself, by repeats of its symbol, comes in waves.
    """
    counts = np.bincount(s)
    k = len(counts)
    tails = np.cumsum(counts)
    heads = tails - counts
    split = heads + np.bincount(s[~smaller], minlength=k)
    out = np.full(len(s), -1, dtype="int64")

    def placed(suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The suffixes by symbol, each with its symbol and its number among those of it; and how many there are."""
        symbol = s[suffixes]
        by = np.argsort(symbol, kind="stable")
        symbol, times = symbol[by], np.bincount(symbol, minlength=k)
        return suffixes[by], symbol, np.arange(len(by)) - (np.cumsum(times) - times)[symbol], times

    suffixes, symbol, number, times = placed(seeds)
    seeded = tails - times
    out[seeded[symbol] + number] = suffixes

    def grow(taken: np.ndarray, kind: bool) -> None:
        taken = taken[taken > 0] - 1
        taken = taken[smaller[taken] == kind]
        if len(taken):
            suffixes, symbol, number, times = placed(taken)
            if kind:
                out[free[symbol] - 1 - number] = suffixes
                np.subtract(free, times, out=free)
            else:
                out[free[symbol] + number] = suffixes
                np.add(free, times, out=free)

    free = heads.copy()
    for c in range(k):
        done = heads[c]
        while done < free[c]:
            wave, done = out[done : free[c]], free[c]
            grow(wave, False)
        grow(out[seeded[c] : tails[c]], False)
    free = tails.copy()
    for c in range(k - 1, -1, -1):
        done = tails[c]
        while free[c] < done:
            wave, done = out[free[c] : done][::-1], free[c]
            grow(wave, True)
        grow(out[heads[c] : split[c]][::-1], True)
    return out


def _same_as_before(s: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each of some substrings whether it equals the one before it."""
    same = np.append(False, sizes[1:] == sizes[:-1])
    at, k = np.flatnonzero(same), 0
    while len(at):
        equal = s[starts[at] + k] == s[starts[at - 1] + k]
        same[at[~equal]] = False
        k += 1
        at = at[equal & (sizes[at] > k)]
    return same


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Of symbols 0..k that end in the only 0 (Nong, Zhang and Chan, 2009).

    Suffixes are classified, the leftmost-smaller substrings are sorted by inducing
    and named, their order is found recursively if names repeat, and the order of
    all suffixes is induced from it in two linear scans.
    """
    n = len(s)
    if n == 1:
        return np.zeros(1, dtype="int64")
    smaller = _types(s)
    leftmost = smaller.copy()
    leftmost[0] = False
    leftmost[1:] &= ~smaller[:-1]
    induced = _induced_by_symbol if (int(s.max()) + 1) * FEW <= n else _induced
    starts = np.flatnonzero(leftmost)
    ordered = induced(s, smaller, starts)
    ordered = ordered[leftmost[ordered]]
    sizes = np.zeros(n, dtype="int64")
    sizes[starts] = np.append(starts[1:], n - 1) - starts + 1
    names = np.zeros(n, dtype="int64")
    names[ordered] = np.cumsum(~_same_as_before(s, ordered, sizes[ordered])) - 1
    if names[ordered[-1]] + 1 < len(starts):
        ordered = starts[suffix_array(names[starts])]
    return induced(s, smaller, ordered)


def common_prefixes(s: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each rank, the symbols that its suffix shares with the one before it.

    Computed in text order (Kärkkäinen, Manzini and Puglisi, 2009): where a suffix and the
    one before it in the order follow equal symbols, they share one symbol less than those
    at the place before; only the others are compared.
    """
    n = len(s)
    before = np.full(n, -1, dtype="int64")
    before[order[1:]] = order[:-1]
    alike = np.zeros(n, dtype=bool)
    there = np.flatnonzero(before[1:] > 0) + 1
    alike[there] = s[there - 1] == s[before[there] - 1]
    at = np.flatnonzero(~alike & (before >= 0))
    # Ends that are equal to nothing.
    left, right = (np.append(s, np.full(WIDE, end)) for end in (-1, -2))
    shared, step, length = np.zeros(n, dtype="int64"), np.arange(WIDE), 0
    while len(at):
        equal = left[(at + length)[:, None] + step] == right[(before[at] + length)[:, None] + step]
        whole = equal.all(axis=1)
        shared[at] += np.where(whole, WIDE, equal.argmin(axis=1))
        at, length = at[whole], length + WIDE
    # A place that was not compared has what is left of the compared one before it.
    place = np.arange(n)
    return (np.maximum.accumulate(np.where(alike, 0, shared + place)) - place)[order]
