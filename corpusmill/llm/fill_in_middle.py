"""Fill-in-middle: documents rearranged so that a model learns to fill a gap from both sides.

A text is cut twice, at ranks drawn from its id.  The units that the ranks count are words with the
white space before them, and white space at the end.  Each text becomes an indexable skip list: its
lowest lane has a link per unit, each express lane above skips to about every fourth node
of the lane below, and every link carries how many units and how many code points it spans.  A cut
descends from the top lane, following links while their units fit into the rank, and has
summed up its code points when it arrives.

A rearranged text is ``<P>`` prefix ``<S>`` suffix ``<M>`` middle (psm), or ``<S>`` suffix ``<P>`` prefix
``<M>`` middle (spm).  A text that holds one of the marks stays plain, so :func:`restored` is exact.

Defined cases: a null or empty text is plain and empty; white space alone is one unit; a null id
draws as an empty one; repeated rows come out alike; other columns are ignored; an empty
table gives an empty result.  Nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.words import mixed

SEED, RATE, SPM_RATE = 42, 50, 80
MARKS = PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

# Lanes end when one has so few links; code points of text that are put out at a time.
_TOP = 4
_STEP = 1 << 22


def unit_widths(text: str) -> np.ndarray:
    """Code points of each unit, in order."""
    if not text:
        return np.empty(0, dtype="int64")
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    space = (codes == 32) | ((codes >= 9) & (codes <= 13))
    ends = np.append(np.flatnonzero(~space[:-1] & space[1:]) + 1, len(codes))
    return np.diff(ends, prepend=0)


class SkipList:
    """Units of given widths, to be found by rank."""

    def __init__(self, widths: np.ndarray):
        self.lanes = [(np.ones(len(widths), dtype="int64"), widths)]
        self.below: list[np.ndarray] = []  # for each express lane, where its links start in the lane below
        nodes = np.arange(len(widths), dtype="uint64")
        while len(self.lanes[-1][0]) > _TOP:
            # A coin for every node and lane; the head is in all lanes.
            up = mixed(nodes * np.uint64(64) + np.uint64(len(self.lanes))) & np.uint64(3) == 0
            up[0] = True
            starts = np.flatnonzero(up)
            self.lanes.append(tuple(np.add.reduceat(w, starts) for w in self.lanes[-1]))
            self.below.append(starts)
            nodes = nodes[starts]

    def __len__(self) -> int:
        return int(self.lanes[-1][0].sum())

    def points_before(self, rank: int) -> int:
        """Code points of the first ``rank`` units."""
        at = reached = points = 0
        for k in range(len(self.lanes) - 1, -1, -1):
            units, widths = self.lanes[k]
            while at < len(units) and reached + units[at] <= rank:
                reached += int(units[at])
                points += int(widths[at])
                at += 1
            if k:
                starts = self.below[k - 1]
                at = int(starts[at]) if at < len(starts) else len(self.lanes[k - 1][0])
        return points


def _draws(seed: int, id: object) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if id is None else id}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in range(0, 16, 4)]


def rearranged(text: str, draws: list[int], rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix, of the middle, output)."""
    widths = unit_widths(text)
    if not text or draws[2] % 100 >= rate or any(mark in text for mark in MARKS):
        return len(widths), "plain", None, None, text
    units = SkipList(widths)
    n = len(units)
    first, last = (units.points_before(rank) for rank in sorted((draws[0] % (n + 1), draws[1] % (n + 1))))
    prefix, middle, suffix = text[:first], text[first:last], text[last:]
    if draws[3] % 100 < spm_rate:
        return n, "spm", first, last - first, "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", first, last - first, "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def fill_in_middle(docs: DataFrame, id: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) per row of ``docs``; of a hundred texts ``rate``
    are rearranged, and of a hundred of these ``spm_rate`` with the suffix in front."""
    schema = T.StructType(
        [
            T.StructField(id, docs.schema[id].dataType),
            T.StructField("n", T.LongType()),
            T.StructField("form", T.StringType()),
            T.StructField("prefix_chars", T.LongType()),
            T.StructField("middle_chars", T.LongType()),
            T.StructField("output", T.StringType()),
        ]
    )
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def rearrange(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, start, size, rows = batch.column(0), 0, 0, []
            for k in range(batch.num_rows):
                value = batch.column(1)[k].as_py() or ""
                rows.append(rearranged(value, _draws(seed, ids[k].as_py()), rate, spm_rate))
                size += len(value)
                if size > _STEP or k + 1 == batch.num_rows:
                    columns = [pa.array(list(c), kind) for c, kind in zip(zip(*rows), kinds)]
                    yield pa.RecordBatch.from_arrays([ids.slice(start, len(rows)), *columns], names=schema.names)
                    start, size, rows = k + 1, 0, []

    return docs.select(id, text).mapInArrow(rearrange, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from."""
    parts = F.split(output, "|".join(MARKS))
    front = lambda *order: F.concat(*[F.get(parts, k) for k in order])
    return F.when(form == "psm", front(1, 3, 2)).when(form == "spm", front(2, 3, 1)).otherwise(output)
