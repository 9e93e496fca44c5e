"""Fuzzy line dedup by MinHash: of every group of near-equal lines one stays.

Lines are compared in lower case with white space collapsed, as sets of character
runs.  Equal lines are one row from the start.  A distinct line has ``BANDS`` keys, each of
``ROWS`` MinHash values: two lines with a similarity of 0.8 share a key with a probability of
over 0.99.  Lines that share a key are verified by exact Jaccard similarity, the
verified pairs are joined up to components, and of each component the first line (least
document id, then least line number) stays.

Defined cases: lines without a word are not compared and stay; a null text stays null; ids
are expected to be unique, rows that share an id are decided together (line n of each
goes if line n of one goes); rows without an id are left as they are; all columns
are kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.links import key_groups, marked, neighbouring_keys
from corpusmill.llm.words import char_shingles, minima, mixed, runs_within
from corpusmill.session import materialize

SIMILARITY = 0.8
SHINGLE = 8
BANDS, ROWS = 10, 4

# Characters of lines that leave as one batch, and of lines that are hashed together: few enough for a processor's cache.
_STEP, _HASHED = 1 << 20, 1 << 15


def _place(id: Column, line: Column) -> Column:
    """Document and line as one number in their order; any 64-bit id fits."""
    return (id.cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(11,0)") + line.cast("decimal(10,0)")).cast("decimal(33,0)")


def _document(place: Column) -> Column:
    return F.floor(place / F.lit(1 << 32).cast("decimal(11,0)")).cast("long")


def _collapsed(line: str) -> str:
    # Of all white space only the space is printable.
    return line.strip() if "  " not in line and line.isprintable() else " ".join(line.split())


def _lines(text: str | None) -> list[tuple[int, str]]:
    """(number, normalized line) of the lines that have a word."""
    rows = ((k, _collapsed(line)) for k, line in enumerate((text or "").lower().split("\n")))
    return [(k, line) for k, line in rows if line]


def _band_keys(lines: list[str], bands: int) -> np.ndarray:
    """(bands, lines) keys; lines are hashed a few at a time."""
    lengths = np.array([len(line) for line in lines])
    ends = np.cumsum(lengths)
    keys, start = np.empty((bands, len(lines)), dtype="uint64"), 0
    while start < len(lines):
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + _HASHED, side="right")))
        codes = np.frombuffer("".join(lines[start:stop]).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype("uint64")
        shingles, counts = runs_within(codes, lengths[start:stop], SHINGLE)
        values = minima(shingles, counts, bands * ROWS).astype("uint64").T.reshape(bands, ROWS, stop - start)
        key = np.repeat(np.arange(bands, dtype="uint64")[:, None], stop - start, axis=1)
        for r in range(ROWS):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + values[:, r])
        keys[:, start:stop] = key
        start = stop
    return keys.view("int64")


def _line_rows(docs: DataFrame, id: str, text: str, bands: int) -> DataFrame:
    """(id, line, h1, h2, k0, ...): a line's 128-bit key and its band keys, none if ``bands`` is 0."""
    names = ["h1", "h2", *[f"k{b}" for b in range(bands)]]
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("line", T.LongType()), *[T.StructField(n, T.LongType()) for n in names]])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush():
            digests = np.frombuffer(b"".join(keys), dtype=">i8").astype("int64").reshape(-1, 2)
            columns = [np.array(owners, dtype="int64"), np.array(numbers, dtype="int64"), digests[:, 0], digests[:, 1]]
            if bands:
                columns += list(_band_keys(lines, bands))
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=schema.names)

        owners, numbers, keys, lines, size = [], [], [], [], 0
        for batch in batches:
            for identifier, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for number, line in _lines(value):
                    owners.append(identifier)
                    numbers.append(number)
                    keys.append(xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass")))
                    if bands:
                        lines.append(line)
                        size += len(line)
                    if size > _STEP or len(owners) > 100_000:
                        yield flush()
                        owners, numbers, keys, lines, size = [], [], [], [], 0
        if owners:
            yield flush()

    return docs.select(F.col(id).cast("long"), text).where(F.col(id).isNotNull()).mapInArrow(keyed, schema)


def _texts_of_lines(docs: DataFrame, wanted: DataFrame, id: str, text: str) -> DataFrame:
    """(node, text) of the wanted lines (node, id, line), which are read twice."""
    numbers = wanted.groupBy("id").agg(F.collect_set(F.struct("line", "node")).alias("lines"))
    node = wanted.schema["node"].dataType
    schema = T.StructType([T.StructField("node", node), T.StructField("text", T.StringType())])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, lines = [], []
            for value, want in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = (value or "").split("\n")
                for w in want:
                    if w["line"] < len(rows):
                        nodes.append(w["node"])
                        lines.append(rows[w["line"]])
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(lines, pa.string())], names=schema.names)

    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    rows = marked(rows, wanted, "id").where("_likely")
    return rows.join(numbers, "id").select("text", "lines").mapInArrow(pick, schema)


def repeated_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(id, lines): the numbers of the lines that go, for documents that lose any."""
    distinct = _line_rows(docs, id, text, BANDS).groupBy("h1", "h2")
    distinct = distinct.agg(
        F.min(_place(F.col("id"), F.col("line"))).alias("place"), F.count("*").alias("n"), *[F.min(f"k{b}").alias(f"k{b}") for b in range(BANDS)]
    )
    # Written once, so that the numbers given to the distinct lines stay what they are.
    distinct = materialize(distinct.withColumn("node", F.monotonically_increasing_id()), "distinct-lines")
    members = distinct.select("node", F.explode(F.array(*[f"k{b}" for b in range(BANDS)])).alias("key"))
    members = materialize(neighbouring_keys(members, distinct.count() * BANDS), "line-keys")
    wanted = members.select("node").distinct()
    place = F.col("place")
    wanted = wanted.join(distinct, "node").select("node", _document(place).alias("id"), F.pmod(place, F.lit(1 << 32)).cast("long").alias("line"))
    wanted = materialize(wanted, "lines-wanted")
    texts = materialize(_texts_of_lines(docs, wanted, id, text), "line-texts")
    shingles = lambda line: char_shingles(line, SHINGLE)
    groups = key_groups(members, texts, shingles, similarity)
    grouped = distinct.select("node", "h1", "h2", "place", "n").join(groups, "node", "left")
    firsts = grouped.where("component IS NOT NULL").groupBy("component").agg(F.min("place").alias("first"))
    # Distinct lines of which some occurrence goes, with the place that stays.
    decided = (
        grouped.join(firsts, "component", "left")
        .where("component IS NOT NULL OR n > 1")
        .select("h1", "h2", F.coalesce("first", "place").alias("stays"))
    )
    decided = materialize(decided, "decided-lines")
    lines = marked(_line_rows(docs, id, text, 0), decided, "h1", "h2").where("_likely").drop("_likely")
    gone = lines.join(decided, ["h1", "h2"]).where(_place(F.col("id"), F.col("line")) != F.col("stays"))
    return gone.groupBy("id").agg(F.collect_set("line").alias("lines"))


def unused(name: str, columns: list[str]) -> str:
    """``name``, with underscores in front until no column has it."""
    while name.lower() in [c.lower() for c in columns]:
        name = f"_{name}"
    return name


def without_lines(docs: DataFrame, gone: DataFrame, id: str = "doc_id", text: str = "text", n_lines: str = "_n_lines", n_gone: str = "_n_gone") -> DataFrame:
    """``docs`` with the lines taken out of the text, and (n_lines, n_gone) added, which must be new names.

    The list of a document is no longer than the document, which is a row as well.
    """
    if {n_lines.lower(), n_gone.lower()} & {c.lower() for c in docs.columns}:
        raise ValueError(f"documents have a column {n_lines} or {n_gone} already")
    key, taken = unused("_id", docs.columns), unused("_lines", docs.columns)
    lists = materialize(gone, "lines-gone").select(F.col("id").alias(key), F.col("lines").alias(taken))
    # Documents that surely keep all lines stay out of the shuffle.
    own, likely = unused("_own", docs.columns), unused("_likely", docs.columns)
    rows = marked(docs.withColumn(own, F.col(id).cast("long")), lists.select(F.col(key).alias(own)), own, name=likely)
    joined = rows.where(likely).join(lists, F.col(own) == F.col(key), "left").select(*docs.columns, taken)
    whole = rows.where(~F.col(likely)).select(*docs.columns, F.size(F.split(text, "\n")).cast("long").alias(n_lines), F.lit(0).cast("long").alias(n_gone))
    whole = whole.withColumn(n_lines, F.when(F.col(text).isNull(), 0).otherwise(F.col(n_lines)).cast("long"))
    schema = T.StructType([*docs.schema.fields, T.StructField(n_lines, T.LongType()), T.StructField(n_gone, T.LongType())])
    at = docs.columns.index(text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, total, removed = [], [], []
            for value, numbers in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                lines = [] if value is None else value.split("\n")
                if numbers:
                    out = set(numbers)
                    kept = [line for k, line in enumerate(lines) if k not in out]
                    value = None if value is None else "\n".join(kept)
                    removed.append(len(lines) - len(kept))
                else:
                    removed.append(0)
                texts.append(value)
                total.append(len(lines))
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(removed, pa.int64())], names=schema.names)

    return joined.mapInArrow(cut, schema).unionByName(whole)


def dedup_lines(
    docs: DataFrame, id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, n_lines: str = "_n_lines", n_gone: str = "_n_gone"
) -> DataFrame:
    """``docs`` with near-equal lines taken out but for one of each group, and (n_lines, n_gone)."""
    return without_lines(docs, repeated_lines(docs, id, text, similarity), id, text, n_lines, n_gone)
