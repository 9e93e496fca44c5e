"""Token-bounded chunks with provenance, row estimates, and text samples."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.records import position
from corpusmill.functions.text import has_text, strip, uuid_from
from corpusmill.functions.tokens import WORDS

# Chunk size, row ceiling, characters of a project sample.
MAX_CHUNK_TOKENS = 512
MAX_ACCEPTED_ROWS = 100_000
SAMPLE_CHARS = 8_000
SAMPLE_JOINER = "\n\n---\n\n"

_SPANS = T.ArrayType(
    T.StructType(
        [
            T.StructField("first", T.IntegerType()),
            T.StructField("n", T.IntegerType()),
            T.StructField("path", T.ArrayType(T.IntegerType())),
        ]
    )
)


def _pack_row(levels, counts, limit: int) -> list[dict]:
    """Greedy runs of body blocks between headings, as 1-based positions."""
    spans: list[dict] = []
    path: list[tuple[int, int]] = []
    used = None
    for at, (level, count) in enumerate(zip(levels, counts), start=1):
        if level:
            path = [(other, i) for other, i in path if other < level] + [(level, at)]
            used = None
        elif used is not None and used + count <= limit:
            used += count
            spans[-1]["n"] += 1
        else:
            used = count
            spans.append({"first": at, "n": 1, "path": [i for _, i in path]})
    return spans


def _pack(limit: int):
    @F.pandas_udf(_SPANS)
    def pack(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for levels, counts in batches:
            yield pd.Series([[] if a is None else _pack_row(a, b, limit) for a, b in zip(levels, counts)])

    # So marked, the optimizer neither repeats nor inlines the call.
    return pack.asNondeterministic()


def chunk_blocks(
    documents: DataFrame, *keep: str, max_tokens: int = MAX_CHUNK_TOKENS, tokenizer=WORDS, blocks: str = "blocks"
) -> DataFrame:
    """One row per chunk: *keep, chunk_no, chunk_id, text, page, heading, headings.

    Blocks under one heading are packed greedily up to ``max_tokens``; a longer
    block is first cut into windows; a heading without body text makes no chunk,
    nor does a document whose blocks are null.
    ``documents`` needs ``document_id`` and ``blocks``.  Everything happens
    within the document's row; only levels and counts visit Python.
    """
    pieces = (
        _word_pieces(documents, keep, max_tokens, tokenizer, blocks)
        if tokenizer is WORDS
        else _arrow_pieces(documents, keep, max_tokens, tokenizer, blocks)
    )
    spans = pieces.withColumn(
        "_spans",
        _pack(max_tokens)(F.transform("_pieces", lambda p: p["level"]), F.transform("_pieces", lambda p: p["tokens"])),
    )

    def chunk(span: Column, number: Column) -> Column:
        inside = F.slice(F.col("_pieces"), span["first"], span["n"])
        headings = F.transform(span["path"], lambda i: F.element_at(F.col("_pieces"), i)["text"])
        pages = F.filter(F.transform(inside, lambda p: p["page"]), lambda page: page.isNotNull())
        return F.struct(
            number.alias("chunk_no"),
            F.array_join(F.transform(inside, lambda p: p["text"]), "\n").alias("text"),
            F.get(pages, F.lit(0)).alias("page"),
            F.get(headings, F.size(headings) - 1).alias("heading"),
            F.coalesce(headings, F.array().cast("array<string>")).alias("headings"),
        )

    # Chunks are made before the rows are multiplied, so that no chunk carries its whole document.
    chunks = spans.select("document_id", *keep, F.explode(F.transform("_spans", chunk)).alias("_chunk"))
    return chunks.select(
        "document_id",
        *keep,
        "_chunk.chunk_no",
        F.concat_ws("-", "document_id", "_chunk.chunk_no").alias("chunk_id"),
        *[f"_chunk.{name}" for name in ("text", "page", "heading", "headings")],
    )


def _piece(block: Column, text: Column, tokens: Column) -> Column:
    return F.struct(
        block["level"].alias("level"), text.alias("text"), block["page"].alias("page"), tokens.alias("tokens")
    )


def _word_pieces(documents: DataFrame, keep, max_tokens: int, tokenizer, blocks: str) -> DataFrame:
    counted = F.transform(blocks, lambda b: _piece(b, b["text"], tokenizer.count(b["text"])))

    def cut(piece: Column) -> Column:
        windows = tokenizer.windows(piece["text"], max_tokens)
        return F.when(
            (piece["level"] == 0) & (piece["tokens"] > max_tokens),
            F.transform(windows, lambda w: _piece(piece, w, tokenizer.count(w))),
        ).otherwise(F.array(piece))

    return documents.select("document_id", *keep, F.flatten(F.transform(counted, cut)).alias("_pieces"))


def _arrow_pieces(documents: DataFrame, keep, max_tokens: int, tokenizer, blocks: str) -> DataFrame:
    """As above for tokenizers on Arrow batches; levels and texts visit Python as arrays, once, and
    no block leaves its document's row."""
    block = F.col(blocks)
    cut = tokenizer.pieces(F.transform(block, lambda b: b["level"]), F.transform(block, lambda b: b["text"]), max_tokens)
    found = documents.select("document_id", *keep, block.alias("_blocks"), cut.alias("_cut"))
    pieces = F.zip_with("_blocks", "_cut", lambda b, c: F.transform(c, lambda w: _piece(b, w["text"], w["tokens"])))
    return found.select("document_id", *keep, F.flatten(pieces).alias("_pieces"))


def token_windows(documents: DataFrame, *keep: str, text: str = "text", size: int = MAX_CHUNK_TOKENS, tokenizer=WORDS) -> DataFrame:
    """Consecutive pieces of at most ``size`` tokens: *keep, window_no, text."""
    return documents.where(has_text(F.col(text))).select(
        *keep, F.posexplode(tokenizer.windows(F.col(text), size)).alias("window_no", "text")
    )


def document_id(project_id: Column, source_hash: Column) -> Column:
    """The same id for the same content of a project, run after run."""
    return uuid_from(project_id, source_hash)


def as_sources(chunks: DataFrame, source_ordinal: str) -> DataFrame:
    """Add ``ord``, the position of a chunk in the whole input."""
    return chunks.withColumn("ord", position(F.col(source_ordinal), F.col("chunk_no")))


def estimate_rows(chunks: DataFrame, structured_rows: DataFrame, capped_at: int = MAX_ACCEPTED_ROWS) -> DataFrame:
    """One row (total_rows, truncated, capped_at) from two counts."""
    parts = chunks.select(F.lit(1).alias("one")).unionByName(structured_rows.select(F.lit(1).alias("one")))
    total = F.count("one")
    return parts.agg(
        total.alias("total_rows"), (total > capped_at).alias("truncated"), F.lit(capped_at).cast("bigint").alias("capped_at")
    )


def sample_text(
    sources: DataFrame, project: str = "project_id", text: str = "text", budget: int = SAMPLE_CHARS, salts: int = 1024
) -> DataFrame:
    """(project, sample, n_chars): the opening of each project's sources.

    Sources are taken in order while characters are left; blank ones use none;
    what is taken is cut to what is left.  Only lengths are shuffled to decide,
    first within ``salts`` slices of a project: a source with ``budget``
    characters before it in its slice has them before it in the project.  So
    no task ever sees all sources of a large project, and at most ``budget``
    sources of each project remain to be joined with their text.
    """
    opening = F.substring(strip(F.col(text)), 1, budget)
    lengths = sources.select(project, "ord", F.length(opening).alias("n")).where("n > 0")
    for keys in ([project, F.pmod(F.xxhash64("ord"), F.lit(salts))], [project]):
        before = F.sum("n").over(W.partitionBy(*keys).orderBy("ord").rowsBetween(W.unboundedPreceding, -1))
        lengths = lengths.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < budget)
    taken = lengths.select("ord", (budget - F.col("before")).cast("int").alias("room"))
    openings = sources.select(project, "ord", opening.alias("_opening"))
    pieces = openings.join(taken, "ord").select(project, "ord", F.substring("_opening", F.lit(1), F.col("room")).alias("piece"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "piece"))), lambda p: p["piece"]), SAMPLE_JOINER)
    return pieces.groupBy(project).agg(joined.alias("sample"), F.sum(F.length("piece")).alias("n_chars"))
