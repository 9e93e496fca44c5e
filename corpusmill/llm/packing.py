"""Concatenate and cut: documents as one stream of tokens, cut into fixed windows.

The first pass tokenizes and writes each partition's documents with their token
ids and their place in the partition.  The partitions' totals, one number each,
are summed up to global offsets.  The second pass adds them and cuts every
document at the multiples of the window: a document over such a boundary gives one
piece on either side.  Nothing is shuffled, and every window but the last is full.

Defined cases: a null or empty text is the end token alone; repeated rows are packed
each by itself; other columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.words import by_size
from corpusmill.session import materialize

WINDOW = 4096
END_ID = 2

# White space that Python and the tokenizers may not agree about; such texts are tokenized in one go.
_ODD_SPACE = "[\x1c-\x1f\x85\xa0 ᠎ -​    　﻿]"

# Words that a task remembers, and bytes of text that it tokenizes at a time.
_REMEMBERED = 1 << 19
_STEP = 1 << 23

Encoder = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def _ids_of(tokenizer, texts: list[str], dtype: str) -> list[np.ndarray]:
    return [np.array(e.ids, dtype=dtype) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _letters_encoder(tokenizer, dtype: str) -> Callable[[list[str]], list[bytes]]:
    """words of letters -> id bytes of each.

    Where the vocabulary marks the ends of words, many words are encoded as one text and cut after each
    such mark: as many marks as words leave one for each.
    """
    suffix = getattr(tokenizer.model, "end_of_word_suffix", None)
    ends = np.zeros(tokenizer.get_vocab_size(), dtype=bool)
    if suffix:
        ends[[i for token, i in tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
    width = np.dtype(dtype).itemsize

    def encode(words: list[str]) -> list[bytes]:
        if not suffix:
            return [x.tobytes() for x in _ids_of(tokenizer, words, dtype)]
        out: list[bytes] = []
        groups = [words[k : k + 200] for k in range(0, len(words), 200)]
        for group, ids in zip(groups, _ids_of(tokenizer, [" ".join(g) for g in groups], dtype)):
            stops = (np.flatnonzero(ends[ids]) + 1) * width
            if len(stops) != len(group):
                out += [x.tobytes() for x in _ids_of(tokenizer, group, dtype)]
                continue
            data, start = ids.tobytes(), 0
            for stop in stops.tolist():
                out.append(data[start:stop])
                start = stop
        return out

    return encode


def split_tokenizer(path: str, dtype: str) -> Encoder:
    """texts -> (all ids, ids of each text), for tokenizers that drop white space and never merge across it.

    The words of the texts are encoded as a dictionary, so that each distinct one is tokenized once,
    and the ids are put together by position.  Some words stay known until the task ends.  A word and the
    punctuation mark after it are looked up apart where the tokenizer parts them.
    """
    from tokenizers import Tokenizer

    # A task has one core.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(path)
    letters = _letters_encoder(tokenizer, dtype)
    width = np.dtype(dtype).itemsize
    pieces = tokenizer.pre_tokenizer.pre_tokenize_str if tokenizer.pre_tokenizer else lambda text: [(text, (0, len(text)))]
    marks = {m for m in ".,;:!?" if [at for _, at in pieces(f"ab{m}")] == [(0, 2), (2, 3)]}
    known: dict[str, bytes] = {}

    def learn(words: list[str]) -> list[bytes]:
        if len(known) > _REMEMBERED:
            known.clear()
        whole, parted = {}, []
        for word in words:
            if word not in known:
                if word[-1:] in marks and word[:-1].isalpha():
                    parted.append(word)
                    whole[word[:-1]] = whole[word[-1]] = None
                else:
                    whole[word] = None
        new = [w for w in whole if w not in known]
        plain, rest = [w for w in new if w.isalpha()], [w for w in new if not w.isalpha()]
        for some, run in ((plain, letters), (rest, lambda part: [x.tobytes() for x in _ids_of(tokenizer, part, dtype)])):
            for start in range(0, len(some), 20_000):
                part = some[start : start + 20_000]
                known.update(zip(part, run(part)))
        known.update((w, known[w[:-1]] + known[w[-1]]) for w in parted)
        return [known[w] for w in words]

    def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = pc.match_substring_regex(texts, _ODD_SPACE)
        whole = {k: _ids_of(tokenizer, [texts[k].as_py()], dtype)[0] for k in np.flatnonzero(odd.to_numpy(zero_copy_only=False))}
        rows = pc.ascii_split_whitespace(pc.if_else(odd, "", texts) if whole else texts)
        words = rows.flatten().dictionary_encode()
        at = words.indices.to_numpy()
        found = learn(words.dictionary.to_pylist())
        lengths = np.array([len(x) // width for x in found], dtype="int64")
        flat = np.frombuffer(b"".join(found), dtype=dtype)
        n = lengths[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat((np.cumsum(lengths) - lengths)[at] - ends[:-1], n) + np.arange(ends[-1])]
        ends = ends[rows.offsets.to_numpy()]
        counts = np.diff(ends)
        if whole:
            parts = [whole.get(k, ids[ends[k] : ends[k + 1]]) for k in range(len(counts))]
            ids, counts = np.concatenate(parts), np.array([len(x) for x in parts], dtype="int64")
        return ids, counts

    return encode


def whole_tokenizer(path: str, dtype: str) -> Encoder:
    """texts -> (all ids, ids of each text), for any tokenizer of the library."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = _ids_of(tokenizer, texts.to_pylist(), dtype)
        return np.concatenate([*found, np.empty(0, dtype=dtype)]), np.array([len(x) for x in found], dtype="int64")

    return encode


def tokenized(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", end_id: int = END_ID, dtype: str = "<u2", load=split_tokenizer) -> DataFrame:
    """Written table (doc_id, part, at, n, ids): a document's ids with the end token, and
    the tokens before it in its partition.  ``dtype`` must hold the largest id."""
    schema = T.StructType(
        [
            T.StructField(id, docs.schema[id].dataType),
            T.StructField("part", T.IntegerType()),
            T.StructField("at", T.LongType()),
            T.StructField("n", T.LongType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )
    width = np.dtype(dtype).itemsize

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, part, at = load(tokenizer, dtype), TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in by_size(batch, 1, _STEP):
                ids, n = run(pc.fill_null(piece.column(1).cast(pa.string()), ""))
                ids = np.insert(ids, np.cumsum(n), end_id).astype(dtype)
                n = n + 1
                ends = np.concatenate([[0], np.cumsum(n)])
                data = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((ends * width).astype("int32")), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array([part] * len(n), pa.int32()), pa.array(at + ends[:-1]), pa.array(n), data],
                    names=schema.names,
                )
                at += int(ends[-1])

    return materialize(docs.select(id, text).mapInArrow(encode, schema), "tokens")


def concat_and_cut(tokens: DataFrame, window: int = WINDOW, id: str = "doc_id", dtype: str = "<u2") -> DataFrame:
    """One row per piece of the tables that :func:`tokenized` writes:
    (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).  ``offset`` runs from 0
    without a gap; a piece's ids are those from ``start`` on."""
    before, total = {}, 0
    for part, n in sorted(tuple(r) for r in tokens.groupBy("part").agg(F.sum("n")).collect()):
        before[part], total = total, total + n
    names = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    schema = T.StructType([tokens.schema[id], *[T.StructField(name, T.LongType()) for name in names]])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for k, (part, at, n, ids) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("part", "at", "n", "ids")])):
                ids, at, start = np.frombuffer(ids, dtype=dtype).astype("<u4"), before[part] + at, 0
                while start < n:
                    length = min(n - start, window - (at + start) % window)
                    crc = zlib.crc32(ids[start : start + length].tobytes())
                    out.append((start, length, crc, n, (at + start) // window, (at + start) % window))
                    rows.append(k)
                    start += length
            columns = np.array(out, dtype="int64").reshape(-1, len(names)).T
            yield pa.RecordBatch.from_arrays(
                [batch.column(id).take(pa.array(rows, pa.int64())), *[pa.array(np.ascontiguousarray(c)) for c in columns]],
                names=schema.names,
            )

    return tokens.select(id, "part", "at", "n", "ids").mapInArrow(cut, schema)
