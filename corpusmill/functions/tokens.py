"""Tokenizers, as objects that turn a text column into counts and windows."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.text import strip, word_count, word_spans

# Characters of the texts that a task turns into windows at once, characters of the words
# whose tokens it remembers, words that it tokenizes as one text.
PORTION = 1 << 20
REMEMBERED = 6 << 20
TOGETHER = 200

# White space of Arrow's split, and the splits of tokenizers that never have it in a token.
_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_SPLITS = {r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}


class WordTokenizer:
    """Whitespace words, as native expressions."""

    def count(self, text: Column) -> Column:
        return word_count(text)

    def windows(self, text: Column, size: int) -> Column:
        """Array of consecutive pieces of at most ``size`` tokens, whitespace
        inside a piece untouched."""

        def cut(spans: Column) -> Column:
            last = F.greatest(F.ceil(F.size(spans) / size) - 1, F.lit(0)).cast("int")
            return F.transform(
                F.sequence(F.lit(0), last), lambda i: strip(F.array_join(F.slice(spans, i * size + 1, F.lit(size)), ""))
            )

        # The one-element array binds the spans, so that they are found once.
        return F.flatten(F.transform(F.array(word_spans(text)), cut))


def portions(texts: pd.Series, size: int = PORTION) -> Iterator[pd.Series]:
    """A batch in runs of texts of about ``size`` characters together, so that what a task holds of
    its output doesn't grow with the rows of a batch; a longer text is alone or the last of its run."""
    length = texts.str.len().fillna(0)
    for _, part in texts.groupby((length.cumsum() - length) // size):
        yield part


Counts = Callable[[list[str]], list[int]]
Pieces = Callable[..., list[tuple[list[str], list[int]]]]


def _counted(counts: Counts, cut: Callable[[str, int], list[str]]) -> tuple[Counts, Pieces]:
    """``counts``, and the pieces that ``cut`` makes, counted if that is wanted."""

    def pieces(texts: list[str], size: int, counted: bool = True) -> list[tuple[list[str], list[int]]]:
        windows = [cut(t, size) for t in texts]
        tokens = iter(counts([w for some in windows for w in some]) if counted else ())
        return [(some, [next(tokens) for _ in some] if counted else []) for some in windows]

    return counts, pieces


class ArrowTokenizer:
    """Any ``encode(text) -> ids`` / ``decode(ids) -> text`` pair, on Arrow batches.

    ``load`` is called once per task and returns the pair, so that nothing heavy
    is pickled with the plan.
    """

    def __init__(self, load: Callable[[], tuple[Callable[[str], Sequence[int]], Callable[[Sequence[int]], str]]]):
        self._load = load

    def open(self) -> tuple[Counts, Pieces]:
        """For a task: the token counts of some texts, and the pieces of some texts with their counts."""
        encode, decode = self._load()

        def cut(text: str, size: int) -> list[str]:
            ids = list(encode(text))
            return [decode(ids[i : i + size]) for i in range(0, len(ids), size)] or [decode(ids)]

        return _counted(lambda texts: [len(encode(t)) for t in texts], cut)

    def count(self, text: Column) -> Column:
        open = self.open

        @F.pandas_udf("int")
        def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            numbers, _ = open()
            for batch in batches:
                there = batch.notna()
                found = iter(numbers(batch[there].tolist()))
                yield pd.Series([next(found) if known else None for known in there], dtype="Int32")

        return counts(text)

    def windows(self, text: Column, size: int) -> Column:
        open = self.open

        @F.pandas_udf("array<string>")
        def windows(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            _, cuts = open()
            for batch in batches:
                for part in portions(batch):
                    yield pd.Series([row for row, _ in cuts([t or "" for t in part], size, counted=False)], dtype=object)

        return windows(text)

    def pieces(self, levels: Column, texts: Column, size: int) -> Column:
        """For arrays of levels and texts, an array of (text, tokens) per text: itself, or its windows
        if its level is 0 and it has more than ``size`` tokens; none for a null text."""
        open = self.open

        def of_rows(levels: pa.ListArray, texts: pa.ListArray, numbers, cuts) -> pa.ListArray:
            flat = texts.flatten().to_numpy(zero_copy_only=False).tolist()
            bodies = [not level for level in levels.flatten().to_pylist()]
            there = [t for t in flat if t is not None]
            counted = iter(numbers(there))
            row = [(t, None if t is None else next(counted)) for t in flat]
            long = [body and n is not None and n > size for body, (_, n) in zip(bodies, row)]
            cut = iter(cuts([t for t, many in zip(flat, long) if many], size))
            parts, tokens, ends = [], [], [0]
            for many, (text, n) in zip(long, row):
                if text is not None:
                    windows, each = next(cut) if many else ([text], [n])
                    parts += windows
                    tokens += each
                ends.append(len(parts))
            pairs = pa.StructArray.from_arrays([pa.array(parts, pa.string()), pa.array(tokens, pa.int32())], names=["text", "tokens"])
            blocks = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
            rows = np.cumsum([0, *pc.fill_null(pc.list_value_length(texts), 0).to_pylist()])
            return pa.ListArray.from_arrays(pa.array(rows, pa.int32()), blocks, mask=texts.is_null())

        @F.arrow_udf("array<array<struct<text: string, tokens: int>>>")
        def pieces(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            numbers, cuts = open()
            for level, text in batches:
                ends = np.cumsum([0, *pc.fill_null(pc.list_value_length(text), 0).to_pylist()])
                chars = np.cumsum([0, *pc.fill_null(pc.utf8_length(text.flatten()), 0).to_pylist()])[ends]
                stops = np.flatnonzero(np.diff(chars[:-1] // PORTION)) + 1
                for a, b in zip([0, *stops], [*stops, len(text)]):
                    yield of_rows(level[a:b], text[a:b], numbers, cuts)

        return pieces.asNondeterministic()(levels, texts)


class SubwordTokenizer(ArrowTokenizer):
    """A public tokenizer, from its ``tokenizers`` file, which every executor has to reach.

    Pieces are cut out of the text where their first token begins, so that together they are the
    text, to the last space; a character that two tokens share goes to the later piece.
    Special tokens are not added.  Texts go through the tokenizer many at a time, on one thread,
    in steps of ``step`` characters, which bounds the offsets a task holds.  Where no token has white
    space in it, a task tokenizes each distinct word once and adds up.
    """

    def __init__(self, file: str, step: int = 1 << 20):
        self._file, self._step = file, step

    def open(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(self._file)
        tokenizer.no_padding()
        tokenizer.no_truncation()
        return _by_words(tokenizer, self._step) if _parts_at_space(tokenizer) else _by_texts(tokenizer, self._step)


def _steps(texts: list[str], size: int) -> Iterator[list[str]]:
    """The texts in runs of about ``size`` characters."""
    together, length = [], 0
    for text in texts:
        together.append(text)
        length += len(text)
        if length >= size:
            yield together
            together, length = [], 0
    yield together


def _by_texts(tokenizer, step: int):
    """Counts and cuts for any tokenizer of the library."""

    def counts(texts: list[str]) -> list[int]:
        return [len(e) for some in _steps(texts, step) for e in tokenizer.encode_batch(some, add_special_tokens=False)]

    def cut(text: str, size: int) -> list[str]:
        offsets = tokenizer.encode(text, add_special_tokens=False).offsets
        starts = [0, *[offsets[i][0] for i in range(size, len(offsets), size)], len(text)]
        return [text[a:b] for a, b in zip(starts, starts[1:])]

    return _counted(counts, cut)


def _parts_at_space(tokenizer) -> bool:
    """Whether the tokens of a text are surely those of its words, one word after the other: only
    for forms of tokenizers that are known to work character by character and to drop white space."""

    def steps(part) -> list[dict]:
        whole = json.loads(part.__getstate__()) if part is not None else {"type": "Sequence"}
        return (whole.get("normalizers") or whole.get("pretokenizers") or []) if whole["type"] == "Sequence" else [whole]

    def is_local(step: dict) -> bool:
        return step["type"] in ("NFC", "Lowercase") or (step["type"], step.get("pattern"), step.get("content")) == ("Replace", {"Regex": r"\s+"}, " ")

    def drops_space(step: dict) -> bool:
        split = step["type"] == "Split" and step["behavior"] == "Removed" and step["invert"]
        return step["type"] in ("Whitespace", "WhitespaceSplit") or bool(split) and step["pattern"].get("Regex") in _SPLITS

    added = tokenizer.get_added_tokens_decoder().values()
    return (
        all(map(is_local, steps(tokenizer.normalizer)))
        and any(map(drops_space, steps(tokenizer.pre_tokenizer)[:1]))
        and tokenizer.post_processor is None
        and not getattr(tokenizer.model, "dropout", None)
        and not any(t.lstrip or t.rstrip or t.single_word or any(c.isspace() for c in t.content) for t in added)
    )


def _by_words(tokenizer, step: int) -> tuple[Counts, Pieces]:
    """The same for tokenizers that part at white space: words stay known to the task, up to REMEMBERED characters."""
    parted = tokenizer.pre_tokenizer.pre_tokenize_str
    marks = {m for m in ".,;:!?" if [at for _, at in parted(f"ab{m}")] == [(0, 2), (2, 3)]}
    known: dict[str, int] = {"": 0}
    size_known = 0

    def is_plain(word: str) -> bool:
        # Letters that stay letters in lower case and NFC: one run for the tokenizer.
        return word.isalpha() and max(word) < "\u0100"

    def joined(words: list[str]) -> Iterator[tuple[list[str], object]]:
        groups = [words[k : k + TOGETHER] for k in range(0, len(words), TOGETHER)]
        for k in range(0, len(groups), TOGETHER):
            some = groups[k : k + TOGETHER]
            yield from zip(some, tokenizer.encode_batch([" ".join(g) for g in some], add_special_tokens=False))

    def learn(words: list[str]) -> None:
        nonlocal size_known
        marked = [w for w in words if w[-1] in marks and is_plain(w[:-1])]
        ends = set(marked)
        new = {w: None for word in words for w in ((word[:-1], word[-1]) if word in ends else (word,)) if w not in known}
        plain = [w for w in new if is_plain(w)]
        for group, e in joined(plain):
            known.update(zip(group, np.bincount(e.word_ids, minlength=len(group)).tolist()))
        for group, e in joined([w for w in new if not is_plain(w)]):
            # A token belongs to the last word that begins at its place or before.
            begins = np.cumsum([0, *[len(w) + 1 for w in group]])[:-1]
            starts = np.fromiter(chain.from_iterable(e.offsets), "int64")[::2]
            known.update(zip(group, np.bincount(np.searchsorted(begins, starts, "right") - 1, minlength=len(group)).tolist()))
        known.update((w, known[w[:-1]] + known[w[-1]]) for w in marked)
        size_known += sum(map(len, new)) + sum(map(len, marked))

    def lookup(words: list[str]) -> list[int]:
        nonlocal size_known
        if size_known > REMEMBERED:
            known.clear()
            known[""] = size_known = 0
        unknown = [w for w in words if w not in known]
        if unknown:
            learn(unknown)
        return [known[w] for w in words]

    def words_of(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The texts' bytes and where each begins; where each word of them begins, the tokens up to
        its end, and the first word of each text.  There is one begin more than texts."""
        rows = pa.array(texts, pa.large_string())
        begins = np.frombuffer(rows.buffers()[1], "int64", len(texts) + 1)
        data = rows.buffers()[2].to_pybytes()[: begins[-1]] if begins[-1] else b""
        space = _SPACE[np.frombuffer(data, "uint8")]
        after = np.append(True, space)[:-1]
        after[begins[:-1][begins[:-1] < len(data)]] = True
        words = pc.ascii_split_whitespace(rows).flatten()
        words = words.filter(pc.greater(pc.binary_length(words), 0)).dictionary_encode()
        at = np.flatnonzero(~space & after)
        tokens = np.array(lookup(words.dictionary.to_numpy(zero_copy_only=False).tolist()), dtype="int64")[words.indices.to_numpy()]
        return data, begins, at, np.append(0, np.cumsum(tokens)), np.searchsorted(at, begins)

    def counts(texts: list[str]) -> list[int]:
        out: list[int] = []
        for some in _steps(texts, step):
            _, _, _, ends, first = words_of(some)
            out += np.diff(ends[first]).tolist()
        return out

    def pieces(texts: list[str], size: int, counted: bool = True) -> list[tuple[list[str], list[int]]]:
        out = []
        for some in _steps(texts, step):
            data, begins, at, ends, first = words_of(some)
            stops = np.append(at[1:], len(data))
            # Cuts as (word, byte of the word): a text's begin, each token that begins a window, the next text's begin.
            firsts = [np.arange(a + size, b, size) for a, b in zip(ends[first], ends[first[1:]])]
            place = np.concatenate([np.empty(0, "int64"), *firsts])
            word = np.searchsorted(ends, place, "right") - 1
            inside = [data[at[w] : stops[w]].split()[0].decode() for w in word.tolist()]
            offsets = [e.offsets for e in tokenizer.encode_batch(inside, add_special_tokens=False)]
            byte = [len(w[: o[i][0]].encode()) for w, o, i in zip(inside, offsets, (place - ends[word]).tolist())]
            found, partial, whole = iter(zip(word.tolist(), byte, inside)), [], []
            rows = []
            for k, more in enumerate(firsts):
                cuts = [next(found) for _ in more]
                where = [int(begins[k]), *[int(at[w]) + o for w, o, _ in cuts], int(begins[k + 1])]
                rows.append([data[a:b].decode() for a, b in zip(where, where[1:])])
                if not counted:
                    continue
                for left, right in zip([None, *cuts], [*cuts, None]):
                    # Whole words between two cuts, and what is cut off of the words at either side.
                    a, b = left[0] + 1 if left else first[k], right[0] if right else first[k + 1]
                    whole.append(int(ends[max(a, b)] - ends[a]))
                    same = left and right and left[0] == right[0]
                    head = left[2].encode()[left[1] : right[1] if same else None].decode() if left else ""
                    partial += [head, right[2].encode()[: right[1]].decode() if right and not same else ""]
            found = iter(lookup(partial))
            tokens = iter([n + next(found) + next(found) for n in whole])
            out += [(row, [next(tokens) for _ in row] if counted else []) for row in rows]
        return out

    return counts, pieces


WORDS = WordTokenizer()
