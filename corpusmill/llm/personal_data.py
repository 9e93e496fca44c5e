"""Personal data in texts: exact patterns, and a character-level BiLSTM-CRF that adds to them.

The patterns give the base spans and, on a bounded sample, the labelled spans that the model is
trained on, along with variants of them that the patterns don't know (numbers without
a plus sign, other separators, addresses with a written-out at sign) and windows of other text
that has digits.  The model looks at every part of a text that holds a digit, an at sign or a
written-out one ("at" with a dotted name after it), the only places where a span of these kinds can be.  Such a part goes in windows that overlap;
each character takes its tag from the window in which it is farthest from the edge, so
that a span over two windows comes out once.  Found spans that touch no base span and have
the digits of their kind are added.

Defined cases: a null or empty text has no spans; without labelled spans in the sample nothing
is added; repeated rows come out alike; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.lstm_crf import Tagger, encoded
from corpusmill.session import materialize

KINDS = ("email", "ip", "card", "phone")

# The patterns.  Runs are taken whole from their start, which finds the same.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Texts the model is trained on at most, and windows of each sort.
TRAIN_TEXTS, TRAIN_WINDOWS, STEPS = 2000, 3000, 500
WINDOW, OVERLAP, CONTEXT = 96, 48, 32
_BATCH = 2048
_TRIGGER = re.compile(r"[0-9@]")

# Longest names of an address (RFC 5321, RFC 1035), and where an added span can be: a written-out
# at sign needs a dotted name after it.
LOCAL, DOMAIN = 64, 253
_WRITTEN_AT = re.compile(r"\bat\b(?:(?<=\.at)|(?=((?s:.{0,%d}?)\.[A-Za-z]{2})))" % (DOMAIN + 8))
_BEFORE = re.compile(r"\S*\s*[(\[{<]?\s*\Z")
_AFTER = re.compile(r"\s*[)\]}>]?\s*\S{0,%d}" % (DOMAIN + 2))


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed."""
    spans = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and _LOCAL_END.match(text[start - 1]):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            spans.append((start, done, "email"))
        else:
            done = max(done, at + 1)
        at = text.find("@", done)
    if any(d in text for d in "0123456789"):
        spans += [(*m.span(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = _digits(m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                spans.append((*m.span(), "card"))
        spans += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def _tags(length: int, spans: list[tuple[int, int, str]]) -> np.ndarray:
    """0 outside, else 1 + 2 * kind at a span's first character and one more inside."""
    out = np.zeros(length, dtype="int64")
    for start, end, kind in spans:
        out[start:end] = 2 + 2 * KINDS.index(kind)
        out[start] -= 1
    return out


def _variant(span: str, kind: str, draw: random.Random) -> str:
    """A form of a span that the patterns may not know."""
    if kind == "phone":
        bare = re.sub(r"^\+[0-9]{1,3}[ .-]?", "", span)
        return draw.choice([span, bare, bare.replace(" ", "-"), bare.replace("(", "").replace(") ", "-"), bare.replace(") ", ")")])
    if kind == "email":
        return draw.choice([span, span.replace("@", " at "), span.replace("@", " (at) "), span.replace("@", "[at]")])
    if kind == "card":
        digits = _digits(span)
        return draw.choice([span, draw.choice([".", "/", " ", "-"]).join(digits[i : i + 4] for i in range(0, len(digits), 4))])
    return span


def training_windows(texts: list[str], most: int = TRAIN_WINDOWS, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and tags of windows with spans, with variants of spans, and with other digits."""
    draw, windows = random.Random(seed), []
    for text in texts:
        spans = base_spans(text)
        disjoint = [s for k, s in enumerate(spans) if not any(a < s[1] and s[0] < b for a, b, _ in spans[:k] + spans[k + 1 :])]
        for start, end, kind in disjoint:
            for form in (text[start:end], _variant(text[start:end], kind, draw)):
                before = draw.randint(0, max(0, WINDOW - len(form)))
                left = text[max(0, start - before) : start]
                # Neighbouring spans are left out, so that all of the rest is outside.
                if any(start - len(left) < b <= start or end <= a < end + WINDOW for a, b, _ in spans):
                    continue
                right = text[end : end + WINDOW - len(left) - len(form)]
                windows.append((left + form + right, [(len(left), len(left) + len(form), kind)]))
        others = [m.start() for m in _TRIGGER.finditer(text) if not any(a - WINDOW < m.start() < b + WINDOW for a, b, _ in spans)]
        for at in draw.sample(others, min(2, len(others))) + ([draw.randrange(len(text))] if text and not others and not spans else []):
            left = max(0, at - draw.randint(0, WINDOW - 1))
            windows.append((text[left : left + WINDOW], []))
    draw.shuffle(windows)
    windows = [(t[:WINDOW].ljust(WINDOW), [s for s in spans if s[1] <= WINDOW]) for t, spans in windows[:most]]
    if not windows:
        empty = np.empty((0, WINDOW), dtype="int64")
        return empty, empty
    return np.stack([encoded(t) for t, _ in windows]), np.stack([_tags(WINDOW, s) for _, s in windows])


def train(docs: DataFrame, text: str = "text", most: int = TRAIN_TEXTS, steps: int = STEPS) -> bytes | None:
    """A trained model's bytes, or None if the sample has no spans.

    The sample is some of the texts with a digit or an at sign, about ``most`` of them by a
    hash of the text; one task learns from it.
    """
    with_any = docs.select(F.col(text).alias("text")).where(F.rlike(F.col(text), F.lit("[0-9@]")))
    n = with_any.count()
    share = 2**32 if n <= most else int(2**32 * most / n)
    sample = materialize(with_any.where(F.pmod(F.xxhash64("text"), F.lit(2**32)) < share), "pii-sample")

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        symbols, tags = training_windows(sorted(group["text"].tolist()))
        if not (tags > 0).any():
            return pd.DataFrame({"model": pd.Series([], dtype=object)})
        model = Tagger(1 + 2 * len(KINDS))
        model.fit(symbols, tags, steps)
        return pd.DataFrame({"model": [model.to_bytes()]})

    rows = sample.groupBy().applyInPandas(learn, "model binary").collect()
    return bytes(rows[0].model) if rows else None


def _regions(text: str) -> list[tuple[int, int]]:
    """The parts of a text around its digits, and around its at signs with the names beside them."""
    parts = []
    for m in _TRIGGER.finditer(text):
        start, end = m.span()
        if m[0] == "@":
            start, end = _names(text, start, end)
        parts.append((max(0, start - CONTEXT), min(len(text), max(end - 1, m.start()) + CONTEXT)))
    for m in _WRITTEN_AT.finditer(text):
        start, end = _names(text, *m.span())
        end = max(end, m.end(1))
        parts.append((max(0, start - CONTEXT), min(len(text), end + CONTEXT)))
    out: list[list[int]] = []
    for start, end in sorted(parts):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def _names(text: str, start: int, end: int) -> tuple[int, int]:
    """From the start of the name before an at sign to the end of the one after it."""
    first = max(0, start - LOCAL - 8)
    return first + _BEFORE.search(text[first:start]).start(), _AFTER.match(text, end).end()


def _plausible(kind: str, value: str) -> bool:
    digits = _digits(value)
    if kind == "phone":
        return 9 <= len(digits) <= 15 and len(value) <= 25
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "ip":
        parts = re.findall("[0-9]+", value)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    return bool(re.search(r"@|\bat\b", value)) and bool(re.search(r"\.[A-Za-z]{2,}$", value))


def model_spans(model: Tagger, texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """Spans that the model finds, windows reconciled over each text."""
    jobs = []
    for row, text in enumerate(texts):
        for start, end in _regions(text):
            for at in range(start, max(end - OVERLAP, start + 1), WINDOW - OVERLAP):
                jobs.append((row, at, min(end, at + WINDOW)))
    tags: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for first in range(0, len(jobs), _BATCH):
        part = jobs[first : first + _BATCH]
        decoded = model.decode(np.stack([encoded(texts[row][a:b].ljust(WINDOW)) for row, a, b in part]))
        for (row, a, b), found in zip(part, decoded):
            if row not in tags:
                tags[row] = np.zeros(len(texts[row]), dtype="int8"), np.zeros(len(texts[row]), dtype="int16")
            tag, sure = tags[row]
            here = np.arange(b - a)
            # Distance from the edge, but the ends of a text are no edge.
            left = here + 1 if a else here + WINDOW
            right = (b - a) - here if b < len(texts[row]) else (b - a) - here + WINDOW
            distance = np.minimum(left, right)
            better = distance > sure[a:b]
            tag[a:b][better] = found[: b - a][better]
            sure[a:b][better] = distance[better]
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for row, (tag, _) in tags.items():
        at = np.flatnonzero(tag)
        k = 0
        while k < len(at):
            kind, start = (tag[at[k]] - 1) // 2, k
            k += 1
            while k < len(at) and at[k] == at[k - 1] + 1 and tag[at[k]] == 2 + 2 * kind:
                k += 1
            out[row].append((int(at[start]), int(at[k - 1]) + 1, KINDS[kind]))
    return out


def all_spans(texts: list[str | None], model: Tagger | None) -> list[tuple[list, list]]:
    """(base spans, added spans) of every text."""
    texts = [t or "" for t in texts]
    base = [base_spans(t) for t in texts]
    added: list[list] = [[] for _ in texts]
    if model is not None:
        for k, spans in enumerate(model_spans(model, texts)):
            for start, end, kind in spans:
                value = texts[k][start:end]
                start, end = start + len(value) - len(value.lstrip()), end - len(value) + len(value.rstrip())
                clear = all(end <= a or b <= start for a, b, _ in base[k])
                if clear and _plausible(kind, texts[k][start:end]):
                    added[k].append((start, end, kind))
    return list(zip(base, added))


@lru_cache(maxsize=2)
def _model(data: bytes) -> Tagger:
    return Tagger.from_bytes(data)


def find_personal_data(docs: DataFrame, model: bytes | None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans) per row of ``docs``.  No shuffle.

    The counts and the digest are of the base spans; ``spans`` has the added ones too.
    """
    counts = [T.StructField(f"n_{kind}", T.LongType()) for kind in KINDS]
    schema = T.StructType([docs.schema[id], *counts, T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = _model(sent.value) if sent.value else None
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                piece = batch.slice(start, 1000)
                found = all_spans(piece.column(1).to_pylist(), tagger)
                columns = [[sum(kind == k for _, _, k in base) for base, _ in found] for kind in KINDS]
                digests = [hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found]
                everything = [written([*base, *added]) for base, added in found]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), *[pa.array(c, pa.int64()) for c in columns], pa.array(digests, pa.string()), pa.array(everything, pa.string())],
                    names=schema.names,
                )

    return docs.select(id, text).mapInArrow(find, schema)
