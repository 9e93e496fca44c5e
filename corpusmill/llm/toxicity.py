"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its distinct words, their stems (first letters, so that endings don't
hide a word), pairs of neighbouring words, and pairs with one word between them, hashed to
2**BITS coordinates.  The learner keeps a rate for every
coordinate, and its L1 penalty leaves most weights at exactly zero, so that what scoring
needs is a short list: at most 2**BITS (coordinate, weight) pairs, usually some thousands.

It learns from a bounded sample of the labelled rows (``TRAIN_ROWS``), drawn by a hash of
their ids; rows are hashed to features where they lie, and one task takes them in the
order of that hash.  Everything else covers all rows.

Defined cases: a null or empty text has no features and gets the score of the intercept;
a label that is null is ignored, of several labels of an id the largest counts; without
labels every score is 0.5 or less; rows are scored one by one, so repeated rows
get equal scores; a null id is not held out; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.words import mixed, word_hashes
from corpusmill.session import materialize

BITS = 20
TRAIN_ROWS = 8000
PUNCTUATION = ".,;:!?\"'()[]{}<>«»“”„…*#$%&|-–—_/\\"

STEMS = (4, 5)
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 5.0, 0.0, 5

_PAIR, _SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def features(texts: list[str | None], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text number, coordinate) of all n-grams and skip-grams, not made distinct."""
    words = [[w for w in (x.strip(PUNCTUATION) for x in (t or "").lower().split()) if w] for t in texts]
    row = np.repeat(np.arange(len(texts)), [len(w) for w in words])
    flat = [w for ws in words for w in ws]
    one = word_hashes(flat)
    shift = np.uint64(64 - bits)
    rows, keys = [row], [mixed(one) >> shift]
    for letters in STEMS:
        rows.append(row)
        keys.append(mixed(word_hashes([w[:letters] + "~" for w in flat])) >> shift)
    with np.errstate(over="ignore"):
        for gap, factor in ((1, _PAIR), (2, _SKIP)):
            same = row[gap:] == row[:-gap]
            rows.append(row[gap:][same])
            keys.append(mixed(one[:-gap][same] * factor + one[gap:][same]) >> shift)
    return np.concatenate(rows), np.concatenate(keys).astype("int64")


class Ftrl:
    """Logistic regression with a rate per coordinate (McMahan et al., 2013)."""

    def __init__(self, size: int):
        # The last coordinate is the intercept, which is not penalized.
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, l1 = self.z[at], np.where(at == len(self.z) - 1, 0.0, L1)
        shrunk = np.sign(z) * l1 - z
        return np.where(np.abs(z) > l1, shrunk / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2), 0.0)

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, len(self.z) - 1)
        w = self.weights(at)
        gradient = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        grown = self.n[at] + gradient * gradient
        self.z[at] += gradient - (np.sqrt(grown) - np.sqrt(self.n[at])) / ALPHA * w
        self.n[at] = grown


def held_out(id: Column) -> Column:
    """The fold that is never learned from."""
    return F.coalesce(F.pmod(F.crc32(id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", id: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS, bits: int = BITS) -> list[tuple[int, float]]:
    """(coordinate, weight) of the weights that are not zero; coordinate 2**bits is the intercept."""
    usable = (
        labels.where(F.col(label).isNotNull() & F.col(id).isNotNull() & ~held_out(F.col(id)))
        .groupBy(id)
        .agg(F.max(label).alias("_label"))
        .withColumn("_order", F.xxhash64(F.col(id).cast("string")))
    )
    usable = materialize(usable, "labels")
    total = usable.count()
    part = 2**32 if total <= rows else int(2**32 * rows / total)
    sample = usable.where(F.pmod("_order", F.lit(2**32)) < part)
    # At most about ``rows`` narrow rows, so the sample is what is sent around.
    chosen = docs.select(F.col(id), F.col(text).alias("_text")).join(F.broadcast(sample), id).select("_text", "_label", "_order")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, key = features(batch.column(0).to_pylist(), bits)
            keys = [np.unique(key[row == k]).astype("<i4").tobytes() for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(keys, pa.binary())], names=["label", "order", "keys"])

    prepared = materialize(chosen.mapInArrow(hashed, "label int, order long, keys binary"), "features")

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        model = Ftrl(1 << bits)
        group = group.sort_values(["order", "label"])
        examples = [(np.frombuffer(k, dtype="<i4").astype("int64"), int(y)) for k, y in zip(group["keys"], group["label"])]
        for _ in range(EPOCHS):
            for at, y in examples:
                model.learn(at, y)
        everywhere = np.arange(len(model.z))
        w = model.weights(everywhere)
        return pd.DataFrame({"at": everywhere[w != 0], "weight": w[w != 0]})

    # One task learns: the sample is bounded.
    learned = prepared.groupBy().applyInPandas(learn, "at long, weight double").collect()
    return sorted((r.at, r.weight) for r in learned)


def scored(docs: DataFrame, weights: list[tuple[int, float]], id: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """(id, score) per row, the score being the probability of the label 1."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    schema = T.StructType([docs.schema[id], T.StructField("score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((1 << bits) + 1)
        for at, weight in sent.value:
            table[at] = weight
        for batch in batches:
            sums = []
            for start in range(0, batch.num_rows, 500):
                texts = batch.column(1).slice(start, 500).to_pylist()
                row, key = features(texts, bits)
                # Only coordinates with a weight need to be made distinct.
                used = table[key] != 0
                pairs = np.unique(row[used] * (1 << bits) + key[used])
                total = np.bincount(pairs >> bits, weights=table[pairs & ((1 << bits) - 1)], minlength=len(texts))
                sums.append(total + table[-1])
            value = 1 / (1 + np.exp(-np.clip(np.concatenate(sums) if sums else np.empty(0), -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value)], names=schema.names)

    return docs.select(id, text).mapInArrow(score, schema)
