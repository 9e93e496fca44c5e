"""Join of documents on the Jaccard similarity of their word n-grams, by a MinHash LSH forest.

Documents with equal sets of shingles are one class, and one of them stands for all.  Each
class has ``TREES`` labels of ``DEPTH`` MinHash values, a byte of each.  The labels of a tree, sorted
over range partitions, are its prefix trie: the nodes on the path of a label are the runs of neighbours
that share a prefix with it.  A label's longest match is the prefix it shares with a neighbour; from
there the prefix is shortened value by value, and at every node passed the document is
compared with the node's least one.  Shortening ends where the probability that two documents of just
the wanted similarity have met in some tree reaches ``RECALL``; a label that shares no prefix of that length
is done at once.  A node that is cut by a border of partitions has a least document on either side, and these
are compared too.

Documents that are at least loosely similar to a common one form a group, whose documents are all
compared with each other by exact Jaccard similarity, in tiles of bounded size.  Only counts and a
spanning forest leave a tile, so that a group of many different near copies gives a row per document
and tile, not a row per pair.

Defined cases: a text of fewer than five words is one shingle; a null or empty text is its
own class without links; ids are expected to be unique, rows that share an id share a
class if one of them does; rows without an id have no class; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.links import BLOCK, only_wanted, similar_groups
from corpusmill.llm.words import minima, mixed, set_key, word_shingles
from corpusmill.session import materialize

SIMILARITY = 0.8
SHINGLE = 5
TREES, DEPTH, RECALL = 20, 12, 0.999

_STEP = 1 << 20

# Values of a label that stand beside its tree in the first of two numbers.
_HIGH = 7

# Leaves that a task sorts and holds, 24 bytes each.
_LEAVES = 1 << 18


def depth_for(similarity: float, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The length to which prefixes are shortened: the longest, not over ``depth``, with which two documents
    of that similarity meet in some tree with a probability of ``recall``."""
    while depth > 1 and 1 - (1 - similarity**depth) ** trees < recall:
        depth -= 1
    return depth


def _signatures(docs: DataFrame, id: str, text: str, shingle: int) -> DataFrame:
    """(id, h1, h2, labels): the key of the shingle set, and ``TREES`` labels of ``DEPTH`` bytes behind each other."""
    schema = "id long, h1 long, h2 long, labels binary"

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush():
            values = minima(np.concatenate(sets), np.array([len(x) for x in sets]), TREES * DEPTH).astype("uint64")
            labels = np.ascontiguousarray((mixed(values) >> np.uint64(56)).astype("uint8").reshape(len(sets), TREES * DEPTH))
            table = np.array(rows, dtype="int64").reshape(-1, 3).T
            return pa.RecordBatch.from_arrays(
                [*[pa.array(np.ascontiguousarray(c)) for c in table], pa.array([row.tobytes() for row in labels], pa.binary())], names=["id", "h1", "h2", "labels"]
            )

        rows: list[tuple[int, int, int]] = []
        sets: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for identifier, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                values = word_shingles(value, shingle)
                if len(values):
                    rows.append((identifier, *set_key(values.tobytes())))
                    sets.append(values)
                    size += len(values)
                if size > _STEP:
                    yield flush()
                    rows, sets, size = [], [], 0
        if rows:
            yield flush()

    return docs.select(F.col(id).cast("long"), text).where(F.col(id).isNotNull()).mapInArrow(sign, schema)


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(high, low, node) per tree from (node, labels): the tree and the first seven values, and the other values."""
    for batch in batches:
        labels = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype="uint8").reshape(-1, TREES, DEPTH).astype("int64")
        high = np.broadcast_to(np.arange(TREES, dtype="int64"), labels.shape[:2]).copy()
        low = np.zeros_like(high)
        for k in range(_HIGH):
            high = (high << 8) | labels[:, :, k]
        for k in range(_HIGH, DEPTH):
            low = (low << 8) | labels[:, :, k]
        node = np.repeat(batch.column(0).to_numpy(), TREES)
        yield pa.RecordBatch.from_arrays([pa.array(high.ravel()), pa.array(low.ravel()), pa.array(node)], names=["high", "low", "node"])


def _common(high: np.ndarray, low: np.ndarray, other_high: np.ndarray, other_low: np.ndarray) -> np.ndarray:
    """The number of values that two labels begin with alike, -1 between trees."""
    above, below = high ^ other_high, low ^ other_low
    same = sum((above >> (8 * k) == 0).astype("int64") for k in range(_HIGH + 1)) - 1
    rest = sum((below >> (8 * k) == 0).astype("int64") for k in range(DEPTH - _HIGH))
    return np.where(above == 0, same + rest, same)


def forest_pairs(labels: DataFrame, floor: int, rows_of_a_task: int = _LEAVES) -> DataFrame:
    """(a, b) with b < a from (node, labels): documents and the least one of a trie node on their path.

    The leaves of all trees are sorted over range partitions, of about ``rows_of_a_task`` leaves by
    (label, node), so that equal labels are split too.  A task walks its part of the tries from the
    deepest nodes to those of ``floor`` values.  What crosses a border is told from one row per partition.
    """
    spark = labels.sparkSession
    tasks = max(1, -(-labels.count() * TREES // rows_of_a_task))
    leaves = labels.select("node", "labels").mapInArrow(_leaves, "high long, low long, node long")
    ordered = leaves.repartitionByRange(tasks, "high", "low", "node").sortWithinPartitions("high", "low", "node")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy() for c in batch.columns] for batch in batches if batch.num_rows]
        if not parts:
            return
        high, low, node = (np.concatenate(c) for c in zip(*parts))
        shared = np.concatenate([[-1], _common(high[1:], low[1:], high[:-1], low[:-1])])
        first, last, found = [], [], []
        # Rows that share the floor with a neighbour; the others are in no node of two.
        at = np.flatnonzero((shared >= floor) | (np.append(shared[1:], -1) >= floor))
        near, among = shared[at], node[at]
        for depth in range(DEPTH, floor - 1, -1):
            starts = np.flatnonzero(near < depth)
            if len(at):
                lead = np.repeat(np.minimum.reduceat(among, starts), np.diff(np.append(starts, len(at))))
                other = among != lead
                found.append(np.stack([among[other], lead[other]]))
            first.append(int(lead[0]) if len(at) and at[0] == 0 else int(node[0]))
            last.append(int(lead[-1]) if len(at) and at[-1] == len(node) - 1 else int(node[-1]))
        pairs = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.empty((2, 0), dtype="int64")
        edge = [int(high[0]), int(low[0]), int(node[0]), int(high[-1]), int(low[-1]), *first, *last]
        a, b = pa.array([*pairs[0], None], pa.int64()), pa.array([*pairs[1], None], pa.int64())
        yield pa.RecordBatch.from_arrays([a, b, pa.array([None] * pairs.shape[1] + [edge], pa.list_(pa.int64()))], names=["a", "b", "edge"])

    walked = materialize(ordered.mapInArrow(walk, "a long, b long, edge array<long>"), "forest-walk")
    # One row per partition.
    edges = sorted(row.edge for row in walked.where("edge IS NOT NULL").select("edge").collect())
    levels = DEPTH - floor + 1
    across = set()
    for left, right in zip(edges, edges[1:]):
        shared = int(_common(*(np.array([v]) for v in (left[3], left[4], right[0], right[1])))[0])
        for k, depth in enumerate(range(DEPTH, floor - 1, -1)):
            if depth <= shared:
                x, y = left[5 + levels + k], right[5 + k]
                across.add((max(x, y), min(x, y)))
    pairs = walked.where("edge IS NULL").select("a", "b")
    return pairs.unionByName(spark.createDataFrame(sorted(across), "a long, b long")).where("a > b").distinct()


def ngram_classes(docs: DataFrame, id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE, block: int = BLOCK, links: bool = True) -> DataFrame:
    """(id, copy_of, class_id, n_links) per row of ``docs``.

    ``copy_of`` is the least id with an equal set of shingles, ``class_id`` the least id of the
    component of similar documents, and ``n_links`` the number of different shingle
    sets that are similar to the row's (left out with ``links=False``).
    """
    signed = materialize(_signatures(docs, id, text, shingle), "signatures")
    classes = materialize(signed.groupBy("h1", "h2").agg(F.min("id").alias("node")), "classes")
    stand = signed.join(classes, ["h1", "h2"]).where("id = node").dropDuplicates(["h1", "h2"]).select("node", "labels")
    pairs = materialize(forest_pairs(materialize(stand, "labels"), depth_for(similarity)), "pairs")
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    texts = docs.select(F.col(id).cast("long").alias("node"), F.col(text).alias("text"))
    texts = materialize(only_wanted(texts, materialize(wanted, "pair-nodes")), "pair-texts")
    of = lambda value: word_shingles(value, shingle)
    groups, counted = similar_groups(pairs, texts, of, similarity, block=block)
    found = classes.join(groups, "node", "left").select("h1", "h2", F.col("node").alias("copy_of"), F.coalesce("component", "node").alias("class_id"))
    if links:
        found = found.join(counted.withColumnRenamed("node", "copy_of"), "copy_of", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    names = [c for c in ("copy_of", "class_id", "n_links") if c in found.columns]
    rows = signed.select("id", "h1", "h2").join(found, ["h1", "h2"]).select("id", *names).dropDuplicates(["id"])
    own = F.col(id).cast("long")
    plain = {"copy_of": own, "class_id": own, "n_links": F.when(own.isNotNull(), F.lit(0)).cast("long")}
    return docs.select(id).join(rows, own == F.col("id"), "left").select(F.col(id), *[F.coalesce(n, plain[n]).alias(n) for n in names])


def one_of_each_class(docs: DataFrame, id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The first document of every class, with all columns; documents without an id stay."""
    classes = ngram_classes(docs.where(F.col(id).isNotNull()), id, text, similarity, links=False)
    gone = classes.where(F.col(id) != F.col("class_id")).select(F.col(id))
    return docs.join(gone, id, "left_anti")
