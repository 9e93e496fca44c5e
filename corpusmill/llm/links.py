"""Candidate pairs from shared keys, their verification, and connected components.

All of it is narrow rows that are combined before each shuffle: a bucket with a third
of all rows is one row per task when its lead is chosen, and its members then
meet that one row in a join whose large partitions Spark may split.  No bucket,
component or text is gathered anywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.words import jaccard
from corpusmill.session import materialize

Shingles = Callable[[str | None], np.ndarray]

# Nodes of a block; a tile compares two blocks.
BLOCK = 128

# Rows of 64 bits that tell which nodes are wanted.
WORDS = 1 << 18

# Rows of keys that a task holds, 16 bytes each.
_ROWS = 1 << 20

# Similarity to the lead of a bucket from which a node joins the lead's group for a full comparison.
LOOSE = 0.45


def marked(rows: DataFrame, wanted: DataFrame, *key: str, name: str = "_likely") -> DataFrame:
    """``rows`` and whether their ``key`` columns can be in ``wanted``: true for all that are, and for few others
    while there are far fewer keys than bits.

    A bit per hashed key, at most ``WORDS`` rows of 64 bits whatever the size of the tables.
    """
    of = "pmod(xxhash64({}), {})".format(", ".join(f"`{k}`" for k in key), WORDS)
    bit = "shiftleft(1L, cast(pmod(xxhash64({}, 1), 64) as int))".format(", ".join(f"`{k}`" for k in key))
    word, bits = f"{name}_word", f"{name}_bits"
    while {word.lower(), bits.lower()} & {c.lower() for c in rows.columns}:
        word, bits = f"_{word}", f"_{bits}"
    table = wanted.groupBy(F.expr(of).alias(word)).agg(F.bit_or(F.expr(bit)).alias(bits))
    told = rows.withColumn(word, F.expr(of)).join(F.broadcast(table), word, "left")
    likely = F.coalesce(F.col(bits).bitwiseAND(F.expr(bit)) != 0, F.lit(False))
    return told.select(*[F.col(f"`{c}`") for c in rows.columns], likely.alias(name))


def only_wanted(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of (node, text) whose node is in ``wanted`` (node), which is read twice; a sketch of it
    keeps nearly all other texts out of the shuffle of the join that decides."""
    return marked(texts, wanted, "node").where("_likely").drop("_likely").join(wanted, "node", "left_semi")


def similar_pairs(pairs: DataFrame, texts: DataFrame, shingles: Shingles, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs whose texts, (node, text), have a Jaccard similarity of ``threshold`` or more."""
    node = pairs.schema["a"].dataType
    schema = T.StructType([T.StructField("a", node), T.StructField("b", node), T.StructField("similarity", T.DoubleType())])
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(
        texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b"
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[str | None, np.ndarray] = {}
            values = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if y not in known:
                    # Leads come again and again; a batch is what is remembered at most.
                    known[y] = shingles(y)
                values.append(jaccard(shingles(x), known[y]))
            close = pa.array([v >= threshold - 1e-12 for v in values], pa.bool_())
            columns = [*batch.columns[:2], pa.array(values, pa.float64())]
            yield pa.RecordBatch.from_arrays([c.filter(close) for c in columns], names=schema.names)

    return both.select("a", "b", "text_a", "text_b").mapInArrow(verify, schema)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of the edges (a, b), the component being its least node.

    Alternating large-star and small-star steps (Kiveris et al., 2014): every node's
    neighbours are hung on the least of them until nothing changes, in about
    the logarithm of the longest path.  Each round is written to the shared folder.
    """
    links = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "links")
    before = None
    for _ in range(most_rounds):
        now = links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now[0] == 0 or now == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = now
        ways = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = ways.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = materialize(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").unionByName(least.select("u", F.col("m").alias("v")))
        links = materialize(small.distinct(), "small-star")
    raise RuntimeError("components did not settle")


def tile_links(groups: DataFrame, texts: DataFrame, shingles: Shingles, similarity: float, block: int = BLOCK) -> DataFrame:
    """(node, root, n) from (node, component): all nodes of a component are compared with each other.

    A component is cut into blocks of about ``block`` nodes, and each pair of blocks is a tile;
    components that are smaller than a block share tiles, of about as many nodes.
    Only counts and a spanning forest leave a tile: for each of its nodes the number ``n``
    of similar ones, and the least node ``root`` that similar pairs of the tile lead to.
    """
    sizes = groups.groupBy("component").agg(F.count("*").alias("size"))
    placed = groups.join(sizes, "component").withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    shared = max(1, sizes.where(F.col("size") <= block).agg(F.sum("size")).first()[0] or 0) // block + 1
    whole = F.col("blocks") == 1
    together = F.pmod(F.xxhash64("component"), F.lit(shared))
    placed = placed.withColumn("component", F.when(whole, together).otherwise(F.col("component"))).withColumn("whole", whole)
    placed = placed.join(texts, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = placed.select("whole", "component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "block", "text")

    def compare(tile: pd.DataFrame) -> pd.DataFrame:
        tile = tile.sort_values("node", kind="stable")
        sets = [shingles(t) for t in tile["text"]]
        sizes = np.array([len(s) for s in sets], dtype="float64")
        values, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), sizes.astype("int64"))
        # What only one set has is in no intersection.
        column, shared = np.cumsum(times > 1) - 1, times[inverse] > 1
        owner, column = owner[shared], column[inverse][shared]
        common = np.zeros((len(sets), len(sets)))
        for start in range(0, int((times > 1).sum()), 8192):
            now = (column >= start) & (column < start + 8192)
            part = np.zeros((len(sets), 8192), dtype="float32")
            part[owner[now], column[now] - start] = 1
            common += part @ part.T
        close = (common > 0) & (common >= similarity * (sizes[:, None] + sizes[None, :] - common) - 1e-9)
        np.fill_diagonal(close, False)
        if tile["i"].iloc[0] != tile["j"].iloc[0]:
            side = tile["block"].to_numpy()
            close &= side[:, None] != side[None, :]
        root = np.arange(len(sets))
        while True:
            near = np.minimum(root, np.where(close, root[None, :], len(sets)).min(axis=1))
            if (near == root).all():
                break
            root = near[near]
        node = tile["node"].to_numpy()
        return pd.DataFrame({"node": node, "root": node[root], "n": close.sum(axis=1)})

    return tiles.groupBy("whole", "component", "i", "j").applyInPandas(compare, "node long, root long, n long")


def similar_groups(pairs: DataFrame, texts: DataFrame, shingles: Shingles, similarity: float, loose: float = LOOSE, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(node, component) of similar texts, and (node, n_links).

    Pairs of a node and a lead are compared first.  Nodes that are at least loosely similar to a
    common lead, directly or over others, are one group, and within each group
    everything is compared with everything, in tiles.  So two similar nodes are linked even where
    neither is similar enough to the lead.
    """
    groups = materialize(components(similar_pairs(pairs, texts, shingles, min(loose, similarity))), "loose-groups")
    tiles = materialize(tile_links(groups, texts, shingles, similarity, block), "tile-links")
    edges = tiles.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    return components(edges), tiles.groupBy("node").agg(F.sum("n").alias("n_links"))


def shared_keys(members: DataFrame) -> DataFrame:
    """The rows of (node, key) whose key has more than one node."""
    groups = members.groupBy("key").agg(F.min("node").alias("b"), F.max("node").alias("last")).where("b < last").select("key")
    return members.join(groups, "key").select("node", "key")


def neighbouring_keys(members: DataFrame, rows: int, rows_of_a_task: int = _ROWS) -> DataFrame:
    """The rows of (node, key) whose key has more than one node, from a table of about ``rows`` rows, in one shuffle.

    Rows are dealt by ranges of (key, node), so that a key with a third of all rows is in many
    tasks of about ``rows_of_a_task`` rows.  The rows of a task's least and greatest key stay too, as the
    key may go on in another task.
    """
    tasks = max(1, -(-rows // rows_of_a_task))
    dealt = members.select("key", "node").repartitionByRange(tasks, "key", "node")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy() for c in batch.columns] for batch in batches if batch.num_rows]
        if not parts:
            return
        key, node = (np.concatenate(c) for c in zip(*parts))
        order = np.argsort(key)
        key = key[order]
        same = key[1:] == key[:-1]
        several = (key == key[0]) | (key == key[-1])
        several[1:] |= same
        several[:-1] |= same
        yield pa.RecordBatch.from_arrays([pa.array(node[order[several]]), pa.array(key[several])], names=["node", "key"])

    return dealt.mapInArrow(keep, "node long, key long")


def lead_rounds(members: DataFrame, texts: DataFrame, shingles: Shingles, similarity: float, loose: float = LOOSE) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of a node and a lead that are loosely similar, and the rows of (node, key) that are left.

    In a round the nodes of a key are compared with the least of them.  That one leaves the key, and so
    do those that are so near to it that whatever is similar to them is loosely similar to it
    (one less the similarity is a distance): they meet all that they can be similar to in its
    group.  All others stay for the next round with the next lead.  Rounds go on while they take a
    quarter of the rows away; rows that are left have to be compared with each other.
    """
    loose = min(loose, similarity)
    enough = loose + (1 - similarity) + 1e-9
    rest, near = members, None
    size = rest.count()
    while size:
        leads = rest.groupBy("key").agg(F.min("node").alias("b"))
        others = materialize(rest.join(leads, "key").where("node > b").select(F.col("node").alias("a"), "b", "key"), "lead-pairs")
        close = materialize(similar_pairs(others.select("a", "b").distinct(), texts, shingles, loose), "near-leads")
        near = close if near is None else near.unionByName(close)
        gone = close.where(F.col("similarity") >= enough).select("a", "b")
        rest = materialize(shared_keys(others.join(gone, ["a", "b"], "left_anti").select(F.col("a").alias("node"), "key")), "keys-left")
        before, size = size, rest.count()
        if size > 0.75 * before:
            break
    if near is None:
        near = similar_pairs(members.select(F.col("node").alias("a"), F.col("node").alias("b")), texts, shingles, loose)
    return near, rest


def key_groups(members: DataFrame, texts: DataFrame, shingles: Shingles, similarity: float, loose: float = LOOSE, block: int = BLOCK) -> DataFrame:
    """(node, component) of similar texts; any two nodes of (node, key) that share a key are compared or
    known to be less similar, however unlike the others of the key are.

    Nodes that are loosely similar to a common lead, directly or over others, are one group, and
    within a group, as among the nodes that are left in a key, everything is compared
    with everything, in tiles.  A group needs no tile where the comparisons with its least node have
    decided it: all its nodes are similar to that one, or there are two nodes.
    """
    near, rest = lead_rounds(members, texts, shingles, similarity, loose)
    groups = materialize(components(near), "loose-groups")
    close = near.where(F.col("similarity") >= similarity - 1e-12).select("a", "b")
    direct = groups.join(close, (F.col("node") == F.col("a")) & (F.col("component") == F.col("b"))).select("node", "component").distinct()
    direct = materialize(direct, "similar-to-least")
    sizes = groups.groupBy("component").agg(F.count("*").alias("size"))
    done = direct.groupBy("component").agg((F.count("*") + 1).alias("done"))
    undecided = sizes.join(done, "component", "left").where("size > 2 AND size > coalesce(done, 1)").select("component")
    undecided = groups.join(materialize(undecided, "undecided-groups"), "component")
    tiles = tile_links(undecided, texts, shingles, similarity, block)
    left = tile_links(rest.select("node", F.col("key").alias("component")), texts, shingles, similarity, 2 * block)
    edges = tiles.unionByName(left).where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    return components(materialize(edges.unionByName(direct.select(F.col("node").alias("a"), F.col("component").alias("b"))), "tile-links"))
