"""Shape and length checks on records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.records import (
    CPT,
    DPO,
    MAX_SOURCE_BYTES,
    SFT_CONVERSATION,
    SFT_PAIR,
    all_filled,
    message,
    rendered,
    roles_alternate,
)
from corpusmill.functions.text import has_text
from corpusmill.functions.tokens import WORDS

# Numbers of turns that are summed up together.
TURNS_OF_BLOCK = 4096

# Bytes charged per message besides its text, so that blank ones count too.
_MESSAGE_OVERHEAD = 16


def well_formed() -> Column:
    """True when a record has the shape its kind asks for.

    Preference pairs need non-empty lists but not alternating roles.
    """
    filled_list = lambda name: (F.size(name) > 0) & all_filled(F.col(name))
    return F.coalesce(
        F.when(F.col("kind") == CPT, has_text(F.col("text")))
        .when(F.col("kind") == SFT_PAIR, has_text(F.col("prompt")) & has_text(F.col("completion")))
        .when(F.col("kind") == SFT_CONVERSATION, all_filled(F.col("messages")) & roles_alternate(F.col("messages")))
        .when(F.col("kind") == DPO, filled_list("dpo_prompt") & filled_list("chosen") & filled_list("rejected")),
        F.lit(False),
    )


def flag_structure(records: DataFrame, max_tokens: int | None = None, tokenizer=WORDS) -> DataFrame:
    """Add ``reject_reason``: 'structural' for a bad shape or an over-long text."""
    ok = well_formed()
    if max_tokens is not None:
        ok = ok & (tokenizer.count(rendered()) <= max_tokens)
    return records.withColumn("reject_reason", F.when(~F.coalesce(ok, F.lit(False)), F.lit("structural")))


def split_oversize(turns: DataFrame, key: str, text: str, max_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Turns of the conversations within ``max_bytes``, and the keys of the others.

    A conversation is one row of a source, so it cannot outgrow the ceiling for
    a whole source.  Sizes are summed with map-side combine, and the turns of an
    oversize conversation are dropped before any shuffle on its key.  There are
    at most total bytes / max_bytes such keys, which bounds their broadcast.
    """
    sizes = turns.groupBy(key).agg(F.sum(F.octet_length(text) + _MESSAGE_OVERHEAD).alias("bytes"))
    oversize = sizes.where(F.col("bytes") > max_bytes).select(key)
    return turns.join(F.broadcast(oversize), key, "left_anti"), oversize


def alternation_by_turn(turns: DataFrame, key: str, order: str, role: str = "role", block: int = TURNS_OF_BLOCK) -> DataFrame:
    """(key, alternates) from one row per message, for conversations of any length.

    System messages are left out before neighbours are compared.  The turns of a conversation, whose
    ``order`` is a number that no two of them share, are summed up in blocks of ``block`` numbers
    wherever these land: first role, last role, and whether neighbours differ.  The summaries of a
    conversation, one for each block, then meet in their order.
    """
    turn = F.when(F.col(role) != "system", F.struct(F.col(order).alias("at"), F.col(role).alias("role")))
    differ = lambda left, right: F.forall(F.zip_with(left, right, lambda a, b: a != b), lambda x: x)
    n_but_one = lambda x: F.greatest(F.size(x) - 1, F.lit(0))
    head, tail = lambda x: F.slice(x, F.lit(1), n_but_one(x)), lambda x: F.slice(x, F.lit(2), n_but_one(x))
    blocks = turns.groupBy(key, F.floor(F.col(order) / block).alias("_block")).agg(F.array_sort(F.collect_list(turn)).alias("_turns"))
    roles = blocks.select(key, "_block", F.transform("_turns", lambda t: t["role"]).alias("_roles"))
    first, last = F.get("_roles", F.lit(0)), F.get("_roles", F.size("_roles") - 1)
    summary = F.struct("_block", first.alias("first"), last.alias("last"), differ(head("_roles"), tail("_roles")).alias("ok"))
    joined = roles.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.size("_roles") > 0, summary))).alias("_parts"))
    parts = F.col("_parts")
    opens = F.get(parts, F.lit(0))["first"] == "user"
    inner = F.forall(parts, lambda p: p["ok"])
    between = differ(F.transform(head(parts), lambda p: p["last"]), F.transform(tail(parts), lambda p: p["first"]))
    return joined.select(key, F.coalesce((F.size(parts) > 0) & opens & inner & between, F.lit(False)).alias("alternates"))


def fold_turns(
    turns: DataFrame, key: str, order: str, role: str = "role", text: str = "text", max_bytes: int = MAX_SOURCE_BYTES
) -> DataFrame:
    """One row per conversation with its ``messages`` list, in turn order; null
    messages for an oversize conversation."""
    within, oversize = split_oversize(turns, key, text, max_bytes)
    folded = (
        within.groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct(order, role, text))).alias("turns"))
        .select(key, F.transform("turns", lambda t: message(t[role], t[text])).alias("messages"))
    )
    return folded.unionByName(oversize, allowMissingColumns=True)
