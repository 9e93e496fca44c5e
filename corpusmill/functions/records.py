"""The one wide record type and what can be derived from a record.

A DataFrame of records carries every column below; the columns that do not
belong to a record's ``kind`` are null.  ``ord`` is the position of the record
in the whole input and doubles as its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import has_text

# Record kinds and message roles.
CPT = "cpt"
SFT_PAIR = "sft_prompt_completion"
SFT_CONVERSATION = "sft_conversation"
DPO = "dpo"
ROLES = ("system", "user", "assistant")

# Fixed value: upload ceiling for one source file, in bytes.
MAX_SOURCE_BYTES = 500 * 1024 * 1024

# An item of a source takes at least two bytes, so a source under the ceiling
# holds fewer than 2**28 of them.
ITEM_BITS = 28

MESSAGES = "array<struct<role:string,content:string>>"
METADATA = (
    "struct<document_id:string,source_name:string,source_hash:string,chunk_id:string,"
    "row_id:string,source_kind:string,extra:map<string,string>>"
)
RECORD_FIELDS = {
    "ord": "bigint",
    "kind": "string",
    "text": "string",
    "prompt": "string",
    "completion": "string",
    "messages": MESSAGES,
    "dpo_prompt": MESSAGES,
    "chosen": MESSAGES,
    "rejected": MESSAGES,
    "metadata": METADATA,
}
# Columns of each exported kind: name in the file -> column of the wide record.
EXPORT_COLUMNS = {
    CPT: {"text": "text", "metadata": "metadata"},
    SFT_PAIR: {"prompt": "prompt", "completion": "completion", "metadata": "metadata"},
    SFT_CONVERSATION: {"messages": "messages", "metadata": "metadata"},
    DPO: {"prompt": "dpo_prompt", "chosen": "chosen", "rejected": "rejected", "metadata": "metadata"},
}


def position(source_ordinal: Column, item: Column | int = 0) -> Column:
    """Pack source position and item position into one sortable BIGINT; a job that
    meets a position that does not fit fails."""
    source, item = source_ordinal.cast("bigint"), (item if isinstance(item, Column) else F.lit(item)).cast("bigint")
    fits = source.between(0, (1 << 63 - ITEM_BITS) - 1) & item.between(0, (1 << ITEM_BITS) - 1)
    return F.when(~fits, F.raise_error("source or item position out of range").cast("bigint")).otherwise(F.shiftleft(source, ITEM_BITS) + item)


def as_records(df: DataFrame, kind: str, *keep: str, **columns: Column) -> DataFrame:
    """Project ``df`` to the wide record; ``keep`` names extra columns to carry."""
    values = {"kind": F.lit(kind), **columns}
    return df.select(
        *[values.get(name, F.lit(None)).cast(dtype).alias(name) for name, dtype in RECORD_FIELDS.items()],
        *keep,
    )


def metadata(
    document_id: Column,
    source_name: Column,
    source_hash: Column,
    *,
    source_kind: str = "document",
    chunk_id: Column | None = None,
    row_id: Column | None = None,
    extra: Column | None = None,
) -> Column:
    """Provenance struct; ``extra`` is a map because Parquet cannot hold an empty struct."""
    none = F.lit(None)
    return F.struct(
        document_id.cast("string").alias("document_id"),
        source_name.cast("string").alias("source_name"),
        source_hash.cast("string").alias("source_hash"),
        (none if chunk_id is None else chunk_id).cast("string").alias("chunk_id"),
        (none if row_id is None else row_id).cast("string").alias("row_id"),
        F.lit(source_kind).alias("source_kind"),
        (F.create_map() if extra is None else extra).cast("map<string,string>").alias("extra"),
    )


def message(role: Column | str, content: Column) -> Column:
    role = role if isinstance(role, Column) else F.lit(role)
    return F.struct(role.cast("string").alias("role"), content.cast("string").alias("content"))


def roles_alternate(messages: Column) -> Column:
    """True when, system messages aside, a conversation is not empty, opens
    with the user and never has the same role twice in a row."""
    roles = F.transform(F.filter(messages, lambda m: m["role"] != "system"), lambda m: m["role"])
    size = F.size(roles)
    neighbours = F.zip_with(
        F.slice(roles, F.lit(1), F.greatest(size - 1, F.lit(0))),
        F.slice(roles, F.lit(2), F.greatest(size - 1, F.lit(0))),
        lambda a, b: a != b,
    )
    return F.coalesce((F.get(roles, F.lit(0)) == "user") & F.forall(neighbours, lambda ok: ok), F.lit(False))


def all_filled(messages: Column) -> Column:
    """True when no message content is blank (an empty list passes)."""
    return F.coalesce(F.forall(messages, lambda m: has_text(m["content"])), F.lit(False))


def rendered() -> Column:
    """The whole text of a record, whatever its kind."""
    contents = lambda name: F.transform(F.coalesce(F.col(name), F.array().cast(MESSAGES)), lambda m: m["content"])
    return (
        F.when(F.col("kind") == CPT, F.col("text"))
        .when(F.col("kind") == SFT_PAIR, F.concat(F.col("prompt"), F.lit("\n"), F.col("completion")))
        .when(F.col("kind") == SFT_CONVERSATION, F.array_join(contents("messages"), "\n"))
        .when(
            F.col("kind") == DPO,
            F.array_join(F.concat(contents("dpo_prompt"), contents("chosen"), contents("rejected")), "\n"),
        )
    )
