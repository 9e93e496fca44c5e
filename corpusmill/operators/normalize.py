"""Structured rows to records.

Each normalizer takes rows with typed columns or with a free-form ``data`` map,
plus ``ord`` and provenance columns, and returns wide records with a
``reject_reason`` (null = good).  Mode 'quarantine' keeps bad rows flagged, mode
'strict' fails the job on the first one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.records import (
    CPT,
    DPO,
    ROLES,
    SFT_CONVERSATION,
    SFT_PAIR,
    as_records,
    message,
    metadata,
    roles_alternate,
)
from corpusmill.functions.replies import json_type
from corpusmill.functions.text import fail_unless, has_text, strip

# Senders of shared conversations and the role of each; the record
# kind of each detectable shape.
ROLE_BY_SENDER = {"human": "user", "gpt": "assistant", "system": "system"}
KIND_BY_SHAPE = {
    "text": CPT,
    "prompt_completion": SFT_PAIR,
    "instruction_input_output": SFT_PAIR,
    "messages": SFT_CONVERSATION,
    "conversations": SFT_CONVERSATION,
    "prompt_chosen_rejected": DPO,
}


def _variant(df: DataFrame, name: str) -> Column | None:
    return F.col("data")[F.lit(name)] if "data" in df.columns and name not in df.columns else None


def string_field(df: DataFrame, name: str) -> Column:
    """A field as STRING; null when it is missing or not a string."""
    value = _variant(df, name)
    if value is not None:
        return F.when(json_type(value) == "STRING", F.try_variant_get(value, "$", "string"))
    if name in df.columns and isinstance(df.schema[name].dataType, T.StringType):
        return F.col(name)
    return F.lit(None).cast("string")


# How values that count as absent are written.
_NOTHING = ("false", "0", "0.0", "-0.0", "[]", "{}")


def written_field(df: DataFrame, name: str) -> Column:
    """A field as it would be written in a text, as in JSON; null when it is missing, null, false, zero or an
    empty list or object."""
    value = _variant(df, name)
    if value is not None:
        plain = F.try_variant_get(value, "$", "string")
        absent = (json_type(value) != "STRING") & plain.isin(*_NOTHING)
    elif name in df.columns and not isinstance(df.schema[name].dataType, T.StringType):
        plain = F.col(name).cast("string")
        absent = plain.isin(*_NOTHING)
    else:
        return string_field(df, name)
    return F.when(~absent, plain)


def _pairs_field(df: DataFrame, name: str, who: str, what: str) -> Column:
    """A list field as ARRAY<STRUCT<who, what>>, members null where not strings."""
    value = _variant(df, name)
    if value is None:
        if name not in df.columns or not isinstance(df.schema[name].dataType, T.ArrayType):
            return F.lit(None).cast(f"array<struct<{who}:string,{what}:string>>")
        return F.col(name)
    item = lambda v, key: F.try_variant_get(v, f"$['{key}']", "variant")
    text = lambda v: F.when(json_type(v) == "STRING", F.try_variant_get(v, "$", "string"))
    return F.transform(
        F.when(json_type(value).startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>")),
        lambda v: F.struct(text(item(v, who)).alias(who), text(item(v, what)).alias(what)),
    )


def row_metadata() -> Column:
    """Provenance of a structured row."""
    return metadata(
        F.col("document_id"), F.col("source_name"), F.col("source_hash"), source_kind="structured", row_id=F.col("row_id")
    )


def _required(**fields: Column) -> Column:
    """Reject reason for the first field that is missing or blank."""
    return F.coalesce(*[F.when(~has_text(value), F.lit(f"empty_{name}")) for name, value in fields.items()])


def _records(df: DataFrame, kind: str, reason: Column, keep, **columns: Column) -> DataFrame:
    if "reject_reason" in df.columns:
        reason = F.coalesce(F.col("reject_reason"), reason)
    flagged = df.withColumn("_reason", reason)
    return as_records(flagged, kind, "_reason", *keep, ord=F.col("ord"), metadata=row_metadata(), **columns).withColumnRenamed(
        "_reason", "reject_reason"
    )


def normalize_text(df: DataFrame, *keep: str) -> DataFrame:
    text = string_field(df, "text")
    return _records(df, CPT, _required(text=text), keep, text=text)


def normalize_prompt_completion(df: DataFrame, *keep: str) -> DataFrame:
    prompt, completion = string_field(df, "prompt"), string_field(df, "completion")
    return _records(df, SFT_PAIR, _required(prompt=prompt, completion=completion), keep, prompt=prompt, completion=completion)


def normalize_instruction(df: DataFrame, *keep: str) -> DataFrame:
    """The input, if there is one, follows the instruction after a blank line."""
    instruction, output, extra = string_field(df, "instruction"), string_field(df, "output"), written_field(df, "input")
    joined = strip(F.concat(instruction, F.lit("\n\n"), extra))
    prompt = F.when(extra.isNull() | (extra == ""), instruction).otherwise(joined)
    return _records(df, SFT_PAIR, _required(instruction=instruction, output=output), keep, prompt=prompt, completion=output)


def _conversation(df: DataFrame, keep, pairs: Column, messages: Column) -> DataFrame:
    complete = F.forall(messages, lambda m: m["role"].isNotNull() & m["content"].isNotNull())
    known = F.forall(messages, lambda m: m["role"].isin(*ROLES))
    reason = (
        F.when(pairs.isNull() | (F.size(pairs) <= 0), F.lit("empty_messages"))
        .when(~F.coalesce(complete & known, F.lit(False)), F.lit("bad_message"))
        .when(~roles_alternate(messages), F.lit("roles_do_not_alternate"))
    )
    return _records(df, SFT_CONVERSATION, reason, keep, messages=messages)


def normalize_messages(df: DataFrame, *keep: str) -> DataFrame:
    messages = _pairs_field(df, "messages", "role", "content")
    return _conversation(df, keep, messages, F.transform(messages, lambda m: message(m["role"], m["content"])))


def normalize_conversations(df: DataFrame, *keep: str) -> DataFrame:
    """Turns of (from, value); an unknown sender is a bad message."""
    turns = _pairs_field(df, "conversations", "from", "value")
    roles = F.create_map(*[F.lit(part) for pair in ROLE_BY_SENDER.items() for part in pair])
    return _conversation(df, keep, turns, F.transform(turns, lambda t: message(roles[t["from"]], t["value"])))


def normalize_preference(df: DataFrame, *keep: str) -> DataFrame:
    prompt, chosen, rejected = (string_field(df, name) for name in ("prompt", "chosen", "rejected"))
    one = lambda role, content: F.array(message(role, content))
    return _records(
        df,
        DPO,
        _required(prompt=prompt, chosen=chosen, rejected=rejected),
        keep,
        dpo_prompt=one("user", prompt),
        chosen=one("assistant", chosen),
        rejected=one("assistant", rejected),
    )


NORMALIZERS = {
    "text": normalize_text,
    "prompt_completion": normalize_prompt_completion,
    "instruction_input_output": normalize_instruction,
    "messages": normalize_messages,
    "conversations": normalize_conversations,
    "prompt_chosen_rejected": normalize_preference,
}


def normalize_rows(df: DataFrame, shape: str, *keep: str, mode: str = "quarantine") -> DataFrame:
    """Normalize rows of one shape.

    'strict' returns only records and fails the running job at the first bad
    row; 'quarantine' returns all rows with their ``reject_reason``.
    """
    records = NORMALIZERS[shape](df, *keep)
    if mode == "quarantine":
        return records
    bad = F.concat(F.lit("row "), F.coalesce("metadata.row_id", F.lit("?")), F.lit(": "), F.col("reject_reason"))
    return records.where(fail_unless(F.col("reject_reason").isNull(), bad)).drop("reject_reason")


def route_sources(sources: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Split confirmed sources into those that make ``kind`` records and
    (source_id, reason) for the others; unconfirmed ones are documents."""
    kinds = F.create_map(*[F.lit(part) for pair in KIND_BY_SHAPE.items() for part in pair])
    confirmed = sources.where("confirmed_schema IS NOT NULL").withColumn("kind", kinds[F.col("confirmed_schema")])
    reason = F.format_string("schema %s makes %s records, not %s", "confirmed_schema", F.coalesce("kind", F.lit("no")), F.lit(kind))
    skipped = confirmed.where(~F.coalesce(F.col("kind") == kind, F.lit(False)))
    return confirmed.where(F.col("kind") == kind), skipped.select("source_id", reason.alias("reason"))
