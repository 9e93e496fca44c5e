"""Reading model replies: strict candidates, lenient scores, goal choice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.text import has_text, let

# The goals a reply may choose and the objective of each.
OBJECTIVE_BY_GOAL = {
    "domain_adaptation": "cpt",
    "single_turn_instruction": "sft_prompt_completion",
    "multi_turn_conversation": "sft_conversation",
    "preference_alignment": "dpo",
}

# Patterns of a reasoning block and of a JSON object in a reply.
THINKING = r"(?is)<think>.*?</think>"
OBJECT = r"(?s)\{.*\}"


def json_type(value: Column) -> Column:
    """Type name of a VARIANT ('STRING', 'BIGINT', 'OBJECT<...>', ...)."""
    return F.schema_of_variant(value)


def _string(value: Column) -> Column:
    return F.when(json_type(value) == "STRING", F.try_variant_get(value, "$", "string"))


def string_at(document: Column, field: str) -> Column:
    """A top-level field of a VARIANT, only if it is a JSON string."""
    return let(F.try_variant_get(document, f"$['{field}']", "variant"), _string)


def _object(text: Column) -> Column:
    return let(F.try_parse_json(text), lambda parsed: F.when(json_type(parsed).startswith("OBJECT"), parsed))


def qa_candidate(content: Column) -> Column:
    """STRUCT<question, answer, supporting_quote> when the whole reply is a JSON
    object whose three fields are non-blank strings, else null."""
    names = ("question", "answer", "supporting_quote")

    def complete(fields: Column) -> Column:
        filled = has_text(fields[names[0]]) & has_text(fields[names[1]]) & has_text(fields[names[2]])
        return F.when(filled, fields)

    def read(document: Column) -> Column:
        return let(F.struct(*[string_at(document, name).alias(name) for name in names]), complete)

    return let(_object(content), read)


def lenient_object(content: Column) -> Column:
    """The JSON object between the first '{' and the last '}' of a reply, after
    removing <think> blocks; null when there is none."""
    spoken = F.regexp_replace(content, THINKING, "")
    return _object(F.nullif(F.regexp_extract(spoken, OBJECT, 0), F.lit("")))


def number_at(document: Column, field: str) -> Column:
    """A field as DOUBLE: a number, a number in a string, or a boolean."""

    def read(value: Column) -> Column:
        in_text = F.trim(F.try_variant_get(value, "$", "string")).try_cast("double")
        return F.when(json_type(value) == "STRING", in_text).otherwise(F.try_variant_get(value, "$", "double"))

    return let(F.try_variant_get(document, f"$['{field}']", "variant"), read)


def score(content: Column, field: str = "score") -> Column:
    """The score in a judge's reply, or null when it cannot be read."""
    return let(lenient_object(content), lambda document: number_at(document, field))


def goal_choice(content: Column) -> Column:
    """STRUCT<goal, rationale, desired_behavior> of a valid goal reply, else null."""

    def read(document: Column) -> Column:
        text = lambda name: F.when(
            F.try_variant_get(document, f"$.{name}", "variant").isNotNull(),
            F.coalesce(F.try_variant_get(document, f"$.{name}", "string"), F.lit("None")),
        )
        fields = F.struct(
            string_at(document, "goal").alias("goal"),
            text("rationale").alias("rationale"),
            text("desired_behavior").alias("desired_behavior"),
        )
        valid = lambda f: f["goal"].isin(*OBJECTIVE_BY_GOAL) & f["rationale"].isNotNull() & f["desired_behavior"].isNotNull()
        return let(fields, lambda f: F.when(valid(f), f))

    return let(_object(content), read)
