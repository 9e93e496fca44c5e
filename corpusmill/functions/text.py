"""Whitespace, tokens and normalized text as native expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: one character class that covers exactly the code points that
# Python's str.strip() and str.split() treat as whitespace.
WS_CLASS = r"\s\x1c-\x1f\x85\p{Z}"
WS = f"[{WS_CLASS}]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often body uses it.

    Large expressions over a parsed document would otherwise be multiplied by
    every projection and pushed-down filter that mentions them.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fail_unless(condition: Column, message: Column) -> Column:
    """A filter that lets every row pass and fails the job where the condition
    does not hold.  As a filter it is evaluated whatever columns are used later."""
    return F.when(condition, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))


def strip(text: Column) -> Column:
    """Remove leading and trailing Unicode whitespace."""
    # The look-behind makes a long run of spaces be tried once, not per space.
    return F.regexp_replace(text, rf"\A{WS}|(?<![{WS_CLASS}]){WS}\z", "")


def is_blank(text: Column) -> Column:
    """True when nothing but whitespace is left; null stays null."""
    return ~F.rlike(text, F.lit(f"[^{WS_CLASS}]"))


def has_text(text: Column) -> Column:
    """True only for a non-null string with at least one visible character."""
    return F.coalesce(F.rlike(text, F.lit(f"[^{WS_CLASS}]")), F.lit(False))


def words(text: Column) -> Column:
    """Whitespace-separated tokens; an empty array for blank text."""
    return F.regexp_extract_all(text, F.lit(f"[^{WS_CLASS}]+"), F.lit(0))


def word_spans(text: Column) -> Column:
    """Tokens together with the whitespace that follows, so that joining them
    with nothing in between gives the text back verbatim."""
    return F.regexp_extract_all(text, F.lit(f"[^{WS_CLASS}]+[{WS_CLASS}]*"), F.lit(0))


def word_count(text: Column) -> Column:
    """Number of whitespace-separated tokens."""
    return F.regexp_count(text, F.lit(f"[^{WS_CLASS}]+"))


def normalized_hash(text: Column) -> Column:
    """SHA-256 of the text with whitespace collapsed and case folded down."""
    return F.sha2(F.lower(F.trim(F.regexp_replace(text, WS, " "))), 256)


def uuid_from(*parts: Column) -> Column:
    """A UUID-shaped string that depends only on ``parts``."""
    digest = F.md5(F.concat_ws(":", *parts))
    return F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
