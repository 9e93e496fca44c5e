"""Schema detection, column mapping, previews."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.replies import json_type

# Detectable shapes in order of priority.  Each names the columns
# that must be there, and the type one of them must have.
SHAPES = (
    ("prompt_chosen_rejected", ("prompt", "chosen", "rejected"), None),
    ("messages", ("messages",), "array"),
    ("conversations", ("conversations",), "array"),
    ("prompt_completion", ("prompt", "completion"), None),
    ("instruction_input_output", ("instruction", "output"), None),
    ("text", ("text",), "string"),
)
PREVIEW_ROWS = 20


class ColumnMappingError(ValueError):
    """A mapping names a missing column or cannot be applied."""


def detect_columns(df: DataFrame) -> str | None:
    """Shape of a typed DataFrame, from its column names and types alone."""
    types = {"array": T.ArrayType, "string": T.StringType}
    for shape, names, wanted in SHAPES:
        if set(names) <= set(df.columns):
            if wanted is None or isinstance(df.schema[names[0]].dataType, types[wanted]):
                return shape
    return None


def shape_index(data: Column) -> Column:
    """Position in ``SHAPES`` of the shape of one free-form row, -1 for none."""
    found = F.lit(-1)
    for index in reversed(range(len(SHAPES))):
        _, names, wanted = SHAPES[index]
        fits = F.lit(True)
        for name in names:
            fits = fits & F.map_contains_key(data, F.lit(name))
        if wanted is not None:
            fits = fits & F.coalesce(json_type(data[names[0]]).startswith(wanted.upper()), F.lit(False))
        found = F.when(fits, F.lit(index)).otherwise(found)
    return found


def detect_sources(rows: DataFrame, source: str = "path", data: str = "data") -> DataFrame:
    """(source, schema_name, confidence, matched_keys) from each source's first row.

    Every row is reduced to a small number before the pre-aggregated minimum, so
    all sources are done in one even pass, however large one of them is.
    """
    shapes = F.array(*[F.lit(shape) for shape, _, _ in SHAPES])
    keys = F.array(*[F.array(*map(F.lit, names)) for _, names, _ in SHAPES])
    return (
        rows.select(source, "row_no", shape_index(F.col(data)).alias("shape"))
        .groupBy(source)
        .agg(F.min_by("shape", "row_no").alias("shape"))
        .select(
            source,
            F.when(F.col("shape") >= 0, F.get(shapes, F.col("shape"))).alias("schema_name"),
            F.when(F.col("shape") >= 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("confidence"),
            F.coalesce(F.get(keys, F.col("shape")), F.array().cast("array<string>")).alias("matched_keys"),
        )
    )


def _check_mapping(mapping: Mapping[str, str]) -> None:
    swapped = set(mapping) & set(mapping.values())
    if swapped - {a for a, c in mapping.items() if a == c}:
        raise ColumnMappingError(f"columns are both renamed and renamed to: {sorted(swapped)}")
    if len(set(mapping.values())) < len(mapping):
        raise ColumnMappingError("two columns are renamed to the same name")


def map_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename actual to canonical columns of a typed DataFrame and keep the rest;
    an existing column of the canonical name is replaced."""
    _check_mapping(mapping)
    missing = [name for name in mapping if name not in df.columns]
    if missing:
        raise ColumnMappingError(f"missing expected columns: {missing}")
    replaced = [canonical for actual, canonical in mapping.items() if canonical != actual]
    return df.drop(*replaced).withColumnsRenamed(dict(mapping))


def map_row_keys(rows: DataFrame, mapping: Mapping[str, str], data: str = "data") -> DataFrame:
    """The same for free-form rows; a row without an expected key gets the
    ``reject_reason`` 'missing_column'."""
    _check_mapping(mapping)
    replaced = [canonical for actual, canonical in mapping.items() if canonical != actual]
    names = F.create_map(*[F.lit(part) for pair in mapping.items() for part in pair])
    kept = F.map_filter(data, lambda key, _: ~key.isin(*replaced)) if replaced else F.col(data)
    complete = F.lit(True)
    for actual in mapping:
        complete = complete & F.map_contains_key(data, F.lit(actual))
    renamed = F.transform_keys(kept, lambda key, _: F.coalesce(names[key], key))
    return rows.select(
        *[c for c in rows.columns if c != data],
        F.when(complete, renamed).otherwise(F.col(data)).alias(data),
        F.when(~complete, F.lit("missing_column")).alias("reject_reason"),
    )


def preview(rows: DataFrame, normalize, limit: int = PREVIEW_ROWS) -> DataFrame:
    """Normalize the first ``limit`` rows only, so later bad rows do not matter."""
    return normalize(rows.orderBy("ord").limit(limit))
