"""The source manifest and run ledgers: small relational tables.

sources: source_id, project_id, filename, source_hash, relative_path, size_bytes,
confirmed_schema, column_mapping, created_at, ord.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import uuid_from
from corpusmill.operators.detection import SHAPES

_OWNER = ("project_id", "source_hash")


def stored_path(project_id: Column, source_hash: Column, filename: Column) -> Column:
    """Content-addressed place of a source; the suffix is that of its first name."""
    suffix = F.regexp_extract(filename, r"[^/](\.[^./]*)$", 1)
    return F.concat(F.lit("projects/"), project_id, F.lit("/sources/"), source_hash, suffix)


def add_sources(incoming: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """New manifest rows for ``incoming`` (project_id, filename, source_hash,
    size_bytes, ord).

    The same content enters a project once, under the name it had first; what
    the manifest already has is left out.  The first of a content is a
    pre-aggregated minimum, so many copies of one file stay cheap.
    """
    first = incoming.groupBy(*_OWNER).agg(F.min("ord").alias("ord"))
    fresh = incoming.join(first.select("ord"), "ord", "left_semi")
    if manifest is not None:
        fresh = fresh.join(manifest.select(*_OWNER), list(_OWNER), "left_anti")
    return fresh.select(
        uuid_from(F.col("project_id"), F.col("source_hash")).alias("source_id"),
        "project_id",
        "filename",
        "source_hash",
        stored_path(F.col("project_id"), F.col("source_hash"), F.col("filename")).alias("relative_path"),
        "size_bytes",
        F.lit(None).cast("string").alias("confirmed_schema"),
        F.lit(None).cast("map<string,string>").alias("column_mapping"),
        "ord",
    )


def list_sources(manifest: DataFrame, project_id: str) -> DataFrame:
    """Sources of one project, oldest first."""
    return manifest.where(F.col("project_id") == project_id).orderBy("ord")


def list_active(projects: DataFrame, created: str = "created_at") -> DataFrame:
    """Projects that are not deleted, oldest first."""
    return projects.where("deleted_at IS NULL").orderBy(created)


def latest(table: DataFrame, *keys: str, by: str, columns: tuple[str, ...]) -> DataFrame:
    """Per key, the row with the highest ``by`` (checkpoints by sequence, model
    profiles by creation time)."""
    newest = F.max_by(F.struct(*columns), by).alias("newest")
    return table.groupBy(*keys).agg(newest, F.max(by).alias(by)).select(*keys, by, *[F.col(f"newest.{c}").alias(c) for c in columns])


def confirm_mapping(manifest: DataFrame, confirmations: DataFrame) -> DataFrame:
    """Store (source_id, confirmed_schema, column_mapping) on the manifest.

    A schema that is not detectable is refused: the source stays unconfirmed.
    """
    known = confirmations.where(F.col("confirmed_schema").isin(*[shape for shape, _, _ in SHAPES])).select(
        "source_id", F.col("confirmed_schema").alias("_schema"), F.col("column_mapping").alias("_mapping")
    )
    return (
        manifest.join(known, "source_id", "left")
        .withColumn("column_mapping", F.when(F.col("_schema").isNotNull(), F.col("_mapping")).otherwise(F.col("column_mapping")))
        .withColumn("confirmed_schema", F.coalesce("_schema", "confirmed_schema"))
        .drop("_schema", "_mapping")
    )


def split_confirmed(manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(structured sources, document sources)."""
    return manifest.where("confirmed_schema IS NOT NULL"), manifest.where("confirmed_schema IS NULL")


def run_summary(records: DataFrame, runs: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """Accepted rows per run by where they came from, with its skipped sources.

    ``records`` has run_id and ``metadata``; ``runs`` has run_id, status,
    is_preview; ``skipped`` has run_id, source_id, reason.
    """
    counted = (
        records.groupBy("run_id", F.col("metadata.source_kind").alias("source_kind"))
        .agg(F.count("*").alias("n"))
        .groupBy("run_id")
        .pivot("source_kind", ["document", "structured"])
        .agg(F.sum("n"))
    )
    generated, normalized = F.coalesce("document", F.lit(0)), F.coalesce("structured", F.lit(0))
    summary = runs.join(counted, "run_id", "left").select(
        "run_id",
        "status",
        "is_preview",
        generated.alias("accepted_generated"),
        normalized.alias("accepted_normalized"),
        (generated + normalized).alias("completed_rows"),
        (generated + normalized).alias("total_rows"),
    )
    if skipped is None:
        return summary.withColumn("n_skipped", F.lit(0).cast("bigint"))
    left_out = skipped.groupBy("run_id").agg(F.count("*").alias("n_skipped"))
    return summary.join(left_out, "run_id", "left").withColumn("n_skipped", F.coalesce("n_skipped", F.lit(0)))
