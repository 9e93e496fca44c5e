"""The manifest, ledgers, and reading and writing of records."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import cpt_documents, doc_of, labelled, query, table
from corpusmill.functions.records import CPT, EXPORT_COLUMNS
from corpusmill.session import scratch_path
from corpusmill.sources.manifest import add_sources, confirm_mapping, latest, list_active, list_sources, run_summary, split_confirmed
from corpusmill.sources.records_io import export_bundle, export_rows, first_records, load_jsonl, read_bundle, read_run, write_run


def _incoming(spark, folder):
    """Every document uploaded to the project named by its language."""
    return table(spark, folder, "documents").select(
        F.col("lang").alias("project_id"),
        F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"),
        F.sha2("text", 256).alias("source_hash"),
        F.octet_length("text").cast("bigint").alias("size_bytes"),
        F.col("doc_id").alias("ord"),
    )


_MANIFEST_SQL = """manifest AS (
  SELECT lang AS project_id, source || '_' || doc_id || '.txt' AS filename, sha256(text) AS source_hash, octet_length(encode(text)) AS size_bytes,
    'projects/' || lang || '/sources/' || sha256(text) || '.txt' AS relative_path, doc_id AS ord
  FROM documents QUALIFY row_number() OVER (PARTITION BY lang, sha256(text) ORDER BY doc_id) = 1)"""
_COLUMNS = ("project_id", "filename", "source_hash", "size_bytes", "relative_path", "ord")


@query(f"WITH {_MANIFEST_SQL} SELECT * FROM manifest")
def manifest_of_uploads(spark, folder):
    """One source per content and project, under its first name."""
    return add_sources(_incoming(spark, folder)).select(*_COLUMNS)


@query(
    f"""WITH {_MANIFEST_SQL} SELECT * FROM manifest m
    WHERE NOT EXISTS (SELECT 1 FROM documents d JOIN labels USING (doc_id) WHERE toxic = 1 AND d.lang = m.project_id AND sha256(d.text) = m.source_hash)"""
)
def manifest_update(spark, folder):
    """Uploads against a manifest that has the contents labelled toxic already."""
    old = labelled(spark, folder).where("toxic = 1").select(F.col("lang").alias("project_id"), F.sha2("text", 256).alias("source_hash"))
    return add_sources(_incoming(spark, folder), old).select(*_COLUMNS)


@query(f"WITH {_MANIFEST_SQL} SELECT filename, ord FROM manifest WHERE project_id = 'fr'")
def project_sources(spark, folder):
    return list_sources(add_sources(_incoming(spark, folder)), "fr").select("filename", "ord")


@query("SELECT doc_id, source FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(toxic, 0) = 0")
def active_projects(spark, folder):
    """Documents stand for projects; those labelled toxic are deleted."""
    projects = labelled(spark, folder).withColumn("deleted_at", F.when(F.col("toxic") == 1, F.lit("2024-01-01")))
    return list_active(projects, "doc_id").select("doc_id", "source")


@query(
    "SELECT source AS run_id, max(doc_id) AS sequence, arg_max(n_chars, doc_id) AS completed_rows FROM documents GROUP BY source"
)
def latest_checkpoints(spark, folder):
    """The checkpoint of the highest sequence of every run."""
    checkpoints = table(spark, folder, "documents").select(
        F.col("source").alias("run_id"), F.col("doc_id").alias("sequence"), F.col("n_chars").alias("completed_rows")
    )
    return latest(checkpoints, "run_id", by="sequence", columns=("completed_rows",))


_SHAPE = {"en": "text", "fr": "prompt_completion", "de": "unknown_shape"}


@query(
    f"""WITH {_MANIFEST_SQL} SELECT ord, project_id IN ('en', 'fr') AS structured,
      CASE project_id WHEN 'en' THEN 'text' WHEN 'fr' THEN 'prompt_completion' END AS confirmed_schema,
      CASE WHEN project_id IN ('en', 'fr') THEN 'body' END AS mapped_from FROM manifest"""
)
def confirmed_sources(spark, folder):
    """Confirmed mappings split the manifest into structured and document sources."""
    manifest = add_sources(_incoming(spark, folder))
    shapes = F.create_map(*[F.lit(part) for pair in _SHAPE.items() for part in pair])
    confirmations = manifest.where(shapes[F.col("project_id")].isNotNull()).select(
        "source_id", shapes[F.col("project_id")].alias("confirmed_schema"), F.create_map(F.lit("body"), F.lit("text")).alias("column_mapping")
    )
    structured, documents = split_confirmed(confirm_mapping(manifest, confirmations))
    pick = lambda df, flag: df.select(
        "ord", F.lit(flag).alias("structured"), "confirmed_schema", F.get(F.map_keys("column_mapping"), F.lit(0)).alias("mapped_from")
    )
    return pick(structured, True).unionByName(pick(documents, False))


@query(
    """SELECT source AS run_id, 'completed' AS status, count(*) FILTER (lang = 'en') AS accepted_generated,
      count(*) FILTER (lang <> 'en') AS accepted_normalized, count(*) AS completed_rows, count(*) AS total_rows,
      coalesce(max(n_toxic), 0) AS n_skipped
    FROM documents LEFT JOIN (SELECT source, count(*) AS n_toxic FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY source) t USING (source)
    GROUP BY source"""
)
def run_summaries(spark, folder):
    """Accepted rows of every run by origin, with its skipped sources."""
    docs = labelled(spark, folder)
    records = docs.select(
        F.col("source").alias("run_id"),
        F.struct(F.when(F.col("lang") == "en", F.lit("document")).otherwise(F.lit("structured")).alias("source_kind")).alias("metadata"),
    )
    runs = docs.select(F.col("source").alias("run_id"), F.lit("completed").alias("status"), F.lit(False).alias("is_preview")).distinct()
    skipped = docs.where("toxic = 1").select(F.col("source").alias("run_id"), F.col("doc_id").alias("source_id"), F.lit("x").alias("reason"))
    return run_summary(records, runs, skipped).drop("is_preview")


# --- records in and out -------------------------------------------------------------


_RECORD_SQL = """SELECT doc_id::VARCHAR AS document_id, source AS source_name, sha256(text) AS text_hash, doc_id || '-0' AS chunk_id,
  true AS extra_is_null FROM documents"""


def _columns(rows):
    return rows.select(
        "metadata.document_id", "metadata.source_name", F.sha2("text", 256).alias("text_hash"), "metadata.chunk_id",
        F.col("metadata.extra").isNull().alias("extra_is_null"),
    )


@query(_RECORD_SQL)
def records_from_jsonl(spark, folder):
    """Records written as JSON lines and loaded with the fixed schema."""
    path = scratch_path(spark, "records")
    export_rows(cpt_documents(spark, folder), CPT).write.option("ignoreNullFields", "false").json(path)
    return _columns(load_jsonl(spark, path, CPT))


@query("SELECT doc_id, sha256(text) AS text_hash, (SELECT count(*) FROM documents) AS total FROM documents ORDER BY doc_id LIMIT 20")
def first_run_records(spark, folder):
    shown = first_records(cpt_documents(spark, folder))
    return shown.select(doc_of(F.col("ord")).alias("doc_id"), F.sha2("text", 256).alias("text_hash"), "total")


def _exported(spark, folder):
    path = scratch_path(spark, "bundle")
    return path, export_bundle(cpt_documents(spark, folder), CPT, path)


@query(_RECORD_SQL)
def exported_parquet(spark, folder):
    """The bundle's Parquet, checked on export and read back."""
    path, _ = _exported(spark, folder)
    return _columns(spark.read.parquet(f"{path}/train.parquet"))


@query(_RECORD_SQL)
def exported_jsonl(spark, folder):
    """The bundle's JSONL, nulls kept, read back."""
    path, _ = _exported(spark, folder)
    return _columns(load_jsonl(spark, f"{path}/train.jsonl", CPT))


@query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS position, doc_id::VARCHAR AS document_id, sha256(text) AS text_hash FROM documents")
def exported_order(spark, folder):
    """The bundle's records in the order they are read, which is that of the run."""
    path = scratch_path(spark, "bundle")
    # Written from rows that lie in another order.
    export_bundle(cpt_documents(spark, folder).repartition(7, F.xxhash64("ord")), CPT, path)
    return read_bundle(spark, path).select("position", "metadata.document_id", F.sha2("text", 256).alias("text_hash"))


@query(
    """SELECT 'cpt' AS kind, count(*) AS n_told, count(*) AS n_read FROM documents
    UNION ALL SELECT kind, 0, 0 FROM (VALUES ('sft_prompt_completion'), ('sft_conversation'), ('dpo')) AS k(kind)"""
)
def exported_kinds(spark, folder):
    """A bundle of every kind from the same run; a kind without records has no files."""
    path = scratch_path(spark, "bundle")
    records = cpt_documents(spark, folder)
    told = spark.createDataFrame([(kind, export_bundle(records, kind, f"{path}/{kind}")) for kind in EXPORT_COLUMNS], "kind string, n_told bigint")
    # The path matches those bundles only that have been written.
    files = spark.read.parquet(f"{path}/*/train.parquet").select(F.regexp_extract("_metadata.file_path", "/([^/]+)/train[.]parquet/", 1).alias("kind"))
    read = files.groupBy("kind").agg(F.count("*").alias("n_read"))
    return told.join(read, "kind", "left").select("kind", "n_told", F.coalesce("n_read", F.lit(0)).cast("bigint").alias("n_read"))


@query("SELECT count(*) AS n_checked FROM documents")
def reload_checked(spark, folder):
    """Rows whose fingerprint was the same after reading back (a mismatch fails)."""
    path, n = _exported(spark, folder)
    return spark.read.parquet(f"{path}/train.parquet").agg(F.count("*").alias("n_checked")).where(F.col("n_checked") == n)


@query("SELECT 'generated' AS part, count(*) AS n FROM documents WHERE lang = 'en' UNION ALL SELECT 'normalized', count(*) FROM documents WHERE lang <> 'en'")
def run_parts(spark, folder):
    """Both parts of a run; writing one again replaces it."""
    path = scratch_path(spark, "runs")
    docs = cpt_documents(spark, folder, "lang")
    for part, rows in (("generated", docs.where("lang = 'en'")), ("normalized", docs.where("lang <> 'en'"))) * 2:
        write_run(rows.drop("lang"), path, "r1", part)
    return read_run(spark, path, "r1").groupBy("part").agg(F.count("*").alias("n"))
