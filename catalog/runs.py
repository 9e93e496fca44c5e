"""Run assembly: caps, merging, resuming, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.dedup import HASH_SQL
from catalog.documents import PAGE_CHUNKS_SQL, page_table
from catalog.registry import cpt_documents, doc_of, document_metadata, query, table
from catalog.validation import MAX_TOKENS, decided_sql
from corpusmill.functions.records import CPT, as_records, position
from corpusmill.functions.text import normalized_hash
from corpusmill.operators.chunking import as_sources, chunk_blocks
from corpusmill.operators.generation import generate
from corpusmill.operators.structure import flag_structure
from corpusmill.plans.run import assemble_run, first_in_order, generate_to_target, target_rows, unprocessed
from corpusmill.plans.validation import validate
from corpusmill.plans.waves import WaveValidator
from corpusmill.session import materialize, scratch_path, spread
from corpusmill.streaming.incremental import dedup_stream, process_stream, read_stream

TARGET = 500


@query(f"SELECT doc_id, sha256(text) AS text_hash FROM documents ORDER BY doc_id LIMIT {TARGET}")
def capped_run(spark, folder):
    """The first accepted rows of a run with a target."""
    kept = first_in_order(cpt_documents(spark, folder), target_rows(TARGET))
    return kept.select(doc_of(F.col("ord")).alias("doc_id"), F.sha2("text", 256).alias("text_hash"))


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 10")
def preview_run(spark, folder):
    kept = first_in_order(cpt_documents(spark, folder), target_rows(TARGET, is_preview=True))
    return kept.select(doc_of(F.col("ord")).alias("doc_id"))


def _halves(spark, folder):
    """Generated records from English documents, structured ones from the others."""
    docs = cpt_documents(spark, folder, "lang")
    return docs.where("lang = 'en'").drop("lang"), docs.where("lang <> 'en'").drop("lang")


def _shape_only(records):
    from corpusmill.plans.validation import Validation

    return Validation(flag_structure(records, MAX_TOKENS), "lower_assurance")


_FITS = rf"len(regexp_extract_all(text, '\S+')) <= {MAX_TOKENS}"


def _merged_sql(target: str, after: bool) -> str:
    rest = (
        f"SELECT * FROM others WHERE {_FITS} QUALIFY row_number() OVER (ORDER BY doc_id) <= (SELECT n FROM room)"
        if after
        else f"SELECT * FROM (SELECT * FROM others QUALIFY row_number() OVER (ORDER BY doc_id) <= (SELECT n FROM room)) WHERE {_FITS}"
    )
    return f"""WITH others AS (SELECT * FROM documents WHERE lang <> 'en'),
      generated AS (SELECT * FROM documents WHERE lang = 'en' AND {_FITS}),
      room AS (SELECT {target} - count(*) AS n FROM generated)
    SELECT 'generated' AS part, doc_id FROM generated UNION ALL SELECT 'normalized', doc_id FROM ({rest})"""


_TARGET_SQL = "(SELECT 3 * count(*) // 4 FROM documents)"


def _merged(spark, folder, cap):
    generated, structured = _halves(spark, folder)
    target = 3 * table(spark, folder, "documents").count() // 4
    path = scratch_path(spark, "runs")
    run = assemble_run(generated, structured, path, "r1", validate_generated=_shape_only, validate_structured=_shape_only, target=target, cap=cap)
    return run.select("part", doc_of(F.col("ord")).alias("doc_id"))


@query(_merged_sql(_TARGET_SQL, after=False))
def merged_run(spark, folder):
    """Structured rows are cut to the room left, then validated."""
    return _merged(spark, folder, "before")


@query(_merged_sql(_TARGET_SQL, after=True))
def merged_run_filled(spark, folder):
    """Structured rows are validated first and fill the room."""
    return _merged(spark, folder, "after")


@query(
    f"""WITH RECURSIVE english AS (SELECT * FROM documents WHERE lang = 'en'), {decided_sql('english')}
    SELECT 'generated' AS part, doc_id FROM decided WHERE reject_reason IS NULL
    UNION ALL SELECT 'normalized', doc_id FROM documents WHERE lang <> 'en' AND {_FITS}"""
)
def assembled_run(spark, folder):
    """A whole uncapped run: generated records go through the full validation."""
    generated, structured = _halves(spark, folder)
    run = assemble_run(
        spread(generated, "ord"), structured, scratch_path(spark, "runs"), "r1",
        validate_generated=lambda records: validate(records, max_tokens=MAX_TOKENS), validate_structured=_shape_only,
    )
    return run.select("part", doc_of(F.col("ord")).alias("doc_id"))


@query(f"SELECT doc_id FROM documents WHERE {_FITS} ORDER BY doc_id LIMIT {_TARGET_SQL}")
def targeted_run(spark, folder):
    """Chunks in waves until the target is met; the last wave is not started."""
    docs = table(spark, folder, "documents")
    n = docs.count()
    chunks = docs.select(position(F.col("doc_id")).alias("ord"), "doc_id", "text", "source")

    def produce(batch):
        records = as_records(batch, CPT, ord=F.col("ord"), text=F.col("text"), metadata=document_metadata())
        return flag_structure(records, MAX_TOKENS).where("reject_reason IS NULL").drop("reject_reason")

    run = generate_to_target(chunks, produce, scratch_path(spark, "runs"), "r1", target=3 * n // 4, wave=n // 6 + 1)
    return run.select(doc_of(F.col("ord")).alias("doc_id"))


@query(
    f"""WITH RECURSIVE {PAGE_CHUNKS_SQL},
    records AS MATERIALIZED (SELECT document_id::BIGINT * 1000000 + chunk_no AS doc_id, chunk_id, text FROM chunks),
    {decided_sql('records')}
    SELECT chunk_id, sha256(text) AS text_hash, reject_reason FROM records JOIN decided USING (doc_id)"""
)
def page_records(spark, folder):
    """Web pages all the way: extract, chunk, make text records, validate.

    The records are written before they are validated, which reads them twice.
    """
    pages = page_table(spark, folder).select(
        "page_id", F.col("page_id").cast("string").alias("document_id"), F.lit("page").alias("source_name"), F.lit("h").alias("source_hash"), "blocks"
    )
    chunks = as_sources(chunk_blocks(pages, "page_id", "source_name", "source_hash"), "page_id")
    records, _ = generate(chunks, CPT)
    result = validate(materialize(records, "records"), max_tokens=MAX_TOKENS)
    return result.decided.select("metadata.chunk_id", F.sha2("text", 256).alias("text_hash"), "reject_reason")


def _waved(spark, folder, waves):
    """Documents in so many waves, each validated against all before it."""
    docs = table(spark, folder, "documents")
    chunks = docs.select(position(F.col("doc_id")).alias("ord"), "doc_id", "text", "source")
    path = scratch_path(spark, "runs")

    def produce(batch):
        return as_records(spread(batch, "ord"), CPT, ord=F.col("ord"), text=F.col("text"), metadata=document_metadata())

    validator = WaveValidator(f"{path}/ledgers", MAX_TOKENS)
    run = generate_to_target(chunks, produce, path, "r1", target=None, wave=docs.count() // waves + 1, validate=validator)
    return run.select(doc_of(F.col("ord")).alias("doc_id"))


_WAVED_SQL = f"WITH RECURSIVE {decided_sql()} SELECT doc_id FROM decided WHERE reject_reason IS NULL"


@query(_WAVED_SQL)
def waved_run(spark, folder):
    """The same rows as one validation of everything."""
    return _waved(spark, folder, 2)


@query(_WAVED_SQL)
def waved_run_of_small_waves(spark, folder):
    return _waved(spark, folder, 3)


# --- resuming and streams ---------------------------------------------------------------


@query("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL")
def resumed_chunks(spark, folder):
    """What is left to do when the labelled documents are done."""
    chunks = table(spark, folder, "documents").select("doc_id", F.col("doc_id").cast("string").alias("chunk_id"), "text")
    done = table(spark, folder, "labels").select(F.col("doc_id").cast("string").alias("chunk_id"))
    return unprocessed(chunks, done).select("doc_id")


def _stream(spark, folder):
    """The documents as files that arrive in four batches; there are as many files as splits of the table, so no task writes a fixed share of it."""
    path = scratch_path(spark, "arrivals")
    docs = table(spark, folder, "documents").select(position(F.col("doc_id")).alias("ord"), "doc_id", "text", "source")
    files = max(4, docs.rdd.getNumPartitions())
    docs.repartitionByRange(files, "ord").write.parquet(path)
    return read_stream(spark, path, "ord bigint, doc_id bigint, text string, source string", files_per_batch=-(-files // 4))


def _drain(start, path):
    query_ = start(path, f"{path}-checkpoint")
    query_.awaitTermination()


@query(rf"SELECT doc_id, sha256(text) AS text_hash FROM documents WHERE {_FITS}")
def streamed_run(spark, folder):
    """Records of a stream of chunk files, each micro-batch checked and written."""
    out = scratch_path(spark, "stream")

    def process(batch, batch_id):
        meta = document_metadata()
        records = as_records(batch, CPT, ord=F.col("ord"), text=F.col("text"), metadata=meta)
        return flag_structure(records, MAX_TOKENS).where("reject_reason IS NULL").drop("reject_reason")

    _drain(lambda path, checkpoint: process_stream(_stream(spark, folder), path, checkpoint, process), out)
    written = spark.read.parquet(out)
    return written.select(doc_of(F.col("ord")).alias("doc_id"), F.sha2("text", 256).alias("text_hash"))


@query(f"SELECT {HASH_SQL} AS text_hash, 1::BIGINT AS n FROM documents GROUP BY {HASH_SQL}")
def streamed_dedup(spark, folder):
    """Every normalized text once, however its copies are spread over batches."""
    out = scratch_path(spark, "stream")
    _drain(lambda path, checkpoint: dedup_stream(_stream(spark, folder), path, checkpoint), out)
    return spark.read.parquet(out).groupBy(normalized_hash(F.col("text")).alias("text_hash")).agg(F.count("*").alias("n"))
