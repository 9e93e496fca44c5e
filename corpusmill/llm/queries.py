"""The registered queries over the operators of this package."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from corpusmill.llm.decontamination import with_passages
from corpusmill.llm.fill_in_middle import fill_in_middle, restored
from corpusmill.llm.html_blocks import extract_main_text
from corpusmill.llm.line_dedup import dedup_lines
from corpusmill.llm.ngram_join import ngram_classes
from corpusmill.llm.packing import concat_and_cut, tokenized
from corpusmill.llm.personal_data import find_personal_data
from corpusmill.llm.personal_data import train as train_tagger
from corpusmill.llm.quality import quality_judgements
from corpusmill.llm.registry import query, table
from corpusmill.llm.suffix_dedup import repeated_spans, without_spans
from corpusmill.llm.toxicity import held_out, scored, train
from corpusmill.llm.vector_codes import code, encoded_vectors, with_label_errors
from corpusmill.llm.warc import described, read_archive, write_archive
from corpusmill.llm.winnowing import edited_and_next, likeness, written
from corpusmill.session import scratch_path

_QUALITY_SQL = r"""
WITH parts AS (
  SELECT doc_id, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
places AS (
  SELECT doc_id, unnest(range(1, len(ws) - 6)) AS i, ws FROM parts WHERE len(ws) > 8),
windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, list_slice(ws, i, i + 7)) AS n FROM places),
gaps AS (
  SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS gap FROM windows WHERE n > 1),
repeats AS (SELECT doc_id, sum(gap)::BIGINT AS n FROM gaps GROUP BY doc_id),
base AS (
  SELECT doc_id, t, ws, ls, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM parts LEFT JOIN repeats USING (doc_id)),
tested AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    10 * n_symbols > 3 * n_words
    OR word_chars < 2 * n_words OR word_chars > 14 * n_words
    OR 10 * len(list_filter(range(2, n_words + 1), lambda i: ws[i] = ws[i - 1])) > 3 * n_words
    OR 2 * (length(t) - length(regexp_replace(t, '\p{Lu}+', '', 'g'))) > word_chars
    OR length(t) - length(regexp_replace(t, '[!?]+', '', 'g')) > n_words
    OR 2 * (length(t) - length(regexp_replace(t, '[0-9]+', '', 'g'))) > word_chars
    OR 10 * n_dup_lines > 7 * len(ls)
    OR 10 * len(list_filter(ls, lambda s: regexp_matches(s, '(\.\.\.|…) *$'))) > 3 * len(ls)
    OR 10 * len(list_filter(ls, lambda s: regexp_matches(s, '^\s*[-•*]\s'))) > 9 * len(ls) AS failed
  FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT failed AS kept
FROM tested"""


@query(_QUALITY_SQL)
def op1_quality_cascade(spark, folder):
    return quality_judgements(table(spark, folder, "documents")).drop("failed_rule")


_WARC_SQL = """
WITH records AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes FROM pages),
leads AS (SELECT html, max(page_id) AS lead FROM records WHERE payload_bytes >= 1000 GROUP BY html)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN lead IS NULL OR lead = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN lead <> page_id THEN lead END AS refers_to
FROM records LEFT JOIN leads USING (html)"""


@query(_WARC_SQL)
def op2_warc_archive(spark, folder):
    archive = scratch_path(spark, "archive")
    write_archive(table(spark, folder, "pages"), archive)
    return described(read_archive(spark, archive)).withColumnRenamed("id", "page_id")


@query()
def op3_toxicity_ftrl(spark, folder):
    docs = table(spark, folder, "documents")
    scores = scored(docs, train(docs, table(spark, folder, "labels")))
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query()
def op4_ngram_join(spark, folder):
    return ngram_classes(table(spark, folder, "documents").select("doc_id", "text"))


@query()
def op5_concat_and_cut(spark, folder):
    return concat_and_cut(tokenized(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json")))


@query()
def op6_block_rules(spark, folder):
    return extract_main_text(table(spark, folder, "pages"))


@query()
def op7_char_lstm_pii(spark, folder):
    docs = table(spark, folder, "documents")
    return find_personal_data(docs, train_tagger(docs))


@query()
def op8_qgram_decontamination(spark, folder):
    found = with_passages(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
    return found.select("doc_id", (F.size("passages") > 0).alias("contaminated"), F.col("passages.item_id").alias("items"))


@query()
def op9_induced_suffix_dedup(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    rest = without_spans(docs, repeated_spans(docs))
    return rest.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query()
def op10_fuzzy_lines(spark, folder):
    docs = dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_gone").alias("n_removed"), "text")


_MIDDLE_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
units AS (
  SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
    ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM texts),
cuts AS (
  SELECT *, len(w)::BIGINT AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM units),
parts AS (
  SELECT *, coalesce(array_to_string(w[1:a], ''), '') AS p, coalesce(array_to_string(w[a + 1:b], ''), '') AS m, coalesce(array_to_string(w[b + 1:], ''), '') AS s
  FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts"""


@query(_MIDDLE_SQL)
def op11_fill_in_middle(spark, folder):
    out = fill_in_middle(table(spark, folder, "documents"))
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")]
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


@query()
def op12_winnowing(spark, folder):
    both = edited_and_next(table(spark, folder, "documents"))
    return both.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        written(F.col("print")).alias("fingerprint"),
        written(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print.hashes"), F.col("edited_print.hashes")).alias("near_edited"),
        likeness(F.col("print.hashes"), F.col("next_hashes")).alias("near_next"),
    )


def _assign_sql(name: str, books: str) -> str:
    return f"""
{name} AS MATERIALIZED (
  SELECT vec_id, p, x, m % 64 AS e, m // 64 AS far FROM (
    SELECT vec_id, a.p, any_value(a.x) AS x,
      min(list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * 64 + b.e) AS m
    FROM parts a JOIN {books} b ON a.p = b.p GROUP BY vec_id, a.p))"""


def _update_sql(name: str, books: str, assignment: str) -> str:
    return f"""
{name} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM {books} b LEFT JOIN (
    SELECT p, e, list((total - ((total % n) + n) % n) // n ORDER BY i) AS x FROM (
      SELECT p, e, i, sum(x[i])::BIGINT AS total, count(*) AS n
      FROM {assignment}, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i) GROUP BY p, e, i)
    GROUP BY p, e) m ON m.p = b.p AND m.e = b.e)"""


_CODES_SQL = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT vec_id, p, v[p * (len(v) // 16) + 1:(p + 1) * (len(v) // 16)] AS x FROM kept, LATERAL (SELECT unnest(range(16)) AS p)),
book0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x FROM parts QUALIFY e < 64),
{_assign_sql("first", "book0")}, {_update_sql("book1", "book0", "first")},
{_assign_sql("second", "book1")}, {_update_sql("book2", "book1", "second")},
{_assign_sql("final", "book2")},
coded AS (
  SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(far)::BIGINT AS error FROM final GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM book2) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)"""


@query(_CODES_SQL)
def op13_active_lloyd(spark, folder):
    coded, books = encoded_vectors(table(spark, folder, "embeddings"))
    digest = F.lit(books.digest() if books else None).cast("string")
    return with_label_errors(coded).select(F.col("id").alias("vec_id"), code().alias("code"), "error", "label_error", digest.alias("codebooks_sha256"))
