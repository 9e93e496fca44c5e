"""Structured rows: reading, detection, mapping, normalization, URL rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import conversations, doc_of, labelled, query, row_columns, table
from corpusmill.functions.records import CPT, DPO, SFT_CONVERSATION, SFT_PAIR, position
from corpusmill.operators.detection import detect_columns, detect_sources, map_columns, map_row_keys, preview
from corpusmill.operators.normalize import (
    ROLE_BY_SENDER,
    normalize_conversations,
    normalize_instruction,
    normalize_messages,
    normalize_preference,
    normalize_prompt_completion,
    normalize_rows,
    normalize_text,
    route_sources,
)
from corpusmill.operators.urls import citation, is_allowed, keep_allowed
from corpusmill.session import scratch_path
from corpusmill.sources.structured import attach_sources, read_csv_rows, read_json_rows, read_jsonl_rows, read_structured

CSV = {"header": True, "quoteAll": True, "escape": '"', "maxRecordsPerFile": 200_000}
JSON_GROUP = 1000  # rows of one JSON array file


def string_of(name: str):
    return F.try_variant_get(F.col("data")[F.lit(name)], "$", "string")


def long_of(name: str):
    return F.try_variant_get(F.col("data")[F.lit(name)], "$", "bigint")


# --- readers: written from the tables, read back ------------------------------


def _csv(spark, folder):
    path = scratch_path(spark, "csv")
    table(spark, folder, "documents").select("doc_id", "text", "lang", "source").write.options(**CSV).csv(path)
    return read_csv_rows(spark, path)


@query("SELECT doc_id::VARCHAR AS doc_id, sha256(text) AS text_hash, lang, source FROM documents")
def csv_rows(spark, folder):
    rows = _csv(spark, folder)
    return rows.select(
        string_of("doc_id").alias("doc_id"),
        F.sha2(string_of("text"), 256).alias("text_hash"),
        string_of("lang").alias("lang"),
        string_of("source").alias("source"),
    )


@query("SELECT count(*) AS n_rows, true AS numbered FROM documents")
def csv_row_numbers(spark, folder):
    """Row ids of a file run from 0 without a gap."""
    per_file = (
        _csv(spark, folder)
        .groupBy("path")
        .agg(F.count("*").alias("n"), F.countDistinct("row_id").alias("ids"), F.max("row_no").alias("last"))
    )
    numbered = (F.col("ids") == F.col("n")) & (F.col("last") == F.col("n") - 1)
    return per_file.agg(F.sum("n").alias("n_rows"), F.bool_and(numbered).alias("numbered"))


@query(
    f"SELECT doc_id, (row_number() OVER (PARTITION BY doc_id // {JSON_GROUP} ORDER BY doc_id) - 1)::VARCHAR AS row_id, "
    "sha256(text) AS text_hash FROM documents"
)
def json_rows(spark, folder):
    """Files of one JSON array each; the row id is the place in the array."""
    path = scratch_path(spark, "json")
    docs = table(spark, folder, "documents").withColumn("file", F.floor(F.col("doc_id") / JSON_GROUP))
    rows = F.array_sort(F.collect_list(F.struct("doc_id", "text")))
    arrays = docs.groupBy("file").agg(F.to_json(rows).alias("value"))
    arrays.write.partitionBy("file").text(path)
    return read_json_rows(spark, f"{path}/*").select(
        long_of("doc_id").alias("doc_id"), "row_id", F.sha2(string_of("text"), 256).alias("text_hash")
    )


@query("SELECT doc_id, sha256(text) AS text_hash, 0::BIGINT AS line_parity FROM documents")
def jsonl_rows(spark, folder):
    """Every record is followed by a blank line, so records are on even lines."""
    path = scratch_path(spark, "jsonl")
    docs = table(spark, folder, "documents").select(F.to_json(F.struct("doc_id", "text")).alias("line"))
    docs.select(F.explode(F.array("line", F.lit(""))).alias("value")).write.text(path)
    return read_jsonl_rows(spark, path).select(
        long_of("doc_id").alias("doc_id"),
        F.sha2(string_of("text"), 256).alias("text_hash"),
        (F.col("row_no") % 2).alias("line_parity"),
    )


@query(
    "SELECT 'csv' AS format, doc_id, lang FROM documents UNION ALL SELECT 'jsonl', doc_id, lang FROM documents"
)
def structured_by_suffix(spark, folder):
    """The reader is chosen by the suffix of the source's name."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    csv_path, jsonl_path = scratch_path(spark, "rows") + ".CSV", scratch_path(spark, "rows") + ".jsonl"
    docs.write.options(**CSV).csv(csv_path)
    docs.write.json(jsonl_path)
    read = [
        read_structured(spark, path).select(
            F.lit(name).alias("format"), string_of("doc_id").cast("bigint").alias("doc_id"), string_of("lang").alias("lang")
        )
        for name, path in (("csv", csv_path), ("jsonl", jsonl_path))
    ]
    return read[0].unionByName(read[1])


@query("SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY source")
def rows_with_sources(spark, folder):
    """Rows joined with the source they came from, by path."""
    path = scratch_path(spark, "by-source")
    docs = table(spark, folder, "documents")
    docs.select("source", F.to_json(F.struct("doc_id", "n_chars")).alias("value")).write.partitionBy("source").text(path)
    rows = read_jsonl_rows(spark, f"{path}/*")
    sources = rows.select("path").distinct().withColumn("source_name", F.regexp_extract("path", "source=([^/]+)/", 1))
    return (
        attach_sources(rows, sources)
        .groupBy(F.col("source_name").alias("source"))
        .agg(F.count("*").alias("n"), F.sum(long_of("n_chars")).alias("n_chars"))
    )


# --- detection and mapping ----------------------------------------------------


def _free_rows(spark, folder):
    """Documents as free-form rows whose keys depend on the language."""
    text = F.col("text")
    fields = (
        F.when(F.col("lang") == "en", F.to_json(F.struct(text.alias("text"), F.col("n_chars").alias("size"))))
        .when(
            F.col("lang") == "fr",
            F.to_json(F.struct(F.col("source").alias("prompt"), text.alias("completion"), F.lit("x").alias("text"))),
        )
        .when(F.col("lang") == "de", F.to_json(F.struct(F.col("source").alias("instruction"), text.alias("output"))))
        .otherwise(F.to_json(F.struct(F.col("source").alias("question"), text.alias("answer"))))
    )
    docs = table(spark, folder, "documents")
    data = F.parse_json(fields).cast("map<string,variant>").alias("data")
    return docs.select(
        "doc_id",
        "source",
        F.col("doc_id").alias("row_no"),
        *row_columns(position(F.col("doc_id")), F.col("source"), F.col("doc_id")),
        data,
    )


_SHAPE_SQL = """CASE {lang} WHEN 'en' THEN 'text' WHEN 'fr' THEN 'prompt_completion'
  WHEN 'de' THEN 'instruction_input_output' END"""
_KEYS_SQL = """CASE {lang} WHEN 'en' THEN 'text' WHEN 'fr' THEN 'prompt,completion'
  WHEN 'de' THEN 'instruction,output' ELSE '' END"""


@query(
    f"""SELECT source, {_SHAPE_SQL.format(lang='lang')} AS schema_name,
      CASE WHEN {_SHAPE_SQL.format(lang='lang')} IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS confidence,
      {_KEYS_SQL.format(lang='lang')} AS matched_keys
    FROM (SELECT source, arg_min(lang, doc_id) AS lang FROM documents GROUP BY source)"""
)
def detected_schemas(spark, folder):
    found = detect_sources(_free_rows(spark, folder), "source")
    return found.withColumn("matched_keys", F.array_join("matched_keys", ","))


@query(
    """SELECT conv_id, 'messages' AS schema_name FROM (SELECT DISTINCT conv_id FROM conversations)
    UNION ALL SELECT -1 - conv_id, 'conversations' FROM (SELECT DISTINCT conv_id FROM conversations)"""
)
def detected_list_schemas(spark, folder):
    """Lists of messages and of turns, each conversation a source of its own."""
    folded = conversations(spark, folder)
    turns = F.transform("messages", lambda m: F.struct(m["role"].alias("from"), m["content"].alias("value")))
    as_data = lambda struct: F.parse_json(F.to_json(struct)).cast("map<string,variant>").alias("data")
    both = folded.select("conv_id", F.lit(0).alias("row_no"), as_data(F.struct("messages"))).unionByName(
        folded.select((-1 - F.col("conv_id")).alias("conv_id"), F.lit(0).alias("row_no"), as_data(F.struct(turns.alias("conversations"))))
    )
    return detect_sources(both, "conv_id").select("conv_id", "schema_name")


@query("SELECT doc_id, source AS prompt, sha256(text) AS completion_hash, 'prompt_completion' AS schema_name FROM documents")
def mapped_columns(spark, folder):
    """Typed columns renamed; the column that had the canonical name is replaced."""
    docs = table(spark, folder, "documents").withColumn("prompt", F.col("lang"))
    mapped = map_columns(docs, {"source": "prompt", "text": "completion"})
    return mapped.select(
        "doc_id", "prompt", F.sha2("completion", 256).alias("completion_hash"), F.lit(detect_columns(mapped)).alias("schema_name")
    )


@query(
    """SELECT doc_id, CASE WHEN lang = 'es' THEN source END AS prompt, CASE WHEN lang = 'es' THEN sha256(text) END AS completion_hash,
      CASE WHEN lang <> 'es' THEN 'missing_column' END AS reject_reason
    FROM documents"""
)
def mapped_rows(spark, folder):
    """Free-form keys renamed and normalized; rows without the keys are flagged."""
    mapped = map_row_keys(_free_rows(spark, folder), {"question": "prompt", "answer": "completion"})
    good = F.col("reject_reason").isNull()
    return normalize_prompt_completion(mapped, "doc_id").select(
        "doc_id",
        F.when(good, F.col("prompt")).alias("prompt"),
        F.when(good, F.sha2("completion", 256)).alias("completion_hash"),
        "reject_reason",
    )


@query(
    """SELECT doc_id, sha256(text) AS text_hash, (SELECT count(*) FROM documents) AS total
    FROM documents ORDER BY doc_id LIMIT 20"""
)
def normalization_preview(spark, folder):
    rows = _typed(spark, folder)
    total = rows.agg(F.count("*").alias("total"))
    shown = preview(rows, lambda first: normalize_rows(first, "text"))
    return shown.select(
        doc_of(F.col("ord")).alias("doc_id"), F.sha2("text", 256).alias("text_hash"), total.scalar().alias("total")
    )


# --- normalizers ----------------------------------------------------------------


def _typed(spark, folder):
    """Documents with the columns every structured row carries."""
    return table(spark, folder, "documents").select(
        *row_columns(position(F.col("doc_id")), F.col("source"), F.col("doc_id")), "doc_id", "text", "lang", "source"
    )


def _typed_labelled(spark, folder):
    return labelled(spark, folder).select(
        *row_columns(position(F.col("doc_id")), F.col("source"), F.col("doc_id")),
        "doc_id", "text", "lang", "source", F.coalesce("toxic", F.lit(0)).alias("toxic"),
    )


@query(
    f"""SELECT doc_id, '{CPT}' AS kind, sha256(text) AS text_hash, doc_id::VARCHAR AS row_id, source AS source_name,
      sha256(source) AS source_hash, 'structured' AS source_kind, NULL::VARCHAR AS reject_reason FROM documents"""
)
def normalized_text(spark, folder):
    return normalize_text(_typed(spark, folder), "doc_id").select(
        "doc_id", "kind", F.sha2("text", 256).alias("text_hash"),
        "metadata.row_id", "metadata.source_name", "metadata.source_hash", "metadata.source_kind", "reject_reason",
    )


@query(
    f"""SELECT doc_id, '{SFT_PAIR}' AS kind, 'About ' || source AS prompt,
      sha256(CASE WHEN toxic = 1 THEN chr(32) || chr(10) ELSE text END) AS completion_hash,
      CASE WHEN toxic = 1 THEN 'empty_completion' END AS reject_reason
    FROM documents LEFT JOIN labels USING (doc_id)"""
)
def normalized_prompt_completion(spark, folder):
    rows = _typed_labelled(spark, folder).select(
        "*",
        F.concat(F.lit("About "), "source").alias("prompt"),
        F.when(F.col("toxic") == 1, F.lit(" \n")).otherwise(F.col("text")).alias("completion"),
    )
    return normalize_prompt_completion(rows, "doc_id").select(
        "doc_id", "kind", "prompt", F.sha2("completion", 256).alias("completion_hash"), "reject_reason"
    )


@query(
    f"""SELECT doc_id, '{SFT_PAIR}' AS kind,
      sha256(CASE lang WHEN 'en' THEN 'Shorten: ' || chr(10) || chr(10) || text ELSE 'Shorten: ' END) AS prompt_hash,
      sha256(source) AS completion_hash, NULL::VARCHAR AS reject_reason FROM documents"""
)
def normalized_instruction(spark, folder):
    """The instruction keeps its trailing space when there is no input; with an
    input both are joined and stripped."""
    rows = _typed(spark, folder).select(
        "*",
        F.lit("Shorten: ").alias("instruction"),
        F.when(F.col("lang") == "en", F.concat("text", F.lit(" \n"))).when(F.col("lang") == "fr", F.lit("")).alias("input"),
        F.col("source").alias("output"),
    )
    return normalize_instruction(rows, "doc_id").select(
        "doc_id", "kind", F.sha2("prompt", 256).alias("prompt_hash"), F.sha2("completion", 256).alias("completion_hash"), "reject_reason"
    )


# Roles as they would be if short messages were system messages: some
# conversations stop alternating.
_ROLE_SQL = "CASE WHEN length(text) < 120 THEN 'system' ELSE role END"


def _shifted(spark, folder):
    turns = table(spark, folder, "conversations")
    return turns.withColumn("role", F.when(F.length("text") < 120, F.lit("system")).otherwise(F.col("role")))


def _conversation_rows(spark, folder, turns):
    from corpusmill.operators.structure import fold_turns

    name = F.lit("conversations")
    return fold_turns(turns, "conv_id", "turn").select(
        *row_columns(position(F.col("conv_id")), name, F.col("conv_id")), "conv_id", "messages"
    )


def _alternation_sql(role: str) -> str:
    return f"""
      marked AS (SELECT conv_id, turn, text, {role} AS role FROM conversations),
      steps AS (SELECT conv_id, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS previous
                FROM marked WHERE role <> 'system'),
      checked AS (SELECT conv_id, bool_and(CASE WHEN previous IS NULL THEN role = 'user' ELSE role <> previous END) AS ok
                  FROM steps GROUP BY conv_id),
      folded AS (SELECT conv_id, string_agg(role || ':' || text, chr(10) ORDER BY turn) AS body, count(*) AS n
                 FROM marked GROUP BY conv_id)"""


@query(
    f"""WITH {_alternation_sql(_ROLE_SQL)}
    SELECT conv_id, '{SFT_CONVERSATION}' AS kind, n AS n_messages, sha256(body) AS messages_hash,
      CASE WHEN NOT coalesce(ok, false) THEN 'roles_do_not_alternate' END AS reject_reason
    FROM folded LEFT JOIN checked USING (conv_id)"""
)
def normalized_messages(spark, folder):
    body = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")
    return normalize_messages(_conversation_rows(spark, folder, _shifted(spark, folder)), "conv_id").select(
        "conv_id", "kind", F.size("messages").cast("bigint").alias("n_messages"), F.sha2(body, 256).alias("messages_hash"), "reject_reason"
    )


@query(
    """SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles, sha256(string_agg(text, chr(10) ORDER BY turn)) AS contents_hash,
      CASE WHEN bool_or(length(text) > 1500) THEN 'bad_message' END AS reject_reason
    FROM (SELECT conv_id, turn, text, CASE WHEN length(text) > 1500 THEN '?' ELSE role END AS role FROM conversations)
    GROUP BY conv_id"""
)
def normalized_conversations(spark, folder):
    """Senders instead of roles; the sender of a very long turn is unknown."""
    senders = {role: sender for sender, role in ROLE_BY_SENDER.items()}
    names = F.create_map(*[F.lit(part) for pair in senders.items() for part in pair])
    turns = F.transform(
        "messages",
        lambda m: F.struct(
            F.when(F.length(m["content"]) > 1500, F.lit("bot")).otherwise(names[m["role"]]).alias("from"), m["content"].alias("value")
        ),
    )
    rows = _conversation_rows(spark, folder, table(spark, folder, "conversations")).withColumn("conversations", turns)
    out = normalize_conversations(rows.drop("messages"), "conv_id")
    return out.select(
        "conv_id",
        F.array_join(F.transform("messages", lambda m: F.coalesce(m["role"], F.lit("?"))), ",").alias("roles"),
        F.sha2(F.array_join(F.transform("messages", lambda m: m["content"]), "\n"), 256).alias("contents_hash"),
        "reject_reason",
    )


@query(
    f"""SELECT doc_id, '{DPO}' AS kind, source AS prompt, sha256(text) AS chosen_hash,
      CASE WHEN toxic = 1 THEN '' ELSE lang END AS rejected, 'user,assistant,assistant' AS roles,
      CASE WHEN toxic = 1 THEN 'empty_rejected' END AS reject_reason
    FROM documents LEFT JOIN labels USING (doc_id)"""
)
def normalized_preferences(spark, folder):
    rows = _typed_labelled(spark, folder).select(
        *[c for c in ("ord", "document_id", "source_name", "source_hash", "row_id", "doc_id")],
        F.col("source").alias("prompt"),
        F.col("text").alias("chosen"),
        F.when(F.col("toxic") == 1, F.lit("")).otherwise(F.col("lang")).alias("rejected"),
    )
    lists = ("dpo_prompt", "chosen", "rejected")
    return normalize_preference(rows, "doc_id").select(
        "doc_id", "kind",
        F.col("dpo_prompt")[0]["content"].alias("prompt"),
        F.sha2(F.col("chosen")[0]["content"], 256).alias("chosen_hash"),
        F.col("rejected")[0]["content"].alias("rejected"),
        F.concat_ws(",", *[F.col(name)[0]["role"] for name in lists]).alias("roles"),
        "reject_reason",
    )


@query(
    "SELECT doc_id, CASE WHEN lang <> 'en' THEN (CASE WHEN lang = 'fr' THEN NULL ELSE 'empty_text' END) END AS reject_reason FROM documents"
)
def normalized_free_rows(spark, folder):
    """Free-form rows read as 'text' rows: only some have that key."""
    return normalize_rows(_free_rows(spark, folder), "text", "doc_id").select("doc_id", "reject_reason")


# --- routing and URL rules --------------------------------------------------------


@query(
    f"""WITH s AS (SELECT source, arg_min(lang, doc_id) AS lang FROM documents GROUP BY source),
      c AS (SELECT source, {_SHAPE_SQL.format(lang='lang')} AS shape FROM s)
    SELECT source AS source_id, shape = 'prompt_completion' OR shape = 'instruction_input_output' AS kept,
      CASE WHEN shape = 'text' THEN 'schema text makes cpt records, not sft_prompt_completion' END AS reason
    FROM c WHERE shape IS NOT NULL"""
)
def routed_sources(spark, folder):
    """Confirmed sources that make pair records, and the others with the reason."""
    found = detect_sources(_free_rows(spark, folder), "source").select(
        F.col("source").alias("source_id"), F.col("schema_name").alias("confirmed_schema")
    )
    kept, skipped = route_sources(found, SFT_PAIR)
    return kept.select("source_id", F.lit(True).alias("kept"), F.lit(None).cast("string").alias("reason")).unionByName(
        skipped.select("source_id", F.lit(False).alias("kept"), "reason")
    )


_ALLOWED = (("example.org", "/en"), ("tionsh.example.net", "/"), ("example.com", "/fr/"))
_HOST_SQL = "regexp_extract(url, '^https://([^/?#:]*)', 1)"
_PATH_SQL = "regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)"
_ALLOWED_SQL = " OR ".join(
    f"(({_HOST_SQL} = '{host}' OR {_HOST_SQL} LIKE '%.{host}') AND "
    f"starts_with(CASE WHEN {_PATH_SQL} = '' THEN '/' ELSE {_PATH_SQL} END, '{prefix}'))"
    for host, prefix in _ALLOWED
)


@query(f"SELECT page_id, url FROM pages WHERE {_ALLOWED_SQL}")
def allowed_pages(spark, folder):
    return keep_allowed(table(spark, folder, "pages"), _ALLOWED).select("page_id", "url")


@query(
    f"SELECT starts_with(url, 'https:') AS is_https, coalesce({_ALLOWED_SQL}, false) AS allowed, count(*) AS n FROM pages GROUP BY ALL"
)
def allowed_counts(spark, folder):
    pages = table(spark, folder, "pages").select(
        F.col("url").startswith("https:").alias("is_https"), is_allowed(F.col("url"), _ALLOWED).alias("allowed")
    )
    return pages.groupBy("is_https", "allowed").agg(F.count("*").alias("n"))


@query("SELECT page_id, sha256(html) AS sha256, left(html, 500) AS excerpt FROM pages")
def citations(spark, folder):
    return table(spark, folder, "pages").select("page_id", citation(F.col("html")).alias("c")).select("page_id", "c.sha256", "c.excerpt")
