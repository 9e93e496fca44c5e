"""Structure, length, judging, and the whole validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.dedup import HASH_SQL, near_sql
from catalog.registry import conversations, cpt_documents, doc_of, document_metadata, labelled, query, table
from catalog.rows import _ROLE_SQL, _alternation_sql, _shifted
from corpusmill.functions.records import CPT, DPO, SFT_CONVERSATION, SFT_PAIR, as_records, message, metadata, position, rendered
from corpusmill.functions.replies import score
from corpusmill.operators.judging import judge_requests, verdicts
from corpusmill.operators.structure import alternation_by_turn, flag_structure, fold_turns
from corpusmill.plans.validation import flag_duplicates, validate
from corpusmill.session import spread

MAX_TOKENS = 2048


def _mixed(spark, folder):
    """Records of all four kinds, some malformed: blank completions and rejected
    answers where a label says toxic, shifted roles in conversations."""
    docs = labelled(spark, folder).withColumn("toxic", F.coalesce("toxic", F.lit(0)))
    toxic = F.col("toxic") == 1
    at, meta = position(F.col("doc_id")), document_metadata()
    one = lambda role, content: F.array(message(role, content))
    text = as_records(docs, CPT, "doc_id", ord=at, text=F.when(toxic, F.lit("\t\n")).otherwise(F.col("text")), metadata=meta)
    pair = as_records(
        docs, SFT_PAIR, "doc_id", ord=at, prompt=F.col("source"), completion=F.when(toxic, F.lit(" ")).otherwise(F.col("text")), metadata=meta
    )
    preference = as_records(
        docs, DPO, "doc_id", ord=at, dpo_prompt=one("user", F.col("source")), chosen=one("assistant", F.col("text")),
        rejected=F.when(toxic, F.array().cast("array<struct<role:string,content:string>>")).otherwise(one("assistant", F.col("lang"))),
        metadata=meta,
    )
    folded = fold_turns(_shifted(spark, folder), "conv_id", "turn")
    where = metadata(F.col("conv_id"), F.lit("conversations"), F.lit("h"))
    chat = as_records(folded, SFT_CONVERSATION, F.col("conv_id").alias("doc_id"), ord=position(F.col("conv_id")), messages=F.col("messages"), metadata=where)
    return text.unionByName(pair).unionByName(preference).unionByName(chat)


_LABELLED_SQL = "(SELECT d.*, coalesce(toxic, 0) AS toxic FROM documents d LEFT JOIN labels USING (doc_id))"


@query(
    f"""WITH {_alternation_sql(_ROLE_SQL)}
    SELECT doc_id, kind, CASE WHEN toxic = 1 THEN 'structural' END AS reject_reason
    FROM {_LABELLED_SQL}, (VALUES ('{CPT}'), ('{SFT_PAIR}'), ('{DPO}')) AS k(kind)
    UNION ALL
    SELECT conv_id, '{SFT_CONVERSATION}', CASE WHEN NOT coalesce(ok, false) THEN 'structural' END
    FROM folded LEFT JOIN checked USING (conv_id)"""
)
def structure_checked(spark, folder):
    return flag_structure(_mixed(spark, folder)).select("doc_id", "kind", "reject_reason")


@query(
    f"""WITH {_alternation_sql(_ROLE_SQL)}
    SELECT conv_id, coalesce(ok, false) AS alternates FROM folded LEFT JOIN checked USING (conv_id)"""
)
def alternating_roles(spark, folder):
    return alternation_by_turn(_shifted(spark, folder), "conv_id", "turn")


@query("SELECT conv_id, count(*) AS n_messages, sha256(string_agg(text, chr(10) ORDER BY turn)) AS text_hash FROM conversations GROUP BY conv_id")
def folded_conversations(spark, folder):
    contents = F.array_join(F.transform("messages", lambda m: m["content"]), "\n")
    return conversations(spark, folder).select(
        "conv_id", F.size("messages").cast("bigint").alias("n_messages"), F.sha2(contents, 256).alias("text_hash")
    )


@query(
    f"""SELECT doc_id, '{CPT}' AS kind, sha256(CASE WHEN toxic = 1 THEN chr(9) || chr(10) ELSE text END) AS text_hash FROM {_LABELLED_SQL}
    UNION ALL SELECT doc_id, '{SFT_PAIR}', sha256(source || chr(10) || CASE WHEN toxic = 1 THEN ' ' ELSE text END) FROM {_LABELLED_SQL}
    UNION ALL SELECT doc_id, '{DPO}', sha256(source || chr(10) || text || CASE WHEN toxic = 1 THEN '' ELSE chr(10) || lang END) FROM {_LABELLED_SQL}
    UNION ALL SELECT conv_id, '{SFT_CONVERSATION}', sha256(string_agg(text, chr(10) ORDER BY turn)) FROM conversations GROUP BY conv_id"""
)
def rendered_text(spark, folder):
    return _mixed(spark, folder).select("doc_id", "kind", F.sha2(rendered(), 256).alias("text_hash"))


@query(
    rf"SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '\S+')) > {MAX_TOKENS} THEN 'structural' END AS reject_reason FROM documents"
)
def length_checked(spark, folder):
    flagged = flag_structure(cpt_documents(spark, folder), MAX_TOKENS)
    return flagged.select(doc_of(F.col("ord")).alias("doc_id"), "reject_reason")


# --- judging ----------------------------------------------------------------------


def _replies(spark, folder):
    """(request_id, content): free-form judge replies, scored by the labels.  A
    document without labels gets a reply with no JSON in it."""
    content = F.when(
        F.col("quality").isNotNull(),
        F.concat(
            F.lit('<think>maybe {"score": 1}\n</think>I would say {"score": "'), (F.col("quality") * 10 - F.col("toxic")).cast("string"), F.lit('"}.')
        ),
    ).otherwise(F.lit("no opinion"))
    return labelled(spark, folder).select(position(F.col("doc_id")).cast("string").alias("request_id"), content.alias("content"))


@query("SELECT doc_id, (quality * 10 - toxic)::DOUBLE AS score FROM documents LEFT JOIN labels USING (doc_id)")
def judge_scores(spark, folder):
    """Scores read out of free-form replies."""
    return _replies(spark, folder).select(
        doc_of(F.col("request_id").cast("bigint")).alias("doc_id"), score(F.col("content")).alias("score")
    )


_QUALITY_SQL = """CASE WHEN quality IS NULL THEN 'judging_error'
  WHEN quality * 10 - toxic < 6 THEN 'quality_judged_insufficient' END"""


@query(f"SELECT doc_id, {_QUALITY_SQL} AS judge_reason FROM documents LEFT JOIN labels USING (doc_id)")
def quality_judged(spark, folder):
    judged = verdicts(cpt_documents(spark, folder), _replies(spark, folder))
    return judged.select(doc_of(F.col("ord")).alias("doc_id"), "judge_reason")


def _preferences(spark, folder):
    docs = labelled(spark, folder)
    one = lambda role, content: F.array(message(role, content))
    return as_records(
        docs, DPO, ord=position(F.col("doc_id")), dpo_prompt=one("user", F.col("source")),
        chosen=one("assistant", F.col("text")), rejected=one("assistant", F.col("lang")), metadata=document_metadata(),
    )


def _preference_replies(spark, folder):
    content = F.format_string(
        'Scores: {"score_a": %d, "score_b": "%d"}', F.coalesce("quality", F.lit(0)) * 3, F.coalesce("toxic", F.lit(1)) * 3 + 2
    )
    content = F.when(F.col("lang") == "es", F.lit('{"score_a": 9}')).otherwise(content)
    return labelled(spark, folder).select(position(F.col("doc_id")).cast("string").alias("request_id"), content.alias("content"))


_PREFERENCE_SQL = """CASE WHEN lang = 'es' THEN 'judging_error'
  WHEN coalesce(quality, 0) * 3 - (coalesce(toxic, 1) * 3 + 2) < 1 THEN 'dpo_preference_not_confirmed' END"""


@query(f"SELECT doc_id, {_PREFERENCE_SQL} AS judge_reason FROM documents LEFT JOIN labels USING (doc_id)")
def preference_judged(spark, folder):
    judged = verdicts(_preferences(spark, folder), _preference_replies(spark, folder))
    return judged.select(doc_of(F.col("ord")).alias("doc_id"), "judge_reason")


@query(
    """SELECT doc_id, sha256('Score both answers from 0 to 10, each on its own.' || chr(10) || chr(10) || 'Prompt:' || chr(10) || source
      || chr(10) || chr(10) || 'First answer:' || chr(10) || text || chr(10) || chr(10) || 'Second answer:' || chr(10) || lang
      || chr(10) || chr(10) || 'Reply with one JSON object with the numeric fields "score_a" and "score_b".') AS request_hash,
      'preference' AS kind FROM documents
    UNION ALL
    SELECT doc_id, sha256('Score from 0 to 10 how useful this example is for training a model.' || chr(10) || chr(10) || 'Example:' || chr(10)
      || text || chr(10) || chr(10) || 'Reply with one JSON object with the numeric field "score".'), 'quality' FROM documents"""
)
def judge_request_texts(spark, folder):
    requests = judge_requests(_preferences(spark, folder).unionByName(cpt_documents(spark, folder)))
    return requests.select(
        doc_of(F.col("request_id").cast("bigint")).alias("doc_id"), F.sha2(F.col("messages")[0]["content"], 256).alias("request_hash"), "kind"
    )


# --- the whole validation -----------------------------------------------------------


def decided_sql(base: str = "documents", scope: str = "", max_tokens: int = MAX_TOKENS) -> str:
    """CTEs ending in decided(doc_id, reject_reason) for the rows of ``base``."""
    keys = f"{scope}, {HASH_SQL}" if scope else HASH_SQL
    return rf"""
    fitting AS MATERIALIZED (SELECT * FROM {base} WHERE len(regexp_extract_all(text, '\S+')) <= {max_tokens} AND regexp_matches(text, '\S')),
    firsts AS MATERIALIZED (SELECT * FROM fitting QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY doc_id) = 1),
    {near_sql('firsts', scope or "''")},
    decided AS MATERIALIZED (
      SELECT {base}.doc_id, CASE WHEN fitting.doc_id IS NULL THEN 'structural' WHEN firsts.doc_id IS NULL THEN 'exact_duplicate'
        WHEN near.doc_id IS NOT NULL THEN 'near_duplicate' END AS reject_reason
      FROM {base} LEFT JOIN fitting USING (doc_id) LEFT JOIN firsts USING (doc_id) LEFT JOIN near USING (doc_id))"""


@query(f"WITH RECURSIVE {decided_sql()} SELECT doc_id, sha256(text) AS text_hash FROM documents JOIN decided USING (doc_id) WHERE reject_reason IS NULL")
def validated_documents(spark, folder):
    """Documents to accepted text records: structure, length, both dedup passes."""
    accepted = validate(spread(cpt_documents(spark, folder), "ord"), max_tokens=MAX_TOKENS).accepted
    return accepted.select(doc_of(F.col("ord")).alias("doc_id"), F.sha2("text", 256).alias("text_hash"))


@query(
    f"""WITH RECURSIVE {decided_sql()},
    judged AS (SELECT doc_id, coalesce(reject_reason, {_QUALITY_SQL}) AS reject_reason FROM decided LEFT JOIN labels USING (doc_id))
    SELECT reject_reason, count(*) AS n, 'standard_assurance' AS assurance_level FROM judged WHERE reject_reason IS NOT NULL GROUP BY reject_reason"""
)
def rejection_counts(spark, folder):
    """Count per reason of the whole validation, with the optional judging."""
    records = spread(cpt_documents(spark, folder), "ord")
    result = validate(records, max_tokens=MAX_TOKENS, judge=lambda requests: _replies(spark, folder).join(requests, "request_id", "left_semi"), judge_all=True)
    return result.report.withColumn("assurance_level", F.lit(result.assurance_level))


@query(f"WITH RECURSIVE {decided_sql(scope='source')} SELECT doc_id, reject_reason FROM decided")
def decided_by_source(spark, folder):
    """Duplicates are only looked for within a source."""
    flagged = flag_structure(spread(cpt_documents(spark, folder, "source"), "ord"), MAX_TOKENS)
    return flag_duplicates(flagged, scope=("source",)).select(doc_of(F.col("ord")).alias("doc_id"), "reject_reason")


@query(
    f"""WITH RECURSIVE prefs AS (SELECT doc_id, source || chr(10) || text || chr(10) || lang AS text FROM documents),
    {decided_sql('prefs')}
    SELECT doc_id, coalesce(reject_reason, {_PREFERENCE_SQL}) AS reject_reason
    FROM decided JOIN documents USING (doc_id) LEFT JOIN labels USING (doc_id)"""
)
def validated_preferences(spark, folder):
    """Preference pairs, whose judging is mandatory."""
    result = validate(
        spread(_preferences(spark, folder), "ord"),
        max_tokens=MAX_TOKENS,
        judge=lambda requests: _preference_replies(spark, folder).join(requests, "request_id", "left_semi"),
    )
    return result.decided.select(doc_of(F.col("ord")).alias("doc_id"), "reject_reason")
