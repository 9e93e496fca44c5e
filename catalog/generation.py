"""Generation: requests, provider, candidates, pairs, goals.

Replies are derived from the tables: what a model would be asked about a
document is answered from the document itself and its labels.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import cpt_documents, doc_of, labelled, query, table
from corpusmill.functions.records import CPT, DPO, SFT_CONVERSATION, SFT_PAIR, position
from corpusmill.functions import prompts
from corpusmill.operators.generation import (
    complete,
    cpt_records,
    examples,
    first_valid,
    generate,
    goals,
    pair_record,
    qa_candidates,
    qa_requests,
    select_pairs,
)


def plain_chunks(documents, *more):
    """Every document as one chunk."""
    return documents.select(
        position(F.col("doc_id")).alias("ord"),
        F.col("doc_id").cast("string").alias("document_id"),
        F.concat(F.col("doc_id").cast("string"), F.lit("-0")).alias("chunk_id"),
        F.col("source").alias("source_name"),
        F.sha2("text", 256).alias("source_hash"),
        "text", "doc_id", "lang", *more,
    )


def chunks(spark, folder):
    """Every document as one chunk, with its labels."""
    return plain_chunks(labelled(spark, folder), F.coalesce("quality", F.lit(1)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


@query(
    f"""SELECT doc_id, '{CPT}' AS kind, sha256(text) AS text_hash, doc_id || '-0' AS chunk_id, source AS source_name, 'document' AS source_kind,
      0 AS n_extra FROM documents"""
)
def cpt_passthrough(spark, folder):
    return cpt_records(chunks(spark, folder), "doc_id").select(
        "doc_id", "kind", F.sha2("text", 256).alias("text_hash"), "metadata.chunk_id", "metadata.source_name", "metadata.source_kind",
        F.size("metadata.extra").alias("n_extra"),
    )


@query(
    f"""SELECT doc_id, example::INTEGER AS example, '{SFT_PAIR}' AS objective, row_number() OVER (ORDER BY doc_id, example) AS place
    FROM documents, range(1, 4) AS e(example)
    UNION ALL SELECT doc_id, 1, '{CPT}', row_number() OVER (ORDER BY doc_id) FROM documents"""
)
def wanted_examples(spark, folder):
    """Three examples per chunk, one for plain text; ``ord`` keeps their order."""
    parts = []
    for objective, count in ((SFT_PAIR, 3), (CPT, 1)):
        units = examples(chunks(spark, folder), objective, 3)
        # Documents are numbered without gaps, so the packed position gives the place.
        place = doc_of(F.col("ord")) * count + F.col("ord") % (1 << 28) + 1
        parts.append(units.select("doc_id", "example", F.lit(objective).alias("objective"), place.alias("place")))
    return parts[0].unionByName(parts[1])


@query(
    """SELECT doc_id, 'qa|' || doc_id || '-0|1|0|0' AS request_id, 'user' AS role, sha256(
      'Write one question that the passage answers, the answer, and a passage excerpt, copied character for character, that proves the answer.'
      || chr(10) || chr(10) || 'Passage:' || chr(10) || text || chr(10) || chr(10)
      || 'Reply with one JSON object with the string fields "question", "answer" and "supporting_quote".') AS request_hash FROM documents"""
)
def question_requests(spark, folder):
    asked = qa_requests(examples(chunks(spark, folder), SFT_PAIR), attempt=0)
    first = F.col("messages")[0]
    return asked.select("doc_id", "request_id", first["role"].alias("role"), F.sha2(first["content"], 256).alias("request_hash"))


def _client():
    """Answers from the length of what it is asked; fails for some lengths."""

    def ask(messages):
        n = len(messages[0]["content"].split())
        if n % 7 == 0:
            return 503, None
        if n % 7 == 1:
            return 200, None
        if n % 7 == 2:
            return 404, None
        if n % 7 == 3:
            raise TimeoutError
        return 200, f'{{"score": {n % 11}}}'

    return ask


_N_SQL = r"len(regexp_extract_all('Score from 0 to 10 how useful this example is for training a model. Example: ' || text || ' Reply with one JSON object with the numeric field \"score\".', '\S+'))".replace('\\"', '"')


@query(
    f"""SELECT doc_id, CASE n % 7 WHEN 0 THEN 'http_503' WHEN 1 THEN 'null_content' WHEN 2 THEN 'http_404' WHEN 3 THEN 'timeout' ELSE 'ok' END AS status,
      CASE WHEN n % 7 > 3 THEN '{{"score": ' || (n % 11) || '}}' END AS content
    FROM (SELECT doc_id, {_N_SQL} AS n FROM documents)"""
)
def provider_responses(spark, folder):
    """One request per document through a client that fails in several ways."""
    requests = cpt_documents(spark, folder).select(F.col("ord").cast("string").alias("request_id"), prompts.quality().alias("messages"))
    return complete(requests, _client).select(doc_of(F.col("request_id").cast("bigint")).alias("doc_id"), "status", "content")


# --- candidates --------------------------------------------------------------------

QUOTE_SQL = r"regexp_extract(text, '[^.\n]*\.')"


def quote_of(text):
    """The first sentence that ends on its line."""
    return F.regexp_extract(text, r"(?m)^[^.\n]*\.", 0)


def attempts(spark, folder):
    """Three replies per document.  The first quotes in capitals, the second is
    not bare JSON where the quality label is 0, the third has a blank answer
    where the text is labelled toxic."""
    reply = lambda quote, answer: F.to_json(
        F.struct(
            F.concat(F.lit("What does "), "source_name", F.lit(" say?")).alias("question"),
            answer.alias("answer"),
            quote.alias("supporting_quote"),
        )
    )
    quote = quote_of(F.col("text"))
    contents = F.array(
        reply(F.upper(quote), F.col("lang")),
        F.when(F.col("quality") == 0, F.concat(F.lit("Sure: "), reply(quote, F.col("lang")))).otherwise(reply(quote, F.col("lang"))),
        reply(quote, F.when(F.col("toxic") == 1, F.lit("  ")).otherwise(F.col("lang"))),
    )
    return (
        chunks(spark, folder)
        .select("*", F.lit(1).alias("example"), F.posexplode(contents).alias("attempt", "content"))
        .withColumn("request_id", F.concat_ws("|", "chunk_id", "attempt"))
    )


def _candidates(spark, folder):
    replies = attempts(spark, folder)
    return qa_candidates(replies.drop("content"), replies.select("request_id", "content"))


_VALID_SQL = f"""({QUOTE_SQL} <> '' AND regexp_matches({QUOTE_SQL}, '\\S') AND CASE attempt
  WHEN 0 THEN contains(text, upper({QUOTE_SQL})) WHEN 1 THEN coalesce(quality, 1) <> 0 ELSE coalesce(toxic, 0) <> 1 END)"""
_ATTEMPTS_SQL = f"""attempts AS (SELECT d.*, quality, toxic, attempt, {_VALID_SQL} AS valid
    FROM documents d LEFT JOIN labels USING (doc_id), range(0, 3) AS a(attempt))"""


@query(
    f"""WITH {_ATTEMPTS_SQL} SELECT doc_id, attempt::INTEGER AS attempt, CASE WHEN valid THEN 'What does ' || source || ' say?' END AS question,
      CASE WHEN valid THEN lang END AS answer FROM attempts"""
)
def parsed_candidates(spark, folder):
    """Strictly parsed and grounded candidates, null where a reply is neither."""
    return _candidates(spark, folder).select("doc_id", "attempt", "candidate.question", "candidate.answer")


@query(
    f"""WITH {_ATTEMPTS_SQL} SELECT doc_id, (min(attempt) FILTER (valid))::INTEGER AS attempt FROM attempts GROUP BY doc_id"""
)
def first_valid_attempts(spark, folder):
    """The first valid attempt of each document; null where none is."""
    tried = _candidates(spark, folder)
    kept, rejected = first_valid(tried, F.col("candidate").isNotNull(), "doc_id", "example")
    return kept.select("doc_id", "attempt").unionByName(rejected.select("doc_id"), allowMissingColumns=True)


@query(
    f"""WITH {_ATTEMPTS_SQL} SELECT doc_id, '{SFT_PAIR}' AS kind, 'What does ' || source || ' say?' AS prompt, lang AS completion,
      {QUOTE_SQL} AS supporting_quote FROM attempts WHERE valid AND attempt = 2"""
)
def pair_records(spark, folder):
    """Pairs from the third attempts, with the quote as provenance."""
    valid = _candidates(spark, folder).where("candidate IS NOT NULL AND attempt = 2")
    return pair_record(valid, "doc_id").select(
        "doc_id", "kind", "prompt", "completion", F.col("metadata.extra")["supporting_quote"].alias("supporting_quote")
    )


# --- whole generation, answered from the request ------------------------------------------

_passage = r"(?s)Passage:\n(.*)\n\nReply with"


def _answers(requests):
    """A model that quotes the passage.  Its first attempt on an odd number of
    characters is prose; from draw to draw its answers get longer."""
    passage = F.regexp_extract(F.col("messages")[0]["content"], _passage, 1)
    parts = F.split("request_id", r"\|")
    attempt, draw = F.get(parts, F.lit(3)), F.get(parts, F.lit(4)).cast("int")
    quote = quote_of(passage)
    answer = F.concat(F.lit("Answer"), F.repeat(F.lit("!"), draw))
    reply = F.to_json(F.struct(F.lit("What is said?").alias("question"), answer.alias("answer"), quote.alias("supporting_quote")))
    prose = (attempt == "0") & (F.length(passage) % 2 == 1)
    return requests.select("request_id", F.when(prose, F.lit("I cannot")).otherwise(reply).alias("content"))


def _marks(requests):
    """A judge that counts: the answer's exclamation marks, times the number of
    full stops of the passage modulo 3."""
    content = F.col("messages")[0]["content"]
    stops = F.regexp_count(F.regexp_extract(content, r"(?s)Passage:\n(.*)\n\nQuestion: ", 1), F.lit(r"\.")) % 3
    marks = F.length(F.regexp_extract(content, r"\n\nAnswer: Answer(!*)", 1))
    return requests.select("request_id", F.format_string('Well: {"score": %d}', marks * stops).alias("content"))


_QUOTED_SQL = f"({QUOTE_SQL} <> '' AND regexp_matches({QUOTE_SQL}, '\\S'))"


@query(
    f"""SELECT doc_id, example::INTEGER AS example, 'What is said?' AS prompt, 'Answer' AS completion, {QUOTE_SQL} AS supporting_quote
    FROM documents, range(1, 3) AS e(example) WHERE {_QUOTED_SQL}"""
)
def generated_pairs(spark, folder):
    """Two examples per document, failed attempts asked again."""
    records, _ = generate(plain_chunks(table(spark, folder, "documents")), SFT_PAIR, _answers, per_chunk=2)
    return records.select(
        doc_of(F.col("ord")).alias("doc_id"), "example", "prompt", "completion", F.col("metadata.extra")["supporting_quote"].alias("supporting_quote")
    )


@query(
    f"""SELECT doc_id, CASE WHEN {_QUOTED_SQL} AND length(text) % 2 = 0 THEN 'user:What is said?,assistant:Answer' END AS messages FROM documents"""
)
def generated_conversations(spark, folder):
    """No second attempt: what failed comes out as rejected."""
    records, rejected = generate(plain_chunks(table(spark, folder, "documents")), SFT_CONVERSATION, _answers, retries=0)
    lines = F.array_join(F.transform("messages", lambda m: F.concat_ws(":", m["role"], m["content"])), ",")
    kept = records.select(doc_of(F.col("ord")).alias("doc_id"), lines.alias("messages"))
    lost = rejected.select(F.split("chunk_id", "-")[0].cast("bigint").alias("doc_id"))
    return kept.unionByName(lost, allowMissingColumns=True)


@query(
    f"""SELECT doc_id, 'What is said?' AS prompt, 'Answer!!!!' AS chosen, 'Answer!' AS rejected FROM documents
    WHERE {_QUOTED_SQL} AND len(regexp_extract_all(text, '\\.')) % 3 > 0"""
)
def generated_preferences(spark, folder):
    """Four candidates per document, scored by a judge; equal scores give nothing."""
    records, _ = generate(plain_chunks(table(spark, folder, "documents")), DPO, _answers, _marks)
    content = lambda name: F.col(name)[0]["content"]
    return records.select(
        doc_of(F.col("ord")).alias("doc_id"), content("dpo_prompt").alias("prompt"), content("chosen").alias("chosen"), content("rejected").alias("rejected")
    )


_SCORE_SQL = "CASE WHEN toxic = 1 AND draw = 3 THEN NULL ELSE (length(text) * draw * draw) % 10 END"


@query(
    f"""WITH scored AS (SELECT doc_id, draw, 'answer ' || draw AS answer, {_SCORE_SQL} AS score
      FROM (SELECT * FROM documents LEFT JOIN labels USING (doc_id)), range(1, 5) AS r(draw))
    SELECT doc_id, arg_max(answer, score * 10 + draw) AS best_answer, arg_min(answer, score * 10 + draw) AS worst_answer,
      max(score)::DOUBLE AS best_score, min(score)::DOUBLE AS worst_score
    FROM scored GROUP BY doc_id HAVING count(score) = 4 AND max(score) - min(score) >= 2"""
)
def selected_pairs(spark, folder):
    """Best and worst of four scored answers; ties go by draw."""
    n = F.length("text") * F.col("draw") * F.col("draw") % 10
    drawn = chunks(spark, folder).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(4))))
    scored = drawn.select(
        "doc_id", "draw", F.concat(F.lit("answer "), F.col("draw").cast("string")).alias("answer"),
        F.when(~((F.col("toxic") == 1) & (F.col("draw") == 3)), n.cast("double")).alias("score"),
    )
    return select_pairs(scored, "doc_id", n=4)


@query(
    """SELECT doc_id::VARCHAR AS request_id, CASE lang WHEN 'en' THEN 'domain_adaptation' WHEN 'fr' THEN 'preference_alignment' END AS goal,
      CASE lang WHEN 'en' THEN 'cpt' WHEN 'fr' THEN 'dpo' END AS objective,
      CASE WHEN lang IN ('en', 'fr') THEN source END AS rationale,
      CASE WHEN lang IN ('en', 'fr') THEN n_chars::VARCHAR END AS desired_behavior,
      CASE WHEN lang NOT IN ('en', 'fr') THEN 'bad_goal_reply' END AS reject_reason FROM documents"""
)
def goal_replies(spark, folder):
    """Goal replies: two known goals, an unknown one, and one without a field."""
    names = F.create_map(*map(F.lit, ("en", "domain_adaptation", "fr", "preference_alignment", "de", "anything", "es", "domain_adaptation")))
    lang = F.col("lang")
    reply = F.to_json(
        F.struct(names[lang].alias("goal"), F.col("source").alias("rationale"), F.when(lang != "es", F.col("n_chars")).alias("desired_behavior"))
    )
    docs = table(spark, folder, "documents")
    return goals(docs.select(F.col("doc_id").cast("string").alias("request_id"), reply.alias("content")))
