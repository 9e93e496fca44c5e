"""Exact and near duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import cpt_documents, doc_of, query
from corpusmill.functions.minhash import MAX_HASH, NUM_PERM, PRIME, band_shape, permutations, signatures_of
from corpusmill.functions.text import normalized_hash
from corpusmill.operators.dedup import drop_exact_duplicates, drop_near_duplicates, exact_first, near_duplicates
from corpusmill.operators.similarity import similar_to_kept
from corpusmill.session import materialize, spread

# The checked tables hold ASCII whitespace only, so \s is enough in SQL.
HASH_SQL = r"sha256(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))))"


def first_copies_sql(base: str, scope: str = "") -> str:
    """Rows of ``base`` that come first among equal normalized texts."""
    keys = f"{scope}, {HASH_SQL}" if scope else HASH_SQL
    return f"SELECT * FROM {base} QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY doc_id) = 1"


def near_sql(base: str, scope: str = "''") -> str:
    """CTEs ending in near(doc_id): near duplicates among the rows of ``base``."""
    bands, rows = band_shape()
    draws = ", ".join(f"({i}, {int(a)}, {int(b)})" for i, (a, b) in enumerate(zip(*permutations(NUM_PERM))))
    hex_value = lambda at: f"(instr('0123456789abcdef', substr(h, {at}, 1)) - 1)"
    value = " + ".join(
        f"({hex_value(2 * byte + 1)} * 16 + {hex_value(2 * byte + 2)})::UBIGINT * {256**byte}" for byte in range(4)
    )
    return f"""
    draws(i, a, b) AS (VALUES {draws}),
    tokens AS MATERIALIZED (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '\\S+'))) AS w FROM {base}),
    vocabulary AS MATERIALIZED (SELECT w, {value} AS v FROM (SELECT DISTINCT w, sha1(w) AS h FROM tokens)),
    products AS (
      SELECT w, i, (v::HUGEINT * a::HUGEINT + b::HUGEINT) & {2**64 - 1}::HUGEINT AS x FROM vocabulary CROSS JOIN draws),
    folded AS (SELECT w, i, (x & {PRIME}::HUGEINT) + (x >> 61::HUGEINT) AS y FROM products),
    permuted AS MATERIALIZED (
      SELECT w, i, ((CASE WHEN y >= {PRIME}::HUGEINT THEN y - {PRIME}::HUGEINT ELSE y END) & {MAX_HASH}::HUGEINT)::UBIGINT AS p FROM folded),
    signature AS MATERIALIZED (SELECT doc_id, i, min(p) AS m FROM tokens JOIN permuted USING (w) GROUP BY doc_id, i),
    bands AS MATERIALIZED (
      SELECT doc_id, i // {rows} AS band, string_agg(m::VARCHAR, ',' ORDER BY i) AS k
      FROM signature WHERE i < {bands * rows} GROUP BY doc_id, i // {rows}),
    scoped AS MATERIALIZED (SELECT doc_id, md5(concat_ws('|', {scope}, band, k)) AS bucket FROM bands JOIN {base} USING (doc_id)),
    edges AS MATERIALIZED (
      SELECT DISTINCT x.doc_id AS lo, y.doc_id AS hi FROM scoped x JOIN scoped y USING (bucket) WHERE x.doc_id < y.doc_id),
    rounds(round, doc_id, status) AS (
      SELECT 0, doc_id, 'u' FROM (SELECT lo AS doc_id FROM edges UNION SELECT hi FROM edges)
      UNION ALL
      SELECT any_value(s.round) + 1, s.doc_id,
        CASE WHEN any_value(s.status) <> 'u' THEN any_value(s.status)
             WHEN bool_or(l.status = 'k') THEN 'd'
             WHEN coalesce(bool_and(l.status = 'd'), true) THEN 'k' ELSE 'u' END
      FROM rounds s LEFT JOIN edges e ON e.hi = s.doc_id LEFT JOIN rounds l ON l.doc_id = e.lo
      WHERE EXISTS (SELECT 1 FROM rounds u WHERE u.status = 'u')
      GROUP BY s.doc_id),
    near AS (SELECT DISTINCT doc_id FROM rounds WHERE status = 'd')"""


@query(f"SELECT doc_id, {HASH_SQL} AS text_hash FROM ({first_copies_sql('documents')})")
def exact_dedup(spark, folder):
    kept = drop_exact_duplicates(cpt_documents(spark, folder))
    return kept.select(doc_of(F.col("ord")).alias("doc_id"), normalized_hash(F.col("text")).alias("text_hash"))


@query(f"SELECT doc_id, source FROM ({first_copies_sql('documents', 'source')})")
def exact_dedup_by_source(spark, folder):
    kept = drop_exact_duplicates(cpt_documents(spark, folder, "source"), scope=("source",))
    return kept.select(doc_of(F.col("ord")).alias("doc_id"), "source")


@query(
    f"SELECT min(doc_id) AS first_doc_id, count(*) AS copies, {HASH_SQL} AS text_hash FROM documents GROUP BY {HASH_SQL}"
)
def copies_per_text(spark, folder):
    firsts = exact_first(cpt_documents(spark, folder))
    return firsts.select(doc_of(F.col("ord")).alias("first_doc_id"), "copies", "text_hash")


@query(
    f"WITH RECURSIVE base AS (SELECT * FROM documents), {near_sql('base')} "
    "SELECT doc_id FROM near"
)
def near_duplicates_of_all(spark, folder):
    losers = near_duplicates(spread(cpt_documents(spark, folder), "ord"))
    return losers.select(doc_of(F.col("ord")).alias("doc_id"))


@query(
    f"WITH RECURSIVE base AS ({first_copies_sql('documents')}), {near_sql('base')} "
    "SELECT doc_id FROM base WHERE doc_id NOT IN (SELECT doc_id FROM near)"
)
def near_dedup(spark, folder):
    once = materialize(drop_exact_duplicates(spread(cpt_documents(spark, folder), "ord")), "once")
    return drop_near_duplicates(once).select(doc_of(F.col("ord")).alias("doc_id"))


@query(
    f"WITH RECURSIVE base AS ({first_copies_sql('documents', 'source')}), {near_sql('base', 'source')} "
    "SELECT doc_id, source FROM base WHERE doc_id NOT IN (SELECT doc_id FROM near)"
)
def near_dedup_by_source(spark, folder):
    once = materialize(drop_exact_duplicates(spread(cpt_documents(spark, folder, "source"), "ord"), scope=("source",)), "once")
    return drop_near_duplicates(once, scope=("source",)).select(doc_of(F.col("ord")).alias("doc_id"), "source")


@query(
    f"WITH RECURSIVE base AS (SELECT * FROM documents), {near_sql('base')} "
    "SELECT doc_id, band::INTEGER AS band, md5(k) AS band_key FROM bands"
)
def minhash_bands(spark, folder):
    bands, rows = band_shape()
    signed = spread(cpt_documents(spark, folder), "ord").select("ord", signatures_of(F.col("text")).alias("signature"))
    return signed.select(
        doc_of(F.col("ord")).alias("doc_id"), F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band"), "signature"
    ).select(
        "doc_id",
        "band",
        F.md5(F.array_join(F.slice("signature", F.col("band") * rows + 1, F.lit(rows)), ",")).alias("band_key"),
    )


def similar_sql(scope: str = "''") -> str:
    """Greedy first-wins over all pairs of documents with a Jaccard similarity of 0.85 or more."""
    return f"""
    WITH RECURSIVE sets AS MATERIALIZED (
      SELECT doc_id, {scope} AS scope, list_distinct(regexp_extract_all(text, '\\S+')) AS w FROM documents),
    tokens AS MATERIALIZED (SELECT doc_id, scope, len(w) AS n, unnest(w) AS w FROM sets),
    edges AS MATERIALIZED (
      SELECT x.doc_id AS lo, y.doc_id AS hi FROM tokens x JOIN tokens y ON x.w = y.w AND x.scope = y.scope AND x.doc_id < y.doc_id
      WHERE 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n)
      GROUP BY ALL HAVING 100 * count(*) >= 85 * (any_value(x.n) + any_value(y.n) - count(*))
      UNION SELECT x.doc_id, y.doc_id FROM sets x JOIN sets y ON x.scope = y.scope AND x.doc_id < y.doc_id WHERE len(x.w) = 0 AND len(y.w) = 0),
    rounds(round, doc_id, status) AS (
      SELECT 0, doc_id, 'u' FROM (SELECT lo AS doc_id FROM edges UNION SELECT hi FROM edges)
      UNION ALL
      SELECT any_value(s.round) + 1, s.doc_id,
        CASE WHEN any_value(s.status) <> 'u' THEN any_value(s.status)
             WHEN bool_or(l.status = 'k') THEN 'd'
             WHEN coalesce(bool_and(l.status = 'd'), true) THEN 'k' ELSE 'u' END
      FROM rounds s LEFT JOIN edges e ON e.hi = s.doc_id LEFT JOIN rounds l ON l.doc_id = e.lo
      WHERE EXISTS (SELECT 1 FROM rounds u WHERE u.status = 'u')
      GROUP BY s.doc_id),
    fate AS (SELECT doc_id, status FROM rounds QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round DESC) = 1)
    SELECT hi AS doc_id, min(lo) AS kept_doc_id FROM edges JOIN fate h ON h.doc_id = hi AND h.status = 'd' JOIN fate l ON l.doc_id = lo AND l.status = 'k'
    GROUP BY hi"""


def _similar_documents(spark, folder, *scope):
    told = similar_to_kept(cpt_documents(spark, folder, *scope), scope=scope)
    return told.select(doc_of(F.col("ord")).alias("doc_id"), doc_of(F.col("kept_ord")).alias("kept_doc_id"))


@query(similar_sql())
def similar_documents(spark, folder):
    return _similar_documents(spark, folder)


@query(similar_sql("source"))
def similar_documents_by_source(spark, folder):
    return _similar_documents(spark, folder, "source")
