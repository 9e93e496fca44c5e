import re

import pytest

from __spark_entry__ import entry, oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"
TABLES = "documents pages labels conversations".split()


def test_every_query_of_the_catalog_has_its_sql():
    own = {name for name in queries() if not re.match(r"op\d+_|pipeline$", name)}
    assert own and own <= set(oracle_sql())


def test_flagship_runs(spark):
    df = entry(spark)
    assert df.columns == ["doc_id", "text_hash"] and df.count() > 0


@pytest.mark.parametrize("name", ["near_dedup", "validated_documents", "document_chunks", "page_chunks", "generated_pairs", "normalized_messages", "merged_run", "jsonl_rows"])
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    df = queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    result = db.execute(oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in result.fetchall())
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == want
