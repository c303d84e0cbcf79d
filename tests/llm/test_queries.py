"""The registered queries on the smallest tables: against SQL, or row by row where SQL can't follow."""

from pathlib import Path

import duckdb
import pytest

from check import TABLES, rows_of
from __spark_entry__ import oracle_sql, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the given tables are not here")
NAMES = sorted(n for n in queries() if n == "pipeline" or n.startswith("op") and n[2].isdigit())


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    return connection


def test_all_are_registered():
    assert {n.split("_")[0] for n in NAMES} == {*(f"op{i}" for i in range(1, 14)), "pipeline"}


@pytest.mark.parametrize("name", [n for n in NAMES if n in oracle_sql()])
def test_against_sql(spark, duck, name):
    df = queries()[name](spark, SF)
    result = duck.execute(oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, result.fetchall())


def test_suffix_dedup_of_the_table(spark, brute):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in queries()["op1_suffix_dedup"](spark, SF).collect())
    assert got == sorted(brute.repeated_bytes(docs, 400, "none"))


def test_near_duplicates_of_the_table(spark, brute):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: r["class_id"] for r in queries()["op5_order_minhash"](spark, SF).collect()}
    assert got == brute.near_classes(docs)


def test_pipeline_keeps_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = queries()["pipeline"](spark, SF)
    assert set(docs.columns) <= set(rows.columns)
    kept = {r["doc_id"] for r in rows.select("doc_id").collect()}
    assert len(kept) == rows.count() and 0.5 < len(kept) / docs.count() <= 1


def test_pages_of_the_table(spark):
    rows = queries()["op6_page_text"](spark, SF).collect()
    assert len(rows) == 50 and all(r["text"] and "<" not in r["text"] for r in rows)
    assert not any("©" in r["text"] or "track(" in r["text"] for r in rows)
