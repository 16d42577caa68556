"""Row numbers and totals of batches against SQL, on more rows than a sample of the ranges holds."""

import duckdb
import pytest

import __spark_entry__ as entry

ROWS = 6000
TABLES = {
    "collated_order": ("customer", "SELECT i AS c_custkey, CASE WHEN i > 0 THEN 'Customer#' || lpad(CAST((i * 7919) % {n} AS VARCHAR), 9, '0') END AS c_name FROM range({n}) r(i)"),
    "padding_compare": ("documents", "SELECT (i * 7919) % {n} AS doc_id, CASE WHEN i % 50 <> 0 THEN repeat('water ', CAST((i * 31) % 97 AS INT)) END AS text FROM range({n}) r(i)"),
    "vector_rows": ("embeddings", "SELECT (i * 7919) % {n} AS vec_id, CAST(i % 10 AS INT) AS label FROM range({n}) r(i) UNION ALL SELECT NULL, 0"),
}


@pytest.mark.parametrize("name", sorted(TABLES))
def test_row_numbers(spark, tmp_path, name):
    table, rows = TABLES[name]
    db = duckdb.connect()
    db.execute(f"COPY ({rows.format(n=ROWS)}) TO '{tmp_path}/{table}.parquet'")
    db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    want = db.execute(entry.oracle_sql()[name]).fetchall()
    got = [tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


#: Odd keys: none, below zero, beyond 2 ** 42; and no rows at all.
ODD = {
    "keys": "SELECT CASE WHEN i > 0 THEN (i * 7919) % {n} * 4096 * 1048576 - 4096 END AS doc_id, repeat('water ', CAST((i * 31) % 97 AS INT)) AS text FROM range({n}) r(i)",
    "empty": "SELECT i AS doc_id, CAST(i AS VARCHAR) AS text FROM range(0) r(i)",
}


@pytest.mark.parametrize("name", ["batch_plan", "padding_compare"])
@pytest.mark.parametrize("kind", sorted(ODD))
def test_odd_keys(spark, tmp_path, name, kind):
    db = duckdb.connect()
    db.execute(f"COPY ({ODD[kind].format(n=500)}) TO '{tmp_path}/documents.parquet'")
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    want = db.execute(entry.oracle_sql()[name]).fetchall()
    got = [tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
