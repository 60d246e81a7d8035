"""Shape of the problems' queries on the smallest tables, and SQL where there is some."""

import os

import duckdb
import pytest

from termloom.llm import queries

FOUND = {
    "p1_found": [("row_idx", "bigint"), ("field", "string")], "p2_found": [("row_idx", "bigint")], "p3_found": [("pos_a", "bigint"), ("pos_b", "bigint")],
    "p4_found": [("tbl", "string"), ("key_a", "bigint"), ("key_b", "bigint")], "p5_found": [("row_idx", "bigint")], "p6_found": [("row_idx", "bigint"), ("defect", "string")],
    "p7_found": [("tbl", "string"), ("key", "bigint")], "p8_found": [("doc_id", "bigint"), ("item_id", "bigint")], "p10_found": [("doc_id", "bigint"), ("start_char", "bigint"), ("end_char", "bigint")],
}


@pytest.mark.parametrize("name", FOUND)
def test_columns_and_distinct_rows(spark, data, name):
    df = queries.queries()[name](spark, data)
    assert df.dtypes == FOUND[name]
    rows = df.collect()
    assert rows and len(rows) == len(set(rows))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_like_sql(spark, data, name):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{data}/{f}'")
    assert sorted(map(tuple, queries.queries()[name](spark, data).collect())) == sorted(con.execute(queries.oracle_sql()[name]).fetchall())
