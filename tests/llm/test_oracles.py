import duckdb
import pytest

from tests.helpers import duck_rows, spark_rows
from tracetide.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages", "labels", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    query, sql = QUERIES[name]
    assert spark_rows(query(spark, SF)) == duck_rows(con, sql)
