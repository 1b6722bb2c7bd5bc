"""Every corpus query with SQL gives the rows that DuckDB gives, on whole small tables."""

import duckdb
import pytest
from tarazu.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_gives_the_rows_of_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "conversations", "labels", "embeddings"):
        con.sql(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = con.sql(queries.ORACLE[name])
    assert sorted(found.columns) == columns
    sql = sorted(str([dict(zip(found.columns, r, strict=True))[c] for c in columns]) for r in found.fetchall())
    assert sorted(str([r[c] for c in columns]) for r in df.collect()) == sql
