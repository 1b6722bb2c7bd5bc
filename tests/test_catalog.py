"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import duckdb
import pytest
from tarazu import catalog

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = sorted(str([r[c] for c in columns]) for r in df.collect())
    if name not in catalog.ORACLE:
        assert rows
        return
    found = duck.sql(catalog.ORACLE[name])
    assert sorted(found.columns) == columns
    assert sorted(str([dict(zip(found.columns, r, strict=True))[c] for c in columns]) for r in found.fetchall()) == rows


def test_budget_like_a_loop(spark):
    from tarazu.streaming import budget

    at = [0, 1, 2, 3, 61, 61, 62, 100, 122]
    rows = spark.createDataFrame([(1, t, i) for i, t in enumerate(at)], "client long, at long, seq long")
    hits, expected = [], []
    for t in at:
        hits = [h for h in hits if h > t - 60]
        expected.append(len(hits) < 2)
        if expected[-1]:
            hits.append(t)
    assert [r["admitted"] for r in budget.admitted(rows, 60, 2).orderBy("seq").collect()] == expected


def test_malformed_queries_are_refused():
    from tarazu.plans.query import Query

    with pytest.raises(ValueError, match="doesn't read"):
        Query("recurring", merchant="x")
    with pytest.raises(ValueError, match="no such intent"):
        Query("average")


def test_dates_of_every_customer_are_settled(spark, sf_dir):
    files = {r[0] for r in spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey").distinct().collect()}
    out = catalog.QUERIES["date_order_settled"](spark, sf_dir).collect()
    assert {r["f"] for r in out} == files and any(f % 2 for f in files)
    assert all(r["date_order"] == ("day_first" if r["f"] % 3 else "month_first") for r in out if r["observed"])
