import math

import duckdb
import pytest

from tallyspark.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "<null>"
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return f"{float(v):.6f}"
    return str(v)


def same(df, sql, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    order = sorted(names)
    theirs = sorted(tuple(cell(r[names.index(c)]) for c in order) for r in rel.fetchall())
    assert sorted(df.columns) == order
    assert sorted(tuple(cell(r[c]) for c in order) for r in df.collect()) == theirs


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_meets_its_sql(spark, name):
    same(catalogue.QUERIES[name](spark, SF), catalogue.SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0
