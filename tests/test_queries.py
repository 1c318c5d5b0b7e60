"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from orrery.queries import QUERIES, SQL

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def same(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def rows_of(names, rows):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(same(r[i]) for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, oracle, name):
    got = QUERIES[name](spark, SF_DIR)
    found = oracle.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(got.columns) == sorted(names)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(names, found.fetchall())


def test_samples_have_the_size_asked_for(spark):
    assert QUERIES["select_sample"](spark, SF_DIR).count() == 100
    orders = spark.read.parquet(f"{SF_DIR}/orders.parquet").count()
    assert QUERIES["select_sample_fraction"](spark, SF_DIR).count() == round(orders * 0.1)
    assert set(QUERIES) - set(SQL) == {"select_sample", "select_sample_fraction"}


def test_first_and_last_of_equal_prices_are_settled(spark, tmp_path):
    for t in TABLES:
        if t != "orders":
            os.symlink(f"{SF_DIR}/{t}.parquet", tmp_path / f"{t}.parquet")
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE TABLE orders AS SELECT s.* REPLACE (i * 10000 + o_orderkey AS o_orderkey, CASE WHEN o_custkey % 7 > 0 OR i > 1 THEN o_totalprice END AS o_totalprice) FROM '{SF_DIR}/orders.parquet' s, range(4) r(i) ORDER BY o_orderkey")
    want = rows_of(["o_custkey", "f", "l", "m"], con.execute(SQL["sql_group_first_last"]).fetchall())
    for order in ("o_orderkey", "o_orderkey DESC", "hash(o_orderkey)"):
        con.execute(f"COPY (FROM orders ORDER BY {order}) TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
        got = QUERIES["sql_group_first_last"](spark, str(tmp_path))
        assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == want
