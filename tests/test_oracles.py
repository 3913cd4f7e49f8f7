"""Every query of the engine that has SQL agrees with DuckDB on the smallest tables."""

import duckdb
import pytest

from kvstrata.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(spark, con, name):
    got = catalog.QUERIES[name](spark, SF)
    want = con.execute(catalog.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    rows = sorted(map(repr, (tuple(r) for r in got.select(*names).collect())))
    assert rows == sorted(map(repr, want.fetchall()))


@pytest.fixture(scope="module")
def long_orders(spark, tmp_path_factory):
    """Tables in which order 0 has 40 rows and others up to 21, and a connection to them."""
    d = tmp_path_factory.mktemp("long")
    con = duckdb.connect()
    con.execute(
        f"COPY (SELECT range AS l_orderkey, i AS l_partkey, 7 * i AS l_suppkey, (i % 7 + 1)::INT AS l_linenumber, (100 * range + i)::DOUBLE AS l_quantity, CASE WHEN (range + i) % 3 = 0 THEN 'R' ELSE 'N' END AS l_returnflag "
        f"FROM range(300), generate_series(1, CASE WHEN range = 0 THEN 40 ELSE 1 + range % 21 END) AS g(i)) TO '{d}/lineitem.parquet'"
    )
    con.execute(f"COPY (SELECT range AS o_orderkey, range::DOUBLE AS o_totalprice, range % 10 AS o_custkey FROM range(2000)) TO '{d}/orders.parquet'")
    for t in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    return str(d), con


@pytest.mark.parametrize("name", ["kv_merge_runs", "kv_merge_unique", "kv_bloom_quality"])
def test_any_number_of_runs(spark, long_orders, name):
    d, con = long_orders
    want = con.execute(catalog.ORACLES[name])
    rows = catalog.QUERIES[name](spark, d).select(*(c[0] for c in want.description)).collect()
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want.fetchall()))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 12
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
