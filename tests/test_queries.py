"""Every query against its SQL, on the smallest tables."""

import decimal

import duckdb
import pytest

from tracelight.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf_dir):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return db


def spelled(v):
    return f"decimal {v}" if isinstance(v, decimal.Decimal) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, oracle, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    want = oracle.sql(catalog.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    rows = sorted(tuple(spelled(r[i]) for i in at) for r in want.fetchall())
    assert sorted(tuple(spelled(v) for v in r) for r in df.select(*columns).collect()) == rows


def test_families_of_large_and_odd_numbers(spark, tmp_path):
    db = duckdb.connect()
    large = "SELECT 1 AS o_orderkey, ((1::BIGINT << b) // 5040 - 500 + i) AS o_custkey FROM range(1000) r(i), (VALUES (53), (57), (62)) s(b)"
    odd = "VALUES (0, 5), (1, 1), (NULL, 3), (3, NULL), (-1, 1), (-7, 3), (1, -143), (9000000, 900000)"
    db.execute(f"CREATE VIEW orders AS {large} UNION ALL SELECT * FROM ({odd})")
    db.execute("CREATE VIEW part AS SELECT (1::BIGINT << 40) + i AS p_partkey, CASE WHEN i > 0 THEN i END::INTEGER AS p_size FROM range(50) r(i) UNION ALL SELECT m // 7919, (m % 7919 - i)::INTEGER FROM range(50) r(i), (SELECT 9223372036854775807 AS m)")
    for t in ("orders", "part"):
        db.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    want = db.execute(catalog.ORACLE_SQL["families_for"]).fetchall()
    got = catalog.QUERIES["families_for"](spark, str(tmp_path)).select("v", "has_add", "has_mul", "has_radix", "families").collect()
    assert len({r for r in want if r[0] and r[0] > 2**53 and r[2]}) > 50
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_names_agree():
    assert set(catalog.ORACLE_SQL) == set(catalog.QUERIES) and "scan_report" in catalog.QUERIES


def test_the_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 4
