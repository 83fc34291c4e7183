"""Queries whose rows SQL can state."""

import duckdb
import pytest

from tracelight.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name, sf):
    folder = f"/root/testdata/{sf}"
    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = db.sql(ORACLE_SQL[name])
    df = QUERIES[name](spark, folder).select(*want.columns)
    assert sorted(map(tuple, df.collect())) == sorted(want.fetchall())
