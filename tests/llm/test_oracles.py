"""The operators that SQL can express give DuckDB's rows on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from plexgraph.llm import queries

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_duckdb(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, str(DATA))
    found = c.execute(queries.ORACLES[name])
    at = [x[0] for x in found.description]
    assert set(at) <= set(df.columns)
    want = sorted(tuple(map(str, r)) for r in found.fetchall())
    assert sorted(tuple(str(r[k]) for k in at) for r in df.collect()) == want
