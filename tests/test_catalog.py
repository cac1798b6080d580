"""Every query with an oracle gives DuckDB's rows on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from plexgraph import catalog

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_duckdb(spark, duck, name):
    df = catalog.QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    found = duck.execute(catalog.ORACLES[name])
    at = [x[0] for x in found.description]
    assert sorted(at) == columns
    want = sorted(tuple(plain(r[at.index(c)]) for c in columns) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want


def test_the_entry_works_without_the_training_data_operators(spark):
    import importlib
    import sys

    import __spark_entry__ as entry

    hidden = {k: sys.modules.pop(k) for k in list(sys.modules) if k.startswith("plexgraph.llm") or k == "corpus_pipeline"}
    sys.modules |= {"plexgraph.llm": None, "corpus_pipeline": None}
    try:
        plain_entry = importlib.reload(entry)
        assert set(plain_entry.queries()) == set(catalog.QUERIES)
        assert set(plain_entry.oracle_sql()) == set(catalog.ORACLES)
    finally:
        del sys.modules["plexgraph.llm"], sys.modules["corpus_pipeline"]
        sys.modules |= hidden
        importlib.reload(entry)


def test_scans_prune_and_push_down(spark):
    plan = catalog.QUERIES["j08_semi_anti"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderstatus), IsNotNull(o_totalprice)" in plan
    assert "c_acctbal" not in plan
