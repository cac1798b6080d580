"""Routes with parameters in any segment, against the query's own oracle."""

import duckdb

from plexgraph import catalog


def test_deep_parameters_match(spark, tmp_path):
    # one number a route: of several, the oracle's regexp_replace makes only the first a parameter
    urls = {0: "/a/b/c/d/7/e", 5: "/a/b/c/d/e/f/8/g", 10: "/x/1", 15: "/plain/one", 25: "/x/*",
            1: "/a/b/c/d/k/e", 2: "/a/b/c/d/e/f/k/g", 3: "/a/b/c/d/k/f", 4: "/x/y?q=1", 6: "/plain/one#top", 7: "/a/b/c/d/e/k/h/g", 9: "/x/y/z", 11: "/plain/two", 12: ""}
    spark.createDataFrame([(i, f"https://h.example{u}") for i, u in urls.items()], "page_id long, url string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = dict(duck.execute(f"SELECT page_id, confidence FROM ({catalog.ORACLES['j10_route_match']})").fetchall())
    got = {r.page_id: r.confidence for r in catalog.QUERIES["j10_route_match"](spark, str(tmp_path)).collect()}
    assert got == want
    assert want[1] == want[2] == 95
    assert want[3] == want[7] == 0
