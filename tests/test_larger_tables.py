"""Queries on small tables of the kinds that the smallest driver tables don't hold."""

import duckdb

from plexgraph import catalog


def same_as_sql(spark, folder, name, tables):
    """A query's rows over tables (name: (schema, rows)) are its SQL's."""
    duck = duckdb.connect()
    for t, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    found = duck.execute(catalog.ORACLES[name])
    columns = [x[0] for x in found.description]
    want = sorted(map(str, found.fetchall()))
    got = sorted(str(tuple(r)) for r in catalog.QUERIES[name](spark, str(folder)).select(*columns).collect())
    assert got == want and got
    return got


def test_a_pack_that_is_just_full(spark, tmp_path):
    code = "import x\n" + "    indented\n" * 40
    rows = [(1, 1, "user", "x" * 351), (1, 2, "user", "y"), (2, 1, "user", code), (2, 2, "user", "y"), (3, 1, "user", None), (3, 1, "user", "known"), (3, 2, "user", "y" * 300), (4, 1, "user", None), (4, 2, "user", "y"), (4, 0, "user", "z")]
    got = same_as_sql(spark, tmp_path, "t19_packed_context", {"conversations": ("conv_id long, turn long, role string, text string", rows)})
    assert got[:2] == ["(1, 1, 1)", "(2, 0, 2)"]


def test_near_misses_shuffle_rare_tokens_only(spark):
    import random
    from collections import Counter

    from plexgraph.operators import clones

    draw = random.Random(7)
    texts = [[draw.choice("abcdefghij") * draw.randint(1, 3) for _ in range(draw.randint(1, 60))] for _ in range(12)]
    for t in list(texts):
        for _ in range(4):
            near = list(t)
            for _ in range(draw.randint(0, 3)):
                near[draw.randrange(len(near))] = draw.choice("abxyz")
            texts.append(near)
    texts += texts[:10] + [[], [""]]  # copies of whole elements
    rows = [(i, "uv"[i % 2] if i % 9 else None, t) for i, t in enumerate(texts)] + [(7, "v", ["more"]), (900, "u", None)]
    whole = {}
    for i, bucket, t in rows:
        if bucket and t is not None:
            whole.setdefault((bucket, i), Counter()).update(t)
    want = set()
    for (p, i), x in whole.items():
        for (q, j), y in whole.items():
            if p == q and i < j and x and y:
                s = round(2 * (x & y).total() / (x.total() + y.total()), 6)
                if 0.9 <= s < 1:
                    want.add((i, j, s))
    found = clones.near_misses(spark.createDataFrame(rows, "id long, bucket string, tokens array<string>"), 0.9)
    got = [tuple(r) for r in found.collect()]
    assert set(got) == want and len(got) == len(want) > 20
    assert "tokens" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_files_of_one_small_table_are_read_by_many_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    from plexgraph.sources import extract, scan, synthetic

    spark.createDataFrame([(i, f"n{i}", i % 50) for i in range(200)], "p_partkey long, p_name string, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    files = synthetic.files(spark, str(tmp_path))
    for found in (extract.facts(files), scan.scan(files)):
        assert found.select(F.spark_partition_id().alias("p")).distinct().count() >= 4


def test_a_written_graph_is_shuffled_once(spark, tmp_path):
    from plexgraph.sources import artifacts

    edges = spark.createDataFrame([(f"a{i % 7}", f"b{i % 5}", "call", "resolved", "f", i % 3) for i in range(300)], "src string, tgt string, rel string, status string, file string, line long")
    nodes = spark.createDataFrame([(f"a{i % 7}", i % 7) for i in range(20)], "id string, line long")
    normal = artifacts.normal_edges(edges).sortWithinPartitions("id")
    assert normal._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    artifacts.write_graph(nodes, edges, str(tmp_path))
    n, e = artifacts.load_graph(spark, str(tmp_path))
    assert n.count() == 7 and e.count() == e.select("id").distinct().count() == e.select("src", "tgt", "line").distinct().count() == 105
    for part in e.rdd.glom().collect():
        assert [r.id for r in part] == sorted(r.id for r in part)


def test_texts_of_one_table_are_split_by_many_tasks(spark):
    from pyspark.sql import functions as F

    from plexgraph.plans import build_queries

    corpus = build_queries._corpus(spark, "/root/testdata/sf0.001").where("type = 'orders'")
    assert corpus.select(F.spark_partition_id().alias("p")).distinct().count() >= 4


def test_betweenness_needs_no_bound_of_edges(spark, monkeypatch):
    import random

    from plexgraph.operators import analytics

    draw = random.Random(3)
    pairs = sorted({tuple(sorted(draw.sample(range(40), 2))) for _ in range(70)}) + [(50, 51), (51, 52)]
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    dist = {s: {s: 0} for s in near}
    ways = {s: {s: 1} for s in near}
    for s in near:
        level = [s]
        while level:
            after = []
            for v in level:
                for w in near[v]:
                    if w not in dist[s]:
                        dist[s][w], ways[s][w] = dist[s][v] + 1, 0
                        after.append(w)
                    if dist[s][w] == dist[s][v] + 1:
                        ways[s][w] += ways[s][v]
            level = after
    want = {v: 0.0 for v in near}
    for s in near:
        for t in dist[s]:
            for v in dist[s]:
                if len({s, t, v}) == 3 and dist[s][v] + dist[v][t] == dist[s][t]:
                    want[v] += ways[s][v] * ways[v][t] / ways[s][t] / 2
    monkeypatch.setattr(analytics, "MOST", 10)
    monkeypatch.setattr(analytics, "PIECE", 3)
    for schema, name in (("src long, tgt long", int), ("src string, tgt string", str)):
        e = spark.createDataFrame([(name(a), name(b)) for a, b in pairs], schema)
        got = {int(r.id): r.score for r in analytics.betweenness(e).collect()}
        assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-3 for v in want)
    assert analytics.betweenness(e.where("false")).count() == 0


def test_edges_are_counted_before_they_travel_to_their_targets(spark):
    plan = catalog.QUERIES["j01_enriched_callers"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2 and plan.index("Aggregate") < plan.index("Join") < plan.rindex("Aggregate") < plan.rindex("Join")
