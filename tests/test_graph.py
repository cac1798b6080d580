"""Graph operators on small graphs with results worked out by hand or by brute force."""

import itertools
import random
from collections import defaultdict

import pytest

from plexgraph.operators import analytics, clones, graph

#: Two dense clusters, one bridge, an isolated pair.
CLUSTERS = [(a, b) for group in ("abcd", "wxyz") for a, b in itertools.combinations(group, 2)] + [("d", "w"), ("p", "q")]


def frame(spark, pairs, schema="src string, tgt string"):
    return spark.createDataFrame(pairs, schema)


def edges(spark, rows):
    return spark.createDataFrame(rows, "src string, tgt string, rel string, status string, line long")


def test_only_resolved_edges_count(spark):
    e = edges(spark, [("a", "b", "call", "resolved", 1), ("a", "b", "call", "ambiguous", 2), ("c", None, "call", "resolved", 3), ("a", "a", "import", "resolved", 4)])
    got = {r.id: (r.fan_in, r.fan_out, r.score) for r in graph.hotspots(e, files(spark, a="x.ts", b="y.ts", c="z.ts")).collect()}
    assert got == {"a": (1, 2, 3), "b": (1, 0, 1)}


def files(spark, **of):
    return spark.createDataFrame(list(of.items()), "id string, file string")


def test_hotspots_leave_tests_and_demos_out(spark):
    rows = [("a", "b", True), ("a", "t", False), ("d", "b", False), ("e", "b", None), ("x", "b", False)]
    e = edges(spark, [(s, t, "call", "resolved", 1) for s, t, _ in rows]).join(spark.createDataFrame(rows, "src string, tgt string, test_origin boolean"), ["src", "tgt"])
    n = files(spark, a="src/a.ts", b="src/b.ts", t="src/b.test.ts", d="examples/d.ts", e="src/example-extractor.ts")
    got = {r.id: (r.fan_in, r.fan_out) for r in graph.hotspots(e, n).collect()}
    assert got == {"a": (0, 1), "b": (3, 0), "e": (0, 1)}
    every = {r.id: (r.fan_in, r.fan_out) for r in graph.hotspots(e, n, src_only=False).collect()}
    assert every == {"a": (0, 2), "b": (4, 0), "t": (1, 0), "d": (0, 1), "e": (0, 1)}


def test_hotspot_ties_go_by_id(spark):
    e = edges(spark, [(x, y, "call", "resolved", 1) for x, y in (("b", "c"), ("a", "d"))])
    assert [r.id for r in graph.hotspots(e, files(spark, a="a", b="b", c="c", d="d"), limit=3).collect()] == ["a", "b", "c"]


def test_resolution_takes_the_first_tier(spark):
    n = spark.createDataFrame([("@F/x.ts#run:3", "run", "function", "x.ts", 3, None), ("@F/y.ts#rerun:1", "rerun", "function", "y.ts", 1, None), ("run", "z", "function", "lib/run", 9, None)], "id string, name string, type string, file string, line long, layer string")
    assert {(r.id, r.tier) for r in graph.resolve(n, "run").collect()} == {("run", 1)}
    assert {(r.id, r.tier) for r in graph.resolve(n, "@F/x.ts#run").collect()} == {("@F/x.ts#run:3", 2)}
    assert {(r.name, r.tier) for r in graph.resolve(n, "rerun").collect()} == {("rerun", 3)}
    assert {r.tier for r in graph.resolve(n, "RUN").collect()} == {6}
    assert graph.resolve(n, "nothing").count() == 0


@pytest.mark.parametrize(("threshold", "n"), [("exact", 1), ("heuristic", 2), ("inferred", 3), ("whatever", 3), (None, 3)])
def test_an_unknown_threshold_filters_nothing(spark, threshold, n):
    from pyspark.sql import functions as F

    t = spark.createDataFrame([("exact",), ("heuristic",), ("inferred",)], "tier string")
    assert t.where(graph.meets(F.col("tier"), threshold)).count() == n


def test_reach_gives_first_depths_and_ends_on_cycles(spark):
    e = frame(spark, [("b", "a"), ("c", "b"), ("a", "c"), ("d", "a"), ("d", "c"), ("e", "d")])
    got = {r.id: r.depth for r in graph.reach(e, spark.createDataFrame([("a",)], "id string"), 9).collect()}
    assert got == {"b": 1, "d": 1, "c": 2, "e": 2}


def test_paths(spark):
    e = frame(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "a")])
    assert graph.shortest_path(e, "a", "d").first().path == ["a", "c", "d"]
    assert graph.shortest_path(e, "d", "zz").count() == 0
    assert [r.path for r in graph.all_paths(e, "a", "d", 5).orderBy("hops").collect()] == [["a", "c", "d"], ["a", "b", "c", "d"]]


@pytest.mark.parametrize("seed", range(3))
def test_strong_components_match_reachability(spark, seed):
    rng = random.Random(seed)
    pairs = sorted({(rng.randrange(14), rng.randrange(14)) for _ in range(22)})
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
    reach = {}
    for s in range(14):
        todo, seen = [s], set()
        while todo:
            for w in near[todo.pop()] - seen:
                seen.add(w)
                todo.append(w)
        reach[s] = seen
    want = {}
    for a in range(14):
        mates = {b for b in range(14) if b in reach[a] and a in reach[b]} | {a}
        if len(mates) > 1:
            want[a] = min(mates)
    got = {r.id: r.component for r in graph.strong_components(frame(spark, pairs, "src long, tgt long")).collect()}
    assert got == want


def test_strong_components_of_a_dag_are_empty(spark):
    assert graph.strong_components(frame(spark, [("a", "b"), ("b", "c")])).count() == 0


def test_communities_find_the_clusters(spark):
    got = {r.id: r.community for r in analytics.communities(frame(spark, CLUSTERS)).collect()}
    assert got["a"] == got["b"] == got["c"]
    assert got["x"] == got["y"] == got["z"]
    assert got["a"] != got["x"]


def test_betweenness_and_articulation(spark):
    e = frame(spark, CLUSTERS)
    got = {r.id: r.score for r in analytics.betweenness(e).collect()}
    # a path from one cluster to the other passes both ends of the bridge: 3 x 4 pairs each
    assert got["d"] == got["w"] == 12.0
    assert {r.id for r in analytics.articulation_points(e).collect()} == {"d", "w"}


def test_near_miss_clones_match_brute_force(spark):
    rng = random.Random(1)
    base = [rng.choice("abcdefgh") for _ in range(30)]
    rows = [(i, "k", [rng.choice("abcdefgh") if rng.random() < 0.03 * i else x for x in base]) for i in range(8)] + [(8, "other", base), (9, "k", base)]

    def dice(x, y):
        count = lambda v: {t: v.count(t) for t in v}
        a, b = count(x), count(y)
        return round(2 * sum(min(a[t], b.get(t, 0)) for t in a) / (len(x) + len(y)), 6)

    want = {(a[0], b[0], s) for a, b in itertools.combinations(rows, 2) if a[1] == b[1] and 0.9 <= (s := dice(a[2], b[2])) < 1}
    got = {tuple(r) for r in clones.near_misses(spark.createDataFrame(rows, "id long, bucket string, tokens array<string>")).collect()}
    assert got == want
    assert want
