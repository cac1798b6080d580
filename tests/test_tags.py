"""Tag references and signatures by hand."""

import pytest
from pyspark.sql import functions as F

from plexgraph.functions import tags
from plexgraph.operators import retrieval, signatures


def one(spark, f, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_parse(spark):
    a, b, c, d = one(spark, tags.parse, "@Fn/src/a.ts#run:4-9{status='a, b', q=[1, 2], q=3}", "@Cl/x", " @Fn/a/b.ts:try{here} ", "@T/p.ts#X.y:7")
    assert (a.type, a.path, a.element, a.line, a.line_end, a.metadata, a.error) == ("Fn", "src/a.ts", "run", 4, 9, {"status": "a, b", "q": "3"}, None)
    assert (b.type, b.path, b.element, b.line, b.metadata) == ("Cl", "x", None, None, None)
    assert (c.block, c.block_id) == ("try", "here")
    assert (d.element, d.line) == ("X.y", 7)


@pytest.mark.parametrize(
    ("reference", "verdict"),
    [("x", "no_at"), (None, "no_at"), ("@fn/x", "type"), ("@Fn/", "path"), ("@Fn/a/../b", "path"), ("@Fn/x#", "element"), ("@Fn/x#1a", "element"), ("@Fn/x:", "line"), ("@Fn/x:try{}", "line"), ("@Fn/x{a=1", "unclosed_metadata"), ("@Fn/x{??}", "metadata"), ("@Qq/x", "unknown_type"), ("@Fn/x:9-4", "range"), ("@Fn/x:4-9", "ok")],
)
def test_verdicts(spark, reference, verdict):
    assert one(spark, tags.verdict, reference) == [verdict]


def test_round_trip_and_suggestions(spark):
    x = spark.range(1).select(tags.format_reference(F.lit("Fn"), F.lit("a.ts"), F.lit("run"), F.lit(3)).alias("r")).first().r
    assert x == "@Fn/a.ts#run:3"
    near, known = one(spark, tags.suggestions, "Fm", "Fn")
    assert near[:2] == ["F", "Fn"]
    assert "AST" not in near
    assert known == []


@pytest.mark.parametrize(
    ("before", "after", "change"),
    [
        ([("a", "int", False)], [("a", "int", False), ("b", "int", True)], None), ([("a", "int", False)], [("a", "int", False), ("b", "int", False)], "added"), ([("a", "int", False)], [], "removed"),
        ([("a", "int", False), ("b", "int", False)], [("b", "int", False), ("a", "int", False)], "reordered"), ([("a", "int", False)], [("a", "text", False)], "type-changed"), ([("a", None, False)], [("a", None, False)], None), (None, [], None),
    ],
)
def test_parameters(spark, before, after, change):
    df = spark.createDataFrame([(before, after)], f"b {signatures.PARAMETERS}, a {signatures.PARAMETERS}")
    assert df.select(signatures.parameter_change(F.col("b"), F.col("a")).alias("c")).first().c == change


def test_rerank_by_hand(spark):
    rows = [("a", 0.5, 5, 20, 80.0, 10, True), ("b", 0.9, None, None, None, None, None), ("c", 0.0, 9, 9, 99.0, 0, True)]
    df = spark.createDataFrame(rows, "id string, score double, dependencies int, dependents int, coverage double, complexity int, exported boolean")
    got = {r.id: (round(r.score, 6), round(r.boost, 6)) for r in retrieval.rerank(df).collect()}
    assert got["a"] == (0.61, 1.22)  # 0.1 + 0.1 + 0.3 + 0.16 - 0.05
    assert got["b"] == (0.18, 0.2)
    assert got["c"] == (0.0, 1.0)
    assert retrieval.rerank(df, "public").first().score == pytest.approx(0.793)
    with pytest.raises(ValueError, match="sum"):
        retrieval.rerank(df, weights=dict.fromkeys(retrieval.WEIGHTS, 0.0))
