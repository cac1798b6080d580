"""Predicates over paths, queries and questions, row by row."""

import pytest
from pyspark.sql import functions as F

from plexgraph.functions import classify
from plexgraph.functions import text as t
from plexgraph.operators import retrieval


def each(spark, f, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_tokens(spark):
    got = each(spark, lambda c: F.array_join(t.lexical_tokens(c), " "), ["authenticateUser", "HTTPServer2x", "snake_case-kebab.v10", "", "naïve \u212aelvin", "aB1c", None])
    assert got == ["authenticate user", "httpserver 2 x", "snake case kebab v 10", "", "na ve elvin", "a b 1 c", None]


def test_shapes(spark):
    asked = ['"exact phrase"', "'x'", "--stale-only", "-k", "foo", "LRUCache.get", "$el._x.y", "http://a/b", "how does it work", "", None, "  spaced  ", '"']
    assert each(spark, classify.query_shape, asked) == ["quoted", "quoted", "flag", "flag", "identifier", "member", "member", "identifier", "phrase", "phrase", "phrase", "identifier", "identifier"]


def test_strategies(spark):
    asked = ["Who uses this?", "what calls public API", "exported things", "is it TESTED", "the most important one", "key", "anything else"]
    assert each(spark, classify.query_strategy, asked) == ["usage", "usage", "public", "quality", "centrality", "centrality", "general"]


def test_question_types(spark):
    asked = ["How does A compare?", "compare A and B", "A vs B", "should I do it", "what would improve it", "where is it"]
    assert each(spark, classify.question_type, asked) == ["explanation", "comparison", "comparison", "best-practices", "best-practices", "qa"]


PATHS = ["src/__tests__/a.ts", "src/a.test.ts", "Tests/a.ts", "tests/a.py", "test_a.py", "src/a_test.py", "src/test.ts", "examples/a.ts", "src/example-extractor.ts", "demo-a.ts", "src\\cli\\x.ts", "src/index.ts", "src/indexer.ts", None]


@pytest.mark.parametrize(
    ("f", "want"),
    [
        (classify.is_test_file, "11000000000000"),
        (classify.is_test_like, "11110000000000"),
        (classify.is_coverage_test, "1100110000000-"),
        (classify.is_gap_test, "1101110000000-"),
        (classify.is_demo_file, "00000001010000"),
        (classify.is_entrypoint, "11110000001100"),
    ],
)
def test_kinds_of_files(spark, f, want):
    assert "".join("-" if x is None else str(int(x)) for x in each(spark, f, PATHS)) == want


def test_health(spark):
    rows = [(["critical", "high", "moderate", "low"],), ([],), (["high"],), (["none", "low"],)]
    got = spark.createDataFrame(rows, "s array<string>").select(classify.health_score(F.col("s")).alias("h")).collect()
    assert [r.h for r in got] == [59.0, 100.0, 25.0, 75.0]
    x = spark.range(1).select(
        classify.security_score(*[F.lit(v) for v in (1, 1, 3, 30, 9)]).alias("a"), classify.maintenance_score(*[F.lit(v) for v in (10, 5, 2, 0, 1)]).alias("b"),
        classify.maintenance_score(*[F.lit(0)] * 5).alias("c"), classify.overall_health(F.lit(80), F.lit(70), F.lit(76)).alias("d"),
    ).first()
    assert tuple(x) == (0, 80.0, 100.0, "good")


def test_no_terms_no_rows(spark):
    docs = spark.createDataFrame([(1, ["a"])], "id int, tokens array<string>")
    assert retrieval.bm25(docs, [], 5).count() == 0
    assert retrieval.bm25(docs, ["b"], 5).count() == 0


def test_the_first_query_gives_the_score(spark):
    hits = [spark.createDataFrame(r, "id int, score int") for r in ([(1, 5), (2, 9)], [(2, 50), (3, 7)])]
    assert [tuple(r) for r in retrieval.multi_query(hits, 3).collect()] == [(2, 9), (3, 7), (1, 5)]
