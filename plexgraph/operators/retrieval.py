"""BM25, vector search, rank fusion and reranking as joins and aggregates."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classify import query_shape
from ..functions.text import cosine, half_up
from .graph import checkpointed

K1, B, RRF_K = 1.5, 0.75, 60


def bm25(docs: DataFrame, terms: list[str], limit: int) -> DataFrame:
    """(id, score) of the best texts for distinct query terms; ``docs`` is (id, tokens). Ties by id; no terms, no rows.

    Texts are read once: a narrow row of each, its length and how often it has every term, is kept and gives both the
    statistics and the scores.
    """
    terms = list(dict.fromkeys(terms))
    if not terms:
        return docs.select("id", F.lit(0.0).alias("score")).where("false")
    tf = [F.size(F.filter("tokens", _is(t))).alias(f"t{i}") for i, t in enumerate(terms)]
    counted = checkpointed(docs.select("id", F.size("tokens").alias("dl"), *tf))
    stats = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"t{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    some = counted.where(" or ".join(f"t{i} > 0" for i in range(len(terms)))).join(F.broadcast(stats))  # one row
    norm = K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
    score = sum((F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)) * F.col(f"t{i}") * (K1 + 1) / (F.col(f"t{i}") + norm) for i in range(len(terms))), F.lit(0.0))
    return some.select("id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def multi_query(hits: list[DataFrame], limit: int) -> DataFrame:
    """Hits (id, score) of several queries: the first query that finds an element gives its score; best first, ties by id."""
    x = None
    for i, df in enumerate(hits):
        one = df.select("id", "score", F.lit(i).alias("q"))
        x = one if x is None else x.unionByName(one)
    return x.groupBy("id").agg(F.min_by("score", "q").alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def _is(term: str):
    return lambda x: x == term


def vector_search(vectors: DataFrame, query: DataFrame, limit: int) -> DataFrame:
    """(id, score) by cosine with a one-row query (q); filters belong before this. Ties by id."""
    scored = vectors.join(F.broadcast(query)).select("id", F.round(cosine(F.col("v"), F.col("q")), 6).alias("score"))  # one row
    return scored.orderBy(F.desc("score"), "id").limit(limit)


def fuse(lists: list[DataFrame], limit: int) -> DataFrame:
    """Reciprocal rank fusion of short ranked lists (id, score); ranks start at 0."""
    from pyspark.sql import Window

    ranked = None
    for i, df in enumerate(lists):
        w = Window.partitionBy("list").orderBy(F.desc("score"), "id")
        r = df.select("id", "score", F.lit(i).alias("list")).select("id", (F.row_number().over(w) - 1).alias("rank"))
        ranked = r if ranked is None else ranked.unionByName(r)
    out = ranked.groupBy("id").agg(F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 9).alias("score"))
    return out.orderBy(F.desc("score"), "id").limit(limit)


def exact_name(query: str) -> str:
    """What a query must equal to name an element: without quotes, after its last dot, lower-cased."""
    q = (query or "").strip()
    if len(q) >= 2 and q[0] == q[-1] and q[0] in "\"'":
        q = q[1:-1]
    head, dot, tail = q.rpartition(".")
    return (tail if head and tail else q).lower()


def lexical_terms(query: str) -> list[str]:
    """The distinct identifier parts of a query, as the index has them."""
    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", query or "")
    spaced = re.sub(r"([0-9])([A-Za-z])", r"\1 \2", re.sub(r"([A-Za-z])([0-9])", r"\1 \2", spaced))
    return list(dict.fromkeys(x.lower() for x in re.split(r"[^A-Za-z0-9]+", spaced) if x))


def lexical_search(elements: DataFrame, query: str, limit: int = 10, boost: float = 3.0) -> DataFrame:
    """(id, name, file, line, type, score) of elements (those and tokens): BM25 over-fetched, an exact name's score times ``boost``, 3 digits."""
    hits = bm25(elements.select("id", "tokens"), lexical_terms(query), max(limit * 4, 40))
    x = elements.select("id", "name", "file", "line", "type").join(F.broadcast(hits), "id")  # as few as were fetched
    score = F.col("score") * F.when(F.lower("name") == exact_name(query), boost).otherwise(1.0)
    x = x.withColumn("score", score).orderBy(F.desc("score"), "id").limit(limit)
    return x.withColumn("score", half_up(F.col("score"), 3))


def route_query(shape: str, embeddings: bool = True) -> tuple[str, str]:
    """(lane, reason) of a query's shape: names and flags go to the lexical lane, phrases to the semantic one where it works."""
    if shape != "phrase":
        return "lexical", f"{shape}: answered from the symbol table"
    return ("semantic", "phrase: answered from embeddings") if embeddings else ("lexical", "embeddings unavailable: degraded to the lexical lane")


def search(elements: DataFrame, query: str, semantic=None, limit: int = 10) -> tuple[str, str, DataFrame]:
    """(lane, reason, hits): the lane of the query's shape; a semantic lane that fails or isn't there degrades to the lexical one.

    ``semantic``: a function of query and limit that gives (id, score).
    """
    shape = elements.sparkSession.range(1).select(query_shape(F.lit(query)).alias("s")).first().s
    lane, reason = route_query(shape, semantic is not None)
    if lane == "semantic":
        try:
            hits = semantic(query, limit)
            hits.schema  # noqa: B018  a lane that can't be planned has failed too
            return lane, reason, hits
        except Exception as e:  # noqa: BLE001  whatever a provider raises
            lane, reason = "lexical", f"{type(e).__name__}: degraded to the lexical lane"
    return lane, reason, lexical_search(elements, query, limit)


WEIGHTS = {"dependencies": 0.2, "dependents": 0.3, "coverage": 0.2, "complexity": 0.1, "semantic": 0.2}


def rerank(results: DataFrame, strategy: str = "general", weights: dict[str, float] | None = None, most: float = 2.0, least: float = 0.0) -> DataFrame:
    """``results`` (id, score, dependencies, dependents, coverage in percent, complexity, exported) with ``original`` and ``boost``, best first, ties by id.

    Only the semantic weight is taken as a share of all weights; the graph's and the quality's count as given, and an unknown
    factor counts nothing. The strategy multiplies, the boost is at most ``most``, and a score below ``least`` becomes 0, as does one that
    wasn't positive.
    """
    w = WEIGHTS | (weights or {})
    total = sum(w.values())
    if not 0 < total < float("inf"):
        raise ValueError(f"ranking weights must sum to a positive number, not {total}")
    known = lambda c, of: F.when(F.col(c).isNotNull(), of(F.col(c))).otherwise(0.0)
    share = lambda c, m: known(c, lambda x: F.least(x / m, F.lit(1.0)))
    graph = share("dependencies", 10.0) * w["dependencies"] + share("dependents", 10.0) * w["dependents"]
    quality = known("coverage", lambda x: x / 100.0) * w["coverage"] - share("complexity", 20.0) * w["complexity"]
    extra = {
        "centrality": known("dependents", lambda x: x / 100.0),
        "usage": known("dependents", lambda x: x / 50.0),
        "quality": (known("coverage", lambda x: x / 100.0) + F.greatest(F.lit(0.0), 1 - known("complexity", lambda x: x / 20.0))) / 2,
        "public": F.when(F.coalesce("exported", F.lit(False)), 0.3).otherwise(0.0),
    }.get(strategy, F.lit(0.0))
    new = (F.col("score") * w["semantic"] / total + graph + quality) * (1 + extra)
    positive = F.coalesce(F.col("score") > 0, F.lit(False))
    x = results.withColumn("original", F.col("score")).withColumn("boost", F.when(positive, F.least(new / F.col("score"), F.lit(most))).otherwise(1.0))
    boosted = F.when(positive, F.col("original") * F.col("boost")).otherwise(0.0)
    return x.withColumn("score", F.when(boosted < least, 0.0).otherwise(boosted)).orderBy(F.desc("score"), "id")
