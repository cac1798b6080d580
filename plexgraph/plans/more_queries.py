"""Further predicates, projections, diffs, routes and scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import classify
from ..operators import graph, retrieval
from ..sources import projections as p

N, E, EL = p.SQL_NODES, p.SQL_EDGES, p.SQL_ELEMENTS


@query("p11_complex", f"WITH {EL} SELECT doc_id FROM elements WHERE kind = 'en' AND file IN ('src1', 'src2') AND loc BETWEEN 2 AND 9 AND n_chars % 2 = 0")
def p11(spark, d):
    """All conditions at once."""
    return p.elements(spark, d).where((F.col("kind") == "en") & F.col("file").isin("src1", "src2") & F.col("loc").between(2, 9) & (F.col("n_chars") % 2 == 0)).select("doc_id")


@query("p15_exports_manifest", "SELECT p_name AS key, p_partkey, p_brand FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part WHERE p_size > 10) WHERE k = 1")
def p15(spark, d):
    """Exported elements, the first of each key."""
    x = p.read(spark, d, "part").where("p_size > 10")
    first = x.groupBy(F.col("p_name").alias("key")).agg(F.min(F.struct("p_partkey", "p_brand")).alias("r"))
    return first.select("key", "r.p_partkey", "r.p_brand")


@query("p17_entry_points", r"SELECT page_id, CASE WHEN regexp_matches(url, '/(index|main|app)') THEN 'name' WHEN regexp_matches(url, '^https?://(www|m)\.') THEN 'host' END AS reason FROM pages WHERE regexp_matches(url, '/(index|main|app)') OR regexp_matches(url, '^https?://(www|m)\.')")
def p17(spark, d):
    """Entry points by pattern."""
    reason = F.when(F.col("url").rlike("/(index|main|app)"), "name").when(F.col("url").rlike(r"^https?://(www|m)\."), "host")
    return p.read(spark, d, "pages").select("page_id", reason.alias("reason")).where("reason is not null")


@query("a20_tests_rollup", f"WITH {E}, {N}, r AS (SELECT DISTINCT src, tgt FROM edges WHERE status = 'resolved' AND rel = 'call') SELECT n.file, count(DISTINCT src) AS tests FROM r JOIN nodes n ON n.id = src WHERE tgt IN ('@P/10', '@P/11') GROUP BY n.file")
def a20(spark, d):
    """Direct callers of changed elements by file."""
    e = graph.resolved(p.edges(spark, d)).where("rel = 'call' and tgt in ('@P/10', '@P/11')").select(F.col("src").alias("id")).distinct()
    return e.join(p.nodes(spark, d).select("id", "file"), "id").groupBy("file").agg(F.count("*").alias("tests"))


@query("w05_rank_fusion", "WITH a AS (SELECT s_suppkey AS id, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) - 1 AS k FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 30), b AS (SELECT s_suppkey AS id, row_number() OVER (ORDER BY s_acctbal % 997 DESC, s_suppkey) - 1 AS k FROM supplier ORDER BY s_acctbal % 997 DESC, s_suppkey LIMIT 30) SELECT id, round(sum(1.0 / (60 + k)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id ORDER BY score DESC, id LIMIT 15")
def w05(spark, d):
    """Two ranked lists fused by reciprocal rank."""
    s = p.read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("score"))
    top = lambda df: df.orderBy(F.desc("score"), "id").limit(30)
    return retrieval.fuse([top(s), top(s.withColumn("score", F.col("score") % 997))], 15)


@query(
    "t02_lexical_surface",
    f"WITH {N} SELECT id, name || ' ' || name || ' ' || name || ' ' || type || CASE WHEN layer IS NULL THEN '' ELSE ' ' || layer END || ' ' || file AS surface FROM nodes",
)
def t02(spark, d):
    """What is indexed of an element: its name three times, type, layer and file."""
    return p.nodes(spark, d).select("id", F.concat_ws(" ", "name", "name", "name", "type", "layer", "file").alias("surface"))


@query(
    "t07_multi_query",
    """
WITH u AS (SELECT s_suppkey AS id, CAST(round(s_acctbal * 100) AS BIGINT) AS score, 0 AS q FROM supplier WHERE s_nationkey < 10
  UNION ALL SELECT s_suppkey, CAST(round(s_acctbal * 100) AS BIGINT) // 2, 1 FROM supplier WHERE s_nationkey > 5)
SELECT id, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY q) AS k FROM u) WHERE k = 1 ORDER BY score DESC, id LIMIT 20""",
)
def t07(spark, d):
    """Hits of several queries; the first query that finds one gives its score, here in whole cents."""
    s = p.read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.round(F.col("s_acctbal") * 100).cast("long").alias("cents"), "s_nationkey")
    a = s.where("s_nationkey < 10").select("id", F.col("cents").alias("score"))
    b = s.where("s_nationkey > 5").select("id", F.expr("cast(floor(cents / 2) as long)").alias("score"))
    return retrieval.multi_query([a, b], 20)


@query("t08_related", f"WITH {E}, r AS (SELECT src, tgt FROM edges WHERE status = 'resolved') SELECT id, CAST(max(score) AS DOUBLE) AS score FROM (SELECT tgt AS id, 0.7 AS score FROM r WHERE src = '@O/33' UNION ALL SELECT src, 0.8 FROM r WHERE tgt = '@O/33' UNION ALL SELECT src, 0.8 FROM r WHERE tgt = '@C/3') GROUP BY id")
def t08(spark, d):
    """Structural neighbours with the score of their direction."""
    r = graph.resolved(p.edges(spark, d)).where("src = '@O/33' or tgt in ('@O/33', '@C/3')")
    out = F.col("src") == "@O/33"
    x = r.select(F.when(out, F.col("tgt")).otherwise(F.col("src")).alias("id"), F.when(out, 0.7).otherwise(0.8).alias("score"))
    return x.groupBy("id").agg(F.max("score").alias("score"))


@query("d04_scan_diff", "WITH a AS (SELECT source || ':' || doc_id AS k, n_chars AS line FROM documents WHERE doc_id % 5 <> 0), b AS (SELECT source || ':' || doc_id AS k, CASE WHEN doc_id % 9 = 2 THEN n_chars + 1 ELSE n_chars END AS line FROM documents WHERE doc_id % 7 <> 0) SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'modified' END AS change FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.line <> b.line")
def d04(spark, d):
    """Elements added, removed or moved to another line, by file and name."""
    x = p.read(spark, d, "documents").select("doc_id", F.concat("source", F.lit(":"), F.col("doc_id").cast("string")).alias("k"), "n_chars")
    a = x.where("doc_id % 5 <> 0").select("k", F.col("n_chars").alias("was"))
    b = x.where("doc_id % 7 <> 0").select("k", F.when(F.col("doc_id") % 9 == 2, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("now"))
    y = a.join(b, "k", "full_outer").where("was is null or now is null or was <> now")
    return y.select("k", F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("modified").alias("change"))


@query("d10_incremental_index", "WITH a AS (SELECT doc_id, md5(text) AS h, CAST(ceil(n_chars / 500.0) AS BIGINT) AS chunks FROM documents WHERE doc_id % 6 <> 0), b AS (SELECT doc_id, CASE WHEN doc_id % 10 = 1 THEN 'old' ELSE md5(text) END AS h, CAST(ceil(n_chars / 500.0) AS BIGINT) AS chunks FROM documents WHERE doc_id % 8 <> 0), x AS (SELECT CASE WHEN b.h IS NULL THEN 'new' WHEN a.h IS NULL THEN 'deleted' WHEN a.h <> b.h THEN 'modified' ELSE 'unchanged' END AS state, b.chunks AS old FROM a FULL JOIN b ON a.doc_id = b.doc_id) SELECT state, count(*) AS files, CAST(sum(CASE WHEN state IN ('deleted', 'modified') THEN old ELSE 0 END) AS BIGINT) AS chunks_to_delete FROM x GROUP BY state")
def d10(spark, d):
    """What an incremental run indexes, and the chunks it drops first."""
    x = p.read(spark, d, "documents").select("doc_id", F.md5("text").alias("h"), F.ceil(F.col("n_chars") / 500.0).alias("chunks"))
    a = x.where("doc_id % 6 <> 0").select("doc_id", "h")
    b = x.where("doc_id % 8 <> 0").select("doc_id", F.when(F.col("doc_id") % 10 == 1, "old").otherwise(F.col("h")).alias("was"), "chunks")
    state = F.when(F.col("was").isNull(), "new").when(F.col("h").isNull(), "deleted").when(F.col("h") != F.col("was"), "modified").otherwise("unchanged")
    y = a.join(b, "doc_id", "full_outer").withColumn("state", state)
    return y.groupBy("state").agg(F.count("*").alias("files"), F.sum(F.when(F.col("state").isin("deleted", "modified"), F.col("chunks")).otherwise(0)).alias("chunks_to_delete"))


@query("r06_update_confidence", "SELECT page_id, c AS confidence, CASE WHEN c >= 95 THEN 'auto' WHEN c >= 70 THEN 'suggest' ELSE 'manual' END AS level FROM (SELECT page_id, CAST(CASE page_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 100 WHEN 2 THEN least(100, 60 + page_id % 40 + 5) ELSE 60 + page_id % 40 END AS INT) AS c FROM pages)")
def r06(spark, d):
    """Confidence of a path update: unmapped, identical, explicit or by pattern."""
    i = F.col("page_id")
    c = F.when(i % 4 == 0, 0).when(i % 4 == 1, 100).when(i % 4 == 2, F.least(F.lit(100), 65 + i % 40)).otherwise(60 + i % 40).cast("int")
    x = p.read(spark, d, "pages").select("page_id", c.alias("confidence"))
    return x.withColumn("level", F.when(F.col("confidence") >= 95, "auto").when(F.col("confidence") >= 70, "suggest").otherwise("manual"))


_DEPS = """d AS (SELECT l_orderkey AS k, count(*) AS total, count(*) FILTER (l_linenumber = 1) AS critical, count(*) FILTER (l_linenumber = 2) AS high,
  count(*) FILTER (l_linenumber <= 3) AS vulns, count(*) FILTER (l_returnflag = 'R') AS outdated, count(*) FILTER (l_returnflag = 'A') AS unused, count(*) FILTER (l_quantity > 45) AS peers,
  count(*) FILTER (l_quantity < 3) AS licences, CAST(floor(sum(CASE l_linenumber WHEN 2 THEN 25 WHEN 3 THEN 60 WHEN 4 THEN 100 ELSE 50 END) / count(*) + 0.5) AS DOUBLE) AS health FROM lineitem GROUP BY 1)"""


@query(
    "a35_health_scores",
    f"""
WITH {_DEPS}, s AS (SELECT k, health, CAST(greatest(0, least(100, 100 - 40 * critical - 20 * high - 10 * (vulns - critical - high) - least(20, 2 * outdated) - least(10, 2 * unused))) AS BIGINT) AS security,
  CAST(floor(greatest(0, least(100, 100 - (30.0 * outdated + 20.0 * unused + 15.0 * peers + 10.0 * licences) / total)) + 0.5) AS DOUBLE) AS maintenance FROM d)
SELECT k, health, security, maintenance, CASE WHEN (security + maintenance + health) / 3 >= 90 THEN 'excellent' WHEN (security + maintenance + health) / 3 >= 75 THEN 'good'
  WHEN (security + maintenance + health) / 3 >= 50 THEN 'fair' WHEN (security + maintenance + health) / 3 >= 25 THEN 'poor' ELSE 'critical' END AS overall FROM s""",
)
def a35(spark, d):
    """Orders as manifests and their lines as dependencies: severities by line number, then the three scores and the level."""
    severity = F.element_at(F.array(*[F.lit(x) for x in ("critical", "high", "moderate", "low")]), F.least(F.col("l_linenumber"), F.lit(4)))
    x = p.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.when(F.col("l_linenumber") <= 4, severity).otherwise("none").alias("s"), "l_linenumber", "l_returnflag", "l_quantity")
    n = lambda c, name: F.count_if(c).alias(name)
    x = x.groupBy("k").agg(F.count("*").alias("total"), n(F.col("s") == "critical", "critical"), n(F.col("s") == "high", "high"), n(F.col("l_linenumber") <= 3, "vulns"), n(F.col("l_returnflag") == "R", "outdated"), n(F.col("l_returnflag") == "A", "unused"), n(F.col("l_quantity") > 45, "peers"), n(F.col("l_quantity") < 3, "licences"), F.collect_list("s").alias("severities"))
    c = F.col
    x = x.select("k", classify.health_score(c("severities")).alias("health"), classify.security_score(c("critical"), c("high"), c("vulns"), c("outdated"), c("unused")).alias("security"), classify.maintenance_score(c("total"), c("outdated"), c("unused"), c("peers"), c("licences")).alias("maintenance"))
    return x.withColumn("overall", classify.overall_health(c("security"), c("maintenance"), c("health")))


@query("a33_chunk_statistics", "SELECT label, count(*) AS chunks, CAST(min(len(embedding)) AS BIGINT) AS least, CAST(max(len(embedding)) AS BIGINT) AS most, round(avg(vec_id), 4) AS mean FROM embeddings GROUP BY label")
def a33(spark, d):
    e = p.read(spark, d, "embeddings").select("label", F.size("embedding").cast("long").alias("n"), "vec_id")
    return e.groupBy("label").agg(F.count("*").alias("chunks"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("vec_id"), 4).alias("mean"))


@query("j17_governing_docs", f"WITH {N}, {E} SELECT tgt AS element, src AS doc, k FROM (SELECT tgt, src, row_number() OVER (PARTITION BY tgt ORDER BY CASE n.layer WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, src) AS k FROM (SELECT DISTINCT src, tgt FROM edges WHERE status = 'resolved' AND rel = 'call' AND tgt LIKE '@P/1%') e JOIN nodes n ON n.id = src) WHERE k <= 3")
def j17(spark, d):
    """The three best documents of an element: by status, then id."""
    e = graph.resolved(p.edges(spark, d)).where(F.col("tgt").startswith("@P/1") & (F.col("rel") == "call")).select("src", "tgt").distinct()
    x = e.join(p.nodes(spark, d).select(F.col("id").alias("src"), "layer"), "src")
    rank = F.when(F.col("layer") == "1-URGENT", 0).when(F.col("layer") == "2-HIGH", 1).otherwise(2)
    k = F.row_number().over(Window.partitionBy("tgt").orderBy(rank, "src"))
    return x.select(F.col("tgt").alias("element"), F.col("src").alias("doc"), k.cast("long").alias("k")).where("k <= 3")


@query("x05_session_expiry", "SELECT user_id, count(*) AS sessions, count(*) FILTER (n > 1) AS active FROM (SELECT user_id, k, count(*) AS n FROM (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 1 DAY THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY 1, 2) GROUP BY user_id")
def x05(spark, d):
    """Sessions that expire after an idle day."""
    s = p.read(spark, d, "events").groupBy("user_id", F.session_window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.count_if(F.col("n") > 1).alias("active"))
