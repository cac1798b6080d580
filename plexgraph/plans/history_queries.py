"""Change history, snapshots, sessions and aggregates over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import clones, interval
from ..sources import projections as p

C, EL = p.SQL_COMMITS, p.SQL_ELEMENTS
CAP = 40


@query("a11_churn", f"WITH {C} SELECT file, count(DISTINCT hash) AS commits, CAST(sum(added) AS BIGINT) AS added, CAST(sum(deleted) AS BIGINT) AS deleted FROM commits GROUP BY file")
def a11(spark, d):
    return p.commits(spark, d).groupBy("file").agg(F.count_distinct("hash").alias("commits"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))


_PAIRS = f"f AS (SELECT DISTINCT hash, file FROM commits), s AS (SELECT hash, file, count(*) OVER (PARTITION BY hash) AS n FROM f), q AS (SELECT a.file AS a, b.file AS b, count(*) AS together FROM s a JOIN s b ON a.hash = b.hash AND a.file < b.file WHERE a.n <= {CAP} AND b.n <= {CAP} GROUP BY 1, 2)"


def co_changes(commits, cap: int = CAP):
    """Pairs of files by commits that hold both; commits of more than ``cap`` files are skipped, as the feature asks.

    A commit's files are counted before any are gathered, so each commit's pairs come from its own sorted array of at most
    ``cap`` without a self join.
    """
    one = commits.select("hash", "file").distinct()
    few = one.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n").between(2, cap)).select("hash")
    files = one.join(few, "hash", "left_semi").groupBy("hash").agg(F.array_sort(F.collect_list("file")).alias("f"))  # at most ``cap`` files
    pairs = F.flatten(F.transform("f", lambda a, i: F.transform(F.slice("f", i + 2, F.lit(cap)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return files.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("together"))


@query("a12_co_change", f"WITH {C}, {_PAIRS} SELECT * FROM q WHERE together >= 2")
def a12(spark, d):
    return co_changes(p.commits(spark, d)).where("together >= 2")


@query("a13_ownership", f"WITH {C}, w AS (SELECT file, author, count(DISTINCT hash) AS n, max(epoch) AS last FROM commits GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY n DESC, author) AS k, sum(n) OVER (PARTITION BY file) AS total, count(*) OVER (PARTITION BY file) AS authors, max(last) OVER (PARTITION BY file) AS touched FROM w) SELECT file, authors, author AS owner, floor(n * 1000.0 / total + 0.5) / 1000 AS share, CAST(floor((1709251200 - touched) / 86400) AS BIGINT) AS age_days FROM t WHERE k = 1")
def a13(spark, d):
    """Owner of a file: most commits, then name."""
    w = p.commits(spark, d).groupBy("file", "author").agg(F.count_distinct("hash").alias("n"), F.max("epoch").alias("last"))
    x = w.groupBy("file").agg(F.count("*").alias("authors"), F.min(F.struct(-F.col("n"), F.col("author"))).alias("best"), F.sum("n").alias("total"), F.max("last").alias("touched"))
    return x.select("file", "authors", F.col("best.author").alias("owner"), (F.floor(-F.col("best.col1") * 1000.0 / F.col("total") + 0.5) / 1000).alias("share"), F.floor((F.lit(1709251200) - F.col("touched")) / 86400).alias("age_days"))


@query("a14_coupling_drift", f"WITH {C}, {_PAIRS} SELECT * FROM q WHERE together >= 3 AND split_part(a, '/', 1) <> split_part(b, '/', 1)")
def a14(spark, d):
    """Files that change together without a static edge (another directory)."""
    x = co_changes(p.commits(spark, d)).where("together >= 3")
    known = x.where(F.substring_index("a", "/", 1) == F.substring_index("b", "/", 1)).select("a", "b")
    return x.join(known, ["a", "b"], "left_anti")


@query("a15_clone_groups", "SELECT CASE p_partkey % 2 WHEN 0 THEN 'function' ELSE 'method' END AS kind, 'f' || p_partkey % 97 AS name, CAST(p_size % 3 AS INT) AS arity, count(*) AS members, min(p_partkey) AS first FROM part GROUP BY p_partkey % 2, p_partkey % 97, p_size % 3, p_partkey % 5 HAVING count(*) >= 2")
def a15(spark, d):
    """Structural clones: same kind, name, parameters and imports."""
    k = F.col("p_partkey")
    s = lambda c: c.cast("string")
    e = p.read(spark, d, "part").select(k.alias("id"), F.when(k % 2 == 0, "function").otherwise("method").alias("kind"), F.concat(F.lit("f"), s(k % 97)).alias("name"), F.slice(F.array(F.lit("a"), F.lit("b")), 1, F.col("p_size") % 3).alias("parameters"), F.array(F.concat(F.lit("m"), s(k % 5)), F.lit("x")).alias("imports"))
    return clones.structural_groups(e).select("kind", "name", "arity", "members", "first")


_BODY = "regexp_replace(trim(body), '[ \\t\\n\\r]+', ' ', 'g')"


@query("a16_lexical_clones", f"WITH {EL} SELECT substr(sha256({_BODY}), 1, 32) AS hash, count(*) AS members, min(doc_id) AS first_doc FROM elements WHERE length({_BODY}) >= 40 GROUP BY 1 HAVING count(*) >= 2")
def a16(spark, d):
    """Lexical clones: same normalised body."""
    body = F.regexp_replace(F.trim("body"), r"[ \t\n\r]+", " ")
    return p.elements(spark, d).where(F.char_length(body) >= 40).groupBy(F.substring(F.sha2(body, 256), 1, 32).alias("hash")).agg(F.count("*").alias("members"), F.min("doc_id").alias("first_doc")).where("members >= 2")


@query("a26_complexity_stats", f"WITH {EL} SELECT kind, CAST(min(loc) AS BIGINT) AS least, CAST(max(loc) AS BIGINT) AS most, round(avg(loc), 6) AS mean, CAST(median(loc) AS DOUBLE) AS median, count(*) FILTER (loc > 20) AS high FROM elements GROUP BY kind")
def a26(spark, d):
    return p.elements(spark, d).groupBy("kind").agg(F.min("loc").alias("least"), F.max("loc").alias("most"), F.round(F.avg("loc"), 6).alias("mean"), F.median("loc").alias("median"), F.count_if(F.col("loc") > 20).alias("high"))


@query("r11_complexity_score", f"WITH {EL} SELECT doc_id, floor(10 * (0.3 * least(1.0, loc / 200.0) + 0.4 * least(1.0, (loc % 23) / 15.0) + 0.2 * least(1.0, (doc_id % 12) / 10.0)) + 0.5) AS score FROM elements")
def r11(spark, d):
    """Weighted and capped lines, branches and parameters."""
    part = lambda w, x, cap: w * F.least(F.lit(1.0), x / cap)
    score = F.floor(10 * (part(0.3, F.col("loc"), 200.0) + part(0.4, F.col("loc") % 23, 15.0) + part(0.2, F.col("doc_id") % 12, 10.0)) + 0.5)
    return p.elements(spark, d).select("doc_id", score.cast("double").alias("score"))


@query("a28_index_stats", f"WITH {EL} SELECT kind, file, count(*) AS n FROM elements GROUP BY GROUPING SETS ((kind), (file), (kind, file))")
def a28(spark, d):
    """Counts by kind, by file and by both."""
    e = p.elements(spark, d)
    return e.groupingSets([["kind"], ["file"], ["kind", "file"]], "kind", "file").agg(F.count("*").alias("n"))


@query("a31_search_statistics", "WITH t AS (SELECT o_orderpriority AS tag, count(*) AS n FROM orders GROUP BY 1) SELECT tag, n, round(n * 1.0 / (SELECT max(n) FROM t), 6) AS weight FROM t ORDER BY n DESC, tag LIMIT 20")
def a31(spark, d):
    t = p.read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("tag")).agg(F.count("*").alias("n"))
    top = t.agg(F.max("n").alias("m"))
    return t.join(F.broadcast(top)).select("tag", "n", F.round(F.col("n") / F.col("m"), 6).alias("weight")).orderBy(F.desc("n"), "tag").limit(20)  # one row


@query("a32_session_stats", "SELECT conv_id, count(*) AS messages, count(*) FILTER (role = 'user' AND text LIKE '%?%') AS questions, CAST(sum(ceil(length(text) / 4.0)) AS BIGINT) AS tokens, count(*) FILTER (role = 'assistant') AS answers FROM conversations GROUP BY conv_id")
def a32(spark, d):
    c = p.read(spark, d, "conversations")
    return c.groupBy("conv_id").agg(F.count("*").alias("messages"), F.count_if((F.col("role") == "user") & F.col("text").contains("?")).alias("questions"), F.sum(F.ceil(F.char_length("text") / 4.0)).alias("tokens"), F.count_if(F.col("role") == "assistant").alias("answers"))


@query("w08_history_trim", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) AS k FROM conversations) WHERE k <= 4")
def w08(spark, d):
    """The last four turns of each session."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"), "role", "text")
    return p.read(spark, d, "conversations").withColumn("k", F.row_number().over(w)).where("k <= 4").select("conv_id", "turn", "role")


@query("w06_token_budget", "WITH x AS (SELECT conv_id, turn, role, text, sum(CAST(ceil(length(text) / 4.0) AS BIGINT)) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS spent FROM conversations) SELECT conv_id, turn, CAST(spent AS BIGINT) AS spent FROM x WHERE spent <= 120")
def w06(spark, d):
    """Messages until a session's token budget is spent."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    return p.read(spark, d, "conversations").withColumn("spent", F.sum(F.ceil(F.char_length("text") / 4.0)).over(w)).where("spent <= 120").select("conv_id", "turn", "spent")


@query("w03_argmax_layer", "SELECT n_nationkey, seg AS layer, n FROM (SELECT c_nationkey AS n_nationkey, c_mktsegment AS seg, count(*) AS n, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_mktsegment) AS k FROM customer GROUP BY 1, 2) WHERE k = 1")
def w03(spark, d):
    c = p.read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("layer")).agg(F.count("*").alias("n"))
    best = c.groupBy("n_nationkey").agg(F.min(F.struct((-F.col("n")).alias("m"), "layer")).alias("b"))
    return best.select("n_nationkey", "b.layer", (-F.col("b.m")).alias("n"))


@query("w04_dedupe", "SELECT l_orderkey, l_linenumber, l_partkey, coalesce(CASE WHEN l_discount > 0.05 THEN l_discount END, fallback) AS discount FROM (SELECT *, row_number() OVER w AS k, first_value(CASE WHEN l_discount > 0.05 THEN l_discount END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fallback FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_linenumber ORDER BY l_quantity DESC, l_partkey, l_suppkey)) WHERE k = 1")
def w04(spark, d):
    """The best row of each key, nulls back-filled from the rows it beats."""
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(F.desc("l_quantity"), "l_partkey", "l_suppkey")
    own = F.when(F.col("l_discount") > 0.05, F.col("l_discount"))
    x = p.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", own.alias("own"), F.row_number().over(w).alias("k"), F.first(own, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("fallback"))
    return x.where("k = 1").select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce("own", "fallback").alias("discount"))


@query(
    "w10_rank_changes",
    """
WITH a AS (SELECT c_nationkey AS query, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r1, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal + (c_custkey % 7) * 100 DESC, c_custkey) AS r2 FROM customer)
SELECT query, count(*) AS n, count(*) FILTER (r1 <> r2) AS moved, count(*) FILTER (abs(r1 - r2) >= 3) AS significant, CAST(max(abs(r1 - r2)) AS BIGINT) AS furthest FROM a GROUP BY 1""",
)
def w10(spark, d):
    """How ranks change under another score, among the hits of each query."""
    one = Window.partitionBy("query")
    hits = p.read(spark, d, "customer").select(F.col("c_nationkey").alias("query"), "c_acctbal", "c_custkey")
    by = F.row_number().over(one.orderBy(F.desc("c_acctbal"), "c_custkey")) - F.row_number().over(one.orderBy((F.col("c_acctbal") + F.col("c_custkey") % 7 * 100).desc(), "c_custkey"))
    x = hits.select("query", by.cast("long").alias("by"))
    return x.groupBy("query").agg(F.count("*").alias("n"), F.count_if(F.col("by") != 0).alias("moved"), F.count_if(F.abs("by") >= 3).alias("significant"), F.max(F.abs("by")).alias("furthest"))


# snapshots: parts before and after
_BEFORE, _AFTER = "SELECT p_partkey AS k, p_size AS arity, p_brand AS kind FROM part WHERE p_partkey % 10 <> 0", "SELECT p_partkey AS k, CASE WHEN p_partkey % 15 = 1 THEN p_size + 1 ELSE p_size END AS arity, p_brand AS kind FROM part WHERE p_partkey % 10 <> 5"


def _snapshots(spark, d):
    x = p.read(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("arity"), F.col("p_brand").alias("kind"))
    return x.where("k % 10 <> 0"), x.where("k % 10 <> 5").withColumn("arity", F.when(F.col("k") % 15 == 1, F.col("arity") + 1).otherwise(F.col("arity")))


@query("d01_api_diff", f"WITH b AS ({_BEFORE}), a AS ({_AFTER}) SELECT coalesce(b.k, a.k) AS k, CASE WHEN b.k IS NULL THEN 'added' WHEN a.k IS NULL THEN 'removed' WHEN a.arity IS DISTINCT FROM b.arity THEN 'changed' ELSE 'unchanged' END AS change FROM b FULL JOIN a ON a.k = b.k")
def d01(spark, d):
    b, a = _snapshots(spark, d)
    x = b.select("k", F.col("arity").alias("was"), F.lit(True).alias("old")).join(a.select("k", F.col("arity").alias("now"), F.lit(True).alias("new")), "k", "full_outer")
    return x.select("k", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("now")), "changed").otherwise("unchanged").alias("change"))


@query("d02_metrics_delta", f"WITH b AS (SELECT kind, count(*) AS n FROM ({_BEFORE}) GROUP BY 1), a AS (SELECT kind, count(*) AS n FROM ({_AFTER}) GROUP BY 1) SELECT coalesce(a.kind, b.kind) AS kind, CAST(coalesce(a.n, 0) - coalesce(b.n, 0) AS BIGINT) AS delta, CASE WHEN coalesce(a.n, 0) < coalesce(b.n, 0) THEN 'improved' WHEN coalesce(a.n, 0) > coalesce(b.n, 0) THEN 'regressed' ELSE 'unchanged' END AS direction FROM a FULL JOIN b ON a.kind = b.kind")
def d02(spark, d):
    b, a = _snapshots(spark, d)
    x = a.select("kind", F.lit(1).alias("v")).unionByName(b.select("kind", F.lit(-1).alias("v"))).groupBy("kind").agg(F.sum("v").alias("delta"))
    return x.withColumn("direction", F.when(F.col("delta") < 0, "improved").when(F.col("delta") > 0, "regressed").otherwise("unchanged"))


@query("d03_drift", f"WITH b AS ({_BEFORE}), a AS ({_AFTER}), x AS (SELECT b.k AS bk, a.k AS ak, b.arity IS DISTINCT FROM a.arity AS differs FROM b FULL JOIN a ON a.k = b.k) SELECT count(*) FILTER (bk IS NULL) AS added, count(*) FILTER (ak IS NULL) AS deleted, count(*) FILTER (bk IS NOT NULL AND ak IS NOT NULL AND differs) AS stale, least(100.0, floor(count(*) FILTER (bk IS NULL OR ak IS NULL OR differs) * 100.0 / count(bk) + 0.5)) AS percent FROM x")
def d03(spark, d):
    """Stale, added and deleted over what there was, in per cent and at most 100."""
    c = d01(spark, d).agg(*[F.count_if(F.col("change") == v).alias(n) for v, n in (("added", "added"), ("removed", "deleted"), ("changed", "stale"))], F.count_if(F.col("change") != "added").alias("n"))
    share = F.floor((F.col("added") + F.col("deleted") + F.col("stale")) * 100.0 / F.col("n") + 0.5)
    return c.select("added", "deleted", "stale", F.least(F.lit(100.0), F.when(F.col("n") > 0, share).otherwise(100)).cast("double").alias("percent"))


@query("d08_staleness", "SELECT CASE WHEN a.doc_id IS NULL THEN 'removed' WHEN b.h IS NULL THEN 'new' WHEN a.h <> b.h THEN 'stale' ELSE 'fresh' END AS state, count(*) AS n FROM (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 9 <> 0) a FULL JOIN (SELECT doc_id, sha256(CASE WHEN doc_id % 8 = 3 THEN text || ' ' ELSE text END) AS h FROM documents WHERE doc_id % 11 <> 0) b ON a.doc_id = b.doc_id GROUP BY 1")
def d08(spark, d):
    """Content hashes of a manifest against those of the files now."""
    t = p.read(spark, d, "documents")
    now = t.where("doc_id % 9 <> 0").select("doc_id", F.sha2("text", 256).alias("h"))
    manifest = t.where("doc_id % 11 <> 0").select(F.col("doc_id").alias("id"), F.sha2(F.when(F.col("doc_id") % 8 == 3, F.concat("text", F.lit(" "))).otherwise(F.col("text")), 256).alias("was"))
    x = now.join(manifest, now.doc_id == manifest.id, "full_outer")
    return x.groupBy(F.when(F.col("doc_id").isNull(), "removed").when(F.col("was").isNull(), "new").when(F.col("h") != F.col("was"), "stale").otherwise("fresh").alias("state")).agg(F.count("*").alias("n"))


@query("d09_cache_check", "WITH a AS (SELECT o_orderkey AS k, o_totalprice AS size FROM orders WHERE o_orderkey % 6 <> 1), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 20 = 4 THEN o_totalprice + 1 ELSE o_totalprice END AS size FROM orders WHERE o_orderkey % 7 <> 2), x AS (SELECT CASE WHEN b.k IS NULL THEN 'new' WHEN a.k IS NULL THEN 'deleted' WHEN a.size <> b.size THEN 'changed' ELSE 'unchanged' END AS s FROM a FULL JOIN b ON a.k = b.k) SELECT s AS state, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS ratio FROM x GROUP BY 1")
def d09(spark, d):
    o = p.read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("size"))
    a = o.where("k % 6 <> 1")
    b = o.where("k % 7 <> 2").select(F.col("k").alias("j"), F.when(F.col("k") % 20 == 4, F.col("size") + 1).otherwise(F.col("size")).alias("was"))
    state = F.when(F.col("j").isNull(), "new").when(F.col("k").isNull(), "deleted").when(F.col("size") != F.col("was"), "changed").otherwise("unchanged")
    n = a.join(b, a.k == b.j, "full_outer").groupBy(state.alias("state")).agg(F.count("*").alias("n"))
    return n.withColumn("ratio", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))  # four rows


@query("d06_severity", "WITH c AS (SELECT l_partkey AS k, count(*) AS sites FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1) SELECT p_partkey, CAST(coalesce(sites, 0) AS BIGINT) AS sites, CASE WHEN p_size > 48 OR coalesce(sites, 0) > 20 THEN 'critical' WHEN coalesce(sites, 0) > 10 THEN 'high' WHEN coalesce(sites, 0) > 5 THEN 'medium' ELSE 'low' END AS severity FROM part LEFT JOIN c ON k = p_partkey")
def d06(spark, d):
    """Severity of a change by its call sites."""
    c = p.read(spark, d, "lineitem").where("l_returnflag = 'N'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("sites"))
    x = p.read(spark, d, "part").select("p_partkey", "p_size").join(c, "p_partkey", "left").na.fill(0, ["sites"])
    return x.select("p_partkey", "sites", F.when((F.col("p_size") > 48) | (F.col("sites") > 20), "critical").when(F.col("sites") > 10, "high").when(F.col("sites") > 5, "medium").otherwise("low").alias("severity"))


# hunks against spans, by day buckets of a bounded width
@query(
    "j06_range_join",
    """
WITH h AS (SELECT o_orderkey AS hunk, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS lo FROM orders),
s AS (SELECT date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS a, count(*) AS n FROM lineitem GROUP BY 1)
SELECT hunk, CAST(sum(n) AS BIGINT) AS touched, CAST(min(a) AS BIGINT) AS earliest FROM h JOIN s ON lo <= a + 4 AND lo + 6 >= a GROUP BY hunk""",
)
def j06(spark, d):
    """Hunks [lo, lo + 6] that overlap spans [a, a + 4], counted.

    Equal intervals are counted first on both sides, so the bucket join has a row for each day and not for each pair.
    """
    day = lambda c: F.date_diff(F.col(c).cast("date"), F.lit("1992-01-01").cast("date"))
    h = p.read(spark, d, "orders").select(F.col("o_orderkey").alias("hunk"), day("o_orderdate").alias("lo"))
    s = p.read(spark, d, "lineitem").groupBy(day("l_shipdate").alias("a")).agg(F.count("*").alias("n"))
    met = interval.overlaps(h.select("lo", (F.col("lo") + 6).alias("hi")).distinct(), s.select(F.col("a").alias("start"), (F.col("a") + 4).alias("end"), "a", "n"), 16)
    met = met.groupBy("lo").agg(F.sum("n").cast("long").alias("touched"), F.min("a").cast("long").alias("earliest"))
    return h.join(met, "lo").select("hunk", "touched", "earliest")


@query("j07_as_of_join", "WITH e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts AS vts, event_id AS vid FROM events WHERE event_type = 'view') SELECT event_id, vid AS last_view FROM (SELECT e.event_id, v.vid, row_number() OVER (PARTITION BY e.event_id ORDER BY vts DESC, vid DESC) AS k FROM e LEFT JOIN v ON v.user_id = e.user_id AND vts <= ts) WHERE k = 1")
def j07(spark, d):
    """Each purchase with its user's latest view: one sort of both kinds and a running last value, no range join."""
    x = p.read(spark, d, "events").where("event_type in ('purchase', 'view')").select("event_id", "user_id", "ts", (F.col("event_type") == "view").alias("view"))
    w = Window.partitionBy("user_id").orderBy("ts", F.desc("view"), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("view"), F.col("event_id")), ignorenulls=True).over(w)
    return x.withColumn("last_view", last).where("not view").select("event_id", "last_view")


@query("s21_nearest_call", "WITH a AS (SELECT event_id, user_id, CAST(event_id // 10 AS BIGINT) AS line FROM events WHERE event_type = 'click'), c AS (SELECT user_id, CAST(event_id // 10 AS BIGINT) AS cline, event_id AS cid FROM events WHERE event_type = 'error') SELECT event_id, cid AS call FROM (SELECT event_id, cid, row_number() OVER (PARTITION BY event_id ORDER BY abs(line - cline), cid) AS k FROM a JOIN c ON a.user_id = c.user_id AND abs(line - cline) <= 10) WHERE k = 1")
def s21(spark, d):
    """The call nearest to an element, at most ten lines away: line buckets bound the join."""
    e = p.read(spark, d, "events")
    line = F.floor(F.col("event_id") / 10)
    a = e.where("event_type = 'click'").select("event_id", "user_id", line.alias("line")).withColumn("b", F.explode(F.sequence(F.floor((F.col("line") - 10) / 21), F.floor((F.col("line") + 10) / 21))))
    c = e.where("event_type = 'error'").select("user_id", line.alias("cline"), F.col("event_id").alias("cid")).withColumn("b", F.floor(F.col("cline") / 21))
    x = a.join(c, ["user_id", "b"]).where(F.abs(F.col("line") - F.col("cline")) <= 10)
    return x.groupBy("event_id").agg(F.min(F.struct(F.abs(F.col("line") - F.col("cline")), F.col("cid"))).alias("m")).select("event_id", F.col("m.cid").alias("call"))


@query("u02_key_union", f"SELECT count(*) AS n FROM (SELECT k FROM ({_BEFORE}) UNION SELECT k FROM ({_AFTER}))")
def u02(spark, d):
    b, a = _snapshots(spark, d)
    return b.select("k").union(a.select("k")).distinct().agg(F.count("*").alias("n"))


@query("u03_intersect", f"SELECT kind, count(*) AS n FROM (SELECT k, kind FROM ({_BEFORE}) INTERSECT SELECT k, kind FROM ({_AFTER})) GROUP BY kind")
def u03(spark, d):
    b, a = _snapshots(spark, d)
    return b.select("k", "kind").intersect(a.select("k", "kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("u04_except", f"SELECT kind, count(*) AS n FROM (SELECT k, kind FROM ({_BEFORE}) EXCEPT SELECT k, kind FROM ({_AFTER})) GROUP BY kind")
def u04(spark, d):
    b, a = _snapshots(spark, d)
    return b.select("k", "kind").join(a.select("k"), "k", "left_anti").groupBy("kind").agg(F.count("*").alias("n"))


@query("u05_merge_facts", f"WITH b AS ({_BEFORE}), o AS (SELECT k, arity, kind FROM ({_AFTER}) WHERE k % 4 = 0) SELECT k, arity, kind FROM b WHERE k % 3 <> 0 AND k NOT IN (SELECT k FROM o) UNION ALL SELECT k, arity, kind FROM o")
def u05(spark, d):
    """Facts kept, less deleted ones, with the rescanned ones over them."""
    b, a = _snapshots(spark, d)
    o = a.where("k % 4 = 0")
    return b.where("k % 3 <> 0").join(o.select("k"), "k", "left_anti").unionByName(o)


@query("k08_registry_sync", f"WITH b AS ({_BEFORE}), a AS ({_AFTER}) SELECT coalesce(a.k, b.k) AS k, coalesce(a.arity, b.arity) AS arity, CASE WHEN b.k IS NULL THEN 'created' WHEN a.k IS NULL THEN 'kept' WHEN a.arity = b.arity THEN 'same' ELSE 'updated' END AS outcome FROM b FULL JOIN a ON a.k = b.k")
def k08(spark, d):
    """Upsert in overwrite mode."""
    b, a = _snapshots(spark, d)
    x = b.select("k", F.col("arity").alias("was")).join(a.select("k", F.col("arity").alias("now")), "k", "full_outer")
    return x.select("k", F.coalesce("now", "was").alias("arity"), F.when(F.col("was").isNull(), "created").when(F.col("now").isNull(), "kept").when(F.col("now") == F.col("was"), "same").otherwise("updated").alias("outcome"))


@query("x01_debounce", "WITH x AS (SELECT user_id, ts, event_type, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM x) SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS started, count(*) AS events, count(DISTINCT event_type) AS files FROM s GROUP BY user_id, k")
def x01(spark, d):
    """Bursts of changes with no gap of six hours, as session windows."""
    x = p.read(spark, d, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("s")).agg(F.count("*").alias("events"), F.count_distinct("event_type").alias("files"))
    return x.select("user_id", F.unix_seconds(F.col("s.start").cast("timestamp")).alias("started"), "events", "files")


@query("a34_retrieval_eval", "WITH q AS (SELECT o_custkey AS q, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r, o_orderstatus = 'F' AS good FROM orders), f AS (SELECT q, min(r) FILTER (good) AS r FROM q GROUP BY 1) SELECT round(avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0 END), 6) AS hit1, round(avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0 END), 6) AS hit5, round(avg(coalesce(1.0 / r, 0)), 6) AS mrr FROM f")
def a34(spark, d):
    """Hit rates and mean reciprocal rank of the first good answer."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    q = p.read(spark, d, "orders").select("o_custkey", F.row_number().over(w).alias("r"), (F.col("o_orderstatus") == "F").alias("good"))
    f = q.groupBy("o_custkey").agg(F.min(F.when(F.col("good"), F.col("r"))).alias("r"))
    hit = lambda k: F.round(F.avg(F.when(F.col("r") <= k, 1.0).otherwise(0.0)), 6)
    return f.agg(hit(1).alias("hit1"), hit(5).alias("hit5"), F.round(F.avg(F.coalesce(1.0 / F.col("r"), F.lit(0.0))), 6).alias("mrr"))


@query("t26_embedding_quality", "SELECT count(*) AS n, count(*) FILTER (len(embedding) <> 64) AS odd_length, count(*) FILTER (len(list_filter(embedding, lambda x: x <> 0)) = 0) AS zero, count(*) FILTER (len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) > 0) AS not_finite FROM embeddings")
def t26(spark, d):
    e, v = p.read(spark, d, "embeddings"), F.col("embedding")
    return e.agg(F.count("*").alias("n"), F.count_if(F.size(v) != 64).alias("odd_length"), F.count_if(F.forall(v, lambda x: x == 0)).alias("zero"), F.count_if(F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))).alias("not_finite"))
