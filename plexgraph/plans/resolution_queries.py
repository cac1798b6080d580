"""Import and call resolution, route matching, hierarchy, clones and graph analytics on facts derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import classify
from ..functions.text import half_up
from ..operators import analytics, clones, graph, signatures
from ..sources import projections as p

@query("g11_type_hierarchy", "WITH RECURSIVE s AS (SELECT p_partkey AS sub, p_partkey // 4 AS sup FROM part WHERE p_partkey > 3), r(id, depth) AS (SELECT CAST(5 AS BIGINT), 0 UNION SELECT sub, depth + 1 FROM r JOIN s ON sup = id WHERE depth < 10) SELECT id, CAST(min(depth) AS INT) AS depth FROM r GROUP BY id HAVING min(depth) > 0")
def g11(spark, d):
    """All subtypes at first depth."""
    s = p.read(spark, d, "part").where("p_partkey > 3").select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 4).alias("tgt"))
    return graph.reach(s, spark.createDataFrame([(5,)], "id long"), 10)


@query("j10_route_match", r"WITH s AS (SELECT DISTINCT 'https' AS proto, regexp_replace(split_part(split_part(url, '://', 2), '?', 1), '^[^/]*', '') AS path FROM pages WHERE page_id % 5 = 0), t AS (SELECT DISTINCT regexp_replace(regexp_replace(path, '[#].*$', ''), '[0-9]+', '{}') AS route FROM s), c AS (SELECT page_id, regexp_replace(regexp_replace(split_part(split_part(url, '://', 2), '?', 1), '^[^/]*', ''), '[#].*$', '') AS path FROM pages WHERE page_id % 5 <> 0), m AS (SELECT page_id, CASE WHEN path = route THEN 100 WHEN len(string_split(path, '/')) = len(string_split(route, '/')) AND len(list_filter(list_zip(string_split(path, '/'), string_split(route, '/')), lambda z: z[1] <> z[2] AND z[2] NOT LIKE '%{}%')) = 0 THEN 95 ELSE 0 END AS confidence, route FROM c, t) SELECT page_id, CAST(max(confidence) AS INT) AS confidence FROM m GROUP BY page_id")
def j10(spark, d):
    """Best match of client paths and routes: equal 100, equal but for parameters 95, else 0.

    A route's shape (parameters blanked) is the join key: the client's path is blanked in every set of places that routes of its
    length have parameters in.
    """
    url = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("?"), F.lit(1))
    path = F.regexp_replace(F.regexp_replace(url, "^[^/]*", ""), "#.*$", "")
    x = p.read(spark, d, "pages").select("page_id", path.alias("path"))
    routes = x.where("page_id % 5 = 0").select(F.regexp_replace("path", "[0-9]+", "{}").alias("route")).distinct()
    parts = lambda c: F.split(c, "/")
    free = F.filter(F.transform(parts("route"), lambda s, i: F.when(s.contains("{}"), i).otherwise(-1)), lambda i: i >= 0)
    blanked = lambda c: F.array_join(F.transform(parts(c), lambda s, i: F.when(F.array_contains("free", i), "*").otherwise(s)), "/")
    shapes = routes.select("route", F.size(parts("route")).alias("size"), free.alias("free")).select("size", "free", blanked("route").alias("shape")).distinct()
    calls = x.where("page_id % 5 <> 0")
    able = calls.select("page_id", "path", F.size(parts("path")).alias("size")).join(shapes.select("size", "free").distinct(), "size")
    dynamic = able.select("page_id", "size", "free", blanked("path").alias("shape")).join(shapes, ["size", "free", "shape"], "left_semi").select("page_id", F.lit(95).alias("dynamic")).distinct()
    exact = calls.join(routes.select(F.col("route").alias("path"), F.lit(100).alias("exact")), "path", "left")
    return exact.join(dynamic, "page_id", "left").select("page_id", F.coalesce("exact", "dynamic", F.lit(0)).alias("confidence"))


_BAGS = "e AS (SELECT doc_id AS id, lang AS bucket, unnest(string_split(text, ' ')) AS t, unnest(range(len(string_split(text, ' ')))) AS i FROM documents), k AS (SELECT id, bucket, t || '#' || row_number() OVER (PARTITION BY id, t ORDER BY i) AS t FROM e), n AS (SELECT id, count(*) AS n FROM k GROUP BY 1), o AS (SELECT a.id AS a, b.id AS b, count(*) AS o FROM k a JOIN k b ON a.bucket = b.bucket AND a.t = b.t AND a.id < b.id GROUP BY 1, 2)"


@query("a17_near_miss_clones", f"WITH {_BAGS} SELECT a, b, round(2.0 * o / (x.n + y.n), 6) AS similarity FROM o JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE round(2.0 * o / (x.n + y.n), 6) >= 0.9 AND round(2.0 * o / (x.n + y.n), 6) < 1")
def a17(spark, d):
    e = p.read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("bucket"), F.split("text", " ").alias("tokens"))
    return clones.near_misses(e, 0.9)


@query("a07_layer_drift", "WITH v AS (SELECT c_nationkey AS community, c_mktsegment AS layer, count(*) AS n FROM customer GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY n DESC, layer) AS k, sum(n) OVER (PARTITION BY community) AS voted FROM v) SELECT community, layer AS dominant, floor(n * 1000.0 / voted + 0.5) / 1000 AS purity, CAST(voted - n AS BIGINT) AS outliers FROM t WHERE k = 1 AND voted >= 2")
def a07(spark, d):
    """A community's dominant layer, its purity and outliers."""
    v = p.read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("community"), F.col("c_mktsegment").alias("layer")).agg(F.count("*").alias("n"))
    x = v.groupBy("community").agg(F.min(F.struct((-F.col("n")).alias("m"), "layer")).alias("b"), F.sum("n").alias("voted")).where("voted >= 2")
    n = -F.col("b.m")
    return x.select("community", F.col("b.layer").alias("dominant"), half_up(n * 1.0 / F.col("voted"), 3).alias("purity"), (F.col("voted") - n).alias("outliers"))


@query("a22_edge_evidence", "SELECT l_suppkey AS supplier, CASE l_returnflag WHEN 'N' THEN 'proven' WHEN 'R' THEN 'ambiguous' ELSE 'unresolved' END AS provenance, count(*) AS n, array_to_string(list_sort(list_distinct(list(l_orderkey)))[1:5], ',') AS samples FROM lineitem GROUP BY 1, 2")
def a22(spark, d):
    """Counts and the first samples of each kind of evidence; samples are ranked, never collected whole."""
    flag = F.when(F.col("l_returnflag") == "N", "proven").when(F.col("l_returnflag") == "R", "ambiguous").otherwise("unresolved")
    x = p.read(spark, d, "lineitem").select(F.col("l_suppkey").alias("supplier"), flag.alias("provenance"), "l_orderkey")
    y = x.groupBy("supplier", "provenance", "l_orderkey").agg(F.count("*").alias("c"))
    y = y.withColumn("k", F.row_number().over(Window.partitionBy("supplier", "provenance").orderBy("l_orderkey")))
    few = F.array_sort(F.collect_list(F.when(F.col("k") <= 5, F.col("l_orderkey"))))
    return y.groupBy("supplier", "provenance").agg(F.sum("c").cast("long").alias("n"), F.array_join(F.transform(few, lambda v: v.cast("string")), ",").alias("samples"))


@query("a18_naming_coverage", "WITH s AS (SELECT DISTINCT 'f' || (event_id % 23) AS stem FROM events), t AS (SELECT DISTINCT source FROM documents) SELECT count(*) AS files, count(*) FILTER (EXISTS (SELECT 1 FROM t WHERE replace(source, 'src', 'f') = stem)) AS tested, floor(count(*) FILTER (EXISTS (SELECT 1 FROM t WHERE replace(source, 'src', 'f') = stem)) * 100.0 / count(*) + 0.5) AS percent FROM s")
def a18(spark, d):
    s = p.read(spark, d, "events").select(F.concat(F.lit("f"), (F.col("event_id") % 23).cast("string")).alias("stem")).distinct()
    t = p.read(spark, d, "documents").select(F.replace("source", F.lit("src"), F.lit("f")).alias("stem"), F.lit(1).alias("has")).distinct()
    x = s.join(t, "stem", "left").agg(F.count("*").alias("files"), F.count("has").alias("tested"))
    return x.withColumn("percent", F.floor(F.col("tested") * 100.0 / F.col("files") + 0.5).cast("double"))


@query("a24_doc_coverage", "SELECT quality AS status, count(*) AS docs, count(*) FILTER (toxic = 0) AS clean FROM documents JOIN labels USING (doc_id) GROUP BY 1 UNION ALL SELECT -1, count(*), 0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def a24(spark, d):
    """Documents by status; -1: none."""
    x = p.read(spark, d, "documents").select("doc_id").join(p.read(spark, d, "labels"), "doc_id", "left")
    return x.groupBy(F.coalesce("quality", F.lit(-1)).alias("status")).agg(F.count("*").alias("docs"), F.count_if(F.col("toxic") == 0).alias("clean"))


@query(
    "d05_signature_changes",
    """
WITH x AS (SELECT p_partkey AS k, p_partkey % 4 AS n, p_partkey % 5 AS m, p_size % 3 AS f FROM part)
SELECT k, CASE WHEN m > n AND f <> 2 THEN 'added' WHEN m < n THEN 'removed' WHEN n > 0 AND f = 1 THEN 'reordered' WHEN n > 0 AND k % 7 = 0 THEN 'type-changed' END AS parameters,
  CASE WHEN (m > n AND f <> 2) OR m < n OR (n > 0 AND (f = 1 OR k % 7 = 0)) THEN 'signature' WHEN k % 11 = 0 THEN 'return' WHEN k % 3 = 0 THEN 'visibility' END AS change FROM x""",
)
def d05(spark, d):
    """The first difference of two signatures: parameters, then return type, then visibility.

    Before: k % 4 parameters; after: k % 5, new ones optional for f = 2, names changed for f = 1, types for every seventh.
    """
    k, f = F.col("p_partkey"), F.col("p_size") % 3
    one = lambda i, name, kind, opt: F.struct(F.concat(F.lit(name), i.cast("string")).alias("name"), kind.alias("type"), opt.alias("optional"))
    many = lambda n, make: F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), make)
    none = F.array().cast(signatures.PARAMETERS)
    before = F.when(k % 4 == 0, none).otherwise(many(k % 4, lambda i: one(i, "p", F.lit("int"), F.lit(False))))
    name = lambda i: F.concat(F.when(f == 1, "q").otherwise("p"), i.cast("string"))
    after = F.when(k % 5 == 0, none).otherwise(many(k % 5, lambda i: F.struct(name(i).alias("name"), F.when(k % 7 == 0, "text").otherwise("int").alias("type"), (f == 2).alias("optional"))))
    side = lambda p_, r, e: F.struct(p_.alias("parameters"), r.alias("returns"), e.alias("exported"))
    b = side(before, F.lit(None).cast("string"), F.lit(True))
    a = side(after, F.when(k % 11 == 0, "text").otherwise("void"), k % 3 != 0)
    x = p.read(spark, d, "part").select(k.alias("k"), b.alias("b"), a.alias("a"))
    return x.select("k", signatures.parameter_change(F.col("b.parameters"), F.col("a.parameters")).alias("parameters"), signatures.signature_change(F.col("b"), F.col("a")).alias("change"))


@query("d07_route_impact", "SELECT page_id, greatest(0, least(100, 50 + CASE page_id % 4 WHEN 0 THEN 0 ELSE 20 END + CASE WHEN len(string_split(url, '/')) <= 5 THEN 15 WHEN len(string_split(url, '/')) >= 7 THEN -10 ELSE 0 END + 3 * (page_id % 5))) AS impact FROM pages")
def d07(spark, d):
    """Impact of a changed route: method, depth and number of methods."""
    depth, i = F.size(F.split("url", "/")), F.col("page_id")
    score = 50 + F.when(i % 4 == 0, 0).otherwise(20) + F.when(depth <= 5, 15).when(depth >= 7, -10).otherwise(0) + 3 * (i % 5)
    return p.read(spark, d, "pages").select("page_id", F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("long").alias("impact"))


@query("t13_answer_confidence", "WITH x AS (SELECT conv_id, avg(turn % 5 / 5.0) AS retrieval, least(1.0, count(*) / 5.0) AS diversity, least(1.0, avg(length(text)) / 400.0) AS completeness FROM conversations GROUP BY 1), y AS (SELECT conv_id, round(0.3 * retrieval + 0.2 * diversity + 0.2 * completeness + 0.15 * 0.7 + 0.15 * 0.5, 6) AS score FROM x) SELECT conv_id, score, CASE WHEN score >= 0.8 THEN 'very-high' WHEN score >= 0.6 THEN 'high' WHEN score >= 0.4 THEN 'medium' WHEN score >= 0.2 THEN 'low' ELSE 'very-low' END AS level FROM y")
def t13(spark, d):
    """Weighted confidence of an answer and its level."""
    x = p.read(spark, d, "conversations").groupBy("conv_id").agg(F.avg(F.col("turn") % 5 / 5.0).alias("r"), F.count("*").alias("n"), F.avg(F.char_length("text")).alias("c"))
    s = F.round(0.3 * F.col("r") + 0.2 * F.least(F.lit(1.0), F.col("n") / 5.0) + 0.2 * F.least(F.lit(1.0), F.col("c") / 400.0) + 0.15 * 0.7 + 0.15 * 0.5, 6)
    level = F.when(F.col("score") >= 0.8, "very-high").when(F.col("score") >= 0.6, "high").when(F.col("score") >= 0.4, "medium").when(F.col("score") >= 0.2, "low").otherwise("very-low")
    return x.select("conv_id", s.alias("score")).withColumn("level", level)


_PATHS = """f AS (SELECT CASE o_orderkey % 6 WHEN 0 THEN 'Tests/' WHEN 1 THEN 'tests/' ELSE 'src' || (o_orderkey % 17) || '/' END || CASE o_orderkey % 5 WHEN 0 THEN '__tests__/' WHEN 1 THEN 'cli/' WHEN 2 THEN 'examples/' ELSE '' END
  || CASE o_orderkey % 11 WHEN 0 THEN 'test_m' WHEN 1 THEN 'index' WHEN 2 THEN 'demo-m' ELSE 'm' END || CASE o_orderkey % 7 WHEN 0 THEN '.test.ts' WHEN 1 THEN '.spec.ts' WHEN 2 THEN '_test.py' WHEN 3 THEN '.py' ELSE '.ts' END AS file FROM orders)"""


def _paths(spark, d):
    k = F.col("o_orderkey")
    pick = lambda n, *of: F.element_at(F.array(*[x if not isinstance(x, str) else F.lit(x) for x in of]), (F.least(k % n, F.lit(len(of) - 1)) + 1).cast("int"))
    folder = pick(6, "Tests/", "tests/", F.concat(F.lit("src"), (k % 17).cast("string"), F.lit("/")))
    return p.read(spark, d, "orders").select(F.concat(folder, pick(5, "__tests__/", "cli/", "examples/", ""), pick(11, "test_m", "index", "demo-m", "m"), pick(7, ".test.ts", ".spec.ts", "_test.py", ".py", ".ts")).alias("file"))


@query(
    "p05_test_files",
    rf"""
WITH {_PATHS}, x AS (SELECT file, lower(file) AS l, regexp_extract(file, '[^/]*$') AS n FROM f)
SELECT count(*) FILTER (regexp_matches(l, '(^|/)(__tests__|__mocks__|tests?)/') OR regexp_matches(l, '\.(test|spec)\.[^/]*$')) AS segments, count(*) FILTER (regexp_matches(file, '__tests__|\.test\.|\.spec\.')) AS infix,
  count(*) FILTER (regexp_matches(file, '__tests__|\.test\.|\.spec\.') OR n LIKE 'test\_%' ESCAPE '\' OR n LIKE '%\_test.py' ESCAPE '\' OR (file LIKE '%/tests/%' AND n LIKE '%.py')) AS coverage,
  count(*) FILTER (regexp_matches(file, '__tests__|\.test\.|\.spec\.|/tests/|^tests/|/test_|^test_|_test\.py$')) AS gaps FROM x""",
)
def p05(spark, d):
    """The four test-file heuristics over the same paths."""
    n = lambda f, name: F.count_if(f(F.col("file"))).alias(name)
    return _paths(spark, d).agg(n(classify.is_test_like, "segments"), n(classify.is_test_file, "infix"), n(classify.is_coverage_test, "coverage"), n(classify.is_gap_test, "gaps"))


@query(
    "p06_entry_points",
    rf"""
WITH {_PATHS}, x AS (SELECT lower(file) AS l, file FROM f) SELECT count(*) FILTER (regexp_matches(l, '(^|/)(__tests__|__mocks__|tests?)/') OR regexp_matches(l, '\.(test|spec)\.[^/]*$')
  OR regexp_matches(l, '(^|/)(index|main|app|server|cli|bin)\.[^./]+$') OR regexp_matches(l, '(^|/)(bin|cli|scripts)/')) AS entries, count(*) FILTER (regexp_matches(file, '(^|/)examples/|(^|/)demo-[^/]*\.(ts|tsx|js|jsx|mjs|cjs)$')) AS demos FROM x""",
)
def p06(spark, d):
    """Entry points (tests are excused like them) and demo files."""
    return _paths(spark, d).agg(F.count_if(classify.is_entrypoint(F.col("file"))).alias("entries"), F.count_if(classify.is_demo_file(F.col("file"))).alias("demos"))


@query("r07_parameter_map", "WITH m(name, type) AS (VALUES ('click','int'), ('view','string'), ('purchase','decimal')) SELECT event_type, coalesce(type, 'unknown') AS type, count(*) AS n FROM events LEFT JOIN m ON name = event_type GROUP BY 1, 2")
def r07(spark, d):
    """Parameter names to types by a small dictionary."""
    types = F.create_map(*[F.lit(x) for x in ("click", "int", "view", "string", "purchase", "decimal")])
    return p.read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).withColumn("type", F.coalesce(F.try_element_at(types, "event_type"), F.lit("unknown")))


@query("j13_resolution_delta", "SELECT count(*) AS occurrences, count(*) FILTER (hit IS NULL) AS missing FROM (SELECT l_orderkey, l_linenumber, min(CASE WHEN l_returnflag = 'N' THEN 1 END) AS hit FROM lineitem GROUP BY 1, 2)")
def j13(spark, d):
    """Occurrences without a resolved edge at their place."""
    x = p.read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max((F.col("l_returnflag") == "N").cast("int")).alias("hit"))
    return x.agg(F.count("*").alias("occurrences"), F.count_if(F.col("hit") == 0).alias("missing"))


@query("g15_communities")
def g15(spark, d):
    """Label propagation over who acts after whom."""
    return analytics.communities(p.steps(spark, d))


@query("g16_betweenness")
def g16(spark, d):
    return analytics.betweenness(p.steps(spark, d))


_LINKS = "t AS (SELECT src AS a, tgt AS b FROM edges WHERE rel = 'import' UNION SELECT tgt, src FROM edges WHERE rel = 'import')"


@query("g17_articulation_points", f"WITH {p.SQL_EDGES}, {_LINKS} SELECT a AS id FROM t GROUP BY a HAVING count(DISTINCT b) > 1")
def g17(spark, d):
    """Elements whose loss splits the graph of foreign keys, which is a tree, so that SQL can say which they are."""
    return analytics.articulation_points(p.edges(spark, d).where("rel = 'import'"))
