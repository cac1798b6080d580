"""Scanning, tokenizing, retrieval, routes and their checks over documents, pages and embeddings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import classify, tags
from ..functions import text as t
from ..operators import retrieval as r
from ..sources import markdown
from ..sources import projections as p

EL = p.SQL_ELEMENTS
_HUMPS = r"regexp_replace(regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Za-z])([0-9])', '\1 \2', 'g'), '([0-9])([A-Za-z])', '\1 \2', 'g')"
_TOKENS = f"list_transform(list_filter(regexp_split_to_array({_HUMPS}, '[^A-Za-z0-9]+'), lambda x: x <> ''), lambda x: lower(x))"
_PATH = r"regexp_replace(regexp_replace('/' || regexp_replace(regexp_replace(regexp_replace(url, '[#?].*$', ''), '^[a-z]+://[^/]*', ''), '\{[^}/]*\}|:[A-Za-z_][A-Za-z0-9_]*|<[^>/]*>|\[[^\]/]*\]', '{}', 'g'), '/+', '/', 'g'), '(.)/$', '\1')"


_HEADED = r"regexp_replace(text, '(?m)^([A-Z][a-z]+)\.$', '# \1', 'g')"


@query(
    "w09_sections",
    rf"""
WITH l AS (SELECT doc_id, unnest(string_split({_HEADED}, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents),
h AS (SELECT *, regexp_extract(line, '^#{{1,6}}\s+(.*\S)\s*$', 1) AS title FROM l),
s AS (SELECT doc_id, n, title, lower(regexp_replace(title, '[^A-Za-z0-9]+', '-', 'g')) AS slug, sum(CASE WHEN title <> '' THEN 1 ELSE 0 END) OVER w AS sec
      FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING)),
k AS (SELECT doc_id, sec, n AS start, slug, row_number() OVER (PARTITION BY doc_id, slug ORDER BY n) AS k FROM s WHERE title <> ''),
c AS (SELECT doc_id, sec, count(*) AS lines FROM s WHERE sec > 0 GROUP BY 1, 2)
SELECT doc_id, CAST(start + 1 AS BIGINT) AS start, slug || CASE WHEN k > 1 THEN '-' || k ELSE '' END AS slug, lines FROM k JOIN c USING (doc_id, sec)""",
)
def w09(spark, d):
    """Sections of texts whose one-word sentences on lines of their own are made headings."""
    headed = F.regexp_replace("text", r"(?m)^([A-Z][a-z]+)\.$", "# $1")
    return markdown.sections(p.read(spark, d, "documents").select(F.col("doc_id"), headed.alias("content")), "doc_id").select("doc_id", F.col("line").alias("start"), "slug", "lines")


_REFS = """refs AS (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'Fn/no-at' WHEN 1 THEN '@fn/lower' WHEN 2 THEN '@Fn/' WHEN 3 THEN '@Fn/src/a.ts#' WHEN 4 THEN '@Fn/src/a.ts:x' WHEN 5 THEN '@Fn/src/a.ts{open'
  WHEN 6 THEN '@Fn/src/f' || doc_id || '.ts#run:' || (doc_id % 50) || '-' || (doc_id % 50 + 4) || '{status=''ok'', q=' || doc_id || '}' ELSE ' @Zz/src/f' || doc_id || '.ts:try{b1} ' END AS ref FROM documents)"""


def _refs(spark, d):
    i = F.col("doc_id")
    s = lambda c: c.cast("string")
    whole = F.concat(F.lit("@Fn/src/f"), s(i), F.lit(".ts#run:"), s(i % 50), F.lit("-"), s(i % 50 + 4), F.lit("{status='ok', q="), s(i), F.lit("}"))
    forms = [F.lit(x) for x in ("Fn/no-at", "@fn/lower", "@Fn/", "@Fn/src/a.ts#", "@Fn/src/a.ts:x", "@Fn/src/a.ts{open")] + [whole, F.concat(F.lit(" @Zz/src/f"), s(i), F.lit(".ts:try{b1} "))]
    return p.read(spark, d, "documents").select("doc_id", F.element_at(F.array(*forms), (i % 8 + 1).cast("int")).alias("ref"))


@query(
    "s16_tag_parser",
    f"""
WITH {_REFS} SELECT doc_id, CASE WHEN doc_id % 8 = 6 THEN 'Fn' WHEN doc_id % 8 = 7 THEN 'Zz' END AS type, CASE WHEN doc_id % 8 >= 6 THEN 'src/f' || doc_id || '.ts' END AS path, CASE WHEN doc_id % 8 = 6 THEN 'run' END AS element,
  CAST(CASE WHEN doc_id % 8 = 6 THEN doc_id % 50 END AS INT) AS line, CAST(CASE WHEN doc_id % 8 = 6 THEN doc_id % 50 + 4 END AS INT) AS line_end, CASE WHEN doc_id % 8 = 7 THEN 'try' END AS block, CASE WHEN doc_id % 8 = 7 THEN 'b1' END AS block_id,
  CASE WHEN doc_id % 8 = 6 THEN 'ok' END AS status, CASE WHEN doc_id % 8 = 6 THEN CAST(doc_id AS VARCHAR) END AS q,
  CASE doc_id % 8 WHEN 0 THEN 'no_at' WHEN 1 THEN 'type' WHEN 2 THEN 'path' WHEN 3 THEN 'element' WHEN 4 THEN 'line' WHEN 5 THEN 'unclosed_metadata' END AS error FROM refs""",
)
def s16(spark, d):
    """References taken apart, and what is wrong with those that aren't."""
    x = _refs(spark, d).select("doc_id", tags.parse(F.col("ref")).alias("p"))
    meta = lambda k: F.try_element_at(F.col("p.metadata"), F.lit(k)).alias(k)
    return x.select("doc_id", *[f"p.{c}" for c in ("type", "path", "element", "line", "line_end", "block", "block_id")], meta("status"), meta("q"), "p.error")


@query("p09_docstrings", f"WITH {EL} SELECT kind, count(*) AS n, count(*) FILTER (regexp_matches(body, '^[A-Z]')) AS documented, round(count(*) FILTER (regexp_matches(body, '^[A-Z]')) * 1.0 / count(*), 6) AS ratio FROM elements GROUP BY kind")
def p09(spark, d):
    doc = F.col("body").rlike("^[A-Z]")
    return p.elements(spark, d).groupBy("kind").agg(F.count("*").alias("n"), F.count_if(doc).alias("documented"), F.round(F.count_if(doc) / F.count("*"), 6).alias("ratio"))


@query("p10_index_lookup", f"WITH {EL} SELECT doc_id, name FROM elements WHERE kind IN ('fr', 'de') AND file LIKE 'src1%' AND loc > 3")
def p10(spark, d):
    """Several values of one category, a path prefix and a predicate."""
    return p.elements(spark, d).where(F.col("kind").isin("fr", "de") & F.col("file").startswith("src1") & (F.col("loc") > 3)).select("doc_id", "name")


@query(
    "p16_query_classes",
    r"""
WITH q AS (SELECT regexp_replace(text, '^\s+|\s+$', '', 'g') AS q FROM conversations UNION ALL SELECT p_name FROM part
  UNION ALL SELECT replace(p_type, ' ', '.') FROM part UNION ALL SELECT '--' || lower(p_brand) FROM part UNION ALL SELECT '"' || p_name || '"' FROM part UNION ALL SELECT '--' || replace(lower(p_brand), '#', '-') FROM part)
SELECT CASE WHEN length(q) >= 2 AND ((q LIKE '"%' AND q LIKE '%"') OR (starts_with(q, chr(39)) AND ends_with(q, chr(39)))) THEN 'quoted'
  WHEN q = '' OR regexp_matches(q, '\s') THEN 'phrase' WHEN regexp_matches(q, '^-{1,2}[A-Za-z][A-Za-z0-9_-]*$') THEN 'flag'
  WHEN regexp_matches(q, '^[A-Za-z_$][A-Za-z0-9_$]*(\.[A-Za-z_$][A-Za-z0-9_$]*)+$') THEN 'member' ELSE 'identifier' END AS class, count(*) AS n FROM q GROUP BY 1""",
)
def p16(spark, d):
    """Shapes of whole messages and of names, flags and quoted names."""
    part = p.read(spark, d, "part")
    brand = F.lower("p_brand")
    forms = F.array("p_name", F.replace("p_type", F.lit(" "), F.lit(".")), F.concat(F.lit("--"), brand), F.concat(F.lit('"'), "p_name", F.lit('"')), F.concat(F.lit("--"), F.replace(brand, F.lit("#"), F.lit("-"))))
    q = p.read(spark, d, "conversations").select(F.col("text").alias("q")).unionByName(part.select(F.explode(forms).alias("q")))
    return q.groupBy(classify.query_shape(F.col("q")).alias("class")).agg(F.count("*").alias("n"))


@query("p20_source_window", "SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS source FROM documents WHERE len(string_split(text, chr(10))) >= 2")
def p20(spark, d):
    """Lines two to four."""
    lines = F.split("text", "\n")
    return p.read(spark, d, "documents").where(F.size(lines) >= 2).select("doc_id", F.array_join(F.slice(lines, 2, 3), "\n").alias("source"))


@query("t01_tokens", f"WITH x AS (SELECT o_orderkey, {_TOKENS.format('o_orderpriority || c_name || n_name')} AS w FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey) SELECT o_orderkey, array_to_string(w, ' ') AS tokens, CAST(len(w) AS INT) AS n FROM x")
def t01(spark, d):
    """Identifier tokens of composed names."""
    c = p.read(spark, d, "customer").join(p.read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name")
    x = p.read(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    return x.select("o_orderkey", t.lexical_tokens(F.concat("o_orderpriority", "c_name", "n_name")).alias("w")).select("o_orderkey", F.array_join("w", " ").alias("tokens"), F.size("w").alias("n"))


_BM = f"x AS (SELECT doc_id AS id, {_TOKENS.format('text')} AS w FROM documents), c AS (SELECT id, len(w) AS dl, len(list_filter(w, lambda y: y = 'the')) AS t0, len(list_filter(w, lambda y: y = 'ofthe')) AS t1, len(list_filter(w, lambda y: y = 'license')) AS t2 FROM x), s AS (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (t0 > 0) AS d0, count(*) FILTER (t1 > 0) AS d1, count(*) FILTER (t2 > 0) AS d2 FROM c), b AS (SELECT id, round(" + " + ".join(f"ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * t{i} * 2.5 / (t{i} + 1.5 * (0.25 + 0.75 * dl / avgdl))" for i in range(3)) + ", 6) AS score FROM c, s WHERE t0 > 0 OR t1 > 0 OR t2 > 0 ORDER BY score DESC, id LIMIT {0})"
_TERMS = ["the", "ofthe", "license"]


def _texts(spark, d):
    return p.read(spark, d, "documents").select(F.col("doc_id").alias("id"), t.lexical_tokens(F.col("text")).alias("tokens"))


@query("t03_bm25", f"WITH {_BM.format(20)} SELECT id, score FROM b")
def t03(spark, d):
    return r.bm25(_texts(spark, d), _TERMS, 20)


_COS = "round(list_dot_product(CAST(e.embedding AS DOUBLE[]), q.v) / (sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) * sqrt(list_dot_product(q.v, q.v))), 6)"
_Q = "q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 7)"


def _vectors(spark, d):
    e = p.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    return e, e.where("id = 7").select(F.col("v").alias("q"))


@query("t05_vector_search", f"WITH {_Q} SELECT vec_id AS id, {_COS} AS score FROM embeddings e, q WHERE label IN (1, 2, 3) ORDER BY score DESC, id LIMIT 15")
def t05(spark, d):
    """Nearest vectors after a metadata filter."""
    e, q = _vectors(spark, d)
    return r.vector_search(e.where("label in (1, 2, 3)"), q, 15)


@query("t06_hybrid_search", f"WITH {_Q}, {_BM.format(40)}, v AS (SELECT vec_id AS id, {_COS} AS score FROM embeddings e, q ORDER BY score DESC, id LIMIT 40), u AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS k FROM b UNION ALL SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 FROM v) SELECT id, round(sum(1.0 / (60 + k)), 9) AS score FROM u GROUP BY id ORDER BY score DESC, id LIMIT 10")
def t06(spark, d):
    """Dense and sparse hits fused by rank."""
    e, q = _vectors(spark, d)
    return r.fuse([r.bm25(_texts(spark, d), _TERMS, 40), r.vector_search(e, q, 40)], 10)


_RANKED = "x AS (SELECT vec_id AS id, abs(CAST(embedding[1] AS DOUBLE)) AS s, vec_id % 13 AS d, vec_id % 29 AS t, CAST(vec_id % 101 AS DOUBLE) AS c, vec_id % 37 AS k, vec_id % 3 = 0 AS e FROM embeddings)"
_FACTORS = "s * 0.2 + least(d / 10.0, 1.0) * 0.2 + least(t / 10.0, 1.0) * 0.3 + c / 100.0 * 0.2 - least(k / 20.0, 1.0) * 0.1"


def _ranked(spark, d):
    i = F.col("vec_id")
    return p.read(spark, d, "embeddings").select(i.alias("id"), F.abs(F.col("embedding")[0].cast("double")).alias("score"), (i % 13).alias("dependencies"), (i % 29).alias("dependents"), (i % 101).cast("double").alias("coverage"), (i % 37).alias("complexity"), (i % 3 == 0).alias("exported"))


@query("t11_rerank", f"WITH {_RANKED}, y AS (SELECT id, s, ({_FACTORS}) * (1 + (c / 100.0 + greatest(0, 1 - k / 20.0)) / 2) AS n FROM x) SELECT id, round(CASE WHEN s > 0 THEN greatest(0, least(n, s * 2)) ELSE 0 END, 6) AS score FROM y")
def t11(spark, d):
    """Every hit reranked by graph and quality factors, for a question about quality."""
    return r.rerank(_ranked(spark, d), "quality").select("id", F.round("score", 6).alias("score"))


@query("t11_rerank_public", f"WITH {_RANKED}, y AS (SELECT id, s, ({_FACTORS}) * (1 + CASE WHEN e THEN 0.3 ELSE 0 END) AS n FROM x), z AS (SELECT id, CASE WHEN s > 0 THEN least(n, s * 2) ELSE 0 END AS score FROM y) SELECT id, round(CASE WHEN score < 0.1 THEN 0 ELSE score END, 6) AS score FROM z")
def t11_public(spark, d):
    """The same for a question about the public surface, small scores dropped to nothing."""
    return r.rerank(_ranked(spark, d), "public", least=0.1).select("id", F.round("score", 6).alias("score"))


_ASKED = "(SELECT text AS q FROM conversations UNION ALL SELECT p_name || ' ' || ['who uses it', 'exported', 'tested', 'key part', 'the rest'][CAST(p_partkey % 5 + 1 AS INT)] FROM part)"


def _asked(spark, d, endings):
    """Whole messages, and part names with endings in turn."""
    ending = F.element_at(F.array(*[F.lit(x) for x in endings]), (F.col("p_partkey") % len(endings) + 1).cast("int"))
    return p.read(spark, d, "conversations").select(F.col("text").alias("q")).unionByName(p.read(spark, d, "part").select(F.concat_ws(" ", "p_name", ending).alias("q")))


@query(
    "t12_strategy",
    f"""
SELECT CASE WHEN regexp_matches(lower(q), 'who uses|what calls|usage') THEN 'usage' WHEN regexp_matches(lower(q), 'public|exported|api') THEN 'public'
  WHEN regexp_matches(lower(q), 'quality|tested|coverage') THEN 'quality' WHEN regexp_matches(lower(q), 'important|central|key') THEN 'centrality'
  ELSE 'general' END AS strategy, count(*) AS n FROM {_ASKED} GROUP BY 1""",
)
def t12(spark, d):
    return _asked(spark, d, ["who uses it", "exported", "tested", "key part", "the rest"]).groupBy(classify.query_strategy(F.col("q")).alias("strategy")).agg(F.count("*").alias("n"))


@query(
    "t14_document_search",
    """
WITH x AS (SELECT doc_id, (length(lower(text)) - length(replace(lower(text), 'th', ''))) // 2 AS hits, len(string_split(text, ' ')) AS words FROM documents)
SELECT doc_id, round(hits / (5.0 * words), 6) AS score FROM x WHERE hits / (5.0 * words) >= 0.1 ORDER BY score DESC, doc_id LIMIT 20""",
)
def t14(spark, d):
    """Overlapping occurrences over text length."""
    x = p.read(spark, d, "documents").select("doc_id", (F.regexp_count(F.lower("text"), F.lit("(?=th)")) / (5.0 * F.size(F.split("text", " ")))).alias("s"))
    return x.where("s >= 0.1").select("doc_id", F.round("s", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)


@query("t17_did_you_mean", "WITH t(kind) AS (VALUES ('click'), ('purchase'), ('view'), ('signup'), ('error')), w AS (SELECT DISTINCT substr(event_type, 2) AS q FROM events) SELECT q, kind FROM (SELECT q, kind, row_number() OVER (PARTITION BY q ORDER BY levenshtein(q, kind), kind) AS k FROM w, t WHERE levenshtein(q, kind) <= 3) WHERE k = 1")
def t17(spark, d):
    """The nearest known designator of a misspelt one."""
    known = F.array(*[F.lit(x) for x in ("click", "error", "purchase", "signup", "view")])
    w = p.read(spark, d, "events").select(F.expr("substr(event_type, 2)").alias("q")).distinct()
    best = F.array_min(F.transform(known, lambda k: F.struct(F.levenshtein("q", k).alias("n"), k.alias("kind"))))
    return w.select("q", best.alias("b")).where("b.n <= 3").select("q", "b.kind")


@query("t22_embedding_cache", "SELECT count(*) AS texts, count(DISTINCT sha256(text) || ':m1') AS keys, count(*) FILTER (doc_id % 3 = 0) AS cached, CAST(sum(ceil(length(text) / 4.0)) AS BIGINT) AS tokens FROM documents")
def t22(spark, d):
    """Cache keys and cost of embedding all texts."""
    return p.read(spark, d, "documents").agg(F.count("*").alias("texts"), F.count_distinct(F.concat(F.sha2("text", 256), F.lit(":m1"))).alias("keys"), F.count_if(F.col("doc_id") % 3 == 0).alias("cached"), F.sum(t.token_estimate(F.col("text"))).alias("tokens"))


@query(
    "t25_question_types",
    """
WITH x AS (SELECT text AS q FROM conversations WHERE role = 'user' UNION ALL SELECT p_name || ' ' || ['how does it work', 'vs the other', 'should i use it', 'what is it'][CAST(p_partkey % 4 + 1 AS INT)] FROM part)
SELECT CASE WHEN regexp_matches(lower(q), 'how does|what does|explain|how works') THEN 'explanation' WHEN regexp_matches(lower(q), 'compare|difference between|vs|versus') THEN 'comparison'
  WHEN regexp_matches(lower(q), 'best practice|should i|recommend|improve|better') THEN 'best-practices' ELSE 'qa' END AS type, count(*) AS n FROM x GROUP BY 1""",
)
def t25(spark, d):
    q = p.read(spark, d, "conversations").where("role = 'user'").select(F.col("text").alias("q"))
    more = p.read(spark, d, "part").select("p_name", F.element_at(F.array(*[F.lit(x) for x in ("how does it work", "vs the other", "should i use it", "what is it")]), (F.col("p_partkey") % 4 + 1).cast("int")).alias("e"))
    return q.unionByName(more.select(F.concat_ws(" ", "p_name", "e").alias("q"))).groupBy(classify.question_type(F.col("q")).alias("type")).agg(F.count("*").alias("n"))


@query("r02_endpoint_paths", f"SELECT page_id, {_PATH} AS path FROM pages")
def r02(spark, d):
    return p.read(spark, d, "pages").select("page_id", t.canonical_path(F.col("url")).alias("path"))


_ROUTES = f"x AS (SELECT page_id, regexp_replace({_PATH}, '[0-9]+', '{{}}') AS path, page_id % 4 AS side FROM pages), s AS (SELECT DISTINCT path, page_id % 3 AS method FROM x WHERE side = 0), c AS (SELECT DISTINCT path, page_id % 3 AS method FROM x WHERE side <> 0)"


def _routes(spark, d):
    path = F.regexp_replace(t.canonical_path(F.col("url")), "[0-9]+", "{}")
    x = p.read(spark, d, "pages").select("page_id", path.alias("path"))
    m = (F.col("page_id") % 3).alias("method")
    return x.where("page_id % 4 = 0").select("path", m).distinct(), x.where("page_id % 4 <> 0").select("path", m).distinct()


@query("r03_route_issues", f"WITH {_ROUTES} SELECT 'missing' AS issue, count(DISTINCT path) AS n FROM c WHERE path NOT IN (SELECT path FROM s) UNION ALL SELECT 'unused', count(DISTINCT path) FROM s WHERE path NOT IN (SELECT path FROM c) UNION ALL SELECT 'method', count(*) FROM c WHERE path IN (SELECT path FROM s) AND NOT EXISTS (SELECT 1 FROM s WHERE s.path = c.path AND s.method = c.method)")
def r03(spark, d):
    """Missing and unused routes (methods ignored) and method mismatches."""
    s, c = _routes(spark, d)
    sp, cp = s.select("path").distinct(), c.select("path").distinct()
    n = lambda df, k: df.agg(F.count("*").alias("n")).select(F.lit(k).alias("issue"), "n")
    return n(cp.join(sp, "path", "left_anti"), "missing").unionByName(n(sp.join(cp, "path", "left_anti"), "unused")).unionByName(n(c.join(sp, "path", "left_semi").join(s, ["path", "method"], "left_anti"), "method"))


@query("j11_endpoint_edges", f"WITH {_ROUTES} SELECT CASE WHEN s.path IS NOT NULL THEN 'resolved' WHEN c.path IN (SELECT path FROM s) THEN 'endpoint_method_not_served' ELSE 'endpoint_not_in_project' END AS outcome, count(*) AS n FROM c LEFT JOIN s ON s.path = c.path AND s.method = c.method GROUP BY 1")
def j11(spark, d):
    """Client calls to endpoints: by path, then method."""
    s, c = _routes(spark, d)
    known = s.groupBy("path").agg(F.collect_set("method").alias("methods"))
    x = c.join(known, "path", "left")
    return x.groupBy(F.when(F.array_contains("methods", F.col("method")), "resolved").when(F.col("methods").isNotNull(), "endpoint_method_not_served").otherwise("endpoint_not_in_project").alias("outcome")).agg(F.count("*").alias("n"))


@query("a21_api_surface", f"WITH {_ROUTES} SELECT s.path, count(DISTINCT s.method) AS methods, count(DISTINCT c.method) AS callers, count(c.method) = 0 AS orphaned FROM s LEFT JOIN c ON s.path = c.path GROUP BY s.path")
def a21(spark, d):
    s, c = _routes(spark, d)
    served = s.groupBy("path").agg(F.count_distinct("method").alias("methods"))
    called = c.groupBy("path").agg(F.count_distinct("method").alias("callers"))
    return served.join(called, "path", "left").select("path", "methods", F.coalesce("callers", F.lit(0)).alias("callers"), F.col("callers").isNull().alias("orphaned"))


@query("a29_route_stats", "SELECT split_part(split_part(url, '://', 2), '/', 2) AS prefix, count(*) AS n, count(*) FILTER (url LIKE 'https%') AS secure FROM pages GROUP BY 1")
def a29(spark, d):
    part = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(2))
    return p.read(spark, d, "pages").groupBy(part.alias("prefix")).agg(F.count("*").alias("n"), F.count_if(F.col("url").startswith("https")).alias("secure"))


@query("j19_migration", f"WITH x AS (SELECT page_id, {_PATH} AS path FROM pages), m AS (SELECT *, CASE WHEN path LIKE '/en/1%' THEN '/v2' || path WHEN regexp_matches(path, '^/(fr|de)/') THEN regexp_replace(path, '^/(fr|de)/(.*)$', '/\\1-eu/\\2') END AS target, CASE WHEN path LIKE '/en/1%' THEN 100 WHEN regexp_matches(path, '^/(fr|de)/') THEN 80 ELSE 0 END AS confidence FROM x) SELECT page_id, path, coalesce(target, path) AS target, CAST(confidence AS INT) AS confidence FROM m")
def j19(spark, d):
    """Explicit mapping, then pattern, else unmapped."""
    x = p.read(spark, d, "pages").select("page_id", t.canonical_path(F.col("url")).alias("path"))
    explicit, pattern = F.col("path").startswith("/en/1"), F.col("path").rlike("^/(fr|de)/")
    target = F.when(explicit, F.concat(F.lit("/v2"), "path")).when(pattern, F.regexp_replace("path", "^/(fr|de)/(.*)$", "/$1-eu/$2")).otherwise(F.col("path"))
    return x.select("page_id", "path", target.alias("target"), F.when(explicit, 100).when(pattern, 80).otherwise(0).alias("confidence"))


@query("a30_migration_coverage", f"WITH x AS (SELECT {_PATH} AS path FROM pages) SELECT split_part(path, '/', 2) AS prefix, count(*) AS n, floor(count(*) FILTER (regexp_matches(path, '^/(fr|de|en/1)')) * 1000.0 / count(*) + 0.5) / 10 AS coverage FROM x GROUP BY 1")
def a30(spark, d):
    x = p.read(spark, d, "pages").select(t.canonical_path(F.col("url")).alias("path"))
    return x.groupBy(F.split_part("path", F.lit("/"), F.lit(2)).alias("prefix")).agg(F.count("*").alias("n"), t.half_up(F.count_if(F.col("path").rlike("^/(fr|de|en/1)")) * 100.0 / F.count("*"), 1).alias("coverage"))


@query("r10_broken_references", r"WITH x AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"/([^\"]+)\"', 1)) AS ref FROM pages) SELECT ref, count(*) AS n FROM x WHERE ref NOT IN (SELECT ref FROM x WHERE page_id % 2 = 0) GROUP BY ref")
def r10(spark, d):
    """References that no even page defines."""
    x = p.read(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'href="/([^"]+)"'), F.lit(1))).alias("ref"))
    return x.join(x.where("page_id % 2 = 0").select("ref").distinct(), "ref", "left_anti").groupBy("ref").agg(F.count("*").alias("n"))


@query("r09_tag_validation", f"WITH {_REFS} SELECT CASE doc_id % 8 WHEN 0 THEN 'no_at' WHEN 1 THEN 'type' WHEN 2 THEN 'path' WHEN 3 THEN 'element' WHEN 4 THEN 'line' WHEN 5 THEN 'unclosed_metadata' WHEN 6 THEN 'ok' ELSE 'unknown_type' END AS verdict, count(*) AS n FROM refs GROUP BY 1")
def r09(spark, d):
    """What a validator says of each reference."""
    return _refs(spark, d).groupBy(tags.verdict(F.col("ref")).alias("verdict")).agg(F.count("*").alias("n"))


@query("r19_layer_of_path", "SELECT CASE WHEN p_type LIKE '%STEEL%' THEN 'core' WHEN p_type LIKE '%BRASS%' THEN 'service' WHEN p_name LIKE '%green%' THEN 'ui' END AS layer, lower(regexp_replace(trim(p_type), '[^A-Za-z0-9]+', '-', 'g')) AS capability, count(*) AS n FROM part GROUP BY 1, 2")
def r19(spark, d):
    """The first pattern's layer and a slug."""
    layer = F.when(F.col("p_type").contains("STEEL"), "core").when(F.col("p_type").contains("BRASS"), "service").when(F.col("p_name").contains("green"), "ui")
    return p.read(spark, d, "part").groupBy(layer.alias("layer"), F.lower(F.regexp_replace(F.trim("p_type"), "[^A-Za-z0-9]+", "-")).alias("capability")).agg(F.count("*").alias("n"))


@query("k05_report", "SELECT c_mktsegment AS segment, '## ' || c_mktsegment || chr(10) || string_agg('- ' || n_name || ': ' || n, chr(10) ORDER BY n DESC, n_name) AS report FROM (SELECT c_mktsegment, n_name, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2) GROUP BY 1")
def k05(spark, d):
    """A section of lines for each group."""
    n = p.read(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    x = p.read(spark, d, "customer").join(n, "c_nationkey").groupBy("c_mktsegment", "n_name").agg(F.count("*").alias("n"))
    lines = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "n_name")))
    y = x.groupBy(F.col("c_mktsegment").alias("segment")).agg(lines.alias("l"))
    return y.select("segment", F.concat(F.lit("## "), "segment", F.lit("\n"), F.array_join(F.transform("l", lambda v: F.concat(F.lit("- "), v["n_name"], F.lit(": "), (-v["m"]).cast("string"))), "\n")).alias("report"))


@query(
    "k06_routes_grouped",
    """
WITH k AS (SELECT split_part(url, '://', 1) AS framework, page_id, row_number() OVER (PARTITION BY split_part(url, '://', 1) ORDER BY page_id) AS k FROM pages)
SELECT framework, count(*) AS n, string_agg(CAST(page_id AS VARCHAR), ',' ORDER BY page_id) FILTER (k <= 10) AS first_pages FROM k GROUP BY 1""",
)
def k06(spark, d):
    """Routes of each framework: how many, and the ten first by rank, so that no group is collected whole."""
    x = p.read(spark, d, "pages").select(F.split_part("url", F.lit("://"), F.lit(1)).alias("framework"), "page_id")
    few = x.withColumn("k", F.row_number().over(Window.partitionBy("framework").orderBy("page_id"))).where("k <= 10")
    few = few.groupBy("framework").agg(F.array_join(F.transform(F.array_sort(F.collect_list("page_id")), lambda v: v.cast("string")), ",").alias("first_pages"))
    return x.groupBy("framework").agg(F.count("*").alias("n")).join(few, "framework")
