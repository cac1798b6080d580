"""Files, their facts, documents, logs, diffs, routes and settings: scanners over text made of the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import detect
from ..sources import contracts, extract, logs, markdown, routes, scan, synthetic
from ..sources import projections as p

FILES = synthetic.SQL_FILES
_IGNORED = r"regexp_matches(path, '(^|/)(node_modules|dist)/') OR path LIKE '%.min.js'"


@query("s01_discovery", f"WITH {FILES} SELECT path, CASE WHEN path LIKE '%.py' THEN 'py' WHEN path LIKE '%.js' THEN 'js' ELSE 'ts' END AS language FROM files WHERE NOT ({_IGNORED})")
def s01(spark, d):
    """The files that a walk finds: known languages, nothing ignored."""
    x = synthetic.files(spark, d).select("path", scan.language(F.col("path")).alias("language"))
    return x.where(F.col("language").isNotNull() & ~scan.ignored(F.col("path")))


@query("s02_ignore_rules", f"WITH {FILES} SELECT split_part(path, '/', 1) AS folder, count(*) AS files, count(*) FILTER ({_IGNORED} OR regexp_matches(path, '^src/m3/.*[.]ts$')) AS ignored FROM files GROUP BY 1")
def s02(spark, d):
    """How many files of each folder the default rules and one of a user's ignore."""
    hit = scan.ignored(F.col("path"), ["# comment", "src/m3/*.ts"])
    return synthetic.files(spark, d).groupBy(F.split_part("path", F.lit("/"), F.lit(1)).alias("folder")).agg(F.count("*").alias("files"), F.count_if(hit).alias("ignored"))


@query("s03_parallel_scan", f"WITH {FILES} SELECT language, type, count(*) AS n FROM files, (VALUES ('ts', 'function'), ('ts', 'class'), ('ts', 'method'), ('py', 'class'), ('py', 'method')) t(l, type) WHERE l = language GROUP BY 1, 2")
def s03(spark, d):
    """Declarations by language and type; every task scans the files of its own rows."""
    files = synthetic.files(spark, d)
    found = scan.scan(files).join(files.select("path", "language"), "path")
    return found.groupBy("language", "type").agg(F.count("*").alias("n"))


@query(
    "s04_elements",
    f"""
WITH {FILES} SELECT path AS file, 'function' AS type, 'f' || k AS name, CAST(5 AS BIGINT) AS line, CAST(8 AS BIGINT) AS end_line, 3 AS cyclomatic FROM files WHERE language = 'ts'
UNION ALL SELECT path, 'class', 'C' || k, 9, 11, NULL FROM files WHERE language = 'ts' UNION ALL SELECT path, 'method', 'run', 10, 10, 1 FROM files WHERE language = 'ts'
UNION ALL SELECT path, 'class', 'C' || k, 4, 9, NULL FROM files WHERE language = 'py' UNION ALL SELECT path, 'method', 'C' || k || '.run', 6, 9, 3 FROM files WHERE language = 'py'""",
)
def s04(spark, d):
    """Elements with their spans and complexity: Python parsed, TypeScript by its braces."""
    return extract.elements(extract.facts(synthetic.files(spark, d))).select("file", "type", "name", "line", "end_line", "cyclomatic")


@query(
    "s05_relationships",
    f"""
WITH {FILES} SELECT path, fact, v.name, target FROM files, LATERAL (SELECT * FROM (VALUES
  ('ts', 'import', './p' || o, './p' || o), ('ts', 'call', 'f' || o, 'f' || o), ('ts', 'call', 'fetch', 'fetch'), ('ts', 'call', 'helper', 'helper'), ('ts', 'heritage', 'C' || k, 'C' || b),
  ('py', 'import', 'os', 'os'), ('py', 'import', 'p' || o, 'p' || o), ('py', 'call', 'f', 'f'), ('py', 'call', 'getpid', 'os.getpid'), ('py', 'heritage', 'C' || k, 'C' || b)) v(l, fact, name, target) WHERE l = language) v""",
)
def s05(spark, d):
    """Imports, calls and heritage."""
    return extract.facts(synthetic.files(spark, d)).where("fact in ('import', 'call', 'heritage')").select("path", "fact", "name", "target")


@query(
    "s06_regex_scan",
    f"""
WITH {FILES} SELECT path, 'function' AS type, 'f' || k AS name, CAST(5 AS BIGINT) AS line, true AS exported FROM files WHERE language = 'ts' UNION ALL SELECT path, 'class', 'C' || k, 9, true FROM files WHERE language = 'ts'
UNION ALL SELECT path, 'method', 'run', 10, false FROM files WHERE language = 'ts' UNION ALL SELECT path, 'class', 'C' || k, 4, false FROM files WHERE language = 'py' UNION ALL SELECT path, 'method', 'run', 6, false FROM files WHERE language = 'py'""",
)
def s06(spark, d):
    """Declarations by patterns, comments and strings masked, one type for each name and line."""
    return scan.scan(synthetic.files(spark, d))


@query("e01_registered_patterns", f"WITH {FILES} SELECT path, 'request' AS type, 'fetch' AS name, CAST(7 AS BIGINT) AS line FROM files WHERE language = 'ts'")
def e01(spark, d):
    """A pattern that a user registers, beside the built-in ones."""
    own = scan.Registry()
    own.register("ts", scan.Pattern("request", r"\b(fetch)\("))
    return scan.scan(synthetic.files(spark, d), own).where("type = 'request'").select("path", "type", "name", "line")


@query("e04_where_predicate", f"WITH {FILES} SELECT path FROM files WHERE language = 'py' AND s > 25 AND length(path) % 2 = 0")
def e04(spark, d):
    """Any predicate of a user's as a column."""
    wanted = lambda f: (f["language"] == "py") & (F.regexp_extract("content", r"if x and (\d+)", 1).cast("int") > 25) & (F.char_length(f["path"]) % 2 == 0)
    files = synthetic.files(spark, d)
    return files.where(wanted(files)).select("path")


_SERVED = """served AS (SELECT page_id AS k, CASE page_id % 4 WHEN 0 THEN '@app.route("/p/<int:id>/' || page_id || '", methods=["GET", "POST"])' WHEN 1 THEN 'router.get(''/p/:id/' || page_id || ''', h)'
  WHEN 2 THEN '@api.delete("/p/{id}/' || page_id || '")' ELSE 'app.all("/p/' || page_id || '", h)' END AS content FROM pages)"""


def _served(spark, d):
    """A source of one route for each page, in the notation of a framework."""
    k = F.col("page_id").cast("string")
    forms = (("@app.route(\"/p/<int:id>/", "\", methods=[\"GET\", \"POST\"])"), ("router.get('/p/:id/", "', h)"), ("@api.delete(\"/p/{id}/", "\")"), ("app.all(\"/p/", "\", h)"))
    text = F.element_at(F.array(*[F.concat(F.lit(a), k, F.lit(b)) for a, b in forms]), (F.col("page_id") % 4 + 1).cast("int"))
    return p.read(spark, d, "pages").select(F.concat(F.lit("r"), k, F.lit(".x")).alias("path"), text.alias("content"), "page_id")


@query(
    "s07_routes",
    f"""
WITH {_SERVED} SELECT 'r' || k || '.x' AS file, CASE k % 4 WHEN 0 THEN 'flask' WHEN 2 THEN 'fastapi' ELSE 'express' END AS framework,
  CASE k % 4 WHEN 0 THEN '/p/<int:id>/' WHEN 1 THEN '/p/:id/' WHEN 2 THEN '/p/{{id}}/' ELSE '/p/' END || k AS path, CASE k % 4 WHEN 0 THEN 'GET,POST' WHEN 1 THEN 'GET' WHEN 2 THEN 'DELETE' ELSE 'ANY' END AS methods FROM served""",
)
def s07(spark, d):
    """Routes of four notations with their methods."""
    return routes.routes(_served(spark, d)).select("file", "framework", "path", F.array_join("methods", ",").alias("methods"))


@query(
    "r01_route_normal_forms",
    f"WITH {_SERVED} SELECT 'r' || k || '.x' AS file, CASE WHEN k % 4 = 3 THEN '/p/' ELSE '/p/{{id}}/' END || k AS path FROM served",
)
def r01(spark, d):
    """All notations in one."""
    x = routes.routes(_served(spark, d))
    return x.select("file", routes.normal_route(F.col("path"), F.col("framework")).alias("path"))


@query("e02_framework_registry", f"WITH {_SERVED} SELECT 'custom' AS framework, count(*) AS n FROM served WHERE k % 4 = 1 UNION ALL SELECT 'fastapi', count(*) FROM served WHERE k % 4 = 2 UNION ALL SELECT 'flask', count(*) FROM served WHERE k % 4 = 0")
def e02(spark, d):
    """A detector registered, another taken out."""
    known = routes.Frameworks()
    known.register(routes.Detector("custom", r"router\.get\('([^']+)'", 1))
    known.unregister("express")
    return routes.routes(_served(spark, d), known).groupBy("framework").agg(F.count("*").alias("n"))


_ASKED = """asked AS (SELECT page_id AS k, CASE page_id % 3 WHEN 0 THEN '/p/7/' || page_id WHEN 1 THEN '/p/' || page_id ELSE '/q/' || page_id END AS path, CASE WHEN page_id % 2 = 0 THEN 'GET' ELSE 'POST' END AS method FROM pages)"""


def _asked(spark, d):
    """A client source with one request for each page."""
    k = F.col("page_id").cast("string")
    path = F.concat(F.element_at(F.array(F.lit("/p/7/"), F.lit("/p/"), F.lit("/q/")), (F.col("page_id") % 3 + 1).cast("int")), k)
    text = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("axios.get('"), path, F.lit("')"))).otherwise(F.concat(F.lit("fetch('"), path, F.lit("', { method: 'POST' })")))
    return p.read(spark, d, "pages").select(F.concat(F.lit("c"), k, F.lit(".ts")).alias("path"), text.alias("content"))


@query("s08_client_calls", f"WITH {_ASKED} SELECT 'c' || k || '.ts' AS file, CASE WHEN k % 2 = 0 THEN 'axios' ELSE 'fetch' END AS call, path, method, 100 AS confidence FROM asked")
def s08(spark, d):
    """Requests of clients with method and confidence."""
    return routes.client_calls(_asked(spark, d))


@query(
    "r22_orphaned_calls",
    f"""
WITH {_ASKED}, f AS (SELECT page_id AS k, page_id % 4 AS m FROM pages), x AS (SELECT a.path, a.method, f.m FROM asked a LEFT JOIN f ON (a.k % 3 = 0 AND f.k = a.k AND f.m <> 3) OR (a.k % 3 = 1 AND f.k = a.k AND f.m = 3)),
y AS (SELECT path, method, CASE WHEN m IS NULL THEN 'no_matching_route' WHEN m = 3 OR (m = 0) OR (m = 1 AND method = 'GET') THEN 'served' ELSE 'method_mismatch' END AS reason FROM x)
SELECT path, method, reason, CASE WHEN reason = 'method_mismatch' THEN 80 ELSE 95 END AS confidence FROM y WHERE reason <> 'served'""",
)
def r22(spark, d):
    """Requests that no route serves: by literal path, then by shape."""
    x = routes.routes(_served(spark, d))
    served = x.select(routes.normal_route(F.col("path"), F.col("framework")).alias("path"), "methods")
    return routes.orphaned_calls(routes.client_calls(_asked(spark, d)), served)


@query("s09_doc_sections", "WITH l AS (SELECT p_partkey AS k FROM part) SELECT 'docs/p' || k || '.md' AS path, slug, CAST(line AS BIGINT) AS line, mentions FROM l, LATERAL (SELECT * FROM (VALUES ('part-' || k, 5, 'f' || k), ('usage', 7, ''), ('usage-2', 11, 'helper')) v(slug, line, mentions))")
def s09(spark, d):
    """Documents with front matter, headings, mentions and a fence; one for each part."""
    k = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("---\nsubject: x\nstatus: approved\n---\n# Part "), k, F.lit("\nsee `f"), k, F.lit("()`\n## Usage\n```ts\n# no heading\n```\n## Usage\n`helper` and `not one`\n"))
    docs = p.read(spark, d, "part").select(F.concat(F.lit("docs/p"), k, F.lit(".md")).alias("path"), text.alias("content"))
    return markdown.sections(docs, "path").select("path", "slug", "line", F.array_join("mentions", ",").alias("mentions"))


@query("s11_docstrings", f"WITH {FILES} SELECT path AS file, CASE language WHEN 'ts' THEN 'f' || k ELSE 'C' || k END AS name, CASE language WHEN 'ts' THEN 'Part ' || name || '.' ELSE 'Doc ' || k || '.' END AS doc FROM files UNION ALL SELECT path, '', 'Module of ' || name || '.' FROM files WHERE language = 'py'")
def s11(spark, d):
    """Docstrings of functions, classes and modules."""
    return extract.docstrings(extract.facts(synthetic.files(spark, d))).select("file", "name", "doc")


@query("r13_ast_complexity", f"WITH {FILES} SELECT cyclomatic, cognitive, nesting, count(*) AS n FROM (SELECT 3 AS cyclomatic, 2 AS cognitive, 1 AS nesting FROM files WHERE language = 'ts' UNION ALL SELECT 1, 0, 0 FROM files WHERE language = 'ts' UNION ALL SELECT 3, 2, 1 FROM files WHERE language = 'py') GROUP BY 1, 2, 3")
def r13(spark, d):
    """Cyclomatic and cognitive complexity and nesting of functions and methods."""
    e = extract.elements(extract.facts(synthetic.files(spark, d))).where("type in ('function', 'method')")
    return e.groupBy("cyclomatic", "cognitive", "nesting").agg(F.count("*").alias("n"))


@query("r12_cyclomatic", f"WITH {FILES} SELECT path, CASE language WHEN 'ts' THEN 4 ELSE 1 END AS complexity FROM files")
def r12(spark, d):
    """The plain estimate by eight patterns over whole files, comments and all."""
    return synthetic.files(spark, d).select("path", detect.cyclomatic(F.col("content")).alias("complexity"))


_LOG = "g AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type || '/f' || event_id % 23 || '.ts' AS file, event_id % 9 AS added, event_id % 5 AS deleted FROM events)"


def _log(spark, d):
    """A log for each user: a commit a day and a line for each change."""
    e = p.read(spark, d, "events").select("user_id", F.col("ts").cast("date").alias("day"), "event_id", F.concat("event_type", F.lit("/f"), (F.col("event_id") % 23).cast("string"), F.lit(".ts")).alias("file"))
    line = F.concat_ws("\t", (F.col("event_id") % 9).cast("string"), (F.col("event_id") % 5).cast("string"), "file")
    day = e.groupBy("user_id", "day").agg(F.array_sort(F.collect_list(F.struct("event_id", line.alias("l")))).alias("c"))  # a user's day
    head = F.concat(F.lit(logs.MARK), F.date_format("day", "yyyyMMdd"), F.lit(logs.MARK + "dev"), (F.col("user_id") % 7).cast("string"), F.lit(logs.MARK), F.unix_seconds(F.col("day").cast("timestamp")).cast("string"), F.lit("\n"))
    return day.select(F.concat_ws("-", F.col("user_id").cast("string"), F.lit("log")).alias("log_id"), F.concat(F.lit("0\t0\tbefore any commit\n"), head, F.array_join(F.transform("c", lambda v: v["l"]), "\n"), F.lit("\n-\t-\tbin/x.png\n\n")).alias("log"))


@query("s12_numstat", f"WITH {_LOG}, c AS (SELECT user_id, day, file, sum(added) AS a, sum(deleted) AS x FROM g GROUP BY 1, 2, 3 UNION ALL SELECT DISTINCT user_id, day, 'bin/x.png', 0, 0 FROM g) SELECT file, count(*) AS commits, CAST(sum(a) AS BIGINT) AS added, CAST(sum(x) AS BIGINT) AS deleted FROM c GROUP BY 1")
def s12(spark, d):
    """Churn from the text of logs; each is a row."""
    x = logs.numstat(_log(spark, d)).withColumn("commit", F.concat_ws(":", "log_id", "hash"))
    return logs.churn(x)


@query(
    "s13_changed_elements",
    """
WITH e AS (SELECT p_partkey AS id, 'm' || p_partkey % 17 || '.ts' AS file, p_partkey // 17 * 10 + 1 AS line FROM part),
s AS (SELECT id, file, line, lead(line) OVER (PARTITION BY file ORDER BY line, id) - 1 AS stop FROM e),
h AS (SELECT o_orderkey AS k, 'm' || o_orderkey % 17 || '.ts' AS file, o_orderkey % 200 + 1 AS lo, o_orderkey % 200 + greatest(o_orderkey % 4, 1) AS hi FROM orders)
SELECT k AS diff_id, id FROM h JOIN s ON s.file = h.file AND line <= hi AND coalesce(stop, 1e9) >= lo GROUP BY 1, 2""",
)
def s13(spark, d):
    """The elements that unified diffs touch; a diff for each order."""
    k = F.col("o_orderkey")
    s = lambda c: c.cast("string")
    file = F.concat(F.lit("m"), s(k % 17), F.lit(".ts"))
    text = F.concat(F.lit("--- a/"), file, F.lit("\n+++ b/"), file, F.lit("\n@@ -1,2 +"), s(k % 200 + 1), F.when(k % 4 == 1, "").otherwise(F.concat(F.lit(","), s(k % 4))), F.lit(" @@ x\n-a\n+b\n--- a/y\n+++ /dev/null\n@@ -1 +1 @@\n"))
    diffs = p.read(spark, d, "orders").select(k.alias("diff_id"), text.alias("diff"))
    part = F.col("p_partkey")
    elements = p.read(spark, d, "part").select(part.alias("id"), F.concat(F.lit("m"), s(part % 17), F.lit(".ts")).alias("file"), (F.floor(part / 17) * 10 + 1).alias("line"))
    return logs.changed_elements(logs.hunks(diffs), elements)


@query("s17_contracts", "SELECT kind, count(*) AS n, count(DISTINCT name) AS names FROM (SELECT 'protobuf' AS kind, 'M' || p_partkey AS name FROM part UNION ALL SELECT 'protobuf', 'M' || p_partkey FROM part UNION ALL SELECT 'graphql', 'T' || p_partkey FROM part UNION ALL SELECT 'openapi', '/p/' || p_partkey FROM part UNION ALL SELECT 'protobuf-service', 'S' || p_partkey FROM part) GROUP BY 1")
def s17(spark, d):
    """Members of the contracts in a Protobuf, a GraphQL and an OpenAPI file for each part."""
    k = F.col("p_partkey").cast("string")
    forms = [
        ("a.proto", F.concat(F.lit("message M"), k, F.lit(" {\n  string name = 1;\n  repeated int32 n = 2;\n}\nservice S"), k, F.lit(" {\n  rpc Get (M) returns (M);\n}\n"))),
        ("a.graphql", F.concat(F.lit("type T"), k, F.lit(" {\n  name(x: Int): String\n}\n"))),
        ("a.json", F.concat(F.lit('{"openapi":"3.0","paths":{"/p/'), k, F.lit('":{"get":{"x":1},"parameters":[]}}}'))),
    ]
    files = F.array(*[F.struct(F.concat(k, F.lit(f"/{n}")).alias("path"), c.alias("content")) for n, c in forms])
    x = p.read(spark, d, "part").select(F.explode(files).alias("f")).select("f.*")
    return contracts.contracts(x).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("name").alias("names"))


@query("s18_database_schemas", "SELECT tool, count(*) AS n, count(DISTINCT model) AS models FROM (SELECT 'prisma' AS tool, 'M' || p_partkey AS model FROM part UNION ALL SELECT 'prisma', 'M' || p_partkey FROM part UNION ALL SELECT 'typeorm', 'E' || p_partkey FROM part UNION ALL SELECT 'mongoose', 's' || p_partkey FROM part UNION ALL SELECT 'sequelize', 'q' || p_partkey FROM part) GROUP BY 1")
def s18(spark, d):
    """Fields of the models that four tools declare."""
    k = F.col("p_partkey").cast("string")
    forms = [
        ("s.prisma", F.concat(F.lit("model M"), k, F.lit(" {\n  id Int\n  name String?\n}\n"))),
        ("e.ts", F.concat(F.lit("@Entity('t')\nexport class E"), k, F.lit(" {\n  @Column({ length: 5 })\n  name: string;\n}\n"))),
        ("m.js", F.concat(F.lit("const s"), k, F.lit(" = new Schema({\n  name: { type: String },\n});\n"))),
        ("q.js", F.concat(F.lit("sequelize.define('q"), k, F.lit("', {\n  name: { type: DataTypes.STRING },\n});\n"))),
    ]
    files = F.array(*[F.struct(F.concat(k, F.lit(f"/{n}")).alias("path"), c.alias("content")) for n, c in forms])
    x = p.read(spark, d, "part").select(F.explode(files).alias("f")).select("f.*")
    return contracts.database_schemas(x).groupBy("tool").agg(F.count("*").alias("n"), F.count_distinct("model").alias("models"))


@query("s19_settings", "SELECT kind, count(*) AS n FROM (SELECT 'script' AS kind FROM part UNION ALL SELECT 'dependency' FROM part UNION ALL SELECT 'dependency' FROM part UNION ALL SELECT 'docker' FROM part UNION ALL SELECT 'docker' FROM part UNION ALL SELECT 'variable' FROM part UNION ALL SELECT 'service' FROM part UNION ALL SELECT 'service' FROM part) GROUP BY 1")
def s19(spark, d):
    """Settings by kind from a package file, a Dockerfile, an environment file and services for each part."""
    k = F.col("p_partkey").cast("string")
    forms = [
        ("package.json", F.concat(F.lit('{"name":"p'), k, F.lit('","scripts":{"test":"run"},"dependencies":{"a":"1","b":"2"}}'))),
        ("Dockerfile", F.lit("FROM base\n# no\nCMD run it\n")),
        (".env.local", F.concat(F.lit("# x\nKEY_"), k, F.lit("=secret\n"))),
        ("compose.yml", F.lit("services:\n  web:\n    image: x\n  db:\n    image: y\n\nvolumes:\n  data:\n")),
    ]
    files = F.array(*[F.struct(F.concat(k, F.lit(f"/{n}")).alias("path"), c.alias("content")) for n, c in forms])
    x = p.read(spark, d, "part").select(F.explode(files).alias("f")).select("f.*")
    return contracts.settings(x).groupBy("kind").agg(F.count("*").alias("n"))


@query("r14_design_patterns", f"WITH {FILES} SELECT k % 4 AS form, CASE k % 4 WHEN 0 THEN 'builder:high' WHEN 1 THEN 'repository:low' WHEN 2 THEN 'command:medium' ELSE '' END AS patterns, count(*) AS n FROM files GROUP BY 1, 2")
def r14(spark, d):
    """Design patterns and how sure they are."""
    forms = ["class XBuilder { set(v) { return this } build() { } }", "class XRepository { }", "class XCommand { execute() { } }", "let x = 1"]
    files = synthetic.files(spark, d).select((F.col("k") % 4).alias("form"), F.element_at(F.array(*[F.lit(x) for x in forms]), (F.col("k") % 4 + 1).cast("int")).alias("content"))
    found = F.array_join(F.transform(detect.design_patterns(F.col("content")), lambda x: F.concat(x["pattern"], F.lit(":"), x["confidence"])), ",")
    return files.select("form", found.alias("patterns")).groupBy("form", "patterns").agg(F.count("*").alias("n"))


def _signs(spark, d, forms):
    pick = F.element_at(F.array(*[F.lit(x) for x in forms]), (F.col("k") % len(forms) + 1).cast("int"))
    return synthetic.files(spark, d).select("path", "k", pick.alias("content"))


@query("r15_middleware", f"WITH {FILES} SELECT CASE k % 3 WHEN 0 THEN 'express' ELSE 'fastapi' END AS framework, count(*) AS files, CAST(sum(CASE k % 3 WHEN 0 THEN 2 ELSE 1 END) AS BIGINT) AS n FROM files WHERE k % 3 < 2 GROUP BY 1")
def r15(spark, d):
    """Middleware and injection by framework."""
    x = _signs(spark, d, ["app.use(a); router.use(b)", "def f(x = Depends(y)): ...", "nothing"])
    return detect.sign_counts(x, detect.MIDDLEWARE, "framework").groupBy("framework").agg(F.count("*").alias("files"), F.sum("n").alias("n"))


@query("r16_edge_cases", f"WITH {FILES} SELECT CASE k % 4 WHEN 0 THEN 'uncleared_timer' WHEN 1 THEN 'unhandled_race' WHEN 2 THEN 'leaking_listener' ELSE '' END AS cases, count(*) AS n FROM files GROUP BY 1")
def r16(spark, d):
    """Hazards without the guard that belongs to them."""
    x = _signs(spark, d, ["setTimeout(f, 1)", "Promise.race([a, b])", "s.on('x', f)", "setTimeout(f); clearTimeout(t); s.on('x', f); s.off('x', f)"])
    return x.groupBy(F.array_join(detect.edge_cases(F.col("content")), ",").alias("cases")).agg(F.count("*").alias("n"))


@query("r17_test_patterns", f"WITH {FILES} SELECT sign, count(*) AS files FROM files, (VALUES (0, 'suite'), (0, 'case'), (0, 'assertion'), (1, 'case'), (1, 'assertion'), (1, 'setup')) t(f, sign) WHERE k % 3 = f GROUP BY 1")
def r17(spark, d):
    """What tests are made of."""
    x = _signs(spark, d, ["describe('a', () => { it('works', () => { expect(1) }) })", "def setUp(self): ...\ndef test_it():\n    assert x", "code()"])
    return detect.sign_counts(x, detect.TESTS, "sign").groupBy("sign").agg(F.count("*").alias("files"))


@query("r17_test_examples", f"WITH {FILES} SELECT path, CASE k % 2 WHEN 0 THEN 'works' ELSE 'test_it' END AS title FROM files")
def r17_examples(spark, d):
    return detect.test_examples(_signs(spark, d, ["it('works', f)", "def test_it():\n    ..."]))


@query("r18_dynamic_calls", f"WITH {FILES} SELECT sign, CAST(count(*) AS BIGINT) AS files FROM files, (VALUES (0, 'import'), (0, 'require'), (1, 'literal_import'), (1, 'eval'), (2, 'importlib')) t(f, sign) WHERE k % 3 = f GROUP BY 1")
def r18(spark, d):
    """Imports and calls that only a run can resolve."""
    x = _signs(spark, d, ["import(name); require(x)", "import('./a'); eval(y)", "m = importlib.import_module(n)"])
    return detect.sign_counts(x, detect.DYNAMIC, "sign").groupBy("sign").agg(F.count("*").alias("files"))


@query("t15_ast_search", f"WITH {FILES} SELECT path, 'C' || k || '.run' AS name, CAST(6 AS BIGINT) AS line FROM files WHERE language = 'py'")
def t15(spark, d):
    """Python elements whose syntax tree fits: methods with a branch, two parameters and no docstring."""
    e = extract.elements(extract.facts(synthetic.files(spark, d).where("language = 'py'")))
    return e.where("type = 'method' and cyclomatic > 1 and size(parameters) = 2 and doc is null").select(F.col("file").alias("path"), "name", "line")


@query("a37_pattern_counts", f"WITH {FILES} SELECT 'ts' AS language, pattern, CAST(count(*) AS BIGINT) AS files FROM files, (VALUES ('try_catch'), ('async')) t(pattern) WHERE k % 2 = 0 AND language = 'ts' GROUP BY ALL UNION ALL SELECT 'py', 'async', count(*) FROM files WHERE k % 2 = 0 AND language = 'py'")
def a37(spark, d):
    """How often constructs stand in the sources of each language."""
    from ..operators import context

    x = synthetic.files(spark, d).select("path", "k", "language", F.when((F.col("k") % 2 == 0) & (F.col("language") == "ts"), "async function f() { try { x() } catch (e) { } }").when(F.col("k") % 2 == 0, "async def f(): ...").otherwise("x()").alias("content"))
    return context.pattern_counts(x).select("language", "pattern", "files")
