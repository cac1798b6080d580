"""Name resolution, neighbourhoods, fan-in and fan-out, walks, cycles: queries over the graph of the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import graph as g
from ..sources import projections as p

N, E, S = p.SQL_NODES, p.SQL_EDGES, p.SQL_STEPS
R = "SELECT * FROM edges WHERE status = 'resolved'"


@query("p01_resolve", f"WITH {N} SELECT id, name, type, file, CAST(6 AS INT) AS tier FROM nodes WHERE lower(id) LIKE '%asia%' OR lower(name) LIKE '%asia%' OR lower(file) LIKE '%asia%'")
def p01(spark, d):
    """Substring tier of name resolution."""
    return g.resolve(p.nodes(spark, d), "asia").select("id", "name", "type", "file", "tier")


@query("p01_resolve_file", f"WITH {N} SELECT id, name, CAST(4 AS INT) AS tier FROM nodes WHERE file = 'nation/3'")
def p01_file(spark, d):
    """A file resolves to all its elements."""
    return g.resolve(p.nodes(spark, d), "nation/3").select("id", "name", "tier")


@query("p02_status_filter", f"WITH {E} SELECT rel, count(*) AS n FROM edges WHERE status = 'resolved' AND src IS NOT NULL AND tgt IS NOT NULL GROUP BY rel")
def p02(spark, d):
    return g.resolved(p.edges(spark, d)).groupBy("rel").agg(F.count("*").alias("n"))


_TIER = "CASE WHEN status = 'resolved' AND reason = 'field_based_acg' THEN 'heuristic' WHEN status = 'resolved' AND ev = 'provisional' THEN 'heuristic' WHEN status = 'resolved' THEN 'exact' WHEN status IN ('external','builtin','typeOnly','dynamic') THEN 'strong' ELSE 'inferred' END"
_TIERED = f"t AS (SELECT *, {_TIER} AS tier FROM (SELECT *, CASE WHEN line = 2 THEN 'field_based_acg' END AS reason, CASE WHEN line = 3 THEN 'provisional' END AS ev FROM edges))"


def _tiered(spark, d):
    e = p.edges(spark, d)
    return e.withColumn("tier", g.confidence(F.col("status"), F.when(F.col("line") == 2, "field_based_acg"), F.when(F.col("line") == 3, "provisional")))


@query("p03_confidence_tiers", f"WITH {E}, {_TIERED} SELECT rel, status, tier, count(*) AS n FROM t GROUP BY ALL")
def p03(spark, d):
    return _tiered(spark, d).groupBy("rel", "status", "tier").agg(F.count("*").alias("n"))


@query("p04_min_confidence", f"WITH {E}, {_TIERED} SELECT rel, count(*) AS n FROM t WHERE tier IN ('exact', 'strong') GROUP BY rel")
def p04(spark, d):
    return _tiered(spark, d).where(g.meets(F.col("tier"), "strong")).groupBy("rel").agg(F.count("*").alias("n"))


@query("p07_find_element", f"WITH {N} SELECT id, name, type, file FROM nodes WHERE type = 'customer' AND (lower(name) LIKE '%00012%' OR lower(file) LIKE '%00012%' OR lower(id) LIKE '%00012%') ORDER BY name = 'Customer#000000012' DESC, name, id LIMIT 25")
def p07(spark, d):
    """Substring search with a type filter, the exact name first."""
    n = p.nodes(spark, d).where(F.col("type") == "customer")
    hit = F.lower("name").contains("00012") | F.lower("file").contains("00012") | F.lower("id").contains("00012")
    return n.where(hit).orderBy((F.col("name") == "Customer#000000012").desc(), "name", "id").limit(25).select("id", "name", "type", "file")


@query("p08_unresolved_edges", f"WITH {E}, b AS (SELECT status, count(*) AS total FROM edges WHERE status IN ('unresolved','ambiguous') GROUP BY 1) SELECT status, total, (SELECT count(*) FROM edges e WHERE e.status = b.status AND rel = 'call' AND tgt LIKE '@S/%') AS matching FROM b")
def p08(spark, d):
    """Statuses before the filters, and what the filters leave."""
    e = p.edges(spark, d).where(F.col("status").isin("unresolved", "ambiguous"))
    return e.groupBy("status").agg(F.count("*").alias("total"), F.count_if((F.col("rel") == "call") & F.col("tgt").startswith("@S/")).alias("matching"))


@query("p12_what_exports", f"WITH {N}, f AS (SELECT file, min(file = 'nation/7') AS exact FROM nodes WHERE file LIKE '%nation/7%' GROUP BY 1) SELECT id, name, type FROM nodes WHERE file = 'nation/7' AND type = 'supplier'")
def p12(spark, d):
    """Exported elements (suppliers) of a file, by exact file."""
    return p.nodes(spark, d).where((F.col("file") == "nation/7") & (F.col("type") == "supplier")).select("id", "name", "type")


@query("p13_concise", f"WITH {N} SELECT id, name, type, file, line FROM nodes WHERE type IN ('nation','region')")
def p13(spark, d):
    return p.nodes(spark, d).where(F.col("type").isin("nation", "region")).select("id", "name", "type", "file", "line")


@query("j01_enriched_callers", f"WITH {N}, {E} SELECT src_type, tgt_type, rel, count(*) AS n FROM (SELECT coalesce(a.type,'unknown') AS src_type, coalesce(b.type,'unknown') AS tgt_type, rel FROM edges LEFT JOIN nodes a ON a.id = src LEFT JOIN nodes b ON b.id = tgt) GROUP BY ALL")
def j01(spark, d):
    """Edges by the types of their ends; those of one type to one element are counted before they travel to it."""
    n = p.nodes(spark, d).select("id", "name", "type")
    to = g.enrich(p.edges(spark, d), n, "src").groupBy("src_type", "tgt", "rel").agg(F.count("*").alias("n"))
    return g.enrich(to, n, "tgt").groupBy("src_type", "tgt_type", "rel").agg(F.sum("n").alias("n"))


@query("j08_semi_anti", "SELECT c_mktsegment, count(*) AS idle FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 300000) GROUP BY 1")
def j08(spark, d):
    """Elements without a matching reference."""
    o = p.read(spark, d, "orders").where("o_orderstatus = 'F' and o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return p.read(spark, d, "customer").join(o, "c_custkey", "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("idle"))


_PLACED = """placed AS (SELECT id, CASE WHEN type = 'part' AND line % 5 = 0 THEN 'src/__tests__/p' || line || '.ts' WHEN type = 'supplier' AND line % 4 = 1 THEN 'examples/s' || line || '.ts'
  WHEN type = 'supplier' AND line % 4 = 2 THEN 'src/demo-' || line || '.ts' ELSE 'src/' || file || '.ts' END AS file FROM nodes)"""


def placed(spark, d):
    """Elements in source files; some parts in test files, some suppliers in demo files."""
    line = F.col("line").cast("string")
    part, supplier = F.col("type") == "part", F.col("type") == "supplier"
    file = (
        F.when(part & (F.col("line") % 5 == 0), F.concat(F.lit("src/__tests__/p"), line, F.lit(".ts")))
        .when(supplier & (F.col("line") % 4 == 1), F.concat(F.lit("examples/s"), line, F.lit(".ts")))
        .when(supplier & (F.col("line") % 4 == 2), F.concat(F.lit("src/demo-"), line, F.lit(".ts")))
        .otherwise(F.concat(F.lit("src/"), "file", F.lit(".ts")))
    )
    return p.nodes(spark, d).select("id", file.alias("file"))


@query(
    "a01_hotspots",
    rf"""
WITH {N}, {E}, {_PLACED}, r AS (SELECT * FROM edges WHERE status = 'resolved' AND rel IN ('call', 'import') AND line <> 5), i AS (SELECT tgt AS id, count(*) AS n FROM r GROUP BY 1), o AS (SELECT src AS id, count(*) AS n FROM r GROUP BY 1),
x AS (SELECT coalesce(i.id, o.id) AS id, CAST(coalesce(i.n, 0) AS BIGINT) AS fan_in, CAST(coalesce(o.n, 0) AS BIGINT) AS fan_out FROM i FULL JOIN o ON i.id = o.id)
SELECT id, fan_in, fan_out, fan_in + fan_out AS score FROM x JOIN placed USING (id)
WHERE NOT regexp_matches(file, '__tests__|\.test\.|\.spec\.|(^|/)examples/|(^|/)demo-[^/]*\.(ts|tsx|js|jsx|mjs|cjs)$') ORDER BY score DESC, id LIMIT 25""",
)
def a01(spark, d):
    """Hotspots of the source: edges of line five come from tests, and test and demo files aren't ranked."""
    return g.hotspots(p.edges(spark, d).withColumn("test_origin", F.col("line") == 5), placed(spark, d))


_FILES = "w AS (SELECT a.file AS sf, b.file AS tf, rel FROM edges JOIN nodes a ON a.id = src JOIN nodes b ON b.id = tgt WHERE status = 'resolved' AND a.file <> b.file)"


def _file_edges(spark, d):
    n = p.nodes(spark, d)
    e = g.resolved(p.edges(spark, d))
    e = e.join(n.select(F.col("id").alias("src"), F.col("file").alias("sf")), "src").join(n.select(F.col("id").alias("tgt"), F.col("file").alias("tf")), "tgt")
    return e.where("sf <> tf").select("sf", "tf", "rel")


@query("a02_file_edges", f"WITH {N}, {E}, {_FILES} SELECT sf, tf, count(*) AS weight, count(*) FILTER (rel = 'call') AS calls, count(*) FILTER (rel = 'import') AS imports FROM w GROUP BY 1, 2")
def a02(spark, d):
    """Weighted edges between files; an edge inside one file doesn't count."""
    return _file_edges(spark, d).groupBy("sf", "tf").agg(F.count("*").alias("weight"), F.count_if(F.col("rel") == "call").alias("calls"), F.count_if(F.col("rel") == "import").alias("imports"))


@query("a03_file_nodes", f"WITH {N}, c AS (SELECT file, layer, count(*) AS n FROM nodes GROUP BY ALL), m AS (SELECT file, layer FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY n DESC, layer) AS k FROM c WHERE layer IS NOT NULL) WHERE k = 1) SELECT n.file, count(*) AS elements, any_value(m.layer) AS layer FROM nodes n LEFT JOIN m ON n.file = m.file GROUP BY n.file")
def a03(spark, d):
    """Elements of a file and its majority layer, the least on ties."""
    c = p.nodes(spark, d).groupBy("file", "layer").agg(F.count("*").alias("n"))
    best = F.min_by("layer", F.when(F.col("layer").isNotNull(), F.struct(-F.col("n"), "layer")))
    return c.groupBy("file").agg(F.sum("n").cast("long").alias("elements"), best.alias("layer"))


@query("a04_coupling", f"WITH {N}, {E}, {_FILES}, p AS (SELECT DISTINCT sf, tf FROM w), o AS (SELECT sf AS file, count(*) AS ce FROM p GROUP BY 1), i AS (SELECT tf AS file, count(*) AS ca FROM p GROUP BY 1) SELECT coalesce(o.file, i.file) AS file, CAST(coalesce(ce, 0) AS BIGINT) AS ce, CAST(coalesce(ca, 0) AS BIGINT) AS ca, floor(coalesce(ce, 0) * 1000.0 / (coalesce(ce, 0) + coalesce(ca, 0)) + 0.5) / 1000 AS instability FROM o FULL JOIN i ON o.file = i.file")
def a04(spark, d):
    """Distinct neighbours both ways and instability."""
    pairs = _file_edges(spark, d).select("sf", "tf").distinct()
    half = pairs.select(F.explode(F.array(F.struct(F.col("sf").alias("file"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("tf").alias("file"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("h"))
    out = half.groupBy("h.file").agg(F.sum("h.o").cast("long").alias("ce"), F.sum("h.i").cast("long").alias("ca"))
    return out.withColumn("instability", F.floor(F.col("ce") * 1000.0 / (F.col("ce") + F.col("ca")) + 0.5) / 1000)


@query("a05_dead_code", f"WITH {N}, {E}, r AS ({R}), x AS (SELECT id, type, EXISTS (SELECT 1 FROM r WHERE tgt = id) AS used, EXISTS (SELECT 1 FROM r WHERE src = id) AS uses FROM nodes) SELECT type, count(*) FILTER (NOT used AND NOT uses) AS isolated, count(*) FILTER (NOT used AND uses) AS unused, count(*) FILTER (used) AS live FROM x GROUP BY type")
def a05(spark, d):
    """Isolated, unused and live elements by type."""
    x = p.nodes(spark, d).select("id", "type").join(g.degrees(g.resolved(p.edges(spark, d))), "id", "left").na.fill(0, ["fan_in", "fan_out"])
    return x.groupBy("type").agg(F.count_if((F.col("fan_in") == 0) & (F.col("fan_out") == 0)).alias("isolated"), F.count_if((F.col("fan_in") == 0) & (F.col("fan_out") > 0)).alias("unused"), F.count_if(F.col("fan_in") > 0).alias("live"))


_LAYERS = "l AS (SELECT a.layer AS sl, b.layer AS tl, count(*) AS n FROM edges JOIN nodes a ON a.id = src JOIN nodes b ON b.id = tgt WHERE status = 'resolved' AND a.layer IS NOT NULL AND b.layer IS NOT NULL GROUP BY 1, 2)"


def _layers(spark, d):
    n = p.nodes(spark, d).where("layer is not null")
    e = g.resolved(p.edges(spark, d))
    e = e.join(n.select(F.col("id").alias("src"), F.col("layer").alias("sl")), "src").join(n.select(F.col("id").alias("tgt"), F.col("layer").alias("tl")), "tgt")
    return e.groupBy("sl", "tl").agg(F.count("*").alias("n"))


@query("a06_layer_matrix", f"WITH {N}, {E}, {_LAYERS} SELECT * FROM l")
def a06(spark, d):
    return _layers(spark, d)


@query("r08_dependency_rules", f"WITH {N}, {E}, {_LAYERS}, k(kind, f, t) AS (VALUES ('forbid','1-URGENT','BUILDING'), ('forbid','BUILDING','1-URGENT'), ('allow','5-LOW','MACHINERY')) SELECT kind, f AS from_layer, t AS to_layer, CASE WHEN kind = 'forbid' AND n > 0 THEN 'violated' WHEN kind = 'forbid' THEN 'satisfied' WHEN n > 0 THEN 'satisfied' ELSE 'not_applicable' END AS outcome, CAST(coalesce(n, 0) AS BIGINT) AS n FROM k LEFT JOIN l ON sl = f AND tl = t")
def r08(spark, d):
    """Forbidden and allowed layer edges."""
    rules = spark.createDataFrame([("forbid", "1-URGENT", "BUILDING"), ("forbid", "BUILDING", "1-URGENT"), ("allow", "5-LOW", "MACHINERY")], "kind string, sl string, tl string")
    x = rules.join(_layers(spark, d), ["sl", "tl"], "left").na.fill(0, ["n"])
    outcome = F.when((F.col("kind") == "forbid") & (F.col("n") > 0), "violated").when(F.col("kind") == "forbid", "satisfied").when(F.col("n") > 0, "satisfied").otherwise("not_applicable")
    return x.select("kind", F.col("sl").alias("from_layer"), F.col("tl").alias("to_layer"), outcome.alias("outcome"), "n")


@query("a09_validation_report", f"WITH {E} SELECT count(*) AS edges, count(*) FILTER (status = 'resolved') AS resolved, count(*) FILTER (status = 'ambiguous') AS ambiguous, count(*) FILTER (status = 'unresolved') AS unresolved, floor(count(*) FILTER (status = 'resolved') * 10000.0 / count(*) + 0.5) / 100 AS rate FROM edges")
def a09(spark, d):
    s = F.col("status")
    e = p.edges(spark, d).agg(F.count("*").alias("edges"), *[F.count_if(s == x).alias(x) for x in ("resolved", "ambiguous", "unresolved")])
    return e.withColumn("rate", F.when(F.col("edges") > 0, F.floor(F.col("resolved") * 10000.0 / F.col("edges") + 0.5) / 100).otherwise(100.0))


@query("a10_graph_statistics", f"WITH {N}, {E} SELECT (SELECT count(*) FROM nodes) AS nodes, count(*) AS edges, count(*) FILTER (rel = 'call') AS calls, count(*) FILTER (rel = 'import') AS imports, round(count(*) / ((SELECT count(*) FROM nodes) * ((SELECT count(*) FROM nodes) - 1.0)), 12) AS density FROM edges")
def a10(spark, d):
    e = p.edges(spark, d).agg(F.count("*").alias("edges"), F.count_if(F.col("rel") == "call").alias("calls"), F.count_if(F.col("rel") == "import").alias("imports"))
    n = p.nodes(spark, d).agg(F.count("*").alias("nodes"))
    return e.join(F.broadcast(n)).select("nodes", "edges", "calls", "imports", F.round(F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1.0)), 12).alias("density"))  # one row each


@query("a25_unresolved_by_file", f"WITH {N}, {E} SELECT file, count(*) FILTER (status = 'unresolved') AS unresolved, count(*) FILTER (status = 'ambiguous') AS ambiguous FROM edges JOIN nodes ON id = src WHERE status <> 'resolved' GROUP BY file")
def a25(spark, d):
    e = p.edges(spark, d).where("status <> 'resolved'").groupBy("src").agg(*[F.count_if(F.col("status") == x).alias(x) for x in ("unresolved", "ambiguous")])
    e = e.join(p.nodes(spark, d).select(F.col("id").alias("src"), "file"), "src")
    return e.groupBy("file").agg(F.sum("unresolved").cast("long").alias("unresolved"), F.sum("ambiguous").cast("long").alias("ambiguous"))


@query("a27_summary", f"WITH {N} SELECT type, count(*) AS n, count(DISTINCT file) AS files, round(count(layer) * 100.0 / count(*), 4) AS layered FROM nodes GROUP BY type")
def a27(spark, d):
    return p.nodes(spark, d).groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("file").alias("files"), F.round(F.count("layer") * 100.0 / F.count("*"), 4).alias("layered"))


_ENTRY = "(regexp_matches(file, '^(index|main|app|server|cli|bin)') OR regexp_matches(file, '(^|/)(bin|cli|scripts)(/|$)'))"


@query("w01_span_ends", f"WITH {N} SELECT id, file, line, lead(line) OVER (PARTITION BY file ORDER BY line, id) - 1 AS end_line FROM nodes")
def w01(spark, d):
    """An element ends where the next one of its file starts."""
    w = Window.partitionBy("file").orderBy("line", "id")
    return p.nodes(spark, d).select("id", "file", "line", (F.lead("line").over(w) - 1).alias("end_line"))


@query("w02_top_n_per_file", f"WITH {N} SELECT file, id, k, n, n > 3 AS truncated FROM (SELECT file, id, row_number() OVER (PARTITION BY file ORDER BY line, id) AS k, count(*) OVER (PARTITION BY file) AS n FROM nodes) WHERE k <= 3")
def w02(spark, d):
    w = Window.partitionBy("file")
    x = p.nodes(spark, d).select("file", "id", F.row_number().over(w.orderBy("line", "id")).cast("long").alias("k"), F.count("*").over(w).alias("n"))
    return x.where("k <= 3").withColumn("truncated", F.col("n") > 3)


@query("w07_stride_sample", f"WITH {N}, x AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS n FROM nodes) SELECT id FROM x WHERE i % CAST(ceil(n / 200.0) AS BIGINT) = 0")
def w07(spark, d):
    """Every k-th element in id order: ranks come from partition offsets of a range sort, so no task holds all rows."""
    ids = p.nodes(spark, d).select("id").repartitionByRange("id").sortWithinPartitions("id").withColumn("part", F.spark_partition_id())
    ids = g.checkpointed(ids)
    sizes = ids.groupBy("part").agg(F.count("*").alias("n"))
    w = Window.orderBy("part")
    offsets = sizes.select("part", (F.sum("n").over(w) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))  # a row a partition
    x = ids.join(F.broadcast(offsets), "part").withColumn("i", F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy("id")) - 1)
    return x.where(F.col("i") % F.ceil(F.col("total") / 200.0) == 0).select("id")


@query("l01_page", f"WITH {N} SELECT id, name, count(*) OVER () AS total, (SELECT count(*) FROM nodes WHERE type = 'part') > 75 AS has_more FROM nodes WHERE type = 'part' ORDER BY name, id LIMIT 25 OFFSET 50")
def l01(spark, d):
    """One page with the total and whether more follow."""
    parts = p.nodes(spark, d).where("type = 'part'").select("id", "name")
    total = parts.agg(F.count("*").alias("total"))
    return parts.orderBy("name", "id").offset(50).limit(25).join(F.broadcast(total)).withColumn("has_more", F.col("total") > 75)  # one row


@query("g01_callers", f"WITH {E}, r AS ({R}) SELECT DISTINCT src AS id FROM r WHERE rel = 'call' AND tgt = '@S/3'")
def g01(spark, d):
    """Distinct callers of an element."""
    return g.resolved(p.edges(spark, d)).where("rel = 'call' and tgt = '@S/3'").select(F.col("src").alias("id")).distinct()


@query("g02_what_calls", f"WITH {E}, {N}, r AS ({R}) SELECT src AS id, coalesce(type, 'unknown') AS type, e.line FROM r e LEFT JOIN nodes n ON n.id = src WHERE rel = 'call' AND tgt = '@P/7'")
def g02(spark, d):
    """One row per call edge."""
    e = g.resolved(p.edges(spark, d)).where("rel = 'call' and tgt = '@P/7'").select("src", "line")
    n = p.nodes(spark, d).select(F.col("id").alias("src"), "type")
    return e.join(n, "src", "left").select(F.col("src").alias("id"), F.coalesce("type", F.lit("unknown")).alias("type"), "line")


@query("g03_impact_of", f"WITH RECURSIVE {E}, r AS (SELECT DISTINCT src, tgt FROM edges WHERE status = 'resolved'), b(id, depth) AS (SELECT '@N/5', 0 UNION SELECT src, depth + 1 FROM b JOIN r ON tgt = id WHERE depth < 3) SELECT id, CAST(min(depth) AS INT) AS depth FROM b GROUP BY id HAVING min(depth) > 0")
def g03(spark, d):
    """What depends on a nation within three steps, at first depth."""
    return g.reach(g.resolved(p.edges(spark, d)), spark.createDataFrame([("@N/5",)], "id string"), 3)


@query("a19_impact_by_file", f"WITH RECURSIVE {E}, {N}, r AS (SELECT DISTINCT src, tgt FROM edges WHERE status = 'resolved'), b(id, depth) AS (SELECT '@R/1', 0 UNION SELECT src, depth + 1 FROM b JOIN r ON tgt = id WHERE depth < 2), x AS (SELECT id, min(depth) AS depth FROM b GROUP BY id HAVING min(depth) > 0) SELECT file, count(*) AS dependents, CAST(min(depth) AS INT) AS depth FROM x JOIN nodes USING (id) GROUP BY file")
def a19(spark, d):
    """Dependents of a region by file."""
    x = g.reach(g.resolved(p.edges(spark, d)), spark.createDataFrame([("@R/1",)], "id string"), 2)
    return x.join(p.nodes(spark, d).select("id", "file"), "id").groupBy("file").agg(F.count("*").alias("dependents"), F.min("depth").alias("depth"))


@query("g04_dependencies_of", f"WITH RECURSIVE {E}, r AS (SELECT DISTINCT src, tgt FROM edges WHERE status = 'resolved'), b(id, depth) AS (SELECT '@O/7', 0 UNION SELECT tgt, depth + 1 FROM b JOIN r ON src = id WHERE depth < 5) SELECT id, CAST(min(depth) AS INT) AS depth FROM b GROUP BY id HAVING min(depth) > 0")
def g04(spark, d):
    return g.reach(g.resolved(p.edges(spark, d)), spark.createDataFrame([("@O/7",)], "id string"), 5, inbound=False)


@query("g05_shortest_path", f"WITH RECURSIVE {S}, b(pos, hops) AS (SELECT CAST(1 AS BIGINT), 0 UNION SELECT tgt, hops + 1 FROM b JOIN steps ON src = pos WHERE hops < 10) SELECT CAST(min(hops) AS INT) AS hops FROM b WHERE pos = 40 HAVING min(hops) IS NOT NULL")
def g05(spark, d):
    return g.shortest_path(p.steps(spark, d), 1, 40).select("hops")


@query("g06_all_paths", f"WITH RECURSIVE {S}, s AS (SELECT * FROM steps), b(pos, path) AS (SELECT tgt, [src, tgt] FROM s WHERE src = 1 UNION ALL SELECT tgt, list_append(path, tgt) FROM b JOIN s ON src = pos WHERE pos <> 5 AND len(path) < 4 AND NOT list_contains(path, tgt)) SELECT CAST(len(path) - 1 AS INT) AS hops, array_to_string(path, '>') AS path FROM b WHERE pos = 5")
def g06(spark, d):
    """Simple paths of at most three hops."""
    return g.all_paths(p.steps(spark, d), 1, 5, 3).select("hops", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query("g07_cycles", f"WITH RECURSIVE {S}, s AS (SELECT src, tgt FROM steps WHERE src <> tgt), r AS (SELECT src AS a, tgt AS b FROM s UNION SELECT r.a, s.tgt FROM r JOIN s ON r.b = s.src), m AS (SELECT x.a AS id, x.b AS o FROM r x JOIN r y ON x.a = y.b AND x.b = y.a) SELECT id, least(min(o), id) AS component FROM m GROUP BY id HAVING count(*) FILTER (o <> id) > 0")
def g07(spark, d):
    """Elements on cycles with the smallest id of their component."""
    return g.strong_components(p.steps(spark, d))


@query("g12_tests_for_change", f"WITH RECURSIVE {E}, {N}, r AS (SELECT DISTINCT src, tgt FROM edges WHERE status = 'resolved'), b(id, depth) AS (SELECT id, 0 FROM nodes WHERE id IN ('@P/1','@P/2','@S/1') UNION SELECT src, depth + 1 FROM b JOIN r ON tgt = id WHERE depth < 3), x AS (SELECT id, min(depth) AS depth FROM b GROUP BY id HAVING min(depth) > 0) SELECT file, count(*) AS tests, CAST(min(depth) AS INT) AS depth FROM x JOIN nodes USING (id) WHERE file LIKE 'customer/%' AND file LIKE '%7' GROUP BY file")
def g12(spark, d):
    """Tests (files ending in 7) that reach a changed element, rolled up by file."""
    seeds = spark.createDataFrame([("@P/1",), ("@P/2",), ("@S/1",)], "id string")
    x = g.reach(g.resolved(p.edges(spark, d)), seeds, 3)
    n = p.nodes(spark, d).where(F.col("file").startswith("customer/") & F.col("file").endswith("7")).select("id", "file")
    return x.join(n, "id").groupBy("file").agg(F.count("*").alias("tests"), F.min("depth").alias("depth"))


@query("g13_ego_graph", f"WITH {E}, r AS ({R}), x AS (SELECT DISTINCT 'in_' || rel AS dir, src AS id FROM r WHERE tgt = '@C/10' UNION SELECT DISTINCT 'out_' || rel, tgt FROM r WHERE src = '@C/10') SELECT dir, id, k, total FROM (SELECT dir, id, row_number() OVER (PARTITION BY dir ORDER BY id) AS k, count(*) OVER (PARTITION BY dir) AS total FROM x) WHERE k <= 25")
def g13(spark, d):
    """Neighbours in each direction and kind, at most 25 of each with the total."""
    e = g.resolved(p.edges(spark, d)).where("src = '@C/10' or tgt = '@C/10'")
    x = e.where("tgt = '@C/10'").select(F.concat(F.lit("in_"), "rel").alias("dir"), F.col("src").alias("id")).unionByName(e.where("src = '@C/10'").select(F.concat(F.lit("out_"), "rel").alias("dir"), F.col("tgt").alias("id"))).distinct()
    w = Window.partitionBy("dir")
    return x.select("dir", "id", F.row_number().over(w.orderBy("id")).cast("long").alias("k"), F.count("*").over(w).alias("total")).where("k <= 25")


@query("g18_blast_radius", f"WITH RECURSIVE {E}, r AS (SELECT DISTINCT src, tgt FROM edges WHERE status = 'resolved'), b(id, depth) AS (SELECT '@S/2', 0 UNION SELECT src, depth + 1 FROM b JOIN r ON tgt = id WHERE depth < 5), x AS (SELECT id, min(depth) AS depth FROM b GROUP BY id HAVING min(depth) > 0), c AS (SELECT count(*) FILTER (depth = 1) AS d, count(*) FILTER (depth BETWEEN 2 AND 3) AS t, count(*) FILTER (depth > 3) AS s FROM x) SELECT d AS direct, t AS transitive, s AS secondary, CAST(least(100.0, least(d * 10.0, 60.0) + least(t * 2.0, 30.0) + least(s * 0.5, 10.0)) AS DOUBLE) AS risk FROM c")
def g18(spark, d):
    x = g.reach(g.resolved(p.edges(spark, d)), spark.createDataFrame([("@S/2",)], "id string"), 5)
    c = x.agg(F.count_if(F.col("depth") == 1).alias("direct"), F.count_if(F.col("depth").between(2, 3)).alias("transitive"), F.count_if(F.col("depth") > 3).alias("secondary"))
    return c.withColumn("risk", F.least(F.lit(100.0), F.least(F.col("direct") * 10.0, F.lit(60.0)) + F.least(F.col("transitive") * 2.0, F.lit(30.0)) + F.least(F.col("secondary") * 0.5, F.lit(10.0))).cast("double"))


@query("g24_integrity", f"WITH {N}, {E} SELECT (SELECT count(*) FROM (SELECT id FROM nodes GROUP BY 1 HAVING count(*) > 1)) AS duplicate_ids, (SELECT count(*) FROM edges WHERE NOT EXISTS (SELECT 1 FROM nodes WHERE id = src)) AS dangling_sources, (SELECT count(*) FROM edges WHERE NOT EXISTS (SELECT 1 FROM nodes WHERE id = tgt)) AS dangling_targets, (SELECT count(*) FROM edges WHERE status NOT IN ('resolved','ambiguous','unresolved')) AS bad_status")
def g24(spark, d):
    """Counts of broken constraints."""
    n, e = p.nodes(spark, d).select("id"), p.edges(spark, d)
    dup = n.groupBy("id").count().where("count > 1").agg(F.count("*").alias("duplicate_ids"))
    src = e.join(n, e.src == n.id, "left_anti").agg(F.count("*").alias("dangling_sources"))
    tgt = e.join(n, e.tgt == n.id, "left_anti").agg(F.count("*").alias("dangling_targets"))
    bad = e.agg(F.count_if(~F.col("status").isin("resolved", "ambiguous", "unresolved")).alias("bad_status"))
    return dup.join(F.broadcast(src)).join(F.broadcast(tgt)).join(F.broadcast(bad))  # one row each


@query("j20_references", f"WITH {E} SELECT 'call' AS via, src AS site, line FROM edges WHERE rel = 'call' AND status = 'resolved' AND tgt = '@S/4' UNION SELECT 'import', src, line FROM edges WHERE rel = 'import' AND status = 'resolved' AND tgt = '@S/4' UNION SELECT 'candidate', src, line FROM edges WHERE status = 'ambiguous' AND tgt = '@S/4'")
def j20(spark, d):
    """All references: calls, imports and ambiguous candidates."""
    e = p.edges(spark, d).where("tgt = '@S/4' and status in ('resolved', 'ambiguous')")
    return e.select(F.when(F.col("status") == "ambiguous", "candidate").otherwise(F.col("rel")).alias("via"), F.col("src").alias("site"), "line").distinct()


@query("t18_rename_plan", f"WITH {N}, {E}, s AS (SELECT id, file, line FROM nodes WHERE name = (SELECT min(name) FROM nodes WHERE type = 'supplier')) SELECT 'declaration' AS kind, file, line FROM s UNION SELECT 'reference', n.file, e.line FROM edges e JOIN s ON e.tgt = s.id JOIN nodes n ON n.id = e.src WHERE status = 'resolved'")
def t18(spark, d):
    """Declaration and reference sites of a name."""
    n = p.nodes(spark, d)
    name = n.where("type = 'supplier'").agg(F.min("name").alias("name"))
    s = n.join(F.broadcast(name), "name").select("id", "file", "line")
    refs = g.resolved(p.edges(spark, d)).join(s.select(F.col("id").alias("tgt")), "tgt").select("src", "line").join(n.select(F.col("id").alias("src"), "file"), "src")
    return s.select(F.lit("declaration").alias("kind"), "file", "line").unionByName(refs.select(F.lit("reference").alias("kind"), "file", "line")).distinct()


@query("k04_mermaid", f"WITH {N}, {E}, x AS (SELECT DISTINCT a.name AS s, b.name AS t FROM edges JOIN nodes a ON a.id = src JOIN nodes b ON b.id = tgt WHERE a.type = 'nation' AND b.type = 'region') SELECT 'graph TD' || chr(10) || string_agg('  ' || s || ' --> ' || t, chr(10) ORDER BY s, t) AS diagram FROM x")
def k04(spark, d):
    """The nations' imports as one diagram."""
    n = p.nodes(spark, d)
    e = p.edges(spark, d).join(n.where("type = 'nation'").select(F.col("id").alias("src"), F.col("name").alias("s")), "src").join(n.where("type = 'region'").select(F.col("id").alias("tgt"), F.col("name").alias("t")), "tgt")
    lines = e.select("s", "t").distinct().agg(F.array_sort(F.collect_list(F.struct("s", "t"))).alias("x"))
    return lines.select(F.concat(F.lit("graph TD\n"), F.array_join(F.transform("x", lambda v: F.concat(F.lit("  "), v["s"], F.lit(" --> "), v["t"])), "\n")).alias("diagram"))


@query("k07_registry", f"WITH {N} SELECT id, substr(sha256(id), 1, 8) || '-' || substr(sha256(id), 9, 4) || '-' || substr(sha256(id), 13, 4) || '-' || substr(sha256(id), 17, 4) || '-' || substr(sha256(id), 21, 12) AS uuid FROM nodes")
def k07(spark, d):
    h = F.sha2("id", 256)
    return p.nodes(spark, d).select("id", F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]).alias("uuid"))


@query("edge_ids", f"WITH {E}, {N} SELECT rel, count(DISTINCT eid) AS ids FROM (SELECT rel, substr(sha1(src || ':' || rel || ':' || tgt || ':' || file || ':' || e.line), 1, 16) AS eid FROM edges e JOIN nodes ON id = src) GROUP BY rel")
def edge_ids(spark, d):
    """Edge ids: 16 hex digits of a hash over ends, kind and place."""
    e = p.edges(spark, d).join(p.nodes(spark, d).select(F.col("id").alias("src"), "file"), "src")
    eid = F.substring(F.sha1(F.concat_ws(":", "src", "rel", "tgt", "file", F.col("line").cast("string"))), 1, 16)
    return e.select("rel", eid.alias("eid")).groupBy("rel").agg(F.count_distinct("eid").alias("ids"))


@query("j16_workspace_stitch", f"WITH {N}, {E}, r AS ({R}) SELECT split_part(src, '/', 1) AS from_package, split_part(tgt, '/', 1) AS to_package, count(*) AS edges, count(DISTINCT tgt) AS symbols FROM r WHERE split_part(src, '/', 1) <> split_part(tgt, '/', 1) GROUP BY ALL")
def j16(spark, d):
    """Edges between packages."""
    a, b = F.substring_index("src", "/", 1), F.substring_index("tgt", "/", 1)
    return g.resolved(p.edges(spark, d)).select(a.alias("from_package"), b.alias("to_package"), "tgt").where("from_package <> to_package").groupBy("from_package", "to_package").agg(F.count("*").alias("edges"), F.count_distinct("tgt").alias("symbols"))


@query("a08_engineering_metrics", f"WITH {N}, {E}, x AS (SELECT n.file, e.src, e.tgt, e.status FROM edges e JOIN nodes n ON n.id = e.src) SELECT file, count(DISTINCT tgt) FILTER (status = 'resolved') AS dependencies, count(*) FILTER (status = 'unresolved') AS unresolved, count(DISTINCT src) AS sources FROM x GROUP BY file ORDER BY dependencies DESC, file LIMIT 25")
def a08(spark, d):
    """Files with most dependencies."""
    e = p.edges(spark, d).join(p.nodes(spark, d).select(F.col("id").alias("src"), "file"), "src")
    x = e.groupBy("file").agg(F.count_distinct(F.when(F.col("status") == "resolved", F.col("tgt"))).alias("dependencies"), F.count_if(F.col("status") == "unresolved").alias("unresolved"), F.count_distinct("src").alias("sources"))
    return x.orderBy(F.desc("dependencies"), "file").limit(25)
