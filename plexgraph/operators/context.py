"""Surfaces put together from the graph: symbol cards, change dossiers, task context, packed source, skeleton maps, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify
from .graph import checkpointed, reach, resolved

CAP = 25


def ego_graph(edges: DataFrame, id_: str, cap: int = CAP) -> DataFrame:
    """(direction, id, rank, total) of an element's callers, callees, importers and imports, by id, at most ``cap`` of each (0: all)."""
    e = resolved(edges).where(F.col("rel").isin("call", "import") & ((F.col("src") == id_) | (F.col("tgt") == id_)) & (F.col("src") != F.col("tgt")))
    inbound = F.col("tgt") == id_
    name = F.when(inbound & (F.col("rel") == "call"), "callers").when(inbound, "importers").when(F.col("rel") == "call", "callees").otherwise("imports")
    x = e.select(name.alias("direction"), F.when(inbound, F.col("src")).otherwise(F.col("tgt")).alias("id")).distinct()
    w = Window.partitionBy("direction")
    x = x.select("direction", "id", F.row_number().over(w.orderBy("id")).alias("rank"), F.count("*").over(w).alias("total"))
    return x.where(F.col("rank") <= cap) if cap else x


def reference_sites(edges: DataFrame, nodes: DataFrame, id_: str, cap: int = CAP) -> DataFrame:
    """One row: call, import and test sites of an element and a sample of sites by ``file:line`` as a string, then id."""
    e = edges.where((F.col("tgt") == id_) & F.col("rel").isin("call", "import") & (F.col("status") == "resolved"))
    x = e.select("src", "rel", "line").join(nodes.select(F.col("id").alias("src"), F.col("file").alias("src_file")), "src", "left")
    at = F.concat_ws(":", "src_file", F.col("line").cast("string"))
    x = x.select("rel", F.col("src").alias("id"), at.alias("at"), classify.is_test_file(F.col("src_file")).alias("test"))
    counts = x.agg(F.count_if(F.col("rel") == "call").alias("call_sites"), F.count_if(F.col("rel") == "import").alias("import_sites"), F.count_if("test").alias("test_refs"))
    few = x.orderBy("at", "id").limit(cap).agg(F.array_sort(F.collect_list(F.struct("at", "id"))).alias("sample"))  # at most ``cap`` rows
    few_tests = x.where("test").orderBy("at", "id").limit(cap).agg(F.array_sort(F.collect_list(F.struct("at", "id"))).alias("test_sample"))
    total = F.col("call_sites") + F.col("import_sites")
    return counts.join(F.broadcast(few)).join(F.broadcast(few_tests)).select("*", total.alias("total"), (total > cap).alias("truncated"))  # one row each


def symbol_context(edges: DataFrame, nodes: DataFrame, headers: DataFrame, id_: str, graph_time: int, cap: int = CAP) -> DataFrame:
    """One row about an element: identity, header, neighbourhood, references, test linkage and whether its file is newer.

    ``headers``: id, status, exported, layer, capability, file_time; an element without one counts as missing and not exported, and an
    unknown file time as not stale. No row for an unknown element.
    """
    own = nodes.where(F.col("id") == id_).select("id", "name", "type", "file", "line").limit(1)
    head = headers.where(F.col("id") == id_).select("id", F.col("status").alias("_s"), "exported", "layer", "capability", "file_time").limit(1)
    own = own.join(head, "id", "left")
    near = ego_graph(edges, id_, cap).groupBy("direction").agg(F.max("total").alias("total"), F.array_sort(F.collect_list("id")).alias("ids"))
    near = near.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("direction", F.struct("total", "ids"))))).alias("neighbourhood"))  # four rows
    out = own.join(F.broadcast(reference_sites(edges, nodes, id_, cap))).join(F.broadcast(near))  # one row each
    return out.select(
        "id", "name", "type", "file", "line", F.coalesce("_s", F.lit("missing")).alias("header_status"), F.coalesce("exported", F.lit(False)).alias("exported"), "layer", "capability",
        "neighbourhood", "call_sites", "import_sites", "total", "sample", "truncated", "test_refs", "test_sample", F.coalesce(F.col("file_time") > graph_time, F.lit(False)).alias("stale"),
    )


def change_dossier(changed: DataFrame, edges: DataFrame, nodes: DataFrame, api: DataFrame | None = None, rules: DataFrame | None = None, depth: int = 3) -> DataFrame:
    """(leg, name, n) rows of what a change (id) touches: impact, tests, api and rules; an absent leg is one row of no_data.

    ``api``: change (added, removed, changed, unchanged) a key. ``rules``: outcome a rule.
    """
    e = resolved(edges).where(F.col("rel").isin("call", "import"))
    found = checkpointed(reach(e, changed, max(1, min(10, depth))).join(nodes.select("id", "file"), "id", "left"))
    row = lambda leg, df: df.select(F.lit(leg).alias("leg"), "name", F.col("n").cast("long").alias("n"))
    impact = found.agg(F.count("*").alias("transitive_dependents"), F.count_distinct("file").alias("affected_files"))
    impact = impact.join(F.broadcast(changed.join(nodes.select("id", "file"), "id", "left").agg(F.count_distinct("id").alias("changed_elements"), F.count_distinct("file").alias("changed_files"))))  # one row each
    wide = lambda df: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in df.columns])).alias("x")).select("x.name", "x.n")
    tests = found.where(classify.is_test_file(F.col("file"))).agg(F.count("*").alias("selected_tests"), F.count_distinct("file").alias("test_files"))
    parts = [row("impact", wide(impact)), row("tests", wide(tests))]
    none = changed.sparkSession.createDataFrame([("no_data", 1)], "name string, n long")
    parts.append(row("api", none if api is None else api.groupBy(F.col("change").alias("name")).agg(F.count("*").alias("n"))))
    parts.append(row("rules", none if rules is None else rules.groupBy(F.col("outcome").alias("name")).agg(F.count("*").alias("n"))))
    return reduce(DataFrame.unionByName, parts)


def task_elements(elements: DataFrame, keywords: list[str], names: list[str] | None = None, patterns: list[str] | None = None, most: float | None = None, only_exported: bool = False) -> DataFrame:
    """Elements (name, file, complexity, exported) that hold any keyword in name or file and meet all further conditions, with
    ``by_name``: whether the name holds one; those come first."""
    any_of = lambda c: reduce(lambda a, k: a | F.lower(c).contains(k.lower()), keywords, F.lit(False))
    x = elements.where(any_of(F.col("name")) | any_of(F.col("file")))
    x = x.where(F.col("name").isin(*names)) if names else x
    x = x.where(reduce(lambda a, p: a | F.col("file").rlike(p), patterns, F.lit(False))) if patterns else x
    x = x.where(F.col("complexity") <= most) if most else x
    x = x.where("exported") if only_exported else x
    return x.withColumn("by_name", any_of(F.col("name")))


def impact_scopes(elements: DataFrame, edges: DataFrame, depth: int = 25) -> DataFrame:
    """(id, direct, indirect, scope, risk) of every element (id): one, its dependents and all they reach, counted.

    Every element walks at once: pairs (element, dependent) grow level by level and end when none is new.
    """
    step = checkpointed(resolved(edges).select(F.col("tgt").alias("at"), F.col("src").alias("next")).where("at <> next").distinct().repartition("at"))
    front = elements.select("id").distinct().join(step.withColumnRenamed("at", "id"), "id").select("id", F.col("next").alias("at"))
    seen = front = checkpointed(front)
    direct = front.groupBy("id").agg(F.count("*").alias("direct"))
    for _ in range(depth):
        front = checkpointed(front.join(step, "at").select("id", F.col("next").alias("at")).distinct().join(seen, ["id", "at"], "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    all_ = seen.groupBy("id").agg(F.count("*").alias("indirect"))
    x = elements.select("id").distinct().join(direct, "id", "left").join(all_, "id", "left").na.fill(0, ["direct", "indirect"])
    scope = 1 + F.col("direct") + F.col("indirect")
    return x.withColumn("scope", scope).withColumn("risk", F.when(scope <= 2, "low").when(scope <= 5, "medium").when(scope <= 10, "high").otherwise("critical"))


def tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.char_length(text) / 4.0)


#: A line that declares or heads something, and an indented line that doesn't.
_SIGNATURE = r"^\s*(?:(?:async|class|const|export|function|import|interface|let|private|protected|public|type|var) |#)"
_BODY = r"^\s{2,}[^#\-*\s]"


def compressed(text: Column) -> Column:
    """The text without the bodies under signatures, each run of body lines as one ``// ...``; blank lines end a body."""
    state = "struct<body:boolean,kept:array<string>>"

    def step(a, line):
        blank, head = F.trim(line) == "", line.rlike(_SIGNATURE)
        skip = ~blank & ~head & a["body"] & line.rlike(_BODY)
        dots = F.when(F.element_at(F.concat(F.array(F.lit("")), a["kept"]), -1) == "  // ...", a["kept"]).otherwise(F.concat(a["kept"], F.array(F.lit("  // ..."))))
        return F.struct(F.when(blank, False).when(head, True).otherwise(a["body"]).alias("body"), F.when(skip, dots).otherwise(F.concat(a["kept"], F.array(line))).alias("kept")).cast(state)

    start = F.struct(F.lit(False).alias("body"), F.array().alias("kept")).cast(state)
    return F.array_join(F.aggregate(F.split(text, "\n"), start, step)["kept"], "\n")


def pack_context(focus: DataFrame, neighbours: DataFrame, budget: int = 8000, full: bool = False) -> DataFrame:
    """(pack, id, rank, cost, spent, included) of blocks that fit a token budget.

    ``focus``: pack, id, source; its block always goes in. ``neighbours``: pack, id, rank, source; they follow by rank and id as compressed
    source (``full``: as it is), and from the first one that doesn't fit on all are dropped. Each pack is a window of its own.
    """
    head = lambda role, text: F.concat(F.lit("// === "), F.col("id"), F.lit(f" ({role}) ===\n"), text)
    f = focus.select("pack", "id", F.lit(0).alias("rank"), tokens(head("focus", F.col("source"))).alias("cost"), F.lit(True).alias("focus"))
    n = neighbours.join(focus.select("pack", "id"), ["pack", "id"], "left_anti").select("pack", "id", F.col("rank").cast("int").alias("rank"), tokens(head("dependency", F.col("source") if full else compressed(F.col("source")))).alias("cost"), F.lit(False).alias("focus"))
    w = Window.partitionBy("pack").orderBy(F.desc("focus"), "rank", "id").rowsBetween(Window.unboundedPreceding, 0)
    x = f.unionByName(n).withColumn("spent", F.sum("cost").over(w))
    over = F.max(F.when(~F.col("focus") & (F.col("spent") > budget), 1).otherwise(0)).over(w)
    return x.select("pack", "id", "rank", "cost", "spent", (F.col("focus") | (over == 0)).alias("included"))


def skeleton(files: DataFrame, edges: DataFrame, symbols: DataFrame, budget: int = 4000, most: int = 12) -> DataFrame:
    """(rank, id, in_degree, out_degree, tier, line) of the files that a map of the repository shows.

    Files (id, score) are ranked by distinct dependents, then dependencies too, then score, then id. Half the budget buys the breadth of
    paths alone (tier 2), a prefix of the ranking; what is left upgrades files in order to names (tier 1) or signatures
    (tier 0). Only the prefix that half the budget can hold reaches the last, sequential step, so its size is bounded by
    the budget, whatever the repository's.
    """
    e = edges.select("src", "tgt").where("src <> tgt").distinct()
    ends = files.select("id")
    e = e.join(ends.withColumnRenamed("id", "src"), "src", "left_semi").join(ends.withColumnRenamed("id", "tgt"), "tgt", "left_semi")
    half = e.select(F.explode(F.array(F.struct(F.col("tgt").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("h"))
    degree = half.groupBy("h.id").agg(F.sum("h.i").alias("in_degree"), F.sum("h.o").alias("out_degree"))
    w = Window.partitionBy("file")
    s = symbols.where("exported").select("file", "name", "signature", F.row_number().over(w.orderBy("line", "name")).alias("k"), F.count("*").over(w).alias("n")).where(F.col("k") <= most)
    s = s.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("k", "name", "signature"))).alias("s"), F.max("n").alias("n"))
    x = files.join(degree, "id", "left").na.fill(0, ["in_degree", "out_degree"]).join(s.withColumnRenamed("file", "id"), "id", "left")
    head = F.concat(F.col("id"), F.lit(" [in:"), F.col("in_degree").cast("string"), F.lit(" out:"), F.col("out_degree").cast("string"), F.lit("]"))
    rest = F.when(F.col("n") > most, F.concat(F.lit(" +"), (F.col("n") - most).cast("string"))).otherwise(F.lit(""))
    names = F.when(F.col("s").isNotNull(), F.concat(head, F.lit(": "), F.array_join(F.transform("s", lambda v: v["name"]), ", "), rest)).otherwise(head)
    signatures = F.when(F.col("s").isNotNull(), F.concat(head, F.lit("\n"), F.array_join(F.transform("s", lambda v: F.concat(F.lit("  "), F.coalesce(v["signature"], v["name"]))), "\n"), rest)).otherwise(head)
    x = x.select("id", "in_degree", "out_degree", "score", F.array(signatures, names, head).alias("lines"))
    order = [F.desc("in_degree"), F.desc(F.col("in_degree") + F.col("out_degree")), F.desc("score"), "id"]
    top = x.orderBy(*order).limit(max(1, budget * 2))  # a path costs a token at least
    rows = top.collect()  # bounded by the budget

    def cost(text: str) -> int:
        return -(-len(text) // 4)

    spent, shown = 0, []
    for r in rows:
        if spent + cost(r.lines[2]) > budget // 2:
            break
        spent += cost(r.lines[2])
        shown.append(r)
    out = []
    for i, r in enumerate(shown):
        costs, tier = [cost(t) for t in r.lines], 2
        for t in (0, 1):
            if costs[t] <= costs[2] or spent + costs[t] - costs[2] <= budget:
                spent += max(0, costs[t] - costs[2])
                tier = t
                break
        out.append((i + 1, r.id, int(r.in_degree), int(r.out_degree), tier, r.lines[tier]))
    return files.sparkSession.createDataFrame(out, "rank int, id string, in_degree int, out_degree int, tier int, line string")


def orient(map_lines: DataFrame, summary: DataFrame, report: DataFrame, hot: DataFrame) -> DataFrame:
    """(part, position, text) of a first look: skeleton, counts by type, validation figures, hotspots; each already bounded."""
    text = lambda df: F.to_json(F.struct(*df.columns))
    place = lambda part, df, by: df.select(F.lit(part).alias("part"), F.row_number().over(Window.orderBy(*by)).alias("position"), text(df).alias("text"))
    parts = [map_lines.select(F.lit("skeleton").alias("part"), F.col("rank").alias("position"), F.col("line").alias("text"))]
    parts += [place(n, df, by) for n, df, by in (("summary", summary, [summary.columns[0]]), ("validation", report, [report.columns[0]]), ("hotspots", hot, [F.desc("score"), "id"]))]
    return reduce(DataFrame.unionByName, parts)


def result_context(results: DataFrame, budget: int = 3000) -> DataFrame:
    """(query, text, tokens, files, types, shown, truncated): a query's results (query, id, type, file, score, snippet) grouped by file under
    headings, best files first, cut where the budget is spent; counts are of all results."""
    block = F.concat(F.lit("### "), F.col("id"), F.lit(" ["), F.col("type"), F.lit("]\n"), F.coalesce("snippet", F.lit("")))
    w = Window.partitionBy("query", "file")
    x = results.withColumn("block", block).withColumn("best", F.max("score").over(w))
    run = Window.partitionBy("query").orderBy(F.desc("best"), "file", F.desc("score"), "id").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("spent", F.sum(tokens(F.col("block"))).over(run)).withColumn("place", F.row_number().over(run))
    counts = results.groupBy("query").agg(F.count_distinct("file").alias("files"), F.count_distinct("type").alias("types"), F.count("*").alias("all"))
    shown = x.where(F.col("spent") <= budget).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "file", "block"))).alias("b"), F.max("spent").alias("tokens"), F.count("*").alias("shown"))  # bounded by the budget
    lines = F.transform("b", lambda v, i: F.concat(F.when((i == 0) | (F.get(F.col("b"), i - 1)["file"] != v["file"]), F.concat(F.lit("## "), v["file"], F.lit("\n"))).otherwise(F.lit("")), v["block"]))
    out = counts.join(shown, "query", "left").na.fill(0, ["tokens", "shown"])
    return out.select("query", F.coalesce(F.array_join(lines, "\n"), F.lit("")).alias("text"), "tokens", "files", "types", "shown", (F.col("shown") < F.col("all")).alias("truncated"))


def subprocess_linkage(tests: DataFrame, sources: DataFrame) -> DataFrame:
    """(file, test_files, refs): source files that tests (file, content) start as built programs, by string literals.

    Only tests that start processes at all count; a literal ``dist/src/….js`` or its joined pieces is mapped to the first source (file)
    of its stem that exists.
    """
    t = tests.where(F.col("content").rlike(r"\bchild_process\b|\b(?:exec|spawn|fork)\w*\s*\("))
    direct = F.regexp_extract_all("content", F.lit(r"\bdist[\\/](src(?:[\\/][\w.-]+)+\.[mc]?js)\b"), F.lit(1))
    tails = F.regexp_extract_all("content", F.lit(r"['\"]dist['\"]\s*,\s*['\"]src['\"]((?:\s*,\s*['\"][\w.-]+['\"])+)"), F.lit(1))
    joined = F.transform(tails, lambda x: F.concat(F.lit("src/"), F.array_join(F.regexp_extract_all(x, F.lit(r"['\"]([\w.-]+)['\"]"), F.lit(1)), "/")))
    rel = t.select(F.translate("file", "\\", "/").alias("test"), F.posexplode(F.concat(F.transform(direct, lambda x: F.translate(x, "\\", "/")), F.filter(joined, lambda x: x.rlike(r"\.[mc]?js$")))).alias("k", "rel"))
    stem = F.regexp_replace("rel", r"\.[mc]?js$", "")
    own = F.when(F.col("rel").endswith(".mjs"), F.array(F.concat(stem, F.lit(".mts")), F.col("rel"), F.concat(stem, F.lit(".ts")))).when(F.col("rel").endswith(".cjs"), F.array(F.concat(stem, F.lit(".cts")), F.col("rel"), F.concat(stem, F.lit(".ts")))).otherwise(F.array(F.concat(stem, F.lit(".ts")), F.concat(stem, F.lit(".tsx")), F.col("rel")))
    tried = rel.select("test", "k", F.posexplode(own).alias("at", "file")).join(sources.select("file").distinct(), "file")
    first = tried.groupBy("test", "k").agg(F.min_by("file", "at").alias("file"))
    return first.groupBy("file").agg(F.count_distinct("test").alias("test_files"), F.count("*").alias("refs"))


def docs_score(readme: Column, jsdoc: Column, changelog: Column, api: Column, density: Column) -> Column:
    """30 for the readme, 25 for documented code, 20 for a recent changelog, 15 for API documents, 10 for comments of 15 to 25 %; parts
    that are null count nothing."""
    comments = F.when(density.between(0.15, 0.25), 100.0).when(density < 0.15, density / 0.15 * 100).otherwise(F.greatest(F.lit(0.0), 100 - (density - 0.25) * 200))
    nil = lambda c: F.coalesce(c, F.lit(0.0))
    return F.floor(nil(readme * 0.3) + nil(jsdoc * 25) + nil(changelog * 0.2) + F.when(api, 15.0).otherwise(0.0) + nil(comments * 0.1) + 0.5).cast("double")


def docs_level(score: Column) -> Column:
    return F.when(score >= 80, "excellent").when(score >= 60, "good").when(score >= 40, "basic").otherwise("poor")


def critical_score(complexity: Column, dependents: Column, pipeline: Column, orchestrator: Column, entry: Column) -> Column:
    """How critical a function is: half its complexity and a quarter of its dependents, extremes weighed more, and its roles."""
    c = F.when(complexity >= 15, complexity * 3).otherwise(complexity)
    d = F.when(dependents >= 20, dependents * 2).otherwise(dependents)
    return c * 0.5 + d * 0.25 + F.when(pipeline, 60).otherwise(0) + F.when(orchestrator, 10).otherwise(0) + F.when(entry, 5).otherwise(0)


def critical_functions(functions: DataFrame, limit: int = 20) -> DataFrame:
    """(name, file, complexity, score) of functions (name, file, complexity, dependents, pipeline, orchestrator, entry) outside tests with a score over 3: the best
    of each name, at most ``limit``, ties by file."""
    c = F.col
    x = functions.where(~classify.is_gap_test(c("file"))).withColumn("score", critical_score(c("complexity"), c("dependents"), c("pipeline"), c("orchestrator"), c("entry"))).where("score > 3")
    best = x.groupBy("name").agg(F.min(F.struct((-c("score")).alias("m"), "file", "complexity")).alias("b"))
    return best.select("name", "b.file", "b.complexity", (-c("b.m")).alias("score")).orderBy(F.desc("score"), "name").limit(limit)


def risk_heat_map(files: DataFrame, limit: int = 20) -> DataFrame:
    """(file, complexity, coverage, score, level) of files (file, complexity, tested): five points a branch and 30 without tests; the
    level comes from the score before its cap of 100."""
    raw = F.col("complexity") * 5 + F.when(F.col("tested"), 0).otherwise(30)
    x = files.select("file", "complexity", F.when(F.col("tested"), F.greatest(F.lit(20), 100 - F.col("complexity") * 3)).otherwise(0).alias("coverage"), raw.alias("raw"))
    level = F.when(F.col("raw") >= 80, "critical").when(F.col("raw") >= 60, "high").when(F.col("raw") >= 40, "medium").otherwise("low")
    return x.select("file", "complexity", "coverage", F.least(F.lit(100), "raw").alias("score"), level.alias("level")).orderBy(F.desc("score"), "file").limit(limit)


PATTERN_COUNTS = {"try_catch": r"\btry\s*\{", "async": r"\basync\b", "barrels": r"(?m)^export \* from", "decorators": r"(?m)^\s*@\w+", "promises": r"\bnew Promise\b|\.then\s*\("}


def pattern_counts(sources: DataFrame) -> DataFrame:
    """(language, pattern, n, files) over sources (path, language, content)."""
    counts = F.array(*[F.struct(F.lit(k).alias("pattern"), F.regexp_count("content", F.lit(v)).alias("n")) for k, v in PATTERN_COUNTS.items()])
    x = sources.select("language", F.explode(counts).alias("c")).where("c.n > 0")
    return x.groupBy("language", "c.pattern").agg(F.sum("c.n").alias("n"), F.count("*").alias("files"))


def type_summary(elements: DataFrame, limit: int = 10) -> DataFrame:
    """(part, name, n): elements by type, and the files with most of them, ties by name."""
    types = elements.groupBy(F.col("type").alias("name")).agg(F.count("*").alias("n")).select(F.lit("type").alias("part"), "name", "n")
    files = elements.groupBy(F.col("file").alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(limit)
    return types.unionByName(files.select(F.lit("file").alias("part"), "name", "n"))


ARCHETYPES = {
    "web-app": (r"\.(tsx|jsx|vue|svelte)$", 3.0), "api": (r"(^|/)(routes?|controllers?|api)/", 2.0), "cli": (r"(^|/)(bin|cli)/", 2.0),
    "library": (r"(^|/)(src|lib)/index\.[a-z]+$", 4.0), "docs": (r"\.md$", 0.5), "data": (r"(^|/)(notebooks|pipelines?|etl)/|\.ipynb$", 3.0),
}


def project_kind(files: DataFrame, hybrid: float = 0.8) -> DataFrame:
    """One row (kind, score, scores): the archetype with the highest share of weighted files; hybrid if the second reaches ``hybrid`` of it."""
    marks = files.agg(F.count("*").alias("n"), *[(F.count_if(F.col("path").rlike(p)) * w).alias(k) for k, (p, w) in ARCHETYPES.items()])
    scores = F.array_sort(F.array(*[F.struct((-F.round(F.col(k) / F.greatest(F.col("n"), F.lit(1)), 6)).alias("m"), F.lit(k).alias("kind")) for k in ARCHETYPES]))
    x = marks.select(scores.alias("s"))
    best, second = -F.col("s")[0]["m"], -F.col("s")[1]["m"]
    kind = F.when(best <= 0, "unknown").when(second >= hybrid * best, "hybrid").otherwise(F.col("s")[0]["kind"])
    return x.select(kind.alias("kind"), best.alias("score"), F.transform("s", lambda v: F.concat(v["kind"], F.lit("="), (-v["m"]).cast("string"))).alias("scores"))


def ambiguity(matches: DataFrame, limit: int = 5) -> DataFrame:
    """One row (ambiguous, n, candidates): more than ``limit`` matches (id, tier) that aren't a file's (tier 4) are an error, with the first as candidates."""
    n = matches.where("tier <> 4").agg(F.count("*").alias("n"))
    few = matches.where("tier <> 4").orderBy("id").limit(limit).agg(F.array_sort(F.collect_list("id")).alias("candidates"))
    return n.join(F.broadcast(few)).select((F.col("n") > limit).alias("ambiguous"), "n", "candidates")  # one row each


def traverse(edges: DataFrame, start: DataFrame, rel: str, depth: int = 10) -> DataFrame:
    """(id, depth) along one kind of edge, at the least depth."""
    return reach(edges.where(F.col("rel") == rel), start, depth, inbound=False)


def circular_chains(components: DataFrame, limit: int = 10) -> DataFrame:
    """(component, size, members) of strong components (id, component): the members in order, at most ``limit`` of each, largest first."""
    w = Window.partitionBy("component").orderBy("id")
    x = components.withColumn("k", F.row_number().over(w))
    x = x.groupBy("component").agg(F.count("*").alias("size"), F.array_sort(F.collect_list(F.when(F.col("k") <= limit, F.col("id")))).alias("members"))
    return x.orderBy(F.desc("size"), "component")

