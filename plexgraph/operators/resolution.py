"""From facts to edges: export tables, imports, calls, heritage, field lookups, and an overlay of compiler facts.

Facts are tables; every rule is a join on names and files, and the number of candidates decides between resolved, ambiguous and
the next rule. Walks over re-exports and supertypes are loops of joins that end when nothing is left.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scan import family
from .graph import checkpointed

HERITAGE_DEPTH, HOPS = 16, 32
#: Modules of the run-time environment that no project file stands for.
BUILTIN_MODULES = frozenset("assert buffer child_process cluster console crypto dns events fs http http2 https net os path process querystring readline stream string_decoder timers tls tty url util v8 vm worker_threads zlib".split())


def export_table(exports: DataFrame, elements: DataFrame) -> DataFrame:
    """(file, exported, kind, origin, via, local): what each file exports, later facts over earlier ones.

    ``exports``: file, exported, local, kind (named, default, reexport, namespace), via, order. ``elements``: id, file, name. The
    origin of an own export is the element of its local name, else of its exported one; re-exports keep their module.
    """
    w = Window.partitionBy("file", "exported").orderBy(F.desc("order"))
    last = exports.withColumn("_k", F.row_number().over(w)).where("_k = 1")
    named = elements.groupBy("file", "name").agg(F.min("id").alias("id"))
    by = lambda c, out: named.select("file", F.col("name").alias(c), F.col("id").alias(out))
    x = last.join(by("local", "_a"), ["file", "local"], "left").join(by("exported", "_b"), ["file", "exported"], "left")
    own = ~F.col("kind").isin("reexport", "namespace")
    return x.select("file", "exported", "kind", F.when(own, F.coalesce("_a", "_b")).alias("origin"), F.when(~own, F.col("via")).alias("via"), "local")


def module_file(source: Column, specifier: Column) -> Column:
    """The normalised path of a relative specifier from the folder of the importing file."""
    folder = F.regexp_replace(F.regexp_extract(source, r"^(.*)/[^/]*$", 1), r"/+$", "")
    parts = F.split(F.concat_ws("/", F.nullif(folder, F.lit("")), specifier), "/")
    up = lambda a, s: F.when(s.isin(".", ""), a).when(s == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), up), "/")


def resolve_modules(imports: DataFrame, files: DataFrame, aliases: dict[str, str] | None = None, packages: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """``imports`` (source, specifier, kind, ...) with ``module`` (a project file) and ``outcome``.

    Dynamic imports stay dynamic; an alias prefix is replaced first, relative specifiers are probed with the usual endings and
    index files, then the plain path, then built-in and declared packages; anything else is unresolved.
    """
    spec = F.col("specifier")
    real = reduce(lambda c, kv: F.when(spec.startswith(kv[0]), F.concat(F.lit(kv[1]), F.expr(f"substring(specifier, {len(kv[0]) + 1})"))).otherwise(c), (aliases or {}).items(), spec)
    base = F.when(real.startswith("."), module_file(F.col("source"), real)).otherwise(real)
    ends = ("", ".ts", ".tsx", ".js", ".jsx", ".py", "/index.ts", "/index.tsx", "/index.js", "/__init__.py")
    stem = F.regexp_replace(base, r"\.(js|jsx|mjs)$", "")
    probes = F.array_distinct(F.array(*[F.concat(base, F.lit(e)) for e in ends], *[F.concat(stem, F.lit(e)) for e in (".ts", ".tsx")]))
    rows = imports.withColumn("_id", F.monotonically_increasing_id())
    rows = checkpointed(rows)  # the ids must not change between the two uses below
    tried = rows.select("_id", F.posexplode(probes).alias("_at", "module")).join(files.select(F.col("file").alias("module")).distinct(), "module")
    found = tried.groupBy("_id").agg(F.min_by("module", "_at").alias("module"))
    package = F.regexp_extract(spec, r"^(@[^/]+/[^/]+|[^/]+)", 1)
    known = package.isin(*packages) if packages else F.lit(False)
    builtin = spec.startswith("node:") | package.isin(*BUILTIN_MODULES)
    outcome = (
        F.when(F.col("kind") == "dynamic", "dynamic")
        .when(F.col("module").isNotNull(), "module")
        .when(builtin & ~spec.startswith("."), "builtin")
        .when(known, "external")
        .otherwise("unresolved")
    )
    return rows.join(found, "_id", "left").drop("_id").withColumn("outcome", outcome)


def follow_exports(wanted: DataFrame, table: DataFrame, hops: int = HOPS) -> DataFrame:
    """``wanted`` (module, binding) with the origin that the export table leads to, and how many re-exports lie between.

    A name that a module lacks goes on through its ``*`` re-exports; a module and name already seen ends the walk, so cycles do.
    The first hop with an origin wins, the least id on ties.
    """
    asked = checkpointed(wanted.select("module", "binding").distinct().withColumn("at", F.col("module")).withColumn("name", F.col("binding")))
    table = checkpointed(table.select(F.col("file").alias("at"), F.col("exported").alias("name"), "kind", "origin", "via", "local"))
    star = table.where("name = '*' and kind = 'reexport'").select("at", F.col("via").alias("star"))
    seen, done, level = asked, None, 0
    while level <= hops:
        x = asked.join(table.where("name <> '*'"), ["at", "name"], "left")
        hit = x.where("origin is not null").groupBy("module", "binding").agg(F.min("origin").alias("origin")).withColumn("hops", F.lit(level))
        hit = checkpointed(hit)
        done = hit if done is None else done.unionByName(hit)
        rest = x.join(hit.select("module", "binding"), ["module", "binding"], "left_anti")
        named = rest.where("via is not null").select("module", "binding", F.col("via").alias("at"), F.coalesce("local", "name").alias("name"))
        wild = rest.where("kind is null").select("module", "binding", "at", "name").join(star, "at").select("module", "binding", F.col("star").alias("at"), "name")
        asked = named.unionByName(wild).distinct().join(seen, ["module", "binding", "at", "name"], "left_anti")
        asked = checkpointed(asked)
        if asked.isEmpty():
            break
        seen, level = seen.unionByName(asked), level + 1
    return done


def resolve_imports(imports: DataFrame, files: DataFrame, exports: DataFrame, aliases: dict[str, str] | None = None, packages: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """A row for each binding: (source, specifier, binding, module, target, status, reason).

    ``imports``: source, specifier, kind, bindings (array). ``exports``: what :func:`export_table` gives, ``via`` naming files.
    """
    x = resolve_modules(imports, files, aliases, packages).withColumn("binding", F.explode_outer("bindings"))
    led = follow_exports(x.where("outcome = 'module' and binding is not null").select("module", "binding"), exports)
    x = x.join(led, ["module", "binding"], "left")
    status = (
        F.when(F.col("outcome") != "module", F.when(F.col("outcome") == "builtin", "builtin").otherwise(F.col("outcome")))
        .when(F.col("kind") == "type", "typeOnly")
        .when(F.col("origin").isNotNull() | F.col("binding").isNull() | (F.col("binding") == "*"), "resolved")
        .otherwise("unresolved")
    )
    reason = F.when(F.col("outcome") == "unresolved", "module_not_found").when((F.col("outcome") == "module") & F.col("origin").isNull() & F.col("binding").isNotNull() & (F.col("binding") != "*"), "export_not_found")
    target = F.when(F.col("outcome") == "module", F.coalesce("origin", F.concat(F.lit("@File/"), "module")))
    return x.withColumn("status", status).select("source", "specifier", "binding", "module", F.when(F.col("status").isin("resolved", "typeOnly"), target).alias("target"), "status", F.when(F.col("status") == "unresolved", reason).alias("reason"))


def field_index(elements: DataFrame) -> DataFrame:
    """(name, family, id, file) of methods and properties by their bare names: what a member call may mean."""
    bare = F.substring_index("name", ".", -1)
    return elements.where(F.col("type").isin("method", "property")).select(bare.alias("name"), family(F.col("file")).alias("family"), "id", "file").where("name <> ''").distinct()


def field_lookup(calls: DataFrame, index: DataFrame) -> DataFrame:
    """``calls`` (call_id, name, file) with the candidate definitions of their name in the same family of languages."""
    got = calls.select("call_id", "name", family(F.col("file")).alias("family")).join(index, ["name", "family"])
    return got.groupBy("call_id").agg(F.count_distinct("id").alias("n"), F.min("id").alias("target"))


def heritage_lookup(wanted: DataFrame, heritage: DataFrame, methods: DataFrame, depth: int = HERITAGE_DEPTH) -> DataFrame:
    """(class, method, id, level): the nearest supertypes that have the method, all of the first level with a hit.

    ``wanted``: class, method. ``heritage``: sub, sup. ``methods``: class, method, id. Each level is a join; a class already
    seen is not walked again, so cycles end.
    """
    links = checkpointed(heritage.where("sub <> sup").select(F.col("sub").alias("at"), F.col("sup").alias("next")).distinct())
    front = wanted.select("class", "method").distinct().withColumn("at", F.col("class"))
    seen, done = front, None
    for level in range(1, depth + 1):
        front = front.join(links, "at").select("class", "method", F.col("next").alias("at")).distinct().join(seen, ["class", "method", "at"], "left_anti")
        front = checkpointed(front)
        if front.isEmpty():
            break
        hit = front.join(methods.select(F.col("class").alias("at"), "method", "id"), ["at", "method"]).select("class", "method", "id", F.lit(level).alias("level")).distinct()
        hit = checkpointed(hit)
        done = hit if done is None else done.unionByName(hit)
        seen = seen.unionByName(front)
        front = front.join(hit.select("class", "method").distinct(), ["class", "method"], "left_anti")
    return done if done is not None else methods.where("false").select("class", "method", "id", F.lit(0).alias("level"))


def resolve_calls(calls: DataFrame, symbols: DataFrame, imported: DataFrame, builtins: list[str] | tuple[str, ...] = (), fields: DataFrame | None = None) -> DataFrame:
    """(call_id, status, rule, target, candidates) by the first rule with a candidate; several candidates are ambiguous.

    ``calls``: call_id, file, name, kind (bare or method). ``symbols``: id, file, name. ``imported``: file, name, target. Rules of a bare call:
    a binding imported into the file, the file's own symbols, the project's; of a method call: fields of its family. The
    names in ``builtins`` are settled before all others.
    """
    own = symbols.groupBy("file", "name").agg(F.count_distinct("id").alias("n1"), F.min("id").alias("t1"))
    brought = imported.groupBy("file", "name").agg(F.count_distinct("target").alias("n0"), F.min("target").alias("t0"))
    anywhere = symbols.groupBy("name").agg(F.count_distinct("id").alias("n2"), F.min("id").alias("t2"))
    x = calls.join(brought, ["file", "name"], "left").join(own, ["file", "name"], "left").join(anywhere, "name", "left")
    bare = F.col("kind") == "bare"
    if fields is None:
        x = x.withColumn("n3", F.lit(None).cast("long")).withColumn("t3", F.lit(None).cast("string"))
    else:
        x = x.join(field_lookup(calls.where("kind = 'method'"), fields).withColumnsRenamed({"n": "n3", "target": "t3"}), "call_id", "left")
    rules = (("import", bare, "0"), ("same_file", bare, "1"), ("project", bare, "2"), ("field", ~bare, "3"))
    known = F.col("name").isin(*builtins) if builtins else F.lit(False)
    pick = lambda of: reduce(lambda c, r: F.when(r[1] & (F.col(f"n{r[2]}") > 0), of(r)).otherwise(c), reversed(rules), F.lit(None))
    rule, n, target = pick(lambda r: F.lit(r[0])), pick(lambda r: F.col(f"n{r[2]}")), pick(lambda r: F.col(f"t{r[2]}"))
    status = F.when(known, "builtin").when(n == 1, "resolved").when(n > 1, "ambiguous").otherwise("unresolved")
    return x.select("call_id", status.alias("status"), F.when(known, "builtin").otherwise(F.coalesce(rule, F.lit("none"))).alias("rule"), F.when(~known & (n == 1), target).alias("target"), F.when(known, 0).otherwise(F.coalesce(n, F.lit(0))).cast("long").alias("candidates"))


def heritage_edges(heritage: DataFrame, elements: DataFrame) -> DataFrame:
    """(src, tgt, rel, status, reason, line): a supertype of the same file, else the only one of its name; a subtype that isn't known
    drops its edge, a supertype that isn't becomes external.

    ``heritage``: file, sub, sup, rel, line. ``elements``: id, file, name, type.
    """
    types = elements.where(F.col("type").isin("class", "interface", "type")).select("id", "file", "name")
    local = types.groupBy("file", "name").agg(F.min("id").alias("id"))
    once = types.groupBy("name").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id")).where("n = 1")
    x = heritage.join(local.select("file", F.col("name").alias("sub"), F.col("id").alias("src")), ["file", "sub"])
    x = x.join(local.select("file", F.col("name").alias("sup"), F.col("id").alias("_a")), ["file", "sup"], "left").join(once.select(F.col("name").alias("sup"), F.col("id").alias("_b")), "sup", "left")
    x = x.withColumn("tgt", F.coalesce("_a", "_b"))
    return x.select("src", "tgt", "rel", F.when(F.col("tgt").isNotNull(), "resolved").otherwise("external").alias("status"), F.when(F.col("tgt").isNull(), "supertype_not_in_project").alias("reason"), "line")


def build_edges(elements: DataFrame, imports: DataFrame, calls: DataFrame, heritage: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """All edges (src, tgt, rel, status, reason, line) of a project as one union.

    ``imports``: from :func:`resolve_imports`; an import's line is 0, and one that resolves to nothing in the project counts as external.
    ``calls``: call_id, caller, file, line with status, target. ``docs``: doc, file. Exports come from the elements; a missing
    caller or importer is its file's node.
    """
    none = F.lit(None).cast("string")
    at = lambda c: F.concat(F.lit("@File/"), c)
    parts = [
        imports.select(at(F.col("source")).alias("src"), F.col("target").alias("tgt"), F.lit("import").alias("rel"), F.when((F.col("status") == "resolved") & F.col("target").isNull(), "external").otherwise(F.col("status")).alias("status"), "reason", F.lit(0).cast("long").alias("line")),
        calls.select(F.coalesce("caller", at(F.col("file"))).alias("src"), F.col("target").alias("tgt"), F.lit("call").alias("rel"), "status", F.when(F.col("rule") == "field", "field_based_acg").alias("reason"), F.col("line").cast("long").alias("line")),
        elements.where("exported").select(at(F.col("file")).alias("src"), F.col("id").alias("tgt"), F.lit("export").alias("rel"), F.lit("resolved").alias("status"), none.alias("reason"), F.col("line").cast("long").alias("line")),
        heritage.select("src", "tgt", "rel", "status", "reason", F.col("line").cast("long").alias("line")),
    ]
    if docs is not None:
        known = elements.select("file").distinct()
        parts.append(docs.join(known.withColumn("_k", F.lit(True)), "file", "left").select(F.col("doc").alias("src"), F.when(F.col("_k"), at(F.col("file"))).alias("tgt"), F.lit("documents").alias("rel"), F.when(F.col("_k"), "resolved").otherwise("unresolved").alias("status"), F.when(F.col("_k").isNull(), "file_not_in_project").alias("reason"), F.lit(0).cast("long").alias("line")))
    return reduce(DataFrame.unionByName, parts)


def overlay(edges: DataFrame, nodes: DataFrame, occurrences: DataFrame) -> DataFrame:
    """``edges`` (src, tgt, file, line, status, reason, order) with unresolved and ambiguous ones settled by compiler occurrences.

    ``occurrences``: file, line, symbol, definition. A symbol with one definition site and a site with one node give the target; an edge is
    settled where a reference to such a symbol stands at its file and line, unless a resolved edge stands there. Of
    several open edges at a place the last one is settled, as only one reference is used up.
    """
    scope = F.when(F.col("symbol").startswith("local "), F.concat_ws("\x00", "file", "symbol")).otherwise(F.col("symbol"))
    occ = occurrences.where("symbol <> ''").withColumn("sym", scope)
    defs = occ.where("definition").groupBy("sym").agg(F.count_distinct("file", "line").alias("n"), F.min(F.struct("file", "line")).alias("d")).where("n = 1").select("sym", "d.file", "d.line")
    sites = nodes.where("file is not null and line is not null").groupBy("file", "line").agg(F.count_distinct("id").alias("n"), F.min("id").alias("node")).where("n = 1").select("file", "line", "node")
    targets = defs.join(sites, ["file", "line"]).select("sym", "node")
    refs = occ.where("not definition").join(targets, "sym").groupBy("file", "line").agg(F.min("node").alias("node"))
    w = Window.partitionBy("file", "line")
    open_ = F.col("status").isin("unresolved", "ambiguous") & F.col("file").isNotNull() & F.col("line").isNotNull()
    x = edges.withColumn("_r", F.max((F.col("status") == "resolved").cast("int")).over(w)).withColumn("_l", F.max(F.when(open_, F.col("order"))).over(w))
    x = x.join(refs, ["file", "line"], "left")
    flip = open_ & (F.col("_r") == 0) & (F.col("_l") == F.col("order")) & F.col("node").isNotNull()
    new = {"was": F.col("status"), "tgt": F.when(flip, F.col("node")).otherwise(F.col("tgt")), "reason": F.when(flip, "scip_resolved").otherwise(F.col("reason")), "status": F.when(flip, "resolved").otherwise(F.col("status"))}
    return x.select(*[new.get(c, F.col(c)).alias(c) for c in edges.columns], new["was"].alias("was"))
