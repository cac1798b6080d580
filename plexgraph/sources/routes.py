"""Server routes and client calls in source text, their notations, and how they fit together."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_path, half_up

_VERBS = "get|post|put|delete|patch|head|options"


@dataclass(frozen=True)
class Detector:
    """A framework's routes: an expression over content with the groups of path and method, or a file path that is itself a route."""

    framework: str
    expression: str
    path: int = 0
    method: int = 0
    by_file: bool = False


DETECTORS = (
    Detector("flask", r"@\w+\.route\(\s*['\"]([^'\"\n]+)['\"](?:[^)\n]*methods\s*=\s*\[([^\]\n]*)\])?", 1, 2),
    Detector("fastapi", rf"@\w+\.({_VERBS})\(\s*['\"]([^'\"\n]+)['\"]", 2, 1),
    Detector("express", rf"\b(?:app|router|server)\.({_VERBS}|all)\(\s*['\"`]([^'\"`\n]+)['\"`]", 2, 1),
    Detector("next", r"(?:^|/)(?:src/)?(?:app|pages)(/api/.*?)(?:/route)?\.[jt]sx?$", 1, by_file=True),
    Detector("sveltekit", r"(?:^|/)(?:src/)?routes(/.*?)/?\+(?:server|page)(?:\.server)?\.[jt]s$", 1, by_file=True),
    Detector("nuxt", r"(?:^|/)server(/(?:api|routes)/.*?)\.[jt]s$", 1, by_file=True),
    Detector("remix", r"(?:^|/)app/routes/(.*?)\.[jt]sx?$", 1, by_file=True),
)


@dataclass
class Frameworks:
    """Detectors by framework, in order; they can be added and taken out."""

    detectors: dict[str, Detector] = field(default_factory=lambda: {d.framework: d for d in DETECTORS})

    def register(self, detector: Detector) -> None:
        self.detectors[detector.framework] = detector

    def unregister(self, framework: str) -> bool:
        return self.detectors.pop(framework, None) is not None

    def names(self) -> list[str]:
        return list(self.detectors)


def _methods(raw: Column) -> Column:
    found = F.transform(F.regexp_extract_all(F.upper(raw), F.lit(r"([A-Z]+)"), F.lit(1)), lambda m: F.when(m == "ALL", "ANY").otherwise(m))
    return F.when(F.size(found) > 0, F.array_sort(F.array_distinct(found))).otherwise(F.array(F.lit("GET")))


def _matches(expression: str, fields: dict[str, Column | int]) -> Column:
    """A struct for each match: constants as they are, numbers as what their group holds, 0 as nothing."""

    def one(x: Column) -> Column:
        group = lambda g: F.regexp_extract(x, expression, g) if g else F.lit("")
        return F.struct(*[(group(v) if isinstance(v, int) else v).alias(k) if k != "methods" else _methods(group(v)).alias(k) for k, v in fields.items()])

    return F.transform(F.regexp_extract_all("content", F.lit(expression), F.lit(0)), one)


def routes(sources: DataFrame, known: Frameworks | None = None) -> DataFrame:
    """(file, framework, path, methods) of all routes in sources (path, content): one expression a framework, all in one pass.

    ``methods`` is GET where none is named; routes that are files take the methods that the file exports.
    """
    parts = []
    for d in (known or Frameworks()).detectors.values():
        if d.by_file:
            own = F.regexp_extract("path", d.expression, d.path)
            exported = F.array_sort(F.array_distinct(F.regexp_extract_all("content", F.lit(r"export\s+(?:async\s+)?(?:function|const)\s+(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\b"), F.lit(1))))
            methods = F.when(F.size(exported) > 0, exported).otherwise(F.array(F.lit("GET")))
            parts.append(F.when(own != "", F.array(F.struct(F.lit(d.framework).alias("framework"), own.alias("path"), methods.alias("methods")))).otherwise(F.array()))
        else:
            parts.append(_matches(d.expression, {"framework": F.lit(d.framework), "path": d.path, "methods": d.method}))
    kind = "array<struct<framework:string,path:string,methods:array<string>>>"
    found = sources.select(F.col("path").alias("file"), F.explode(F.concat(*[p.cast(kind) for p in parts])).alias("r"))
    return found.select("file", "r.framework", "r.path", "r.methods")


def normal_route(path: Column, framework: Column) -> Column:
    """A route with its parameters as {name}, optional ones too, rest parameters as {*}; groups and index segments dropped."""
    brace = r"{$1}"
    flask = F.regexp_replace(path, r"<(?:[A-Za-z_]+:)?([A-Za-z_]\w*)>", brace)
    express = F.regexp_replace(F.regexp_replace(path, r":([A-Za-z_]\w*)(?:\([^)]*\))?\??", brace), r"\*\w*", "{*}")
    files = F.regexp_replace(path, r"/\([^)/]*\)(?=/|$)", "")
    files = F.regexp_replace(F.regexp_replace(files, r"\[\[?\.\.\.\w+\]\]?", "{*}"), r"\[\[?(\w+)(?:=\w+)?\]\]?", brace)
    files = F.regexp_replace(files, r"/index$", "")
    remix = F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("."), F.lit("/")), r"(^|/)\$(?=/|$)", "$1{*}"), r"\$(\w+)", brace)
    remix = F.regexp_replace(F.regexp_replace(remix, r"(^|/)_[^/]*", "$1"), r"(^|/)index$", "$1")
    x = F.when(framework.isin("flask"), flask).when(framework == "express", express).when(framework.isin("next", "sveltekit", "nuxt"), files).when(framework == "remix", remix).otherwise(path)
    x = F.regexp_replace(F.concat(F.lit("/"), x), r"/+", "/")
    return F.regexp_replace(x, r"(.)/$", "$1")


_CALLS = (
    ("fetch", r"\bfetch\(\s*(['\"`])([^'\"`\n]+)\1(?:\s*,\s*\{[^}]*?method\s*:\s*['\"](\w+)['\"])?", 2, 3),
    ("axios", rf"\baxios\.({_VERBS})(?:<[^>(]*>)?\(\s*['\"`]([^'\"`\n]+)['\"`]", 2, 1),
    ("client", rf"\b(?:api|http|client|request)\.({_VERBS})(?:<[^>(]*>)?\(\s*['\"`]([^'\"`\n]+)['\"`]", 2, 1),
    ("query", r"\buse(?:Query|Mutation|SWR)\w*\(\s*(?:\[\s*)?['\"`](/[^'\"`\n]+)['\"`]", 1, 0),
)


def client_calls(sources: DataFrame) -> DataFrame:
    """(file, call, path, method, confidence): requests in client code; a literal path is certain (100), one with placeholders less so (80)."""
    parts = []
    for name, expression, path, method in _CALLS:
        parts.append(_matches(expression, {"call": F.lit(name), "path": path, "method": method}))
    kind = "array<struct<call:string,path:string,method:string>>"
    found = sources.select(F.col("path").alias("file"), F.explode(F.concat(*[p.cast(kind) for p in parts])).alias("c"))
    return found.select("file", "c.call", "c.path", F.when(F.col("c.method") == "", "GET").otherwise(F.upper("c.method")).alias("method"), F.when(F.col("c.path").contains("${"), 80).otherwise(100).alias("confidence"))


def orphaned_calls(calls: DataFrame, served: DataFrame) -> DataFrame:
    """Calls (path, method) that no route (path, methods) serves, with reason and confidence.

    A path of the same literal text is looked up first, then as a shape: routes of as many segments whose parameters stand where
    the call's segments differ. The shapes of the routes are the join key, so no pair of unlike paths ever meets.
    """
    own = served.select("path", F.explode("methods").alias("m")).groupBy("path").agg(F.collect_set("m").alias("methods"))
    parts = lambda c: F.split(c, "/")
    parameter = r"^(?:\{[^}]*\}|<[^>]*>|:[A-Za-z_]\w*)$"
    free = lambda c: F.filter(F.transform(parts(c), lambda s, i: F.when(s.rlike(parameter), i).otherwise(-1)), lambda i: i >= 0)
    shaped = own.withColumn("size", F.size(parts("path"))).withColumn("free", free("path")).where("size(free) > 0")
    blanked = lambda c: F.array_join(F.transform(parts(c), lambda s, i: F.when(F.array_contains("free", i), "*").otherwise(s)), "/")
    shapes = shaped.select("size", "free", blanked("path").alias("shape"), "methods").groupBy("size", "free", "shape").agg(F.flatten(F.collect_set("methods")).alias("methods"))
    asked = calls.select("path", "method").distinct()
    literal = asked.join(own.withColumnRenamed("methods", "exact"), "path", "left")
    able = asked.withColumn("size", F.size(parts("path"))).join(shapes.select("size", "free").distinct(), "size").withColumn("shape", blanked("path"))
    by_shape = able.join(shapes, ["size", "free", "shape"]).groupBy("path", "method").agg(F.flatten(F.collect_set("methods")).alias("dynamic"))
    x = literal.join(by_shape, ["path", "method"], "left").withColumn("all", F.concat(F.coalesce("exact", F.array().cast("array<string>")), F.coalesce("dynamic", F.array().cast("array<string>"))))
    served_by = F.array_contains("all", F.col("method")) | F.array_contains("all", F.lit("ANY"))
    known = F.size("all") > 0
    return x.where(~served_by).select("path", "method", F.when(known, "method_mismatch").otherwise("no_matching_route").alias("reason"), F.when(known, 80).otherwise(95).alias("confidence"))


def mapped(calls: DataFrame, explicit: dict[str, str], patterns: list[tuple[str, str]]) -> DataFrame:
    """``calls`` with target, rule and confidence: the explicit mapping (100), the first pattern that matches (80), else itself (0)."""
    path = F.col("path")
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in explicit.items() for x in kv]), path) if explicit else F.lit(None).cast("string")
    by = F.lit(None).cast("string")
    for pattern, to in reversed(patterns):
        by = F.when(path.rlike(pattern), F.regexp_replace(path, pattern, to)).otherwise(by)
    x = calls.withColumn("_e", known).withColumn("_p", by)
    rule = F.when(F.col("_e").isNotNull(), "explicit").when(F.col("_p").isNotNull(), "pattern").otherwise("unmapped")
    return x.withColumn("target", F.coalesce("_e", "_p", path)).withColumn("rule", rule).withColumn("confidence", F.when(F.col("rule") == "explicit", 100).when(F.col("rule") == "pattern", 80).otherwise(0)).drop("_e", "_p")


def mapping_errors(explicit: dict[str, str], patterns: list[tuple[str, str]]) -> list[str]:
    """What is wrong with a migration mapping: paths without a leading slash, mappings to themselves, expressions that don't compile."""
    import re

    out = [f"{p}: paths start with a slash" for kv in explicit.items() for p in kv if not p.startswith("/")]
    out += [f"{a}: maps to itself" for a, b in explicit.items() if a == b]
    for pattern, _ in patterns:
        try:
            re.compile(pattern)
        except re.error as e:
            out.append(f"{pattern}: {e}")
    return out


def migration_report(calls: DataFrame, new_routes: DataFrame, explicit: dict[str, str], patterns: list[tuple[str, str]], deprecated: list[str] | None = None) -> DataFrame:
    """One row of counts: calls, mapped, unmapped, deprecated, served after mapping, issues and coverage; an invalid mapping raises."""
    errors = mapping_errors(explicit, patterns)
    if errors:
        raise ValueError("; ".join(errors))
    m = mapped(calls, explicit, patterns)
    lost = orphaned_calls(m.select(F.col("target").alias("path"), "method"), new_routes).select(F.col("path").alias("target"), "method", "reason")
    x = m.join(lost, ["target", "method"], "left")
    gone = F.col("path").isin(*deprecated) if deprecated else F.lit(False)
    out = x.agg(
        F.count("*").alias("calls"), F.count_if(F.col("confidence") > 0).alias("mapped"), F.count_if(F.col("confidence") == 0).alias("unmapped"), F.count_if(gone).alias("deprecated"),
        F.count_if(F.col("reason").isNull()).alias("served"), F.count_if(F.col("reason") == "no_matching_route").alias("missing"), F.count_if(F.col("reason") == "method_mismatch").alias("mismatched"),
    )
    return out.withColumn("coverage", F.when(F.col("calls") > 0, half_up(F.col("mapped") * 100.0 / F.col("calls"), 1)).otherwise(100.0))


def report_lines(report: DataFrame) -> DataFrame:
    """(position, line) of a readable report of a one-row frame: a heading and a line for each figure."""
    items = [F.struct(F.lit(i + 1).alias("position"), F.concat(F.lit(f"- {c}: "), F.col(c).cast("string")).alias("line")) for i, c in enumerate(report.columns)]
    return report.select(F.explode(F.array(F.struct(F.lit(0).alias("position"), F.lit("# Report").alias("line")), *items)).alias("x")).select("x.position", "x.line")


def endpoint(path: Column, method: Column) -> Column:
    """The id of an endpoint: its canonical path and method."""
    return F.concat(F.lit("@Endpoint"), canonical_path(path), F.lit("#"), F.upper(method))
