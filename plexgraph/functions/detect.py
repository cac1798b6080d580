"""Signs in source text: design patterns, frameworks, edge cases, tests, dynamic imports; all as counts of expressions in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Branches of the plain complexity estimate.
BRANCHES = (r"\bif\s*\(", r"\bfor\s*\(", r"\bwhile\s*\(", r"\bcase\s+", "&&", r"\|\|", r"\?", r"\bcatch\s*\(")


def cyclomatic(content: Column) -> Column:
    """One and a point for each match of the eight branches."""
    out = F.lit(1)
    for b in BRANCHES:
        out = out + F.regexp_count(content, F.lit(b))
    return out


#: Name, expressions that must all occur, expressions that make it likelier.
DESIGN = {
    "singleton": ((r"\bstatic\s+(?:#|_)?instance\b", r"\bgetInstance\s*\(|\bprivate\s+constructor\b"), (r"\bprivate\s+constructor\b",)),
    "factory": ((r"\b(?:class\s+\w*Factory\b|create[A-Z]\w*\s*\()",), (r"\bclass\s+\w*Factory\b", r"\breturn\s+new\s+[A-Z]")),
    "observer": ((r"\b(?:subscribe|addListener|addObserver|on)\s*\(", r"\b(?:notify|emit|publish|next)\w*\s*\("), (r"\b(?:observers|listeners|subscribers)\b",)),
    "strategy": ((r"\bStrategy\b",), (r"\bimplements\s+\w*Strategy\b", r"\bsetStrategy\s*\(")),
    "decorator": ((r"(?m)^\s*@[A-Z]\w*\s*\(|\bclass\s+\w+Decorator\b",), (r"\bclass\s+\w+Decorator\b",)),
    "adapter": ((r"\bclass\s+\w*Adapter\b",), (r"\badaptee\b",)),
    "builder": ((r"\bclass\s+\w*Builder\b",), (r"\bbuild\s*\(\s*\)", r"\breturn\s+this\b")),
    "facade": ((r"\bclass\s+\w*Facade\b",), ()),
    "repository": ((r"\bclass\s+\w*Repository\b",), (r"\bfind(?:All|By\w+|One)\s*\(", r"\bsave\s*\(")),
    "command": ((r"\bclass\s+\w*Command\b",), (r"\bexecute\s*\(", r"\bundo\s*\(")),
}
MIDDLEWARE = {
    "express": r"\b(?:app|router)\.use\s*\(", "koa": r"\bctx\s*,\s*next\b", "fastify": r"\baddHook\s*\(", "nest": r"@(?:Injectable|Module|UseGuards|UseInterceptors)\s*\(",
    "next": r"\bNextResponse\b|\bexport\s+function\s+middleware\b", "flask": r"@\w+\.(?:before|after)_request\b", "fastapi": r"\bDepends\s*\(|@\w+\.middleware\s*\(", "angular": r"\bHttpInterceptor\b|\binject\s*\(\s*[A-Z]",
}
TESTS = {"suite": r"\b(?:describe|context)\s*\(", "case": r"\b(?:it|test)\s*\(|(?m)^\s*def\s+test_\w+", "assertion": r"\bexpect\s*\(|\bassert\b", "mock": r"\b(?:jest|vi)\.(?:fn|mock|spyOn)\s*\(|\bMock\s*\(", "setup": r"\b(?:beforeEach|beforeAll|setUp)\b", "teardown": r"\b(?:afterEach|afterAll|tearDown)\b"}
DYNAMIC = {"import": r"\bimport\s*\(\s*(?!['\"])", "literal_import": r"\bimport\s*\(\s*['\"]", "require": r"\brequire\s*\(\s*(?!['\"])", "eval": r"\beval\s*\(|\bnew\s+Function\s*\(", "computed": r"\]\s*\(", "importlib": r"\bimport_module\s*\(|\b__import__\s*\("}


def _has(content: Column, expression: str) -> Column:
    return content.rlike(expression)


def edge_cases(content: Column) -> Column:
    """Names of the hazards in a text: each is a sign without the guard that belongs to it."""
    n = lambda e: F.regexp_count(content, F.lit(e))
    cases = [
        ("unhandled_race", _has(content, r"Promise\.race\s*\(") & ~_has(content, r"\.catch\s*\(")),
        ("shared_state_in_async", _has(content, r"\basync\s+\w+[^\n]*\{") & _has(content, r"\bthis\.\w+\s*=[^=]") & (n(r"\basync\s+\w+") > 1)),
        ("unchecked_access", (n(r"\w+\.\w+\.\w+\.\w+") > 0) & ~_has(content, r"\?\.|\bif\s*\(\s*!|\bnull\b")),
        ("mutated_literals", _has(content, r"\b(?:let\s+\w+\s*=\s*\{|const\s+\w+\s*=\s*\[)") & (n(r"\.\w+\s*=[^=]|\.push\s*\(") > 5)),
        ("missing_await", _has(content, r"\basync\s+\w+") & _has(content, r"\bPromise<") & ~_has(content, r"\bawait\s")),
        ("uncleared_timer", _has(content, r"\bset(?:Timeout|Interval)\s*\(") & ~_has(content, r"\bclear(?:Timeout|Interval)\b")),
        ("unclosed_resource", _has(content, r"\b(?:fs\.open|createConnection|createServer)\s*\(") & ~_has(content, r"\.(?:close|destroy|end)\s*\(")),
        ("leaking_listener", _has(content, r"\.(?:on|addEventListener)\s*\(") & ~_has(content, r"\.(?:off|removeListener|removeEventListener)\s*\(")),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in cases]))


def design_patterns(content: Column) -> Column:
    """Structs (pattern, confidence): high where all likelier signs stand too, medium where one does, low else."""
    out = []
    for name, (must, may) in DESIGN.items():
        all_ = F.lit(True)
        for e in must:
            all_ = all_ & _has(content, e)
        hits = F.lit(0)
        for e in may:
            hits = hits + _has(content, e).cast("int")
        level = F.when(hits == len(may), "high").when(hits > 0, "medium").otherwise("low") if may else F.lit("medium")
        out.append(F.when(all_, F.struct(F.lit(name).alias("pattern"), level.alias("confidence"))))
    return F.array_compact(F.array(*out))


def sign_counts(sources: DataFrame, signs: dict[str, str], name: str) -> DataFrame:
    """(path, ``name``, n) of the signs that occur in sources (path, content)."""
    counts = F.array(*[F.struct(F.lit(k).alias(name), F.regexp_count("content", F.lit(e)).alias("n")) for k, e in signs.items()])
    return sources.select("path", F.explode(counts).alias("c")).where("c.n > 0").select("path", f"c.{name}", "c.n")


def test_examples(sources: DataFrame) -> DataFrame:
    """(path, title) of the test cases in test files, as examples of use."""
    titles = F.regexp_extract_all("content", F.lit(r"\b(?:it|test)\s*\(\s*['\"`]([^'\"`\n]+)['\"`]"), F.lit(1))
    python = F.regexp_extract_all("content", F.lit(r"(?m)^\s*def\s+(test_\w+)"), F.lit(1))
    return sources.select("path", F.explode(F.concat(titles, python)).alias("title"))
