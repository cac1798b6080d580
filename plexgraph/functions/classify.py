"""What a file, a query or a question is: ordered patterns over one string column, the first that matches decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TEST_FILE = r"__tests__|\.test\.|\.spec\."
DEMO_FILE = r"(^|/)examples/|(^|/)demo-[^/]*\.(?:ts|tsx|js|jsx|mjs|cjs)$"


def _has(text: Column, *parts: str) -> Column:
    out = text.contains(parts[0])
    for part in parts[1:]:
        out = out | text.contains(part)
    return out


def slashes(path: Column) -> Column:
    """Forward slashes only; null counts as empty."""
    return F.translate(F.coalesce(path, F.lit("")), "\\", "/")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def is_test_file(path: Column) -> Column:
    """By infix, case kept: the test of tools and edges."""
    return slashes(path).rlike(TEST_FILE)


def is_demo_file(path: Column) -> Column:
    return slashes(path).rlike(DEMO_FILE)


def is_test_like(path: Column) -> Column:
    """By lower-cased folder names or infix of the file name: the test of maps and metrics."""
    low = F.lower(slashes(path))
    return _has(basename(low), ".test.", ".spec.") | low.rlike(r"(^|/)(__tests__|__mocks__|tests?)/")


def is_coverage_test(path: Column) -> Column:
    """With Python's names: the test of coverage reports."""
    name = basename(path)
    return _has(path, ".test.", ".spec.", "__tests__") | name.startswith("test_") | name.endswith("_test.py") | (path.contains("/tests/") & name.endswith(".py"))


def is_gap_test(path: Column) -> Column:
    """The test of test-gap reports."""
    return _has(path, "/tests/", "/test_", ".test.", ".spec.", "__tests__") | path.startswith("tests/") | path.startswith("test_") | path.endswith("_test.py")


def is_entrypoint(path: Column) -> Column:
    """Names and folders that something outside calls; files like tests are none of their own but also excused."""
    low = F.lower(slashes(path))
    return is_test_like(path) | basename(low).rlike(r"^(index|main|app|server|cli|bin)\.[^.]+$") | low.rlike(r"(^|/)(bin|cli|scripts)/")


def query_shape(query: Column) -> Column:
    """quoted, flag, member, identifier (any other single token too) or phrase (empty too)."""
    raw = F.regexp_replace(F.coalesce(query, F.lit("")), r"^\s+|\s+$", "")
    one = (raw != "") & ~raw.rlike(r"\s")
    return (
        F.when((F.char_length(raw) >= 2) & raw.rlike("(?s)^(\".*\"|'.*')$"), "quoted")
        .when(one & raw.rlike(r"^-{1,2}[A-Za-z][\w-]*$"), "flag")
        .when(one & raw.rlike(r"^[A-Za-z_$][\w$]*(\.[A-Za-z_$][\w$]*)+$"), "member")
        .when(one, "identifier")
        .otherwise("phrase")
    )


def query_strategy(query: Column) -> Column:
    """What a rerank should favour."""
    q = F.lower(query)
    return (
        F.when(_has(q, "who uses", "what calls", "usage"), "usage")
        .when(_has(q, "public", "exported", "api"), "public")
        .when(_has(q, "quality", "tested", "coverage"), "quality")
        .when(_has(q, "important", "central", "key"), "centrality")
        .otherwise("general")
    )


def question_type(question: Column) -> Column:
    """Which kind of answer a question asks for; explanations come first."""
    q = F.lower(question)
    return (
        F.when(_has(q, "how does", "what does", "explain", "how works"), "explanation")
        .when(_has(q, "compare", "difference between", "vs", "versus"), "comparison")
        .when(_has(q, "best practice", "should i", "recommend", "improve", "better"), "best-practices")
        .otherwise("qa")
    )


def health_score(severities: Column) -> Column:
    """Mean weight of the dependencies' severities, rounded: high 25, moderate 60, low 100, anything else 50; 100 without any."""
    weight = lambda s: F.when(s == "high", 25).when(s == "moderate", 60).when(s == "low", 100).otherwise(50)
    total = F.aggregate(severities, F.lit(0), lambda a, s: a + weight(s))
    return F.when(F.size(severities) == 0, 100.0).otherwise(F.floor(total / F.size(severities) + 0.5).cast("double"))


def security_score(critical: Column, high: Column, all_: Column, outdated: Column, unused: Column) -> Column:
    """100 less what vulnerabilities, outdated and unused dependencies take off, the last two capped."""
    left = 100 - 40 * critical - 20 * high - 10 * (all_ - critical - high) - F.least(F.lit(20), 2 * outdated) - F.least(F.lit(10), 2 * unused)
    return F.greatest(F.lit(0), F.least(F.lit(100), left))


def maintenance_score(total: Column, outdated: Column, unused: Column, peers: Column, licences: Column) -> Column:
    """100 less the shares of outdated, unused, peer and licence issues; 100 without dependencies."""
    share = (30.0 * outdated + 20.0 * unused + 15.0 * peers + 10.0 * licences) / F.nullif(total, F.lit(0))
    return F.when(total == 0, 100.0).otherwise(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - share)) + 0.5).cast("double"))


def overall_health(security: Column, maintenance: Column, health: Column) -> Column:
    mean = (security + maintenance + health) / 3
    return F.when(mean >= 90, "excellent").when(mean >= 75, "good").when(mean >= 50, "fair").when(mean >= 25, "poor").otherwise("critical")
