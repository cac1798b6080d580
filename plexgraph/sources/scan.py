"""Finding source files, leaving ignored ones out, and scanning them for declarations by patterns that can be registered."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classify import slashes

EXTENSIONS = {
    "ts": "ts", "tsx": "tsx", "js": "js", "jsx": "jsx", "mjs": "js", "cjs": "js", "py": "py", "go": "go", "rs": "rs", "java": "java",
    "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "vue": "vue", "svelte": "svelte", "md": "md",
}
#: Extensions whose files can call each other.
FAMILIES = {"ts": "js", "tsx": "js", "js": "js", "jsx": "js", "vue": "js", "svelte": "js", "c": "c", "cpp": "c"}

_IGNORED_FOLDERS = "__pycache__ .cache .git .mypy_cache .next .nuxt .parcel-cache .pytest_cache .ruff_cache .svelte-kit .tox .turbo .venv build coverage dist env node_modules out target venv"
DEFAULT_IGNORES = (*(f"{name}/" for name in _IGNORED_FOLDERS.split()), "**/*.min.js", "**/workbox-*.js", "**/*-" + "[0-9a-f]" * 8 + ".js")


def glob_regex(pattern: str) -> str | None:
    """A line of an ignore file as a regular expression over relative paths; None for blank lines and comments.

    A pattern with a slash at its end is a folder, one without any slash any name at any depth, all others hang on the root.
    Whatever lies below a folder that matches is ignored too.
    """
    p = pattern.strip().replace("\\", "/").removeprefix("./")
    if not p or p.startswith("#"):
        return None
    folder, p = p.endswith("/"), p.rstrip("/")
    out, i = "", 0
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif p[i] == "[" and "]" in p[i:]:
            end = p.index("]", i)
            out, i = out + p[i : end + 1].replace("[!", "[^"), end + 1
        else:
            out, i = out + re.escape(p[i]), i + 1
    return ("(?:^|.*/)" if "/" not in p else "^") + out + ("/.*" if folder else "(?:/.*)?") + "$"


def ignored(path: Column, more: list[str] | tuple[str, ...] = ()) -> Column:
    """Whether the default patterns or ``more`` ignore a relative path: one alternation, matched in the JVM."""
    rules = [r for r in map(glob_regex, (*DEFAULT_IGNORES, *more)) if r]
    return F.regexp_replace(slashes(path), r"^\./", "").rlike("|".join(f"(?:{r})" for r in rules))


def language(path: Column) -> Column:
    """The language of a path by its extension; null for others."""
    known = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return F.try_element_at(known, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)))


def family(path: Column) -> Column:
    """Languages that share names: those of a family, else the language itself."""
    known = F.create_map(*[F.lit(x) for kv in FAMILIES.items() for x in kv])
    lang = language(path)
    return F.coalesce(F.try_element_at(known, lang), lang)


def discover(spark: SparkSession, root: str, languages: list[str] | None = None, ignores: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """(path, language, content) of the source files under a folder of any file system that Spark reads.

    Listing is distributed by Spark, names are filtered before contents are read, and each file is a row: a scan over them runs
    in as many tasks as the bytes need.
    """
    wanted = sorted(e for e, lang in EXTENSIONS.items() if languages is None or lang in languages)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(wanted) + "}").load(root)
    base = re.sub(r"/+$", "", re.sub(r"^[a-z0-9]+:/+", "/", root))
    path = F.regexp_replace("path", "^[a-z0-9]+:/+(?=/)|^[a-z0-9]+:", "")
    path = F.regexp_replace(path, f"^{re.escape(base)}/", "")
    return files.select(path.alias("path"), F.col("content").cast("string").alias("content")).where(~ignored(F.col("path"), ignores)).select("path", language(F.col("path")).alias("language"), "content")


#: Types that win over others for one name on one line.
PRIORITY = {"decorator": 8, "interface": 7, "type": 7, "constant": 6, "property": 5, "component": 5, "hook": 4, "class": 3, "enum": 3, "function": 2, "method": 1}


@dataclass(frozen=True)
class Pattern:
    """A declaration: its type, the expression that finds it and the group that holds its name."""

    type: str
    expression: str
    group: int = 1
    priority: int | None = None

    @property
    def rank(self) -> int:
        return PRIORITY.get(self.type, 0) if self.priority is None else self.priority


_WORD = r"[A-Za-z_$][\w$]*"
_JS = (
    Pattern("interface", rf"\binterface\s+({_WORD})"),
    Pattern("type", rf"\btype\s+({_WORD})\s*(?:<[^=]*>)?\s*="),
    Pattern("enum", rf"\benum\s+({_WORD})"),
    Pattern("class", rf"\bclass\s+({_WORD})"),
    Pattern("constant", r"\bconst\s+([A-Z][A-Z0-9_]+)\s*[:=]"),
    Pattern("component", r"\b(?:function|const)\s+([A-Z][a-z][\w$]*)\s*(?:=\s*(?:async\s*)?\(|\()"),
    Pattern("hook", r"\b(?:function|const)\s+(use[A-Z][\w$]*)"),
    Pattern("function", rf"\bfunction\s*\*?\s*({_WORD})\s*[(<]"),
    Pattern("function", rf"\b(?:const|let|var)\s+({_WORD})\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^()]*\)|{_WORD})\s*(?::[^=]+)?=>"),
    Pattern("method", rf"^[ \t]+(?:(?:public|private|protected|static|async|readonly|get|set)\s+)*({_WORD})\s*\([^()]*\)\s*(?::[^{{;]+)?\{{"),
)
_NOT_NAMES = {"if", "for", "while", "switch", "catch", "function", "return", "constructor", "else", "do", "try", "with"}
PATTERNS: dict[str, tuple[Pattern, ...]] = {
    **dict.fromkeys(("ts", "tsx", "js", "jsx", "vue", "svelte"), _JS),
    "py": (
        Pattern("class", r"^[ \t]*class\s+(\w+)"),
        Pattern("method", r"^[ \t]+(?:async\s+)?def\s+(\w+)"),
        Pattern("function", r"^(?:async\s+)?def\s+(\w+)"),
        Pattern("constant", r"^([A-Z][A-Z0-9_]+)\s*(?::[^=]+)?="),
    ),
    "go": (
        Pattern("method", r"^func\s*\([^)]*\)\s*(\w+)"),
        Pattern("function", r"^func\s+(\w+)"),
        Pattern("interface", r"^type\s+(\w+)\s+interface\b"),
        Pattern("class", r"^type\s+(\w+)\s+struct\b"),
        Pattern("constant", r"^\s*const\s+([A-Z]\w*)"),
    ),
    "rs": (
        Pattern("function", r"\bfn\s+(\w+)"),
        Pattern("class", r"\b(?:struct|union)\s+(\w+)"),
        Pattern("enum", r"\benum\s+(\w+)"),
        Pattern("interface", r"\btrait\s+(\w+)"),
        Pattern("constant", r"\bconst\s+([A-Z][A-Z0-9_]*)"),
    ),
    "java": (
        Pattern("class", r"\b(?:class|record)\s+(\w+)"),
        Pattern("interface", r"\binterface\s+(\w+)"),
        Pattern("enum", r"\benum\s+(\w+)"),
        Pattern("method", r"^\s+(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)+[\w<>\[\], ?]+\s+(\w+)\s*\("),
        Pattern("constant", r"\bstatic\s+final\s+[\w<>\[\]]+\s+([A-Z][A-Z0-9_]*)"),
    ),
    **dict.fromkeys(
        ("c", "cpp"),
        (
            Pattern("class", r"\b(?:class|struct)\s+(\w+)\s*(?:final\s*)?[:{]"),
            Pattern("enum", r"\benum\s+(?:class\s+)?(\w+)"),
            Pattern("function", r"^(?!\s*(?:return|else|if|for|while|switch)\b)[\w:<>*&~ \t]+?[ \t*&]([A-Za-z_]\w*)\s*\([^;{}()]*\)\s*(?:const\s*)?\{"),
            Pattern("constant", r"#define\s+([A-Z][A-Z0-9_]*)"),
        ),
    ),
}


@dataclass
class Registry:
    """Patterns by language; the ones registered later come after those of their rank."""

    patterns: dict[str, list[Pattern]] = field(default_factory=lambda: {k: list(v) for k, v in PATTERNS.items()})

    def register(self, lang: str, pattern: Pattern) -> None:
        """Adds a pattern of a known or a new language; its expression must compile and have the group."""
        if re.compile(pattern.expression).groups < pattern.group:
            raise ValueError(f"{pattern.expression!r} has no group {pattern.group}")
        self.patterns.setdefault(lang, []).append(pattern)

    def ordered(self, lang: str) -> list[Pattern]:
        return sorted(self.patterns.get(lang, ()), key=lambda p: -p.rank)


def masked(text: str, python: bool = False, strings: bool = True) -> str:
    """The text with comments and, with ``strings``, the insides of strings as spaces; lengths and lines stay."""
    comment = r"#[^\n]*" if python else r"//[^\n]*|/\*.*?(?:\*/|\Z)"
    quoted = r"\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|" if python else r"`(?:[^`\\]|\\.)*(?:`|\Z)|"
    quoted += r"\"(?:[^\"\\\n]|\\.)*[\"\n]?|'(?:[^'\\\n]|\\.)*['\n]?"

    def blank(m: re.Match) -> str:
        x = m[0]
        if m.lastgroup == "c":
            return re.sub(r"[^\n]", " ", x)
        return re.sub(r"[^\n\"'`]", " ", x) if strings else x

    return re.sub(rf"(?P<c>{comment})|(?P<q>{quoted})", blank, text, flags=re.S)


def scan_text(text: str, patterns: list[Pattern], python: bool = False) -> list[tuple[str, str, int, bool]]:
    """(type, name, line, exported) by line and name; of several types for one name on a line the one of highest rank."""
    code = masked(text, python)
    lines = [m.start() for m in re.finditer(r"\n", code)]
    best: dict[tuple[int, str], tuple[int, str, bool]] = {}
    from bisect import bisect_left

    for p in patterns:
        for m in re.finditer(p.expression, code, re.M):
            name = m[p.group]
            if name is None or name in _NOT_NAMES:
                continue
            at = m.start(p.group) if p.group else m.start()
            line = bisect_left(lines, at) + 1
            head = code[code.rfind("\n", 0, at) + 1 : at]
            key = (line, name)
            if key not in best or p.rank > best[key][0]:
                best[key] = (p.rank, p.type, bool(re.search(r"\b(?:export|pub|public)\b", head)))
    return [(t, name, line, exported) for (line, name), (_, t, exported) in sorted(best.items())]


def scan(sources: DataFrame, registry: Registry | None = None) -> DataFrame:
    """(path, type, name, line, exported) of what the registry's patterns find in sources (path, language, content)."""
    known = registry or Registry()
    ordered = {lang: known.ordered(lang) for lang in known.patterns}
    columns = [("path", pa.string()), ("type", pa.string()), ("name", pa.string()), ("line", pa.int64()), ("exported", pa.bool_())]

    def run(batches):
        for batch in batches:
            rows = []
            for path, lang, content in zip(*(c.to_pylist() for c in batch.columns)):
                rows += [(path, *r) for r in scan_text(content or "", ordered.get(lang, []), lang == "py")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), columns)], [n for n, _ in columns])

    return sources.select("path", "language", "content").mapInArrow(run, "path string, type string, name string, line long, exported boolean")
