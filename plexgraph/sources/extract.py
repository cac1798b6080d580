"""Facts of source files: elements with spans and complexity, imports, exports, calls, heritage and docstrings.

Python is parsed; languages with braces are read with comments and strings masked, and bodies end at their matching brace. Each
file is one row and its facts come out as tagged rows, so files spread over tasks and a lost executor's files are
simply read again.
"""

from __future__ import annotations

import ast
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import Registry, masked, scan_text

_FIELDS = (
    ("path", pa.string()), ("fact", pa.string()), ("type", pa.string()), ("name", pa.string()), ("line", pa.int64()), ("end_line", pa.int64()), ("owner", pa.string()),
    ("target", pa.string()), ("names", pa.list_(pa.string())), ("exported", pa.bool_()), ("asynchronous", pa.bool_()), ("doc", pa.string()), ("cyclomatic", pa.int32()), ("cognitive", pa.int32()), ("nesting", pa.int32()),
)
SCHEMA = "path string, fact string, type string, name string, line long, end_line long, owner string, target string, names array<string>, exported boolean, asynchronous boolean, doc string, cyclomatic int, cognitive int, nesting int"
_CALL_WORDS = frozenset("if for while switch catch function return typeof await new delete void super import constructor else do with in of and or not def class lambda elif except assert yield print_".split())


def _fact(fact: str, type_: str, name: str, line: int, **more) -> dict:
    return {"fact": fact, "type": type_, "name": name, "line": line, **more}


_BRANCH = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.match_case)
_NESTS = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.With, ast.AsyncWith, ast.Match)


def _complexity(node: ast.AST) -> tuple[int, int, int]:
    """Cyclomatic, cognitive (a branch costs one more for each level it lies in) and the deepest nesting of a function's own
    body; nested functions have their own."""
    cyclomatic, cognitive, deepest = 1, 0, 0
    todo = [(child, 0) for child in ast.iter_child_nodes(node)]
    while todo:
        n, level = todo.pop()
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)):
            continue
        if isinstance(n, _BRANCH):
            cyclomatic += 1
            if not isinstance(n, ast.comprehension):
                cognitive += 1 + level
        if isinstance(n, ast.BoolOp):
            cyclomatic += len(n.values) - 1
            cognitive += 1
        inner = level + 1 if isinstance(n, _NESTS) else level
        deepest = max(deepest, inner)
        chained = n.orelse[0] if isinstance(n, ast.If) and len(n.orelse) == 1 and isinstance(n.orelse[0], ast.If) else None  # elif doesn't nest
        todo += [(child, level if child is chained else inner) for child in ast.iter_child_nodes(n)]
    return cyclomatic, cognitive, deepest


def python_facts(text: str) -> list[dict]:
    """Facts of one Python file; a file that doesn't parse has one fact of kind error."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError) as e:
        return [_fact("error", "syntax", type(e).__name__, getattr(e, "lineno", None) or 1)]
    out: list[dict] = []

    def walk(node: ast.AST, owner: str | None, scope: str | None) -> None:
        for n in ast.iter_child_nodes(node):
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                name = f"{owner}.{n.name}" if owner else n.name
                a = n.args
                names = [x.arg for x in (*a.posonlyargs, *a.args, *a.kwonlyargs)]
                c = _complexity(n)
                out.append(_fact("element", "method" if owner else "function", name, n.lineno, end_line=n.end_lineno, owner=owner, names=names, exported=not n.name.startswith("_"), asynchronous=isinstance(n, ast.AsyncFunctionDef), doc=ast.get_docstring(n), cyclomatic=c[0], cognitive=c[1], nesting=c[2]))
                walk(n, None, name)
            elif isinstance(n, ast.ClassDef):
                out.append(_fact("element", "class", n.name, n.lineno, end_line=n.end_lineno, exported=not n.name.startswith("_"), doc=ast.get_docstring(n)))
                out.extend(_fact("heritage", "extends", n.name, n.lineno, target=ast.unparse(b)) for b in n.bases)
                walk(n, n.name, scope)
            else:
                if isinstance(n, ast.Import):
                    out.extend(_fact("import", "module", a.asname or a.name, n.lineno, target=a.name, names=[]) for a in n.names)
                elif isinstance(n, ast.ImportFrom):
                    out.append(_fact("import", "names", "." * n.level + (n.module or ""), n.lineno, target="." * n.level + (n.module or ""), names=[a.name for a in n.names]))
                elif isinstance(n, ast.Call):
                    callee = n.func.attr if isinstance(n.func, ast.Attribute) else n.func.id if isinstance(n.func, ast.Name) else None
                    if callee:
                        out.append(_fact("call", "method" if isinstance(n.func, ast.Attribute) else "bare", callee, n.lineno, owner=scope, target=ast.unparse(n.func)))
                elif isinstance(n, ast.Assign) and node is tree:
                    out.extend(_fact("element", "constant", t.id, n.lineno, end_line=n.end_lineno, exported=True) for t in n.targets if isinstance(t, ast.Name) and t.id.isupper())
                walk(n, owner, scope)

    walk(tree, None, None)
    module = ast.get_docstring(tree)
    if module:
        out.append(_fact("docstring", "module", "", 1, doc=module))
    return out


def _body_end(code: str, at: int) -> int:
    """The place after the brace that matches the first one from ``at``; the end of the line if none follows there."""
    open_ = code.find("{", at)
    stop = code.find(";", at)
    if open_ < 0 or (0 <= stop < open_):
        end = code.find("\n", at)
        return len(code) if end < 0 else end
    depth = 0
    for m in re.finditer(r"[{}]", code[open_:]):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return open_ + m.end()
    return len(code)


def jsdoc(comment: str) -> str:
    """The text of a ``/** */`` comment without its stars."""
    lines = [re.sub(r"^\s*\*? ?", "", x) for x in comment.strip()[3:-2].splitlines()]
    return "\n".join(lines).strip()


def braces_complexity(body: str) -> tuple[int, int, int]:
    """Cyclomatic, cognitive and nesting of a masked body, by keywords and braces."""
    cyclomatic, cognitive, deepest, depth = 1, 0, 0, -1
    for m in re.finditer(r"\b(?:if|for|while|case|catch)\b|&&|\|\||\?(?![.?:])|[{}]", body):
        if m[0] == "{":
            depth += 1
            deepest = max(deepest, depth)
        elif m[0] == "}":
            depth -= 1
        else:
            cyclomatic += 1
            cognitive += 1 if m[0] in ("&&", "||", "case") else 1 + max(0, depth)
    return cyclomatic, cognitive, deepest


def braces_facts(text: str, lang: str, registry: Registry | None = None) -> list[dict]:
    """Facts of one file of a language with braces."""
    code = masked(text)
    held = masked(text, strings=False)  # strings stay: import sources are strings
    starts = [0, *(m.end() for m in re.finditer(r"\n", code))]
    line_of = lambda at: code.count("\n", 0, at) + 1
    out: list[dict] = []
    spans: list[tuple[int, int, str, str]] = []
    for type_, name, line, exported in scan_text(text, (registry or Registry()).ordered(lang)):
        at = starts[line - 1]
        end = _body_end(code, code.find(name, at))
        body = code[at:end]
        before = text[:at].rstrip()
        doc = jsdoc(before[before.rfind("/**") :]) if before.endswith("*/") and "/**" in before else None
        params = re.search(rf"{re.escape(name)}[^(\n{{]*\(([^()]*)\)", body)
        names = [re.split(r"[:=?]", x.strip().lstrip("."))[0].strip() for x in params[1].split(",") if x.strip()] if params and type_ in ("function", "method", "component", "hook") else []
        c = braces_complexity(body[body.find("{") :]) if type_ in ("function", "method", "component", "hook") else (None,) * 3
        spans.append((at, end, type_, name))
        out.append(_fact("element", type_, name, line, end_line=line_of(max(at, end - 1)), names=names, exported=exported, asynchronous=bool(re.search(r"\basync\b", body.split("{")[0])), doc=doc, cyclomatic=c[0], cognitive=c[1], nesting=c[2]))
    for f, (at, _, type_, _) in zip(out, spans):
        around = [s for s in spans if s[2] in ("class", "interface") and s[0] < at < s[1]]
        f["owner"] = max(around)[3] if around and type_ in ("method", "property") else None
    for m in re.finditer(r"\bclass\s+([\w$]+)(?:\s*<[^{>]*>)?(?:\s+extends\s+([\w$.]+))?(?:\s*<[^{>]*>)?(?:\s+implements\s+([\w$.,\s<>]+?))?\s*\{", code):
        out += [_fact("heritage", "extends", m[1], line_of(m.start()), target=m[2])] if m[2] else []
        out += [_fact("heritage", "implements", m[1], line_of(m.start()), target=re.sub(r"<.*", "", t).strip()) for t in (m[3] or "").split(",") if t.strip()]
    for m in re.finditer(r"\bimport\s+(type\s+)?([^;'\"`]*?)\s*(?:from\s*)?['\"]([^'\"\n]+)['\"]", held):
        if code[m.start() : m.start() + 6] == "import":
            names = [re.split(r"\s+as\s+", x.strip())[0].removeprefix("type ").strip() for x in re.sub(r"[{}]", ",", m[2]).split(",") if x.strip()]
            out.append(_fact("import", "type" if m[1] else "names", m[3], line_of(m.start()), target=m[3], names=names))
    for m in re.finditer(r"\b(?:import|require)\s*\(\s*(?:['\"]([^'\"\n]+)['\"]|([^)\n]*))\s*\)", held):
        dynamic = held[m.start() : m.start() + 6] == "import" or m[1] is None
        out.append(_fact("import", "dynamic" if dynamic else "names", m[1] or (m[2] or "").strip(), line_of(m.start()), target=m[1], names=[]))
    for m in re.finditer(r"\bexport\s*(\*(?:\s+as\s+([\w$]+))?|\{([^}]*)\})\s*(?:from\s*['\"]([^'\"\n]+)['\"])?", held):
        if m[3] is None:
            out.append(_fact("export", "namespace" if m[2] else "reexport", m[2] or "*", line_of(m.start()), target=m[4]))
        else:
            for part in filter(None, map(str.strip, m[3].split(","))):
                local, _, shown = part.partition(" as ")
                out.append(_fact("export", "reexport" if m[4] else "named", (shown or local).strip(), line_of(m.start()), owner=local.strip(), target=m[4]))
    for m in re.finditer(r"((?:[\w$\])]+\s*\??\.\s*)*)([A-Za-z_$][\w$]*)\s*\(", code):
        name = m[2]
        if name in _CALL_WORDS or re.search(r"\b(?:function|class|fn|func|def)\s*\*?\s*$", code[: m.start()]):
            continue
        if any(s[3] == name and s[0] <= m.start() and line_of(s[0]) == line_of(m.start(2)) and s[2] in ("method", "function", "component", "hook") for s in spans):
            continue  # the declaration itself
        around = [s for s in spans if s[2] in ("function", "method", "component", "hook") and s[0] <= m.start() < s[1]]
        receiver = re.sub(r"\s|\?", "", m[1])
        out.append(_fact("call", "method" if receiver else "bare", name, line_of(m.start(2)), owner=max(around)[3] if around else None, target=receiver + name))
    return out


def facts(sources: DataFrame, registry: Registry | None = None) -> DataFrame:
    """All facts of sources (path, language, content) as rows of ``SCHEMA``; ``fact`` says which kind a row is."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, lang, content in zip(*(c.to_pylist() for c in batch.columns)):
                found = python_facts(content or "") if lang == "py" else braces_facts(content or "", lang, registry) if lang not in (None, "md") else []
                rows += [{"path": path} | f for f in found]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in _FIELDS], [n for n, _ in _FIELDS])

    return sources.select("path", "language", "content").mapInArrow(run, SCHEMA)


def elements(found: DataFrame) -> DataFrame:
    """Elements of extracted facts with their ids, ``@Type/path#name:line``."""
    kind = F.concat(F.upper(F.substring("type", 1, 1)), F.expr("substring(type, 2)"))
    return found.where("fact = 'element'").select(
        F.concat(F.lit("@"), kind, F.lit("/"), "path", F.lit("#"), "name", F.lit(":"), F.col("line").cast("string")).alias("id"),
        "name", "type", F.col("path").alias("file"), "line", "end_line", "owner", F.col("names").alias("parameters"), "exported", "asynchronous", "doc", "cyclomatic", "cognitive", "nesting",
    )


def docstrings(found: DataFrame) -> DataFrame:
    """(file, name, type, line, doc) of all documented elements and modules."""
    return found.where("doc is not null").select(F.col("path").alias("file"), "name", "type", "line", "doc")
