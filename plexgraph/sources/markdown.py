"""Markdown documents: front matter, heading sections with the identifiers they mention, fenced code."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FENCE = re.compile(r"^\s{0,3}(`{3,}|~{3,})\s*([A-Za-z0-9_+-]*)")
_HEADING = re.compile(r"^(#{1,6})\s+(.*\S)\s*$")
_LEXED = {"ts", "tsx", "js", "jsx", "typescript", "javascript"}
_KEYWORDS = frozenset(
    "if for while switch catch return typeof instanceof await new delete void function class const let var import export from as default this super yield in of do else try finally throw case break continue".split()
)
_SECTION = [("heading", pa.string()), ("depth", pa.int32()), ("slug", pa.string()), ("order", pa.int32()), ("line", pa.int64()), ("end_line", pa.int64()), ("mentions", pa.list_(pa.string())), ("identifiers", pa.list_(pa.string()))]
_NAME = r"[A-Za-z_$][A-Za-z0-9_$]*"


def slug(heading: str) -> str:
    """A heading as an anchor: letters, digits and single hyphens, none at the ends."""
    kept = "".join(c for c in heading.strip().lower() if c.isalpha() or c.isnumeric() or c.isspace() or c == "-")
    return re.sub(r"-{2,}", "-", re.sub(r"\s+", "-", kept.strip())).strip("-")


def mention(raw: str) -> str | None:
    """An identifier in backticks, with or without (); None for anything else."""
    token = re.sub(r"\(\s*\)$", "", raw.strip())
    return token if re.fullmatch(_NAME, token) else None


def code_identifiers(code: str) -> list[str]:
    """Identifiers that fenced code imports, calls or constructs, in that order; comments, strings and member calls left out."""
    for pattern, by in ((r"/\*[\s\S]*?\*/", " "), (r"//[^\n]*", " "), (r"'(?:[^'\\\n]|\\.)*'", "''"), (r'"(?:[^"\\\n]|\\.)*"', '""'), (r"`(?:[^`\\]|\\.)*`", "``")):
        code = re.sub(pattern, by, code)
    found = [re.split(r"\s+as\s+", part)[0] for names in re.findall(r"import\s+(?:type\s+)?\{([^}]*)\}", code) for part in names.split(",")]
    found += re.findall(rf"import\s+(?:type\s+)?(?:\*\s+as\s+)?({_NAME})\s+from", code)
    found += re.findall(rf"(?:^|[^.\w$])({_NAME})\s*\(", code)
    found += re.findall(rf"\bnew\s+({_NAME})", code)
    return list(dict.fromkeys(t for t in map(str.strip, found) if re.fullmatch(_NAME, t) and t not in _KEYWORDS))


def split_sections(text: str) -> list[dict]:
    """Sections of one document in order; front matter and fenced lines are no headings, a repeated slug gets -2, -3, ..."""
    lines = re.split(r"\r?\n", text)
    start = 0
    if lines[0].strip() == "---":
        start = next((i + 1 for i in range(1, len(lines)) if lines[i].strip() == "---"), 0)
    out: list[dict] = []
    counts: dict[str, int] = {}
    fence, language, body = None, "", []

    def take(key: str, tokens) -> None:
        if out:
            out[-1][key] += [t for t in dict.fromkeys(tokens) if t is not None and t not in out[-1][key]]

    for i in range(start, len(lines)):
        line = lines[i]
        mark = _FENCE.match(line)
        if mark:
            if fence is None:
                fence, language, body = mark[1][0], mark[2].lower(), []
            elif fence == mark[1][0]:
                if language in _LEXED and body:
                    take("identifiers", code_identifiers("\n".join(body)))
                fence = None
            continue
        if fence is not None:
            body.append(line)
            continue
        head = _HEADING.match(line)
        if head:
            base = slug(head[2]) or f"section-{len(out) + 1}"
            counts[base] = counts.get(base, 0) + 1
            if out:
                out[-1]["end_line"] = i
            out.append({"heading": head[2].strip(), "depth": len(head[1]), "slug": base if counts[base] == 1 else f"{base}-{counts[base]}", "order": len(out), "line": i + 1, "end_line": len(lines), "mentions": [], "identifiers": []})
        take("mentions", map(mention, re.findall(r"`([^`\n]+)`", line)))
    return out


def sections(docs: DataFrame, key: str, content: str = "content") -> DataFrame:
    """A row for each section of every document: ``key``, heading, depth, slug, order, line, end_line, lines, mentions,
    identifiers; null and heading-less documents have none. Documents are parsed one by one in Arrow batches, for
    a fence's state runs through all of its lines."""
    kind = dict(docs.dtypes)[key]
    fields = "heading string, depth int, slug string, order int, line long, end_line long, mentions array<string>, identifiers array<string>"

    def run(batches):
        for batch in batches:
            rows = [(k, s) for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for s in split_sections(text or "")]
            if rows:
                cols = {"key": [k for k, _ in rows]} | {f: [s[f] for _, s in rows] for f in ("heading", "depth", "slug", "order", "line", "end_line", "mentions", "identifiers")}
                yield pa.RecordBatch.from_pydict(cols, pa.schema([("key", batch.schema.types[0]), *_SECTION]))

    found = docs.select(key, content).mapInArrow(run, f"key {kind}, {fields}")
    return found.withColumnRenamed("key", key).withColumn("lines", F.col("end_line") - F.col("line") + 1)


def front_matter(content: Column) -> Column:
    """The scalars of the leading ``---`` block as a map, quotes taken off; null where a document has none."""
    block = F.regexp_extract(content, r"(?s)\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)", 1)
    lines = F.filter(F.split(block, r"\r?\n"), lambda x: x.rlike(r"^[A-Za-z_][\w-]*:\s*\S"))
    pair = lambda x: F.struct(F.regexp_extract(x, r"^([\w-]+):", 1), F.regexp_replace(F.trim(F.regexp_extract(x, r"^[\w-]+:(.*)$", 1)), r"^[\"']|[\"']$", ""))
    first = F.map_from_entries(F.filter(F.transform(lines, lambda x, i: F.struct(pair(x).alias("p"), i.alias("i"))), lambda v: ~F.exists(F.slice(lines, 1, v["i"]), lambda y: F.regexp_extract(y, r"^([\w-]+):", 1) == v["p"]["col1"])).getField("p"))
    return F.when(content.rlike(r"\A---[ \t]*\r?\n"), first)


def front_matter_list(content: Column, name: str) -> Column:
    """A list of the leading block, in brackets or as dashed lines below its name."""
    block = F.regexp_extract(content, r"(?s)\A---[ \t]*\r?\n(.*?)\r?\n---", 1)
    inline = F.regexp_extract(block, rf"(?m)^{name}:[ \t]*\[([^\]]*)\]", 1)
    dashed = F.regexp_extract(block, rf"(?m)^{name}:[ \t]*\r?\n((?:[ \t]*-[^\n]*(?:\n|\z))+)", 1)
    clean = lambda x: F.regexp_replace(F.trim(x), r"^[\"']|[\"']$", "")
    items = F.when(inline != "", F.split(inline, ",")).otherwise(F.regexp_extract_all(dashed, F.lit(r"(?m)^[ \t]*-[ \t]*(.*?)[ \t]*$"), F.lit(1)))
    return F.filter(F.transform(items, clean), lambda x: x != "")


def doc_facts(docs: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """One row a document that states what it documents: kind by its folder, subject, status, documented paths, placeholders;
    sheets without front matter are skipped, other files only count when they ask for it."""
    fm = front_matter(F.col(content))
    folder = F.col(path)
    kind = F.when(folder.contains("resource-sheets/"), "resource-sheet").when(folder.contains("foundation-docs/"), "foundation").otherwise("report")
    x = docs.where(F.col(path).endswith(".md")).select("*", kind.alias("doc_type"), fm.alias("fm"))
    wanted = (F.col("doc_type") == "foundation") | ((F.col("doc_type") == "resource-sheet") & F.col("fm").isNotNull()) | (F.lower(F.col("fm")["ingestion_candidate"]) == "true")
    stated = F.regexp_replace(F.translate(F.col("fm")["documents"], "\\", "/"), r"^\./", "")
    return x.where(wanted).select(
        F.col(path).alias("path"), F.regexp_replace(F.substring_index(path, "/", -1), r"\.md$", "").alias("slug"), "doc_type",
        F.when(F.col("doc_type") == "report", F.coalesce(F.col("fm")["title"], F.col("fm")["artifact_name"], F.col("fm")["genre"])).otherwise(F.col("fm")["subject"]).alias("subject"),
        F.when(F.col("doc_type") == "foundation", "generated").otherwise(F.coalesce(F.col("fm")["status"], F.lit("draft"))).alias("status"),
        stated.alias("documents"), front_matter_list(F.col(content), "related_files").alias("related_files"),
    )
