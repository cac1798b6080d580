"""Graphs, indexes, exports and registries on storage: written by Spark to any file system and read back as tables."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_NODE = "id string, name string, type string, file string, line long, metadata map<string,string>"
_EDGE = "id string, sourceId string, targetId string, relationship string, resolutionStatus string, evidence struct<kind:string,testOrigin:boolean,confidence:string>, sourceLocation struct<file:string,line:long>, candidates array<string>, reason string"


def _struct(fields: str) -> str:
    return "struct<" + re.sub(r"(^|, )(\w+) ", r"\1\2:", fields) + ">"


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a graph: a folder of tables as :func:`write_graph` leaves it, or one JSON document, zipped or not.

    Edges come as (id, src, tgt, rel, status, file, line, reason, evidence, test_origin, candidates), tables with their own schema.
    A single document is one row by nature; for graphs of any size the tables are the form to keep.
    """
    if not re.search(r"\.json(\.gz)?$", path):
        return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
    schema = f"nodes array<{_struct(_NODE)}>, edges array<{_struct(_EDGE)}>"
    doc = spark.read.schema(schema).option("multiLine", "true").json(path)
    nodes = doc.select(F.explode("nodes").alias("n")).select("n.*")
    e = doc.select(F.explode("edges").alias("e"))
    edges = e.select(
        "e.id", F.col("e.sourceId").alias("src"), F.col("e.targetId").alias("tgt"), F.col("e.relationship").alias("rel"), F.col("e.resolutionStatus").alias("status"), "e.sourceLocation.file", "e.sourceLocation.line",
        "e.reason", F.col("e.evidence.confidence").alias("evidence"), F.coalesce("e.evidence.testOrigin", F.lit(False)).alias("test_origin"), "e.candidates",
    )
    return nodes, edges


def normal_edges(edges: DataFrame) -> DataFrame:
    """Edges with their ids, 16 digits of a hash over ends, kind and place, one row each.

    They go to their places by id before equal ones are dropped, so that each is shuffled and sorted once.
    """
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("src", "rel", "tgt", "file", "line")])
    return edges.withColumn("id", F.substring(F.sha1(key), 1, 16)).repartition("id").dropDuplicates(["id"])


def manifest(files: DataFrame, built: str) -> DataFrame:
    """(path, sha256, built) of files (path, content): what staleness is later measured against."""
    return files.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("sha256"), F.lit(built).alias("built"))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, files: DataFrame | None = None, built: str = "") -> None:
    """Normalised nodes and edges, sorted within their files by id, and the manifest of the sources beside them."""
    nodes.repartitionByRange("id").dropDuplicates(["id"]).sortWithinPartitions("id").write.mode("overwrite").parquet(f"{path}/nodes")
    normal_edges(edges).sortWithinPartitions("id").write.mode("overwrite").parquet(f"{path}/edges")
    if files is not None:
        manifest(files, built).write.mode("overwrite").parquet(f"{path}/manifest")


def write_index(elements: DataFrame, path: str) -> None:
    """The element index in three forms: Parquet, JSON lines and zipped compact JSON lines, which leave nulls out."""
    elements.write.mode("overwrite").parquet(f"{path}/index")
    elements.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/index-json")
    elements.write.mode("overwrite").option("compression", "gzip").json(f"{path}/index-compact")


def load_index(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """An index in any of its forms: Parquet, JSON lines or a JSON document with ``elements``, zipped or not."""
    if re.search(r"\.json(\.gz)?$", path):
        doc = spark.read.option("multiLine", "true").json(path)
        if "elements" in doc.columns:
            return doc.select(F.explode("elements").alias("e")).select("e.*")
        return doc
    if path.rstrip("/").endswith(("-json", "-compact")):
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.json(path)
    return spark.read.parquet(path)


def json_lines(df: DataFrame) -> DataFrame:
    """One JSON object a row, keys in column order."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("line"))


def export_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, line): nodes and edges as JSON lines with the weight of each edge, its number of equal ones."""
    w = edges.groupBy("src", "tgt", "rel").agg(F.count("*").alias("weight"))
    return json_lines(nodes).select(F.lit("node").alias("kind"), "line").unionByName(json_lines(w).select(F.lit("edge").alias("kind"), "line"))


def json_ld(nodes: DataFrame) -> DataFrame:
    """(id, line): nodes as linked data."""
    line = F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.concat(F.lit("Code"), F.initcap("type")).alias("@type"), F.col("id").alias("@id"), "name", F.col("file").alias("url")))
    return nodes.select("id", line.alias("line"))


def dot_lines(edges: DataFrame) -> DataFrame:
    """(position, line) of a digraph, a line an edge, sorted; the first and last lines open and close it."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('\\"')), F.lit('"'))
    body = edges.select(F.lit(1).alias("position"), F.concat(F.lit("  "), quoted("src"), F.lit(" -> "), quoted("tgt"), F.lit(";")).alias("line")).distinct()
    spark = edges.sparkSession
    return spark.createDataFrame([(0, "digraph G {"), (2, "}")], "position int, line string").unionByName(body)


def sync_registry(current: DataFrame, incoming: DataFrame, mode: str = "overwrite") -> DataFrame:
    """Registry entries (key, description, rules, related) with ``incoming`` taken in and the outcome of each.

    ``overwrite`` takes the new entry, ``skip`` keeps the old one, ``merge`` joins the arrays as sets and keeps old text where there is no new.
    """
    if mode not in ("overwrite", "merge", "skip"):
        raise ValueError(f"unknown conflict mode {mode!r}")
    sets = [f.name for f in incoming.schema.fields if f.dataType.typeName() == "array"]
    others = [c for c in incoming.columns if c != "key" and c not in sets]
    a, b = current.select(F.struct(*current.columns).alias("a"), "key"), incoming.select(F.struct(*incoming.columns).alias("b"), "key")
    x = a.join(b, "key", "full_outer")
    old, new = F.col("a").isNotNull(), F.col("b").isNotNull()

    def value(c: str) -> Column:
        va, vb = F.col(f"a.{c}"), F.col(f"b.{c}")
        if mode == "merge" and c in sets:
            union = F.array_sort(F.array_union(F.coalesce(va, F.array()), F.coalesce(vb, F.array())))
            return F.when(old & new, union).when(new, vb).otherwise(va)
        both = va if mode == "skip" else F.coalesce(vb, va) if mode == "merge" else vb
        return F.when(old & new, both).when(new, vb).otherwise(va)

    outcome = F.when(~old, "created").when(~new, "kept").when(F.lit(mode == "skip"), "skipped").when(F.col("a") == F.col("b"), "same").otherwise("merged" if mode == "merge" else "updated")
    return x.select("key", *[value(c).alias(c) for c in (*others, *sets)], outcome.alias("outcome"))


def renamed_sources(sources: DataFrame, sites: DataFrame, old: str, new: str) -> DataFrame:
    """Sources (path, content) with a name replaced as a whole word on the lines of a rename plan (file, line); others as they are.

    Only rows are made: writing them is the caller's, with a patch (:func:`patches`) to look at first.
    """
    plan = sites.groupBy(F.col("file").alias("path")).agg(F.collect_set("line").alias("at"))
    word = rf"(?<![\w$]){re.escape(old)}(?![\w$])"
    lines = F.transform(F.split("content", "\n"), lambda x, i: F.when(F.array_contains("at", (i + 1).cast("long")), F.regexp_replace(x, word, new.replace("$", "\\$"))).otherwise(x))
    x = sources.join(plan.withColumn("at", F.transform("at", lambda v: v.cast("long"))), "path", "left")
    return x.select("path", F.when(F.col("at").isNull(), F.col("content")).otherwise(F.array_join(lines, "\n")).alias("content"))


def with_header(sources: DataFrame, headers: DataFrame) -> DataFrame:
    """Sources with a leading comment (path, header) put in, after a ``#!`` line; files that have it stay."""
    x = sources.join(headers, "path", "left")
    shebang = F.regexp_extract("content", r"\A#![^\n]*\n", 0)
    put = F.concat(shebang, F.col("header"), F.lit("\n"), F.expr("substring(content, length(regexp_extract(content, '\\\\A#![^\\n]*\\n', 0)) + 1)"))
    return x.select("path", F.when(F.col("header").isNull() | F.startswith(F.expr("substring(content, length(regexp_extract(content, '\\\\A#![^\\n]*\\n', 0)) + 1)"), F.col("header")), F.col("content")).otherwise(put).alias("content"))


def patches(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, patch) of the files (path, content) that differ, as unified diffs."""
    both = before.select("path", F.col("content").alias("a")).join(after.select("path", F.col("content").alias("b")), "path").where("a <> b")

    def run(batches):
        import difflib

        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            text = ["\n".join(difflib.unified_diff(a.split("\n"), b.split("\n"), f"a/{p}", f"b/{p}", lineterm="")) for p, a, b in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], ["path", "patch"])

    return both.select("path", "a", "b").mapInArrow(run, "path string, patch string")


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _fields(data: bytes):
    """(number, value) of a protobuf message; values are numbers or bytes."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        if tag & 7 == 0:
            value, at = _varint(data, at)
        elif tag & 7 == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        elif tag & 7 in (1, 5):
            size = 8 if tag & 7 == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {tag & 7}")
        yield tag >> 3, value


def decode_occurrences(data: bytes) -> list[tuple[str, str, int, bool]]:
    """(file, symbol, line from 1, definition) of a SCIP index: documents are field 2, their path 1 and occurrences 2."""
    out = []
    for number, doc in _fields(data):
        if number != 2:
            continue
        parts = list(_fields(doc))
        path = next((v.decode() for n, v in parts if n == 1), "")
        for n, occ in parts:
            if n != 2:
                continue
            symbol, line, roles = "", None, 0
            for k, v in _fields(occ):
                if k == 1:  # a packed range: line, first character, ...
                    line = (_varint(v, 0)[0] if isinstance(v, bytes) else v) if line is None else line
                elif k == 2:
                    symbol = v.decode()
                elif k == 3:
                    roles = v
            if symbol and line is not None:
                out.append((path, symbol, line + 1, bool(roles & 1)))
    return out


def occurrences(indexes: DataFrame, content: str = "content") -> DataFrame:
    """(file, symbol, line, definition) of SCIP index files read as ``binaryFile``; each file is a row and a task decodes its own."""

    def run(batches):
        for batch in batches:
            rows = [r for x in batch.column(0) for r in (decode_occurrences(x.as_py()) if x.is_valid else [])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["file", "symbol", "line", "definition"])

    return indexes.select(content).mapInArrow(run, "file string, symbol string, line long, definition boolean")
