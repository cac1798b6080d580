"""The graph model over the driver tables: elements, typed edges, history, sessions, routes and snapshots.

Every projection prunes to the columns it needs; nothing is collected. Keys, not row numbers, give lines, so no
projection shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SQL_NODES = """
nodes AS (
  SELECT '@R/' || r_regionkey AS id, r_name AS name, 'region' AS type, 'world' AS file, CAST(r_regionkey AS BIGINT) AS line, CAST(NULL AS VARCHAR) AS layer FROM region
  UNION ALL SELECT '@N/' || n_nationkey, n_name, 'nation', 'region/' || n_regionkey, CAST(n_nationkey AS BIGINT), NULL FROM nation
  UNION ALL SELECT '@C/' || c_custkey, c_name, 'customer', 'nation/' || c_nationkey, c_custkey, c_mktsegment FROM customer
  UNION ALL SELECT '@S/' || s_suppkey, s_name, 'supplier', 'nation/' || s_nationkey, s_suppkey, NULL FROM supplier
  UNION ALL SELECT '@P/' || p_partkey, p_name, 'part', 'brand/' || p_brand, p_partkey, p_brand FROM part
  UNION ALL SELECT '@O/' || o_orderkey, 'order' || o_orderkey, 'orders', 'customer/' || o_custkey, o_orderkey, o_orderpriority FROM orders)"""
SQL_EDGES = """
edges AS (
  SELECT '@O/' || o_orderkey AS src, '@C/' || o_custkey AS tgt, 'import' AS rel, 'resolved' AS status, CAST(0 AS BIGINT) AS line FROM orders
  UNION ALL SELECT '@C/' || c_custkey, '@N/' || c_nationkey, 'import', 'resolved', 0 FROM customer
  UNION ALL SELECT '@S/' || s_suppkey, '@N/' || s_nationkey, 'import', 'resolved', 0 FROM supplier
  UNION ALL SELECT '@N/' || n_nationkey, '@R/' || n_regionkey, 'import', 'resolved', 0 FROM nation
  UNION ALL SELECT '@O/' || l_orderkey, '@P/' || l_partkey, 'call', CASE l_returnflag WHEN 'N' THEN 'resolved' WHEN 'R' THEN 'ambiguous' ELSE 'unresolved' END, CAST(l_linenumber AS BIGINT) FROM lineitem
  UNION ALL SELECT '@O/' || l_orderkey, '@S/' || l_suppkey, 'call', CASE l_returnflag WHEN 'N' THEN 'resolved' WHEN 'R' THEN 'ambiguous' ELSE 'unresolved' END, CAST(l_linenumber AS BIGINT) FROM lineitem)"""
SQL_STEPS = """
steps AS (SELECT DISTINCT src, tgt FROM (SELECT user_id AS src, lead(user_id) OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id) AS tgt FROM events) WHERE tgt IS NOT NULL)"""
SQL_COMMITS = """
commits AS (SELECT 'c' || user_id || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS hash, 'dev' || user_id AS author, CAST(floor(epoch(ts)) AS BIGINT) AS epoch, event_type || '/f' || (event_id % 23) || '.ts' AS file, CAST(floor(abs(value)) AS BIGINT) AS added, CAST(event_id % 7 AS BIGINT) AS deleted FROM events)"""
SQL_ELEMENTS = """
elements AS (SELECT doc_id, source || '#' || doc_id AS name, lang AS kind, source AS file, text AS body, n_chars, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS loc FROM documents)"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str, bytes_each: int = 256 << 10) -> DataFrame:
    """Narrow rows over at least as many tasks as the session asks for, however few files they lie in: for work that costs far more
    than reading. More tasks for more than ``bytes_each`` of stored bytes a task."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(max(least, -(-size // bytes_each)) if size < 1 << 50 else least, key)


def _key(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, type, file (its container), line and layer of every element."""
    none = F.lit(None).cast("string")

    def part(table: str, prefix: str, key: str, name: Column, kind: str, file: Column, layer: Column) -> DataFrame:
        return read(spark, sf_dir, table).select(_key(prefix, key).alias("id"), name.alias("name"), F.lit(kind).alias("type"), file.alias("file"), F.col(key).cast("long").alias("line"), layer.alias("layer"))

    out = part("region", "@R/", "r_regionkey", F.col("r_name"), "region", F.lit("world"), none)
    for p in (
        part("nation", "@N/", "n_nationkey", F.col("n_name"), "nation", _key("region/", "n_regionkey"), none),
        part("customer", "@C/", "c_custkey", F.col("c_name"), "customer", _key("nation/", "c_nationkey"), F.col("c_mktsegment")),
        part("supplier", "@S/", "s_suppkey", F.col("s_name"), "supplier", _key("nation/", "s_nationkey"), none),
        part("part", "@P/", "p_partkey", F.col("p_name"), "part", F.concat(F.lit("brand/"), "p_brand"), F.col("p_brand")),
        part("orders", "@O/", "o_orderkey", _key("order", "o_orderkey"), "orders", _key("customer/", "o_custkey"), F.col("o_orderpriority")),
    ):
        out = out.unionByName(p)
    return out


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, tgt, rel, status and line of every edge; foreign keys are imports, order lines are calls."""

    def part(table: str, src: Column, tgt: Column, rel: str, status: Column, line: Column) -> DataFrame:
        return read(spark, sf_dir, table).select(src.alias("src"), tgt.alias("tgt"), F.lit(rel).alias("rel"), status.alias("status"), line.cast("long").alias("line"))

    sure, top = F.lit("resolved"), F.lit(0)
    status = F.when(F.col("l_returnflag") == "N", "resolved").when(F.col("l_returnflag") == "R", "ambiguous").otherwise("unresolved")
    out = part("orders", _key("@O/", "o_orderkey"), _key("@C/", "o_custkey"), "import", sure, top)
    for p in (
        part("customer", _key("@C/", "c_custkey"), _key("@N/", "c_nationkey"), "import", sure, top),
        part("supplier", _key("@S/", "s_suppkey"), _key("@N/", "s_nationkey"), "import", sure, top),
        part("nation", _key("@N/", "n_nationkey"), _key("@R/", "n_regionkey"), "import", sure, top),
        part("lineitem", _key("@O/", "l_orderkey"), _key("@P/", "l_partkey"), "call", status, F.col("l_linenumber")),
        part("lineitem", _key("@O/", "l_orderkey"), _key("@S/", "l_suppkey"), "call", status, F.col("l_linenumber")),
    ):
        out = out.unionByName(p)
    return out


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cyclic graph: who acts after whom on a day in each kind of event; a day bounds what a task sorts."""
    from pyspark.sql import Window

    after = F.lead("user_id").over(Window.partitionBy("event_type", F.col("ts").cast("date")).orderBy("ts", "event_id"))
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("src"), after.alias("tgt")).where("tgt is not null").distinct()


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hash, author, epoch, file, added, deleted of every change to a file."""
    day = F.date_format(F.col("ts").cast("date"), "yyyy-MM-dd")
    return read(spark, sf_dir, "events").select(
        F.concat(F.lit("c"), F.col("user_id").cast("string"), F.lit("-"), day).alias("hash"), _key("dev", "user_id").alias("author"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("epoch"),
        F.concat("event_type", F.lit("/f"), (F.col("event_id") % 23).cast("string"), F.lit(".ts")).alias("file"), F.floor(F.abs("value")).cast("long").alias("added"), (F.col("event_id") % 7).alias("deleted"),
    )


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as elements: name, kind, file, body and lines of code."""
    lines = F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return read(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("#"), F.col("doc_id").cast("string")).alias("name"), F.col("lang").alias("kind"), F.col("source").alias("file"), F.col("text").alias("body"), "n_chars", lines.cast("long").alias("loc"))
