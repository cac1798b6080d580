"""Relational and iterative operators over elements and typed edges.

Edges are (src, tgt, rel, status, line). Only resolved edges are ever walked. Iterations keep their frontier in the
cluster, subtract what was visited with an anti join and cut lineage with checkpoints; the driver sees one boolean a level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import is_demo_file, is_test_file
from ..session import shared_folder

TIERS = ("inferred", "heuristic", "strong", "exact")


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the cluster's shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def resolved(edges: DataFrame) -> DataFrame:
    """Edges that may be walked."""
    return edges.where((F.col("status") == "resolved") & F.col("src").isNotNull() & F.col("tgt").isNotNull())


def confidence(status: Column, reason: Column, evidence: Column) -> Column:
    """The tier of an edge."""
    return (
        F.when((status == "resolved") & (F.coalesce(reason, F.lit("")) == "field_based_acg"), "heuristic")
        .when((status == "resolved") & (F.coalesce(evidence, F.lit("")) == "provisional"), "heuristic")
        .when(status == "resolved", "exact")
        .when(status.isin("external", "builtin", "typeOnly", "dynamic"), "strong")
        .otherwise("inferred")
    )


def tier_rank(tier: Column) -> Column:
    """3 for exact down to 0 for inferred; -1 for anything else."""
    out = F.when(tier == TIERS[0], 0)
    for i, name in enumerate(TIERS[1:], 1):
        out = out.when(tier == name, i)
    return out.otherwise(-1)


def meets(tier: Column, threshold: str | None) -> Column:
    """Whether a tier reaches the threshold; an unknown threshold filters nothing."""
    return tier_rank(tier) >= TIERS.index(threshold) if threshold in TIERS else F.lit(True)


def resolve(nodes: DataFrame, query: str) -> DataFrame:
    """Elements of the first tier that matches: id, id without line, name, file, path suffix, substring."""
    q = F.lit(query)
    tier = (
        F.when(F.col("id") == q, 1)
        .when(F.regexp_replace("id", r":\d+$", "") == q, 2)
        .when((F.col("name") == q) & (F.col("type") != "doc"), 3)
        .when(F.col("file") == q, 4)
        .when(F.col("file").endswith(F.concat(F.lit("/"), q)) | q.endswith(F.concat(F.lit("/"), F.col("file"))), 5)
        .when(F.lower("id").contains(query.lower()) | F.lower("name").contains(query.lower()) | F.lower("file").contains(query.lower()), 6)
    )
    found = nodes.withColumn("tier", tier).where("tier is not null")
    best = found.agg(F.min("tier").alias("tier"))
    return found.join(F.broadcast(best), "tier")  # one row


def degrees(edges: DataFrame) -> DataFrame:
    """fan_in and fan_out of every element, from one pass that turns an edge into two half-edges."""
    half = edges.select(F.explode(F.array(F.struct(F.col("tgt").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("h"))
    return half.groupBy("h.id").agg(F.sum("h.i").cast("long").alias("fan_in"), F.sum("h.o").cast("long").alias("fan_out"))


def hotspots(edges: DataFrame, nodes: DataFrame, src_only: bool = True, limit: int = 25, offset: int = 0) -> DataFrame:
    """Elements (id, file) by fan-in plus fan-out over resolved calls and imports; ties by id, unknown elements left out.

    With ``src_only`` edges marked ``test_origin`` (a column that may be missing) don't count, and elements of test and demo
    files are not ranked.
    """
    e = resolved(edges).where(F.col("rel").isin("call", "import"))
    if src_only and "test_origin" in edges.columns:
        e = e.where(~F.coalesce("test_origin", F.lit(False)))
    known = nodes.select("id", "file").dropDuplicates(["id"])
    if src_only:
        known = known.where(~is_test_file(F.col("file")) & ~is_demo_file(F.col("file")))
    score = F.col("fan_in") + F.col("fan_out")
    return degrees(e).join(known.select("id"), "id", "left_semi").withColumn("score", score).orderBy(F.desc("score"), "id").offset(offset).limit(limit)


def enrich(edges: DataFrame, nodes: DataFrame, end: str) -> DataFrame:
    """Edges with name and type of one end; an element that isn't there has type unknown."""
    side = nodes.select(F.col("id").alias(end), F.col("name").alias(f"{end}_name"), F.col("type").alias(f"{end}_type"))
    return edges.join(side, end, "left").withColumn(f"{end}_type", F.coalesce(f"{end}_type", F.lit("unknown")))


def reach(edges: DataFrame, seeds: DataFrame, depth: int, inbound: bool = True) -> DataFrame:
    """(id, depth) of what is reached from the seeds (id) in at most ``depth`` steps, at first depth; seeds are left out."""
    step = edges.select(F.col("tgt" if inbound else "src").alias("id"), F.col("src" if inbound else "tgt").alias("next"))
    if depth > 1:  # read by every level, so written once, by its key
        step = checkpointed(step.where("id is not null and next is not null").repartition("id"))
    seen = seeds.select("id").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for level in range(1, depth + 1):
        fresh = frontier.join(step, "id").select(F.col("next").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("depth", F.lit(level))
        fresh = checkpointed(fresh)
        if fresh.isEmpty():
            break
        seen, frontier = seen.unionByName(fresh), fresh
    return seen.where("depth > 0")


def shortest_path(edges: DataFrame, source, target, depth: int = 10) -> DataFrame:
    """One row with the shortest path's hops and elements, the least path of those; none if there is no path."""
    step = edges.select("src", "tgt").distinct()
    paths = step.where(F.col("src") == F.lit(source)).select(F.col("tgt").alias("at"), F.array("src", "tgt").alias("path"))
    seen = step.where("false").select(F.col("src").alias("at"))
    for hops in range(1, depth + 1):
        paths = checkpointed(paths.join(seen, "at", "left_anti").groupBy("at").agg(F.min("path").alias("path")))
        hit = paths.where(F.col("at") == F.lit(target)).select(F.lit(hops).alias("hops"), "path")
        if not hit.isEmpty() or paths.isEmpty():
            return hit
        seen = seen.unionByName(paths.select("at"))
        paths = paths.join(step, paths.at == step.src).select(F.col("tgt").alias("at"), F.concat("path", F.array("tgt")).alias("path"))
    return paths.where("false").select(F.lit(0).alias("hops"), "path")


def all_paths(edges: DataFrame, source, target, depth: int = 5, limit: int | None = None) -> DataFrame:
    """Simple paths of at most ``depth`` hops, by length and then elements."""
    step = edges.select("src", "tgt").distinct()
    paths = step.where(F.col("src") == F.lit(source)).select(F.array("src", "tgt").alias("path"))
    found = None
    for _ in range(depth):
        hit = paths.where(F.element_at("path", -1) == F.lit(target))
        found = hit if found is None else found.unionByName(hit)
        open_ = paths.where(F.element_at("path", -1) != F.lit(target))
        paths = checkpointed(open_.join(step, F.element_at("path", -1) == F.col("src")).where(~F.array_contains("path", F.col("tgt"))).select(F.concat("path", F.array("tgt")).alias("path")))
    found = found.select(F.size("path").alias("n"), "path").withColumn("hops", F.col("n") - 1).select("hops", "path")
    return found.orderBy("hops", "path").limit(limit) if limit else found


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component) of elements on cycles, named by their smallest id.

    Elements without an edge in or out are trimmed; of the rest each takes the largest id that reaches it as its
    colour, and what reaches a colour's root inside the colour is one component, which then leaves the graph. Every round
    finds a component at least, so it goes on until none is left.
    """
    todo = checkpointed(edges.where("src <> tgt").select("src", "tgt").distinct())
    done = None
    while True:
        while True:  # trim
            kept = todo.join(todo.select(F.col("tgt").alias("src")).distinct(), "src", "left_semi").join(todo.select(F.col("src").alias("tgt")).distinct(), "tgt", "left_semi").select("src", "tgt")
            kept = checkpointed(kept)
            n, m = kept.count(), todo.count()
            todo = kept
            if n == m:
                break
        if not n:
            break
        colour = checkpointed(todo.select(F.explode(F.array("src", "tgt")).alias("id")).distinct().withColumn("c", F.col("id")))
        before = None
        while True:  # the largest id flows forward
            flow = todo.join(colour, todo.src == colour.id).select(F.col("tgt").alias("id"), "c").unionByName(colour)
            colour = checkpointed(flow.groupBy("id").agg(F.max("c").alias("c")))
            now = colour.agg(F.sum(F.xxhash64("id", "c").cast("decimal(38,0)"))).first()[0]
            if now == before:
                break
            before = now
        inside = todo.join(colour.withColumnsRenamed({"id": "src", "c": "a"}), "src").join(colour.withColumnsRenamed({"id": "tgt", "c": "b"}), "tgt").where("a = b").select("src", "tgt")
        roots = colour.where("id = c").select("id")
        back = reach(inside, roots, 1_000_000, inbound=True).select("id").unionByName(roots)
        found = checkpointed(colour.join(back, "id", "left_semi"))
        done = found if done is None else done.unionByName(found)
        gone = found.select("id")
        todo = checkpointed(todo.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "tgt"), "tgt", "left_anti").select("src", "tgt"))
    if done is None:
        return todo.select(F.col("src").alias("id"), F.col("src").alias("component"))
    named = done.groupBy("c").agg(F.min("id").alias("component"), F.count("*").alias("n")).where("n > 1")  # a root names one component
    return done.join(named, "c").select("id", "component")
