"""Benchmark decontamination by winnowing, in DataFrame functions only.

A window is 8 consecutive words of a benchmark item (a shorter item is one window). Both sides are winnowed: of the
five 4-gram hashes in every 8-word window the smallest is kept, so that a document and an item that share a window
share a fingerprint. Fingerprints are joined to find candidate documents; only those are extended, by joining all
their windows with the item windows on 128 bits of hash of their words, and hits are spread over the words they cover.

Each of the three benchmark sides (fingerprints, windows with their items, short windows) is counted and broadcast only
when its own rows and items are within ``BROADCAST_ROWS``; beyond that its join shuffles. Documents that share text with very many items are no hot key: the join keys are
hashes of windows, and the benchmark side is distinct in them, so AQE can split a hot document side.

Defined results: null and empty texts have no words and no hits; null or empty items have no window; items with equal
ids and texts count once; rows of one doc_id, null too, count as one document whose texts all count (sums of words and hits);
an empty benchmark hits nothing; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table

NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SIZE, GRAM, BROADCAST_ROWS = 8, 4, 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, nothing else; the slow per-character map only where a capital stands beside non-ASCII letters."""
    low = F.lower(text)
    return F.when(low == text, text).when(F.octet_length(text) == F.char_length(text), low).otherwise(F.translate(text, _UPPER, _LOWER))


def words(text: Column) -> Column:
    """The lower-cased words; none for null. Splitting at what is no word is linear; extracting all matches is not."""
    return F.transform(F.array_remove(F.split(F.coalesce(text, F.lit("")), NO_WORD), ""), lambda w: ascii_lower(w))


def let(x: Column, f) -> Column:
    """f(x) with x evaluated once; a plain f(x) repeats x wherever f uses it."""
    return F.transform(F.array(x), lambda v: f(v))[0]


def _combine(x: Column, by: int, f) -> Column:
    """f of every element and the one ``by`` places on; ``by`` elements fewer."""
    return let(x, lambda v: let(F.greatest(F.size(v) - by, F.lit(0)), lambda n: F.zip_with(F.slice(v, 1, n), F.slice(v, by + 1, n), f)))


def gram_hashes(w: Column, size: int, salt: int = 0) -> Column:
    """A 64-bit hash of every run of ``size`` words, built by doubling."""
    x, n = F.transform(w, lambda x: F.xxhash64(x, F.lit(salt))), 1
    while 2 * n <= size:
        x, n = _combine(x, n, lambda a, b: F.xxhash64(a, b)), 2 * n
    if n < size:  # two overlapping runs of n words cover size < 2n words
        x = _combine(x, size - n, lambda a, b: F.xxhash64(a, b))
    return x


def fingerprints(w: Column) -> Column:
    """Winnowed 4-gram hashes of an array of words: the minimum of each run of five; empty below 8 words."""
    two = _combine(gram_hashes(w, GRAM), 1, lambda a, b: F.least(a, b))
    four = _combine(two, 2, lambda a, b: F.least(a, b))
    return F.array_distinct(_combine(four, 1, lambda a, b: F.least(a, b)))


def coarse_words(text: Column) -> Column:
    """Words for fingerprints alone: fast full lower-casing, equal wherever :func:`words` are equal (sigma has one form)."""
    return F.array_remove(F.split(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("\u03c2"), F.lit("\u03c3")), NO_WORD), "")


def windows(w: Column, size: int) -> Column:
    """All windows of ``size`` words as struct<m, i, a, b>: size, position and 128 bits of hash of their words."""
    pairs = F.zip_with(gram_hashes(w, size), gram_hashes(w, size, 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.transform(pairs, lambda x, i: F.struct(F.lit(size).alias("m"), i.alias("i"), x["a"].alias("a"), x["b"].alias("b")))


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_words, n_hit and the items hit, of every document."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text", words(F.col("text")).alias("w")).where("size(w) > 0 and item is not null").dropDuplicates(["item", "text"])
    items = items.select("item", "text", "w", F.least(F.size("w"), F.lit(size)).alias("m"))
    short = sorted(r.m for r in items.where(F.col("m") < size).select("m").distinct().collect())  # below 8 rows

    def every(df: DataFrame, sizes: list[int], *keep: str) -> DataFrame:
        x = let(F.col("w"), lambda w: F.flatten(F.array(*[windows(w, m) for m in sizes])))
        return df.select(*keep, F.explode(x).alias("x")).select(*keep, "x.m", "x.i", "x.a", "x.b")

    grams = every(items.where(F.col("m") == size), [size], "item")
    for m in short:
        grams = grams.unionByName(every(items.where(F.col("m") == m), [m], "item"))
    grams = checkpointed(grams.groupBy("m", "a", "b").agg(F.collect_set("item").alias("items")))
    prints = items.where(F.col("m") == size).select(F.explode(fingerprints(coarse_words(F.col("text")))).alias("f")).distinct()

    def sized(df: DataFrame, weight: Column) -> DataFrame:
        """Broadcast if its rows, weighed by what each holds, are few enough; else as it is."""
        return F.broadcast(df) if (df.agg(F.sum(weight)).first()[0] or 0) <= BROADCAST_ROWS else df

    def same(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        """Joins on doc_id, where null equals null."""
        right = right.withColumnRenamed("doc_id", "_doc")
        return left.join(right, left["doc_id"].eqNullSafe(right["_doc"]), how).drop("_doc")

    once = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), let(coarse_words(F.col("text")), lambda w: F.struct(F.size(w).alias("n"), fingerprints(w).alias("f"))).alias("x"))
    counted = once.select("doc_id", "row", F.col("x.n").alias("n"), F.explode_outer("x.f").alias("f"))
    marked = counted.join(sized(prints.withColumn("hit", F.lit(1)), F.lit(1)), "f", "left")
    base = marked.groupBy("doc_id", "row").agg(F.first("n").alias("n"), F.max("hit").alias("hit"))
    base = checkpointed(base.groupBy("doc_id").agg(F.sum("n").cast("long").alias("n_words"), F.max("hit").alias("hit")))
    candidates = base.where("hit = 1").select("doc_id")
    if short:
        # windows below 8 words have no fingerprint: all documents' windows of those lengths are joined instead
        lone = sized(grams.where(F.col("m") < size).select("m", "a", "b"), F.lit(1))
        some = every(docs.select("doc_id", words(F.col("text")).alias("w")), short, "doc_id").join(lone, ["m", "a", "b"], "left_semi").select("doc_id")
        candidates = candidates.unionByName(some).distinct()

    held = same(docs.select("doc_id", "text"), candidates, "left_semi")
    held = held.select("doc_id", F.monotonically_increasing_id().alias("row"), words(F.col("text")).alias("w"))
    found = every(held, [size, *short], "doc_id", "row").join(sized(grams, F.size("items")), ["m", "a", "b"])
    found = found.groupBy("doc_id", "row").agg(F.array_sort(F.collect_set(F.struct("i", (F.col("i") + F.col("m")).alias("e")))).alias("x"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    # covered words: each interval adds what lies beyond the furthest end before it
    fold = F.aggregate("x", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("e")), lambda a, v: F.struct((a["n"] + F.greatest(v["e"] - F.greatest(v["i"], a["e"]), F.lit(0))).alias("n"), F.greatest(a["e"], v["e"]).alias("e")))
    found = found.select("doc_id", fold["n"].alias("n"), "items").groupBy("doc_id").agg(F.sum("n").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return same(base.select("doc_id", "n_words"), found, "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document stands in benchmark items."""
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n = F.size("items").cast("long")
    return found.select("doc_id", "n_words", "n_hit", n.alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n >= 2).alias("contaminated"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with any benchmark item: one leaked passage is enough to go."""
    found = contaminated(docs, table(spark, sf_dir, "benchmark"))
    out = found.where(F.size("items") >= 1).select(F.col("doc_id").alias("_leaked_doc"))
    return docs.join(out, F.col("doc_id").eqNullSafe(F.col("_leaked_doc")), "left_anti").select(*docs.columns)


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item, m, array_to_string(w[i + 1 : i + m], ' ') AS s FROM (SELECT item, w, least(len(w), 8) AS m, unnest(range(greatest(len(w) - 8, 0) + 1)) AS i FROM b WHERE len(w) > 0)),
x AS (SELECT doc_id, m, i, array_to_string(w[i + 1 : i + m], ' ') AS s FROM (SELECT doc_id, w, m, unnest(range(len(w) - m + 1)) AS i FROM d, (SELECT DISTINCT m FROM g) WHERE len(w) >= m)),
h AS (SELECT DISTINCT doc_id, x.m, i, item FROM x JOIN g ON x.m = g.m AND x.s = g.s),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n, 0) AS BIGINT) AS n_items, sha256(coalesce(t.l, '')) AS items_sha256, coalesce(t.n, 0) >= 2 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
