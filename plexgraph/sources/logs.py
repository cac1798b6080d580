"""Version control output as tables: commit logs with numbers of lines, and unified diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import interval

#: Starts a commit's line and parts its fields: hash, author, seconds.
MARK = "\x01"


def renamed_path(path: Column) -> Column:
    """The new path of ``a => b`` and ``dir/{a => b}/file``; others as they are."""
    braces = F.regexp_replace(path, r"\{[^{}]* => ([^{}]*)\}", "$1")
    whole = F.regexp_replace(braces, r"^.* => ", "")
    return F.translate(F.trim(F.regexp_replace(whole, r"/{2,}", "/")), "\\", "/")


def numstat(logs: DataFrame, key: str = "log_id", text: str = "log") -> DataFrame:
    """(key, commit, hash, author, epoch, file, added, deleted) of logs whose commits start with ``MARK``hash``MARK``author``MARK``seconds.

    A log is cut at its commits and a commit at its lines, all within the row; lines before the first commit, blank ones and
    those without two tabs are no changes, binary files change zero lines.
    """
    commits = logs.select(key, F.posexplode(F.split(text, rf"(?m)^(?={MARK})")).alias("commit", "body")).where(F.col("body").startswith(MARK))
    lines = commits.select(key, "commit", F.split("body", r"\r?\n").alias("l"))
    head = F.split(F.col("l")[0], MARK)
    part = lambda i: F.when(F.size(head) > i, F.nullif(F.get(head, i), F.lit("")))
    rows = lines.select(key, "commit", part(1).alias("hash"), part(2).alias("author"), F.regexp_extract(F.coalesce(part(3), F.lit("")), r"^\s*(-?\d+)", 1).alias("e"), F.explode(F.slice("l", 2, F.size("l"))).alias("row"))
    rows = rows.where(F.col("row").rlike(r"^[^\t]*\t[^\t]*\t."))
    cell = F.split("row", "\t", 3)
    number = lambda c: F.coalesce(F.nullif(F.regexp_extract(c, r"^\s*(\d+)", 1), F.lit("")).cast("long"), F.lit(0))
    return rows.select(key, "commit", "hash", "author", F.nullif("e", F.lit("")).cast("long").alias("epoch"), renamed_path(cell[2]).alias("file"), number(cell[0]).alias("added"), number(cell[1]).alias("deleted")).where("file <> ''")


def churn(changes: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(file, commits, added, deleted): a file counts once a commit."""
    one = changes.groupBy(*keys, "file", "commit").agg(F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))
    return one.groupBy(*keys, "file").agg(F.count("*").alias("commits"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))


def hunks(diffs: DataFrame, key: str = "diff_id", text: str = "diff") -> DataFrame:
    """(key, file, lo, hi) of the new side's line ranges in unified diffs; a hunk that only deletes is the line it stands at.

    Each file's part starts at its ``+++`` line, so a diff is cut there and hunks keep their file without any state.
    """
    parts = diffs.select(key, F.explode(F.split(text, r"(?m)^(?=\+\+\+ )")).alias("p")).where(F.col("p").startswith("+++ "))
    name = F.translate(F.regexp_replace(F.trim(F.regexp_extract("p", r"\A\+\+\+ ([^\n]*)", 1)), r"^b/", ""), "\\", "/")
    one = parts.select(key, name.alias("file"), F.explode(F.regexp_extract_all("p", F.lit(r"(?m)^@@ -\d+(?:,\d+)? \+(\d+(?:,\d+)?) @@"), F.lit(1))).alias("h")).where("file <> '/dev/null'")
    lo, n = F.split("h", ",")[0].cast("long"), F.coalesce(F.get(F.split("h", ","), 1).cast("long"), F.lit(1))
    return one.select(key, "file", lo.alias("lo"), (lo + F.greatest(n, F.lit(1)) - 1).alias("hi"))


def changed_elements(changed: DataFrame, elements: DataFrame, key: str = "diff_id", width: int = 64) -> DataFrame:
    """(key, id) of the elements (id, file, line) whose spans a hunk touches; a span ends before the next element of its file."""
    from pyspark.sql import Window

    w = Window.partitionBy("file").orderBy("line", "id")
    spans = elements.select("id", F.translate(F.coalesce("file", F.lit("")), "\\", "/").alias("file"), F.coalesce("line", F.lit(0)).cast("long").alias("line"))
    spans = spans.withColumn("end", F.lead("line").over(w) - 1).withColumnRenamed("line", "start").where("end is null or end >= start")
    return interval.overlaps(changed, spans, width, ("file",)).select(key, "id").distinct()
