"""Substring dedup over words with prefix-partitioned suffix trees.

Suffixes start at anchors (see :mod:`.repeats`), so a group holds suffixes of one prefix of five words. Where a prefix has
too many suffixes for memory, its windows are suffixes of their own, split by prefixes of 7, 9, 11 or all 13
words, the longer the more there are. In each group the suffixes form a truncated suffix tree:
sorted rows are its leaves and the common prefixes of neighbours its internal nodes. A node deep enough to hold the
rest of a window, split by the words before the anchor, is a repeat; its smallest doc_id keeps the words.

Defined results: null and blank texts have no words; documents of fewer than 13 words lose nothing; rows of one doc_id do not
remove each other's words; a null doc_id counts as the largest; repeated rows each get a row; columns named like the
results are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SOLID, mix, ranges, span_hashes, spans, table
from .repeats import Runs, Unit, remove_repeats

WINDOW, PREFIX = 13, 5
UNIT = Unit(True, WINDOW, PREFIX)


class Subtrees:
    """Truncated suffix trees of many groups: leaves in order, and how deep neighbours share their path."""

    def __init__(self, group: np.ndarray, paths: np.ndarray):
        self.order = np.lexsort((*paths.T[::-1], group))
        sorted_, g = paths[self.order], group[self.order]
        same = sorted_[1:] == sorted_[:-1]
        depth = np.where(same.all(axis=1), paths.shape[1], (~same).argmax(axis=1))
        self.shared = np.where(g[1:] == g[:-1], depth, -1)

    def nodes(self, depth: int) -> np.ndarray:
        """Of every leaf the node that holds it at a depth."""
        out = np.zeros(len(self.order), np.int64)
        out[self.order] = np.r_[0, np.cumsum(self.shared < depth)]
        return out


def solve(runs: Runs) -> np.ndarray:
    """The smallest doc_id of every window of the runs, from the deep nodes of the groups' trees."""
    n = len(runs.group)
    start, end, first = spans(runs.buf, runs.off, SOLID)
    words = span_hashes(runs.buf, start, end)
    total = np.diff(first)
    reach = WINDOW - PREFIX
    place = np.arange(n, dtype=np.uint64)[:, None] * np.uint64(64)
    right = mix(place + np.arange(WINDOW, dtype=np.uint64))  # no two paths share what lies beyond their ends
    left = mix(place + np.arange(32, 32 + reach, dtype=np.uint64))
    row, k = np.repeat(np.arange(n), total), ranges(np.zeros(n, np.int64), total)
    ahead = k - runs.left[row]
    r = (ahead >= 0) & (ahead < WINDOW)
    right[row[r], ahead[r]] = words[r]
    left[row[~r & (ahead < 0)], -1 - ahead[~r & (ahead < 0)]] = words[~r & (ahead < 0)]
    forward, backward = Subtrees(runs.group, right), Subtrees(runs.group, left)
    at = np.cumsum(runs.windows) - runs.windows
    best = np.repeat(runs.low, runs.windows)
    for before in range(reach + 1):  # windows that begin so many words before the anchor
        k = np.flatnonzero((before <= runs.left) & (before > runs.left - runs.windows))
        if len(k):
            node = forward.nodes(WINDOW - before)[k] * (n + 1) + backward.nodes(before)[k]
            _, node = np.unique(node, return_inverse=True)
            low = np.full(node.max() + 1, 2**63 - 1)
            np.minimum.at(low, node, runs.low[k])
            best[at[k] + runs.left[k] - before] = low[node]
    return best


def deduplicate(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with n_symbols (words), n_removed, n_spans and the words kept, joined by spaces."""
    return remove_repeats(docs, UNIT, solve, keep)


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that repeat a window of a document of smaller doc_id."""
    found = deduplicate(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", F.col("n_symbols").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated words; a text that loses none stays as it is."""
    odd = {"n_symbols", "n_removed", "n_spans", "kept", "p"} & set(docs.columns)
    names = {c: f"__{c}" if c in odd else c for c in docs.columns}
    found = deduplicate(docs.withColumnsRenamed({a: b for a, b in names.items() if a != b}), list(names.values()))
    text = F.when(F.col("n_removed") > 0, F.decode("kept", "UTF-8")).otherwise(F.col("text"))
    size = F.when(F.col("n_removed") > 0, F.char_length(text).cast("long")).otherwise(F.col("n_chars")) if "n_chars" in names else None
    made = {"text": text} | ({"n_chars": size} if size is not None else {})
    return found.select(*[made.get(c, F.col(f"`{names[c]}`")).alias(c) for c in docs.columns])


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 13], ' ') AS s FROM (SELECT doc_id, w, unnest(range(len(w) - 12)) AS i FROM d WHERE len(w) >= 13)),
m AS (SELECT s, min(doc_id) AS low FROM x GROUP BY 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM x JOIN m USING (s) WHERE doc_id > low),
e AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS k FROM d),
r AS (SELECT e.doc_id, count(*) FILTER (g.k IS NOT NULL) AS n, string_agg(word, ' ' ORDER BY e.k) FILTER (g.k IS NULL) AS t FROM e LEFT JOIN g ON e.doc_id = g.doc_id AND e.k = g.k GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)
"""
