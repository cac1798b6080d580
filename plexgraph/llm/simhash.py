"""SimHash near-duplicates with a Gray-order hierarchical index.

A text's fingerprint has the bits set in over half of the XXH64 hashes of its 3-word shingles. Fingerprints link at
three differing bits or fewer. Of five blocks of the 64 bits at least two are then equal, so distinct fingerprints
are routed to the bins of all ten pairs of blocks; a bin of more than ``SPLIT`` fingerprints is split again over four
blocks of the bits left, which loses no pair. In its bins each task sorts fingerprints by Gray rank, factors the
bits that all members of a node share into the node, and walks the tree with differences accumulated from root to
leaf: a whole group is left as soon as the sum exceeds three. Bins give spanning links only, and components are
found over the cluster.

Equal texts collapse to one fingerprint before routing, so groups of copies cost one row there.

Defined results: null, empty and blank texts have fingerprint zero, linked like any other; fewer than three words are one
shingle; repeated rows each get a row; the smallest doc_id of a component names it, null doc_ids are left out of that;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, partitions_for, ranges, table
from .components import components, local_components

WORDS, SEED, RADIUS, FANOUT, SPLIT = 3, 42, 3, 8, 20_000
_BLOCKS = (13, 13, 13, 13, 12)
_ONE = np.uint64(1)


def _masks(widths) -> list[int]:
    out, at = [], 0
    for w in widths:
        out.append(((1 << w) - 1) << at)
        at += w
    return out


PAIRS = [a | b for a, b in itertools.combinations(_masks(_BLOCKS), 2)]


def sub_masks(mask: int) -> list[int]:
    """Four blocks of the bits outside ``mask``; of two fingerprints within three bits there, one block is equal."""
    rest = [i for i in range(64) if not mask >> i & 1]
    cut = [len(rest) * k // 4 for k in range(5)]
    return [sum(1 << i for i in rest[a:b]) for a, b in zip(cut, cut[1:])]


def shingle_hashes(text: bytes, run: int = WORDS) -> list[int]:
    """XXH64 of each run of three (``run``) words of the lower-cased text; of the whole if it has fewer."""
    words = text.lower().split()
    if not words:
        return []
    if len(words) < run:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(size)
    start = (ends - size)[: len(words) - run + 1].tolist()
    end = (ends - 1)[run - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], SEED) for a, b in zip(start, end)]


def majority(hashes: list[int] | np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    h = np.asarray(hashes, np.uint64)
    total = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        part = h[i : i + (1 << 16)]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h), bitorder="little").view(np.uint64)[0])


def _fingerprint(batches):
    for batch in batches:
        out = [majority(h) if (h := shingle_hashes(t.as_buffer().to_pybytes() if t.is_valid else b"")) else 0 for t in batch.column("text").cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(out, np.uint64).view(np.int64))], ["doc_id", "f"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, f) of every row; f is the fingerprint's 64 bits as a long."""
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(_fingerprint, f"doc_id {kind}, f long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of a bit pattern in the reflected Gray code."""
    for k in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(k))
    return x


class GrayIndex:
    """Trees over the fingerprints of many bins, all in arrays; nodes never span bins."""

    def __init__(self, bins: np.ndarray, prints: np.ndarray):
        self.order = np.lexsort((gray_rank(prints), bins))
        bins, self.prints = bins[self.order], prints[self.order]
        full = np.full(len(prints), ~np.uint64(0))
        # a level: pattern and mask of shared bits, first and end child, end leaf
        self.levels = [(self.prints, full, np.arange(len(prints)), np.arange(1, len(prints) + 1), np.arange(1, len(prints) + 1))]
        owner = bins
        while True:
            _, first, count = np.unique(owner, return_index=True, return_counts=True)
            if (count == 1).all():
                break
            pattern, mask, _, _, leaf_end = self.levels[-1]
            nodes = -(-count // FANOUT)
            lo = np.repeat(first, nodes) + FANOUT * ranges(np.zeros(len(nodes), np.int64), nodes)
            hi = np.minimum(lo + FANOUT, np.repeat(first + count, nodes))
            same = np.bitwise_and.reduceat(pattern & mask, lo) | np.bitwise_and.reduceat(~pattern & mask, lo)
            self.levels.append((pattern[lo], same, lo, hi, leaf_end[hi - 1]))
            owner = owner[lo]
        self.roots = len(owner)
        top = self.levels[-1]
        self.root_of = np.repeat(np.arange(self.roots), np.diff(np.r_[0, top[4]]))

    def pairs(self, room: int = 1 << 20):
        """Arrays of leaves (a, b), a < b, within three bits; chunks of queries whose frontier stays near ``room``."""
        top = self.levels[-1]
        size = np.diff(np.r_[0, top[4]])[self.root_of]
        weight = np.cumsum(np.maximum(1, size // FANOUT))
        at = 0
        while at < len(self.prints):
            end = max(at + 1, int(np.searchsorted(weight, weight[at] + room)))
            q = np.arange(at, end)
            node = self.root_of[at:end]
            gone = np.bitwise_count((self.prints[q] ^ top[0][node]) & top[1][node]).astype(np.int8)
            keep = (gone <= RADIUS) & (top[4][node] > q + 1)
            q, node, gone = q[keep], node[keep], gone[keep]
            for depth in range(len(self.levels) - 1, 0, -1):
                _, mask, lo, hi, _ = self.levels[depth]
                pattern, below, _, _, leaf_end = self.levels[depth - 1]
                n = hi[node] - lo[node]
                child = ranges(lo[node], n)
                q, gone, above = np.repeat(q, n), np.repeat(gone, n), np.repeat(mask[node], n)
                gone = gone + np.bitwise_count((self.prints[q] ^ pattern[child]) & below[child] & ~above).astype(np.int8)
                keep = (gone <= RADIUS) & (leaf_end[child] > q + 1)
                q, node, gone = q[keep], child[keep], gone[keep]
            keep = node > q
            yield q[keep], node[keep]
            at = end


def _link(group: pa.Table) -> pa.Table:
    """Spanning links of the bins of a group."""
    bins = group.column("bin").to_numpy()
    prints = group.column("f").to_numpy().view(np.uint64)
    ids = group.column("rep").to_numpy()
    index = GrayIndex(bins, prints)
    links_a, links_b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for a, b in index.pairs():
        links_a, links_b = np.r_[links_a, a], np.r_[links_b, b]
        if len(links_a) > 1 << 21:  # spanning links say as much
            root = local_components(len(ids), links_a, links_b)
            links_a = np.flatnonzero(root != np.arange(len(ids)))
            links_b = root[links_a]
    root = local_components(len(ids), links_a, links_b)
    own = np.flatnonzero(root != np.arange(len(ids)))
    ids = ids[index.order]
    return pa.table({"a": ids[own], "b": ids[root[own]]})


def _binned(prints: DataFrame, masks: list[int], salt: int) -> DataFrame:
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.xxhash64(F.lit(salt + i), F.col("f").bitwiseAND(F.lit(m).cast("long"))) for i, m in enumerate(signed)])
    return prints.select("f", "rep", F.posexplode(keys).alias("k", "bin"))


def link(prints: DataFrame, split: int = SPLIT) -> DataFrame:
    """Links (a, b) between the ``rep`` of distinct fingerprints (f, rep) that join all of a component; hashes of block
    values name bins, so two values of one hash merely share a bin."""
    binned = _binned(prints, PAIRS, 0)
    hot = checkpointed(binned.groupBy("k", "bin").count().where(F.col("count") > split).select("k", "bin"))
    if hot.isEmpty():
        bins = binned.select("bin", "f", "rep")
    else:
        bins = binned.join(hot, ["k", "bin"], "left_anti").select("bin", "f", "rep")
        inside = binned.join(hot, ["k", "bin"], "left_semi")
        for i, mask in enumerate(PAIRS):
            part = inside.where(F.col("k") == i).select("f", "rep", F.col("bin").alias("outer"))
            deep = _binned(part.select("f", "rep"), sub_masks(mask), 1000 + 10 * i)
            signed = mask - (1 << 64) if mask >> 63 else mask
            bins = bins.unionByName(deep.select(F.xxhash64("bin", F.col("f").bitwiseAND(F.lit(signed).cast("long"))).alias("bin"), "f", "rep"))
    groups = partitions_for(prints)
    return bins.groupBy(F.pmod("bin", F.lit(groups)).alias("g")).applyInArrow(_link, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint bits and component of every row."""
    prints = checkpointed(fingerprints(docs))
    reps = checkpointed(prints.where("doc_id is not null").groupBy("f").agg(F.min("doc_id").cast("long").alias("rep")))
    found = components(link(reps))
    named = reps.join(found, F.col("rep") == F.col("vertex"), "left").select("f", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(named, "f", "left").select("doc_id", "f", "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: pairs of a 5-word Jaccard similarity of 0.8 or more link, all of them.

    The three bits of :func:`near_duplicates` bind ``op6_simhash`` alone. The smallest doc_id stays, null ids come last,
    and rows that share an id are decided on one by one.
    """
    from .near_copies import one_of_each

    return one_of_each(docs)
