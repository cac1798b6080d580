"""Embedding near-duplicates by product quantisation.

Unit vectors go to the inverted list of their nearest coarse centroid with a code of their residual, one byte for each
of eight subspaces. Two unit vectors of cosine c or more lie within ``r = sqrt(2 - 2c)``, so of vectors in two lists the distances to
the plane that bisects the lists' centroids sum to r at most. Of each two lists only vectors meet that can be so near together with the
nearest of the other side, and each pair of vectors meets once. Where they meet, the cosine of one with the direction of the
other's code comes from one matrix product in single precision; a pair is a candidate unless the angle exceeds that of c
by more than the angle between the other vector and its code. Neither step can lose a pair, whatever the data.
Candidates are reranked by the exact cosine in double precision.

Equal vectors collapse to one row with a count. Vectors are written once, to files of bounded size that hold whole lists, or blocks of
one that is larger. A task reads pairs of files, each pair once, and compares the vectors of their lists, so
vectors are never copied to other lists and no pair ever leaves a task: only link counts and spanning
links do. The files go when all pairs are read. There are about as many lists as the square root of the vectors (``LISTS`` to
``MOST_LISTS``). Centroids and codes are fitted on at most ``SAMPLE`` vectors or eight a list, the smallest hashes of their
values; vectors of each length have an index of their own.

Defined results: vectors that are null, zero, or hold null or non-finite components link with nothing: they are their own
component and kept. Vectors of different lengths don't link. Rows with one vec_id count as separate vectors and each get a
row. A row whose vec_id is null links and is counted like any other but names no component; it is kept only if
nothing in its component has a vec_id. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyarrow.dataset import dataset
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, give_back, shared_dir, table
from .components import components, local_components
from .token_counts import storage

COSINE, SUBSPACES, CODES, SAMPLE, LISTS, MOST_LISTS = 0.9, 8, 256, 8192, 256, 4096
#: Rows compared at once, by rows of the other side, and comparisons of a task.
BLOCK, STEP, WORK = 512, 128, 100_000_000
#: Doubles of vectors that are reranked at once.
RERANKED = 1 << 22
#: About how many files the vectors fill, and the least and most vectors of one.
FILES, LEAST_HELD, MOST_HELD = 48, 4096, 65_536
_SLACK = 1e-6


def _rounding(dimensions: int) -> float:
    """More than a product of two vectors of length 1 at most is off in single precision."""
    return _SLACK + dimensions * 2.0**-23


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centroids from evenly spaced rows of x in the order given; empty ones stay where they were."""
    k = min(k, len(x))
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


class Quantizer:
    """Coarse centroids and the code books of the residuals."""

    def __init__(self, x: np.ndarray, lists: int):
        self.coarse = _kmeans(x, lists)
        rest = x - self.coarse[self.nearest(x)]
        self.cut = np.linspace(0, x.shape[1], min(SUBSPACES, x.shape[1]) + 1).astype(int)
        self.books = [_kmeans(rest[:, a:b], CODES) for a, b in zip(self.cut, self.cut[1:])]
        self.apart = np.sqrt(np.maximum(0, (self.coarse**2).sum(1)[:, None] + (self.coarse**2).sum(1) - 2 * self.coarse @ self.coarse.T))

    def _coarse_distances(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(0, (x * x).sum(1)[:, None] + (self.coarse**2).sum(1) - 2 * x @ self.coarse.T)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return np.argmin(self._coarse_distances(x), axis=1)

    def encode(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and the length of what they leave out."""
        rest = x - self.coarse[lists]
        codes = np.zeros((len(x), len(self.books)), np.uint8)
        error = np.zeros(len(x))
        for m, (a, b) in enumerate(zip(self.cut, self.cut[1:])):
            codes[:, m] = np.argmin((self.books[m] ** 2).sum(1) - 2 * rest[:, a:b] @ self.books[m].T, axis=1)
            error += ((rest[:, a:b] - self.books[m][codes[:, m]]) ** 2).sum(1)
        return codes, np.sqrt(error)

    def probes(self, x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of all lists that can hold a vector within ``radius`` of a row."""
        d = self._coarse_distances(x)
        own = np.argmin(d, axis=1)
        gap = d - d[np.arange(len(x)), own][:, None]
        return np.nonzero(gap <= 2 * self.apart[own] * (radius + _SLACK) + _SLACK)

    def decode(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The vectors that codes in lists stand for."""
        out = self.coarse[lists]
        for m, (a, b) in enumerate(zip(self.cut, self.cut[1:])):
            out[:, a:b] += self.books[m][codes[:, m]]
        return out

    def distances(self, queries: np.ndarray, which: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of the queries to the codes of a list."""
        x = self.decode(np.full(len(codes), which), codes)
        return np.sqrt(np.maximum(0, (queries**2).sum(1)[:, None] + (x**2).sum(1) - 2 * queries @ x.T))

    def gaps(self, x: np.ndarray, own: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """By list and row of x: how much farther, in squared distance, the list's centroid is than that of the row's own list."""
        c = self.coarse.astype(x.dtype)
        size = (c * c).sum(1)
        return size[lists][:, None] - 2 * c[lists] @ x.T - (size[own] - 2 * (c[own] * x).sum(axis=1))


def _packed(x: np.ndarray) -> list[bytes]:
    """Vectors one by one, in single precision where that is exact."""
    short = x.astype("<f4")
    exact = (short == x).all(axis=1)
    return [(a if e else b).tobytes() for a, b, e in zip(short, x.astype("<f8"), exact)]


def _unpacked(column, dimensions: int) -> np.ndarray:
    rows = column.to_pylist()
    out, short = np.empty((len(rows), dimensions)), np.array([len(v) == 4 * dimensions for v in rows], bool)
    for kind, which in (("<f4", short), ("<f8", ~short)):
        out[which] = np.frombuffer(b"".join(rows[k] for k in np.flatnonzero(which)), kind).reshape(-1, dimensions)
    return out


_READY: dict[str, Quantizer] = {}


def _load(model) -> Quantizer:
    """The broadcast quantizer; a Python worker unpacks it once."""
    name, quantizer = model.value
    if name not in _READY:
        _READY.clear()
        _READY[name] = quantizer
    return _READY[name]


class _Held:
    """The vectors of a file, in order of their lists."""

    def __init__(self, folder: str, file: int, quantizer: Quantizer):
        found, path = storage(folder)
        t = dataset(f"{path}/file={file}", filesystem=found, format="parquet").to_table(columns=["node", "n", "vector", "own", "code"])
        t = t.take(np.argsort(t.column("own").to_numpy(), kind="stable"))
        self.node, self.n, self.own = (t.column(c).to_numpy() for c in ("node", "n", "own"))
        self.begin = np.flatnonzero(np.r_[True, self.own[1:] != self.own[:-1]])
        self.end, self.lists = np.r_[self.begin[1:], len(self.own)], self.own[self.begin]
        self.vector = _unpacked(t.column("vector"), int(quantizer.cut[-1]))
        self.length = np.sqrt((self.vector**2).sum(axis=1))
        unit = _unit(self.vector)
        self.unit = unit.astype(np.float32)
        seen = quantizer.decode(self.own, np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint8).reshape(len(t), -1))
        seen /= np.maximum(np.linalg.norm(seen, axis=1, keepdims=True), 1e-30)
        #: Directions of the codes, and the angles between them and the vectors.
        self.seen, self.off = seen.astype(np.float32), np.arccos(np.clip((unit * seen).sum(axis=1), -1, 1))


def _meetings(quantizer: Quantizer, asked: _Held, stored: _Held, cosine: float):
    """Blocks (rows of asked, rows of stored) in which each pair of vectors as near as ``cosine`` is met once; a file meets itself, too."""
    slack = 10 * _rounding(int(quantizer.cut[-1]))
    there, back = quantizer.gaps(asked.unit, asked.own, stored.lists), quantizer.gaps(stored.unit, stored.own, asked.lists)
    nearest, reverse = np.minimum.reduceat(there, asked.begin, axis=1), np.minimum.reduceat(back, stored.begin, axis=1).T
    # the gaps of both ends sum to 2 (y - x) (c' - c) for vectors x, y and the centroids c, c' of their lists
    limit = 2 * quantizer.apart[np.ix_(stored.lists, asked.lists)] * math.sqrt(max(0.0, 2 - 2 * cosine)) + slack
    open_ = nearest + reverse <= limit
    if asked is stored:
        open_ = np.tril(open_)
    for s, a in zip(*np.nonzero(open_)):
        lo, first = asked.begin[a], stored.begin[s]
        g, h = there[s, lo : asked.end[a]], back[a, first : stored.end[s]]
        u, v = np.argsort(g), np.argsort(h)
        g, h = g[u], h[v]
        u, v = lo + u[: np.searchsorted(g, limit[s, a] - h[0], "right")], first + v
        for i in range(0, len(u), STEP):  # the farther these are, the fewer they can meet
            end = int(np.searchsorted(h, limit[s, a] - g[i], "right"))
            for j in range(0, end, BLOCK):
                yield u[i : i + STEP], v[j : min(j + BLOCK, end)]


def _candidates(quantizer: Quantizer, asked: _Held, stored: _Held, cosine: float):
    """Rows (of asked, of stored) of pairs whose codes allow the cosine, some thousands at once."""
    least = (np.cos(np.minimum(np.pi, stored.off + math.acos(max(-1.0, min(1.0, cosine))))) - _rounding(int(quantizer.cut[-1]))).astype(np.float32)
    most = max(1, RERANKED // int(quantizer.cut[-1]))
    held, size = [], 0
    for u, v in _meetings(quantizer, asked, stored, cosine):
        at = np.flatnonzero(asked.unit[u] @ stored.seen[v].T >= least[v])
        if len(at):
            pair = np.stack([u[at // len(v)], v[at % len(v)]])
            held.append(pair[:, pair[0] > pair[1]] if asked is stored and asked.own[u[0]] == stored.own[v[0]] else pair)
            size += held[-1].shape[1]
        if size >= most:
            whole = np.concatenate(held, axis=1)
            yield from (whole[:, i : i + most] for i in range(0, size, most))
            held, size = [], 0
    if size:
        yield np.concatenate(held, axis=1)


def _compare(model, cosine: float, folder: str):
    """For rows (i, j) of files: links between the vectors of both."""

    def meet(quantizer: Quantizer, asked: _Held, stored: _Held) -> pa.RecordBatch:
        q, x = asked.node, stored.node
        links = [np.zeros(len(q), np.int64), np.zeros(len(x), np.int64)]
        tied = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        for u, v in _candidates(quantizer, asked, stored, cosine):
            hit = (asked.vector[u] * stored.vector[v]).sum(axis=1) / (asked.length[u] * stored.length[v]) >= cosine
            u, v = u[hit], v[hit]
            if not len(u):
                continue
            links[0] += np.bincount(u, stored.n[v], len(q)).astype(np.int64)
            links[1] += np.bincount(v, asked.n[u], len(x)).astype(np.int64)
            tied = [np.r_[tied[0], u], np.r_[tied[1], len(q) + v]]
            if len(tied[0]) > 1 << 20:  # spanning links say as much
                root = local_components(len(q) + len(x), *tied)
                tied[0] = np.flatnonzero(root != np.arange(len(root)))
                tied[1] = root[tied[0]]
        ids, counts = np.r_[q, x], np.r_[links[0], links[1]]
        hit = np.flatnonzero(counts)
        root = local_components(len(ids), *tied)
        held = np.flatnonzero(ids != ids[root])
        out = np.r_[ids[hit], ids[held]], np.r_[counts[hit], np.zeros(len(held), np.int64)], np.r_[np.full(len(hit), -1), ids[root[held]]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in out], ["a", "n", "b"])

    def run(batches):
        quantizer = _load(model)
        last, stored = None, None
        for batch in batches:
            for i, j in zip(batch.column("i").to_pylist(), batch.column("j").to_pylist()):
                if i != last:
                    stored = None
                    last, stored = i, _Held(folder, i, quantizer)
                yield meet(quantizer, stored if i == j else _Held(folder, j, quantizer), stored)
        give_back()

    return run


def _index(classes: DataFrame, size: int, cosine: float, lists: int, sample: int) -> DataFrame:
    """Of the distinct vectors (node, n, v), all of one length: link counts (a, n, -1) and spanning links (a, 0, b)."""
    spark = classes.sparkSession
    picked = classes.orderBy(F.xxhash64("v"), "node").limit(max(sample, 8 * lists)).select("v").toArrow()  # bounded by the limit
    quantizer = Quantizer(_unit(_matrix(picked.column("v"))), lists)
    model = spark.sparkContext.broadcast((uuid.uuid4().hex, quantizer))
    margin = math.sqrt(max(0.0, 2 - 2 * cosine)) / 2

    def assign(batches):
        quantizer = _load(model)
        for batch in batches:
            raw = _matrix(batch.column("v"))
            if len(raw):
                x = _unit(raw)
                own = quantizer.nearest(x)
                codes, _ = quantizer.encode(x, own)
                row, _ = quantizer.probes(x, margin)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node"), batch.column("n"), pa.array(_packed(raw), pa.binary()), pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(np.bincount(row, minlength=len(x)))],
                    ["node", "n", "vector", "own", "code", "asks"],
                )

    coded = classes.select("node", "n", "v").mapInArrow(assign, "node long, n long, vector binary, own int, code binary, asks long")
    coded = checkpointed(coded)
    own = coded.groupBy("own").agg(F.count("*").alias("s"), F.sum("asks").alias("asks")).collect()  # at most ``lists`` rows
    rows = sum(r.s for r in own)
    most = min(MOST_HELD, max(LEAST_HELD, rows // FILES))
    named, files, room = [], 0, 0  # lists fill files in turn; one that is larger is cut into several by the vectors' hashes
    for r in sorted(own):
        if r.s > room:
            files, room = files + max(1, math.ceil(r.s / most)), most if r.s <= most else 0
        blocks = max(1, math.ceil(r.s / most))
        named.append((r.own, files - blocks, blocks))
        room = max(0, room - r.s)
    where = F.broadcast(spark.createDataFrame(named, "own int, first long, blocks long"))
    folder = f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}"
    coded.join(where, "own").withColumn("file", F.col("first") + F.pmod(F.xxhash64("node"), F.col("blocks"))).drop("first", "blocks", "asks").write.partitionBy("file").parquet(folder)
    there = sorted(r.file for r in spark.read.parquet(folder).select(F.col("file").cast("int").alias("file")).distinct().collect())  # a row a file
    work = rows / max(1, len(quantizer.coarse)) * sum(r.asks for r in own)
    m = len(there)
    parts = min(m * (m + 1) // 2, max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(work / WORK)))
    held = F.array(*map(F.lit, there))
    # a first file and the one as far from the end meet m + 1 files at or after them, together: as many in each row of pairs
    row, column = F.floor(F.col("id") / (m + 1)).cast("int"), (F.col("id") % (m + 1)).cast("int")
    fits = column < m - row
    pairs = spark.range(0, (m + 1) // 2 * (m + 1), 1, parts).where(fits | (row != m - 1 - row))
    pairs = pairs.select(F.when(fits, row).otherwise(m - 1 - row).alias("p"), F.when(fits, row + column).otherwise(column - 1).alias("q"))
    pairs = pairs.select(F.element_at(held, F.col("p") + 1).alias("i"), F.element_at(held, F.col("q") + 1).alias("j"))
    found = checkpointed(pairs.mapInArrow(_compare(model, cosine, folder), "a long, n long, b long"))
    place, path = storage(folder)
    place.delete_dir(path)
    return found


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, lists: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    v = F.col("embedding")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double") + 0.0).alias("v"), F.coalesce(fine, F.lit(False)).alias("fine"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull())
    lone = rows.where(~F.col("fine")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    good = rows.where("fine").select("vec_id", "v")
    name = [F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("g")]  # 128 bits stand for a vector in joins
    classes = good.groupBy("v").agg(F.min("vec_id").alias("low"), F.count("*").alias("n"))
    classes = checkpointed(classes.withColumn("node", F.monotonically_increasing_id()))
    found = None
    for r in sorted(classes.groupBy(F.size("v").alias("d")).count().where("count > 1").collect()):  # a row for each length
        some = classes.where(F.size("v") == r.d)
        wanted = lists or min(MOST_LISTS, max(LISTS, 1 << math.ceil(math.log2(r["count"]) / 2)))
        got = _index(some, r.d, cosine, wanted, sample)
        found = got if found is None else found.unionByName(got)
    if found is None:
        found = classes.where("false").select(F.col("node").alias("a"), "n", F.col("node").alias("b"))
    links = found.where("b = -1").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    parts = components(found.where("b >= 0").select("a", "b"))
    held = classes.select("node", "low", "n", *name).join(links, "node", "left").join(parts, F.col("node") == F.col("vertex"), "left")
    held = held.withColumn("component", F.coalesce("component", "node"))
    named = held.join(held.groupBy("component").agg(F.min("low").alias("component_id")), "component")
    named = named.select("h", "g", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), "component_id")
    out = good.select("vec_id", *name).join(named, ["h", "g"]).select("vec_id", "n_links", "component_id")
    return out.unionByName(lone).withColumn("kept", kept)


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every embedding."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS n FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b WHERE a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY 1),
k AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, CAST(component_id AS BIGINT) AS component_id, vec_id = component_id AS kept FROM c LEFT JOIN k USING (vec_id)
"""
