"""Toxicity by nearest labelled examples: exact TF-IDF cosine over block-max inverted lists, distance-weighted votes.

* Features are lower-cased words and their first 4, 5 and 6 bytes, so that inflected forms share evidence; the vocabulary
  is every feature of the examples. A feature's weight is its IDF times FLOOR plus the size of its phi coefficient with
  the label, which doesn't depend on the number of examples; none weighs nothing.
* The examples are a sample of at most ``max_examples`` labelled rows (the smallest hashes of doc_id), so the index
  that every executor gets has a fixed bound. Everything else covers all rows and whole texts.
* Search is exact, many queries at a time: short lists are added first; the long ones, held dense in blocks of
  examples, only in blocks whose maxima can still reach the k-th neighbour. What is found is reranked in double precision.
* A score is the cosine-weighted share of toxic neighbours, shrunk towards the base rate; a text without any
  feature in common with any example gets the toxic rate of examples without features.

Defined results: null and empty texts count as texts without features; a null doc_id isn't held out; without labelled rows
every score is 0; rows with a null label are no examples; a doc_id labelled twice counts as toxic if any label says so;
repeated documents each get a row; columns named like the results are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LETTERS, LOWER, checkpointed, give_back, ranges, span_hashes, spans, table, text_chunks

MAX_EXAMPLES, FLOOR, NEIGHBOURS, SHRINK, BLOCK = 6000, 0.02, 15, 0.5, 64
#: Plans of the search, without effect on results: dense lists at most, and how many examples of DENSE they have at least;
#: queries taken at once, and postings within them; what single precision may be off.
COMMON, DENSE, QUERIES, POSTINGS, SLACK = 2048, 16, 128, 1 << 17, 2e-5
_PREFIXES = (4, 5, 6)


def _features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and 64-bit feature ids of all feature occurrences."""
    low = LOWER[buf]
    s, e, first = spans(low, off, LETTERS)
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    rows, ids = [row], [span_hashes(low, s, e)]
    for n in _PREFIXES:
        keep = e - s > n
        rows.append(row[keep])
        ids.append(span_hashes(low, s[keep], s[keep] + n) ^ np.uint64(n))
    return np.concatenate(rows), np.concatenate(ids)


def _count(batches):
    """Per batch: feature id, how many toxic and clean documents have it."""
    for batch in batches:
        labels = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
        for i, j, buf, off in text_chunks(batch.column("text")):
            row, ids = _features(buf, off)
            order = np.lexsort((row, ids))
            row, ids = row[order], ids[order]
            new = np.r_[True, (ids[1:] != ids[:-1]) | (row[1:] != row[:-1])] if len(ids) else np.zeros(0, bool)
            row, ids = row[new], ids[new]
            at = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, np.int64)
            if len(at):
                y = labels[i:j][row]
                pos = np.add.reduceat(y, at)
                n = np.diff(np.r_[at, len(ids)])
                yield pa.RecordBatch.from_arrays([pa.array(ids[at].view(np.int64)), pa.array(pos), pa.array(n - pos)], ["f", "pos", "neg"])


def _terms(buf, off, vocab):
    """Features of the rows over the sorted vocabulary: row pointers, terms, how often."""
    n = len(off) - 1
    row, ids = _features(buf, off)
    if not len(vocab) or not len(ids):
        return np.zeros(n + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    seen, which = np.unique(ids, return_inverse=True)
    at = np.minimum(np.searchsorted(vocab, seen), len(vocab) - 1)
    at[vocab[at] != seen] = -1
    term = at[which]
    key, tf = np.unique(row[term >= 0] * len(vocab) + term[term >= 0], return_counts=True)
    return np.searchsorted(key, np.arange(n + 1) * len(vocab)), key % len(vocab), tf


def _weights(ptr, term, tf, idf):
    """Unit TF-IDF weights of the rows."""
    w = (1 + np.log(tf)) * idf[term]
    row = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    norm = np.sqrt(np.bincount(row, w * w, len(ptr) - 1))
    norm[norm == 0] = 1
    return w / norm[row]


def _encode(words):
    def run(batches):
        vocab = words.value
        for batch in batches:
            for i, j, buf, off in text_chunks(batch.column("text")):
                ptr, term, tf = _terms(buf, off, vocab)
                part = batch.slice(i, j - i)
                cut = lambda x, kind: pa.array([x[a:b].astype(kind).tobytes() for a, b in zip(ptr, ptr[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic").cast(pa.int32()), cut(term, np.int32), cut(tf, np.int32)], ["doc_id", "toxic", "terms", "tf"])

    return run


def _alike(x: np.ndarray) -> np.ndarray:
    """An order of the rows in which like ones stand together: halves, to whole blocks, along the axis of their largest spread."""
    order = np.arange(len(x))
    todo = [(0, len(x))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= BLOCK or not x.shape[1]:
            continue
        part = x[order[lo:hi]]
        part -= part.mean(axis=0)
        axis = part[np.argmax(np.einsum("ij,ij->i", part, part))]
        for _ in range(4):
            axis = (part @ axis) @ part
            axis /= max(float(np.abs(axis).max()), 1e-30)
        order[lo:hi] = order[lo:hi][np.argsort(part @ axis, kind="stable")]
        mid = lo + BLOCK * max(1, round((hi - lo) / BLOCK / 2))
        todo += [(lo, mid), (mid, hi)]
    return order


class BlockMaxIndex:
    """Inverted lists over distinct example vectors, in blocks of ``BLOCK`` with each list's largest weight in the block.

    Vectors that are alike share a block. The ``COMMON`` longest lists are held dense, block by block, with their maxima; a block of
    them is visited only if the maxima let it reach the k-th neighbour. The other lists are short and always added.
    """

    def __init__(self, doc_ids: list[int], labels: list[int], vectors: list[tuple[np.ndarray, np.ndarray]], terms: int):
        ids, y = np.array(doc_ids, np.int64), np.array(labels, np.int64)
        turn = np.lexsort((ids, y))
        self.ids, self.y = ids[turn], y[turn]
        entries: dict[bytes, list[int]] = {}
        for i, j in enumerate(turn.tolist()):
            t, w = vectors[j]
            if len(t):
                key = hashlib.blake2b(np.ascontiguousarray(t, np.int64).tobytes() + np.ascontiguousarray(w, np.float32).tobytes(), digest_size=16).digest()
                entries.setdefault(key, []).append(i)
        members = list(entries.values())
        first = [vectors[turn[m[0]]] for m in members]
        size = np.array([len(t) for t, _ in first], np.int64)
        term = np.concatenate([t for t, _ in first]).astype(np.int32) if first else np.zeros(0, np.int32)
        self.blocks = max(1, -(-len(first) // BLOCK))
        self.width = self.blocks * BLOCK
        many = np.bincount(term, minlength=terms)
        long = np.flatnonzero(many * DENSE >= max(1, len(first)))
        long = np.sort(long[np.argsort(-many[long], kind="stable")[:COMMON]])
        self.slot = np.full(terms + 1, -1, np.int32)
        self.slot[long] = np.arange(len(long))
        common = np.zeros((self.width, len(long)), np.float32)
        for i, (t, w) in enumerate(first):
            at = self.slot[t]
            common[i, at[at >= 0]] = w[at >= 0]
        order = _alike(common[: len(first)])
        self.members = np.array([i for m in order.tolist() for i in members[m]], np.int64)
        self.first = np.r_[0, np.cumsum([len(members[m]) for m in order.tolist()], dtype=np.int64)]
        self.ptr = np.r_[0, np.cumsum(size[order])]
        self.term = term[ranges((np.cumsum(size) - size)[order], size[order])]
        self.weight = np.concatenate([first[m][1] for m in order.tolist()]).astype(np.float32) if first else np.zeros(0, np.float32)
        common[: len(first)] = common[order]
        self.dense = np.ascontiguousarray(common.reshape(self.blocks, BLOCK, len(long)).transpose(0, 2, 1))
        del common
        self.top = np.ascontiguousarray(self.dense.max(axis=2).T)  # of every common list the largest weight in every block
        entry = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(self.ptr))
        rest = np.flatnonzero(self.slot[self.term] < 0)
        rest = rest[np.argsort(self.term[rest], kind="stable")]
        self.doc, self.add = entry[rest], self.weight[rest]
        self.start = np.searchsorted(self.term[rest], np.arange(terms + 1))
        bare = np.array([len(vectors[j][0]) == 0 for j in turn.tolist()], bool)
        self.base = float(self.y.mean()) if len(y) else 0.0
        self.bare = (float(self.y[bare].sum()) + 10 * self.base) / (int(bare.sum()) + 10) if len(y) else 0.0
        self.room = np.zeros(terms)  # a query's weights by term while its candidates are reranked

    def search(self, ptr: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int):
        """Of every query (row pointers, terms, weights) its k nearest distinct vectors at least, with all that tie with the
        last, and their cosines in double precision; exact."""
        for lo in range(0, len(ptr) - 1, QUERIES):
            hi = min(lo + QUERIES, len(ptr) - 1)
            yield from self._search(ptr[lo : hi + 1] - ptr[lo], term[ptr[lo] : ptr[hi]], weight[ptr[lo] : ptr[hi]], k)

    def _short(self, row, term, weight, n: int) -> np.ndarray:
        """What the short lists of n queries (rows, terms, weights) add to their scores, a few queries at a time."""
        first = self.start[term]
        count = self.start[term + 1] - first
        at = np.searchsorted(row, np.arange(n + 1))
        work = np.r_[0, np.cumsum(count)][at]
        score = np.empty((n, self.width), np.float32)
        lo = 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(work, work[lo] + POSTINGS, "right")) - 1)
            a, b = at[lo], at[hi]
            post = ranges(first[a:b], count[a:b])
            cell = np.repeat((row[a:b] - lo) * self.width, count[a:b])
            cell += self.doc[post]
            add = np.repeat(weight[a:b], count[a:b])
            add *= self.add[post]
            score[lo:hi] = np.bincount(cell, add, (hi - lo) * self.width).reshape(hi - lo, self.width)
            lo = hi
        return score

    def _search(self, ptr, term, weight, k):
        n, width = len(ptr) - 1, self.width
        row, slot = np.repeat(np.arange(n), np.diff(ptr)), self.slot[term]
        rare = np.flatnonzero(slot < 0)
        score = self._short(row[rare], term[rare], weight[rare], n)
        query = np.zeros((n, self.dense.shape[1]), np.float32)
        query[row[slot >= 0], slot[slot >= 0]] = weight[slot >= 0]
        least = np.partition(score, width - k, axis=1)[:, width - k] if width > k else np.zeros(n, np.float32)
        split = score.reshape(n, self.blocks, BLOCK)
        visit = split.max(axis=2) + query @ self.top + SLACK >= least[:, None]
        for b in range(self.blocks):
            some = np.flatnonzero(visit[:, b])
            if 4 * len(some) > 3 * n:  # the few others are cleared below
                split[:, b] += query @ self.dense[b]
            elif len(some):
                split[some, b] += query[some] @ self.dense[b]
        split[~visit] = 0
        least = np.partition(score, width - k, axis=1)[:, width - k] if width > k else np.zeros(n, np.float32)
        for i in range(n):
            near = np.flatnonzero((score[i] >= least[i] - SLACK) & (score[i] > 0))
            t = term[ptr[i] : ptr[i + 1]]
            self.room[t] = weight[ptr[i] : ptr[i + 1]]
            ends = list(zip(self.ptr[near].tolist(), self.ptr[near + 1].tolist()))
            if ends:
                product = self.room[np.concatenate([self.term[a:b] for a, b in ends])]
                product *= np.concatenate([self.weight[a:b] for a, b in ends])
                length = self.ptr[near + 1] - self.ptr[near]
                cosine = np.add.reduceat(product, np.cumsum(length) - length)
            else:
                cosine = np.zeros(0)
            self.room[t] = 0
            yield near, cosine

    def _examples(self, near: np.ndarray, cosine: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest examples (ties: the smaller doc_id) of the distinct vectors found."""
        count = np.minimum(self.first[near + 1] - self.first[near], k)
        d, s = self.members[ranges(self.first[near], count)], np.repeat(cosine, count)
        order = np.lexsort((self.ids[d], -s))[:k]
        return d[order], s[order]

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The doc_ids of the k examples of largest positive cosine to one vector (ties: the smaller doc_id) and the cosines; exact."""
        (found,) = self.search(np.array([0, len(terms)]), np.asarray(terms), np.asarray(weights), k)
        d, s = self._examples(*found, k)
        return self.ids[d], s

    def votes(self, ptr: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int = NEIGHBOURS) -> tuple[np.ndarray, list[list[int]]]:
        """Scores of the vectors and the doc_ids of their three nearest examples."""
        scores, evidence = np.full(len(ptr) - 1, self.bare), []
        for i, found in enumerate(self.search(ptr, term, weight, k)):
            d, s = self._examples(*found, k)
            if len(d):
                scores[i] = (s @ self.y[d] + SHRINK * self.base) / (s.sum() + SHRINK)
            evidence.append(self.ids[d[:3]].tolist())
        return scores, evidence


class Model:
    """A fitted model. A Python worker makes its index once and holds it with the broadcast value, so it goes when Spark drops that."""

    def __init__(self, vocab, idf, ids, labels, size, term, tf):
        self.vocab, self.idf, self._parts, self._index = vocab, idf, (ids, labels, size, term, tf), None

    def index(self) -> BlockMaxIndex:
        if self._index is None:
            ids, labels, size, term, tf = self._parts
            ptr = np.r_[0, np.cumsum(size)]
            w = np.zeros(len(term), np.float32)
            for a in range(0, len(size), 256):  # in pieces, for the sake of memory
                b = min(a + 256, len(size))
                w[ptr[a] : ptr[b]] = _weights(ptr[a : b + 1] - ptr[a], term[ptr[a] : ptr[b]], tf[ptr[a] : ptr[b]].astype(np.int64), self.idf)
            vectors = [(term[x:y], w[x:y]) for x, y in zip(ptr, ptr[1:])]
            self._index, self._parts = BlockMaxIndex(ids.tolist(), labels.tolist(), vectors, len(self.vocab)), None
        return self._index


def examples(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> DataFrame:
    """The bounded sample of labelled training rows: doc_id, text, toxic."""
    rows = labels.where("toxic is not null and doc_id is not null and crc32(cast(cast(doc_id as string) as binary)) % 5 != 0")
    rows = rows.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)
    return docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id")  # at most max_examples narrow rows


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> Model:
    """The model of the labelled rows: the vocabulary, its weights, and of every example id, label and terms.

    Its size is bounded by the texts of ``max_examples`` rows.
    """
    spark = docs.sparkSession
    sample = checkpointed(examples(docs, labels, max_examples).coalesce(16))
    n, pos = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    counts = sample.select("text", "toxic").mapInArrow(_count, "f long, pos long, neg long").groupBy("f").agg(F.sum("pos").alias("a"), F.sum("neg").alias("b"))
    df, a = F.col("a") + F.col("b"), F.col("a")
    spread = df * (n - df) * F.lit(float(pos) * (n - pos))
    phi = F.when(spread > 0, F.abs(a * (n - pos - F.col("b")) - F.col("b") * (pos - a)) / F.sqrt(spread)).otherwise(0.0)
    found = counts.select("f", ((F.log((1 + n) / (1 + df)) + 1) * (FLOOR + phi)).alias("w")).toArrow()  # the features of at most max_examples texts
    vocab, idf = found.column("f").to_numpy().view(np.uint64), found.column("w").to_numpy()
    order = np.argsort(vocab)
    vocab, idf = vocab[order], idf[order]
    del found, order
    words = spark.sparkContext.broadcast(vocab)
    rows = sample.mapInArrow(_encode(words), "doc_id long, toxic int, terms binary, tf binary").toArrow()  # at most max_examples rows
    size = np.array([len(x) // 4 for x in rows.column("terms").to_pylist()], np.int64)
    term = np.frombuffer(b"".join(rows.column("terms").to_pylist()), np.int32)
    tf = np.frombuffer(b"".join(rows.column("tf").to_pylist()), np.int32)
    narrow = tf.astype(np.uint8) if tf.max(initial=0) < 256 else tf
    return Model(vocab, idf, rows.column("doc_id").to_numpy(), rows.column("toxic").to_numpy(), size, term, narrow)


def score(docs: DataFrame, labels: DataFrame, source: DataFrame | None = None, keep: tuple[str, ...] | None = None, max_examples: int = MAX_EXAMPLES) -> DataFrame:
    """``docs`` (the columns ``keep``, all by default) with score, predicted and the nearest examples as evidence.

    ``source``: where the texts of labelled rows are read, ``docs`` itself by default.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs if source is None else source, labels, max_examples))
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted", "evidence")]
    read = docs.select(*dict.fromkeys([*names, "text"]))

    def run(batches):
        vocab, idf, index = model.value.vocab, model.value.idf, model.value.index()
        give_back()
        for batch in batches:
            for i, j, buf, off in text_chunks(batch.column("text")):
                ptr, term, tf = _terms(buf, off, vocab)
                scores, evidence = index.votes(ptr, term, _weights(ptr, term, tf, idf))
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in names), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array(evidence, pa.list_(pa.int64()))],
                    [*names, "score", "predicted", "evidence"],
                )

    kinds = dict(read.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "score double, predicted int, evidence array<long>"])
    return read.mapInArrow(run, schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score, learned from the training fold of ``labels``."""
    scored = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=("doc_id",))
    held = F.expr("coalesce(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, false)")
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted", "evidence")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those predicted toxic; columns named like the results keep their own values."""
    odd = {c: f"_kept_{c}" for c in ("score", "predicted", "evidence") if c in docs.columns}
    scored = score(docs.withColumnsRenamed(odd), table(spark, sf_dir, "labels"), source=table(spark, sf_dir, "documents"))
    return scored.where("predicted = 0").select(*[F.col(f"`{odd.get(c, c)}`").alias(c) for c in docs.columns])
