"""Mixing documents to target weights with soft membership.

A classifier fitted on the labelled table gives every document posteriors over domains. Rates r >= 0 (expected copies) are
then fitted by projected-gradient least squares so that the expected tokens of each domain, the sum of rate x tokens x
posterior, meet the targets. Steps start from rate one and follow the gradient in the metric of tokens, so documents
keep a rate near one unless their domains call for more or less.

A rate depends on its own posterior and on the residuals of all steps so far, a few numbers a step. Each step is therefore
one pass over the narrow table of tokens and posteriors, from which the driver gets one sum per domain; no rates
are collected or kept between steps, and a lost executor's part is simply worked out again. Where texts are kept, they are not
part of that table: they are read and classified once more when their rates are known.

The classifier is a linear model on mean hashed word features, fitted on at most ``MAX_EXAMPLES`` labelled rows (the
smallest hashes of doc_id). Everything else covers all documents and whole texts.

Defined results: null, empty and wordless texts have no tokens and keep rate one; labels without a domain are no examples,
and without examples all posteriors are equal; repeated rows each get a row; columns named like the results are replaced; an
empty table gives no rows. Targets are shares of the documents' total tokens and need not sum to one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LETTERS, LOWER, checkpointed, give_back, span_hashes, spans, table, text_chunks

MAX_EXAMPLES, BUCKETS, ROUNDS, STEPS, CLOSE, STALL = 4000, 1 << 14, 150, 60, 1e-7, 1e-4
TARGETS = {"high": 0.85, "low": 0.10, "toxic": 0.05}
PIPELINE_TARGETS = {"high": 0.92, "low": 0.08, "toxic": 0.0}


def domain_of_label() -> Column:
    """The domain that a row of ``labels`` names."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")


def _buckets(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature buckets of the words and of their first four bytes, and each row's first word."""
    low = LOWER[buf]
    s, e, first = spans(low, off, LETTERS)
    return span_hashes(low, s, e) % np.uint64(BUCKETS), span_hashes(low, s, np.minimum(e, s + 4)) % np.uint64(BUCKETS), first


class DomainClassifier:
    """Multinomial logistic regression on mean features; (BUCKETS, domains) weights and a bias."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray, int]], domains: int):
        self.weights, self.bias = np.zeros((BUCKETS, domains)), np.zeros(domains)
        if not rows:
            return
        row = np.repeat(np.arange(len(rows)), [len(i) for i, _, _ in rows])
        index, value = np.concatenate([i for i, _, _ in rows]).astype(np.int64), np.concatenate([v for _, v, _ in rows])
        y = np.eye(domains)[[d for _, _, d in rows]]
        seen, rate = np.full((BUCKETS, domains), 1e-8), 0.5
        self.bias = np.log(y.mean(axis=0) + 1e-3)
        for _ in range(ROUNDS):  # full-batch Adagrad
            z = np.stack([np.bincount(row, value * self.weights[index, k], len(rows)) for k in range(domains)], axis=1) + self.bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p = (p / p.sum(axis=1, keepdims=True) - y) / len(rows)
            g = np.stack([np.bincount(index, value * p[row, k], BUCKETS) for k in range(domains)], axis=1) + 1e-7 * self.weights
            seen += g * g
            self.weights -= rate * g / np.sqrt(seen)
            self.bias -= rate * p.sum(axis=0)

    def posteriors(self, a: np.ndarray, b: np.ndarray, first: np.ndarray) -> np.ndarray:
        n = np.maximum(1, np.diff(first))
        z = np.empty((len(n), len(self.bias)))
        for k in range(len(self.bias)):
            total = np.r_[0, np.cumsum(self.weights[a, k] + self.weights[b, k])]
            z[:, k] = SCALE * np.diff(total[first]) / n + self.bias[k]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


SCALE = 20.0  # of mean features, so that one word in a hundred can weigh


def _encode(batches):
    for batch in batches:
        for i, j, buf, off in text_chunks(batch.column("text")):
            a, b, first = _buckets(buf, off)
            out = []
            for x, y in zip(first, first[1:]):
                index, n = np.unique(np.r_[a[x:y], b[x:y]], return_counts=True)
                out.append((index.astype(np.int32).tobytes(), (SCALE * n / max(1, y - x)).tobytes()))
            part = batch.slice(i, j - i)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("domain"), pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.binary())], ["doc_id", "domain", "index", "value"])


def fit(docs: DataFrame, labels: DataFrame, domains: list[str], domain: Column | None = None, max_examples: int = MAX_EXAMPLES) -> DomainClassifier:
    """The classifier of the labelled rows."""
    rows = labels.select("doc_id", (domain_of_label() if domain is None else domain).alias("domain")).where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull())
    rows = rows.groupBy("doc_id").agg(F.max("domain").alias("domain")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(rows), "doc_id")  # at most max_examples narrow rows
    got = sample.mapInArrow(_encode, "doc_id long, domain string, index binary, value binary").collect()  # at most max_examples rows
    got.sort(key=lambda r: (r.doc_id, bytes(r["index"])))
    return DomainClassifier([(np.frombuffer(r["index"], np.int32), np.frombuffer(r["value"]), domains.index(r.domain)) for r in got], len(domains))


def memberships(docs: DataFrame, classifier: DomainClassifier, keep: list[str], rated=None) -> DataFrame:
    """The columns ``keep`` with n_tokens (words) and the posteriors p of every row; ``rated``: what adds rate and shortfall to them."""
    model = docs.sparkSession.sparkContext.broadcast(classifier)
    read = docs.select(*dict.fromkeys([*keep, "text"]))
    kinds = dict(read.dtypes)

    def scored(batches):
        classifier = model.value
        for batch in batches:
            for i, j, buf, off in text_chunks(batch.column("text")):
                a, b, first = _buckets(buf, off)
                p = classifier.posteriors(a, b, first)
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(np.diff(first)), pa.array(p.tolist(), pa.list_(pa.float64()))], [*keep, "n_tokens", "p"])
        give_back()

    run = scored if rated is None else lambda batches: rated(scored(batches))
    return read.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "n_tokens long, p array<double>", *[_RATED] * (rated is not None)]))


_RATED = "rate double, shortfall double"


def _rates(p: np.ndarray, history: list[tuple[np.ndarray, float]], step: float, look: float) -> tuple[np.ndarray, np.ndarray]:
    """Rates after the steps of ``history`` (residual at the point looked at, momentum to there), and the next point."""
    r = np.ones(len(p))
    before = r
    for residual, momentum in history:
        z = r + momentum * (r - before)
        before, r = r, np.maximum(0.0, z - step * (p @ residual))
    return r, r + look * (r - before)


def _posteriors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def solve(members: DataFrame, targets: list[float], steps: int = STEPS) -> tuple[list[tuple[np.ndarray, float]], float, float]:
    """The residuals of the steps, the step length, and the shortfall: how far from the targets the last point looked at was.

    Sums over ``members`` (n_tokens, p) alone. The steps end at ``CLOSE``, after ``steps``, or when three of them in a row gain
    next to nothing, as with targets that no rates can meet; the shortfall then says what is left.
    """
    k = len(targets)
    slim = members.select("n_tokens", "p")

    def sums(history, step, look, gram):
        def run(batches):
            for batch in batches:
                n, p = batch.column("n_tokens").to_numpy().astype(np.float64), _posteriors(batch.column("p"))
                if len(n):
                    out = (p * n[:, None]).T @ p if gram else ((_rates(p, history, step, look)[1] * n) @ p)[None, :]
                    total = np.r_[out.ravel(), n.sum()]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["i", "x"])

        rows = slim.mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()  # a few sums
        out = np.zeros((k * k if gram else k) + 1)
        for r in rows:
            out[r.i] = r.x
        return out[:-1], out[-1]

    gram, total = sums([], 0.0, 0.0, True)
    if not total:
        return [], 0.0, 0.0
    step = 1 / max(1e-12, np.linalg.eigvalsh(gram.reshape(k, k) / total).max())
    goal, history, t, last, look, still, left = np.array(targets), [], 1.0, np.inf, 0.0, 0, 0.0
    for _ in range(steps):
        got, _ = sums(history, step, look, False)
        residual = got / total - goal
        size = float(residual @ residual)
        left = size**0.5
        if size < CLOSE**2:
            break
        if size > last and look:  # the momentum overshot
            t, look = 1.0, 0.0
            last = np.inf
            continue
        still = still + 1 if last - size <= STALL * size else 0
        if still == 3:  # the targets are out of reach and this is as near as they get
            break
        history, last = [*history, (residual, look)], size
        ahead = (1 + (1 + 4 * t * t) ** 0.5) / 2
        t, look = ahead, (t - 1) / ahead
    return history, step, left


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], keep: list[str], source: DataFrame | None = None) -> DataFrame:
    """The columns ``keep`` of every row with n_tokens, the posteriors p, the fitted rate and the fit's shortfall."""
    domains = list(targets)
    keep = [c for c in keep if c not in ("n_tokens", "p", "rate", "shortfall")]
    classifier = fit(docs if source is None else source, labels, domains)
    wide = "text" in keep
    members = checkpointed(memberships(docs, classifier, [] if wide else keep))
    history, step, left = solve(members, list(targets.values()))
    kinds = dict(members.dtypes)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                rate = _rates(_posteriors(batch.column("p")), history, step, 0.0)[0]
                rate = np.where(batch.column("n_tokens").to_numpy() > 0, rate, 1.0)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rate), pa.array(np.full(len(rate), left))], [*batch.schema.names, "rate", "shortfall"])

    if wide:
        return memberships(docs, classifier, keep, run)
    return members.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in members.columns), _RATED]))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, posteriors and rate of every document for the target mixture."""
    found = mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), TARGETS, ["doc_id"])
    return found.select("doc_id", "n_tokens", *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(TARGETS)], "rate", "shortfall")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their tokens, posteriors and rates; columns named like the results are replaced."""
    made = {"n_tokens", "rate", "shortfall", *(f"p_{d}" for d in PIPELINE_TARGETS)}
    odd = {"p": "_kept_p"} if "p" in docs.columns else {}
    kept = [c for c in docs.columns if c not in made]
    renamed = docs.select(*kept).withColumnsRenamed(odd)
    found = mix(renamed, table(spark, sf_dir, "labels"), PIPELINE_TARGETS, renamed.columns, source=table(spark, sf_dir, "documents"))
    return found.select(*[F.col(f"`{odd.get(c, c)}`").alias(c) for c in kept], "n_tokens", *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(PIPELINE_TARGETS)], "rate", "shortfall")
