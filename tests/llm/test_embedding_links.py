"""Every link of the embeddings against brute force, where probes from one end alone would miss some."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from plexgraph.llm import embeddings


def brute(ids, x):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    root = np.arange(len(x))
    for _ in range(len(x)):
        low = np.minimum(root, np.where(near, root, len(x)).min(axis=1))
        if (low == root).all():
            break
        root = low
    named = {}
    for i, r in enumerate(root.tolist()):
        if ids[i] is not None:
            named[r] = min(named.get(r, ids[i]), ids[i])
    return [(ids[i], int(near[i].sum()), named.get(int(r))) for i, r in enumerate(root)], near


def key(rows):
    return sorted(tuple(-1 if v is None else v for v in r) for r in rows)


@pytest.mark.parametrize("inner", [3, 4, 8, 64])
def test_links_of_few_inner_dimensions(spark, monkeypatch, inner):
    """Vectors of 64 dimensions that span few, with pairs planted at cosines from 0.88 to 0.97."""
    rng = np.random.default_rng(inner)
    base = rng.normal(size=(900 if inner < 8 else 500, inner)) @ rng.normal(size=(inner, 64))
    side = rng.normal(size=(300, inner)) @ rng.normal(size=(inner, 64))
    a = base[:300] / np.linalg.norm(base[:300], axis=1, keepdims=True)
    side -= (side * a).sum(axis=1, keepdims=True) * a
    side /= np.maximum(1e-9, np.linalg.norm(side, axis=1, keepdims=True))
    c = rng.uniform(0.88, 0.97, (300, 1))
    x = np.r_[base, c * a + np.sqrt(1 - c * c) * side].astype(np.float32).astype(np.float64)
    ids = list(range(len(x)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>").repartition(4)
    want, near = brute(ids, x)
    assert near[:300].any(axis=1).sum() > 100
    got = embeddings.near_duplicates(df, lists=40).collect()
    assert key((r.vec_id, r.n_links, r.component_id) for r in got) == key(want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_odd_vectors(spark):
    """Null and repeated ids, other lengths, clashing names, copies."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 12))
    x = np.r_[x, x[:20] + 0.05 * rng.normal(size=(20, 12)), x[:6]]
    ids = [*range(60), *range(100, 118), None, None, 5, 5, 200, None, None, 3]
    short = rng.normal(size=(4, 3))
    short[3] = 2 * short[0]
    rows = [(i, v.tolist(), "x", 1) for i, v in zip(ids, x)] + [(300 + k, v.tolist(), "x", 1) for k, v in enumerate(short)] + [(400, None, "x", 1), (None, [0.0] * 12, "x", 1), (400, [float("nan")] * 12, "x", 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, node string, n int").repartition(3)
    want = brute(ids, x)[0] + [(300, 1, 300), (301, 0, 301), (302, 0, 302), (303, 1, 300), (400, 0, 400), (None, 0, None), (400, 0, 400)]
    got = embeddings.near_duplicates(df, lists=5).collect()
    assert key((r.vec_id, r.n_links, r.component_id) for r in got) == key(want)
    assert all(r.kept == (r.component_id is None or r.vec_id == r.component_id) for r in got)


@pytest.mark.parametrize(("least", "most"), [(50, 50), (4096, 65_536)])
def test_vectors_are_not_copied_to_the_lists_they_probe(spark, monkeypatch, least, most):
    """Links are whole when lists are cut into several files, and what is compared is read from files, not shuffled."""
    monkeypatch.setattr(embeddings, "LEAST_HELD", least)
    monkeypatch.setattr(embeddings, "MOST_HELD", most)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6, 16))[rng.integers(0, 6, 300)] + 0.25 * rng.normal(size=(300, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    classes = df.select(F.col("embedding").alias("v"), F.col("vec_id").alias("node"), F.lit(1).cast("long").alias("n"))
    seen = []
    monkeypatch.setattr(embeddings, "checkpointed", lambda d: seen.append(d._jdf.queryExecution().optimizedPlan().toString()) or d.checkpoint(eager=True))
    embeddings._index(classes, 16, 0.9, 20, 300)
    assert not any("CoGroup" in p for p in seen)
    got = embeddings.near_duplicates(df, lists=20).collect()
    assert key((r.vec_id, r.n_links, r.component_id) for r in got) == key(brute(list(range(300)), x)[0])


@pytest.mark.parametrize(("held", "odd"), [(75, False), (60, True), (1000, True)])
def test_two_files_are_read_together_once(spark, monkeypatch, held, odd):
    """Not once from either end; a file meets itself, too."""
    monkeypatch.setattr(embeddings, "LEAST_HELD", held)
    monkeypatch.setattr(embeddings, "MOST_HELD", held)

    def told(model, cosine, folder):
        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column("i").cast("int64"), pa.array([0] * len(b), "int64"), b.column("j").cast("int64")], ["a", "n", "b"])

        return run

    monkeypatch.setattr(embeddings, "_compare", told)
    x = np.random.default_rng(9).normal(size=(300, 8))
    df = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(x)], "node long, n long, v array<double>")
    got = [(r.a, r.b) for r in embeddings._index(df, 300, 0.9, 1, 300).collect()]
    files = sorted({f for p in got for f in p})
    assert len(files) % 2 == odd
    assert sorted(tuple(sorted(p)) for p in got) == [(a, b) for a in files for b in files if a <= b]


def test_pairs_are_compared_once_and_fewer_with_more_lists(tmp_path):
    """Random directions and close groups, in two files that share a list: no near pair is left out, next to none is reranked in vain."""
    rng = np.random.default_rng(10)
    x = np.r_[rng.normal(size=(1800, 24)), rng.normal(size=(20, 24))[rng.integers(0, 20, 400)] + 0.2 * rng.normal(size=(400, 24))]
    unit = embeddings._unit(x)
    near = np.triu(unit @ unit.T >= 0.9, 1)
    met = {}
    for lists in (4, 64):
        quantizer = embeddings.Quantizer(unit, lists)
        own = quantizer.nearest(unit)
        codes, _ = quantizer.encode(unit, own)
        rank = np.argsort(own, kind="stable")
        for f, k in enumerate((rank[:900], rank[900:])):
            (folder := tmp_path / f"{lists}/file={f}").mkdir(parents=True)
            pq.write_table(pa.table({"node": k, "n": np.ones(len(k), np.int64), "vector": pa.array(embeddings._packed(x[k]), pa.binary()), "own": own[k].astype(np.int32), "code": pa.array([c.tobytes() for c in codes[k]], pa.binary())}), folder / "part.parquet")
        held = [embeddings._Held(str(tmp_path / str(lists)), f, quantizer) for f in (0, 1)]
        assert held[0].own[-1] == held[1].own[0]
        times, found = np.zeros((len(x), len(x)), int), np.zeros((len(x), len(x)), int)
        for a, b in ((0, 0), (1, 0), (1, 1)):
            for u, v in embeddings._meetings(quantizer, held[a], held[b], 0.9):
                times[np.ix_(held[a].node[u], held[b].node[v])] += 1
            for u, v in embeddings._candidates(quantizer, held[a], held[b], 0.9):
                np.add.at(found, (held[a].node[u], held[b].node[v]), 1)
        same = own[:, None] == own
        assert (times + times.T)[~same].max() == 1  # blocks of a list with itself hold both orders; candidates don't
        assert (found + found.T).max() == 1
        assert (found + found.T)[near].all()
        assert found.sum() < 1.5 * near.sum()
        met[lists] = times.sum()
    assert met[64] < 0.8 * met[4]
