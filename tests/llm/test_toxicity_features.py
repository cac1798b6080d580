"""Whole texts are searched whatever the number of examples, and pruned search stays exact."""

import random

import numpy as np
import pytest

from plexgraph.llm import toxicity


def test_few_examples_still_give_features(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("one two three four five six seven".split()) for _ in range(12)) + (" vile scum" if i % 4 == 0 else " kind")) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(24)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(df, labels).collect()}
    assert all(len(r.evidence) == 3 for r in got.values())
    low, high = [r.score for i, r in got.items() if i % 4], [r.score for i, r in got.items() if i % 4 == 0]
    assert max(low) < min(high)


@pytest.mark.parametrize(("common", "dense"), [(0, 16), (40, 4), (2048, 10**6)])
def test_pruned_search_is_exact(monkeypatch, common, dense):
    """Whatever lists are held dense, the nearest examples and their cosines are those of brute force."""
    monkeypatch.setattr(toxicity, "COMMON", common)
    monkeypatch.setattr(toxicity, "DENSE", dense)
    monkeypatch.setattr(toxicity, "POSTINGS", 500)
    rng = np.random.default_rng(common)
    x = rng.random((400, 300)) * (rng.random((400, 300)) < 0.1) * np.exp(rng.normal(size=300) * 2)
    x[10:30] = x[10] + 0.01 * x[10:30]
    x[50:80] = x[50]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = rng.integers(0, 2, 400)
    index = toxicity.BlockMaxIndex(list(range(400)), label.tolist(), [(np.flatnonzero(v).astype(np.int32), v[v > 0]) for v in x], 300)
    some = x[:80]
    term = [np.flatnonzero(v) for v in some]
    ptr = np.r_[0, np.cumsum([len(t) for t in term])]
    weight = np.concatenate([v[v > 0] for v in some])
    scores, evidence = index.votes(ptr, np.concatenate(term), weight)
    for i, v in enumerate(some):
        d, s = index.nearest(term[i], v[term[i]], 15)
        full = x @ v
        assert np.allclose(s, np.sort(full)[::-1][: len(d)], atol=1e-6)
        assert np.allclose(s, full[d], atol=1e-6)
        assert len(d) == min(15, int((full > 0).sum()))
        assert evidence[i] == d[:3].tolist()
        assert scores[i] == pytest.approx((s @ label[d] + toxicity.SHRINK * label.mean()) / (s.sum() + toxicity.SHRINK))


def test_words_of_one_example_count(spark):
    """The vocabulary is every word of the examples, those of a single one included."""
    rows = [(i, f"common words here rare{chr(97 + i // 26)}{chr(97 + i % 26)}x") for i in range(60)]
    df = spark.createDataFrame([*rows, (100, "rarebcx alone"), (None, "rarebcx"), (101, "x " * 400000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(60)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(df, labels).collect()}
    near = [i for i, t in rows if "rarebcx" in t and __import__("zlib").crc32(str(i).encode()) % 5]
    assert got[100].evidence[:1] == got[None].evidence[:1] == near
    assert len(got) == 63


def test_the_stage_keeps_columns_of_clashing_names(spark, tmp_path):
    rows = [(i, "you vile scum of words" if i % 3 == 0 else "kind plain words here", "mine", 0.25) for i in range(120)]
    docs = spark.createDataFrame([*rows, (None, None, "none", None)], "doc_id long, text string, evidence string, score double")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = toxicity.stage(spark, docs, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == [i for i in range(120) if i % 3]
    assert {(r.evidence, r.score) for r in got} == {("mine", 0.25), ("none", None)}
    held = toxicity.op9_toxicity(spark, str(tmp_path))
    assert held.where("held_out is null").count() == 0


def test_workers_drop_the_index_with_its_broadcast(spark):
    """Python workers live on after the query; the index of the examples doesn't stay in them."""
    df = spark.createDataFrame([(i, f"word{i % 7} other{i % 3}") for i in range(100)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    assert toxicity.score(df, labels).count() == 100

    def held(batches):
        import gc

        import pyarrow as pa

        gc.collect()
        n = sum(type(x).__name__ == "BlockMaxIndex" for x in gc.get_objects())
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([n] * batch.num_rows, pa.int64())], ["n"])

    assert {r.n for r in spark.range(0, 64, 1, 16).mapInArrow(held, "n long").collect()} == {0}


def test_most_blocks_hold_examples_of_one_kind(monkeypatch):
    """Examples of four vocabularies that come in turn: few blocks mix them, so a query leaves the blocks of the others."""
    monkeypatch.setattr(toxicity, "DENSE", 10**6)
    rng = np.random.default_rng(8)
    x = np.zeros((16 * toxicity.BLOCK, 160))
    for i in range(len(x)):
        x[i, 40 * (i % 4) + rng.permutation(40)[:20]] = rng.random(20) + 0.1
    index = toxicity.BlockMaxIndex(list(range(len(x))), rng.integers(0, 2, len(x)).tolist(), [(np.flatnonzero(v).astype(np.int32), v[v > 0]) for v in x], 160)
    kinds = (index.top.reshape(4, 40, index.blocks) > 0).any(axis=1)
    assert index.blocks == 16
    assert kinds.sum() < 1.5 * index.blocks
    assert sorted(index.members.tolist()) == list(range(len(x)))
