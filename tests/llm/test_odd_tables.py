"""Null and repeated ids, very long texts, empty tables and clashing names, for operators and stages; counts end to end."""

import random

import pytest
from pyspark.sql import functions as F
from test_text_operators import docs

from plexgraph.llm import decontaminate, html_text, mixing, simhash, suffix_tree, token_counts

PASSAGE = "the quick brown fox jumps over the lazy dog tonight"


def bench(spark):
    return spark.createDataFrame([(1, PASSAGE), (2, PASSAGE + " again"), (3, "short one"), (4, None), (None, PASSAGE)], "item_id long, text string")


def test_leaks_under_null_ids(spark):
    rows = [(1, f"a b {PASSAGE} c"), (None, f"a b {PASSAGE} c"), (None, "nothing here"), (2, None), (3, ""), (4, "x " * 400_000 + PASSAGE)]
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in decontaminate.contaminated(docs(spark, rows), bench(spark)).collect()}
    assert got[1] == (13, 10, ["1", "2"])
    assert got[None] == (15, 10, ["1", "2"])
    assert got[2] == got[3] == (0, 0, [])
    assert got[4] == (400_010, 10, ["1", "2"])


@pytest.mark.parametrize("most", [0, 3, 10**6])
def test_leaks_whatever_is_broadcast(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", most)
    rows = [(i, f"w{i} {PASSAGE if i % 3 == 0 else 'clean words only'} short one w{i}") for i in range(30)]
    got = {r.doc_id: len(r["items"]) for r in decontaminate.contaminated(docs(spark, rows), bench(spark)).collect()}
    assert got == {i: 3 if i % 3 == 0 else 1 for i in range(30)}


def test_the_leak_stage_decides_null_ids(spark, tmp_path):
    bench(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, PASSAGE), (2, "clean"), (None, "clean too")]
    assert sorted(r.text for r in decontaminate.stage(spark, docs(spark, rows), str(tmp_path)).collect()) == ["clean", "clean too"]
    assert decontaminate.stage(spark, docs(spark, [*rows, (None, PASSAGE)]), str(tmp_path)).count() == 1
    assert decontaminate.stage(spark, docs(spark, []), str(tmp_path)).count() == 0


def test_stages_keep_columns_and_odd_rows(spark, tmp_path):
    bench(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "p", 1.5), (2, "other words", "q", None), (None, None, None, 2.0), (None, "", "r", 0.0), (2, "other words", "q", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, p string, rate double")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    kept = suffix_tree.stage(spark, df, str(tmp_path))
    assert kept.columns == df.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, df.collect()))
    one = simhash.stage(spark, df, str(tmp_path))
    assert one.columns == df.columns
    assert sorted((str(r.doc_id), r.text or "") for r in one.collect()) == [("1", rows[0][1]), ("2", "other words"), ("None", "")]
    mixed = mixing.stage(spark, df, str(tmp_path))
    assert mixed.count() == len(rows)
    assert set(df.columns) <= set(mixed.columns)
    for stage in (suffix_tree.stage, simhash.stage, mixing.stage):
        assert stage(spark, df.where("false"), str(tmp_path)).count() == 0


def test_token_counts_end_to_end(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["word", "Straße", "日本", "x1", "\n"]) for _ in range(rng.randrange(0, 60)))) for i in range(50)] + [(None, "no id"), (3, None), (60, ""), (61, "long " * 300_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    encode = token_counts.encoder().encode_ordinary
    got = sorted((str(r.doc_id), r.n_tokens) for r in token_counts.op8_token_counts(spark, str(tmp_path)).collect())
    assert got == sorted((str(i), len(encode(t or ""))) for i, t in rows)
    df.where("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert token_counts.op8_token_counts(spark, f"{tmp_path}/none").count() == 0


def test_token_files_by_uri(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b c"), (2, "d")], "doc_id long, text string")
    written = token_counts.write_tokens(df, f"file://{tmp_path}/t").cache()
    counts = token_counts.count_tokens(written.where("ordinal = -1").select("file", "bytes"), 4)
    assert sorted(r.n_tokens for r in counts.collect()) == [1, 3]
    with pytest.raises(Exception, match=r"(?i)scheme|uri|protocol"):
        token_counts.storage("nowhere://host/x")


def test_rates_are_the_constrained_least_squares(spark):
    """The targets are met as nearly as nonnegative rates can, with momentum on, against plain projected descent run long."""
    import numpy as np

    rng = np.random.default_rng(3)
    n, p = rng.integers(1, 80, 300), rng.dirichlet([0.4, 0.4, 0.4], 300)
    p[:, 2] = np.minimum(p[:, 2], 0.3)
    p /= p.sum(axis=1, keepdims=True)
    df = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p)], "n_tokens long, p array<double>").repartition(3)
    step = 1 / np.linalg.eigvalsh((p * n[:, None]).T @ p / n.sum()).max()
    for goal in ([0.5, 0.3, 0.2], [0.9, 0.1, 0.0], [1.2, 0.3, 0.1]):
        history, length, left = mixing.solve(df, goal)
        got = mixing._rates(p, history, length, 0.0)[0]
        r = np.ones(300)
        for _ in range(20_000):
            r = np.maximum(0, r - step * (p @ ((r * n) @ p / n.sum() - goal)))
        square = lambda x: float((((x * n) @ p / n.sum() - goal) ** 2).sum())
        assert (got >= 0).all()
        assert square(got) <= square(r) + 5e-4
        assert left == pytest.approx(square(got) ** 0.5, abs=0.02)
        assert left < 1e-5 or goal[0] > 0.5  # what can be met is


def test_very_long_pages_and_empty_ones(spark):
    long = "<article>" + "<p>some words of it here.</p>" * 40_000 + "</article>"
    got = html_text.extract(spark.createDataFrame([(1, "u", long), (1, "u", None)], "page_id long, url string, html string")).collect()
    assert sorted(r.n_chars for r in got) == [0, 40_000 * 23 - 1 + 0]
    assert F is not None


def test_the_mixing_stage_keeps_no_copy_of_the_texts(spark, tmp_path):
    """Its steps read a narrow table: what it writes to the shared folder is far less than the texts."""
    from pathlib import Path

    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(400))) for i in range(500)]
    df = docs(spark, rows)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    folder = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))
    size = lambda: sum(p.stat().st_size for p in folder.rglob("part-*"))
    before = size()
    got = mixing.stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()
    assert {r.doc_id: r.text for r in got} == dict(rows)
    assert all(r.n_tokens == 400 for r in got)
    assert size() - before < sum(len(t) for _, t in rows) / 10
