"""Embeddings, token counts, toxicity, pages and mixing against brute force, exact round trips and held-out labels."""

import itertools
import random
import uuid
from pathlib import Path

import numpy as np
import pytest

from plexgraph.llm import embeddings, html_text, mixing, token_counts, toxicity

DATA = Path("/root/testdata/sf0.01")
driver_tables = pytest.mark.skipif(not DATA.exists(), reason="no driver tables")


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 16)).astype(np.float32)
    near = base[:12] + 0.12 * rng.normal(size=(12, 16)).astype(np.float32)
    rows = [(i, v.tolist(), 0, "c") for i, v in enumerate(np.r_[base, near, base[:5], (3 * base[5:7])])]
    odd = [(100, None, 0, "c"), (101, [0.0] * 16, 0, "c"), (102, [float("nan"), *[1.0] * 15], 0, "c"), (103, [float("inf"), *[1.0] * 15], 0, "c"), (104, [None, *[1.0] * 15], 0, "c"), (105, [1.0, 2.0], 0, "c"), (106, [], 0, "c")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int, list string").repartition(3)
    x = np.array([r[1] for r in rows], np.float64)
    c = x @ x.T / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1)) >= 0.9
    np.fill_diagonal(c, False)
    root = np.arange(len(x))
    for _ in root:
        for a, b in zip(*np.nonzero(c)):
            root[a] = root[b] = min(root[a], root[b])
    want = {i: (int(c[i].sum()), int(root[i]), root[i] == i) for i in range(len(x))} | {r[0]: (0, r[0], True) for r in odd}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df, lists=6).collect()}
    assert got == want
    assert c.any()
    assert embeddings.near_duplicates(df.where("false")).count() == 0
    assert embeddings.near_duplicates(df.where("vec_id >= 100 and vec_id < 105")).count() == 5


def test_probes_and_codes_lose_nothing():
    """Recall of the probes and of the code bounds is 1, whatever the fit."""
    rng = np.random.default_rng(1)
    x = embeddings._unit(rng.normal(size=(400, 24)) + 2 * rng.normal(size=(5, 24))[rng.integers(0, 5, 400)])
    q = embeddings.Quantizer(x[:60], 12)
    own = q.nearest(x)
    codes, error = q.encode(x, own)
    radius = (2 - 2 * 0.9) ** 0.5
    row, which = q.probes(x, radius / 2)
    probes = set(zip(row.tolist(), which.tolist()))
    pairs = np.argwhere(x @ x.T >= 0.9)
    assert len(pairs) > 400
    assert all((a, own[b]) in probes or (b, own[a]) in probes for a, b in pairs.tolist())
    for which in range(len(q.coarse)):
        there = np.flatnonzero(own == which)
        d = q.distances(x, which, codes[there])
        real = np.sqrt(((x[:, None] - x[there]) ** 2).sum(-1))
        assert (d <= real + error[there] + 1e-6).all()


@pytest.mark.parametrize("block", [2, 6, 64, 1 << 20])
def test_token_counts_over_any_blocks(spark, tmp_path, block):
    rng = random.Random(block)
    files, want = [], {}
    for f in range(3):
        lengths = [rng.choice([0, 0, 1, 2, 7, 50]) for _ in range(rng.randrange(0, 30))]
        ids = [x for n in lengths for x in [*[5] * n, token_counts.END]]
        if f == 2:
            ids += [9] * 11  # a last document that nothing ends
            lengths.append(11)
        path = tmp_path / f"{f}.tokens"
        np.array(ids, "<u2").tofile(path)
        files.append((str(path), 2 * len(ids)))
        want |= {(str(path), k): n for k, n in enumerate(lengths)}
    got = token_counts.count_tokens(spark.createDataFrame(files, "file string, bytes long"), block).collect()
    assert {(r.file, r.ordinal): r.n_tokens for r in got} == want
    assert len(got) == len(want)


def test_tokens_round_trip(spark, tmp_path):
    texts = [(1, "Hello  wörld, 日本\n\n"), (2, None), (3, ""), (4, "x" * 5000), (4, "again"), (None, "no id"), (5, "<|endoftext|>")]
    df = spark.createDataFrame([(*t, "b") for t in texts], "doc_id long, text string, bytes string").repartition(2)
    written = token_counts.write_tokens(df, str(tmp_path / uuid.uuid4().hex)).collect()
    encode = token_counts.encoder()
    back = []
    for r in written:
        if r.ordinal == -1:
            ids = np.fromfile(r.file, "<u2")
            assert r.bytes == ids.nbytes
            back += [encode.decode(part[:-1].tolist()) for part in np.split(ids, np.flatnonzero(ids == token_counts.END) + 1) if len(part)]
    assert sorted(back) == sorted(t or "" for _, t in texts)
    assert token_counts.write_tokens(df.where("false"), str(tmp_path / "none")).where("ordinal >= 0").count() == 0


def test_nearest_examples_are_exact():
    rng = np.random.default_rng(3)
    dense = rng.random((300, 50)) * (rng.random((300, 50)) < 0.1)
    dense[5] = dense[4]
    norm = np.linalg.norm(dense, axis=1, keepdims=True)
    dense = np.divide(dense, norm, out=np.zeros_like(dense), where=norm > 0)
    index = toxicity.BlockMaxIndex(list(range(300)), (rng.random(300) < 0.3).astype(int).tolist(), [(np.flatnonzero(v).astype(np.int32), v[v > 0]) for v in dense], 50)
    for v in dense[:60]:
        t = np.flatnonzero(v).astype(np.int32)
        if len(t):
            d, s = index.nearest(t, v[t], 15)
            full = dense @ v
            want = np.lexsort((np.arange(300), -np.round(full, 12)))[: len(d)]
            assert np.allclose(s, full[want], atol=1e-6)
            assert len(d) == min(15, int((full > 0).sum()))


@driver_tables
def test_held_out_toxicity(spark):
    got = {r.doc_id: r for r in toxicity.op9_toxicity(spark, str(DATA)).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    assert len(got) == 1000
    known = [(got[i].predicted, y) for i, y in labels.items() if got[i].held_out and y is not None]
    assert len(known) > 50
    assert sum(a == b for a, b in known) / len(known) > 0.9
    assert sum(a for a, y in known if y) >= 0.6 * sum(y for _, y in known)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert any(r.held_out for r in got.values())


def test_toxicity_of_odd_tables(spark):
    schema = "doc_id long, text string, score string, evidence string"
    rows = [(i, "you vile scum of words" if i % 3 == 0 else "kind plain words here", "s", "e") for i in range(120)] + [(500, None, "s", "e"), (501, "", "s", "e"), (3, "again", "s", "e")]
    df = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(100)] + [(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score(df, labels).collect()
    assert len(got) == len(rows)
    # "again" stands in a toxic example only, whose own word is evidence too
    assert all(r.predicted == (r.text or "").startswith(("you vile", "again")) for r in got)
    assert {r.score for r in toxicity.score(df, labels.where("false")).collect()} == {0.0}
    assert toxicity.score(df.where("false"), labels).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header class="site"><h2>Site</h2><p>Welcome to the site, there is a lot to read here.</p></header>
<nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav><div id="cookie-notice"><p>We use cookies so that this site works for all of you.</p></div>
<main><article><h1>A &mdash; title</h1><p>First  paragraph<br>of the &lt;story&gt; with <a href="/c">a link</a> in it.<p>Unclosed second one &amp; more, and &unknown; stays.</p>
<script>var x = "</p><p>no";</script><!-- <p>nor this</p> --><ul><li>item one</li><li>item two</li></ul><blockquote>Said somebody once, at some length.</blockquote></article>
<div class="comments"><p>I like this very much and write a long comment about it here.</p></div></main>
<aside class="sidebar"><p>Popular this week: a long list of other things to read.</p></aside><form><label>Mail</label><input><button>Send</button></form><footer>&copy; 2024 all rights reserved</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "A — title\nFirst paragraph of the <story> with a link in it.\nUnclosed second one & more, and &unknown; stays.\nitem one\nitem two\nSaid somebody once, at some length."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<div><br></div>") == ""
    assert html_text.main_text("<article><p>Cut off in a ta<b") == "Cut off in a ta"
    assert len(html_text.main_text("<article>" + "<p>one two three</p>" * 20000 + "</article>").split("\n")) == 20000


@pytest.mark.parametrize("seed", range(5))
def test_min_cut_is_minimal(seed):
    rng = random.Random(seed)
    n = 9
    gain = [rng.uniform(-2, 2) for _ in range(n)]
    ties = [(a, b, rng.uniform(0, 2)) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.4]

    def cost(label):
        return sum(max(0, -g) if x else max(0, g) for g, x in zip(gain, label)) + sum(w for a, b, w in ties if label[a] != label[b])

    best = min(cost(label) for label in itertools.product((False, True), repeat=n))
    assert cost(html_text.min_cut(gain, ties)) == pytest.approx(best)


def test_pages_keep_their_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (2, None, None, "t"), (None, "v", "", "t")], "page_id long, url string, html string, text string")
    got = html_text.extract(df).collect()
    assert sorted(r.n_chars for r in got)[:2] == [0, 0]
    assert len(got) == 4
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract(df.where("false")).count() == 0


def test_mixing_meets_its_targets(spark):
    rng = random.Random(2)
    kinds = {0: "ruby coral amber", 1: "ash dust slag"}
    rows = [(i, " ".join(rng.choice((kinds[i % 4 == 0] + " the of and").split()) for _ in range(rng.randrange(20, 80))), "t", 0.5) for i in range(300)] + [(900, None, "t", 0.5), (901, "", "t", 0.5), (5, "ruby", "t", 0.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, p string, rate double").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(200)] + [(None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    got = mixing.mix(df, labels, {"high": 0.5, "low": 0.5}, ["doc_id"]).collect()
    assert len(got) == len(rows)
    n, p, r = np.array([x.n_tokens for x in got]), np.array([x.p for x in got]), np.array([x.rate for x in got])
    assert (r >= 0).all()
    assert np.allclose((r * n) @ p / n.sum(), [0.5, 0.5], atol=1e-4)
    assert all(x.rate == 1 for x in got if x.n_tokens == 0)
    assert mixing.mix(df.where("false"), labels, {"high": 0.5, "low": 0.5}, ["doc_id"]).count() == 0
    flat = mixing.mix(df, labels.where("false"), {"high": 0.5, "low": 0.5}, ["doc_id"]).collect()
    assert {tuple(x.p) for x in flat} == {(0.5, 0.5)}


def test_rates_follow_the_projected_steps():
    """The fold over residuals is the iteration itself, and it lowers the squares with targets out of reach."""
    rng = np.random.default_rng(0)
    n, p = rng.integers(1, 50, 200).astype(float), rng.dirichlet([0.3, 0.3, 0.3], 200)
    goal, step = np.array([0.9, 0.3, 0.0]), 1 / np.linalg.eigvalsh((p * n[:, None]).T @ p / n.sum()).max()
    history, r, sizes = [], np.ones(200), []
    for _ in range(60):
        residual = (r * n) @ p / n.sum() - goal
        sizes.append(float(residual @ residual))
        history.append((residual, 0.0))
        r = np.maximum(0, r - step * (p @ residual))
        assert np.allclose(mixing._rates(p, history, step, 0.0)[0], r)
    assert (r >= 0).all()
    assert (r == 0).any()
    assert sizes == sorted(sizes, reverse=True)


@driver_tables
def test_pipeline(spark):
    import corpus_pipeline

    sf = str(DATA)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "substrings", "decontamination", "mixing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True)
    assert counts[1] < counts[0]
    assert counts[2] < counts[1]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.count() == counts[-1]
    assert set(columns) < set(last.columns)
