"""Text operators against brute force on small, awkward tables."""

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from plexgraph.llm import common, components, decontaminate, licenses, lyndon, repeats, simhash, suffix_tree

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, f string, p string, kept string, n_removed string, row string, x string"


def docs(spark, texts):
    """(doc_id, text) rows with extra columns of clashing names."""
    rows = [(i, t, "en", None, len(t or ""), "s", "f", "p", "k", "n", "r", "x") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def jumble(seed, n=40, vocabulary=30, longest=60):
    """Texts that share passages, with copies, nulls, blanks, odd white space and non-ASCII words."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["é", "Ünï", "日本", "A.b"]
    passages = [[rng.choice(words) for _ in range(rng.randrange(10, 40))] for _ in range(4)]
    out = []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randrange(0, longest))]
        if rng.random() < 0.6:
            at = rng.randrange(len(w) + 1)
            w[at:at] = rng.choice(passages)
        out.append((3 * i + 1, rng.choice([" ", " ", "\n", " \t "]).join(w)))
    out += [(500, None), (501, ""), (502, " \n "), (503, out[0][1]), (504, out[0][1]), (0, out[5][1]), (505, "the " * 400), (506, "the " * 300)]
    return out


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words_of(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def test_spans_and_hashes_do_not_depend_on_place():
    column = pa.array(["ab cd", None, "", "cd", "x\tab", "é z"])
    buf, off = common.text_bytes(column)
    s, e, first = common.spans(buf, off, common.SOLID)
    assert [buf[a:b].tobytes().decode() for a, b in zip(s, e)] == ["ab", "cd", "cd", "x", "ab", "é", "z"]
    assert np.diff(first).tolist() == [2, 0, 0, 1, 2, 2]
    h = common.span_hashes(buf, s, e)
    assert h[0] == h[4]
    assert h[1] == h[2]
    assert len(set(h.tolist())) == 5
    again = list(common.text_chunks(column.slice(3), 4))
    assert [(i, j) for i, j, _, _ in again] == [(0, 1), (1, 2), (2, 3)]


@pytest.mark.parametrize("seed", range(2))
def test_repeated_words(spark, seed):
    texts = jumble(seed)
    low = {}
    for i, t in sorted(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        for k in range(len(w) - 12):
            low.setdefault(tuple(w[k : k + 13]), i)
    want = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = {k + j for k in range(len(w) - 12) if low[tuple(w[k : k + 13])] < i for j in range(13)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    got = suffix_tree.deduplicate(docs(spark, texts), ["doc_id"]).collect()
    assert {r.doc_id: (r.n_symbols, r.n_removed, hashlib.sha256(r.kept).hexdigest()) for r in got} == want
    assert len(got) == len(texts)


@pytest.mark.parametrize("hot", [repeats.HOT, 0])
def test_repeated_bytes(spark, hot, monkeypatch):
    """Also with every anchor hot, and with groups large enough to be split by windows."""
    monkeypatch.setattr(repeats, "HOT", hot)
    texts = jumble(7, n=30)
    low = {}
    for i, t in sorted(texts):
        b = (t or "").encode()
        for k in range(len(b) - 49):
            low.setdefault(b[k : k + 50], i)
    want = {}
    for i, t in texts:
        b = (t or "").encode()
        gone = {k + j for k in range(len(b) - 49) if low[b[k : k + 50]] < i for j in range(50)}
        spans = sum(k - 1 not in gone for k in gone)
        want[i] = (len(b), len(gone), spans, bytes(x for k, x in enumerate(b) if k not in gone))
    got = {r.doc_id: (r.n_symbols, r.n_removed, r.n_spans, bytes(r.kept)) for r in lyndon.deduplicate(docs(spark, texts), ["doc_id"]).collect()}
    assert got == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=30), min_size=1, max_size=5))
def test_suffix_arrays_match_sorting(strings):
    strings = [[*s, 0] for s in strings]
    bounds = np.r_[0, np.cumsum([len(s) for s in strings])]
    got = lyndon.suffix_arrays(np.concatenate(strings).astype(np.int64), bounds)
    for q, s in enumerate(strings):
        assert (got[bounds[q] : bounds[q + 1]] - bounds[q]).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize("members", [1, 2, 9, 12, 30])
def test_groups_of_any_size_are_solved(members):
    rng = random.Random(3)
    cores = [bytes(rng.choice(b"ab") for _ in range(120)) for _ in range(60)]  # a window stands in one group only
    texts = [cores[i // members][a : a + rng.randrange(50, 84)] for i, a in enumerate(rng.randrange(0, 30) for _ in range(60))]
    windows = np.array([len(t) - 49 for t in texts])
    low = np.arange(60) * 7 % 61
    runs = repeats.Runs(np.arange(60, dtype=np.uint64) // np.uint64(members), windows, np.zeros(60, np.int64), np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])], low)
    least = {}
    for i, t in enumerate(texts):
        for k in range(windows[i]):
            key = (i // members, t[k : k + 50])
            least[key] = min(least.get(key, 99), low[i])
    want = [least[i // members, t[k : k + 50]] for i, t in enumerate(texts) for k in range(windows[i])]
    assert lyndon.solve(runs).tolist() == want


@pytest.mark.parametrize("seed", range(2))
def test_decontamination(spark, seed):
    texts = jumble(seed, vocabulary=40)
    rng = random.Random(seed)
    long = [w for _, t in texts if len(w := words_of(t)) > 30]
    items = [(i, " ".join(rng.choice(long)[5 : 5 + n])) for i, n in enumerate((20, 9, 8, 12, 25))] + [(10, "Ünï"), (11, "w1, W2"), (12, None), (13, " . "), (14, "w3"), (10, "Ünï")]
    wins = {}
    for i, t in items:
        w = words_of(t)
        for k in range(max(1, len(w) - 7) if w else 0):
            wins.setdefault(tuple(w[k : k + 8]), set()).add(str(i))
    want = {}
    for i, t in texts:
        w, hit, found = words_of(t), set(), set()
        for win, ids in wins.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found |= ids
        want[i] = (len(w), len(hit), sorted(found))
    for bench in (items, [x for x in items if len(words_of(x[1])) >= 8]):
        keep = {str(i) for i, _ in bench}
        got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.contaminated(docs(spark, texts), spark.createDataFrame(bench, "item_id long, text string")).collect()}
        assert set(got) == set(want)
        if bench is items:
            assert got == want
        else:
            assert {i: v[2] for i, v in got.items()} == {i: [x for x in v[2] if x in keep and int(x) < 10] for i, v in want.items()}


def test_winnowing_keeps_a_print_of_every_window(spark):
    from pyspark.sql import functions as F

    a, b = "q1 q2 one two three four five six seven eight q3", "one two three four five six seven eight"
    df = spark.createDataFrame([(a,), (b,)], "text string").select(decontaminate.fingerprints(decontaminate.coarse_words(F.col("text"))).alias("f"))
    x, y = (set(r.f) for r in df.collect())
    assert y
    assert y <= x


def test_licences(spark):
    texts = [
        (1, "Under the MIT License. x under THE mit-license"), (2, "Licensed under the Apache License, Version 2.0 and more"), (3, "CC BY-NC 4.0 cc by nc"),
        (4, None), (5, ""), (6, "omit the licenses of summit"), (7, "é " * 2000 + "under the mit license " + "x " * 5000), (8, "GNU General Public License v3"), (8, "plain"),
    ]
    got = licenses.scan(docs(spark, texts)).collect()
    assert len(got) == len(texts)
    base = {r.doc_id: (r.n_base, r.first_word, r.last_word, r.base_labels) for r in got if r.doc_id != 8}
    phrases = [(p.split(), label) for p, label in licenses.BASE]
    for i, t in texts:
        if i == 8:
            continue
        w = words_of(t)
        at = [(k, label) for p, label in phrases for k in range(len(w)) if w[k : k + len(p)] == p]
        assert base[i] == (len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at})))
    labels = {r.doc_id: r.labels.split(",") for r in got if r.labels}
    assert "apache-2.0" in labels[2]
    assert "apache" not in labels[2]  # contained in the longer detection
    assert "gpl-3.0" in labels[8]
    assert "cc-by-nc-4.0" in labels[3]
    assert 6 not in labels
    assert all(0 <= r.score <= 1 and (r.score > 0) == bool(r.labels) for r in got)
    assert len(licenses.rules()) >= 200


def fingerprint(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", lower(t).encode())
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    rng = random.Random(5)
    long = [f"v{rng.randrange(400)}" for _ in range(300)]
    near = [(600 + k, " ".join("zz" if i == 40 * k else w for i, w in enumerate(long))) for k in range(6)]
    texts = jumble(9) + near + [(700, "one two"), (701, "ONE  two")]
    prints = {i: fingerprint(t) for i, t in texts}
    ids = sorted(prints)
    root = {i: i for i in ids}
    pairs = [(a, b) for a, b in itertools.combinations(ids, 2) if (prints[a] ^ prints[b]).bit_count() <= 3]
    for _ in ids:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = simhash.near_duplicates(docs(spark, texts)).collect()
    assert {r.doc_id: r.f % 2**64 for r in got} == prints
    assert {r.doc_id: r.component_id for r in got} == root
    assert len({root[i] for i, _ in near}) < 6
    split = simhash.link(spark.createDataFrame([(v - 2**64 if v >> 63 else v, i) for v, i in {prints[i]: i for i in reversed(ids)}.items()], "f long, rep long"), split=1)
    hot = {r.vertex: r.component for r in components.components(split).collect()}
    reps = {}
    for i in ids:
        reps.setdefault(prints[i], i)
    assert all(hot.get(i, i) == root[i] for i in reps.values())


def test_gray_index_finds_all_pairs():
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 2**63, 40, dtype=np.uint64)
    prints = np.unique(np.concatenate([centre ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(12)]))
    bins = rng.integers(0, 3, len(prints))
    index = simhash.GrayIndex(bins, prints)
    got = {tuple(sorted((int(index.order[a]), int(index.order[b])))) for x, y in index.pairs(room=100) for a, b in zip(x, y)}
    want = {(a, b) for a, b in itertools.combinations(range(len(prints)), 2) if bins[a] == bins[b] and int(prints[a] ^ prints[b]).bit_count() <= 3}
    assert got == want


def test_components_over_the_cluster(spark):
    rng = random.Random(8)
    links = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(200, k) for k in range(201, 260)] + [(k, k + 1) for k in range(300, 340)]
    a, b = np.array(links).T
    want = components.local_components(400, a, b)
    got = {r.vertex: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {int(v): int(want[v]) for x, y in links for v in (x, y) if x != y}


@pytest.mark.parametrize("module", [suffix_tree, simhash, decontaminate])
def test_empty_tables(spark, module):
    none = docs(spark, [])
    if module is suffix_tree:
        assert suffix_tree.deduplicate(none, ["doc_id"]).count() == 0
        assert lyndon.deduplicate(none, ["doc_id"]).count() == 0
    elif module is simhash:
        assert simhash.near_duplicates(none).count() == 0
    else:
        bench = spark.createDataFrame([], "item_id long, text string")
        assert decontaminate.contaminated(none, bench).count() == 0
        assert {(r.n_words, r.n_hit) for r in decontaminate.contaminated(docs(spark, [(1, "a b")]), bench).collect()} == {(2, 0)}
        assert licenses.scan(none).count() == 0


def test_null_ids_do_not_crash(spark):
    texts = [(None, "a b c " * 10), (1, "a b c " * 10), (None, None)]
    assert {(r.doc_id, r.n_removed > 0) for r in suffix_tree.deduplicate(docs(spark, texts), ["doc_id"]).collect()} == {(None, True), (1, False), (None, False)}
    assert simhash.near_duplicates(docs(spark, texts)).count() == 3
    assert licenses.scan(docs(spark, texts)).count() == 3
