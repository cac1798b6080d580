"""Repeats in groups of very many different runs, and under prefixes of every length, against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from plexgraph.llm import lyndon, repeats, suffix_tree


def passes(module, texts, parts=3):
    """The three passes over a few parts, without a cluster."""
    ids = np.arange(len(texts))
    docs = pa.table({"doc_id": ids, "text": texts})
    held = {p: docs.filter(pa.array(ids % parts == p)).append_column("p", pa.array(np.full(int((ids % parts == p).sum()), p))) for p in range(parts)}

    def sent(tables):
        rows = pa.concat_tables(tables)
        to = rows.column("to").to_numpy()
        return {int(p): rows.filter(pa.array(to == p)) for p in np.unique(to)}

    named = sent([repeats._name_anchors(module.UNIT, parts)(t) for t in held.values()])
    shared = sent([repeats._shared_anchors(t) for t in named.values()])
    none = pa.table({k: pa.array([], t) for k, t in (("to", pa.int64()), ("sender", pa.int64()), ("n", pa.int64()), ("data", pa.binary()))})
    runs = sent([repeats._send_runs(module.UNIT, parts)(t, shared.get(p, none)) for p, t in held.items()])
    told = sent([repeats._answer_runs(module.solve)(t) for t in runs.values()])
    out = pa.concat_tables([repeats._finish(module.UNIT, ["doc_id"])(t, told.get(p, none)) for p, t in held.items()])
    return dict(zip(out.column("doc_id").to_pylist(), out.column("kept").to_pylist()))


def brute(module, texts):
    words, length = module.UNIT.words, module.UNIT.length
    symbols = [t.encode().split() if words else t.encode() for t in texts]
    seen, kept = {}, {}
    for i, s in enumerate(symbols):
        for k in range(len(s) - length + 1):
            seen.setdefault(tuple(s[k : k + length]) if words else s[k : k + length], i)
    for i, s in enumerate(symbols):
        gone = np.zeros(len(s), bool)
        for k in range(len(s) - length + 1):
            if seen[tuple(s[k : k + length]) if words else s[k : k + length]] < i:
                gone[k : k + length] = True
        left = [x for x, g in zip(s, gone) if not g]
        kept[i] = b" ".join(left) if words else bytes(left)
    return kept


def slotted(rng, n):
    """Texts that share a template whose slots differ, so that an anchor has very many different runs that partly agree."""
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randrange(2, 6)))
    names = [word() for _ in range(max(3, n // 8))]
    out = []
    for _ in range(n):
        middle = "permission is hereby granted free of charge to any person obtaining a copy of this software"
        out.append(f"{rng.choice(names)} {rng.choice(names)} {word()} {rng.choice(names)} the {middle} and {rng.choice(names)} with {rng.choice(names)} as said {word()} " + " ".join(word() for _ in range(rng.randrange(0, 25))))
    return out


@pytest.mark.parametrize("module", [lyndon, suffix_tree])
@pytest.mark.parametrize("n", [13, 500])
def test_groups_of_many_runs(module, n):
    texts = slotted(random.Random(n), n)
    assert passes(module, texts) == brute(module, texts)


@pytest.mark.parametrize("module", [lyndon, suffix_tree])
@pytest.mark.parametrize("hot", [1, 5, 40])
def test_prefixes_of_every_length(monkeypatch, module, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "FULLER", 2)
    texts = slotted(random.Random(hot), 150)
    level = repeats.levels(np.array([0, 1, hot, hot + 1, 3 * hot, 7 * hot, 10**6]))
    assert level[:4].tolist() == [0, 0, 0, 1]
    assert level[-1] == repeats.LEVELS
    assert [repeats.prefix_length(module.UNIT, k) for k in (0, repeats.LEVELS)] == [module.UNIT.gram, module.UNIT.length]
    assert passes(module, texts) == brute(module, texts)


def test_texts_of_one_hash_are_told_apart():
    buf = np.frombuffer(b"abcabdabcabc", np.uint8)
    first, cls = repeats.same_texts((np.zeros(4, np.int64),), buf, np.array([0, 3, 6, 9]), np.full(4, 3))
    assert cls[0] == cls[2] == cls[3] != cls[1]
    assert first[cls[0]] in (0, 2, 3)


@pytest.mark.parametrize("module", [lyndon, suffix_tree])
def test_buckets_are_solved_in_several_turns(monkeypatch, module):
    """Whole groups at a time, a few bytes of text each: the same windows are found."""
    solved = []
    monkeypatch.setattr(repeats, "SOLVED", 300)
    monkeypatch.setattr(repeats, "STEP", 64)
    solve = module.solve
    monkeypatch.setattr(module, "solve", lambda runs: solved.append(len(runs.buf)) or solve(runs))
    rng = random.Random(11)
    pool = [" ".join(f"w{rng.randrange(500)}" for _ in range(30)) for _ in range(12)]
    texts = [" ".join(rng.choice(pool) if rng.random() < 0.5 else f"own{i}x{k} " * 6 for k in range(4)) for i in range(60)]
    assert passes(module, texts) == brute(module, texts)
    assert len(solved) > 30


def test_parts_send_to_few_buckets(spark, monkeypatch):
    """Rows between parts and buckets grow as their product: of 400 parts each sends to 50 buckets, not to 400."""
    found = []
    name = repeats._name_anchors
    monkeypatch.setattr(repeats, "partitions_for", lambda *_: 100)
    monkeypatch.setattr(repeats, "_name_anchors", lambda unit, buckets: found.append(buckets) or name(unit, buckets))
    lyndon.deduplicate(spark.createDataFrame([(1, "a")], "doc_id long, text string"), ["doc_id"])
    assert found == [50]
