"""Licence detections against the rules applied one by one, and texts of very many matches."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F
from test_text_operators import docs

from plexgraph.llm import licenses

RULES = [(label, p, k, re.compile(r)) for label, p, k, r in licenses.rules()]


def brute(text):
    """Labels and best priority by the definition: every rule's matches, less those inside a stronger or longer interval."""
    low = (text or "").lower()
    found = [(m.start(), m.end(), p, label) for label, p, k, r in RULES if k in low for m in r.finditer(low)]
    kept = []
    for s, e, p, label in found:
        inside = any((s2, e2) != (s, e) and s2 <= s and e2 >= e and p2 >= p or (s2, e2) == (s, e) and p2 > p for s2, e2, p2, _ in found)
        if not inside:
            kept.append((label, p))
    return {x for x, _ in kept}, max((p for _, p in kept), default=0)


def texts(seed):
    rng = random.Random(seed)
    names = ["MIT License", "Apache License, Version 2.0", "BSD 3-Clause", "GNU General Public License v3", "cc by-nc-sa 4.0", "Mozilla Public License, version 2", "public domain", "copyright (c) 2020", "all rights reserved", "Creative Commons", "SPDX-License-Identifier: MIT", "isc license", "lgpl-2.1", "wtfpl", "Boost Software License"]
    lead = ["", "licensed under the ", "released under the terms of the ", "distributed under ", "see the ", "this license and "]
    return [(i, " ".join(rng.choice(["words", "are", "here;", "and."]) + " " + rng.choice(lead) + rng.choice(names) for _ in range(rng.randrange(1, 8)))) for i in range(60)]


@pytest.mark.parametrize("seed", [1, 2])
def test_labels_and_score(spark, seed):
    rows = texts(seed)
    base = dict(licenses.BASE)
    for r in licenses.scan(docs(spark, rows)).collect():
        labels, best = brute(dict(rows)[r.doc_id])
        own = set(filter(None, r.base_labels.split(",")))
        assert own <= set(base.values())
        assert set(filter(None, r.labels.split(","))) == labels | own
        assert r.score == max(0.95 if r.n_base else 0.0, licenses.SCORES.get(best, 0.0))


def test_prefix_sums(spark):
    rows = [list(range(n)) for n in (0, 1, 255, 256, 257, 1000)]
    got = spark.createDataFrame([(r,) for r in rows], "x array<int>").select("x", licenses.prefix_sums(F.col("x")).alias("y")).collect()
    for r in got:
        total, want = 0, []
        for v in r.x:
            total += v
            want.append(total)
        assert r.y == want


def test_very_many_matches_take_seconds(spark):
    text = "copyright " * 100_000
    df = docs(spark, [(1, text), (2, "as is " * 50_000)])
    licenses.scan(df.limit(1)).collect()
    began = time.monotonic()
    got = {r.doc_id: r.labels for r in licenses.scan(df).collect()}
    assert got[1] == "copyright"
    assert time.monotonic() - began < 60


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_words_of_every_text_are_counted(spark):
    rows = [(1, "no such phrase here"), (2, "under the mit license"), (3, None), (4, ""), (5, " ,; "), (6, "é ß -x- A_b9\tz."), (7, "a " * 50_000), (8, "K-1 one"), (9, " under"), (10, "cc\x00by nc ")]
    got = {r.doc_id: r.n_words for r in licenses.scan(docs(spark, rows)).collect()}
    assert got == {i: len(WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))) for i, t in rows}


FORMS = [
    "Expat License", "released under the X11 license", "GNU Library General Public License version 2", "Open RAIL licence", "everyone is permitted to copy and distribute verbatim or modified copies",
    "Attribution Non-Commercial", "Neither the name of the owner nor the names of its contributors may be used", "MIT License", "attribution-noncommercial",
]


def test_keywords_and_the_gate_leave_no_rule_out(spark):
    """Every rule's matches count, whatever other words the text holds."""
    got = {r.doc_id: r.labels for r in licenses.scan(docs(spark, list(enumerate(FORMS)))).collect()}
    for i, t in enumerate(FORMS):
        found = [(m.start(), m.end(), p, label) for label, p, _, r in RULES for m in r.finditer(t.lower())]
        kept = {label for s, e, p, label in found if not any((s2, e2) != (s, e) and s2 <= s and e2 >= e and p2 >= p or (s2, e2) == (s, e) and p2 > p for s2, e2, p2, _ in found)}
        assert kept
        assert set(got[i].split(",")) == kept


def test_only_a_to_z_are_lower_cased(spark):
    got = licenses.scan(docs(spark, [(1, "the blue oaK model license"), (2, "the Blue Oak model license")])).collect()
    assert {r.doc_id: "blueoak-1.0.0" in r.labels for r in got} == {1: False, 2: True}
