"""How alike names, paths and signatures are."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def jaro(a: str, b: str) -> float:
    """Jaro similarity: equal characters at most half the longer length less one apart, less half of those out of order."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    window = max(len(a), len(b)) // 2 - 1
    taken, left = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - window), min(i + window + 1, len(b))):
            if not taken[j] and b[j] == x:
                taken[j] = True
                left.append(x)
                break
    m = len(left)
    if not m:
        return 0.0
    swapped = sum(x != y for x, y in zip(left, (y for y, t in zip(b, taken) if t)))
    return (m / len(a) + m / len(b) + (m - swapped / 2) / m) / 3


def name_similarity(a: str | None, b: str | None) -> float:
    """Jaro with a tenth of the rest for each of up to four equal first characters."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    same = 0
    while same < min(len(a), len(b), 4) and a[same] == b[same]:
        same += 1
    j = jaro(a, b)
    return min(1.0, j + same * 0.1 * (1 - j))


def path_similarity(a: str | None, b: str | None) -> float:
    """File name 0.40, shared folders 0.35, extension 0.15, depth 0.10."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    *dirs_a, file_a = a.replace("\\", "/").split("/")
    *dirs_b, file_b = b.replace("\\", "/").split("/")
    (stem_a, dot_a, ext_a), (stem_b, dot_b, ext_b) = file_a.rpartition("."), file_b.rpartition(".")
    stem_a, ext_a = (stem_a, ext_a) if dot_a else (file_a, "")
    stem_b, ext_b = (stem_b, ext_b) if dot_b else (file_b, "")
    every = set(dirs_a) | set(dirs_b)
    shared = len(set(dirs_a) & set(dirs_b)) / len(every) if every else 0.0
    ext = 1.0 if ext_a == ext_b else 0.0 if ext_a and ext_b else 0.5
    return name_similarity(stem_a, stem_b) * 0.40 + shared * 0.35 + ext * 0.15 + 0.10 / (1 + abs(len(dirs_a) - len(dirs_b)) * 0.1)


def signature_similarity(a: str | None, b: str | None) -> float:
    """Of two JSON signatures: async, exported, number of parameters and type, a quarter each; 0.5 where nothing is known."""
    if not a or not b:
        return 0.5
    if a == b:
        return 1.0
    try:
        x, y = json.loads(a), json.loads(b)
        n, m = (len(v.get("parameters") or []) for v in (x, y))
    except (ValueError, AttributeError):
        return name_similarity(a, b)
    score, known = 0.0, 0
    for k in ("isAsync", "exported"):
        if k in x or k in y:
            score, known = score + 0.25 * (x.get(k) == y.get(k)), known + 1
    if n or m:
        score, known = score + max(0.0, 0.25 - abs(n - m) * 0.05), known + 1
    if x.get("type") and y.get("type"):
        score, known = score + 0.25 * (x["type"] == y["type"]), known + 1
    return score if known else 0.5


def combined(name: float, path: float, signature: float) -> tuple[float, float]:
    """The weighted similarity, and how far its three parts agree on it."""
    s = name * 0.5 + path * 0.3 + signature * 0.2
    return s, 1 - min(1.0, (abs(name - s) + abs(path - s) + abs(signature - s)) / 3)


def _each(f):
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[tuple, float] = {}  # equal pairs are worked out once a batch
        out = []
        for pair in zip(a, b):
            if pair not in known:
                known[pair] = f(*pair)
            out.append(known[pair])
        return pd.Series(out, dtype="float64")

    return run


def jaro_winkler(a: Column, b: Column) -> Column:
    """:func:`name_similarity` of two columns, in Arrow batches."""
    return _each(name_similarity)(a, b)


def path_likeness(a: Column, b: Column) -> Column:
    """:func:`path_similarity` of two columns, in Arrow batches."""
    return _each(path_similarity)(a, b)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct members of two arrays; 0 where both are empty."""
    every = F.size(F.array_union(a, b))
    return F.when(every == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / every)


def l1(a: Column, b: Column) -> Column:
    """Sum of differences of two count maps; a missing key counts zero."""
    at = lambda m, k: F.coalesce(F.try_element_at(m, k), F.lit(0))
    return F.aggregate(F.array_union(F.map_keys(a), F.map_keys(b)), F.lit(0).cast("long"), lambda s, k: s + F.abs(at(a, k) - at(b, k)))
