"""Elements that have moved or look alike: each of a bounded set of vanished elements against all others, in blocks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import combined, name_similarity, path_similarity, signature_similarity

#: Vanished elements that a pass over the candidates takes along.
BLOCK = 500
_SCHEMA = "source string, id string, similarity double, confidence double, name_similarity double, path_similarity double, signature_similarity double"


def similar_elements(vanished: DataFrame, elements: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Pairs (source, id) of different elements (id, name, file, signature) whose similarity reaches the threshold.

    The vanished ones are a stated query set: they go out in blocks of ``BLOCK``, each with one pass over the candidates, which
    are never shuffled. Within a block a candidate whose best case can't reach the threshold is left out before its
    characters are compared: a name ratio bounds Jaro from above.
    """
    rows = [(r.id, r.name, r.file, r.signature) for r in vanished.select("id", "name", "file", "signature").distinct().toLocalIterator()]
    out = None
    for at in range(0, max(1, len(rows)), BLOCK):
        part = rows[at : at + BLOCK]

        def run(batches, part=part):
            for batch in batches:
                found = []
                for i, name, file, sig in zip(*(batch.column(c).to_pylist() for c in ("id", "name", "file", "signature"))):
                    for s_id, s_name, s_file, s_sig in part:
                        if s_id == i:
                            continue
                        short, long = sorted((len(name or ""), len(s_name or "")))
                        # with m <= short matches Jaro is at most (1 + short / long + 1) / 3, and the bonus takes 0.4 of the rest
                        best = (2 + short / long) / 3 if long else 1.0
                        if (best + 0.4 * (1 - best)) * 0.5 + 0.5 < threshold:
                            continue
                        n = name_similarity(s_name, name)
                        if n * 0.5 + 0.5 < threshold:
                            continue
                        p = path_similarity(s_file, file) if s_file and file else 0.5
                        g = signature_similarity(s_sig, sig)
                        similarity, confidence = combined(n, p, g)
                        if similarity >= threshold:
                            found.append((s_id, i, similarity, confidence, n, p, g))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], ["source", "id", "similarity", "confidence", "name_similarity", "path_similarity", "signature_similarity"])

        one = elements.select("id", "name", "file", "signature").mapInArrow(run, _SCHEMA)
        out = one if out is None else out.unionByName(one)
    return out


def moved(vanished: DataFrame, elements: DataFrame, threshold: float = 0.7, limit: int = 10) -> DataFrame:
    """The best matches of every vanished element, at most ``limit``, ties by id; one without any has no row."""
    w = Window.partitionBy("source").orderBy(F.desc("similarity"), "id")
    return similar_elements(vanished, elements, threshold).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
