"""The queries of the training-data operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, embeddings, html_text, licenses, lyndon, mixing, simhash, suffix_tree, token_counts, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": mixing.op1_mixing,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_licenses": licenses.op3_licenses,
    "op4_substrings": suffix_tree.op4_substrings,
    "op5_suffix_array": lyndon.op5_suffix_array,
    "op6_simhash": simhash.op6_simhash,
    "op7_embeddings": embeddings.op7_embeddings,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_html_text": html_text.op10_html_text,
}
#: Classifiers, XXH64, tokenizers and HTML have no SQL; tests/llm holds those queries against brute force.
ORACLES: dict[str, str] = {
    "op2_decontaminate": decontaminate.SQL,
    "op4_substrings": suffix_tree.SQL,
    "op5_suffix_array": lyndon.SQL,
    "op7_embeddings": embeddings.SQL,
}
