"""Spark-first code-intelligence analytics: DataFrame operators over elements, typed edges, history, routes and chunks."""
