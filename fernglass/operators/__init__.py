"""Relational, window, graph, retrieval and sequential operators on DataFrames."""
