"""Findings analytics on PySpark: sources, row functions, relational and graph operators, queries."""
