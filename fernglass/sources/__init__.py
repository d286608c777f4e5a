"""Readers of tables, logs, labels and source trees."""
