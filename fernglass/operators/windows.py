"""Interval merging, line windows, line ranges and budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_intervals(df: DataFrame, keys: Sequence[str], start: str, end: str, aggregates: Sequence[Column], ordinal: str = "ordinal") -> DataFrame:
    """Overlapping intervals (both ends included) of a key as one, with aggregates over their rows."""
    w = Window.partitionBy(*keys).orderBy(start, end, ordinal)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(reach >= F.col(start), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("island", island).groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end), *aggregates)


def lines(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """(keys..., line_no, line): the text's lines from 1; NULL texts give none."""
    return df.where(F.col(text).isNotNull()).select(*keys, F.posexplode(F.split(F.col(text), "\n")).alias("_i", "line")).select(*keys, (F.col("_i") + 1).alias("line_no"), "line")


def line_windows(df: DataFrame, keys: Sequence[str], text: str, size: int) -> DataFrame:
    """(keys..., window_no, first_line, last_line, body): the text in runs of size lines, blank runs left out.

    Texts are cut in place, without exploding and regrouping their lines.
    """
    parts = F.split(F.col(text), "\n")
    starts = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / size).cast("int"))
    cut = df.where(F.col(text).isNotNull()).withColumn("_lines", parts).select(*keys, "_lines", F.explode(starts).alias("window_no"))
    out = cut.select(*keys, "window_no", (F.col("window_no") * size + 1).alias("first_line"), F.least((F.col("window_no") + 1) * size, F.size("_lines")).alias("last_line"), F.array_join(F.slice("_lines", F.col("window_no") * size + 1, size), "\n").alias("body"))
    return out.where(F.regexp_replace("body", r"\s", "") != "")


def within_budget(df: DataFrame, keys: Sequence[str], order: Sequence[Column], size: Column, budget: int) -> DataFrame:
    """The leading rows of each key whose sizes add up to at most budget, with used: the sum so far."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= budget)


def symbol_chunks(df: DataFrame, key: str, text: str, symbols: str) -> DataFrame:
    """(key, start_line, end_line, symbol): the lines of each symbol, cut to the text's end, blank ones left out; texts are cut in place."""
    f = df.where(F.col(text).isNotNull()).withColumn("_lines", F.split(F.col(text), "\n"))
    rows = F.transform(symbols, lambda s: F.struct(s["start_line"].alias("start_line"), F.least(s["end_line"], F.size("_lines")).alias("end_line"), s["name"].alias("symbol")))
    inside = F.filter(rows, lambda x: (x["start_line"] >= 1) & (x["start_line"] <= F.size("_lines")) & (x["end_line"] >= x["start_line"]))
    filled = F.filter(inside, lambda x: F.regexp_replace(F.array_join(F.slice("_lines", x["start_line"], x["end_line"] - x["start_line"] + 1), ""), r"\s", "") != "")
    return f.select(key, F.explode(filled).alias("c")).select(key, "c.*")


def around_matches(df: DataFrame, key: str, text: str, pattern: str, before: int, after: int) -> DataFrame:
    """(key, line_no, lines): each line that the pattern matches with the lines around it; texts without one are not split."""
    f = df.where(F.col(text).rlike(f"(?m){pattern}")).withColumn("_l", F.split(F.col(text), "\n"))
    hits = F.filter(F.sequence(F.lit(1), F.size("_l")), lambda i: F.element_at("_l", i).rlike(pattern))
    cut = F.transform(hits, lambda i: F.struct(i.cast("long").alias("line_no"), F.array_join(F.slice("_l", F.greatest(i - before, F.lit(1)), i + after - F.greatest(i - before, F.lit(1)) + 1), "\n").alias("lines")))
    return f.select(key, F.explode(cut).alias("c")).select(key, "c.*")
