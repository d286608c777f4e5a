"""Keyed deduplication, voting, histograms and top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order, whole; order must end in something unique.

    Each task keeps one row per key before the shuffle (a window's group limit), so a hot key does not travel.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def best_keeps_place(df: DataFrame, keys: Sequence[str], rank: Column, ordinal: str = "ordinal") -> DataFrame:
    """The row of highest rank of each key (the earlier of equals), with place: where the key first stood."""
    top = df.withColumn("_rank", rank).groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(F.col("_rank"), -F.col(ordinal))).alias("_r"), F.min(ordinal).alias("place"))
    return top.select("_r.*", "place")


def vote(df: DataFrame, k: int, keys: Sequence[Column], run: str = "run_idx", ordinal: str = "ordinal", score: str = "score") -> DataFrame:
    """Rows that at least k of the runs bring: the first of each key, with votes, total and the score times votes / total.

    A score of 0 counts as 0.5. With k of at most 1, or a single run, the first run comes out as it is.
    """
    total = df.select(run).where(F.col(run).isNotNull()).distinct().count()
    if k <= 1 or total <= 1:
        first = df.agg(F.min(run).alias("_f")).first()["_f"]
        return df.where(F.col(run) == first).select("*", F.lit(1).cast("long").alias("votes"), F.lit(total).cast("long").alias("total"), F.col(score).alias("voted_score"))
    named = {f"_k{i}": c for i, c in enumerate(keys)}
    voted = df.withColumns(named).groupBy(*named).agg(F.countDistinct(run).alias("votes"), F.min_by(F.struct(*df.columns), F.struct(run, ordinal)).alias("_r"))
    base = F.when(F.col(f"_r.{score}") == 0, 0.5).otherwise(F.col(f"_r.{score}"))
    return voted.where(F.col("votes") >= k).select("_r.*", "votes", F.lit(total).cast("long").alias("total"), (base * F.col("votes") / total).alias("voted_score"))


def histograms(df: DataFrame, *columns: str) -> DataFrame:
    """(column, value, n) for several columns in one pass over the data."""
    sets = [F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns]
    return df.select(F.explode(F.array(*sets)).alias("x")).groupBy("x.column", "x.value").agg(F.count("*").alias("n"))


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each group, with their rank."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
