"""Evaluation against labels, and isotonic calibration of scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(predictions: DataFrame, labels: DataFrame, keys: list[str], by: str) -> DataFrame:
    """(by, tp, fp, fn, precision, recall, f1) for each value of by and, with NULL, over all; both sides count as sets."""
    p = predictions.select(*keys).distinct().withColumn("_p", F.lit(True))
    t = labels.select(*keys).distinct().withColumn("_t", F.lit(True))
    both = p.join(t, keys, "full_outer").select(F.col(by).alias("value"), F.coalesce("_p", F.lit(False)).alias("p"), F.coalesce("_t", F.lit(False)).alias("t"))
    n = lambda c: F.sum(c.cast("long"))
    out = both.rollup("value").agg(n(F.col("p") & F.col("t")).alias("tp"), n(F.col("p") & ~F.col("t")).alias("fp"), n(~F.col("p") & F.col("t")).alias("fn"), F.grouping("value").alias("is_total"))
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return out.withColumns({"precision": precision, "recall": recall, "f1": ratio(2 * precision * recall, precision + recall)})


def samples(predictions: DataFrame, labels: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Predictions with a score other than 0 and hit: whether a label has their keys. Repeated predictions stay."""
    t = labels.select(*keys).distinct().withColumn("hit", F.lit(True))
    return predictions.where(F.col(score) != 0).join(t, keys, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def pool_scores(sampled: DataFrame, score: str = "score", hit: str = "hit") -> DataFrame:
    """(x, n, hits): the samples by score; the only form of them that leaves the executors."""
    return sampled.groupBy(F.col(score).alias("x")).agg(F.count("*").alias("n"), F.sum(F.col(hit).cast("long")).alias("hits"))


def _pooled_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The blocks (lo, hi, n, hits, scores) of adjacent violators in rows of one range in ascending order."""
    blocks: list[list] = []
    for pdf in batches:
        for lo, hi, n, h, c in zip(*(pdf[k].tolist() for k in ("lo", "hi", "n", "hits", "scores"))):
            blocks.append([lo, hi, n, h, c])
            while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
                _, hi_, n_, h_, c_ = blocks.pop()
                last = blocks[-1]
                blocks[-1] = [last[0], hi_, last[2] + n_, last[3] + h_, last[4] + c_]
    yield pd.DataFrame(blocks, columns=["lo", "hi", "n", "hits", "scores"]).astype({"lo": "float64", "hi": "float64", "n": "int64", "hits": "int64", "scores": "int64"})


def isotonic_blocks(pooled: DataFrame) -> list[tuple[float, float, float]]:
    """(lo, hi, y): the blocks of the non-decreasing fit by pooling adjacent violators, exact for any number of scores.

    Each range of scores is pooled on the cluster; only its blocks, whose values ascend, reach the driver and are pooled on.
    Blocks of adjacent violators of a range are blocks of the whole or parts of them.
    """
    rows = pooled.select(F.col("x").cast("double").alias("lo"), F.col("x").cast("double").alias("hi"), F.col("n").cast("long").alias("n"), F.col("hits").cast("long").alias("hits"), F.lit(1).cast("long").alias("scores"))
    parts = rows.repartitionByRange("lo").sortWithinPartitions("lo").mapInPandas(_pooled_blocks, "lo double, hi double, n long, hits long, scores long").toPandas()
    whole = next(_pooled_blocks(iter([parts.sort_values("lo")])))
    return [(lo, hi, h / n) for lo, hi, n, h in zip(*(whole[k].tolist() for k in ("lo", "hi", "n", "hits")))]


def isotonic_fit(pooled: DataFrame) -> list[tuple[float, float]]:
    """Knots (x, y) of the non-decreasing fit by pooling adjacent violators, one for each distinct score; none without samples."""
    blocks = isotonic_blocks(pooled)
    his = np.array([hi for _, hi, _ in blocks])
    xs = sorted(float(r["x"]) for r in pooled.select("x").collect())
    return [(x, float(blocks[i][2])) for x, i in zip(xs, np.searchsorted(his, xs).tolist())]


def fitted(pooled: DataFrame) -> DataFrame:
    """(x, y): the same fit as a table, whose scores stay on the cluster."""
    blocks = pooled.sparkSession.createDataFrame(isotonic_blocks(pooled), "lo double, hi double, y double")
    return pooled.select(F.col("x").cast("double").alias("x")).join(blocks, F.col("x").between(F.col("lo"), F.col("hi"))).select("x", "y")


def interpolated(score: Column, knots: list[tuple[float, float]]) -> Column:
    """Linear interpolation between knots, constant beyond them; without knots the score itself. Scores of 0 stay 0."""
    if not knots:
        return score
    xs, ys = F.array(*(F.lit(float(x)) for x, _ in knots)), F.array(*(F.lit(float(y)) for _, y in knots))
    at = F.size(F.filter(xs, lambda x: x <= score))  # knots at or before the score
    lo, hi = F.greatest(at, F.lit(1)), F.least(at + 1, F.lit(len(knots)))
    x0, x1, y0, y1 = F.element_at(xs, lo), F.element_at(xs, hi), F.element_at(ys, lo), F.element_at(ys, hi)
    inside = F.when(x1 > x0, y0 + (y1 - y0) * (F.least(F.greatest(score, x0), x1) - x0) / (x1 - x0)).otherwise(y0)
    return F.when(score == 0, score).otherwise(inside)


def brier(pooled: DataFrame, p: Column) -> DataFrame:
    """(brier, samples): the mean squared error of the predictions p over pooled scores (x, n, hits); NULL without samples."""
    error = F.col("hits") * (p - 1) * (p - 1) + (F.col("n") - F.col("hits")) * p * p
    return pooled.agg(F.try_divide(F.sum(error), F.sum("n")).alias("brier"), F.coalesce(F.sum("n"), F.lit(0)).alias("samples"))
