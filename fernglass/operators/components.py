"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernglass.session import materialize


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over the edges of each batch: the batch's spanning stars replace its edges."""
    for pdf in batches:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while parent.setdefault(root, root) != root:
                root = parent[root]
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
            ra, rb = find(a), find(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
        nodes = [x for x in parent if find(x) != x]
        yield pd.DataFrame({"a": [find(x) for x in nodes], "b": nodes}, dtype="int64")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node long, component long): each node of an edge with the smallest node it is connected to.

    Edges are undirected; NULL ends, loops and repeated edges are ignored; an empty table gives an empty result. Rounds go on
    until nothing changes (their number grows with the logarithm of a component's size). Each round is written to the shared folder, only two counters reach the driver. A hub's edges are never in one group:
    minima are pre-aggregated and joined back, where AQE can split a skewed key.
    """
    e = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    e = materialize(e.mapInPandas(_contract, "a long, b long").distinct(), "cc")
    last = None
    while True:
        # e is (a, b) with a < b. Large star: every larger neighbour of u goes to the least of u's neighbourhood.
        both = e.union(e.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        # Small star: smaller neighbours and u itself go to the least of them.
        small = large.groupBy("b").agg(F.min("a").alias("m"))
        e2 = large.join(small, "b")
        e2 = e2.select(F.col("m").alias("a"), "b").union(e2.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct()
        e = materialize(e2, "cc")
        mark = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (mark["n"], mark["h"]) == last:
            break
        last = (mark["n"], mark["h"])
    members = e.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return members.union(e.select("a", "a").distinct().toDF("node", "component"))
