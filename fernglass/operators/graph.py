"""Graph operators on edge tables (src, dst): reach, distance, layers, cycles, bounded paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernglass.session import counted, materialize


def distances(edges: DataFrame, seeds: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(node, distance): nodes reached from the seeds (column node) and the least number of edges to them.

    A frontier is joined with the edges round by round and those already seen are taken off; each round is written to the
    shared folder. The seeds have distance 0. Cycles, loops and repeated edges do no harm.
    """
    step = materialize(edges.select("src", "dst").distinct(), "step")  # read in every round
    seen = materialize(seeds.select("node").where("node IS NOT NULL").distinct().withColumn("distance", F.lit(0)), "seen")
    frontier, hops = seen, 0
    while max_hops is None or hops < max_hops:
        hops += 1
        reached = step.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).where("node IS NOT NULL").distinct()
        frontier, n = counted(reached.join(seen, "node", "left_anti").withColumn("distance", F.lit(hops)), "frontier")
        if not n:
            break
        seen = seen.union(frontier) if hops % 8 else materialize(seen.union(frontier), "seen")
    return seen


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node): the seeds and all that they reach."""
    return distances(edges, seeds).select("node")


def layers(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, layer): nodes whose predecessors are all in earlier layers; nodes on or behind a cycle have NULL.

    Rounds go on until no node is free: as many as there are layers. Finished layers are put together every eight rounds.
    """
    left = materialize(nodes.select("node").union(edges.select("src")).union(edges.select("dst")).distinct(), "left")
    live = materialize(edges.select("src", "dst").distinct(), "live")
    done, layer = None, 0
    while True:
        free, n = counted(left.join(live.select(F.col("dst").alias("node")).distinct(), "node", "left_anti").withColumn("layer", F.lit(layer)), "layer")
        if not n:
            break
        done = free if done is None else done.union(free)
        layer += 1
        if layer % 8 == 0:
            done = materialize(done, "done")
        gone = free.select("node")
        left = materialize(left.join(gone, "node", "left_anti"), "left")
        live = materialize(live.join(gone.withColumnRenamed("node", "src"), "src", "left_anti"), "live")
    rest = left.withColumn("layer", F.lit(None).cast("int"))
    return rest if done is None else done.union(rest)


def bounded_paths(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(path array, hops): the simple paths of one to depth edges from the seeds. Their number may grow with degree ** depth."""
    step = materialize(edges.select("src", "dst").distinct(), "step")
    paths = seeds.select(F.array("node").alias("path")).distinct()
    out = None
    for hops in range(1, depth + 1):
        paths = paths.withColumn("src", F.element_at("path", -1)).join(step, "src").where(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"))
        paths = materialize(paths, "paths")
        level = paths.withColumn("hops", F.lit(hops))
        out = level if out is None else out.union(level)
    return out


def fan_in(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, n): how many edges come in, 0 included."""
    counts = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"))
    return nodes.select("node").join(counts, "node", "left").select("node", F.coalesce("n", F.lit(0)).alias("n"))


def roots(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node): nodes without an edge coming in."""
    return nodes.select("node").join(edges.select(F.col("dst").alias("node")), "node", "left_anti")
