"""Context packs: fragments around a chunk, merged, admitted in order up to a budget, and put together as text."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kinds of fragments, the foremost first, as they stand in a pack.
KINDS = ("callee", "caller", "type", "sanitizer", "const", "sibling", "rag")


@dataclass(frozen=True)
class Preset:
    """What a pack may hold."""

    budget: int
    ratio: float = 0.6
    depth: int = 2
    siblings: int = 3
    similar: int = 4


PRESETS = {"minimal": Preset(40_000, depth=1, siblings=0, similar=0), "balanced": Preset(80_000), "aggressive": Preset(80_000, depth=3, siblings=6, similar=8), "extreme": Preset(120_000, depth=4, siblings=8, similar=12)}


def overflows(tokens: Column, budget: int, ratio: float = 0.6) -> Column:
    """Whether a chunk takes more than its part of the budget, so that it has to be cut."""
    return tokens > int(budget * ratio)


def outside(fragments: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """The fragments (key, file_id, start_line, end_line, ...) that do not overlap their chunk in its file."""
    c = chunks.select(key, F.col("file_id").alias("_f"), F.col("start_line").alias("_a"), F.col("end_line").alias("_b"))
    over = (F.col("file_id") == F.col("_f")) & (F.col("start_line") <= F.col("_b")) & (F.col("end_line") >= F.col("_a"))
    return fragments.join(c, key, "left").where(~F.coalesce(over, F.lit(False))).drop("_f", "_a", "_b")


def admitted(items: DataFrame, key: str, order: Sequence[str], size: str, ordinal: str, budget: int, floor: int, squeezable: str | None = None, least: int = 0) -> DataFrame:
    """(key, ordinal, granted): the items of a key that fit its budget, in order: whole where there is room, else squeezed.

    An item that does not fit gets what is left if that is at least floor (and squeezable, a column, holds); nothing is
    admitted where least or less is left. Dropped items take nothing. Items pass through a task in order, and only what is
    left of the present key's budget is held, so a key may have any number of items.
    """
    schema = T.StructType([items.schema[key], items.schema[ordinal], T.StructField("granted", T.LongType())])
    schema = T.StructType([T.StructField("k", schema[0].dataType), T.StructField("i", schema[1].dataType), schema[2]])
    sel = items.select(F.col(key).alias("k"), F.col(ordinal).alias("i"), F.col(size).cast("long").alias("s"), (F.col(squeezable) if squeezable else F.lit(True)).alias("q"), *(F.col(o).alias(f"o{n}") for n, o in enumerate(order)))
    ordered = sel.repartition("k").sortWithinPartitions("k", *(f"o{n}" for n in range(len(order))), "i").select("k", "i", "s", "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, left = object(), 0
        for batch in batches:
            keep, grants = [], []
            for at, (k, s, q) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                if k != now:
                    now, left = k, budget
                grant = 0 if left <= least else s if s <= left else left if floor and left >= floor and q else 0
                if grant:
                    left -= grant
                    keep.append(at)
                    grants.append(grant)
            part = batch.take(pa.array(keep, pa.int64()))
            yield pa.record_batch([part.column(0), part.column(1), pa.array(grants, pa.int64())], names=["k", "i", "granted"])

    return ordered.mapInArrow(run, schema).withColumnsRenamed({"k": key, "i": ordinal})


def rendered(fragments: DataFrame, key: str, kind: str, order: Sequence[str], text: Column) -> DataFrame:
    """(key, text): a key's fragments as one text, by kind in the order of KINDS, then by order. A pack is bounded by its budget."""
    place = F.coalesce(F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col(kind)), F.lit(0))
    row = F.struct(place.alias("p"), *(F.col(o) for o in order), text.alias("t"))
    return fragments.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["t"]), "\n").alias("text"))
