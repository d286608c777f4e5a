"""First-match joins on ranges, fallbacks by priority, and differences between snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def range_first_match(left: DataFrame, right: DataFrame, eq: Sequence[str], left_range: tuple[str, str], right_range: tuple[str, str], order: str, left_id: str = "ordinal", where: Column | None = None, block: int = 64, rank: Column | None = None) -> DataFrame:
    """(left_id, match): for each left row the first right row, by order, of equal eq whose range overlaps its own.

    Both ranges are cut into blocks of lines, which join the equality keys: a file with very many rows is spread over its
    blocks instead of being compared as a whole. match is a struct of the right row; left rows without one do not come out.
    where may compare further columns, the left side's as l.x and the right side's as r.x. With rank, a column over both, the
    match of least rank is taken, and (left_id, rank) comes out.
    """
    def blocks(df: DataFrame, lo: str, hi: str) -> DataFrame:
        cut = lambda c: F.floor(F.col(c) / block)
        return df.where(F.col(lo) <= F.col(hi)).withColumn("_block", F.explode(F.sequence(cut(lo), cut(hi))))

    l, r = blocks(left, *left_range).alias("l"), blocks(right, *right_range).alias("r")  # noqa: E741
    cond = F.col("l._block") == F.col("r._block")
    for c in eq:
        cond &= F.col(f"l.{c}") == F.col(f"r.{c}")
    cond &= (F.col(f"r.{right_range[0]}") <= F.col(f"l.{left_range[1]}")) & (F.col(f"r.{right_range[1]}") >= F.col(f"l.{left_range[0]}"))
    if where is not None:
        cond &= where
    if rank is not None:
        return l.join(r, cond).groupBy(F.col(f"l.{left_id}").alias(left_id)).agg(F.min(rank).alias("rank"))
    row = F.struct(*(F.col(f"r.{c}") for c in right.columns))
    return l.join(r, cond).groupBy(F.col(f"l.{left_id}").alias(left_id)).agg(F.min_by(row, F.col(f"r.{order}")).alias("match"))


def prioritised(candidates: DataFrame, key: Sequence[str], priority: Sequence[str]) -> DataFrame:
    """The candidate of least priority of each key."""
    rest = [c for c in candidates.columns if c not in key]
    return candidates.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*priority)).alias("_b")).select(*key, "_b.*")


def with_default(left: DataFrame, lookup: DataFrame, key: str, values: Sequence[str], default: str = "default") -> DataFrame:
    """left with the values of its key, or those of the key default, or NULL. The lookup has one row per key and is broadcast."""
    d = lookup.where(F.col(key) == default).select(*values).first()
    out = left.join(F.broadcast(lookup.where(F.col(key) != default).select(key, *values)), key, "left")
    other = {v: F.lit(d[v] if d else None).cast(lookup.schema[v].dataType) for v in values}
    return out.select(*left.columns, *(F.coalesce(v, other[v]).alias(v) for v in values))


def first_drop(stages: Sequence[tuple[str, DataFrame]], key: str) -> DataFrame:
    """(key, stage_no, stage): the first of the successive snapshots that a row of the first one is missing from."""
    seen = None
    for i, (name, df) in enumerate(stages):
        tagged = df.select(key, F.lit(i).alias("_i"))
        seen = tagged if seen is None else seen.union(tagged)
    have = seen.groupBy(key).agg(F.collect_set("_i").alias("_in")).where(F.array_contains("_in", 0))
    missing = F.array_min(F.array_except(F.lit(list(range(len(stages)))), F.col("_in")))
    names = F.array(*(F.lit(n) for n, _ in stages))
    return have.select(key, missing.alias("stage_no")).where("stage_no IS NOT NULL").select(key, "stage_no", F.element_at(names, F.col("stage_no") + 1).alias("stage"))


def first_step(steps: Sequence[tuple[str, Column]], kept: str = "kept") -> Column:
    """The name of the first of successive filters that removes a row, kept if none does; NULL removes nothing."""
    out = F.lit(kept)
    for name, drops in reversed(list(steps)):
        out = F.when(drops, F.lit(name)).otherwise(out)
    return out


def flagged(rows: DataFrame, named: DataFrame, key: str, flag: str) -> DataFrame:
    """rows with flag set where named has their key; no row goes."""
    n = named.select(key).distinct().withColumn("_named", F.lit(True))
    return rows.join(n, key, "left").withColumn(flag, F.col(flag) | F.coalesce("_named", F.lit(False))).drop("_named")


def all_of(parts: Sequence[DataFrame], number: str) -> DataFrame:
    """The rows of all parts, with the part's number; columns are matched by name."""
    from functools import reduce

    return reduce(DataFrame.unionByName, (p.withColumn(number, F.lit(i)) for i, p in enumerate(parts)))


def in_all(names: DataFrame, lists: Sequence[DataFrame], column: str, other: str) -> DataFrame:
    """The names that all lists have, sorted; one row with other if there is none."""
    left = names
    for x in lists:
        left = left.join(x.select(column).distinct(), column, "left_semi")
    found = left.select(column).distinct()
    alone = names.sparkSession.createDataFrame([(other,)], f"{column} string")
    some = found.limit(1).select(F.lit(other).alias(column), F.lit(True).alias("_some"))
    return found.union(alone.join(some, column, "left_anti").select(column)).orderBy(column)


def overridden(rows: DataFrame, values: DataFrame, key: str, columns: Sequence[str], flag: str) -> DataFrame:
    """rows with the columns of values where it has their key and a value, and flag telling so; of several the first in order."""
    v = values.groupBy(key).agg(F.min(F.struct(*columns)).alias("_v"))
    got = rows.join(v, key, "left")
    return got.withColumns({**{c: F.coalesce(F.col("_v")[c], F.col(c)) for c in columns}, flag: F.col("_v").isNotNull()}).drop("_v")
