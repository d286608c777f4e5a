"""Sorted tables on disk that are read by ranges of their key: a directory of pages tells which row groups hold a range.

A page is a row group of a Parquet file that is sorted by its first column, a long. The directory has one row per page, so
that a look-up reads the pages of its ranges and nothing else, whatever the size of the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a page before compression.
PAGE_BYTES = 1 << 20
#: Files whose footers the driver reads itself; of more, tasks do.
DRIVER_FILES = 32
DIRECTORY = "file string, page int, first long, last long, rows long"


def _opened(file: str) -> pq.ParquetFile:
    if "://" not in file and not file.startswith("file:"):
        return pq.ParquetFile(file)
    system, path = fs.FileSystem.from_uri("file://" + file.removeprefix("file:").replace("//", "/") if file.startswith("file:") else file)
    return pq.ParquetFile(path, filesystem=system)


def _footer(file: str, key: str) -> list[tuple[str, int, int, int, int]]:
    """The pages of a file, as rows of a directory."""
    meta = _opened(file).metadata
    at = meta.schema.names.index(key)
    groups = [(g, meta.row_group(g)) for g in range(meta.num_row_groups)]
    return [(file, g, x.column(at).statistics.min, x.column(at).statistics.max, x.num_rows) for g, x in groups if x.num_rows]


def write_pages(df: DataFrame, path: str, by: Column | None = None) -> None:
    """df as a table sorted by its first column (a long without NULLs), and its directory beside it.

    by spreads the rows over files, each of them sorted; without it files hold ranges of the key, for which df is read twice.
    """
    spark = df.sparkSession
    key = df.columns[0]
    spread = df.repartitionByRange(key) if by is None else df.repartition(by)
    spread.sortWithinPartitions(*df.columns[:2]).write.option("parquet.block.size", PAGE_BYTES).parquet(f"{path}/rows")
    files = spark.read.parquet(f"{path}/rows").inputFiles()

    if len(files) <= DRIVER_FILES:
        listed = spark.createDataFrame([r for f in files for r in _footer(f, key)], DIRECTORY)
    else:

        def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cols = list(zip(*(r for f in batch.column(0).to_pylist() for r in _footer(f, key)))) or [[]] * 5
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["file", "page", "first", "last", "rows"])

        listed = spark.createDataFrame([(f,) for f in files], "file string").repartition(64).mapInArrow(footers, DIRECTORY)
    listed.coalesce(1).write.parquet(f"{path}/pages")


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a table."""
    return spark.read.parquet(f"{path}/rows")


def pages_of(spark: SparkSession, paths: list[str], wanted: DataFrame) -> DataFrame:
    """(file, page, ...): the pages of the tables that each range (lo, hi, ...) of wanted falls into.

    Ranges and pages meet on slots of the key, about as many as there are pages.
    """
    directory = spark.read.schema(DIRECTORY).parquet(*(f"{p}/pages" for p in paths))
    found = directory.agg(F.count("*").alias("n"), F.min("first").alias("a"), F.max("last").alias("b")).first()
    low, high, n = found["a"] or 0, found["b"] or 0, max(1, found["n"])
    width = (high - low) // n + 1
    slot = lambda c: F.expr(f"(cast(least(greatest({c}, {low}), {high}) as decimal(38, 0)) - ({low})) div {width}")
    pages = directory.select("file", "page", "first", "last", F.explode(F.sequence(slot("first"), slot("last"))).alias("slot"))
    asked = wanted.where((F.col("hi") >= F.lit(low)) & (F.col("lo") <= F.lit(high))).withColumn("slot", F.explode(F.sequence(slot("lo"), slot("hi"))))
    met = asked.join(pages, "slot").where((F.col("first") <= F.col("hi")) & (F.col("last") >= F.col("lo")) & (F.col("slot") == F.greatest(slot("lo"), slot("first"))))
    return met.select("file", "page", *wanted.columns)


def read_ranges(spark: SparkSession, paths: list[str], wanted: DataFrame, work: Callable[[dict[str, pa.Array], pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """work(ranges, page) of every page of the tables that a range (lo, hi, ...) of wanted falls into, its rows being columns.

    Each page is read by one task, for a batch of ranges at a time. A page's name travels once, its ranges carry a number.
    """
    met = pages_of(spark, paths, wanted)
    number = F.xxhash64("file", "page").alias("number")
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in wanted.schema]
    named = spark.read.schema(DIRECTORY).parquet(*(f"{p}/pages" for p in paths)).select(number, "file", "page", *empty)
    rows = named.union(met.select(number, F.lit(None).cast("string"), F.lit(None).cast("int"), *wanted.columns))
    ordered = rows.repartition("number").sortWithinPartitions("number", F.col("file").isNull(), "lo")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = spot = page = None
        handle, name = None, None
        for batch in batches:
            numbers, files, pages = batch.column(0).to_numpy(), batch.column(1), batch.column(2)
            cuts = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), batch.num_rows]
            for s, e in zip(cuts, cuts[1:]):
                if s == e:
                    continue
                if number != numbers[s]:
                    number, spot, page = numbers[s], None, None
                while s < e and files[s].is_valid:
                    spot = (files[s].as_py(), pages[s].as_py())
                    s += 1
                if s == e:
                    continue
                if page is None:
                    if name != spot[0]:
                        handle, name = _opened(spot[0]), spot[0]
                    page = handle.read_row_group(spot[1])
                part = batch.slice(s, e - s)
                got = work({n: part.column(i + 3) for i, n in enumerate(part.schema.names[3:])}, page)
                if got is not None:
                    yield got

    return ordered.mapInArrow(run, schema)


def starts_and_ends(keys: np.ndarray, ranges: dict[str, pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """The places of each range in sorted keys, by binary search."""
    return np.searchsorted(keys, ranges["lo"].to_numpy(), "left"), np.searchsorted(keys, ranges["hi"].to_numpy(), "right")
