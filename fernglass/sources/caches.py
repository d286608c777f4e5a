"""Tables kept by key: vectors, answers of tools, packs, parse records. A cache is a folder of Parquet that only grows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException
from pyspark.sql.functions import pandas_udf


@pandas_udf(T.ArrayType(T.FloatType()))
def decoded(vec: pd.Series) -> pd.Series:
    """Little-endian float32 bytes as values; NULL for NULL and for lengths that are no multiple of four."""
    return vec.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, "<f4"))


@pandas_udf(T.BinaryType())
def encoded(values: pd.Series) -> pd.Series:
    """Values as little-endian float32 bytes."""
    return values.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


def kept(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a cache; a cache that is not there is empty."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def put(rows: DataFrame, path: str, keys: Sequence[str], when: Column | None = None) -> None:
    """Rows added to a cache, each key once; only those that when holds for, such as packs that fit."""
    (rows if when is None else rows.where(when)).dropDuplicates(list(keys)).write.mode("append").parquet(path)


def looked_up(asked: DataFrame, cache: DataFrame, keys: Sequence[str]) -> DataFrame:
    """asked with the cache's columns (NULL for a miss) and hit; of a key that was put more than once one row counts."""
    one = cache.dropDuplicates(list(keys)).withColumn("hit", F.lit(True))
    return asked.join(one, list(keys), "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def counters(looked: DataFrame) -> DataFrame:
    """(hits, misses) of a look-up."""
    return looked.agg(F.count(F.when(F.col("hit"), 1)).alias("hits"), F.count(F.when(~F.col("hit"), 1)).alias("misses"))
