"""Vectors for texts by a provider's function, in batches, and the index of a tree's chunks that is searched by them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def embedded(texts: DataFrame, key: str, text: str, provider: Callable[[list[str]], np.ndarray], batch: int = 64, most_bytes: int = 6000) -> DataFrame:
    """(key, embedding): the provider's vector of each text, of a longer one of as many bytes as it takes; NULL texts give none.

    provider takes a list of at most batch texts and gives a row of values for each; it runs in the tasks, once per batch.
    """
    kind = T.StructType([T.StructField("k", texts.schema[key].dataType), T.StructField("v", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                cut = [t.encode()[:most_bytes].decode("utf-8", "ignore") for t in part.column(1).to_pylist()]
                vectors = np.asarray(provider(cut), np.float32)
                yield pa.record_batch([part.column(0), pa.array(list(vectors), pa.list_(pa.float32()))], names=["k", "v"])

    sel = texts.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    return sel.mapInArrow(run, kind).withColumnsRenamed({"k": key, "v": "embedding"})


@pandas_udf(T.StringType())
def short_hash(text):
    """Six letters and digits of a text by a 32-bit hash (FNV-1a); they name, they do not tell apart for sure."""
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"

    def one(t):
        if t is None:
            return None
        h = 2166136261
        for b in t.encode():
            h = (h ^ b) * 16777619 & 0xFFFFFFFF
        out = ""
        for i in range(6):
            h, r = divmod(h, len(letters))
            out += letters[r]
            h = h or 2166136261 ^ i
        return out

    return text.map(one)
