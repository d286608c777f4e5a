"""Usage by stage and model in tumbling windows, over a stream of calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fernglass.session import scratch_path


def usage_windows(calls: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, stage, model, calls, errors, tokens_in): for streams with a watermark, for tables as it is."""
    c = calls.withWatermark("ts", late) if calls.isStreaming else calls
    g = c.groupBy(F.window("ts", size).alias("w"), "stage", "model").agg(F.count("*").alias("calls"), F.sum((~F.col("ok")).cast("long")).alias("errors"), F.sum("tokens_in").alias("tokens_in"))
    return g.select(F.col("w.start").alias("start"), "stage", "model", "calls", "errors", "tokens_in")


def collected_windows(windows: DataFrame, keys: list[str]) -> DataFrame:
    """The windows of a stream after all that is there now has been read.

    Each micro-batch appends the windows it changed to a table in the shared folder; of each window the last state counts.
    The state that is kept is bounded by the watermark, and nothing passes through the driver.
    """
    spark = windows.sparkSession
    path = scratch_path(spark, "windows")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("append").parquet(f"{path}/rows")

    query = windows.writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    states = spark.read.schema(T.StructType([*windows.schema.fields, T.StructField("_batch", T.IntegerType())])).parquet(f"{path}/rows")
    rest = [c for c in windows.columns if c not in keys]
    return states.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_s")).select(*keys, "_s.*")
