"""Session builder and the shared scratch folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with UTC time, AQE and Arrow; on a cluster pass the cluster's own settings in conf."""
    b = (
        SparkSession.builder.master(master)
        .appName("fernglass")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a local one where it is unset (tests, local mode)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        root = "file://" + tempfile.mkdtemp(prefix="fernglass-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one that is deleted when the driver's JVM ends."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(p)
    system.deleteOnExit(p)
    return path


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df once as a table in the shared folder and read it back: later stages do not depend on executors' disks.

    The table is deleted when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str = "t") -> tuple[DataFrame, int]:
    """materialize, and how many rows were written, without a job of its own."""
    seen = Observation()
    out = materialize(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return out, seen.get["n"]
