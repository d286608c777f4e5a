"""Readers of source trees, call logs and label files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernglass.functions import text as T

CALL = "ts timestamp, stage string, provider string, model string, tokens_in long, tokens_out long, latency_ms long, ok boolean, error string"


def source_tree(spark: SparkSession, root: str, exclude: tuple[str, ...] = (), glob: str = "*", max_bytes: int = 262_144) -> DataFrame:
    """(path, language, content, lines) of the files below root: of known languages, up to max_bytes, no path with an excluded part."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).where(F.col("length") <= max_bytes)
    for part in exclude:
        raw = raw.where(~F.col("path").contains(part))
    text = F.decode("content", "UTF-8")
    out = raw.select("path", T.language_of(F.col("path")).alias("language"), text.alias("content"), T.line_count(text).alias("lines"))
    return out.where(F.col("language") != "text")


def call_log(spark: SparkSession, path: str) -> DataFrame:
    """A call log of JSON lines; malformed and blank lines are left out."""
    return spark.read.schema(CALL + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path).where("_bad IS NULL AND stage IS NOT NULL").drop("_bad")


def json_labels(spark: SparkSession, path: str) -> DataFrame:
    """(file, cwe) of a JSON array of labels."""
    return spark.read.schema("file string, cwe string, line int").json(path, multiLine=True).where("file IS NOT NULL").select("file", F.upper("cwe").alias("cwe"))


def jsonl_labels(spark: SparkSession, path: str) -> DataFrame:
    """(file, cwe) of JSON lines with label 1 and a path; malformed lines are left out."""
    rows = spark.read.schema("path string, cwe string, label int").option("mode", "DROPMALFORMED").json(path)
    return rows.where("label = 1 AND path <> ''").select(F.col("path").alias("file"), F.upper("cwe").alias("cwe"))


def csv_labels(spark: SparkSession, path: str) -> DataFrame:
    """(file, cwe) of rows name, category, real, cwe with real true; headers and # lines are left out."""
    rows = spark.read.schema("name string, category string, real string, cwe string").option("comment", "#").csv(path)
    return rows.where("lower(trim(real)) = 'true'").select(F.col("name").alias("file"), F.concat(F.lit("CWE-"), F.regexp_extract("cwe", r"(\d+)", 1)).alias("cwe"))


def parse_cached(files: DataFrame, cache: DataFrame | None, parse) -> tuple[DataFrame, DataFrame]:
    """(parsed rows of all files, rows to add to the cache): only contents that the cache (key, ...) lacks are parsed."""
    keyed = files.withColumn("key", T.cache_key(F.col("content"), F.col("language")))
    if cache is None:
        fresh = parse(keyed.dropDuplicates(["key"]))
        return keyed.select("path", "key").join(fresh, "key"), fresh
    missing = keyed.join(cache.select("key"), "key", "left_anti").dropDuplicates(["key"])
    fresh = parse(missing)
    return keyed.select("path", "key").join(cache.unionByName(fresh), "key"), fresh
