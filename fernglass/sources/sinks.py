"""Sinks: JSON reports, SARIF documents, graph text, fingerprints and call logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernglass.functions import findings as V


def sarif_level(severity: Column) -> Column:
    """error for critical and high, warning for medium, note for the rest."""
    s = F.lower(F.trim(severity))
    return F.when(s.isin("critical", "high"), "error").when(s == "medium", "warning").otherwise("note")


def sarif_rule(rule: Column, agent: Column, title: Column) -> Column:
    """The rule's id, or the agent and the title as a slug where there is none."""
    slug = F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(rule != "", rule).otherwise(F.concat_ws("/", agent, slug))


def sarif_results(findings: DataFrame) -> DataFrame:
    """(ruleId, level, result): one result per finding that is no false positive, as JSON text."""
    f = findings.where("NOT false_positive")
    rule = sarif_rule(F.col("rule_id"), F.col("agent"), F.col("title"))
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.greatest("start_line", F.lit(1)).alias("startLine"), F.greatest("end_line", F.lit(1)).alias("endLine")).alias("region")).alias("physicalLocation"))
    result = F.to_json(F.struct(rule.alias("ruleId"), sarif_level(F.col("severity")).alias("level"), F.struct(F.col("title").alias("text")).alias("message"), F.array(place).alias("locations")))
    return f.select("ordinal", rule.alias("ruleId"), sarif_level(F.col("severity")).alias("level"), result.alias("result"))


def write_sarif(findings: DataFrame, path: str) -> None:
    """One line of SARIF result JSON per finding, in canonical order, over as many files as there are partitions."""
    ordered = findings.where("NOT false_positive").orderBy(*V.canonical_order())
    sarif_results(ordered).select("result").write.mode("overwrite").text(path)


def dot_lines(edges: DataFrame) -> DataFrame:
    """(line): the edges as lines of a graph description, sorted."""
    return edges.select(F.format_string('  "%s" -> "%s";', F.col("src").cast("string"), F.col("dst").cast("string")).alias("line")).distinct().orderBy("line")


def write_snapshot(df: DataFrame, path: str) -> None:
    """JSON lines; an empty table writes an empty folder."""
    df.write.mode("overwrite").json(path)


def append_calls(df: DataFrame, path: str) -> None:
    """JSON lines added to a call log."""
    df.write.mode("append").json(path)


def replace_fingerprints(findings: DataFrame, path: str) -> None:
    """The known fingerprints, replaced as a whole."""
    findings.select("fingerprint").where("fingerprint IS NOT NULL").distinct().write.mode("overwrite").parquet(path)


def sarif_rules(findings: DataFrame) -> DataFrame:
    """(rule, name, results): the distinct rules of findings that are no false positives, named by the first in canonical order."""
    f = findings.where("NOT false_positive")
    order = F.struct(-V.severity_rank(F.col("severity")), -V.confidence_rank(F.col("confidence")), -F.col("score"), "file", "start_line", "ordinal")
    keyed = f.select(sarif_rule(F.col("rule_id"), F.col("agent"), F.col("title")).alias("rule"), "title", order.alias("o"))
    return keyed.groupBy("rule").agg(F.min_by("title", "o").alias("name"), F.count("*").alias("results"))


def dot_document(edges: DataFrame) -> DataFrame:
    """(at, line): a whole graph description in the order of at: its head, the nodes, the edges, its end."""
    node = edges.select(F.explode(F.array(F.col("src").cast("string"), F.col("dst").cast("string"))).alias("n")).distinct().select(F.lit(1).alias("at"), F.format_string('  "%s";', "n").alias("line"))
    frame = edges.sparkSession.createDataFrame([(0, "digraph G {"), (3, "}")], "at int, line string")
    return frame.union(node).union(dot_lines(edges).select(F.lit(2), "line")).orderBy("at", "line")


def report_lines(findings: DataFrame) -> DataFrame:
    """(ordinal, line): one line of a text report per finding: its severity, title and place."""
    s = F.lower(F.trim("severity"))
    level = F.upper(F.when(s.isin(*V.SEVERITIES), s).otherwise("other"))
    return findings.select("ordinal", F.concat(F.lit("["), level, F.lit("] "), F.col("title"), F.lit(" ("), F.col("file"), F.lit(":"), F.col("start_line").cast("string"), F.lit(")")).alias("line"))


def write_report(findings: DataFrame, path: str) -> None:
    """All findings as JSON lines in canonical order."""
    findings.orderBy(*V.canonical_order()).write.mode("overwrite").json(path)
