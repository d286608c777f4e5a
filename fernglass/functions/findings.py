"""Row functions over findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernglass.functions import text as T

SEVERITIES = ("critical", "high", "medium", "low", "info")
CONFIDENCES = ("high", "medium", "low")
TEXTS = ("id", "rule_id", "title", "description", "severity", "confidence", "cwe", "owasp", "file", "code_sample", "agent", "verifier_verdict", "verifier_comment", "deep_verdict")


def rank(c: Column, order: Sequence[str]) -> Column:
    """The place in order from the end, so that the first is highest; 0 for other values."""
    r = F.lit(0)
    for i, v in enumerate(order):
        r = F.when(c == v, len(order) - i).otherwise(r)
    return r


def severity_rank(c: Column) -> Column:
    return rank(F.lower(F.trim(c)), SEVERITIES)


def confidence_rank(c: Column) -> Column:
    return rank(F.lower(F.trim(c)), CONFIDENCES)


def normalised(findings: DataFrame) -> DataFrame:
    """Findings with an ordinal, empty texts for NULL, false for NULL flags and 0 for a NULL score: the form all passes take."""
    cols = {c: F.coalesce(c, F.lit("")) for c in TEXTS if c in findings.columns}
    cols |= {c: F.coalesce(c, F.lit(False)) for c in ("verified", "false_positive", "suppressed") if c in findings.columns}
    if "score" in findings.columns:
        cols["score"] = F.coalesce("score", F.lit(0.0))
    return findings.withColumns(cols).withColumnRenamed("finding_id", "ordinal")


def canonical_order() -> list[Column]:
    """Severity, confidence and score down, real before false positives, then file, line and ordinal."""
    return [severity_rank(F.col("severity")).desc(), confidence_rank(F.col("confidence")).desc(), F.desc("score"), F.asc("false_positive"), F.asc("file"), F.asc("start_line"), F.asc("ordinal")]


def trace_signature(trace: Column) -> Column:
    """First source and last sink of a trace, folded; empty without a trace."""
    hop = lambda h: F.when(h.isNull(), "").otherwise(F.concat(T.fold(h["kind"]), F.lit(":"), F.replace(T.fold(h["code"]), F.lit(" "), F.lit(""))))
    kind = lambda k: F.filter(trace, lambda h: F.lower(F.coalesce(h["kind"], F.lit(""))) == k)
    source = F.coalesce(F.try_element_at(kind("source"), F.lit(1)), F.try_element_at(trace, F.lit(1)))
    sink = F.coalesce(F.try_element_at(kind("sink"), F.lit(-1)), F.try_element_at(trace, F.lit(-1)))
    return F.when(F.coalesce(F.size(trace), F.lit(0)) <= 0, "").otherwise(F.concat(hop(source), F.lit("|"), hop(sink)))


def group_key(trace: Column, code: Column, description: Column) -> tuple[Column, Column]:
    """(basis, signature) of a root cause: by trace, else by code without blanks, else by a specific description, else by place."""
    t, c, d = trace_signature(trace), F.replace(T.fold(code), F.lit(" "), F.lit("")), T.specific(description)
    basis = F.when(t != "", "trace").when(c != "", "code_sample").when(d != "", "description").otherwise("location")
    place = F.concat_ws("|", "file", F.col("start_line").cast("string"), F.col("end_line").cast("string"))
    return basis, F.when(t != "", t).when(c != "", c).when(d != "", d).otherwise(place)
