"""The registered queries of the subpackage and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernglass.llm import neardup
from fernglass.llm.credentials import find_credentials
from fernglass.llm.handwritten import not_handwritten
from fernglass.llm.history import PrefixForest
from fernglass.llm.leaks import leaked_passages
from fernglass.llm.mixing import mixture
from fernglass.llm.neighbours import most_similar, with_chunks
from fernglass.llm.parsing import invalid_rates, syntax_check
from fernglass.llm.repetition import repetition
from fernglass.llm.representative import best_findings
from fernglass.sources.tables import table

#: The vocabulary file that problem 9 counts tokens with.
VOCABULARY = os.environ.get("FERNGLASS_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
FINDING_TEXT = ("title", "description", "code_sample")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return not_handwritten(table(spark, sf_dir, "files", "file_id", "path", "content")).select(F.col("id").alias("file_id"))


PLACE_COLUMNS = ("finding_id", "file", "rule_id", "start_line", "end_line", "agent", "verified", "severity", "confidence", "created_at", "description", "code_sample", "cwe", "owasp", "verifier_comment")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = best_findings(table(spark, sf_dir, "findings", *PLACE_COLUMNS), table(spark, sf_dir, "agents", "agent", "trust"))
    return best.where("n_best = 6").select("finding_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    owner = lambda path: F.lower(F.regexp_extract(path, r"^(?:\.?/)*([^/]+)", 1))
    files = table(spark, sf_dir, "files", "file_id", "path", "content").select(F.lit("files").alias("tbl"), F.col("file_id").alias("row_id"), owner("path").alias("owner"), F.col("content").alias("text"))
    findings = table(spark, sf_dir, "findings", "finding_id", "file", "code_sample").select(F.lit("findings"), "finding_id", owner("file"), "code_sample")
    return find_credentials(files.union(findings)).select("tbl", "row_id", F.explode("lines").alias("line_no"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = neardup.near_duplicate_groups(table(spark, sf_dir, "findings", "finding_id", *FINDING_TEXT), "finding_id", FINDING_TEXT, threshold=0.7)
    return neardup.group_pairs(groups).toDF("finding_a", "finding_b")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = most_similar(table(spark, sf_dir, "embedding_cache", "vec_id", "provider", "model", "dim", "vec"), k=10, least=0.85)
    return near.select(F.least("a", "b").alias("vec_a"), F.greatest("a", "b").alias("vec_b")).distinct()


def p1_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = with_chunks(p1_found(spark, sf_dir), table(spark, sf_dir, "embedding_cache", "vec_id", "chunk_key"), table(spark, sf_dir, "rag_chunks", "chunk_key", "payload"))
    return shown.select("vec_a", "vec_b", *(F.col(f"code_{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in ("file", "start_line", "symbol", "text")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = F.from_json("finding_json", "title string, description string, code_sample string")
    entries = table(spark, sf_dir, "baseline", "entry_id", "batch_no", "fingerprint", "finding_json").select("entry_id", "batch_no", "fingerprint", parsed.alias("j"))
    entries = entries.select("entry_id", "batch_no", "fingerprint", "j.title", "j.description", "j.code_sample")
    new = F.coalesce(F.col("batch_no") >= 1, F.lit(False))
    forest = PrefixForest.create(spark, "entry_id", FINDING_TEXT, "fingerprint", threshold=0.7).add(entries.where(~new))
    found = spark.createDataFrame([], "entry_id long, first_id long")
    for row in entries.where(new).select("batch_no").distinct().orderBy("batch_no").collect():  # one after another, as they arrive
        repeats, forest = forest.match(entries.where(F.col("batch_no") == row["batch_no"]))
        found = found.union(repeats)
    return found.select("first_id", "entry_id")


def _syntax(spark: SparkSession, sf_dir: str, places: bool = False) -> DataFrame:
    return syntax_check(table(spark, sf_dir, "file_asts", "file_id", "path"), table(spark, sf_dir, "files", "file_id", "repo", "content"), places)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _syntax(spark, sf_dir).where("edits > 0").select("file_id").distinct()


def p7_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invalid_rates(_syntax(spark, sf_dir))


def p7_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invalid files by language and by what the places of their edits say."""
    return _syntax(spark, sf_dir, True).where("edits > 0").groupBy("language", "kind").agg(F.count("*").alias("files"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_passages(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "eval_items", "item_id", "text")).select("doc_id", "item_id")


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mixture(table(spark, sf_dir, "documents", "doc_id", "source", "text"), table(spark, sf_dir, "mix_targets"), VOCABULARY)


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = repetition(table(spark, sf_dir, "documents", "doc_id", "text"))
    # what the model believes, and what any rule votes for, is checked exactly: so the posterior takes off no case
    return judged.where("probability >= 0.5 OR votes > 0").where("share >= 0.3").select("doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found, "p1_shown": p1_shown, "p2_found": p2_found, "p3_found": p3_found, "p4_found": p4_found, "p5_found": p5_found, "p6_found": p6_found, "p7_found": p7_found, "p7_rates": p7_rates, "p7_kinds": p7_kinds, "p8_found": p8_found, "p9_mixture": p9_mixture, "p9_shares": p9_shares, "p10_found": p10_found}
SQL: dict[str, str] = {
    "p4_found": r"""
WITH r AS (
  SELECT finding_id, lower(trim(rule_id)) AS rule, start_line AS s, end_line AS e,
         regexp_replace(regexp_replace(regexp_replace(trim(file), '[\\\\/]+', '/', 'g'), '/(\./)+', '/', 'g'), '^(\./)+', '') AS f,
         CASE WHEN verified THEN 2 WHEN NOT verified THEN 1 ELSE 0 END AS q1,
         CASE lower(trim(severity)) WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 WHEN 'info' THEN 1 ELSE 0 END AS q2,
         CASE lower(trim(confidence)) WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS q3,
         coalesce((SELECT max(trust) FROM agents a WHERE lower(trim(a.agent)) = lower(trim(findings.agent))), -1000000) AS q4,
         coalesce(created_at, TIMESTAMP '0001-01-01') AS q5,
         CAST(coalesce(trim(description), '') <> '' AS INT) + CAST(coalesce(trim(code_sample), '') <> '' AS INT) + CAST(coalesce(trim(cwe), '') <> '' AS INT)
           + CAST(coalesce(trim(owasp), '') <> '' AS INT) + CAST(coalesce(trim(verifier_comment), '') <> '' AS INT) AS q6
  FROM findings WHERE file IS NOT NULL AND rule_id IS NOT NULL AND start_line IS NOT NULL AND end_line IS NOT NULL),
m AS (SELECT f, rule, s, e, count(*) AS n, max(q1) AS m1, max(q2) AS m2, max(q3) AS m3, max(q4) AS m4, max(q5) AS m5, max(q6) AS m6 FROM r GROUP BY f, rule, s, e HAVING count(*) > 1)
SELECT min(finding_id) AS finding_id FROM r JOIN m USING (f, rule, s, e)
WHERE q1 = m1 AND q2 = m2 AND q3 = m3 AND q4 = m4 AND q5 = m5 AND q6 = m6 GROUP BY f, rule, s, e""",
    "p2_found": r"""
WITH e AS (SELECT entry_id, batch_no, fingerprint, list_distinct(regexp_extract_all(lower(concat_ws(' ', coalesce(json_extract_string(finding_json, '$.title'), ''), coalesce(json_extract_string(finding_json, '$.description'), ''), coalesce(json_extract_string(finding_json, '$.code_sample'), ''))), '[a-z0-9_]+')) AS w FROM baseline),
u AS (SELECT entry_id, unnest(w) AS word FROM e), c AS (SELECT a.entry_id AS x, b.entry_id AS y, count(*) AS n FROM u a JOIN u b ON a.word = b.word AND a.entry_id > b.entry_id GROUP BY ALL),
p AS (SELECT x, y FROM c JOIN e a ON a.entry_id = x JOIN e b ON b.entry_id = y WHERE 10 * n >= 7 * (len(a.w) + len(b.w) - n)
UNION ALL SELECT a.entry_id, b.entry_id FROM e a JOIN e b ON a.fingerprint = b.fingerprint AND a.entry_id > b.entry_id)
SELECT min(y) AS first_id, x AS entry_id FROM p JOIN e ON entry_id = x WHERE batch_no >= 1 GROUP BY x""",
    "p6_found": r"""
WITH RECURSIVE e AS (SELECT finding_id AS id, list_distinct(regexp_extract_all(lower(concat_ws(' ', coalesce(title, ''), coalesce(description, ''), coalesce(code_sample, ''))), '[a-z0-9_]+')) AS w FROM findings),
u AS (SELECT id, unnest(w) AS word FROM e), c AS (SELECT a.id AS x, b.id AS y, count(*) AS n FROM u a JOIN u b ON a.word = b.word AND a.id < b.id GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM c JOIN e a ON a.id = x JOIN e b ON b.id = y WHERE 10 * n >= 7 * (len(a.w) + len(b.w) - n)),
s AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l), r AS (SELECT x, y FROM s UNION SELECT r.x, s.y FROM r JOIN s ON s.x = r.y)
SELECT x AS finding_a, y AS finding_b FROM r WHERE x < y""",
    "p8_found": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents), i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
a AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k : k + 11], ' '))) AS g FROM d), b AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k : k + 11], ' '))) AS g FROM i)
SELECT DISTINCT doc_id, item_id FROM a JOIN b USING (g)""",
    "p10_found": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents), g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 6), lambda k: array_to_string(w[k : k + 7], ' '))) AS g FROM d)
SELECT doc_id FROM g GROUP BY doc_id HAVING 1 - count(DISTINCT g) / count(*) >= 0.3""",
}
