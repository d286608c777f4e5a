"""Queries over reviews, verdicts, filters and funnels of findings, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fernglass.functions import findings as V
from fernglass.functions import text as T
from fernglass.functions import verdicts as W
from fernglass.operators import dedup, joins, sequential
from fernglass.plans.catalogue import WITH, findings, query
from fernglass.sources.tables import table

_GATE = "CASE WHEN lower(trim(coalesce(gates.{0}, ''))) IN ('pass', 'ok', 'yes', 'supports', 'true') THEN 'pass' WHEN lower(trim(coalesce(gates.{0}, ''))) IN ('fail', 'blocked', 'no', 'refutes', 'false') THEN 'fail' WHEN lower(trim(coalesce(gates.{0}, ''))) IN ('n/a', 'na', 'not applicable', 'unknown-na') THEN 'n/a' ELSE '' END AS {1}"
WITH["gt"] = f"""gt AS (SELECT *, CASE WHEN va = 'fail' THEN 'validation failed' WHEN ap = 'fail' THEN 'api_contract failed' WHEN en = 'fail' THEN 'environment failed' WHEN co = 'fail' THEN 'control failed' WHEN re = 'fail' THEN 'reachability failed' WHEN im = 'fail' THEN 'impact failed' ELSE '' END AS why,
  CASE WHEN gates IS NULL OR co || re || va || ap || en || im = '' THEN 'unknown' WHEN 'fail' IN (va, ap, en) THEN 'refuted_defended' WHEN 'fail' IN (co, re) THEN 'refuted_no_control' WHEN im = 'fail' THEN 'defense_in_depth'
  WHEN '' IN (co, re, va, ap, en, im) OR 'pass' NOT IN (co, re, va, ap, en, im) THEN 'inconclusive' ELSE 'confirmed' END AS outcome
  FROM (SELECT finding_id AS ordinal, gates, coalesce(verified, false) AS verified, coalesce(false_positive, false) AS false_positive, coalesce(severity, '') AS severity, coalesce(confidence, '') AS confidence, coalesce(verifier_verdict, '') AS verifier_verdict,
  coalesce(deep_verdict, '') AS deep_verdict, coalesce(verifier_comment, '') AS verifier_comment, coalesce(score, 0) AS score, coalesce(suppressed, false) AS suppressed, coalesce(file, '') AS file, coalesce(rule_id, '') AS rule_id, coalesce(agent, '') AS agent, start_line, tags, trace,
  {", ".join(_GATE.format(k, k[:2]) for k in W.GATES)} FROM findings))"""
FLAGS = ("gates", "verified", "false_positive", "severity", "confidence", "verifier_verdict", "deep_verdict", "verifier_comment", "score", "suppressed", "file", "rule_id", "agent", "start_line")


def reasons() -> dict:
    return {k: F.lit(f"{k} failed") for k in W.GATES}


@query("SELECT ordinal, outcome, why FROM gt", "gt")
def gate_outcomes(spark, d):
    f = findings(spark, d, "gates")
    return f.select("ordinal", W.gate_outcome(F.col("gates")).alias("outcome"), W.failing_reason(F.col("gates"), reasons()).alias("why"))


@query("""SELECT ordinal, outcome, verified OR outcome = 'confirmed' AS verified, (false_positive OR outcome LIKE 'refuted%') AND outcome <> 'confirmed' AS false_positive, CASE WHEN outcome = 'defense_in_depth' THEN 'low' ELSE severity END AS severity,
CASE WHEN outcome LIKE 'refuted%' THEN why WHEN outcome = 'defense_in_depth' THEN 'defense-in-depth: impact failed' ELSE '' END AS fp_reason, outcome = 'defense_in_depth' AS defense_in_depth FROM gt""", "gt")
def gates_applied(spark, d):
    f = findings(spark, d, "gates", "verified", "false_positive", "severity")
    new = W.gates_applied(F.col("gates"), reasons(), F.col("verified"), F.col("false_positive"), F.col("severity"), F.lit(""))
    return f.select("ordinal", *(c.alias(k) for k, c in new.items()))


@query("""SELECT ordinal, CASE WHEN outcome = 'unknown' THEN fp WHEN outcome = 'inconclusive' THEN false_positive OR fp WHEN outcome LIKE 'refuted%' THEN true WHEN outcome = 'confirmed' THEN false ELSE false_positive END AS false_positive,
CASE WHEN outcome = 'defense_in_depth' THEN 'low' ELSE severity END AS severity FROM (SELECT *, verifier_verdict = 'false_positive' AS fp FROM gt)""", "gt")
def verifier_merged(spark, d):
    """A verifier's answer merged into its finding: the review first, the bare word where the review is open."""
    f = findings(spark, d, "gates", "verified", "false_positive", "severity", "verifier_verdict")
    new = W.gates_applied(F.col("gates"), reasons(), F.lit(True), F.col("false_positive"), F.col("severity"), F.lit(""))
    says = F.col("verifier_verdict") == "false_positive"
    fp = F.when(new["outcome"] == "unknown", says).when(new["outcome"] == "inconclusive", F.col("false_positive") | says).otherwise(new["false_positive"])
    return f.select("ordinal", fp.alias("false_positive"), new["severity"].alias("severity"))


@query("""SELECT ordinal, verdict, false_positive OR verdict = 'refuted' AS false_positive, CASE WHEN outcome = 'defense_in_depth' THEN 'low' ELSE severity END AS severity FROM (SELECT *, CASE WHEN outcome LIKE 'refuted%' THEN 'refuted' WHEN outcome IN ('confirmed', 'defense_in_depth') THEN 'confirmed'
WHEN lower(trim(deep_verdict)) IN ('confirmed', 'refuted') THEN lower(trim(deep_verdict)) ELSE 'inconclusive' END AS verdict FROM gt)""", "gt")
def deep_reconciled(spark, d):
    f = findings(spark, d, "gates", "false_positive", "severity", "deep_verdict")
    word = W.deep_verdict(F.col("deep_verdict"), F.col("gates"))
    return f.select("ordinal", word.alias("verdict"), (F.col("false_positive") | (word == "refuted")).alias("false_positive"), F.when(W.gate_outcome(F.col("gates")) == "defense_in_depth", "low").otherwise(F.col("severity")).alias("severity"))


@query("""SELECT ordinal, CASE WHEN outcome LIKE 'refuted%' OR outcome = 'unknown' AND word = 'refuted' THEN true WHEN outcome = 'confirmed' THEN false ELSE false_positive END AS false_positive, word AS verdict
FROM (SELECT *, CASE WHEN lower(trim(deep_verdict)) IN ('confirmed', 'refuted') THEN lower(trim(deep_verdict)) ELSE 'inconclusive' END AS word FROM gt)""", "gt")
def plan_verdict_merged(spark, d):
    f = findings(spark, d, "gates", "false_positive", "deep_verdict")
    word = W.folded(F.col("deep_verdict"))
    word = F.when(word.isin("confirmed", "refuted"), word).otherwise("inconclusive")
    outcome = W.gate_outcome(F.col("gates"))
    fp = F.when(outcome.startswith("refuted") | ((outcome == "unknown") & (word == "refuted")), True).when(outcome == "confirmed", False).otherwise(F.col("false_positive"))
    return f.select("ordinal", fp.alias("false_positive"), word.alias("verdict"))


@query("""SELECT ordinal, CASE WHEN lower(trim(deep_verdict)) IN ('confirmed', 'refuted') THEN lower(trim(deep_verdict)) ELSE 'inconclusive' END AS verdict, trim(verifier_comment) AS reason FROM gt""", "gt")
def verdict_from_answer(spark, d):
    """Verdicts out of answers with other braces around the object: the last balanced object that parses counts."""
    f = findings(spark, d, "deep_verdict", "verifier_comment")
    answer = F.concat(F.lit("Given {x} and {\"a\": 1} first.\n```json\n"), F.to_json(F.struct(F.col("deep_verdict").alias("verdict"), F.col("verifier_comment").alias("reason"))), F.lit("\n```"))
    got = sequential.map_rows(f.withColumn("answer", answer), "answer", ["ordinal"], lambda t: [(sequential.balanced_json(t, last=True),)], "json string")
    v = F.from_json("json", "verdict string, reason string")
    word = W.folded(v["verdict"])
    return got.select("ordinal", F.when(word.isin("confirmed", "refuted"), word).otherwise("inconclusive").alias("verdict"), F.trim(F.coalesce(v["reason"], F.lit(""))).alias("reason"))


_WORD = "CASE WHEN lower(trim({0})) IN ('tp', 'true_positive', 'true-positive', 'true positive', 'confirmed') THEN 'tp' WHEN lower(trim({0})) IN ('fp', 'false_positive', 'false-positive', 'false positive', 'refuted') THEN 'fp' WHEN lower(trim({0})) IN ('inconclusive', 'unknown', 'needs_more_context') THEN 'inconclusive' ELSE '' END"


@query(f""", t AS (SELECT ordinal, r, {_WORD.format('verifier_verdict')} AS p, {_WORD.format('deep_verdict')} AS o, ordinal % 7 = r AS pc, ordinal % 11 = r AS oc FROM gt, (VALUES (0), (1), (2)) x(r)),
c AS (SELECT ordinal, r, CASE WHEN p = '' OR o = '' THEN NULL WHEN pc THEN o WHEN oc THEN p WHEN p = o THEN p END AS v FROM t)
SELECT ordinal, coalesce(arg_min(v, r) FILTER (v IS NOT NULL), 'split') AS verdict, CAST(coalesce(min(r) FILTER (v IS NOT NULL) + 1, 3) AS INT) AS rounds, CASE WHEN count(v) = 0 THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END AS penalty FROM c GROUP BY ordinal""", "gt")
def debate_consensus(spark, d):
    """Turns of three rounds as rows: the first round on which both sides agree decides, else the finding is split."""
    f = findings(spark, d, "verifier_verdict", "deep_verdict").withColumn("r", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    v = W.consensus(F.col("verifier_verdict"), F.col("deep_verdict"), F.col("ordinal") % 7 == F.col("r"), F.col("ordinal") % 11 == F.col("r"))
    got = f.select("ordinal", "r", v.alias("v")).groupBy("ordinal").agg(F.min_by("v", F.when(F.col("v").isNotNull(), F.col("r"))).alias("v"), F.min(F.when(F.col("v").isNotNull(), F.col("r"))).alias("r"))
    return got.select("ordinal", F.coalesce("v", F.lit("split")).alias("verdict"), F.coalesce(F.col("r") + 1, F.lit(3)).alias("rounds"), F.when(F.col("v").isNull(), 0.7).otherwise(1.0).alias("penalty"))


_TEST = r"regexp_matches(lower(replace(file, chr(92), '/')), '(_test\.go|\.(test|spec)\.(js|ts))$|/(test|tests|fixtures|__tests__)/') OR (lower(string_split(replace(file, chr(92), '/'), '/')[-1]) LIKE 'test!_%' ESCAPE '!' AND lower(file) LIKE '%.py')"
_CONF = f""", s AS (SELECT *, verified AND NOT false_positive AND lower(trim(verifier_verdict)) IN ('true_positive', 'tp', 'confirmed', 'true') AS bv, lower(trim(deep_verdict)) = 'confirmed' AS bd, {_TEST} AS lowered,
  CASE lower(trim(confidence)) WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'med' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS c FROM gt),
u AS (SELECT *, greatest(c, CASE WHEN bv OR bd THEN 3 WHEN coalesce(len(trace), 0) > 0 OR severity IN ('critical', 'high') THEN 2 ELSE 0 END) AS st, CASE WHEN bv AND bd THEN 3 WHEN bv OR bd THEN 2 ELSE 0 END AS sg FROM s),
z AS (SELECT ordinal, confidence, CASE CASE WHEN lowered THEN greatest(st - 1, 1, sg) ELSE greatest(st, 1) END WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS resolved FROM u)"""


def _resolved(spark, d):
    f = findings(spark, d, "confidence", "severity", "verified", "false_positive", "verifier_verdict", "deep_verdict", "trace", "file")
    c = F.col
    new = W.resolved_confidence(c("confidence"), c("severity"), c("verified"), c("false_positive"), c("verifier_verdict"), c("deep_verdict"), F.coalesce(F.size("trace"), F.lit(0)) > 0, T.is_test_path(c("file")))
    return f.select("ordinal", "confidence", new.alias("resolved"))


@query(_CONF + " SELECT ordinal, resolved FROM z", "gt")
def resolved_confidence(spark, d):
    return _resolved(spark, d).select("ordinal", "resolved")


@query(_CONF + " SELECT resolved, count(*) AS n, CAST(sum(CASE WHEN resolved <> confidence THEN 1 ELSE 0 END) AS BIGINT) AS changed FROM z GROUP BY resolved", "gt")
def confidence_changes(spark, d):
    return _resolved(spark, d).groupBy("resolved").agg(F.count("*").alias("n"), F.sum((F.col("resolved") != F.col("confidence")).cast("long")).alias("changed"))


@query("""SELECT ordinal, CASE WHEN gd OR sz <> '' THEN CASE severity WHEN 'critical' THEN 'high' WHEN 'high' THEN 'medium' WHEN 'medium' THEN 'low' ELSE severity END ELSE severity END AS severity, CASE WHEN (gd OR sz <> '') AND (lower(confidence) = 'high' OR confidence = '') THEN 'medium' ELSE confidence END AS confidence,
array_to_string(list_filter(tg, lambda x, i: list_position(tg, x) = i), ',') AS tags FROM (SELECT *, list_concat(coalesce(tags, []), list_concat(CASE WHEN gd THEN ['taint-guarded', 'guard:early_return'] ELSE [] END, CASE WHEN sz <> '' THEN ['sanitizer:' || sz] ELSE [] END)) AS tg FROM (SELECT *, ordinal % 3 = 0 AS gd, CASE WHEN ordinal % 5 = 0 THEN 'san-1' ELSE '' END AS sz FROM gt))""", "gt")
def guard_downgrade(spark, d):
    f = findings(spark, d, "severity", "confidence", "tags")
    new = W.guarded(F.col("severity"), F.col("confidence"), F.col("tags"), F.col("ordinal") % 3 == 0, F.lit("early_return"), F.when(F.col("ordinal") % 5 == 0, "san-1").otherwise(""))
    return f.select("ordinal", "severity", "confidence", "tags").select("ordinal", new["severity"].alias("severity"), new["confidence"].alias("confidence"), F.array_join(new["tags"], ",").alias("tags"))


_CP = "round(least(greatest(0.85 - CASE WHEN {h} >= 3 THEN 0.05 * ({h} - 2) ELSE 0 END - CASE WHEN {s} > 0 THEN 0.2 ELSE 0 END + CASE WHEN {r} THEN 0.02 ELSE 0 END, 0.2), 0.99), 9)::DOUBLE"


@query(f"SELECT ordinal, {_CP.format(h='h', s='s', r='r')} AS confidence FROM (SELECT ordinal, ordinal % 19 AS h, ordinal % 3 AS s, ordinal % 2 = 0 AS r FROM gt)", "gt")
def path_confidence(spark, d):
    f = findings(spark, d, "file")
    return f.select("ordinal", F.round(W.path_confidence(F.col("ordinal") % 19, F.col("ordinal") % 3, F.col("ordinal") % 2 == 0), 9).alias("confidence"))


@query("""SELECT ordinal, CASE WHEN h >= 2 THEN greatest(coalesce(len(trace), 0), h) ELSE coalesce(len(trace), 0) END AS hops, round(CASE WHEN h < 2 THEN score WHEN score > 0 THEN least(0.99, score + 0.05) ELSE 0.8 END, 9)::DOUBLE AS score FROM (SELECT *, CAST(ordinal % 5 AS INT) AS h FROM gt)""", "gt")
def path_attached(spark, d):
    """A path found for a finding: the longer of path and trace stays, the score rises a little."""
    f = findings(spark, d, "trace", "score").withColumn("h", (F.col("ordinal") % 5).cast("int"))
    size = F.coalesce(F.size("trace"), F.lit(0))
    score = F.when(F.col("h") < 2, F.col("score")).when(F.col("score") > 0, F.least(F.lit(0.99), F.col("score") + 0.05)).otherwise(0.8)
    return f.select("ordinal", F.when(F.col("h") >= 2, F.greatest(size, "h")).otherwise(size).alias("hops"), F.round(score, 9).alias("score"))


@query("""SELECT ordinal, CASE WHEN lower(trim(severity)) IN ('critical', 'high', 'medium', 'low', 'info') THEN lower(trim(severity)) WHEN lower(trim(severity)) = 'informational' THEN 'info' ELSE '' END AS severity,
CASE WHEN lower(trim(confidence)) IN ('high', 'medium', 'low') THEN lower(trim(confidence)) WHEN lower(trim(confidence)) = 'med' THEN 'medium' ELSE '' END AS confidence, """ + _WORD.format("verifier_verdict") + " AS verdict FROM gt", "gt")
def normal_levels(spark, d):
    f = findings(spark, d, "severity", "confidence", "verifier_verdict")
    return f.select("ordinal", W.severity_name(F.col("severity")).alias("severity"), W.confidence_name(F.col("confidence")).alias("confidence"), W.verdict(F.col("verifier_verdict")).alias("verdict"))


@query("""SELECT ordinal, CASE WHEN id = '' THEN agent || '-' || start_line || '-' || ordinal ELSE id END AS id, start_line + off AS start_line, end_line + off AS end_line, CASE WHEN severity = '' THEN 'medium' ELSE severity END AS severity, CASE WHEN confidence = '' THEN 'medium' ELSE confidence END AS confidence
FROM (SELECT *, CAST(ordinal % 4 AS INT) * 120 AS off FROM v)""", "v")
def rebased_findings(spark, d):
    """Findings of a chunk put back into their file: lines moved by the chunk's offset, missing levels and ids filled."""
    f = findings(spark, d, "id", "agent", "start_line", "end_line", "severity", "confidence")
    off = (F.col("ordinal") % 4).cast("int") * 120
    fill = lambda c: F.when(F.col(c) == "", "medium").otherwise(F.col(c)).alias(c)
    return f.select("ordinal", F.when(F.col("id") == "", F.concat_ws("-", "agent", F.col("start_line").cast("string"), F.col("ordinal").cast("string"))).otherwise(F.col("id")).alias("id"), (F.col("start_line") + off).alias("start_line"), (F.col("end_line") + off).alias("end_line"), fill("severity"), fill("confidence"))


@query("SELECT t AS threshold, coalesce((SELECT max(CASE lower(severity) WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 WHEN 'info' THEN 1 ELSE 0 END) FROM gt WHERE NOT false_positive), 0) >= k AS fails FROM (VALUES ('info', 1), ('low', 2), ('medium', 3), ('high', 4), ('critical', 5)) x(t, k)", "gt")
def severity_gate(spark, d):
    """Whether findings of a severity or above are left, for each threshold: one pass, one maximum."""
    f = findings(spark, d, "severity", "false_positive")
    top = f.agg(F.coalesce(F.max(F.when(~F.col("false_positive"), V.rank(F.lower("severity"), V.SEVERITIES))), F.lit(0)).alias("top"))
    steps = F.array(*(F.struct(F.lit(s).alias("threshold"), F.lit(len(V.SEVERITIES) - i).alias("k")) for i, s in enumerate(V.SEVERITIES)))
    return top.select("top", F.explode(steps).alias("s")).select("s.threshold", (F.col("top") >= F.col("s.k")).alias("fails"))


_SECRET, _UNCLEAR = "contains(lower(rule_id), 'secret') OR contains(lower(agent), 'secret')", "lower(trim({0})) IN ('', 'inconclusive', 'unknown')"
_STAGE = f"CASE WHEN {_SECRET} THEN 'drop_secret' WHEN suppressed THEN 'suppressed' WHEN {_UNCLEAR.format('verifier_verdict')} AND {_UNCLEAR.format('deep_verdict')} THEN 'drop_unconfirmed' WHEN im = 'fail' THEN 'drop_impact_fail' WHEN false_positive OR (score > 0 AND score < 0.3) THEN 'policy' ELSE 'kept' END"


def _stages(spark, d):
    f = findings(spark, d, "gates", "false_positive", "suppressed", "score", "verifier_verdict", "deep_verdict", "rule_id", "agent")
    secret = F.lower("rule_id").contains("secret") | F.lower("agent").contains("secret")
    steps = [
        ("drop_secret", secret), ("suppressed", F.col("suppressed")), ("drop_unconfirmed", W.is_unclear(F.col("verifier_verdict")) & W.is_unclear(F.col("deep_verdict"))),
        ("drop_impact_fail", F.col("gates").isNotNull() & (W.gate(F.col("gates")["impact"]) == "fail")), ("policy", F.col("false_positive") | ((F.col("score") > 0) & (F.col("score") < 0.3))),
    ]
    return f.select("ordinal", "false_positive", joins.first_step(steps).alias("stage"))


@query(f"SELECT ordinal, {_STAGE} AS stage FROM gt", "gt")
def drop_stages(spark, d):
    """The filter that removes a finding, as one expression: no snapshot is compared with another."""
    return _stages(spark, d).select("ordinal", "stage")


@query(f"""SELECT stage, count(*) AS n, CAST(count(*) FILTER (stage = 'policy' AND false_positive) AS BIGINT) AS false_positives FROM (SELECT *, {_STAGE} AS stage FROM gt) GROUP BY stage""", "gt")
def funnel_drops(spark, d):
    return _stages(spark, d).groupBy("stage").agg(F.count("*").alias("n"), F.sum(((F.col("stage") == "policy") & F.col("false_positive")).cast("long")).alias("false_positives"))


@query("""SELECT ordinal FROM gt WHERE NOT suppressed AND NOT false_positive AND (CASE lower(trim(severity)) WHEN 'critical' THEN 5 WHEN 'high' THEN 4 ELSE 0 END >= 4 OR verifier_verdict IN ('inconclusive', 'needs_more_context') OR (gates IS NOT NULL AND outcome IN ('inconclusive', 'unknown')))""", "gt")
def hotspots_or_open(spark, d):
    f = findings(spark, d, "gates", "false_positive", "suppressed", "severity", "verifier_verdict").where(~F.col("suppressed") & ~F.col("false_positive"))
    return f.where((V.severity_rank(F.col("severity")) >= 4) | W.is_open(F.col("verifier_verdict"), F.col("gates"))).select("ordinal")


@query(rf""", q AS (SELECT DISTINCT x.path AS file FROM rec WHERE len(x.calls) >= 3 AND x.path IS NOT NULL), p AS (SELECT ordinal, confidence, score, CASE WHEN {_TEST} THEN 'test fixture file' WHEN file NOT IN (SELECT file FROM q) AND NOT regexp_matches(lower(replace(file, chr(92), '/')), '(main\.go|__main__\.py|manage\.py|app\.py|index\.(js|ts)|server\.js|main\.java|application\.java)$') THEN 'unreachable from any entry point' END AS why FROM v)
SELECT ordinal, CASE WHEN why IS NULL THEN confidence ELSE 'low' END AS confidence, CASE WHEN why IS NULL THEN score ELSE least(score, 0.4) END::DOUBLE AS score, CASE WHEN why IS NULL THEN '' ELSE 'reachability: ' || why END AS fp_reason FROM p""", "v rec")
def reach_downgraded(spark, d):
    """Findings in test files, or in files that no entry reaches, with a low confidence and a capped score."""
    from fernglass.operators import codegraph, rules

    rec = codegraph.records(table(spark, d, "file_asts", "file_id", "path", "imports", "symbols", "calls"))
    reached = rec.where("size(calls) >= 3 AND path IS NOT NULL").select(F.col("path").alias("file"))
    f = findings(spark, d, "file", "confidence", "score")
    low = rules.downgraded(f, reached, "file", T.is_test_path(F.col("file")), T.is_entry_path(F.col("file")))
    why = F.when(F.col("reason") == "test", "test fixture file").when(F.col("reason") == "unreached", "unreachable from any entry point")
    return low.select("ordinal", F.when(why.isNull(), F.col("confidence")).otherwise("low").alias("confidence"), F.when(why.isNull(), F.col("score")).otherwise(F.least("score", F.lit(0.4))).alias("score"), F.coalesce(F.concat(F.lit("reachability: "), why), F.lit("")).alias("fp_reason"))


@query("""SELECT ordinal, CASE WHEN ordinal % 10 < 3 THEN true ELSE false_positive END AS false_positive FROM gt""", "gt")
def keep_list_flags(spark, d):
    """A filter's answer as ids to drop: rows are flagged, not removed."""
    f = findings(spark, d, "false_positive")
    drop = f.where("ordinal % 10 < 3").select("ordinal")
    return joins.flagged(f, drop, "ordinal", "false_positive").select("ordinal", "false_positive")


@query("SELECT ordinal, file, rule_id FROM (SELECT *, row_number() OVER (ORDER BY CASE lower(trim(severity)) WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 WHEN 'info' THEN 1 ELSE 0 END DESC, rule_id, ordinal) AS n FROM gt) WHERE n <= 30", "gt")
def notes_top30(spark, d):
    return findings(spark, d, "file", "rule_id", "severity").orderBy(V.severity_rank(F.col("severity")).desc(), "rule_id", "ordinal").limit(30).select("ordinal", "file", "rule_id")


@query("""SELECT f.file, n, n >= 2 AND chunks >= 2 AS refine FROM (SELECT file, count(*) AS n FROM gt GROUP BY file) f LEFT JOIN (SELECT path, CAST(max((length(content) - length(replace(content, chr(10), ''))) // 120 + 1) AS BIGINT) AS chunks FROM files WHERE content IS NOT NULL GROUP BY path) c ON c.path = f.file WHERE chunks IS NOT NULL""", "gt")
def refine_groups(spark, d):
    """Findings per file, and whether the file was cut into more than one chunk, so that its findings need joining."""
    files = table(spark, d, "files", "path", "content").where("content IS NOT NULL")
    chunks = files.groupBy("path").agg(F.max(F.floor((T.line_count(F.col("content")) - 1) / 120) + 1).alias("chunks"))
    n = findings(spark, d, "file").groupBy("file").agg(F.count("*").alias("n"))
    return n.join(chunks, F.col("file") == F.col("path")).select("file", "n", ((F.col("n") >= 2) & (F.col("chunks") >= 2)).alias("refine"))


@query("""SELECT ordinal, rule_id, agent FROM (SELECT ordinal, rule_id, agent, row_number() OVER (PARTITION BY file ORDER BY CASE lower(trim(severity)) WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 WHEN 'info' THEN 1 ELSE 0 END DESC, CASE lower(trim(confidence)) WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END DESC, start_line, ordinal) AS n FROM gt) WHERE n = 1""", "gt")
def refine_base(spark, d):
    """The finding of a file that joined ones are built on: severity, confidence, then the earliest line."""
    f = findings(spark, d, "file", "rule_id", "agent", "severity", "confidence", "start_line")
    order = [V.severity_rank(F.col("severity")).desc(), V.confidence_rank(F.col("confidence")).desc(), F.asc("start_line"), F.asc("ordinal")]
    return dedup.first_by(f, ["file"], order).select("ordinal", "rule_id", "agent")


@query("""SELECT ordinal, len(list_filter(coalesce(tags, []), lambda x: x LIKE 'A%')) + len(list_filter(coalesce(tags, []), lambda x: x LIKE 'CWE-2%')) > 0 OR trim(verifier_comment) <> '' AS feedback FROM gt""", "gt")
def critique_feedback(spark, d):
    f = findings(spark, d, "tags", "verifier_comment")
    part = lambda p: F.filter("tags", lambda x: x.startswith(p))
    return f.select("ordinal", W.has_feedback(part("A"), part("CWE-2"), notes=F.col("verifier_comment")).alias("feedback"))
