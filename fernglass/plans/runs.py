"""Queries over what a run puts together: plans, scanners, answers, groups, contexts; and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fernglass.functions import findings as V
from fernglass.functions import text as T
from fernglass.functions import verdicts as W
from fernglass.operators import codegraph, dedup, joins, retrieval, windows
from fernglass.plans import verdicts as _verdicts  # noqa: F401 its views are built on
from fernglass.plans.catalogue import SQL, findings, query
from fernglass.plans.code import contents, records
from fernglass.sources.tables import table

_GROUPED = SQL["root_cause_groups"]


@query(_GROUPED.replace("SELECT first(ordinal ORDER BY", "SELECT sha256(string_agg(file || ':' || start_line || '-' || end_line, ',' ORDER BY sr DESC, cr DESC, score DESC, false_positive, file, start_line, ordinal)) AS occurrences, first(ordinal ORDER BY").replace("basis, count(*) AS n, count(DISTINCT file) AS files FROM g", "count(*) AS n FROM g"))
def root_cause_occurrences(spark, d):
    """The places of each root cause in canonical order. A group's places are its result; they are gathered once, after grouping."""
    f = findings(spark, d, "rule_id", "title", "description", "severity", "confidence", "file", "start_line", "end_line", "code_sample", "agent", "false_positive", "score", "trace")
    basis, sig = V.group_key(F.col("trace"), F.col("code_sample"), F.col("description"))
    head = [T.fold(F.when(F.trim("rule_id") == "", F.col("title")).otherwise(F.col("rule_id"))), T.fold(F.col("agent")), T.fold(F.col("title"))]
    place = F.concat(F.col("file"), F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    order = F.struct((-V.severity_rank(F.col("severity"))).alias("a"), (-V.confidence_rank(F.col("confidence"))).alias("b"), (-F.col("score")).alias("c"), "false_positive", "file", "start_line", "ordinal", place.alias("place"))
    keyed = f.select("ordinal", F.concat_ws("\x00", basis, F.sha2(F.concat_ws("\x00", *head, sig), 256)).alias("key"), order.alias("o"))
    grouped = keyed.groupBy("key").agg(F.array_sort(F.collect_list("o")).alias("os"))
    return grouped.select(F.sha2(F.array_join(F.transform("os", lambda o: o["place"]), ","), 256).alias("occurrences"), F.col("os")[0]["ordinal"].alias("primary_id"), F.size("os").cast("long").alias("n"))


FOCUS, BUILT_IN = ("injection", "auth", "crypto"), ("generic", "injection", "auth", "ssrf", "memory-safety")


@query(f"SELECT name FROM (SELECT unnest({list(BUILT_IN)}) AS name UNION SELECT agent FROM agents WHERE model = 'sonar-l' UNION SELECT 'iac-docker' WHERE EXISTS (SELECT 1 FROM files WHERE path LIKE '%.dockerfile')) WHERE name IN (SELECT agent FROM agents WHERE trust >= 50) AND name IN {FOCUS}")
def enabled_scanners(spark, d):
    """Built-in scanners, those of a table, and one that a kind of file asks for; of these the enabled ones in focus, generic if none is."""
    agents = table(spark, d, "agents", "agent", "trust", "model")
    infra = table(spark, d, "files", "path").where("path LIKE '%.dockerfile'").limit(1).select(F.lit("iac-docker"))
    some = spark.createDataFrame([(x,) for x in BUILT_IN], "name string").union(agents.where("model = 'sonar-l'").select("agent")).union(infra).distinct()
    return joins.in_all(some, [agents.where("trust >= 50").select(F.col("agent").alias("name")), spark.createDataFrame([(x,) for x in FOCUS], "name string")], "name", "generic")


@query("SELECT repo, n, CASE WHEN n >= 50 AND k < 3 THEN 'all' ELSE 'focus' END AS scope FROM (SELECT repo, count(*) AS n, count(DISTINCT language) FILTER (language IN ('go', 'sql')) AS k FROM files WHERE repo IS NOT NULL GROUP BY repo)")
def plan_scope(spark, d):
    """Projects of fifty files and more whose plan names fewer than three classes are scanned for all."""
    f = table(spark, d, "files", "repo", "language").where("repo IS NOT NULL")
    g = f.groupBy("repo").agg(F.count("*").alias("n"), F.countDistinct(F.when(F.col("language").isin("go", "sql"), F.col("language"))).alias("k"))
    return g.select("repo", "n", F.when((F.col("n") >= 50) & (F.col("k") < 3), "all").otherwise("focus").alias("scope"))


@query("SELECT ordinal, CASE WHEN ordinal % 4 = 0 THEN 'medium' ELSE severity END AS severity, ordinal % 4 = 0 AS answered FROM v", "v")
def answers_applied(spark, d):
    """Recorded answers put onto their findings; findings without one keep what they have, and all keep their place."""
    f = findings(spark, d, "severity")
    answers = f.where("ordinal % 4 = 0").select("ordinal", F.lit("medium").alias("severity"))
    return joins.overridden(f, answers, "ordinal", ["severity"], "answered").select("ordinal", "severity", "answered")


@query("""SELECT first(ordinal ORDER BY sr DESC, cr DESC, start_line, ordinal) AS base, CASE WHEN hash < 50 THEN 'joined' ELSE first(title ORDER BY sr DESC, cr DESC, start_line, ordinal) END AS title, count(*) AS n FROM (SELECT *, length(file) % 100 AS hash FROM r) GROUP BY file, hash""", "v r")
def joined_findings(spark, d):
    """Findings of a file as one: the best of them is the base, a decision's own values go over its."""
    f = findings(spark, d, "file", "title", "severity", "confidence", "start_line")
    order = F.struct(-V.severity_rank(F.col("severity")), -V.confidence_rank(F.col("confidence")), "start_line", "ordinal")
    g = f.groupBy("file").agg(F.min_by(F.struct("ordinal", "title"), order).alias("b"), F.count("*").alias("n"))
    own = F.when(F.length("file") % 100 < 50, F.lit("joined"))
    return g.select(F.col("b.ordinal").alias("base"), F.coalesce(own, "b.title").alias("title"), "n")


@query("SELECT ordinal AS primary_id, file, 1 AS n, 'location' AS basis FROM v WHERE NOT suppressed", "v")
def default_groups(spark, d):
    """Where a report has no groups, each finding is one."""
    return findings(spark, d, "file", "suppressed").where("NOT suppressed").select(F.col("ordinal").alias("primary_id"), "file", F.lit(1).alias("n"), F.lit("location").alias("basis"))


@query("SELECT stage, count(*) AS n FROM (SELECT unnest(CASE WHEN verified THEN ['verified', 'final'] ELSE ['final'] END) AS stage FROM v WHERE NOT false_positive) GROUP BY stage", "v")
def final_set_counts(spark, d):
    """The counts of the stages that the final set is picked from: the filter's where it ran, else the verifier's."""
    f = findings(spark, d, "verified", "false_positive").where("NOT false_positive")
    return f.select(F.explode(F.when(F.col("verified"), F.array(F.lit("verified"), F.lit("final"))).otherwise(F.array(F.lit("final")))).alias("stage")).groupBy("stage").agg(F.count("*").alias("n"))


@query("SELECT c.file_id, c.call_no, coalesce(h.ordinal, n.ordinal) AS ordinal FROM (SELECT file_id, call_no, regexp_extract(trim(regexp_replace(callee, '[\\[(].*$', '')), '([^.:>\\-]*)$', 1) AS name FROM cal) c LEFT JOIN (SELECT file_id, ordinal FROM sym WHERE kind = 'class' AND ordinal = 0) h ON h.file_id = c.file_id AND c.call_no % 5 = 0 LEFT JOIN (SELECT file_id, name, min(ordinal) AS ordinal FROM sym WHERE name IS NOT NULL GROUP BY file_id, name) n ON n.file_id = c.file_id AND n.name = c.name WHERE coalesce(h.ordinal, n.ordinal) IS NOT NULL", "rec sym cal")
def hinted_callees(spark, d):
    """The callee that a hint names, if it is there, else the first of that name."""
    rec = records(spark, d)
    s = codegraph.symbols(rec)
    c = codegraph.calls(rec).select("file_id", "call_no", T.last_segment(F.col("callee")).alias("name"), F.when(F.col("call_no") % 5 == 0, 0).alias("hint"))
    hints = s.where("kind = 'class' AND ordinal = 0").select("file_id", F.col("ordinal").alias("hint"), F.col("ordinal").alias("hinted"))
    named = s.where("name IS NOT NULL").groupBy("file_id", "name").agg(F.min("ordinal").alias("named"))
    got = c.join(hints, ["file_id", "hint"], "left").join(named, ["file_id", "name"], "left")
    return got.select("file_id", "call_no", F.coalesce("hinted", "named").cast("long").alias("ordinal")).where("ordinal IS NOT NULL")


@query(r"""SELECT file_id, CAST(i AS BIGINT) AS line_no, array_to_string(ls[greatest(i - 1, 1) : i + 2], chr(10)) AS lines FROM (SELECT file_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT file_id, string_split(content, chr(10)) AS ls FROM files WHERE content IS NOT NULL)) WHERE regexp_matches(ls[i], '^\s*(def|func|function|class)\s+(load|fetch|publish)\w*')""")
def definitions_by_pattern(spark, d):
    """Definitions found by pattern where no parse helps, with the lines around them."""
    return windows.around_matches(contents(spark, d), "file_id", "content", r"^\s*(def|func|function|class)\s+(load|fetch|publish)\w*", 1, 2)


@query("""SELECT f.file_id, sha256(coalesce(p.t, '') || chr(10) || coalesce(x.t, '')) AS context FROM files f LEFT JOIN (SELECT file, string_agg(finding_id, ',' ORDER BY finding_id) AS t FROM findings WHERE verified GROUP BY file) p ON p.file = f.path LEFT JOIN (SELECT lang, min(doc_id)::VARCHAR AS t FROM documents GROUP BY lang) x ON x.lang = CASE WHEN f.language = 'go' THEN 'en' WHEN f.language = 'python' THEN 'de' END WHERE f.content IS NOT NULL""")
def chunk_contexts(spark, d):
    """The context of each chunk: what its pack holds, then its examples, either empty where there is none."""
    packs_ = table(spark, d, "findings", "file", "finding_id", "verified").where("verified").groupBy(F.col("file").alias("path")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("finding_id")), lambda x: x.cast("string")), ",").alias("pack"))
    examples = table(spark, d, "documents", "lang", "doc_id").where("lang IS NOT NULL").groupBy("lang").agg(F.min("doc_id").cast("string").alias("example"))
    f = contents(spark, d, "path", "language").withColumn("lang", F.when(F.col("language") == "go", "en").when(F.col("language") == "python", "de"))
    got = f.select("file_id", "path", "lang").join(packs_, "path", "left").join(examples, "lang", "left")
    return got.select("file_id", F.sha2(F.concat(F.coalesce("pack", F.lit("")), F.lit("\n"), F.coalesce("example", F.lit(""))), 256).alias("context"))


@query("""SELECT query, id, rank FROM (SELECT q.vec_id AS query, e.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 12) DESC, e.vec_id) AS rank FROM embeddings e CROSS JOIN (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q WHERE e.vec_id // 10 <> q.vec_id // 10) WHERE rank <= 4""")
def similar_outside(spark, d):
    """The rows most similar to each query that are not of its own chunk. A chunk has at most ten rows, so ten more are asked for."""
    e = table(spark, d, "embeddings", "vec_id", "embedding")
    got = retrieval.cosine_topk(e, e.where("vec_id % 100 = 0"), 14)
    other = got.where(F.floor(F.col("query") / 10) != F.floor(F.col("id") / 10)).select("query", "id", F.col("rank").alias("at"))
    return dedup.top_per_group(other, ["query"], [F.asc("at")], 4).select("query", "id", F.col("rank").cast("long").alias("rank"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS stamp FROM events")
def call_stamps(spark, d):
    e = table(spark, d, "events", "event_id", "ts")
    return e.select("event_id", F.concat(F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")).alias("stamp"))


@query("SELECT ordinal, CASE WHEN outcome IN ('confirmed', 'defense_in_depth') THEN 'done' WHEN outcome LIKE 'refuted%' THEN 'done' WHEN lower(trim(deep_verdict)) IN ('confirmed', 'refuted') THEN 'deep' WHEN lower(trim(verifier_verdict)) IN ('true_positive', 'tp', 'false_positive', 'fp') THEN 'debate' ELSE 'open' END AS state FROM gt", "gt")
def review_states(spark, d):
    """How far each finding's review has come, as one expression: its graph of states has no cycle."""
    f = findings(spark, d, "gates", "deep_verdict", "verifier_verdict")
    outcome = W.gate_outcome(F.col("gates"))
    done = outcome.isin("confirmed", "defense_in_depth") | outcome.startswith("refuted")
    state = F.when(done, "done").when(W.folded(F.col("deep_verdict")).isin("confirmed", "refuted"), "deep").when(W.folded(F.col("verifier_verdict")).isin("true_positive", "tp", "false_positive", "fp"), "debate").otherwise("open")
    return f.select("ordinal", state.alias("state"))
