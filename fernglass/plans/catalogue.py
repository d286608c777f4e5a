"""The registered queries over the core operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernglass.functions import findings as V
from fernglass.functions import text as T
from fernglass.operators import codegraph, dedup, evaluate, graph, joins, retrieval, rules, sequential, windows
from fernglass.session import materialize
from fernglass.sources import sinks
from fernglass.sources.tables import table
from fernglass.streaming.windows import collected_windows, usage_windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Views that the SQL builds on.
WITH = {
    "v": """v AS (SELECT finding_id AS ordinal, run_idx, coalesce(id,'') AS id, coalesce(rule_id,'') AS rule_id, coalesce(title,'') AS title, coalesce(description,'') AS description,
  coalesce(severity,'') AS severity, coalesce(confidence,'') AS confidence, coalesce(cwe,'') AS cwe, coalesce(file,'') AS file, start_line, end_line, coalesce(code_sample,'') AS code_sample, coalesce(agent,'') AS agent,
  coalesce(verified,false) AS verified, coalesce(false_positive,false) AS false_positive, coalesce(score,0) AS score, coalesce(suppressed,false) AS suppressed, tags, trace, created_at FROM findings)""",
    "r": """r AS (SELECT *, CASE lower(trim(severity)) WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 WHEN 'info' THEN 1 ELSE 0 END AS sr,
  CASE lower(trim(confidence)) WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS cr FROM v)""",
    "calls": """calls AS (SELECT event_id, ts, event_type AS stage, CASE user_id % 3 WHEN 0 THEN 'm-a' WHEN 1 THEN 'm-b' ELSE 'm-c' END AS model, CAST(floor(value * 10) AS BIGINT) AS tokens_in,
  event_id % 500 AS tokens_out, event_id % 1000 AS latency_ms, event_type <> 'error' AS ok FROM events)""",
    "edges": """edges AS (SELECT p_partkey AS src, (p_partkey * 7 + 3) % (SELECT count(*) FROM part) + 1 AS dst FROM part UNION ALL
  SELECT p_partkey, (p_partkey * 13 + 5) % (SELECT count(*) FROM part) + 1 FROM part WHERE p_size <= 25)""",
    "dag": "dag AS (SELECT DISTINCT src, dst FROM edges WHERE src < dst)",
    "rec": """rec AS (SELECT file_id, arg_max({'path': path, 'imports': imports, 'symbols': symbols, 'calls': calls}, (coalesce(len(symbols),0) + coalesce(len(calls),0)) * 100000 + coalesce(len(imports),0)) AS x FROM file_asts GROUP BY file_id)""",
    "sym": "sym AS (SELECT file_id, i - 1 AS ordinal, s.kind AS kind, s.name AS name, s.start_line AS start_line, s.end_line AS end_line FROM (SELECT file_id, unnest(x.symbols) AS s, unnest(range(1, len(x.symbols) + 1)) AS i FROM rec))",
    "cal": "cal AS (SELECT file_id, i - 1 AS call_no, c.callee AS callee, c.line AS line FROM (SELECT file_id, unnest(x.calls) AS c, unnest(range(1, len(x.calls) + 1)) AS i FROM rec))",
    "frag": """frag AS (SELECT l_orderkey * 10 + l_linenumber AS ordinal, l_suppkey AS chunk_id, l_partkey % 50 AS file_id, l_linenumber * 400 + CAST(l_quantity AS INT) * 8 AS start_line,
  l_linenumber * 400 + CAST(l_quantity AS INT) * 8 + CAST(l_orderkey % 15 AS INT) AS end_line, l_linenumber AS priority, CAST(floor(l_extendedprice) AS BIGINT) % 900 + 1 AS tokens FROM lineitem)""",
}
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def sq(x: str) -> str:
    """SQL of text.squeeze."""
    return f"trim(regexp_replace(replace({x}, chr(13), ''), '{SPACE}', ' ', 'g'))"


def query(sql: str | None = None, views: str = "", recursive: bool = False):
    """Registers a query, and its SQL behind the views it names."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            parts = [WITH[v] for v in views.split()]
            SQL[f.__name__] = f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {sql}" if parts else sql
        return f

    return add


def findings(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """Normalised findings, only the columns needed."""
    cols = cols or ("id", "run_idx", "rule_id", "title", "severity", "confidence", "file", "start_line", "end_line", "agent", "false_positive", "score", "suppressed")
    return V.normalised(table(spark, d, "findings", "finding_id", *cols))


def calls(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_id", "ts", "event_type", "user_id", "value")
    model = F.when(F.col("user_id") % 3 == 0, "m-a").when(F.col("user_id") % 3 == 1, "m-b").otherwise("m-c")
    return e.select("event_id", "ts", F.col("event_type").alias("stage"), model.alias("model"), F.floor(F.col("value") * 10).cast("long").alias("tokens_in"), (F.col("event_id") % 500).alias("tokens_out"), (F.col("event_id") % 1000).alias("latency_ms"), (F.col("event_type") != "error").alias("ok"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part", "p_partkey", "p_size")
    n = F.lit(p.count())
    one = p.select(F.col("p_partkey").alias("src"), ((F.col("p_partkey") * 7 + 3) % n + 1).alias("dst"))
    return one.union(p.where("p_size <= 25").select("p_partkey", (F.col("p_partkey") * 13 + 5) % n + 1))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part", "p_partkey").toDF("node")


def fragments(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity").cast("int") * 8 + F.col("l_linenumber") * 400
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice")
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"), F.col("l_suppkey").alias("chunk_id"), (F.col("l_partkey") % 50).alias("file_id"), q.alias("start_line"), (q + (F.col("l_orderkey") % 15).cast("int")).alias("end_line"), F.col("l_linenumber").alias("priority"), (F.floor("l_extendedprice").cast("long") % 900 + 1).alias("tokens"))


USAGE = "count(*) AS calls, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) AS BIGINT) AS errors, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, CAST(sum(latency_ms) AS BIGINT) // count(*) AS avg_latency"


def usage() -> list:
    n = F.count("*")
    return [n.alias("calls"), F.sum((~F.col("ok")).cast("long")).alias("errors"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.floor(F.sum("latency_ms") / n).alias("avg_latency")]


@query(f"SELECT stage, model, {USAGE} FROM calls GROUP BY stage, model", "calls")
def usage_by_stage_model(spark, d):
    return calls(spark, d).groupBy("stage", "model").agg(*usage())


@query(f"SELECT stage, model, {USAGE} FROM calls GROUP BY ROLLUP (stage, model)", "calls")
def usage_totals(spark, d):
    return calls(spark, d).rollup("stage", "model").agg(*usage())


@query("SELECT stage, model, calls, coalesce(r.weight, 1.0) AS weight FROM (SELECT stage, model, count(*) AS calls FROM calls GROUP BY stage, model) LEFT JOIN (SELECT 'm-a' AS model, 3.0::DOUBLE AS weight) r USING (model)", "calls")
def lookup_with_default(spark, d):
    rates = spark.createDataFrame([("m-a", 3.0), ("default", 1.0)], "model string, weight double")
    return joins.with_default(calls(spark, d).groupBy("stage", "model").agg(F.count("*").alias("calls")), rates, "model", ["weight"])


@query("SELECT date_trunc('hour', ts) AS start, stage, model, count(*) AS calls, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) AS BIGINT) AS errors, CAST(sum(tokens_in) AS BIGINT) AS tokens_in FROM calls GROUP BY ALL", "calls")
def usage_windows_batch(spark, d):
    return usage_windows(calls(spark, d))


@query(SQL["usage_windows_batch"])
def usage_windows_stream(spark, d):
    """The same windows from a stream of the events' file, ended when all of it is read."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(d)
    model = F.when(F.col("user_id") % 3 == 0, "m-a").when(F.col("user_id") % 3 == 1, "m-b").otherwise("m-c")
    log = raw.select("ts", F.col("event_type").alias("stage"), model.alias("model"), F.floor(F.col("value") * 10).cast("long").alias("tokens_in"), (F.col("event_type") != "error").alias("ok"))
    return collected_windows(usage_windows(log.withColumn("ts", F.col("ts").cast("timestamp"))), ["start", "stage", "model"])


@query("SELECT * EXCLUDE (rn) FROM (SELECT ordinal, agent, file, start_line, end_line, title, row_number() OVER (PARTITION BY agent, file, start_line, end_line, title ORDER BY ordinal) AS rn FROM v) WHERE rn = 1", "v")
def dedup_first(spark, d):
    keys = ["agent", "file", "start_line", "end_line", "title"]
    return dedup.first_by(findings(spark, d, *keys), keys, [F.asc("ordinal")])


@query("SELECT ordinal, agent, file, start_line, end_line, rule_id, place FROM (SELECT *, row_number() OVER (PARTITION BY agent, file, start_line, end_line, rule_id ORDER BY sr * 10 + cr DESC, ordinal) AS rn, min(ordinal) OVER (PARTITION BY agent, file, start_line, end_line, rule_id) AS place FROM r) WHERE rn = 1", "v r")
def dedup_best_rank(spark, d):
    keys = ["agent", "file", "start_line", "end_line", "rule_id"]
    rank = V.severity_rank(F.col("severity")) * 10 + V.confidence_rank(F.col("confidence"))
    return dedup.best_keeps_place(findings(spark, d, *keys, "severity", "confidence"), keys, rank).select("ordinal", *keys, "place")


@query("""SELECT ordinal, votes, total, round(CASE WHEN score = 0 THEN 0.5 ELSE score END * votes / total, 9) AS voted_score FROM (
SELECT *, count(DISTINCT run_idx) OVER w AS votes, row_number() OVER (w ORDER BY run_idx, ordinal) AS rn, (SELECT count(DISTINCT run_idx) FROM findings) AS total FROM v WINDOW w AS (PARTITION BY rule_id, agent, file, start_line // 5)) WHERE rn = 1 AND votes >= 2""".replace("count(DISTINCT run_idx) OVER w AS votes", "len(list_distinct(list(run_idx) OVER w)) AS votes").replace("OVER (w ORDER BY", "OVER (PARTITION BY rule_id, agent, file, start_line // 5 ORDER BY"), "v")
def vote_n_of_k(spark, d):
    f = findings(spark, d, "run_idx", "rule_id", "agent", "file", "start_line", "score")
    voted = dedup.vote(f, 2, [F.col("rule_id"), F.col("agent"), F.col("file"), F.floor(F.col("start_line") / 5)])
    return voted.select("ordinal", "votes", "total", F.round("voted_score", 9).alias("voted_score"))


@query("SELECT 'severity' AS \"column\", severity AS value, count(*) AS n FROM v GROUP BY severity UNION ALL SELECT 'agent', agent, count(*) FROM v GROUP BY agent", "v")
def histogram_severity_agent(spark, d):
    return dedup.histograms(findings(spark, d, "severity", "agent"), "severity", "agent")


@query("SELECT ordinal, sr, cr, score, file, start_line FROM r ORDER BY sr DESC, cr DESC, score DESC, false_positive, file, start_line, ordinal LIMIT 20", "v r")
def canonical_order_top20(spark, d):
    top = findings(spark, d).orderBy(*V.canonical_order()).limit(20)
    return top.select("ordinal", V.severity_rank(F.col("severity")).alias("sr"), V.confidence_rank(F.col("confidence")).alias("cr"), "score", "file", "start_line")


@query("SELECT ordinal, file, start_line FROM r WHERE NOT suppressed AND NOT false_positive AND sr >= 4 ORDER BY sr DESC, file, start_line, ordinal LIMIT 20", "v r")
def hotspots_top20(spark, d):
    f = findings(spark, d).where(~F.col("suppressed") & ~F.col("false_positive") & (V.severity_rank(F.col("severity")) >= 4))
    return f.orderBy(V.severity_rank(F.col("severity")).desc(), "file", "start_line", "ordinal").limit(20).select("ordinal", "file", "start_line")


FOLD = lambda x: f"lower({sq(x)})"
HOP = lambda h: f"coalesce({FOLD(f'coalesce({h}.kind, {chr(39)}{chr(39)})')} || ':' || replace({FOLD(f'coalesce({h}.code, {chr(39)}{chr(39)})')}, ' ', ''), '')"


@query(f""", k AS (SELECT *, CASE WHEN coalesce(len(trace), 0) = 0 THEN '' ELSE {HOP("src")} || '|' || {HOP("snk")} END AS t, replace({FOLD("code_sample")}, ' ', '') AS c,
  CASE WHEN strlen({FOLD("description")}) >= 32 AND len(string_split({FOLD("description")}, ' ')) >= 4 THEN {FOLD("description")} ELSE '' END AS ds
  FROM (SELECT *, coalesce(list_filter(trace, lambda h: lower(h.kind) = 'source')[1], trace[1]) AS src, coalesce(list_filter(trace, lambda h: lower(h.kind) = 'sink')[-1], trace[-1]) AS snk FROM r)),
g AS (SELECT *, CASE WHEN t <> '' THEN 'trace' WHEN c <> '' THEN 'code_sample' WHEN ds <> '' THEN 'description' ELSE 'location' END AS basis,
  CASE WHEN t <> '' THEN t WHEN c <> '' THEN c WHEN ds <> '' THEN ds ELSE file || '|' || start_line || '|' || end_line END AS sig, {FOLD("CASE WHEN trim(rule_id) = '' THEN title ELSE rule_id END")} AS hr, {FOLD("agent")} AS ha, {FOLD("title")} AS ht FROM k)
SELECT first(ordinal ORDER BY sr DESC, cr DESC, score DESC, false_positive, file, start_line, ordinal) AS primary_id, basis, count(*) AS n, count(DISTINCT file) AS files FROM g GROUP BY hr, ha, ht, basis, sig""", "v r")
def root_cause_groups(spark, d):
    f = findings(spark, d, "rule_id", "title", "description", "severity", "confidence", "file", "start_line", "end_line", "code_sample", "agent", "false_positive", "score", "trace")
    basis, sig = V.group_key(F.col("trace"), F.col("code_sample"), F.col("description"))
    head = [T.fold(F.when(F.trim("rule_id") == "", F.col("title")).otherwise(F.col("rule_id"))), T.fold(F.col("agent")), T.fold(F.col("title"))]
    order = F.struct(-V.severity_rank(F.col("severity")), -V.confidence_rank(F.col("confidence")), -F.col("score"), "false_positive", "file", "start_line", "ordinal")
    keyed = f.select("ordinal", "file", basis.alias("basis"), F.sha2(F.concat_ws("\x00", *head, sig), 256).alias("key"), order.alias("o"))
    return keyed.groupBy("basis", "key").agg(F.min_by("ordinal", "o").alias("primary_id"), F.count("*").alias("n"), F.countDistinct("file").alias("files")).drop("key")


JSON = {k: f"coalesce(json_extract_string(finding_json, '$.{k}'), '')" for k in ("rule_id", "agent", "file", "code_sample", "description")}


@query(f"""SELECT ordinal, substr(sha256(rule_id || '|' || agent || '|' || file || '|' || CASE WHEN {sq("code_sample")} <> '' THEN {sq("code_sample")} ELSE {sq("description")} END), 1, 16) AS fingerprint FROM v""", "v")
def fingerprints(spark, d):
    c = F.col
    return findings(spark, d, "rule_id", "agent", "file", "code_sample", "description").select("ordinal", T.fingerprint(c("rule_id"), c("agent"), c("file"), c("code_sample"), c("description")).alias("fingerprint"))


@query(f"""SELECT entry_id FROM baseline WHERE batch_no >= 1 AND fingerprint IS NOT NULL AND fingerprint NOT IN (SELECT fingerprint FROM baseline WHERE batch_no = 0 AND fingerprint IS NOT NULL)""")
def baseline_new(spark, d):
    b = table(spark, d, "baseline", "entry_id", "batch_no", "fingerprint").where("fingerprint IS NOT NULL")
    return b.where("batch_no >= 1").join(b.where("batch_no = 0").select("fingerprint"), "fingerprint", "left_anti").select("entry_id")


@query(f"""SELECT batch_no, count(*) AS n, CAST(sum(CASE WHEN fingerprint = substr(sha256({JSON['rule_id']} || '|' || {JSON['agent']} || '|' || {JSON['file']} || '|' || CASE WHEN {sq(JSON['code_sample'])} <> '' THEN {sq(JSON['code_sample'])} ELSE {sq(JSON['description'])} END), 1, 16) THEN 1 ELSE 0 END) AS BIGINT) AS same FROM baseline GROUP BY batch_no""")
def baseline_fingerprint_check(spark, d):
    b = table(spark, d, "baseline", "batch_no", "fingerprint", "finding_json")
    j = b.select("batch_no", "fingerprint", F.from_json("finding_json", "rule_id string, agent string, file string, code_sample string, description string").alias("j"))
    fp = T.fingerprint(F.col("j.rule_id"), F.col("j.agent"), F.col("j.file"), F.col("j.code_sample"), F.col("j.description"))
    return j.groupBy("batch_no").agg(F.count("*").alias("n"), F.sum(F.coalesce((F.col("fingerprint") == fp).cast("long"), F.lit(0))).alias("same"))


MARKERS = "m AS (SELECT ordinal, file, start_line - CAST(ordinal % 2 AS INT) AS line, CASE ordinal % 3 WHEN 0 THEN '*' WHEN 1 THEN rule_id ELSE agent END AS rule FROM v WHERE false_positive)"


@query(f""", {MARKERS} SELECT v.ordinal, min(m.ordinal) AS marker FROM v JOIN m ON m.file = v.file AND v.start_line BETWEEN m.line AND m.line + 1 AND (m.rule = '*' OR m.rule = v.rule_id OR m.rule = v.agent) GROUP BY v.ordinal""", "v")
def suppress_first_match(spark, d):
    f = findings(spark, d, "rule_id", "agent", "file", "start_line", "false_positive")
    rule = F.when(F.col("ordinal") % 3 == 0, "*").when(F.col("ordinal") % 3 == 1, F.col("rule_id")).otherwise(F.col("agent"))
    m = f.where("false_positive").select("ordinal", "file", (F.col("start_line") - (F.col("ordinal") % 2).cast("int")).alias("lo"), rule.alias("rule")).withColumn("hi", F.col("lo") + 1)
    where = (F.col("r.rule") == "*") | (F.col("r.rule") == F.col("l.rule_id")) | (F.col("r.rule") == F.col("l.agent"))
    got = joins.range_first_match(f, m, ["file"], ("start_line", "start_line"), ("lo", "hi"), "ordinal", where=where)
    return got.select("ordinal", F.col("match.ordinal").alias("marker"))


TRACES = "t AS (SELECT ordinal, file, start_line + CAST(ordinal % 5 AS INT) - 2 AS sink FROM v WHERE verified)"


@query(f""", {TRACES} SELECT v.ordinal, min(t.ordinal) AS trace_id FROM v JOIN t ON t.file = v.file AND t.sink BETWEEN v.start_line - 2 AND v.end_line + 2 GROUP BY v.ordinal""", "v")
def trace_first_match(spark, d):
    f = findings(spark, d, "file", "start_line", "end_line", "verified")
    t = f.where("verified").select("ordinal", "file", (F.col("start_line") + (F.col("ordinal") % 5).cast("int") - 2).alias("sink"))
    left = f.withColumn("lo", F.col("start_line") - 2).withColumn("hi", F.col("end_line") + 2)
    return joins.range_first_match(left, t, ["file"], ("lo", "hi"), ("sink", "sink"), "ordinal").select("ordinal", F.col("match.ordinal").alias("trace_id"))


@query(f""", {TRACES} SELECT ordinal, arg_min(trace_id, pass * 10000000000 + trace_id) AS trace_id, min(pass) AS pass FROM (
SELECT v.ordinal, t.ordinal AS trace_id, CASE WHEN t.sink BETWEEN v.start_line - 2 AND v.end_line + 2 THEN 1 WHEN t.sink BETWEEN v.start_line - 50 AND v.end_line + 50 THEN 2 ELSE 3 END AS pass FROM v JOIN t ON t.file = v.file) GROUP BY ordinal""", "v")
def path_three_pass_match(spark, d):
    """The nearest kind of match first: one range join at the widest tolerance keeps the best of pass and order, what it leaves takes a file's first path."""
    f = findings(spark, d, "file", "start_line", "end_line", "verified")
    t = f.where("verified").select("ordinal", "file", (F.col("start_line") + (F.col("ordinal") % 5).cast("int") - 2).alias("sink"))
    left = f.select("ordinal", "file", "start_line", "end_line")
    near = left.withColumn("lo", F.col("start_line") - 50).withColumn("hi", F.col("end_line") + 50)
    close = F.col("r.sink").between(F.col("l.start_line") - 2, F.col("l.end_line") + 2)
    rank = F.struct(F.when(close, 1).otherwise(2).alias("pass"), F.col("r.ordinal").alias("trace_id"))
    got = joins.range_first_match(near, t, ["file"], ("lo", "hi"), ("sink", "sink"), "ordinal", rank=rank).select("ordinal", "rank.trace_id", "rank.pass")
    got = materialize(got, "near")
    rest = left.join(got.select("ordinal"), "ordinal", "left_anti").join(t.groupBy("file").agg(F.min("ordinal").alias("trace_id")), "file").select("ordinal", "trace_id", F.lit(3).alias("pass"))
    return got.union(rest)


@query("""SELECT ordinal, CASE WHEN false_positive THEN 'filter' WHEN suppressed THEN 'suppress' ELSE 'policy' END AS stage, CASE WHEN false_positive THEN 1 WHEN suppressed THEN 2 ELSE 3 END AS stage_no
FROM v WHERE false_positive OR suppressed OR (score > 0 AND score < 0.3)""", "v")
def funnel_first_drop(spark, d):
    f = findings(spark, d, "false_positive", "suppressed", "score")
    a = f.where("NOT false_positive")
    b = a.where("NOT suppressed")
    return joins.first_drop([("raw", f), ("filter", a), ("suppress", b), ("policy", b.where("NOT (score > 0 AND score < 0.3)"))], "ordinal")


@query("""SELECT stage_no, n, n - lag(n) OVER (ORDER BY stage_no) AS delta FROM (SELECT 0 AS stage_no, count(*) AS n FROM v UNION ALL SELECT 1, count(*) FROM v WHERE NOT false_positive UNION ALL SELECT 2, count(*) FROM v WHERE NOT false_positive AND NOT suppressed)""", "v")
def funnel_deltas(spark, d):
    from pyspark.sql import Window

    f = findings(spark, d, "false_positive", "suppressed")
    n = F.count("*"), F.sum((~F.col("false_positive")).cast("long")), F.sum((~F.col("false_positive") & ~F.col("suppressed")).cast("long"))
    rows = f.agg(F.array(*n).alias("a")).select(F.posexplode("a").alias("stage_no", "n"))
    return rows.withColumn("delta", F.col("n") - F.lag("n").over(Window.orderBy("stage_no")))  # three rows


@query(r"""SELECT file_id, path, regexp_matches(lower(path), '(_test\.go|\.(test|spec)\.(js|ts))$|/(test|tests|fixtures|__tests__)/') OR (lower(string_split(path, '/')[-1]) LIKE 'test!_%' ESCAPE '!' AND lower(path) LIKE '%.py') AS test,
regexp_matches(lower(path), '(main\.go|__main__\.py|manage\.py|app\.py|index\.(js|ts)|server\.js|main\.java|application\.java)$') AS entry_file FROM files WHERE path IS NOT NULL""")
def path_flags(spark, d):
    f = table(spark, d, "files", "file_id", "path").where("path IS NOT NULL")
    return f.select("file_id", "path", T.is_test_path(F.col("path")).alias("test"), T.is_entry_path(F.col("path")).alias("entry_file"))



@query("""SELECT file_id, coalesce(language, 'text') AS language FROM (SELECT file_id, CASE WHEN lower(string_split(path, '/')[-1]) = 'dockerfile' THEN '.dockerfile' ELSE regexp_extract(lower(string_split(path, '/')[-1]), '(\\.[^.]*)$', 1) END AS ext FROM files WHERE path IS NOT NULL) LEFT JOIN (VALUES
('.go', 'go'), ('.py', 'python'), ('.js', 'javascript'), ('.jsx', 'javascript'), ('.ts', 'typescript'), ('.tsx', 'typescript'), ('.java', 'java'), ('.kt', 'kotlin'), ('.rb', 'ruby'), ('.php', 'php'), ('.rs', 'rust'), ('.c', 'c'), ('.h', 'c'), ('.cc', 'cpp'), ('.cpp', 'cpp'), ('.hpp', 'cpp'),
('.cs', 'csharp'), ('.scala', 'scala'), ('.swift', 'swift'), ('.sh', 'shell'), ('.bash', 'shell'), ('.zsh', 'shell'), ('.sql', 'sql'), ('.tf', 'terraform'), ('.yml', 'yaml'), ('.yaml', 'yaml'), ('.json', 'json'), ('.toml', 'toml'), ('.xml', 'xml'), ('.html', 'html'), ('.dockerfile', 'dockerfile')) t(ext, language) USING (ext)""")
def file_language(spark, d):
    return table(spark, d, "files", "file_id", "path").where("path IS NOT NULL").select("file_id", T.language_of(F.col("path")).alias("language"))


@query(r"""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(b, '^dockerfile($|\.)|\.dockerfile$') THEN 'dockerfile' WHEN e IN ('.tf', '.tfvars') THEN 'terraform' WHEN e IN ('.yml', '.yaml') AND contains(path, '.github/workflows/') THEN 'workflow'
WHEN regexp_matches(b, '^(docker-)?compose\.ya?ml$') THEN 'compose' WHEN e IN ('.yml', '.yaml') AND contains(c, 'apiVersion') AND regexp_matches(c, 'kind: (Deployment|Pod|Service|Ingress|ConfigMap|Secret|StatefulSet|DaemonSet|Job|CronJob|Role|ClusterRole|ServiceAccount|NetworkPolicy)') THEN 'kubernetes' ELSE '' END AS kind
FROM (SELECT path, coalesce(content, '') AS c, lower(string_split(path, '/')[-1]) AS b, regexp_extract(lower(string_split(path, '/')[-1]), '(\.[^.]*)$', 1) AS e FROM files WHERE path IS NOT NULL)) GROUP BY kind""")
def infra_kinds(spark, d):
    f = table(spark, d, "files", "path", "content").where("path IS NOT NULL")
    return f.groupBy(T.infra_kind(F.col("path"), F.col("content")).alias("kind")).agg(F.count("*").alias("n"))


@query(r"""SELECT doc_id, CASE WHEN strlen(t) < 64 THEN (strlen(t) + 3) // 4 ELSE ((strlen(t) - b - n) * 100) // 360 + n + b // 6 END AS tokens, CASE WHEN t = '' THEN 0 ELSE length(t) - length(replace(t, chr(10), '')) + 1 END AS lines
FROM (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[ \t]', '', 'g')) AS b, length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[\n\r]', '', 'g')) AS n FROM documents)""")
def token_estimate(spark, d):
    x = F.col("text")
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", T.token_estimate(x).alias("tokens"), T.line_count(x).cast("long").alias("lines"))


@query("""SELECT file_id, w AS window_no, w * 120 + 1 AS first_line, least((w + 1) * 120, len(l)) AS last_line, sha256(array_to_string(l[w * 120 + 1 : (w + 1) * 120], chr(10))) AS body
FROM (SELECT file_id, l, unnest(range(0, (len(l) - 1) // 120 + 1)) AS w FROM (SELECT file_id, string_split(content, chr(10)) AS l FROM files WHERE content IS NOT NULL)) WHERE regexp_replace(array_to_string(l[w * 120 + 1 : (w + 1) * 120], chr(10)), '[\\s\\x0b]', '', 'g') <> ''""")
def line_windows_120(spark, d):
    w = windows.line_windows(table(spark, d, "files", "file_id", "content"), ["file_id"], "content", 120)
    return w.select("file_id", F.col("window_no").cast("long").alias("window_no"), F.col("first_line").cast("long").alias("first_line"), F.col("last_line").cast("long").alias("last_line"), F.sha2("body", 256).alias("body"))


@query(r"SELECT file_id, CAST(i AS BIGINT) AS line_no, left(l, 240) AS line FROM (SELECT file_id, unnest(string_split(content, chr(10))) AS l, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i FROM files) WHERE regexp_matches(l, '(TODO|FIXME|rotate the (password|token))')")
def search_lines(spark, d):
    hits = retrieval.search_lines(table(spark, d, "files", "file_id", "content"), ["file_id"], "content", "(TODO|FIXME|rotate the (password|token))")
    return hits.select("file_id", F.col("line_no").cast("long").alias("line_no"), "line")


@query("""SELECT finding_id, array_to_string(string_split(content, chr(10))[greatest(start_line - 2, 1) : end_line + 2], chr(10)) AS snippet FROM findings f JOIN (SELECT path, min(file_id) AS file_id FROM files WHERE content IS NOT NULL GROUP BY path) p ON p.path = f.file JOIN files USING (file_id)""")
def read_lines(spark, d):
    files = table(spark, d, "files", "file_id", "path", "content").where("content IS NOT NULL")
    one = files.groupBy("path").agg(F.min_by("content", "file_id").alias("content"))
    f = table(spark, d, "findings", "finding_id", "file", "start_line", "end_line").join(one, F.col("file") == F.col("path"))
    first = F.greatest(F.col("start_line") - 2, F.lit(1))
    return f.select("finding_id", F.array_join(F.slice(F.split("content", "\n"), first, F.greatest(F.col("end_line") + 2 - first + 1, F.lit(0))), "\n").alias("snippet"))


@query("""SELECT chunk_id, file_id, min(start_line) AS start_line, max(end_line) AS end_line, min(priority) AS priority, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens FROM (
SELECT *, sum(fresh) OVER (PARTITION BY chunk_id, file_id ORDER BY start_line, end_line, ordinal ROWS UNBOUNDED PRECEDING) AS island FROM (
SELECT *, CASE WHEN max(end_line) OVER (PARTITION BY chunk_id, file_id ORDER BY start_line, end_line, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= start_line THEN 0 ELSE 1 END AS fresh FROM frag)) GROUP BY chunk_id, file_id, island""", "frag")
def interval_merge(spark, d):
    out = windows.merge_intervals(fragments(spark, d), ["chunk_id", "file_id"], "start_line", "end_line", [F.min("priority").alias("priority"), F.count("*").alias("n"), F.sum("tokens").alias("tokens")])
    return out.drop("island")


@query("SELECT * FROM (SELECT chunk_id, ordinal, tokens, row_number() OVER (PARTITION BY chunk_id ORDER BY priority, tokens, ordinal) AS rank FROM frag) WHERE rank <= 3", "frag")
def per_group_cap(spark, d):
    return dedup.top_per_group(fragments(spark, d).select("chunk_id", "ordinal", "tokens", "priority"), ["chunk_id"], [F.asc("priority"), F.asc("tokens"), F.asc("ordinal")], 3).drop("priority")


@query("SELECT chunk_id, ordinal, used FROM (SELECT chunk_id, ordinal, CAST(sum(tokens) OVER (PARTITION BY chunk_id ORDER BY priority, tokens, ordinal ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM frag) WHERE used <= 8000", "frag")
def within_budget(spark, d):
    f = fragments(spark, d).select("chunk_id", "ordinal", "tokens", "priority")
    return windows.within_budget(f, ["chunk_id"], [F.asc("priority"), F.asc("tokens"), F.asc("ordinal")], F.col("tokens"), 8000).select("chunk_id", "ordinal", "used")


@query("SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) // count(*) AS mean, list_sort(list(n_chars))[95 * (count(*) - 1) // 100 + 1] AS p95 FROM documents WHERE n_chars IS NOT NULL GROUP BY source")
def size_statistics(spark, d):
    """The floor-index percentile, by rank instead of collected lists."""
    from pyspark.sql import Window

    x = table(spark, d, "documents", "source", "n_chars").where("n_chars IS NOT NULL")
    hist = x.groupBy("source", "n_chars").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("source").orderBy("n_chars"))
    total = hist.groupBy("source").agg(F.sum("c").alias("n"), F.floor(F.sum(F.col("c") * F.col("n_chars")) / F.sum("c")).alias("mean"))
    at = hist.withColumn("upto", upto).join(total, "source").where(F.col("upto") > F.floor(95 * (F.col("n") - 1) / 100))
    return at.groupBy("source", "n", "mean").agg(F.min("n_chars").alias("p95"))


@query("""SELECT query, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 12) DESC, id) AS rank FROM (
SELECT q.vec_id AS query, e.vec_id AS id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS score FROM embeddings e CROSS JOIN (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q)) WHERE rank <= 8""")
def cosine_topk(spark, d):
    e = table(spark, d, "embeddings", "vec_id", "embedding")
    return retrieval.cosine_topk(e, e.where("vec_id % 100 = 0"), 8).select("query", "id", F.round("score", 6).alias("score"), "rank")


@query("SELECT doc_id AS id, score FROM (SELECT doc_id, " + " + ".join(f"(length(t) - length(replace(t, '{w}', ''))) // {len(w)}" for w in ("token", "cache", "cache")) + " AS score FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20")
def keyword_topk(spark, d):
    return retrieval.keyword_topk(table(spark, d, "documents", "doc_id", "text"), ["token", "cache", "cache"], 20, "doc_id", "text")


GRAMS = lambda t: f"list_distinct(flatten(list_transform(list_filter(string_split_regex(regexp_replace(lower(coalesce({t}, '')), '[^a-z0-9_]', ' ', 'g'), ' +'), lambda w: w <> ''), lambda w: CASE WHEN length(w) < 3 THEN [w] ELSE list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3)) END)))"


@query(f"""SELECT query, id, round(score, 9) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM (
SELECT q.item_id AS query, c.finding_id AS id, x / (len(c.g) + len(q.g) - x)::DOUBLE AS score FROM (SELECT q.item_id, c.finding_id, count(*) AS x FROM (SELECT finding_id, unnest({GRAMS('title')}) AS gram FROM findings) c JOIN (SELECT item_id, unnest({GRAMS('text')}) AS gram FROM eval_items WHERE item_id % 100 = 0) q USING (gram) GROUP BY ALL) p
JOIN (SELECT finding_id, {GRAMS('title')} AS g FROM findings) c USING (finding_id) JOIN (SELECT item_id, {GRAMS('text')} AS g FROM eval_items) q USING (item_id))) WHERE rank <= 5""")
def shingle_topk(spark, d):
    q = table(spark, d, "eval_items", "item_id", "text").where("item_id % 100 = 0")
    got = retrieval.shingle_topk(table(spark, d, "findings", "finding_id", "title"), q, 5, "finding_id", "title", "item_id", "text")
    return got.select("query", "id", F.round("score", 9).alias("score"), "rank")


@query("SELECT node, n FROM (SELECT p_partkey AS node, (SELECT count(*) FROM edges WHERE dst = p_partkey) AS n FROM part)", "edges")
def fan_in_rank(spark, d):
    return graph.fan_in(edges(spark, d), nodes(spark, d))


@query("SELECT p_partkey AS node FROM part WHERE p_partkey NOT IN (SELECT dst FROM edges)", "edges")
def roots_no_incoming(spark, d):
    return graph.roots(edges(spark, d), nodes(spark, d))


REACH = ", w AS (SELECT p_partkey AS node, 0 AS distance FROM part WHERE p_partkey % 100 = 0 UNION SELECT dst, distance + 1 FROM w JOIN edges ON src = node WHERE distance < {n})"


@query(REACH.format(n=3) + " SELECT node, min(distance) AS distance FROM w GROUP BY node", "edges", recursive=True)
def k_hop_distance(spark, d):
    return graph.distances(edges(spark, d), nodes(spark, d).where("node % 100 = 0"), 3)


@query(", w AS (SELECT p_partkey AS node FROM part WHERE p_partkey % 100 = 0 UNION SELECT dst FROM w JOIN edges ON src = node) SELECT node FROM w", "edges", recursive=True)
def reachable_set(spark, d):
    return graph.reachable(edges(spark, d), nodes(spark, d).where("node % 100 = 0"))


@query(", l AS (SELECT p_partkey AS node, 0 AS layer FROM part UNION SELECT dst, layer + 1 FROM l JOIN dag ON src = node) SELECT node, max(layer) AS layer FROM l GROUP BY node", "edges dag", recursive=True)
def topological_layers(spark, d):
    return graph.layers(edges(spark, d).where("src < dst").distinct(), nodes(spark, d))


@query(", w AS (SELECT p_partkey AS node, 0 AS k FROM part UNION SELECT e.dst, k + 1 FROM w JOIN edges e ON e.src = node WHERE k < (SELECT count(*) FROM part)) SELECT DISTINCT node FROM w WHERE k = (SELECT count(*) FROM part)", "edges", recursive=True)
def cycle_nodes(spark, d):
    """Nodes on or behind a cycle: those that no layer takes. (In SQL: those that a walk of as many edges as there are nodes leads to.)"""
    return graph.layers(edges(spark, d), nodes(spark, d)).where("layer IS NULL").select("node")


@query(", e AS (SELECT DISTINCT src, dst FROM edges), w AS (SELECT [p_partkey] AS path, 0 AS hops FROM part WHERE p_partkey % 100 = 0 UNION ALL SELECT list_append(path, dst), hops + 1 FROM w JOIN e ON src = path[-1] WHERE hops < 3 AND NOT list_contains(path, dst)) SELECT array_to_string(path, '>') AS path, hops FROM w WHERE hops > 0", "edges", recursive=True)
def bounded_paths(spark, d):
    return graph.bounded_paths(edges(spark, d), nodes(spark, d).where("node % 100 = 0"), 3).select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "hops")


@query("""SELECT file_id, call_no, callee, line, caller, caller_line FROM (SELECT c.file_id, c.call_no, c.callee, c.line, s.name AS caller, s.start_line AS caller_line, row_number() OVER (PARTITION BY c.file_id, c.call_no ORDER BY s.end_line - s.start_line, s.ordinal) AS rn
FROM cal c JOIN sym s ON s.file_id = c.file_id AND c.line BETWEEN s.start_line AND s.end_line) WHERE rn = 1""", "rec sym cal")
def enclosing_function(spark, d):
    rec = codegraph.records(table(spark, d, "file_asts", "file_id", "path", "imports", "symbols", "calls"))
    return codegraph.enclosing(codegraph.calls(rec), codegraph.symbols(rec))


WITH["imp"] = r"""i AS (SELECT file_id, n - 1 AS import_no, trim(m.path) AS imp, p FROM (SELECT file_id, x.path AS p, unnest(x.imports) AS m, unnest(range(1, len(x.imports) + 1)) AS n FROM rec) WHERE trim(m.path) <> ''),
f AS (SELECT DISTINCT path AS target FROM files WHERE path IS NOT NULL), k AS (SELECT key, min(target) AS target FROM (SELECT target, lower(target) AS key FROM f UNION ALL SELECT target, lower(regexp_replace(target, '\.[^./]*$', '')) FROM f) GROUP BY key UNION ALL SELECT '=' || target, target FROM f
UNION ALL SELECT '/' || lower(string_split(target, '/')[-1]), min(target) FROM f GROUP BY 1 HAVING count(*) = 1),
u AS (SELECT file_id, import_no, imp, regexp_replace(p, '/[^/]*$', '') AS d0, regexp_replace(imp, '^(\./)+', '') AS r0, 0 AS n FROM i WHERE imp LIKE '.%' UNION ALL SELECT file_id, import_no, imp, regexp_replace(d0, '(^|/)[^/]*$', ''), substr(r0, 4), n + 1 FROM u WHERE r0 LIKE '../%'),
s AS (SELECT file_id, import_no, imp, CASE WHEN d0 = '' THEN r0 ELSE d0 || '/' || r0 END AS c FROM u WHERE r0 NOT LIKE '../%'),
q AS (SELECT file_id, import_no, j AS p, lower(c) || x AS key FROM s, (VALUES (0, ''), (1, '.go'), (2, '.py'), (3, '.js'), (4, '.jsx'), (5, '.ts'), (6, '.tsx'), (7, '.java')) v(j, x) UNION ALL SELECT file_id, import_no, j, '=' || c || '/' || x FROM s, (VALUES (8, 'index.js'), (9, 'index.ts'), (10, '__init__.py')) v(j, x)
UNION ALL SELECT file_id, import_no, 2 * j, lower(replace(imp, '.', '/')) || x FROM i, (VALUES (0, ''), (1, '.go'), (2, '.py'), (3, '.js'), (4, '.ts'), (5, '.java')) v(j, x) WHERE imp NOT LIKE '.%' UNION ALL SELECT file_id, import_no, 2 * j + 1, lower(imp) || x FROM i, (VALUES (0, ''), (1, '.go'), (2, '.py'), (3, '.js'), (4, '.ts'), (5, '.java')) v(j, x) WHERE imp NOT LIKE '.%'
UNION ALL SELECT file_id, import_no, 20 + j, '/' || lower(string_split_regex(imp, '[/.]')[-1]) || x FROM i, (VALUES (0, '.py'), (1, '.go')) v(j, x) WHERE imp NOT LIKE '.%'),
t AS (SELECT i.file_id, i.import_no, coalesce(m.target, 'ext:' || i.imp) AS target FROM i LEFT JOIN (SELECT file_id, import_no, arg_min(k.target, q.p) AS target FROM q JOIN k USING (key) GROUP BY file_id, import_no) m USING (file_id, import_no)),
lk AS (SELECT DISTINCT t.file_id, r.file_id AS to_file FROM t JOIN rec r ON r.x.path = t.target)"""
WITH["wi"] = r"""wi AS (SELECT DISTINCT file_id, caller, regexp_extract(trim(regexp_replace(callee, '[\[(].*$', '')), '([^.:>\-]*)$', 1) AS callee FROM (SELECT c.file_id, c.call_no, c.callee, s.name AS caller, row_number() OVER (PARTITION BY c.file_id, c.call_no ORDER BY s.end_line - s.start_line, s.ordinal) AS rn FROM cal c JOIN sym s ON s.file_id = c.file_id AND c.line BETWEEN s.start_line AND s.end_line) WHERE rn = 1)"""
WITH["ed"] = """sn AS (SELECT DISTINCT file_id AS to_file, name FROM sym WHERE name IS NOT NULL), ak AS (SELECT DISTINCT file_id, callee FROM wi),
ne AS (SELECT DISTINCT a.file_id, a.callee, s.to_file FROM ak a JOIN (SELECT DISTINCT file_id, file_id AS to_file FROM ak UNION SELECT file_id, to_file FROM lk) l ON l.file_id = a.file_id JOIN sn s ON s.to_file = l.to_file AND s.name = a.callee),
fa AS (SELECT a.file_id, a.callee, s.to_file FROM ak a JOIN sn s ON s.name = a.callee WHERE NOT EXISTS (SELECT 1 FROM ne WHERE ne.file_id = a.file_id AND ne.callee = a.callee)),
ed AS (SELECT w.file_id, w.caller, e.to_file, w.callee FROM wi w JOIN (SELECT * FROM ne UNION ALL SELECT * FROM fa) e USING (file_id, callee) WHERE NOT (w.file_id = e.to_file AND w.caller = w.callee))"""


@query("SELECT * FROM ed", "rec sym cal imp wi ed", recursive=True)
def call_resolution(spark, d):
    rec = codegraph.records(table(spark, d, "file_asts", "file_id", "path", "imports", "symbols", "calls"))
    within = codegraph.enclosing(codegraph.calls(rec), codegraph.symbols(rec))
    files = table(spark, d, "files", "path")
    to = rec.select(F.col("path").alias("target"), F.col("file_id").alias("to_file"))
    links = codegraph.resolve_imports(codegraph.imports(rec), files).join(to, "target").select("file_id", "to_file")
    return codegraph.resolve_calls(within, codegraph.symbols(rec), links)


@query("SELECT * FROM t", "rec imp", recursive=True)
def import_resolution(spark, d):
    rec = codegraph.records(table(spark, d, "file_asts", "file_id", "path", "imports", "symbols", "calls"))
    return codegraph.resolve_imports(codegraph.imports(rec), table(spark, d, "files", "path"))


@query("SELECT m AS import, count(DISTINCT file_id) AS files, array_to_string(list_sort(list_distinct(list(kind))), ',') AS kinds FROM (SELECT file_id, m.path AS m, CASE WHEN x.path LIKE '%.py' THEN 'py' ELSE 'other' END AS kind FROM (SELECT file_id, x, unnest(x.imports) AS m FROM rec)) WHERE m IS NOT NULL GROUP BY m", "rec")
def importers(spark, d):
    rec = codegraph.records(table(spark, d, "file_asts", "file_id", "path", "imports", "symbols", "calls"))
    kind = F.when(F.col("path").endswith(".py"), "py").otherwise("other")
    return codegraph.imports(rec).where("import IS NOT NULL").groupBy("import").agg(F.countDistinct("file_id").alias("files"), F.array_join(F.sort_array(F.collect_set(kind)), ",").alias("kinds"))


PAIRS = "p AS (SELECT DISTINCT file, upper(cwe) AS cwe FROM v WHERE cwe <> '' AND score >= 0.5), t AS (SELECT DISTINCT file, upper(cwe) AS cwe FROM v WHERE cwe <> '' AND verified)"


def labelled(spark, d):
    f = findings(spark, d, "file", "cwe", "score", "verified").where("cwe <> ''").withColumn("cwe", F.upper("cwe"))
    return f, f.where("verified").select("file", "cwe")


@query(f""", {PAIRS}, j AS (SELECT coalesce(p.cwe, t.cwe) AS value, p.file IS NOT NULL AS a, t.file IS NOT NULL AS b FROM p FULL JOIN t ON p.file = t.file AND p.cwe = t.cwe),
c AS (SELECT value, CAST(sum(CASE WHEN a AND b THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN a AND NOT b THEN 1 ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN b AND NOT a THEN 1 ELSE 0 END) AS BIGINT) AS fn, grouping(value) AS is_total FROM j GROUP BY ROLLUP (value)),
q AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS pr, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS re FROM c)
SELECT value, tp, fp, fn, is_total, round(pr, 9) AS precision, round(re, 9) AS recall, round(CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END, 9) AS f1 FROM q""", "v")
def evaluation_by_class(spark, d):
    f, t = labelled(spark, d)
    out = evaluate.confusion(f.where("score >= 0.5").select("file", "cwe"), t, ["file", "cwe"], "cwe")
    return out.select("value", "tp", "fp", "fn", F.col("is_total").cast("long").alias("is_total"), *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


SAMPLES = ", t AS (SELECT DISTINCT file, upper(cwe) AS cwe FROM v WHERE cwe <> '' AND verified), s AS (SELECT v.score AS x, count(*) AS n, CAST(sum(CASE WHEN t.file IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM v LEFT JOIN t ON t.file = v.file AND t.cwe = upper(v.cwe) WHERE v.cwe <> '' AND v.score <> 0 GROUP BY v.score)"
PAV = ", o AS (SELECT *, row_number() OVER (ORDER BY x) AS i, sum(n) OVER (ORDER BY x) AS cn, sum(hits) OVER (ORDER BY x) AS ch FROM s), fit AS (SELECT x, max(low) AS y FROM (SELECT a.x, b.i AS j, min((c.ch - b.ch + b.hits) / (c.cn - b.cn + b.n)) AS low FROM o a JOIN o b ON b.i <= a.i JOIN o c ON c.i >= a.i GROUP BY a.x, b.i) GROUP BY x)"


@query(SAMPLES + " SELECT * FROM s", "v")
def calibration_samples(spark, d):
    f, t = labelled(spark, d)
    return evaluate.pool_scores(evaluate.samples(f, t, ["file", "cwe"]))


@query(SAMPLES + PAV + " SELECT x, round(y, 9) AS y FROM fit", "v")
def calibration_fit(spark, d):
    f, t = labelled(spark, d)
    pooled = materialize(evaluate.pool_scores(evaluate.samples(f, t, ["file", "cwe"])), "scores")
    return evaluate.fitted(pooled).select("x", F.round("y", 9).alias("y"))


@query("SELECT ordinal, round(CASE WHEN score = 0 THEN 0 WHEN score <= 0.2 THEN 0.1 WHEN score >= 0.9 THEN 0.8 WHEN score <= 0.6 THEN 0.1 + (score - 0.2) / 0.4 * 0.4 ELSE 0.5 + (score - 0.6) / 0.3 * 0.3 END, 9) AS calibrated FROM v", "v")
def calibration_apply(spark, d):
    return findings(spark, d, "score").select("ordinal", F.round(evaluate.interpolated(F.col("score"), [(0.2, 0.1), (0.6, 0.5), (0.9, 0.8)]), 9).alias("calibrated"))


@query("SELECT ordinal, array_to_string(list_distinct_keep, ',') AS tags FROM (SELECT ordinal, list_filter(list_append(coalesce(tags, []), 'reviewed'), lambda x, i: list_position(list_append(coalesce(tags, []), 'reviewed'), x) = i) AS list_distinct_keep FROM v)", "v")
def append_unique(spark, d):
    f = table(spark, d, "findings", "finding_id", "tags")
    return f.select(F.col("finding_id").alias("ordinal"), F.array_join(F.array_union(F.coalesce("tags", F.array().cast("array<string>")), F.array(F.lit("reviewed"))), ",").alias("tags"))


@query("SELECT ordinal, CASE WHEN rule_id <> '' THEN rule_id ELSE agent || '/' || trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') END AS \"ruleId\", CASE WHEN lower(trim(severity)) IN ('critical', 'high') THEN 'error' WHEN lower(trim(severity)) = 'medium' THEN 'warning' ELSE 'note' END AS level FROM v WHERE NOT false_positive", "v")
def sarif_results(spark, d):
    return sinks.sarif_results(findings(spark, d)).drop("result")


@query("SELECT DISTINCT '  \"' || src || '\" -> \"' || dst || '\";' AS line FROM edges", "edges")
def dot_lines(spark, d):
    return sinks.dot_lines(edges(spark, d))


@query(f"""SELECT ordinal, CASE WHEN length(t) > 80 THEN left(t, 80) || '...' ELSE t END AS line FROM (SELECT ordinal, {sq('description')} AS t FROM v)""", "v")
def one_line(spark, d):
    return findings(spark, d, "description").select("ordinal", T.one_line(F.col("description"), 80).alias("line"))


@query("SELECT vec_id, octet_length(vec) // 4 AS values FROM embedding_cache WHERE vec IS NOT NULL AND octet_length(vec) = 4 * dim")
def vector_lengths(spark, d):
    e = table(spark, d, "embedding_cache", "vec_id", "dim", "vec").where("vec IS NOT NULL AND octet_length(vec) = 4 * dim")
    return e.select("vec_id", F.floor(F.octet_length("vec") / 4).alias("values"))


@query("SELECT kind, count(*) AS n FROM (SELECT DISTINCT chunk_key, file, CAST(json_extract_string(CASE WHEN json_valid(decode(payload)) THEN decode(payload) END, '$.symbol_kind') AS VARCHAR) AS kind FROM rag_chunks WHERE payload IS NOT NULL) GROUP BY kind")
def chunk_kinds(spark, d):
    c = table(spark, d, "rag_chunks", "chunk_key", "file", "payload").where("payload IS NOT NULL")
    text = F.decode("payload", "UTF-8")
    kind = F.when(F.try_parse_json(text).isNotNull(), F.get_json_object(text, "$.symbol_kind"))
    return c.select("chunk_key", "file", kind.alias("kind")).distinct().groupBy("kind").agg(F.count("*").alias("n"))


@query(""", o AS (SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY start_line, end_line) AS n, start_line AS a, end_line AS b, end_line - start_line + 1 AS s FROM sym WHERE start_line <= end_line),
w AS (SELECT file_id, n, a, b, s, 0 AS run, s AS total FROM o WHERE n = 1 UNION ALL SELECT o.file_id, o.n, o.a, o.b, o.s, CASE WHEN w.total + o.s > 60 THEN w.run + 1 ELSE w.run END, CASE WHEN w.total + o.s > 60 THEN o.s ELSE w.total + o.s END FROM w JOIN o ON o.file_id = w.file_id AND o.n = w.n + 1),
t AS (SELECT file_id, run, sum(s) AS size, max(run) OVER (PARTITION BY file_id) AS last FROM w GROUP BY file_id, run), m AS (SELECT w.*, CASE WHEN w.run = t.last AND w.run > 0 AND t.size < 15 THEN w.run - 1 ELSE w.run END AS r FROM w JOIN t USING (file_id, run))
SELECT file_id, r AS run_no, arg_min(a, n) AS first_line, arg_max(b, n) AS last_line, CAST(sum(s) AS BIGINT) AS size FROM m GROUP BY file_id, r""", "rec sym", recursive=True)
def packed_symbols(spark, d):
    rec = codegraph.records(table(spark, d, "file_asts", "file_id", "path", "imports", "symbols", "calls"))
    return sequential.packed_symbols(codegraph.symbols(rec).where("start_line <= end_line"), "file_id", 60, 15)


@query()
def data_flows(spark, d):
    f = table(spark, d, "files", "file_id", "content").where("content IS NOT NULL")
    return sequential.map_rows(f, "content", ["file_id"], lambda t: sequential.flows(t.split("\n"), ["get_", "fetch", "load"], ["flush", "publish", "submit"], ["validate", "trim"]), "source_line int, sink_line int, name string, cleaned boolean")


@query(r"SELECT entry_id, sha256(trim(finding_json, ' ' || chr(9) || chr(10) || chr(13))) AS object FROM baseline")
def json_in_noise(spark, d):
    """The JSON object of each finding found again between prose with an open brace and code fences."""
    b = table(spark, d, "baseline", "entry_id", "finding_json").withColumn("text", F.concat(F.lit("Result {see below:\n```json\n"), "finding_json", F.lit("\n```\nDone.")))
    got = sequential.map_rows(b, "text", ["entry_id"], lambda t: [(sequential.balanced_json(t),)], "json string")
    return got.select("entry_id", F.sha2("json", 256).alias("object"))


RULES = [("py-query", "python", "select * from"), ("py-auth", "python", "set_header("), ("go-auth", "go", "setHeader("), ("js-auth", "javascript", "setHeader("), ("java-bucket", "java", "openBucket("), ("go-error", "go", "err != nil")]


@query("SELECT file_id, CAST(i AS BIGINT) AS line_no, r.rule FROM (SELECT file_id, language, unnest(string_split(content, chr(10))) AS l, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i FROM files) f JOIN (VALUES " + ", ".join(str(r) for r in RULES) + ") r(rule, lang, lit) ON f.language = r.lang AND contains(l, r.lit)")
def rule_matches(spark, d):
    got = rules.rule_matches(table(spark, d, "files", "file_id", "language", "content"), ["file_id"], "language", "content", RULES)
    return got.select("file_id", F.col("line_no").cast("long").alias("line_no"), "rule")


MARK = r"rotate the (password|token) with ([A-Za-z0-9_]+) every (\d+) days"


@query(f"SELECT file_id, CAST(i AS BIGINT) AS line_no, regexp_extract(l, '{MARK}', 1) AS what, regexp_extract(l, '{MARK}', 2) AS tool, regexp_extract(l, '{MARK}', 3) AS days FROM (SELECT file_id, unnest(string_split(content, chr(10))) AS l, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i FROM files) WHERE regexp_matches(l, '{MARK}')")
def marks_in_source(spark, d):
    got = rules.extract_marks(table(spark, d, "files", "file_id", "content"), ["file_id"], "content", MARK, ["what", "tool", "days"])
    return got.withColumn("line_no", F.col("line_no").cast("long"))


ENTRY = [("handler", "^(queue|publish|submit)", 0.9), ("loader", "^(load|fetch)", 0.7), ("other", "[A-Z_].*[A-Z_]", 0.3)]


@query("SELECT file_id, name, kind, weight FROM (SELECT file_id, name, CASE WHEN regexp_matches(name, '^(queue|publish|submit)') THEN 'handler' WHEN regexp_matches(name, '^(load|fetch)') THEN 'loader' WHEN regexp_matches(name, '[A-Z_].*[A-Z_]') THEN 'other' END AS kind, CASE WHEN regexp_matches(name, '^(queue|publish|submit)') THEN 0.9::DOUBLE WHEN regexp_matches(name, '^(load|fetch)') THEN 0.7::DOUBLE WHEN regexp_matches(name, '[A-Z_].*[A-Z_]') THEN 0.3::DOUBLE END AS weight, row_number() OVER (PARTITION BY file_id, name ORDER BY ordinal) AS rn FROM sym WHERE kind IS NOT NULL) WHERE rn = 1 AND kind IS NOT NULL", "rec sym")
def entry_points(spark, d):
    rec = codegraph.records(table(spark, d, "file_asts", "file_id", "path", "imports", "symbols", "calls"))
    s = codegraph.symbols(rec).where("kind IS NOT NULL")
    kind, weight = rules.first_rule(F.col("name"), ENTRY)
    best = dedup.first_by(s.select("file_id", "ordinal", "name", kind.alias("kind"), weight.alias("weight")), ["file_id", "name"], [F.desc("weight"), F.asc("ordinal")])
    return best.where("kind IS NOT NULL").drop("ordinal")


@query("SELECT f.file_id FROM files f WHERE f.path IN (SELECT file FROM findings)")
def changed_files(spark, d):
    """Files that are named by another table: a semi join."""
    return table(spark, d, "files", "file_id", "path").join(table(spark, d, "findings", "file").toDF("path"), "path", "left_semi").select("file_id")


@query("SELECT file_id, row_number() OVER (ORDER BY p IS NULL, coalesce(p, 0), file_id) AS position FROM (SELECT f.file_id, CASE WHEN n >= 5 THEN -n END AS p FROM files f LEFT JOIN (SELECT file, count(*) AS n FROM findings GROUP BY file) c ON c.file = f.path)")
def files_by_priority(spark, d):
    """Files with many findings first. Positions are the row's own rank, which a sort of the whole table gives."""
    from pyspark.sql import Window

    many = table(spark, d, "findings", "file").groupBy(F.col("file").alias("path")).agg((-F.count("*")).alias("priority")).where("priority <= -5")
    placed = rules.by_priority(table(spark, d, "files", "file_id", "path"), "path", many, "file_id").select("file_id", "position")
    # ranks without one task: positions within sorted partitions, after those of the partitions before
    ordered = materialize(placed.orderBy("position").select("file_id", F.spark_partition_id().alias("part"), (F.monotonically_increasing_id() % F.lit(1 << 33)).alias("at")), "ordered")
    counts = ordered.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
    return ordered.join(F.broadcast(counts), "part").select("file_id", (F.col("before") + F.col("at") + 1).alias("position"))


@query(""", d AS (SELECT file, rule_id, list(ordinal) AS ids, min(ordinal) % 4 = 0 AS dropped FROM r WHERE ordinal % 3 <> 0 GROUP BY file, rule_id HAVING count(*) > 1),
n AS (SELECT file AS f, rule_id AS q, dropped, unnest(ids) AS ordinal FROM d), k AS (SELECT n.ordinal, dropped, row_number() OVER (PARTITION BY f, q ORDER BY sr DESC, cr DESC, start_line, n.ordinal) AS rn FROM n JOIN r ON r.ordinal = n.ordinal)
SELECT ordinal FROM k WHERE NOT dropped AND rn = 1 UNION ALL SELECT ordinal FROM r WHERE ordinal NOT IN (SELECT ordinal FROM n)""", "v r")
def merged_decisions(spark, d):
    f = findings(spark, d, "file", "rule_id", "severity", "confidence", "start_line")
    some = f.where("ordinal % 3 <> 0").select("ordinal", F.struct("file", "rule_id").alias("decision"))
    decided = some.groupBy("decision").agg((F.min("ordinal") % 4 == 0).alias("drop"), F.count("*").alias("n")).where("n > 1")
    named = some.join(decided, "decision").select("decision", "drop", "ordinal")
    order = [V.severity_rank(F.col("severity")).desc(), V.confidence_rank(F.col("confidence")).desc(), F.asc("start_line"), F.asc("ordinal")]
    return rules.merge_decisions(f, named, "ordinal", order).select("ordinal")


def halves(n: int) -> str:
    view, names = "w0 AS (SELECT file_id, start_line AS a, end_line AS b FROM sym WHERE start_line <= end_line)", "w0"
    for i in range(n):
        m = "CAST(floor((a + b) / 2.0) AS INT)"
        view += f", w{i + 1} AS (SELECT file_id, a, b FROM w{i} WHERE b - a + 1 <= 12 UNION ALL SELECT file_id, a, {m} FROM w{i} WHERE b - a + 1 > 12 UNION ALL SELECT file_id, {m} + 1, b FROM w{i} WHERE b - a + 1 > 12)"
    return view


@query(f", {halves(4)} SELECT file_id, a AS start_line, b AS end_line FROM w4", "rec sym")
def split_to_size(spark, d):
    rec = codegraph.records(table(spark, d, "file_asts", "file_id", "path", "imports", "symbols", "calls"))
    s = codegraph.symbols(rec).where("start_line <= end_line").select("file_id", "start_line", "end_line")
    return rules.split_to_size(s, ["file_id"], "start_line", "end_line", 12)


@query(r"""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(lower(file), '(_test\.go|\.(test|spec)\.(js|ts))$|/(test|tests|fixtures|__tests__)/') OR (lower(string_split(file, '/')[-1]) LIKE 'test!_%' ESCAPE '!' AND lower(file) LIKE '%.py') THEN 'test'
WHEN file NOT IN (SELECT x.path FROM rec WHERE len(x.calls) >= 3 AND x.path IS NOT NULL) AND NOT regexp_matches(lower(file), '(main\.go|__main__\.py|manage\.py|app\.py|index\.(js|ts)|server\.js|main\.java|application\.java)$') THEN 'unreached' END AS reason FROM v) GROUP BY reason""".replace("lower(file)", "lower(replace(file, chr(92), '/'))").replace("string_split(file,", "string_split(replace(file, chr(92), '/'),"), "v rec")
def reach_reasons(spark, d):
    rec = codegraph.records(table(spark, d, "file_asts", "file_id", "path", "imports", "symbols", "calls"))
    busy = rec.where("size(calls) >= 3 AND path IS NOT NULL").select(F.col("path").alias("file"))
    f = findings(spark, d, "file")
    return rules.downgraded(f, busy, "file", T.is_test_path(F.col("file")), T.is_entry_path(F.col("file"))).groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT w.file_id, w.window_no, count(*) AS n FROM (SELECT file_id, unnest(range(0, max(end_line) // 40 + 1)) AS window_no FROM sym WHERE start_line <= end_line GROUP BY file_id) w JOIN sym s ON s.file_id = w.file_id AND s.start_line <= w.window_no * 40 + 40 AND s.end_line >= w.window_no * 40 + 1 AND s.start_line <= s.end_line GROUP BY ALL", "rec sym")
def symbols_in_windows(spark, d):
    """Symbols that overlap each of a file's windows of 40 lines."""
    rec = codegraph.records(table(spark, d, "file_asts", "file_id", "path", "imports", "symbols", "calls"))
    s = codegraph.symbols(rec).where("start_line <= end_line")
    first = F.greatest(F.floor((F.col("start_line") - 1) / 40), F.lit(0))
    w = s.select("file_id", F.explode(F.sequence(first, F.greatest(F.floor((F.col("end_line") - 1) / 40), first))).alias("window_no"))
    return w.groupBy("file_id", "window_no").agg(F.count("*").alias("n"))
