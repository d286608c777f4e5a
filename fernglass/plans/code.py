"""Queries over files, symbols, calls and rules, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fernglass.functions import text as T
from fernglass.operators import codegraph, dedup, entries, evaluate, joins, rules, windows
from fernglass.plans.catalogue import WITH, edges, findings, fragments, labelled, query
from fernglass.plans.catalogue import SAMPLES as CALIBRATION
from fernglass.session import materialize
from fernglass.sources import sinks
from fernglass.sources.tables import table

_EXT = "regexp_extract(lower(string_split(path, '/')[-1]), '(\\.[^.]*)$', 1)"
_LINES = "(SELECT file_id, path, language, CAST(i AS BIGINT) AS line_no, l FROM (SELECT file_id, path, language, unnest(string_split(content, chr(10))) AS l, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i FROM files))"


def records(spark, d):
    return codegraph.records(table(spark, d, "file_asts", "file_id", "path", "imports", "symbols", "calls"))


def contents(spark, d, *more):
    return table(spark, d, "files", "file_id", *more, "content").where("content IS NOT NULL")


def linked(spark, d, rec):
    to = rec.select(F.col("path").alias("target"), F.col("file_id").alias("to_file"))
    return codegraph.resolve_imports(codegraph.imports(rec), table(spark, d, "files", "path")).join(to, "target").select("file_id", "to_file").distinct()


@query(f"SELECT file_id, CASE WHEN {_EXT} = '.go' THEN 'go' WHEN {_EXT} = '.py' THEN 'python' WHEN {_EXT} IN ('.js', '.jsx', '.mjs', '.cjs') THEN 'javascript' WHEN {_EXT} IN ('.ts', '.tsx') THEN 'typescript' WHEN {_EXT} = '.java' THEN 'java' ELSE '' END AS language FROM files WHERE path IS NOT NULL")
def parser_language(spark, d):
    return table(spark, d, "files", "file_id", "path").where("path IS NOT NULL").select("file_id", T.parser_language(F.col("path")).alias("language"))


@query(rf"SELECT file_id, string_split(path, '/')[-1] AS base, {_EXT} AS ext, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS dir, path AS cleaned, regexp_replace(path, '^[^/]*/', '') AS below FROM files WHERE path IS NOT NULL AND contains(path, '/')")
def path_operations(spark, d):
    p = F.col("path")
    f = table(spark, d, "files", "file_id", "path").where("path IS NOT NULL AND contains(path, '/')")
    odd = F.concat(F.lit("./a/./../"), T.dir_name(p), F.lit("//x/y/../../"), T.base_name(p))
    return f.select("file_id", T.base_name(p).alias("base"), T.extension(p).alias("ext"), T.dir_name(p).alias("dir"), T.clean_path(odd).alias("cleaned"), T.relative_to(F.split(p, "/")[0], p).alias("below"))


@query(f"SELECT file_id, count(*) AS n FROM {_LINES} WHERE regexp_matches(l, '(^|[^A-Za-z0-9_])session([^A-Za-z0-9_]|$)') GROUP BY file_id")
def whole_word_lines(spark, d):
    rows = windows.lines(contents(spark, d).where(T.contains_word(F.col("content"), "session")), ["file_id"], "content")
    return rows.where(T.contains_word(F.col("line"), "session")).groupBy("file_id").agg(F.count("*").alias("n"))


@query("SELECT file_id, sha256(coalesce(content, chr(1)) || chr(0) || coalesce(language, chr(1))) AS key FROM files")
def cache_keys(spark, d):
    return table(spark, d, "files", "file_id", "content", "language").select("file_id", T.cache_key(F.col("content"), F.col("language")).alias("key"))


@query("""SELECT finding_id, string_agg(printf('%5d | %s', i, l), chr(10) ORDER BY i) AS snippet FROM findings f JOIN (SELECT path, min(file_id) AS file_id FROM files WHERE content IS NOT NULL GROUP BY path) p ON p.path = f.file JOIN (SELECT file_id, unnest(string_split(content, chr(10))) AS l, CAST(unnest(range(1, len(string_split(content, chr(10))) + 1)) AS INT) AS i FROM files) x USING (file_id) WHERE i BETWEEN start_line - 2 AND end_line + 2 GROUP BY finding_id""")
def numbered_snippets(spark, d):
    """The lines around each finding with their numbers; a file's text is cut where it is joined, without exploding it."""
    one = contents(spark, d, "path").groupBy("path").agg(F.min_by("content", "file_id").alias("content"))
    f = table(spark, d, "findings", "finding_id", "file", "start_line", "end_line").join(one, F.col("file") == F.col("path")).withColumn("lines", F.split("content", "\n"))
    first, last = F.greatest(F.col("start_line") - 2, F.lit(1)), F.least(F.col("end_line") + 2, F.size("lines"))
    f = f.where(last >= first)
    rows = F.transform(F.slice("lines", first, last - first + 1), lambda x, i: F.format_string("%5d | %s", first + i, x))
    return f.select("finding_id", F.array_join(rows, "\n").alias("snippet"))


@query(r"SELECT DISTINCT receiver, regexp_extract(regexp_replace(string_split_regex(trim(trim(coalesce(receiver, '')), '()'), '\s+')[-1], '^\*', ''), '([^.]*)$', 1) AS name FROM (SELECT unnest(x.symbols).receiver AS receiver FROM rec)", "rec")
def receiver_names(spark, d):
    s = records(spark, d).select(F.explode("symbols").alias("s")).select(F.col("s.receiver").alias("receiver")).distinct()
    return s.select("receiver", T.receiver_name(F.col("receiver")).alias("name"))


@query("SELECT source, format('{:,}', CAST(sum(n_chars) AS BIGINT)) AS characters FROM documents GROUP BY source")
def thousands_separators(spark, d):
    return table(spark, d, "documents", "source", "n_chars").groupBy("source").agg(F.sum("n_chars").alias("n")).select("source", T.thousands(F.col("n")).alias("characters"))


#: A comment that silences a rule on its own line and the next: the word, the rules in brackets, a reason.
MARKER = r"check:ignore\[([^\]]+)\](?:\s+reason:\s*(.*))?"
_MARKED = "content || chr(10) || '// check:ignore[ ' || CASE file_id % 3 WHEN 0 THEN '*' WHEN 1 THEN 'inj.sql-concat' ELSE 'auth' END || ' ]' || CASE WHEN file_id % 2 = 0 THEN ' reason: known, see ' || file_id || ' ' ELSE '' END"


def _marked(spark, d):
    rule = F.when(F.col("file_id") % 3 == 0, "*").when(F.col("file_id") % 3 == 1, "inj.sql-concat").otherwise("auth")
    reason = F.when(F.col("file_id") % 2 == 0, F.concat(F.lit(" reason: known, see "), F.col("file_id").cast("string"), F.lit(" "))).otherwise("")
    f = contents(spark, d, "path").where("path IS NOT NULL").withColumn("content", F.concat("content", F.lit("\n// check:ignore[ "), rule, F.lit(" ]"), reason))
    return rules.markers(f, ["file_id", "path"], "content", MARKER)


@query(f"SELECT file_id, path, CAST(length(c) - length(replace(c, chr(10), '')) + 1 AS BIGINT) AS line_no, CASE file_id % 3 WHEN 0 THEN '*' WHEN 1 THEN 'inj.sql-concat' ELSE 'auth' END AS rule, CASE WHEN file_id % 2 = 0 THEN 'known, see ' || file_id ELSE '' END AS reason FROM (SELECT file_id, path, {_MARKED} AS c FROM files WHERE content IS NOT NULL AND path IS NOT NULL)")
def suppression_markers(spark, d):
    return _marked(spark, d).withColumn("line_no", F.col("line_no").cast("long"))


@query(f""", m AS (SELECT path, length(c) - length(replace(c, chr(10), '')) + 1 AS line, CASE file_id % 3 WHEN 0 THEN '*' WHEN 1 THEN 'inj.sql-concat' ELSE 'auth' END AS rule, file_id FROM (SELECT file_id, path, {_MARKED} AS c FROM files WHERE content IS NOT NULL AND path IS NOT NULL))
SELECT ordinal, min(m.file_id) AS marker FROM v JOIN m ON m.path = v.file AND m.line BETWEEN v.end_line - 30 AND v.end_line + 30 AND (m.rule = '*' OR m.rule = v.rule_id OR m.rule = v.agent) GROUP BY ordinal""", "v")
def suppressed_by_markers(spark, d):
    """Findings near a marker read from the text, the first marker counting. (The window is wide, as the markers stand at the files' ends.)"""
    m = _marked(spark, d).select("path", "file_id", "rule", (F.col("line_no") - 30).alias("lo"), (F.col("line_no") + 30).alias("hi")).withColumnRenamed("path", "file")
    f = findings(spark, d, "file", "rule_id", "agent", "end_line")
    where = (F.col("r.rule") == "*") | (F.col("r.rule") == F.col("l.rule_id")) | (F.col("r.rule") == F.col("l.agent"))
    return joins.range_first_match(f, m, ["file"], ("end_line", "end_line"), ("lo", "hi"), "file_id", where=where).select("ordinal", F.col("match.file_id").alias("marker"))


#: (id, language, categories, patterns, callees, negative) of a rule table of calls that clean what they are given.
TABLE = (
    ("py-trim", "python", ("format",), (r"\btrim_\w+\(",), ("merge_dispute29", "sync_score_card_toggle"), False), ("py-validate", "python", ("shape", "format"), (r"\bvalidate_\w+\(", r"check_\w+\("), ("refresh_shared_survey",), False),
    ("js-check", "javascript", ("shape",), (r"\bcheck[A-Z]\w*\(",), ("lockHeaderRollout", "routeLegacyHeader"), False), ("go-encode", "go", ("encoding",), (r"\bencode[A-Z]\w*\(",), ("splitReplicaReplica",), False), ("go-raw", "go", ("encoding",), (r"\braw[A-Z]\w*",), (), True),
)
_TABLE = "(VALUES " + ", ".join(f"('{i}', '{lang}', {list(c)}, '{'|'.join(p)}', {list(n) or ['']})" for i, lang, c, p, n, _ in TABLE) + ") r(id, lang, cats, pattern, callees)"


@query(f"SELECT file_id, line_no, r.id FROM {_LINES} f JOIN {_TABLE} ON f.language = r.lang AND regexp_matches(l, r.pattern) WHERE list_has_any(r.cats, ['shape', 'encoding'])")
def regex_rule_matches(spark, d):
    """Lines that a rule's patterns match, once per rule, of the asked categories; rules of other ones are never tried."""
    asked = rules.of_categories(TABLE, ("shape", "ENCODING"))
    got = rules.pattern_matches(contents(spark, d, "language"), ["file_id"], "language", "content", [(i, lang, p) for i, lang, _, p, _, _ in asked])
    return got.select("file_id", F.col("line_no").cast("long").alias("line_no"), F.col("rule").alias("id"))


@query(f"SELECT file_id, call_no, r.id FROM (SELECT c.*, x.path AS path FROM cal c JOIN rec USING (file_id)) c JOIN {_TABLE} ON r.lang = CASE WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.go' THEN 'go' WHEN regexp_matches(path, '\\.(js|jsx|mjs)$') THEN 'javascript' ELSE '' END AND (list_contains(r.callees, trim(callee)) OR list_contains(r.callees, regexp_extract(trim(callee), '([^.]*)$', 1)))", "rec cal")
def callee_rule_matches(spark, d):
    rec = records(spark, d)
    c = codegraph.calls(rec).join(rec.select("file_id", T.parser_language(F.col("path")).alias("language")), "file_id")
    return rules.callee_matches(c, "language", "callee", [(i, lang, n) for i, lang, _, _, n, _ in TABLE]).select("file_id", "call_no", F.col("rule").alias("id"))


@query(f"SELECT c AS category, string_agg(id, ',' ORDER BY id) AS rules FROM (SELECT id, unnest(cats) AS c FROM {_TABLE}) GROUP BY c")
def rules_by_category(spark, d):
    t = spark.createDataFrame([(i, list(c)) for i, _, c, _, _, _ in TABLE], "id string, cats array<string>")
    return t.select("id", F.explode("cats").alias("category")).groupBy("category").agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("rules"))


WATCH = (("python", "load_"), ("go", "fetch"), ("javascript", "publish"), ("java", "submit"))


@query("SELECT f.file_id FROM files f LEFT JOIN rec r USING (file_id) WHERE f.path IS NOT NULL AND (regexp_matches(lower(string_split(f.path, '/')[-1]), '\\.(tf|tfvars|dockerfile)$') OR r.file_id IS NULL OR " + " OR ".join(f"(language = '{a}' AND contains(coalesce(content, ''), '{b}'))" for a, b in WATCH) + ")", "rec")
def watchlist_files(spark, d):
    """Files worth a closer look: infrastructure, not parsed, or with one of their language's watched words."""
    f = table(spark, d, "files", "file_id", "path", "language", "content").where("path IS NOT NULL")
    parsed = table(spark, d, "file_asts", "file_id").where("file_id IS NOT NULL").distinct().withColumn("parsed", F.lit(True))
    hit = F.lit(False)
    for lang, word in WATCH:
        hit |= F.coalesce(F.col("language") == lang, F.lit(False)) & F.contains(F.coalesce("content", F.lit("")), F.lit(word))
    infra = F.lower(T.base_name(F.col("path"))).rlike(r"\.(tf|tfvars|dockerfile)$")
    return f.join(parsed, "file_id", "left").where(infra | F.col("parsed").isNull() | hit).select("file_id")


def _entry_sql() -> str:
    parts = []
    for lang, kinds, where, pattern, kind, weight in entries.RULES:
        langs = "('javascript', 'typescript')" if lang == "javascript" else f"('{lang}')"
        fits = [f"lang IN {langs}", "kind IN (" + ", ".join(f"'{k}'" for k in kinds.split()) + ")"]
        for place, p in zip(where.split("&"), pattern.split("&")):
            fits.append(f"regexp_matches({place}, '{p}')")
        parts.append(f"WHEN {' AND '.join(fits)} THEN {{'k': '{kind}', 'w': {weight}::DOUBLE}}")
    return "CASE " + " ".join(parts) + " END"


@query(rf""", y AS (SELECT file_id, x.path AS path, content AS file, string_split(content, chr(10)) AS ls, CASE WHEN regexp_matches(lower(x.path), '\.go$') THEN 'go' WHEN regexp_matches(lower(x.path), '\.py$') THEN 'python' WHEN regexp_matches(lower(x.path), '\.(js|jsx|mjs|cjs)$') THEN 'javascript' WHEN regexp_matches(lower(x.path), '\.tsx?$') THEN 'typescript' WHEN regexp_matches(lower(x.path), '\.java$') THEN 'java' ELSE '' END AS lang FROM rec JOIN files USING (file_id) WHERE content IS NOT NULL),
z AS (SELECT s.file_id, s.ordinal, s.name, s.kind, lang, path, file, coalesce(ls[a], '') AS signature, array_to_string(ls[a : least(a + 4, greatest(b, a))], chr(10)) AS body4, array_to_string(ls[a : least(a + 3, greatest(b, a))], chr(10)) AS body3, coalesce(list_filter(CASE WHEN a > 1 THEN ls[1 : a - 1] ELSE [] END, lambda q: trim(q) <> '')[-1], '') AS above1,
CASE WHEN a > 1 THEN array_to_string(ls[greatest(a - 3, 1) : a - 1], chr(10)) ELSE '' END AS above3, array_to_string(ls[greatest(a - 1, 1) : least(greatest(b, a), a + 1)], chr(10)) AS near1 FROM (SELECT *, start_line AS a, end_line AS b FROM sym WHERE name IS NOT NULL AND start_line >= 1) s JOIN y USING (file_id)),
w AS (SELECT file_id, ordinal, name, {_entry_sql()} AS e FROM (SELECT *, above3 || chr(10) || signature AS above3line, above1 || chr(10) || near1 AS around1 FROM z))
SELECT file_id, name, ordinal, e.k AS kind, e.w AS weight FROM (SELECT *, row_number() OVER (PARTITION BY file_id, name ORDER BY e.w DESC, ordinal) AS rn FROM w WHERE e IS NOT NULL) WHERE rn = 1""", "rec sym")
def entry_points_by_language(spark, d):
    rec = records(spark, d).select("file_id", "path", "symbols")
    got = entries.entry_points(rec, contents(spark, d), T.parser_language(F.col("path")))
    return got.select("file_id", "name", F.col("ordinal").cast("long").alias("ordinal"), "kind", "weight")


@query("SELECT file_id, ordinal, list_filter(CASE WHEN start_line > 1 THEN string_split(content, chr(10))[1 : start_line - 1] ELSE [] END, lambda q: trim(q) <> '')[-1] AS line FROM sym JOIN files USING (file_id) WHERE content IS NOT NULL AND start_line >= 1", "rec sym")
def previous_nonblank(spark, d):
    f = records(spark, d).select("file_id", "symbols").join(contents(spark, d), "file_id").withColumn("lines", F.split("content", "\n"))
    before = lambda s: F.try_element_at(F.filter(F.slice("lines", 1, F.greatest(F.least(s["start_line"] - 1, F.size("lines")), F.lit(0))), lambda x: F.trim(x) != ""), F.lit(-1))
    rows = f.select("file_id", F.explode(F.transform("symbols", lambda s, i: F.struct(i.cast("long").alias("ordinal"), s["start_line"].alias("at"), before(s).alias("line")))).alias("r"))
    return rows.where("r.at >= 1").select("file_id", "r.ordinal", "r.line")


#: Parts of a path that speak for a file, names that do, and parts that speak against it.
HINTS = ("main.", "server.", "app.", "index.", "router", "routes", "handler", "controller", "middleware", "auth", "api/")
MANIFESTS = ("package.json", "go.mod", "go.sum", "cargo.toml", "pyproject.toml", "requirements.txt", "pom.xml", "build.gradle", "dockerfile", "compose.yaml", "compose.yml", "docker-compose.yml", ".env.example", "config.yaml", "config.yml", "readme.md")
JUNK = ("vendor/", "node_modules/", "dist/", "build/", ".gen.", "_test.", "/test/", "/tests/", "fixtures/", "testdata/")
_SCORE = "0 - (length(path) - length(replace(path, '/', ''))) + 8 * (" + " + ".join(f"CAST(contains(lower(path), '{h}') AS INT)" for h in HINTS) + ") + CASE WHEN lower(string_split(path, '/')[-1]) IN (" + ", ".join(f"'{m}'" for m in MANIFESTS) + ") THEN 20 ELSE 0 END - 30 * (" + " + ".join(f"CAST(contains(lower(path), '{j}') AS INT)" for j in JUNK) + ")"


@query(f"SELECT path, s + 50 * coalesce(n, 0) AS score FROM (SELECT DISTINCT path, {_SCORE} AS s FROM files WHERE path IS NOT NULL) LEFT JOIN (SELECT x.path AS path, count(*) AS n FROM rec JOIN sym USING (file_id) WHERE name = 'main' GROUP BY x.path) USING (path) ORDER BY score DESC, path LIMIT 40", "rec sym")
def file_sample(spark, d):
    """The 40 files that tell most of a project: by name and place, and by the entry points in them."""
    p, low = F.col("path"), F.lower("path")
    part = lambda words: sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))
    score = F.lit(0) - (F.length(p) - F.length(F.replace(p, F.lit("/"), F.lit("")))) + 8 * part(HINTS) + F.when(F.lower(T.base_name(p)).isin(*MANIFESTS), 20).otherwise(0) - 30 * part(JUNK)
    rec = records(spark, d)
    mains = codegraph.symbols(rec).where("name = 'main'").join(rec.select("file_id", "path"), "file_id").groupBy("path").agg(F.count("*").alias("n"))
    files = table(spark, d, "files", "path").where("path IS NOT NULL").distinct()
    return files.join(mains, "path", "left").select("path", (score + 50 * F.coalesce("n", F.lit(0))).alias("score")).orderBy(F.desc("score"), "path").limit(40)


@query(""", top AS (SELECT to_file AS file_id, row_number() OVER (ORDER BY count(*) DESC, to_file) AS n FROM lk GROUP BY to_file QUALIFY n <= 15), p AS (SELECT file_id, 100 + row_number() OVER (ORDER BY file_id) AS n FROM rec WHERE file_id % 50 = 0)
SELECT file_id, row_number() OVER (ORDER BY min(n)) AS position FROM (SELECT * FROM top UNION ALL SELECT * FROM p) GROUP BY file_id""", "rec imp", recursive=True)
def priority_list(spark, d):
    """The 15 most imported files, then a plan's files, each once where it comes first."""
    rec = materialize(records(spark, d), "rec")
    most = linked(spark, d, rec).groupBy(F.col("to_file").alias("file_id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "file_id").limit(15)
    top = most.select("file_id", F.row_number().over(Window.orderBy(F.desc("n"), "file_id")).alias("n"))  # 15 rows
    plan = rec.where("file_id % 50 = 0").select("file_id", (F.lit(100) + F.row_number().over(Window.orderBy("file_id"))).alias("n"))  # a plan's list
    first = top.union(plan).groupBy("file_id").agg(F.min("n").alias("n"))
    return first.select("file_id", F.row_number().over(Window.orderBy("n")).cast("long").alias("position"))


@query("SELECT path FROM (SELECT DISTINCT path FROM files WHERE path IS NOT NULL AND NOT regexp_matches(path, '(^|/)\\.')) ORDER BY path LIMIT 200")
def layout_listing(spark, d):
    return table(spark, d, "files", "path").where(F.col("path").isNotNull() & ~F.col("path").rlike(r"(^|/)\.")).distinct().orderBy("path").limit(200)


@query("SELECT dir, name, is_dir FROM (SELECT DISTINCT string_split(path, '/')[1] AS dir, string_split(path, '/')[2] AS name, len(string_split(path, '/')) > 2 AS is_dir FROM files WHERE path IS NOT NULL AND contains(path, '/'))")
def dir_listing(spark, d):
    parts = F.split("path", "/")
    f = table(spark, d, "files", "path").where("path IS NOT NULL AND contains(path, '/')")
    return f.select(parts[0].alias("dir"), parts[1].alias("name"), (F.size(parts) > 2).alias("is_dir")).distinct()


@query(r""", s AS (SELECT file_id, i - 1 AS ordinal, s.name AS name, regexp_extract(regexp_replace(string_split_regex(trim(trim(coalesce(s.receiver, '')), '()'), '\s+')[-1], '^\*', ''), '([^.]*)$', 1) AS r FROM (SELECT file_id, unnest(x.symbols) AS s, unnest(range(1, len(x.symbols) + 1)) AS i FROM rec) WHERE s.kind IN ('function', 'method') AND s.name IS NOT NULL),
n AS (SELECT *, CASE WHEN ordinal = min(ordinal) OVER (PARTITION BY file_id, name) THEN name WHEN r <> '' THEN r || '.' || name END AS node FROM s) SELECT file_id, node, max(ordinal) AS ordinal FROM n WHERE node IS NOT NULL GROUP BY file_id, node""", "rec")
def graph_nodes(spark, d):
    return codegraph.nodes(records(spark, d)).select("file_id", "node", F.col("ordinal").cast("long").alias("ordinal"))


@query("SELECT q.file_id, q.name, s.file_id AS to_file, s.ordinal, q.file_id = s.file_id AS own FROM (SELECT DISTINCT file_id, name FROM sym WHERE ordinal = 0 AND name IS NOT NULL AND file_id % 100 = 0) q JOIN sym s ON s.name = q.name", "rec sym")
def name_lookup(spark, d):
    s = codegraph.symbols(records(spark, d))
    asked = s.where("ordinal = 0 AND name IS NOT NULL AND file_id % 100 = 0").select("file_id", "name").distinct()
    return codegraph.lookup(asked, s).select("file_id", "name", "to_file", F.col("ordinal").cast("long").alias("ordinal"), "own")


@query("SELECT callee, file_id, caller FROM (SELECT *, row_number() OVER (PARTITION BY callee ORDER BY file_id, caller) AS n FROM wi WHERE callee <> '') WHERE n <= 20", "rec sym cal wi")
def callers_of(spark, d):
    """Up to 20 callers of each name, a limit of the report."""
    rec = records(spark, d)
    c = codegraph.enclosing(codegraph.calls(rec), codegraph.symbols(rec)).select("file_id", "caller", T.last_segment(F.col("callee")).alias("callee")).where("callee <> ''").distinct()
    return dedup.top_per_group(c, ["callee"], [F.asc("file_id"), F.asc("caller")], 20).select("callee", "file_id", "caller")


@query("SELECT file_id, caller, string_agg(callee, ',' ORDER BY callee) AS callees FROM wi GROUP BY file_id, caller", "rec sym cal wi")
def callees_of(spark, d):
    rec = records(spark, d)
    c = codegraph.enclosing(codegraph.calls(rec), codegraph.symbols(rec)).select("file_id", "caller", T.last_segment(F.col("callee")).alias("callee")).distinct()
    return c.groupBy("file_id", "caller").agg(F.array_join(F.sort_array(F.collect_set("callee")), ",").alias("callees"))


@query("SELECT file_id, ordinal, sha256(array_to_string(string_split(content, chr(10))[start_line : least(end_line, len(string_split(content, chr(10))))], chr(10))) AS body FROM sym JOIN files USING (file_id) WHERE content IS NOT NULL AND start_line BETWEEN 1 AND len(string_split(content, chr(10))) AND end_line >= start_line", "rec sym")
def symbol_bodies(spark, d):
    """Each symbol's lines, cut to the file's end; a file's text is cut in place."""
    f = records(spark, d).select("file_id", "symbols").join(contents(spark, d), "file_id").withColumn("lines", F.split("content", "\n"))
    inside = F.filter(F.transform("symbols", lambda s, i: F.struct(i.cast("long").alias("i"), s["start_line"].alias("a"), F.least(s["end_line"], F.size("lines")).alias("b"))), lambda x: (x["a"] >= 1) & (x["a"] <= F.size("lines")) & (x["b"] >= x["a"]))
    cut = F.transform(inside, lambda x: F.struct(x["i"].alias("ordinal"), F.sha2(F.array_join(F.slice("lines", x["a"], x["b"] - x["a"] + 1), "\n"), 256).alias("body")))
    return f.select("file_id", F.explode(cut).alias("c")).select("file_id", "c.*")


@query(""", g AS (SELECT DISTINCT file_id AS chunk, file_id, callee AS name FROM wi), pl AS (SELECT DISTINCT file_id, file_id AS to_file, 0 AS near FROM g UNION ALL SELECT file_id, to_file, 1 FROM lk WHERE file_id <> to_file)
SELECT chunk, name, to_file, near FROM (SELECT g.chunk, g.name, pl.to_file, pl.near, row_number() OVER (PARTITION BY g.chunk, g.name ORDER BY pl.near, pl.to_file) AS n FROM g JOIN pl USING (file_id) JOIN (SELECT DISTINCT file_id AS to_file, name FROM sym) s ON s.to_file = pl.to_file AND s.name = g.name) WHERE n = 1""", "rec sym cal imp wi", recursive=True)
def referenced_definitions(spark, d):
    """The names that each file's functions call, with the file that defines them: the own one, else the first imported one."""
    rec = materialize(records(spark, d), "rec")
    c = codegraph.enclosing(codegraph.calls(rec), codegraph.symbols(rec)).select(F.col("file_id").alias("chunk"), "file_id", T.last_segment(F.col("callee")).alias("name")).distinct()
    return codegraph.referenced(c, codegraph.symbols(rec), linked(spark, d, rec))


@query("SELECT place, ordinal, name, distance, rank FROM (SELECT p.finding_id AS place, s.ordinal, s.name, greatest(s.start_line - p.start_line, p.start_line - s.end_line, 0) AS distance, row_number() OVER (PARTITION BY p.finding_id ORDER BY greatest(s.start_line - p.start_line, p.start_line - s.end_line, 0), s.ordinal) AS rank FROM findings p JOIN (SELECT path, min(file_id) AS file_id FROM files GROUP BY path) f ON f.path = p.file JOIN sym s ON s.file_id = f.file_id AND s.start_line <= s.end_line WHERE greatest(s.start_line - p.start_line, p.start_line - s.end_line, 0) > 0) WHERE rank <= 3", "rec sym")
def sibling_symbols(spark, d):
    first = table(spark, d, "files", "path", "file_id").groupBy("path").agg(F.min("file_id").alias("file_id"))
    at = table(spark, d, "findings", "finding_id", "file", "start_line").join(first, F.col("file") == F.col("path")).select(F.col("finding_id").alias("place"), "file_id", F.col("start_line").alias("line"))
    got = codegraph.siblings(codegraph.symbols(records(spark, d)), at, 3)
    return got.select("place", F.col("ordinal").cast("long").alias("ordinal"), "name", "distance", F.col("rank").cast("long").alias("rank"))


@query("""SELECT c.file_id, c.path || '#' || c.w || '@' || (c.w * 120) AS chunk_key, p.n IS NOT NULL AS packed FROM (SELECT file_id, path, CAST(unnest(range(0, (len(string_split(content, chr(10))) - 1) // 120 + 1)) AS INT) AS w FROM files WHERE content IS NOT NULL AND path IS NOT NULL) c
LEFT JOIN (SELECT path, count(*) AS n FROM findings JOIN (SELECT DISTINCT path FROM files) ON path = file WHERE verified GROUP BY path) p ON p.path = c.path AND c.w = 0""")
def chunks_with_packs(spark, d):
    """Chunks by their key (path, number, offset), with what was collected for them, if anything."""
    f = contents(spark, d, "path").where("path IS NOT NULL")
    w = f.select("file_id", "path", F.explode(F.sequence(F.lit(0), F.floor((F.size(F.split("content", "\n")) - 1) / 120).cast("int"))).alias("w"))
    key = lambda path, n: F.concat(path, F.lit("#"), n.cast("string"), F.lit("@"), (n * 120).cast("string"))
    packs = table(spark, d, "findings", "file", "verified").where("verified").select(key(F.col("file"), F.lit(0)).alias("chunk_key")).distinct().withColumn("packed", F.lit(True))
    return w.select("file_id", key(F.col("path"), F.col("w")).alias("chunk_key")).join(packs, "chunk_key", "left").select("file_id", "chunk_key", F.coalesce("packed", F.lit(False)).alias("packed"))


@query("""SELECT f.file_id, CASE WHEN coalesce(len(list_filter(r.x.symbols, lambda s: s.start_line <= s.end_line)), 0) > 0 THEN 'symbols' ELSE 'whole' END AS mode FROM files f LEFT JOIN rec r USING (file_id) WHERE f.content IS NOT NULL""", "rec")
def chunk_modes(spark, d):
    """Files without usable symbols are one chunk, the others are cut at their symbols."""
    some = records(spark, d).where(F.size(F.filter("symbols", lambda s: s["start_line"] <= s["end_line"])) > 0).select("file_id", F.lit("symbols").alias("mode"))
    return contents(spark, d).select("file_id").join(some, "file_id", "left").select("file_id", F.coalesce("mode", F.lit("whole")).alias("mode"))


_KINDS = ("callee", "caller", "type", "sanitizer", "const", "rag", "sibling")
WITH["fr"] = "fr AS (SELECT *, repeat('x', CAST(tokens % 7 AS INT) + 1) || ordinal AS code, CASE WHEN ordinal % 3 = 0 THEN '' ELSE 's' || ordinal END AS symbol, CAST((ordinal // 10) % 7 AS INT) AS kind, CASE WHEN (ordinal // 10) % 4 = 0 THEN '' ELSE 'r' || ((ordinal // 10) % 4) END AS reason FROM frag)"


@query(f""", i AS (SELECT *, CASE WHEN max(end_line) OVER (PARTITION BY chunk_id, file_id ORDER BY start_line, end_line, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= start_line THEN 0 ELSE 1 END AS fresh FROM fr), j AS (SELECT *, sum(fresh) OVER (PARTITION BY chunk_id, file_id ORDER BY start_line, end_line, ordinal ROWS UNBOUNDED PRECEDING) AS island FROM i)
SELECT chunk_id, file_id, min(start_line) AS start_line, max(end_line) AS end_line, min(priority) AS priority, first(code ORDER BY length(code) DESC, start_line, end_line, ordinal) AS code, coalesce(first(symbol ORDER BY start_line, end_line, ordinal) FILTER (symbol <> ''), '') AS symbol, {list(_KINDS)}[min(kind) + 1] AS kind,
CASE WHEN count(DISTINCT reason) > 1 THEN array_to_string(list_sort(list_distinct(list(reason) FILTER (reason <> ''))), ' + ') ELSE min(reason) END AS reason FROM j GROUP BY chunk_id, file_id, island""", "frag fr")
def merged_fragments(spark, d):
    """Overlapping fragments of a file as one: the longest code, the first symbol, the foremost kind, all reasons."""
    n = F.floor(F.col("ordinal") / 10)
    f = fragments(spark, d).withColumns({"code": F.concat(F.repeat(F.lit("x"), (F.col("tokens") % 7).cast("int") + 1), F.col("ordinal").cast("string")), "symbol": F.when(F.col("ordinal") % 3 == 0, "").otherwise(F.concat(F.lit("s"), F.col("ordinal").cast("string"))), "kind": (n % 7).cast("int"), "reason": F.when(n % 4 == 0, "").otherwise(F.concat(F.lit("r"), (n % 4).cast("string")))})
    first = F.struct("start_line", "end_line", "ordinal")
    some = F.collect_set(F.when(F.col("reason") != "", F.col("reason")))
    several = F.size(F.collect_set("reason")) > 1
    aggregates = [
        F.min("priority").alias("priority"), F.min_by("code", F.struct(-F.length("code"), *("start_line", "end_line", "ordinal"))).alias("code"), F.coalesce(F.min_by(F.when(F.col("symbol") != "", F.col("symbol")), F.when(F.col("symbol") != "", first)), F.lit("")).alias("symbol"),
        F.element_at(F.array(*(F.lit(k) for k in _KINDS)), F.min("kind") + 1).alias("kind"), F.when(several, F.array_join(F.sort_array(some), " + ")).otherwise(F.min("reason")).alias("reason"),
    ]
    return windows.merge_intervals(f, ["chunk_id", "file_id"], "start_line", "end_line", aggregates).drop("island")


@query("""SELECT file_id, start_line, end_line, symbol FROM (SELECT file_id, start_line, least(end_line, len(string_split(content, chr(10)))) AS end_line, name AS symbol, array_to_string(string_split(content, chr(10))[start_line : end_line], chr(10)) AS body FROM sym JOIN files USING (file_id) WHERE content IS NOT NULL AND start_line BETWEEN 1 AND len(string_split(content, chr(10))) AND end_line >= start_line) WHERE regexp_replace(body, '[\\s\\x0b]', '', 'g') <> ''
UNION ALL SELECT f.file_id, w * 120 + 1, least((w + 1) * 120, len(l)), NULL FROM (SELECT file_id, string_split(content, chr(10)) AS l, CAST(unnest(range(0, (len(string_split(content, chr(10))) - 1) // 120 + 1)) AS INT) AS w FROM files WHERE content IS NOT NULL) f LEFT JOIN rec r USING (file_id) WHERE coalesce(len(r.x.symbols), 0) = 0 AND regexp_replace(array_to_string(l[w * 120 + 1 : (w + 1) * 120], chr(10)), '[\\s\\x0b]', '', 'g') <> ''""", "rec sym")
def symbol_chunks(spark, d):
    """Chunks for retrieval: a file's symbols, or windows of 120 lines where it has none; blank ones are left out."""
    f = contents(spark, d).join(records(spark, d).select("file_id", "symbols"), "file_id", "left").withColumn("n", F.coalesce(F.size("symbols"), F.lit(0)))
    return windows.symbol_chunks(f.where("n > 0"), "file_id", "content", "symbols").union(windows.line_windows(f.where("n <= 0").select("file_id", "content"), ["file_id"], "content", 120).select("file_id", F.col("first_line").cast("int"), F.col("last_line").cast("int"), F.lit(None).cast("string")))


@query("SELECT finding_id, array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i), ',') AS words FROM (SELECT finding_id, regexp_extract_all(lower(coalesce(title, '')), '[a-z_]+') AS t FROM findings)")
def unique_in_order(spark, d):
    f = table(spark, d, "findings", "finding_id", "title")
    return f.select("finding_id", F.array_join(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("title", F.lit(""))), F.lit("[a-z_]+"), 0)), ",").alias("words"))


@query("SELECT ordinal, agent, 0 AS scanner FROM v WHERE agent = 'auth' UNION ALL SELECT ordinal, agent, 1 FROM v WHERE agent = 'crypto' UNION ALL SELECT ordinal, agent, 2 FROM v WHERE agent LIKE 'iac%'", "v")
def union_of_scanners(spark, d):
    f = findings(spark, d, "agent")
    parts = [f.where("agent = 'auth'"), f.where("agent = 'crypto'"), f.where("agent LIKE 'iac%'")]
    return joins.all_of(parts, "scanner")


_RATES = [("m-a", 3.0, 15.0), ("default", 1.0, 2.0)]


@query("SELECT stage, model, calls, tokens_in, tokens_out, round((tokens_in * CASE model WHEN 'm-a' THEN 3.0 ELSE 1.0 END + tokens_out * CASE model WHEN 'm-a' THEN 15.0 ELSE 2.0 END) / 1000000, 9)::DOUBLE AS usd, row_number() OVER (ORDER BY (tokens_in * CASE model WHEN 'm-a' THEN 3.0 ELSE 1.0 END + tokens_out * CASE model WHEN 'm-a' THEN 15.0 ELSE 2.0 END) DESC, tokens_in + tokens_out DESC, stage, model) AS position FROM (SELECT stage, model, count(*) AS calls, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out FROM calls GROUP BY stage, model)", "calls")
def usage_cost(spark, d):
    """Usage with its cost by a rate table with a default, dearest first."""
    from fernglass.plans.catalogue import calls

    u = calls(spark, d).groupBy("stage", "model").agg(F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))
    priced = joins.with_default(u, spark.createDataFrame(_RATES, "model string, in_rate double, out_rate double"), "model", ["in_rate", "out_rate"])
    priced = priced.withColumn("cost", F.col("tokens_in") * F.col("in_rate") + F.col("tokens_out") * F.col("out_rate"))
    w = Window.orderBy(F.desc("cost"), (F.col("tokens_in") + F.col("tokens_out")).desc(), "stage", "model")  # a row per stage and model
    return priced.select("stage", "model", "calls", "tokens_in", "tokens_out", F.round(F.col("cost") / 1_000_000, 9).alias("usd"), F.row_number().over(w).cast("long").alias("position"))


@query("SELECT coalesce(a.file_id, b.to_file) AS file_id, coalesce(n, 0) AS imports, coalesce(m, 0) AS importers FROM (SELECT file_id, count(*) AS n FROM lk GROUP BY file_id) a FULL JOIN (SELECT to_file, count(*) AS m FROM lk GROUP BY to_file) b ON a.file_id = b.to_file", "rec imp", recursive=True)
def file_links(spark, d):
    """How many files each file imports, and how many import it: one pass over both ends of the links."""
    links = linked(spark, d, materialize(records(spark, d), "rec"))
    ends = links.select(F.explode(F.array(F.struct(F.col("file_id").alias("f"), F.lit(1).alias("o")), F.struct(F.col("to_file").alias("f"), F.lit(0).alias("o")))).alias("e"))
    return ends.groupBy(F.col("e.f").alias("file_id")).agg(F.sum(F.col("e.o").cast("long")).alias("imports"), F.sum((1 - F.col("e.o")).cast("long")).alias("importers"))


@query("""SELECT rule, first(title ORDER BY sr DESC, cr DESC, score DESC, file, start_line, ordinal) AS name, count(*) AS results FROM (SELECT *, CASE WHEN rule_id <> '' THEN rule_id ELSE agent || '/' || trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') END AS rule FROM r WHERE NOT false_positive) GROUP BY rule""", "v r")
def sarif_rules(spark, d):
    """The rules of a report, each named by its first finding in canonical order."""
    return sinks.sarif_rules(findings(spark, d))


@query("SELECT ordinal, json_object('ruleId', CASE WHEN rule_id <> '' THEN rule_id ELSE agent || '/' || trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') END, 'level', CASE WHEN lower(trim(severity)) IN ('critical', 'high') THEN 'error' WHEN lower(trim(severity)) = 'medium' THEN 'warning' ELSE 'note' END, 'uri', file, 'startLine', greatest(start_line, 1), 'endLine', greatest(end_line, 1)) AS result FROM v WHERE NOT false_positive", "v")
def sarif_objects(spark, d):
    """The results of a SARIF document, read back out of their JSON text."""
    r = sinks.sarif_results(findings(spark, d)).select("ordinal", F.from_json("result", "ruleId string, level string, locations array<struct<physicalLocation struct<artifactLocation struct<uri string>, region struct<startLine int, endLine int>>>>").alias("j"))
    place = F.col("j.locations")[0]["physicalLocation"]
    return r.select("ordinal", F.to_json(F.struct("j.ruleId", "j.level", place["artifactLocation"]["uri"].alias("uri"), place["region"]["startLine"].alias("startLine"), place["region"]["endLine"].alias("endLine"))).alias("result"))


@query("SELECT line FROM (SELECT 'digraph G {' AS line UNION ALL SELECT DISTINCT '  \"' || src || '\";' FROM (SELECT src FROM edges UNION SELECT dst FROM edges) UNION ALL SELECT DISTINCT '  \"' || src || '\" -> \"' || dst || '\";' FROM edges UNION ALL SELECT '}')", "edges")
def dot_document(spark, d):
    return sinks.dot_document(edges(spark, d)).select("line")


@query("SELECT ordinal, '[' || upper(CASE WHEN lower(trim(severity)) IN ('critical', 'high', 'medium', 'low', 'info') THEN lower(trim(severity)) ELSE 'other' END) || '] ' || title || ' (' || file || ':' || start_line || ')' AS line FROM v WHERE NOT false_positive AND NOT suppressed", "v")
def report_lines(spark, d):
    return sinks.report_lines(findings(spark, d, "severity", "title", "file", "start_line", "false_positive", "suppressed").where("NOT false_positive AND NOT suppressed"))


@query("SELECT file, string_agg(DISTINCT c, ',' ORDER BY c) AS categories FROM (SELECT file, unnest(tags) AS c FROM v WHERE len(trace) > 0) GROUP BY file", "v")
def path_categories(spark, d):
    f = findings(spark, d, "file", "tags", "trace").where("size(trace) > 0").select("file", F.explode("tags").alias("c"))
    return f.groupBy("file").agg(F.array_join(F.sort_array(F.collect_set("c")), ",").alias("categories"))


@query(CALIBRATION + """, k AS (SELECT x, n, hits, CASE WHEN x <= 0.2 THEN 0.1 WHEN x >= 0.9 THEN 0.8 WHEN x <= 0.6 THEN 0.1 + (x - 0.2) / 0.4 * 0.4 ELSE 0.5 + (x - 0.6) / 0.3 * 0.3 END AS p FROM s) SELECT round(sum(hits * (p - 1) * (p - 1) + (n - hits) * p * p) / sum(n), 9)::DOUBLE AS brier, CAST(sum(n) AS BIGINT) AS samples FROM k""", "v")
def brier_score(spark, d):
    """The mean squared error of calibrated scores, from their pooled counts."""
    f, t = labelled(spark, d)
    pooled = evaluate.pool_scores(evaluate.samples(f, t, ["file", "cwe"]))
    return evaluate.brier(pooled, evaluate.interpolated(F.col("x"), [(0.2, 0.1), (0.6, 0.5), (0.9, 0.8)])).select(F.round("brier", 9).alias("brier"), "samples")


@query("""SELECT provider, model, count(*) AS asked, CAST(count(vec_id) AS BIGINT) AS hits, CAST(count(*) - count(vec_id) AS BIGINT) AS misses FROM (SELECT DISTINCT chunk_key, m.provider, m.model FROM rag_chunks, (SELECT DISTINCT provider, model FROM embedding_cache) m WHERE chunk_key IS NOT NULL) q LEFT JOIN embedding_cache e USING (chunk_key, provider, model) GROUP BY provider, model""")
def vector_cache_lookups(spark, d):
    """Vectors looked up by key, provider and model, with the counts of hits and misses."""
    e = table(spark, d, "embedding_cache", "vec_id", "chunk_key", "provider", "model")
    asked = table(spark, d, "rag_chunks", "chunk_key").where("chunk_key IS NOT NULL").distinct()
    total = F.lit(asked.count())
    hits = asked.join(e.where("chunk_key IS NOT NULL"), "chunk_key").groupBy("provider", "model").agg(F.countDistinct("chunk_key").alias("hits"))
    kinds = e.select("provider", "model").where("provider IS NOT NULL AND model IS NOT NULL").distinct()
    n = F.coalesce("hits", F.lit(0))
    return kinds.join(hits, ["provider", "model"], "left").select("provider", "model", total.alias("asked"), n.alias("hits"), (total - n).alias("misses"))
