"""Queries over packs, budgets, examples and flows, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fernglass.functions import text as T
from fernglass.operators import codegraph, flows, packs, retrieval, windows
from fernglass.plans.catalogue import fragments, query
from fernglass.plans.code import contents, linked, records
from fernglass.session import materialize
from fernglass.sources import syntax
from fernglass.sources.tables import table

_ADMIT = """, o AS (SELECT chunk_id, ordinal, tokens, {squeeze} AS q, row_number() OVER (PARTITION BY chunk_id ORDER BY priority, tokens, ordinal) AS n FROM frag),
a AS (SELECT chunk_id, ordinal, n, {grant} AS granted, {budget} - {grant} AS lft FROM (SELECT *, {budget} AS lft FROM o WHERE n = 1) UNION ALL SELECT o.chunk_id, o.ordinal, o.n, {step}, a.lft - {step} FROM a JOIN o ON o.chunk_id = a.chunk_id AND o.n = a.n + 1)
SELECT chunk_id, ordinal, granted FROM a WHERE granted > 0"""


def _admit(budget: int, floor: int, squeeze: str = "true", least: int = 0) -> str:
    rule = "CASE WHEN {l} <= " + str(least) + " THEN 0 WHEN {o}tokens <= {l} THEN {o}tokens WHEN {l} >= " + str(floor) + " AND {o}q THEN {l} ELSE 0 END"
    return _ADMIT.format(budget=budget, squeeze=squeeze, grant=rule.format(l="lft", o=""), step=rule.format(l="a.lft", o="o."))


@query(_admit(8000, 50), "frag", recursive=True)
def budget_admission(spark, d):
    f = fragments(spark, d)
    return packs.admitted(f, "chunk_id", ["priority", "tokens"], "tokens", "ordinal", 8000, 50)


@query(_admit(6000, 400, "priority <= 2", 100), "frag", recursive=True)
def pack_admission(spark, d):
    """As a pack is filled: nothing into the last 100 tokens, and only foremost fragments squeezed, if 400 are left."""
    f = fragments(spark, d).withColumn("foremost", F.col("priority") <= 2)
    return packs.admitted(f, "chunk_id", ["priority", "tokens"], "tokens", "ordinal", 6000, 400, "foremost", 100)


@query("SELECT chunk_id, CAST(sum(tokens) AS BIGINT) AS tokens, sum(tokens) > 4800 * 50 AS overflow FROM frag GROUP BY chunk_id", "frag")
def pack_overflow(spark, d):
    t = fragments(spark, d).groupBy("chunk_id").agg(F.sum("tokens").alias("tokens"))
    return t.select("chunk_id", "tokens", packs.overflows(F.col("tokens"), 8000 * 50).alias("overflow"))


@query("SELECT f.chunk_id, f.ordinal FROM frag f JOIN (SELECT chunk_id, unnest(min({'o': ordinal, 'file_id': file_id, 'start_line': start_line, 'end_line': end_line})) FROM frag GROUP BY chunk_id) c USING (chunk_id) WHERE NOT (f.file_id = c.file_id AND f.start_line <= c.end_line AND f.end_line >= c.start_line)", "frag")
def fragments_outside(spark, d):
    f = materialize(fragments(spark, d).select("chunk_id", "ordinal", "file_id", "start_line", "end_line"), "fragments")
    c = f.groupBy("chunk_id").agg(F.min(F.struct("ordinal", "file_id", "start_line", "end_line")).alias("c")).select("chunk_id", "c.*")
    return packs.outside(f, c, "chunk_id").select("chunk_id", "ordinal")


@query(f"SELECT chunk_id, sha256(string_agg('// ' || k || ' ' || ordinal, chr(10) ORDER BY p, priority, ordinal)) AS text FROM (SELECT *, {list(packs.KINDS)}[CAST((ordinal // 10) % 7 AS INT) + 1] AS k, CAST((ordinal // 10) % 7 AS INT) + 1 AS p FROM frag) GROUP BY chunk_id", "frag")
def rendered_packs(spark, d):
    kind = F.element_at(F.array(*(F.lit(k) for k in packs.KINDS)), (F.floor(F.col("ordinal") / 10) % 7).cast("int") + 1)
    f = fragments(spark, d).withColumn("kind", kind)
    got = packs.rendered(f, "chunk_id", "kind", ["priority", "ordinal"], F.concat(F.lit("// "), F.col("kind"), F.lit(" "), F.col("ordinal").cast("string")))
    return got.select("chunk_id", F.sha2("text", 256).alias("text"))


@query("SELECT repo, path, used FROM (SELECT repo, path, file_id, CAST(sum(strlen(content)) OVER (PARTITION BY repo ORDER BY path, file_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM files WHERE content IS NOT NULL AND repo IS NOT NULL AND path IS NOT NULL) WHERE used <= 60000")
def corpus_within_bytes(spark, d):
    """The leading files of each repo whose bytes fit a budget, for a summary of it."""
    f = contents(spark, d, "repo", "path").where("repo IS NOT NULL AND path IS NOT NULL").select("repo", "path", "file_id", F.octet_length("content").alias("bytes"))
    return windows.within_budget(f, ["repo"], [F.asc("path"), F.asc("file_id")], F.col("bytes"), 60_000).select("repo", "path", "used")


_G = lambda t: f"list_distinct(flatten(list_transform(list_filter(string_split_regex(regexp_replace(lower(coalesce({t}, '')), '[^a-z0-9_]', ' ', 'g'), ' +'), lambda w: w <> ''), lambda w: CASE WHEN length(w) < 3 THEN [w] ELSE list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3)) END)))"


_SPOKEN = "CASE item_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'DE' ELSE '' END"


@query(f"""SELECT query, id, round(x / (n + m - x)::DOUBLE, 9) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY x / (n + m - x)::DOUBLE DESC, id) AS rank FROM (SELECT q.doc_id AS query, c.item_id AS id, count(*) AS x, any_value(q.n) AS n, any_value(c.n) AS m FROM (SELECT doc_id, lang, len(g) AS n, unnest(g) AS w FROM (SELECT doc_id, lang, {_G('text')} AS g FROM documents WHERE doc_id % 100 = 0)) q
JOIN (SELECT item_id, lang, len(g) AS n, unnest(g) AS w FROM (SELECT item_id, {_SPOKEN} AS lang, {_G('text')} AS g FROM eval_items)) c ON c.w = q.w AND (coalesce(q.lang, '') = '' OR c.lang = '' OR lower(q.lang) = lower(c.lang)) GROUP BY ALL)) WHERE rank <= 3""")
def few_shot_topk(spark, d):
    """Examples of the query's language (or of none) that share most of its 3-grams, as examples are picked for a prompt."""
    spoken = F.when(F.col("item_id") % 3 == 0, "en").when(F.col("item_id") % 3 == 1, "DE").otherwise("")
    bank = table(spark, d, "eval_items", "item_id", "text").withColumn("lang", spoken)
    q = table(spark, d, "documents", "doc_id", "text", "lang").where("doc_id % 100 = 0").select(F.col("doc_id").alias("q_id"), F.col("text").alias("q_text"), F.col("lang").alias("q_lang"))
    got = retrieval.shingle_topk(bank, q, 3, "item_id", "text", "q_id", "q_text", language="lang", query_language="q_lang")
    return got.select("query", "id", F.round("score", 9).alias("score"), "rank")


@query("SELECT file_id, sha256(CASE WHEN len(l) <= 40 THEN array_to_string(l, chr(10)) ELSE array_to_string(list_concat(list_append(l[1:20], '... ' || (len(l) - 40) || ' lines ...'), l[-20:]), chr(10)) END) AS content FROM (SELECT file_id, string_split(content, chr(10)) AS l FROM files WHERE content IS NOT NULL)")
def squeezed_files(spark, d):
    """The first and last lines of long texts, cut in place."""
    f = contents(spark, d).withColumn("l", F.split("content", "\n"))
    note = F.array(F.concat(F.lit("... "), (F.size("l") - 40).cast("string"), F.lit(" lines ...")))
    cut = F.when(F.size("l") <= 40, F.col("l")).otherwise(F.concat(F.slice("l", 1, 20), note, F.slice("l", -20, 20)))
    return f.select("file_id", F.sha2(F.array_join(cut, "\n"), 256).alias("content"))


@query("""SELECT q.file_id, count(*) AS kept, count(*) FILTER (r.score >= 2) AS good FROM (SELECT file_id, i, score FROM (SELECT file_id, ordinal AS i, length(name) % 4 AS score FROM sym WHERE name IS NOT NULL)) r JOIN (SELECT DISTINCT file_id FROM sym) q USING (file_id) WHERE r.score >= 2 OR (NOT EXISTS (SELECT 1 FROM sym s WHERE s.file_id = q.file_id AND length(s.name) % 4 >= 2) AND r.i < 3) GROUP BY q.file_id""", "rec sym")
def kept_candidates(spark, d):
    """Candidates that a filter keeps; where it keeps none of a group, the first three."""
    s = codegraph.symbols(records(spark, d)).where("name IS NOT NULL").select("file_id", F.col("ordinal").alias("i"), (F.length("name") % 4).alias("score"))
    return retrieval.kept_or_first(s, "file_id", F.col("score") >= 2, "i", 3).groupBy("file_id").agg(F.count("*").alias("kept"), F.sum((F.col("score") >= 2).cast("long")).alias("good"))


@query()
def parsed_files(spark, d):
    """Symbols, imports and calls read out of the files themselves, counted by language."""
    p = syntax.parsed(table(spark, d, "files", "file_id", "path", "content"))
    return p.groupBy("language").agg(F.count("*").alias("files"), *(F.sum(F.size(c)).alias(c) for c in ("imports", "symbols", "calls")))


SINKS, CLEANERS = ("flush", "publish", "submit"), ("validate", "trim", "check")


def _functions(spark, d):
    f = records(spark, d).select("file_id", "path", "symbols").join(contents(spark, d), "file_id").withColumn("l", F.split("content", "\n"))
    part = lambda s: F.slice("l", s["start_line"], F.least(s["end_line"], F.size("l")) - s["start_line"] + 1)
    usable = F.filter("symbols", lambda s: s["kind"].isin("function", "method") & s["name"].isNotNull() & (s["start_line"] >= 1) & (s["start_line"] <= F.least(s["end_line"], F.size("l"))))
    rows = F.transform(usable, lambda s: F.struct(s["name"].alias("function"), s["start_line"].alias("start_line"), part(s).alias("body")))
    return f.select("file_id", T.parser_language(F.col("path")).alias("language"), F.explode(rows).alias("r")).select("file_id", "language", "r.*")


@query()
def function_summaries(spark, d):
    """What each function does with its parameters, counted by kind."""
    s = flows.summaries(_functions(spark, d), SINKS, CLEANERS)
    return s.groupBy("what", "cleaned", "guarded").agg(F.count("*").alias("n"))


@query()
def cross_function_flows(spark, d):
    """Paths of at most four calls from the first function of each file to a sink."""
    rec = materialize(records(spark, d), "rec")
    symbols = codegraph.symbols(rec)
    calls = codegraph.resolve_calls(codegraph.enclosing(codegraph.calls(rec), symbols), symbols, linked(spark, d, rec))
    entries = symbols.where("ordinal = 0 AND name IS NOT NULL").select("file_id", F.col("name").alias("function"))
    got = flows.paths(flows.summaries(_functions(spark, d), SINKS, CLEANERS), calls, entries, 4)
    return got.drop("steps")
