import datetime
import random

import pytest
from pyspark.sql import functions as F

from fernglass.functions import text as T
from fernglass.functions import verdicts as W
from fernglass.operators import codegraph, entries, flows, joins, packs, retrieval, rules
from fernglass.streaming.windows import collected_windows, usage_windows


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_parts_of_lines():
    assert flows.indent("\t  x") == 6 and flows.brace_balance('if x { s = "}" + \'{\' {') == 2 and flows.brace_balance("}") == -1
    assert flows.split_list('a, f(b, c), "x,y", [1, 2]') == ["a", "f(b, c)", '"x,y"', "[1, 2]"] and flows.split_list(" ") == []
    assert flows.bracketed("f(a, g(b)) + c", 1) == "a, g(b)" and flows.bracketed("f(a", 1) == "a"


@pytest.mark.parametrize("language, head, want", [
    ("python", "def f(self, a: int, *b, c=g(1, 2), **d) -> X:", ["a", "b", "c", "d"]), ("go", "func (s *T) F(a, b int, c ...string) error {", ["a", "b", "c"]),
    ("java", "public void f(final List<Map<A, B>> a, @N int... b) {", ["a", "b"]), ("typescript", "private f(a: string, b?: number): void {", ["a", "b"]), ("javascript", "function f() {", []), ("go", "x", []),
])
def test_parameters(language, head, want):
    assert flows.parameters(language, head) == want


def test_summaries():
    python = ["def f(a, b, c):", "    x = validate(a)", "    flush(x)", "    y = g(1, b + x)", "    if c > 1:", "        flush(c)", "    flush(c)", "    x = 3", "    flush(x)", "    return y"]
    got = flows.summarised("python", python, 10, ["flush"], ["validate"])
    assert (0, "a", "sink", "flush", 0, 12, True, False) in got and (1, "b", "call", "g", 1, 13, False, False) in got and (0, "a", "call", "g", 1, 13, True, False) in got
    assert (2, "c", "sink", "flush", 0, 15, False, True) in got and (2, "c", "sink", "flush", 0, 16, False, False) in got
    assert not [r for r in got if r[5] == 18] and (1, "b", "return", "", 0, 19, False, False) in got
    go = ["func F(a string) {", "\tif ok(a) {", "\t\tflush(a)", "\t}", "\tflush(a) // b", "}"]
    assert [(r[5], r[7]) for r in flows.summarised("go", go, 1, ["flush"], []) if r[2] == "sink"] == [(3, True), (5, False)]
    assert flows.summarised("python", [], 1, [], []) == []


def test_summary_table(spark):
    df = spark.createDataFrame([(1, "python", "f", 1, ["def f(a):", "    flush(a)"]), (2, None, "g", 1, None)], "file_id long, language string, function string, start_line int, body array<string>")
    assert rows(flows.summaries(df, ["flush"], [])) == [(1, "f", 0, "a", "sink", "flush", 0, 2, False, False)]


def test_paths_against_search(spark):
    rng = random.Random(3)
    summary, calls = [], set()
    for f in range(12):
        for _ in range(3):
            to = rng.randrange(12)
            summary.append((f, f"n{f}", rng.randrange(2), "p", "call", f"n{to}", rng.randrange(2), 1, rng.random() < 0.3, False))
            calls.add((f, f"n{f}", to, f"n{to}"))
        if f % 4 == 3:
            summary.append((f, f"n{f}", 0, "p", "sink", "flush", 0, f, False, False))
    summary = list(dict.fromkeys(summary))
    want = set()

    def walk(start, at, seen, hops, cleaned):
        for f, n, p, _, what, target, k, line, c, _ in summary:
            if (f, p) != at:
                continue
            if what == "sink":
                want.add((start[0], start[1], hops + 2, f, line, cleaned or c, tuple(seen)))
            elif hops < 3:
                to = (int(target[1:]), k)
                if to not in seen:
                    walk(start, to, [*seen, to], hops + 1, cleaned or c)

    for start in {(r[0], r[2]) for r in summary if r[0] < 3}:
        walk(start, start, [start], 0, False)
    s = spark.createDataFrame(summary, flows.SUMMARY)
    c = spark.createDataFrame(sorted(calls), "file_id long, caller string, to_file long, callee string")
    e = spark.createDataFrame([(f, f"n{f}") for f in range(3)], "file_id long, function string")
    got = flows.paths(s, c, e, 3)
    seen = {(r["file_id"], r["param"], r["hops"], r["sink_file"], r["sink_line"], r["cleaned"], tuple((int(x.split(":")[0]), int(x.split(":")[2])) for x in r["steps"])) for r in got.collect()}
    assert seen == want and want
    assert all(0.2 <= r["confidence"] <= 0.87 for r in got.collect()) and flows.paths(s, c, e.where("false"), 3).count() == 0


@pytest.mark.parametrize("floor, least", [(0, 0), (50, 0), (40, 30)])
def test_admission_against_a_loop(spark, floor, least):
    rng = random.Random(floor)
    items = [(k, i, rng.randrange(1, 90), rng.randrange(3), rng.random() < 0.5) for k in "abc" for i in range(40)]
    want = []
    for k in "abc":
        left = 400
        for _, i, s, _, q in sorted((x for x in items if x[0] == k), key=lambda x: (x[3], x[2], x[1])):
            grant = 0 if left <= least else s if s <= left else left if floor and left >= floor and q else 0
            left -= grant
            want += [(k, i, grant)] if grant else []
    df = spark.createDataFrame(items, "k string, i long, s int, p int, q boolean").repartition(3)
    assert rows(packs.admitted(df, "k", ["p", "s"], "s", "i", 400, floor, "q", least)) == sorted(want, key=repr)
    assert packs.admitted(df.where("false"), "k", ["p"], "s", "i", 400, 0).count() == 0


def test_packs(spark):
    f = spark.createDataFrame([(1, 1, 5, 9, "rag", 2, "b"), (1, 1, 20, 30, "callee", 1, "a"), (1, 2, 5, 9, "odd", 1, "c"), (2, 7, 1, 2, "type", 1, None)], "chunk long, file_id long, start_line int, end_line int, kind string, priority int, code string")
    chunks = spark.createDataFrame([(1, 1, 8, 12)], "chunk long, file_id long, start_line int, end_line int")
    assert [r["start_line"] for r in packs.outside(f, chunks, "chunk").orderBy("file_id").collect()] == [20, 5, 1]
    assert dict(rows(packs.rendered(f.where("code IS NOT NULL"), "chunk", "kind", ["priority"], F.col("code")))) == {1: "c\na\nb"}
    assert spark.range(1).select(packs.overflows(F.lit(61), 100), packs.overflows(F.lit(60), 100)).first()[:] == (True, False) and packs.PRESETS["extreme"].budget == 120_000


def test_entry_points(spark):
    symbol = "array<struct<kind string, name string, start_line int, end_line int, receiver string>>"
    recs = [(1, "p/pkg/a.go", [("function", "main", 2, 3, None), ("function", "Open", 4, 4, None), ("function", "h", 5, 5, None)]), (2, "b.py", [("function", "r", 2, 3, None), ("function", "main", 4, 4, None), ("class", "main", 5, 5, None)]), (3, "c.java", [("method", "m", 3, 4, None)]), (4, "d.rs", [("function", "main", 1, 1, None)]), (5, "e.go", None)]
    texts = [(1, "package main\nfunc main() {\n}\nfunc Open() {}\nfunc h(w http.ResponseWriter) {}"), (2, "@app.route('/x')\ndef r():\n    pass\ndef main(): pass\nclass main: pass"), (3, "class C {\n  @GetMapping\n  public void m() {\n  }\n}"), (4, "fn main() {}"), (5, "x")]
    got = entries.entry_points(spark.createDataFrame(recs, f"file_id long, path string, symbols {symbol}"), spark.createDataFrame(texts, "file_id long, content string"), T.parser_language(F.col("path")))
    assert {(r["file_id"], r["name"], r["kind"]) for r in got.collect()} == {(1, "main", "cli"), (1, "Open", "exported"), (1, "h", "http"), (2, "r", "http"), (2, "main", "cli"), (3, "m", "http")}


def test_code_graph(spark):
    imports = spark.createDataFrame([(1, "r/a/x.ts", 0, "../b/y", 1), (1, "r/a/x.ts", 1, "./", 2), (1, "r/a/x.ts", 2, "../../z", 3), (2, "r/m.py", 0, "r.b.w", 1), (2, "r/m.py", 1, "unique", 2), (2, "r/m.py", 2, " ", 3)], "file_id long, path string, import_no int, import string, line int")
    files = spark.createDataFrame([("r/b/y.ts",), ("r/a/index.js",), ("r/b/w.py",), ("q/unique.py",), ("r/b/W.py",), (None,)], "path string")
    assert rows(codegraph.resolve_imports(imports, files)) == [(1, 0, "r/b/y.ts"), (1, 1, "r/a/index.js"), (1, 2, "ext:../../z"), (2, 0, "r/b/W.py"), (2, 1, "q/unique.py")]
    symbol = "array<struct<kind string, name string, start_line int, end_line int, receiver string>>"
    rec = spark.createDataFrame([(1, [("method", "f", 1, 2, "(a *A)"), ("method", "f", 4, 5, "(b *p.B)"), ("method", "f", 7, 8, None), ("class", "K", 9, 9, None)])], f"file_id long, symbols {symbol}")
    assert rows(codegraph.nodes(rec)) == [(1, "B.f", 1, "f"), (1, "f", 0, "f")]
    s = codegraph.symbols(rec).union(spark.createDataFrame([(2, 0, "function", "f", 1, 9)], "file_id long, ordinal int, kind string, name string, start_line int, end_line int"))
    assert {r["own"] for r in codegraph.lookup(spark.createDataFrame([(2, "f")], "file_id long, name string"), s).collect()} == {True, False}
    chunks = spark.createDataFrame([("c", 3, "f"), ("c", 2, "f"), ("d", 3, "f"), ("d", 3, "none")], "chunk string, file_id long, name string")
    links = spark.createDataFrame([(3, 2), (3, 1), (3, 3)], "file_id long, to_file long")
    assert rows(codegraph.referenced(chunks, s, links)) == [("c", "f", 2, 0), ("d", "f", 1, 1)]
    near = codegraph.siblings(s, spark.createDataFrame([(0, 1, 3)], "place long, file_id long, line int"), 2)
    assert rows(near.select("ordinal", "distance", "rank")) == [(0, 1, 1), (1, 1, 2)]


def test_rules(spark):
    df = spark.createDataFrame([(1, "go", "a\nignore[ x ] because  it is \nignore[*]"), (2, "py", None)], "id long, language string, text string")
    got = rules.markers(df, ["id"], "text", r"ignore\[([^\]]+)\](?:\s+because\s+(.*))?")
    assert rows(got) == [(1, 2, "x", "it is"), (1, 3, "*", "")]
    hits = rules.pattern_matches(df, ["id"], "language", "text", [("r1", "go", ("^a$", "(")), ("r2", "py", ("x",)), ("r3", "go", ("[",))])
    assert rows(hits) == [(1, 1, "r1")]
    assert [r[0] for r in rules.of_categories([("a", "", ("X",)), ("b", "", ("y",))], ["x"])] == ["a"]
    calls = spark.createDataFrame([("go", "ps.Bind"), ("go", "Bind"), ("py", "Bind"), ("go", None)], "language string, callee string")
    assert rows(rules.callee_matches(calls, "language", "callee", [("r", "go", ("Bind",))])) == [("go", "Bind", "r"), ("go", "ps.Bind", "r")]


GATES = "struct<control string, reachability string, validation string, api_contract string, environment string, impact string>"


@pytest.mark.parametrize("gates, want", [
    (None, "unknown"), ((None,) * 6, "unknown"), (("pass",) * 6, "confirmed"), (("n/a",) * 6, "inconclusive"), (("PASS", " ok", "yes", "n/a", "NA", "true"), "confirmed"), (("fail", "pass", "fail", "", "", ""), "refuted_defended"),
    (("pass", "blocked", "pass", "", "", "fail"), "refuted_no_control"), (("pass", "pass", "pass", "pass", "pass", "refutes"), "defense_in_depth"), (("pass", "", "pass", "pass", "pass", "pass"), "inconclusive"), (("odd",) * 6, "unknown"),
])
def test_gate_outcomes(spark, gates, want):
    df = spark.createDataFrame([(gates,)], f"g {GATES}")
    assert df.select(W.gate_outcome(F.col("g"))).first()[0] == want


def test_verdict_columns(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    n = F.lit(None).cast("string")
    conf = lambda c, s, v, fp, ver, deep, t, low: one(W.resolved_confidence(F.lit(c), F.lit(s), F.lit(v), F.lit(fp), F.lit(ver), F.lit(deep), F.lit(t), F.lit(low)))
    assert conf("low", "low", True, False, "TP", "", False, False) == "high" and conf("low", "low", True, True, "TP", "", False, False) == "low"
    assert conf("", "critical", False, False, "", "", False, False) == "medium" and conf("", "", False, False, "", "", False, False) == "low"
    assert conf("high", "low", False, False, "", "", True, True) == "medium" and conf("high", "low", True, False, "tp", "Confirmed", True, True) == "high" and conf("high", "low", False, False, "", "confirmed", True, True) == "medium"
    assert one(W.consensus(F.lit("tp"), F.lit("refuted"), F.lit(True), F.lit(False))) == "fp" and one(W.consensus(F.lit("tp"), n, F.lit(True), F.lit(False))) is None
    assert one(W.consensus(F.lit("tp"), F.lit("fp"), F.lit(False), F.lit(False))) is None and one(W.verdict(F.lit(" True Positive "))) == "tp"
    assert one(W.path_confidence(F.lit(2), F.lit(0), F.lit(False))) == 0.85 and one(W.path_confidence(F.lit(40), F.lit(1), F.lit(False))) == 0.2
    assert one(W.has_feedback(F.array().cast("array<string>"), notes=F.lit(" "))) is False and one(W.has_feedback(F.array(F.lit("x")), notes=n)) is True


def test_small_joins(spark):
    df = spark.createDataFrame([(1, True, None), (2, False, True), (3, None, False)], "id long, a boolean, b boolean")
    assert rows(df.select("id", joins.first_step([("x", F.col("a")), ("y", F.col("b"))]))) == [(1, "x"), (2, "y"), (3, "kept")]
    assert rows(joins.flagged(df.select("id", F.lit(False).alias("f")), spark.createDataFrame([(2,), (2,), (None,)], "id long"), "id", "f")) == [(1, False), (2, True), (3, False)]
    assert rows(joins.all_of([df.select("id"), df.where("id = 1").select("id")], "n")) == [(1, 0), (1, 1), (2, 0), (3, 0)]
    c = spark.createDataFrame([("a", 1, 5), ("a", 2, 0), ("b", 3, 0), ("b", 1, 0), ("b", 2, 0)], "g string, o int, s int")
    assert rows(retrieval.kept_or_first(c, "g", F.col("s") > 1, "o", 2).select("g", "o")) == [("a", 1), ("b", 1), ("b", 2)]


def test_stream_with_a_late_row(spark, tmp_path):
    at = lambda h, m=0: datetime.datetime(2025, 1, 1, h, m)
    schema = "ts timestamp, stage string, model string, tokens_in long, ok boolean"
    for n, part in enumerate([[(at(9), "s", "m", 1, True), (at(12), "s", "m", 2, True)], [(at(12, 30), "s", "m", 4, False)], [(at(15), "s", "m", 16, True), (at(9, 5), "s", "m", 8, True)]]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/p{n}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    got = {r["start"].hour: (r["calls"], r["errors"], r["tokens_in"]) for r in collected_windows(usage_windows(stream), ["start", "stage", "model"]).collect()}
    assert got == {9: (1, 0, 1), 12: (2, 1, 6), 15: (1, 0, 16)}  # what came with 15:00 for 9:05 was too late


def test_embedding_by_a_provider(spark):
    import numpy as np

    from fernglass.operators.windows import around_matches, symbol_chunks
    from fernglass.sources.embed import embedded, short_hash

    df = spark.createDataFrame([(i, "ü" * i if i else None) for i in range(7)], "id long, text string")
    got = {r["id"]: r["embedding"] for r in embedded(df, "id", "text", lambda ts: np.array([[len(t), len(ts)] for t in ts]), batch=3, most_bytes=9).collect()}
    assert set(got) == set(range(1, 7)) and [got[i][0] for i in range(1, 7)] == [1, 2, 3, 4, 4, 4] and all(v[1] <= 3 for v in got.values())
    names = [r[0] for r in df.select(short_hash("text")).collect()]
    assert names[0] is None and len(set(names)) == 7 and all(len(n) == 6 for n in names[1:])
    files = spark.createDataFrame([(1, "a\nb\n\nd", [("f", 2, 9), ("g", 3, 3), ("h", 9, 9)]), (2, None, None)], "id long, text string, symbols array<struct<name string, start_line int, end_line int>>")
    assert rows(symbol_chunks(files, "id", "text", "symbols")) == [(1, 2, 4, "f")]
    assert rows(around_matches(files, "id", "text", "^[bd]$", 1, 1)) == [(1, 2, "a\nb\n"), (1, 4, "\nd")]


def test_names_in_all_lists(spark):
    one = lambda *x: spark.createDataFrame([(v,) for v in x], "n string")
    assert rows(joins.in_all(one("b", "a", "a"), [one("a", "b", "c"), one("b", "a")], "n", "other")) == [("a",), ("b",)]
    assert rows(joins.in_all(one("b"), [one("a")], "n", "other")) == [("other",)]
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id long, v string")
    v = spark.createDataFrame([(1, "n"), (3, "m"), (2, None)], "id long, v string")
    assert rows(joins.overridden(df, v, "id", ["v"], "f")) == [(1, "n", True), (2, "y", True), (3, "m", True)]
