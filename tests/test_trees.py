import os
import subprocess

import pytest
from pyspark.sql import functions as F

from fernglass.functions import text as T
from fernglass.sources import caches, documents, sinks, syntax, trees


def names(df, root):
    return sorted(r["path"].removeprefix(str(root) + "/") for r in df.collect())


@pytest.fixture
def tree(tmp_path):
    for name, body in {"a.py": "x = 1\ny = 2\n", "b/c.go": "package c\n", "b/Dockerfile": "FROM x\n", "b/d.txt": "no", "vendor/e.js": "e()", "b/f_test.go": "package c", "big.sql": "x" * 5000, "g.mjs": "g()"}.items():
        path = tmp_path / "t" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body)
    os.symlink(tmp_path / "t" / "a.py", tmp_path / "t" / "link.py")
    return tmp_path / "t"


def test_scan(spark, tree):
    got = trees.scanned(spark, str(tree), exclude=("vendor/", "*_test.go", ""), max_bytes=1000)
    assert names(got, tree) == ["a.py", "b/Dockerfile", "b/c.go"]
    a = got.where(F.col("path").endswith("a.py")).first()
    assert (a["language"], a["content"], a["lines"]) == ("python", "x = 1\ny = 2\n", 3)
    assert names(trees.scanned(spark, str(tree), include=("*.go", "e.?s"), follow_links=True), tree) == ["b/c.go", "b/f_test.go", "vendor/e.js"]
    assert "link.py" in names(trees.scanned(spark, str(tree), follow_links=True), tree)


def test_scan_of_several_roots(spark, tree):
    got = trees.scanned_roots(spark, str(tree), ("b", ".", "b"), max_bytes=1000)
    assert names(got, tree) == ["a.py", "b/Dockerfile", "b/c.go", "b/f_test.go", "vendor/e.js"]
    with pytest.raises(ValueError):
        trees.scanned_roots(spark, str(tree), ("../..",))
    with pytest.raises(ValueError):
        trees.scanned_roots(spark, str(tree), most=2)
    with pytest.raises(FileNotFoundError):
        trees.scanned_roots(spark, str(tree), ("nowhere",))
    one = trees.discovered(spark, str(tree / "b" / "d.txt")).first()
    assert (one["language"], one["content"], one["lines"]) == ("text", "no", 1)
    assert trees.below(str(tree), "b/../a.py") == str(tree / "a.py")


def test_classes_from_names(spark, tmp_path):
    for n in ("CWE89_x.java", "sub/CWE78_y_bad.c", "CWE_z.c", "x.c"):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_text("x")
    assert sorted((os.path.basename(r["file"]), r["cwe"]) for r in trees.named_classes(spark, str(tmp_path)).collect()) == [("CWE78_y_bad.c", "CWE-78"), ("CWE89_x.java", "CWE-89")]


def test_version_control_texts(spark, tmp_path):
    assert trees.split_range("git:a..b") == ("a..b", "git") and trees.split_range("a:b") == ("a:b", None) and trees.split_range("") == ("", None)
    paths = lambda df: sorted(r["path"] for r in df.collect())
    assert paths(trees.changed_in_names(spark, "a.go\r\n\nb/./c.py\na.go\n", "/r")) == ["/r/a.go", "/r/b/c.py"]
    assert paths(trees.changed_in_status(spark, " M a.go\nA  b.py\n D c.js\nR  d.go -> e.go\n?? f.ts\n", "/r")) == ["/r/a.go", "/r/b.py", "/r/e.go", "/r/f.ts"]
    assert paths(trees.changed_in_log(spark, "commit 12ab\nAuthor: x.y\nDate: 1\nsubject:\nsrc/a.go\nsrc/a.go\n", "/r")) == ["/r/src/a.go"]
    blame = trees.blame_porcelain("a" * 40 + " 1 1 1\nauthor Ann\nauthor-time 17\nsummary Fix it\n\tcode\n")
    assert blame == {"commit": "a" * 40, "author": "Ann", "summary": "Fix it", "time": "17"}
    rows = trees.blamed(spark.createDataFrame([("1a2b3c4d (Ann B 2024-05-01T10:00:00 +0000 12) x = 1\r",), ("deadbeef odd",), ("",)], "line string")).collect()
    assert (rows[0]["commit"], rows[0]["author"], rows[0]["date"], rows[0]["at"], rows[0]["text"]) == ("1a2b3c4d", "Ann B", "2024-05-01T10:00:00", "12", "x = 1")
    assert rows[1]["commit"] == "deadbeef" and rows[1]["author"] == "" and rows[2]["commit"] == ""


def test_repository(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *a], cwd=tmp_path, check=True, capture_output=True)
    git("init", "-q", "-b", "main")
    (tmp_path / "a.py").write_text("1")
    git("add", ".")
    git("commit", "-qm", "one")
    (tmp_path / "a.py").write_text("2")
    assert names(trees.changed_files(spark, str(tmp_path)), tmp_path) == ["a.py"] == names(trees.tracked_files(spark, str(tmp_path)), tmp_path)
    (tmp_path / "x").mkdir()
    assert trees.repository_root(str(tmp_path / "x")) == (str(tmp_path), "git") and trees.current_branch(str(tmp_path)) == "main"


@pytest.mark.parametrize("path, want", [("a/./b//../c", "a/c"), ("../x/..", ".."), ("/../a/", "/a"), ("a/..", "."), ("", "."), ("a\\b", "a/b")])
def test_paths(spark, path, want):
    assert spark.range(1).select(T.clean_path(F.lit(path))).first()[0] == want


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.contains_word(F.lit("a.user_id b"), "user")) is False and one(T.contains_word(F.lit("(user)"), "user")) is True
    assert one(T.receiver_name(F.lit("(s *pkg.Service)"))) == "Service" and one(T.receiver_name(F.lit(None).cast("string"))) == ""
    assert one(T.last_segment(F.lit("a.b::Foo[int](x)"))) == "Foo" and one(T.thousands(F.lit(1234567))) == "1,234,567"
    assert one(T.cache_key(F.lit("x:go"), F.lit(None))) != one(T.cache_key(F.lit("x"), F.lit("go"))) and one(T.cache_key(F.lit(""))) != one(T.cache_key(F.lit(None)))
    assert one(T.is_excluded(F.lit("a/b_test.go"), ("*_test.g[op]",))) and not one(T.is_excluded(F.lit("a/btest.go"), ("*_test.go", "")))


def test_rules_rates_examples(spark, tmp_path):
    (tmp_path / "r.yaml").write_text("- {id: a, languages: [Go, python], categories: [SQL], patterns: ['x+', '('], callees: [f]}\n- nonsense\n---\n- {id: b, language: go, negative: true}\n")
    rows = documents.rule_table(spark, str(tmp_path / "r.yaml")).orderBy("position").collect()
    assert [(r["id"], r["language"], r["patterns"], r["negative"]) for r in rows] == [("a", "go", ["x+"], False), ("a", "python", ["x+"], False), ("b", "go", [], True)]
    assert rows[0]["categories"] == ["sql"]
    (tmp_path / "p.yaml").write_text("models: {m: {input: 3, output: 15}, default: {input: 1}}")
    assert {r["model"]: (r["in_rate"], r["out_rate"]) for r in documents.rates(spark, str(tmp_path / "p.yaml")).collect()} == {"m": (3.0, 15.0), "default": (1.0, 0.0)}
    bank = tmp_path / "sqli"
    bank.mkdir()
    (bank / "1.json").write_text('[{"code": "a", "language": "go"}, {"code": ""}]')
    (bank / "2.JSON").write_text('{"code": "b"}')
    (bank / "3.json").write_text("broken")
    assert sorted((r["skill"], r["code"]) for r in documents.examples(spark, [str(bank)]).collect()) == [("sqli", "a"), ("sqli", "b")]


def test_headed_notes(spark, tmp_path):
    for d, text in {"one": "---\nname: One\nkind: rule\n---\n\nBody\n", "two": "\ufeff---\nname: Two\n---\nB", "_own": "---\nname: Own\n---\nX", "bad": "no head", "worse": "---\nname: x\n"}.items():
        (tmp_path / d).mkdir()
        (tmp_path / d / "N.md").write_text(text, encoding="utf-8")
    got = {r["name"]: (r["kind"], r["body"]) for r in documents.headed_notes(spark, str(tmp_path), "N.md").collect()}
    assert got == {"One": ("rule", "Body"), "Two": ("scanner", "B")}
    assert documents.special_note(str(tmp_path), "_own", "N.md")[1] == "X" and documents.special_note(str(tmp_path), "_none", "N.md") is None
    with pytest.raises(ValueError):
        documents.special_note(str(tmp_path), "one", "N.md")


def test_notes_models_settings(spark, tmp_path):
    path = str(tmp_path / "d" / "n.md")
    assert documents.notes(path) == ""
    documents.save_notes(path, "ü" * 50, most=40)
    assert documents.notes(path).endswith("[...truncated]") and os.path.getsize(path) <= 40
    model = str(tmp_path / "m")
    documents.save_model(spark.createDataFrame([(0.9, 0.8), (0.1, 0.2)], "x double, y double"), model)
    assert documents.load_model(spark, model) == [(0.1, 0.2), (0.9, 0.8)]
    spark.createDataFrame([(9, 0.1, 0.2)], "version int, x double, y double").write.mode("overwrite").json(model)
    with pytest.raises(ValueError):
        documents.load_model(spark, model)
    (tmp_path / "s.yaml").write_text("votes: 3\nexclude: [x/]\nother: 1\n")
    s = documents.Settings.load(str(tmp_path / "s.yaml"), votes=None, min_score=0.2)
    assert (s.votes, s.exclude, s.min_score, s.extra) == (3, ("x/",), 0.2, {"other": 1}) and s.context_budget() == 80_000
    assert documents.Settings(budget_tokens=90, context_window=100).context_budget() == 70 and documents.Settings(level="Extreme").context_budget() == 120_000
    with pytest.raises(ValueError):
        documents.Settings.load(votes=0)
    assert documents.backoff(1, 30, 3, 0.5) == 4 and documents.backoff(1, 30, 20, 1.0) == 30 and documents.backoff(0, 1, 1) == 0


def test_caches(spark, tmp_path):
    path = str(tmp_path / "c")
    rows = spark.createDataFrame([("k1", "p", [1.0, 2.5]), ("k2", "p", None), ("k1", "p", [9.0])], "key string, provider string, v array<float>").limit(2)
    empty = caches.kept(spark, path, "key string, provider string, vec binary")
    assert empty.count() == 0
    caches.put(rows.select("key", "provider", caches.encoded("v").alias("vec")), path, ["key", "provider"], when=F.col("vec").isNotNull())
    asked = spark.createDataFrame([("k1", "p"), ("k2", "p"), ("k1", "q")], "key string, provider string")
    got = caches.looked_up(asked, caches.kept(spark, path, "key string, provider string, vec binary"), ["key", "provider"])
    assert {(r["key"], r["provider"]): (r["hit"], r["v"]) for r in got.withColumn("v", caches.decoded("vec")).collect()} == {("k1", "p"): (True, [1.0, 2.5]), ("k2", "p"): (False, None), ("k1", "q"): (False, None)}
    assert tuple(caches.counters(got).first()) == (1, 2)


SOURCES = {
    "python": ("import a.b as c\nfrom .d import e\n\nclass K:\n    @x\n    async def f(self):\n        return self.g(1)\n", ["a.b", ".d"], [("class", "K", 4, 7), ("function", "f", 6, 7)], ["self.g"]),
    "go": ('package p\n\nimport (\n\t"fmt"\n\tq "a/b" // "no"\n)\n\nfunc (s *T) M(x int) {\n\tif x > 1 {\n\t\tfmt.Println("f(x)")\n\t}\n}\n\nfunc F() {}\n', ["fmt", "a/b"], [("method", "M", 8, 12), ("function", "F", 14, 14)], ["fmt.Println"]),
    "javascript": ("import { a } from './a';\nconst b = require('b');\n// function no() {}\nclass K {\n  async m(x) {\n    if (x) { this.n(x); }\n  }\n}\nfunction f() { return `g(${1})`; }\n", ["./a", "b"], [("class", "K", 4, 8), ("method", "m", 5, 7), ("function", "f", 9, 9)], ["require", "this.n"]),
    "typescript": ("import x from 'y';\nexport class K<T> {\n  private f(a: string): void {\n    a.b();\n  }\n}\n", ["y"], [("class", "K", 2, 6), ("method", "f", 3, 5)], ["a.b"]),
    "java": ('package p;\nimport java.util.List;\npublic class K {\n  @Override\n  public List<String> f(int a) throws E {\n    return g.h("k(1)");\n  }\n}\n', ["java.util.List"], [("class", "K", 3, 8), ("method", "f", 5, 7)], ["h"]),
}


@pytest.mark.parametrize("language", list(SOURCES))
def test_syntax(language):
    text, imports, symbols, calls = SOURCES[language]
    i, s, c = syntax.extract(language, text)
    assert [x["path"] for x in i] == imports
    assert [(x["kind"], x["name"], x["start_line"], x["end_line"]) for x in s] == symbols
    assert [x["callee"] for x in c if x["callee"] not in ("m", "f")] == calls
    broken = syntax.extract(language, text + "\n)){{ def (")
    assert {x[1] for x in symbols} <= {x["name"] for x in broken[1]}


def test_syntax_table(spark):
    files = spark.createDataFrame([(1, "a.py", "def f():\n    g()\n"), (2, "b.txt", "x"), (3, "c.go", None), (4, None, "x"), (5, "d.java", "")], "file_id long, path string, content string").withColumn("symbols", F.lit(1))
    rows = {r["file_id"]: r for r in syntax.parsed(files).collect()}
    assert set(rows) == {1, 5} and rows[1]["symbols"][0]["name"] == "f" and rows[1]["calls"][0]["callee"] == "g" and rows[1]["loc"] == 3 and rows[5]["symbols"] == []
    assert syntax.parsed(files.where("false")).count() == 0


def test_call_log_and_fingerprints(spark, tmp_path):
    log, prints = str(tmp_path / "log"), str(tmp_path / "fp")
    for _ in range(2):
        sinks.append_calls(spark.createDataFrame([("s", 3)], "stage string, tokens_in long"), log)
    assert spark.read.json(log).count() == 2
    for rows in ([("a",), ("a",), (None,)], [("b",)]):
        sinks.replace_fingerprints(spark.createDataFrame(rows, "fingerprint string"), prints)
    assert [r[0] for r in spark.read.parquet(prints).collect()] == ["b"]
