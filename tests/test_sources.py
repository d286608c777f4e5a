from pyspark.sql import functions as F

from fernglass.sources import readers, sinks


def test_readers(spark, tmp_path):
    (tmp_path / "src/skip").mkdir(parents=True)
    (tmp_path / "src/a.py").write_text("x = 1\n")
    (tmp_path / "src/skip/b.go").write_text("package b\n")
    (tmp_path / "src/c.bin").write_text("?")
    got = readers.source_tree(spark, str(tmp_path / "src"), exclude=("/skip/",))
    assert [(r["language"], r["lines"]) for r in got.collect()] == [("python", 2)]
    (tmp_path / "l.json").write_text('[{"file": "a", "cwe": "cwe-1"}, {"cwe": "x"}]')
    (tmp_path / "l.jsonl").write_text('{"path": "a", "cwe": "c", "label": 1}\n\n{bad\n{"path": "", "cwe": "c", "label": 1}\n{"path": "b", "cwe": "c", "label": 0}\n')
    (tmp_path / "l.csv").write_text("# note\nname,category,real,cwe\nt1,x,true,22\nt2,x,false,22\nshort\n")
    assert readers.json_labels(spark, str(tmp_path / "l.json")).collect()[0]["cwe"] == "CWE-1"
    assert [r["file"] for r in readers.jsonl_labels(spark, str(tmp_path / "l.jsonl")).collect()] == ["a"]
    assert [tuple(r) for r in readers.csv_labels(spark, str(tmp_path / "l.csv")).collect()] == [("t1", "CWE-22")]
    (tmp_path / "log.jsonl").write_text('{"ts": "2025-01-01T00:00:00Z", "stage": "scan", "model": "m", "tokens_in": 3, "ok": true}\n\nnot json\n')
    assert readers.call_log(spark, str(tmp_path / "log.jsonl")).count() == 1


def test_parse_cache(spark):
    files = spark.createDataFrame([("a.py", "python", "x"), ("b.py", "python", "x"), ("c.py", "python", "y")], "path string, language string, content string")
    parse = lambda df: df.select("key", F.length("content").alias("size"))
    parsed, fresh = readers.parse_cached(files, None, parse)
    assert parsed.count() == 3 and fresh.count() == 2
    parsed, fresh = readers.parse_cached(files, fresh, parse)
    assert parsed.count() == 3 and fresh.count() == 0


def test_sinks(spark, tmp_path):
    f = spark.createDataFrame([(1, "", "T x!", "High", "low", 0.5, False, "a.py", 0, 0, "ag"), (2, "r", "t", "low", "", 0.1, True, "a", 1, 1, "ag")], "ordinal long, rule_id string, title string, severity string, confidence string, score double, false_positive boolean, file string, start_line int, end_line int, agent string")
    got = sinks.sarif_results(f).collect()
    assert [(r["ruleId"], r["level"]) for r in got] == [("ag/t-x", "error")] and '"startLine":1' in got[0]["result"]
    sinks.write_sarif(f, str(tmp_path / "s"))
    sinks.write_snapshot(f.where("false"), str(tmp_path / "e"))
    assert spark.read.text(str(tmp_path / "s")).count() == 1
    e = spark.createDataFrame([(2, 1), (1, 2), (1, 2)], "src long, dst long")
    assert [r["line"] for r in sinks.dot_lines(e).collect()] == ['  "1" -> "2";', '  "2" -> "1";']
