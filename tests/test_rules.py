from pyspark.sql import functions as F

from fernglass.operators import codegraph, rules


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_rule_matches_and_marks(spark):
    df = spark.createDataFrame([(1, "go", "a\nexec(x) exec(y)\nEXEC("), (2, "py", "exec("), (3, None, "exec("), (4, "go", None)], "id long, lang string, t string")
    assert rows(rules.rule_matches(df, ["id"], "lang", "t", [("g", "go", "exec("), ("h", "go", "(x"), ("p", "js", "exec(")])) == [(1, 2, "g"), (1, 2, "h")]
    assert rows(rules.extract_marks(df, ["id"], "t", r"exec\((\w)\) (\w+)", ["a", "b"])) == [(1, 2, "x", "exec")]


def test_first_rule(spark):
    kind, weight = rules.first_rule(F.col("n"), [("a", "^x", 0.5), ("b", "y", 0.9)])
    df = spark.createDataFrame([("xy",), ("y",), ("z",), (None,)], "n string").select("n", kind.alias("k"), weight.alias("w"))
    assert rows(df) == [("xy", "a", 0.5), ("y", "b", 0.9), ("z", None, None), (None, None, None)]


def test_merge_decisions(spark):
    r = spark.createDataFrame([(1, 5), (2, 9), (3, 9), (4, 0), (5, 0)], "id long, r int")
    d = spark.createDataFrame([([1, 2, 3, 77], False), ([4], True)], "ids array<long>, drop boolean")
    assert rows(rules.merge_decisions(r, d, "id", [F.desc("r"), F.asc("id")]).select("id")) == [(2,), (5,)]
    assert rows(rules.merge_decisions(r, d.where("false"), "id", [F.asc("id")]).select("id")) == [(1,), (2,), (3,), (4,), (5,)]


def test_split_to_size(spark):
    df = spark.createDataFrame([("f", 1, 10), ("g", 4, 4)], "f string, a int, b int")
    assert rows(rules.split_to_size(df, ["f"], "a", "b", 4)) == [("f", 1, 3), ("f", 4, 5), ("f", 6, 8), ("f", 9, 10), ("g", 4, 4)]
    assert rows(rules.split_to_size(df, ["f"], "a", "b", 1, rounds=1)) == [("f", 1, 5), ("f", 6, 10), ("g", 4, 4)]


def test_downgraded(spark):
    f = spark.createDataFrame([("a",), ("b",), ("t",), ("m",)], "file string")
    got = rules.downgraded(f, spark.createDataFrame([("a",), ("a",)], "file string"), "file", F.col("file") == "t", F.col("file") == "m")
    assert rows(got.select("file", "reason")) == [("a", None), ("b", "unreached"), ("m", None), ("t", "test")]


def test_code_graph(spark):
    sym = "array<struct<kind:string,name:string,start_line:int,end_line:int,receiver:string>>"
    rec = spark.createDataFrame([(1, "p/a.py", [("util", None, 1), ("./b", None, 2), ("lodash", None, 3)], [("class", "C", 1, 20, None), ("method", "f", 3, 9, None)], [("x.g", 5), ("f", 6), ("h", 30), ("q", 12)]), (2, "p/b.py", None, [("function", "g", 1, 2, None)], None), (3, "z/util.py", [], [("function", "q", 1, 2, None)], [])],
                                f"file_id long, path string, imports array<struct<path:string,alias:string,line:int>>, symbols {sym}, calls array<struct<callee:string,line:int>>")
    within = codegraph.enclosing(codegraph.calls(rec), codegraph.symbols(rec), block=4)
    assert rows(within.select("callee", "caller")) == [("f", "f"), ("q", "C"), ("x.g", "f")]
    links = spark.createDataFrame([(1, 2)], "file_id long, to_file long")
    assert rows(codegraph.resolve_calls(within, codegraph.symbols(rec), links)) == [(1, "C", 3, "q"), (1, "f", 2, "g")]
    got = codegraph.resolve_imports(codegraph.imports(rec), rec)
    assert rows(got.select("import_no", "target")) == [(0, "z/util.py"), (1, "p/b.py"), (2, "ext:lodash")]
