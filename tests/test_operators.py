import random

import pytest
from pyspark.sql import functions as F

from fernglass.operators import components, dedup, evaluate, graph, joins, retrieval, sequential, windows


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(5, 5), (None, 1)] + [(i, i + 1) for i in range(100, 140)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    want = sorted(((x, find(x)) for x in list(parent)), key=repr)
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    assert rows(components.connected_components(df)) == want
    assert rows(components.connected_components(df.where("false"))) == []


def test_first_and_best(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 5), (3, "a", 5), (4, "b", 0)], "ordinal long, k string, r int")
    assert rows(dedup.first_by(df, ["k"], [F.asc("ordinal")]).select("ordinal")) == [(1,), (4,)]
    assert rows(dedup.best_keeps_place(df, ["k"], F.col("r")).select("ordinal", "place")) == [(2, 1), (4, 4)]


def test_vote(spark):
    df = spark.createDataFrame([(1, 0, "x", 0.8), (2, 0, "x", 0.8), (3, 1, "x", 0.1), (4, 2, "y", 0.0), (5, 0, "z", 0.0), (6, 2, "z", 0.4)], "ordinal long, run_idx int, k string, score double")
    got = dedup.vote(df, 2, [F.col("k")]).select("ordinal", "votes", "total", F.round("voted_score", 6))
    assert rows(got) == [(1, 2, 3, 0.533333), (5, 2, 3, 0.333333)]


def test_range_first_match_is_block_free(spark):
    rng = random.Random(1)
    left = [(i, rng.choice("fg"), a := rng.randrange(300), a + rng.randrange(150)) for i in range(60)]
    right = [(i, rng.choice("fg"), a := rng.randrange(300), a + rng.randrange(90)) for i in range(40)]
    want = []
    for i, f, lo, hi in left:
        m = [r for r in right if r[1] == f and r[2] <= hi and r[3] >= lo]
        if m:
            want.append((i, min(m)[0]))
    lt = spark.createDataFrame(left, "ordinal long, file string, lo int, hi int")
    rt = spark.createDataFrame(right, "ordinal long, file string, a int, b int")
    for block in (1, 7, 64):
        got = joins.range_first_match(lt, rt, ["file"], ("lo", "hi"), ("a", "b"), "ordinal", block=block)
        assert rows(got.select("ordinal", "match.ordinal")) == sorted(want, key=repr)


def test_with_default_and_first_drop(spark):
    left = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    look = spark.createDataFrame([("a", 1), ("default", 9)], "k string, v int")
    assert rows(joins.with_default(left, look, "k", ["v"])) == [("a", 1), ("b", 9), (None, 9)]
    s = [spark.createDataFrame([(i,) for i in ids], "id long") for ids in ([1, 2, 3], [1, 3], [1])]
    assert rows(joins.first_drop([("raw", s[0]), ("x", s[1]), ("y", s[2])], "id")) == [(2, 1, "x"), (3, 2, "y")]


def test_intervals_and_windows(spark):
    df = spark.createDataFrame([(1, "f", 1, 5), (2, "f", 5, 6), (3, "f", 8, 9), (4, "f", 2, 3), (5, "g", 1, 1)], "ordinal long, f string, s int, e int")
    got = windows.merge_intervals(df, ["f"], "s", "e", [F.count("*").alias("n")])
    assert rows(got.select("f", "s", "e", "n")) == [("f", 1, 6, 3), ("f", 8, 9, 1), ("g", 1, 1, 1)]
    t = spark.createDataFrame([(1, "a\nb\nc"), (2, ""), (3, None), (4, "a\n\n\n\nb")], "id long, t string")
    assert rows(windows.line_windows(t, ["id"], "t", 2).select("id", "window_no", "body")) == [(1, 0, "a\nb"), (1, 1, "c"), (4, 0, "a\n"), (4, 2, "b")]


@pytest.mark.parametrize("edges,seeds,want", [
    ([(1, 2), (2, 3), (3, 1)], [1], [(1, 0), (2, 1), (3, 2)]),
    ([(1, 2), (1, 3), (2, 4), (3, 4), (4, 4)], [1], [(1, 0), (2, 1), (3, 1), (4, 2)]),
    ([(1, 2)], [7], [(7, 0)]),
])
def test_distances(spark, edges, seeds, want):
    e = spark.createDataFrame(edges, "src long, dst long")
    assert rows(graph.distances(e, spark.createDataFrame([(s,) for s in seeds], "node long"))) == want


def test_layers_cycles_and_paths(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (4, 5), (5, 4), (5, 6)], "src long, dst long")
    n = spark.createDataFrame([(i,) for i in range(1, 8)], "node long")
    assert rows(graph.layers(e, n)) == sorted([(1, 0), (2, 1), (3, 2), (4, None), (5, None), (6, None), (7, 0)], key=repr)
    got = graph.bounded_paths(e, spark.createDataFrame([(1,), (4,)], "node long"), 3)
    assert rows(got.select(F.concat_ws("", F.transform("path", lambda x: x.cast("string"))))) == [("12",), ("123",), ("13",), ("45",), ("456",)]
    assert rows(graph.fan_in(e, n))[2] == (3, 2)
    assert rows(graph.roots(e, n)) == [(1,), (7,)]


def test_retrieval(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0])], "vec_id long, embedding array<float>")
    got = retrieval.cosine_topk(v, v.where("vec_id = 1"), 2)
    assert rows(got.select("query", "id", "rank")) == [(1, 1, 1), (1, 2, 2)]
    t = spark.createDataFrame([(1, "aa Aa"), (2, "b"), (3, None)], "id long, t string")
    assert rows(retrieval.keyword_topk(t, ["aa", "aa"], 5, "id", "t")) == [(1, 4)]


def test_evaluation_and_calibration(spark):
    p = spark.createDataFrame([("f", "A", 0.9), ("f", "A", 0.8), ("g", "B", 0.0), ("h", "A", 0.2)], "file string, cwe string, score double")
    t = spark.createDataFrame([("f", "A"), ("x", "B")], "file string, cwe string")
    got = {r["value"]: (r["tp"], r["fp"], r["fn"]) for r in evaluate.confusion(p, t, ["file", "cwe"], "cwe").collect()}
    assert got == {"A": (1, 1, 0), "B": (0, 1, 1), None: (1, 2, 1)}
    s = evaluate.samples(p, t, ["file", "cwe"])
    assert sorted((r["score"], r["hit"]) for r in s.collect()) == [(0.2, False), (0.8, True), (0.9, True)]
    knots = evaluate.isotonic_fit(evaluate.pool_scores(spark.createDataFrame([(0.1, False), (0.2, True), (0.3, False), (0.4, True)], "score double, hit boolean")))
    assert knots == [(0.1, 0.0), (0.2, 0.5), (0.3, 0.5), (0.4, 1.0)]
    x = spark.createDataFrame([(0.0,), (0.05,), (0.15,), (0.9,)], "s double").select(F.round(evaluate.interpolated(F.col("s"), knots), 6))
    assert [r[0] for r in x.collect()] == [0.0, 0.0, 0.25, 1.0]


def test_sequences():
    assert sequential.pack([5, 5, 5, 1], 10, 3) == [(0, 1), (2, 3)]
    assert sequential.pack([5, 5, 1], 10, 3) == [(0, 2)]
    assert sequential.pack([], 10, 3) == [] and sequential.pack([50], 10, 3) == [(0, 0)]
    assert sequential.admit([5, 9, 4, 1], 10) == [5, 0, 4, 1]
    assert sequential.admit([5, 9], 10, 2) == [5, 5]
    assert sequential.squeeze_lines(list("abcdefghijklmnop"), 10)[4:7] == ["e", "... 6 lines ...", "l"]
    assert sequential.balanced_json('x {"a": "}{"} {"b": 1}') == '{"a": "}{"}'
    assert sequential.balanced_json('x {"a": 1} {"b": [2]} y', last=True) == '{"b": [2]}'
    assert sequential.balanced_json("{broken [1, 2]") == "[1, 2]" and sequential.balanced_json(None) is None
    code = ["q = get_input()", "r = q + 1", "run(r)", "r = 1", "run(r)", "s = clean(q)", "run(s)"]
    assert sequential.flows(code, ["get_input"], ["run("], ["clean("]) == [(1, 3, "r", False), (1, 7, "s", True)]
