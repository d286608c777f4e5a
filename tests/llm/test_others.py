import ast
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fernglass.llm import mixing, neighbours, parsing, representative
from fernglass.llm.syntax.chart import Grammar
from fernglass.llm.syntax.repair import Repairer


def brute_neighbours(vectors, k, least):
    out = set()
    for a, g, v in vectors:
        near = sorted((-round(float(v @ w), 9), b) for b, h, w in vectors if b != a and h == g and v @ w >= least)[:k]
        out |= {(a, b) for _, b in near}
    return out


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows, unit = [], []
    for i in range(1400):
        g = ("p", "m1", 32) if i % 3 else ("p", "m2", 24)
        v = rng.standard_normal(g[2])
        if i % 5 == 0 and i > 30:
            src = next(r for r in reversed(rows[: i - 6]) if r[2] == g[1])
            v = np.frombuffer(src[4], "<f4") + rng.standard_normal(g[2]) * rng.choice([0.0, 0.05, 0.1])
        rows.append((i, *g[:2], g[2], v.astype("<f4").tobytes()))
        x = np.frombuffer(rows[-1][4], "<f4").astype(float)
        unit.append((i, g, x / np.linalg.norm(x)))
    bad = [(5000, "p", "m1", 32, b""), (5001, "p", "m1", 32, None), (5002, "p", "m1", 32, np.zeros(32, "<f4").tobytes()), (5003, "p", "m1", 32, np.full(32, np.nan, "<f4").tobytes()), (5004, None, "m1", 32, rows[0][4]), (None, "p", "m1", 32, rows[1][4])]
    df = spark.createDataFrame(rows + bad, "vec_id long, provider string, model string, dim int, vec binary")
    got = {(r["a"], r["b"]) for r in neighbours.most_similar(df, 10, 0.8).select("a", "b").collect()}
    want = brute_neighbours(unit, 10, 0.8)
    assert got <= want and len(got & want) >= 0.97 * len(want) and len(want) > 100
    assert neighbours.most_similar(df.where("false"), 10).count() == 0


def test_equal_vectors_and_ties(spark):
    v = np.arange(1, 9).astype("<f4").tobytes()
    df = spark.createDataFrame([(i, "p", "m", 8, v) for i in range(15)], "vec_id long, provider string, model string, dim int, vec binary")
    got = neighbours.most_similar(df, 3).collect()
    assert len(got) == 45 and {r["b"] for r in got if r["a"] == 14} == {0, 1, 2} and {r["b"] for r in got if r["a"] == 0} == {1, 2, 3}


def test_kinds_in_passes(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, "p", f"m{i % 4}", 8, rng.integers(-2, 3, 8).astype("<f4").tobytes()) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, provider string, model string, dim int, vec binary")
    want = sorted(map(tuple, neighbours.most_similar(df, 4, 0.5).collect()))
    monkeypatch.setattr(neighbours, "MODEL_BYTES", 1)
    assert sorted(map(tuple, neighbours.most_similar(df, 4, 0.5).collect())) == want and want


def test_neighbours_with_their_code(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "vec_a long, vec_b long")
    vectors = spark.createDataFrame([(1, "k1"), (2, "k2"), (3, None)], "vec_id long, chunk_key string")
    good = '{"file": "a.py", "start_line": 3, "symbol": "f", "text": "x"}'
    chunks = spark.createDataFrame([("k1", good.encode()), ("k1", good.encode()), ("k2", b'{"file": "b'), (None, b"{}"), ("k2", None)], "chunk_key string, payload binary")
    got = {(r["vec_a"], r["vec_b"]): r for r in neighbours.with_chunks(pairs, vectors, chunks).collect()}
    assert set(got) == {(1, 2), (2, 3)} and got[1, 2]["code_a"]["file"] == "a.py" and got[2, 3]["code_b"] is None


def test_one_bit_bounds_hold():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes = neighbours.Codes(x, x[:50].mean(0), neighbours.rotation(64))
    est, slack = codes.estimate(x[:40])
    error = np.abs(est - x[:40] @ x.T)
    assert (error <= slack).mean() > 0.97 and error.mean() < 0.12


FINDING = "finding_id long, file string, rule_id string, start_line int, end_line int, agent string, verified boolean, severity string, confidence string, created_at timestamp, description string, code_sample string, cwe string, owasp string, verifier_comment string"


def finding(i, agent="x", verified=None, severity="low", cwe=None, file="a/b.py", line=1, at=None):
    return (i, file, " R1 ", line, line, agent, verified, severity, "low", at, "d", None, cwe, None, None)


def test_best_findings(spark):
    import datetime

    at = datetime.datetime(2025, 1, 1)
    rows = [finding(1, "a", True, "HIGH ", at=at), finding(2, "A ", False, "low", file="./a//b.py", at=at), finding(3, "b", True, "critical", file="a\\b.py"), finding(4, line=9), finding(5, "b", True, "low", line=20, at=at), finding(6, "b", True, "low", line=20, at=at)]
    rows += [finding(7, file=None), finding(8, line=None)]
    agents = spark.createDataFrame([("a", 9), ("b", 5), (None, 99)], "agent string, trust int")
    got = {r["finding_id"]: r for r in representative.best_findings(spark.createDataFrame(rows, FINDING), agents).collect()}
    assert set(got) == {1, 5}
    assert got[1]["n_best"] == 5 and got[1]["records"] == 3 and got[5]["n_best"] == 6
    empty = spark.createDataFrame([], FINDING)
    assert representative.best_findings(empty, agents).count() == 0


def test_truth_inference_recovers_sources(spark, monkeypatch):
    rng = random.Random(8)
    rate = {"good": 0.95, "fair": 0.8, "poor": 0.55, "fair2": 0.8}
    truth, claims = {}, []
    for e in range(400):
        truth[e] = rng.choice("uvw")
        for s, r in rate.items():
            claims.append((str(e), "f", truth[e] if rng.random() < r else rng.choice([x for x in "uvw" if x != truth[e]]), s))
    claims += [(None, "f", "u", "good"), ("1", "f", None, "good")]
    facts, rates = representative.infer_truth(spark.createDataFrame(claims, "entity string, field string, value string, source string"))
    best = facts.groupBy("entity").agg(F.max_by("value", "p").alias("v")).collect()
    assert sum(truth[int(r["entity"])] == r["v"] for r in best) > 370
    sens = {r["s"]: r["sens"] for r in rates.collect()}
    assert sens["good"] > sens["fair"] > sens["poor"]
    facts, _ = representative.infer_truth(spark.createDataFrame(claims, "entity string, field string, value string, source string"), rounds=3)
    p = {tuple(r)[:3]: r["p"] for r in facts.collect()}
    monkeypatch.setattr(representative, "MAX_PATTERNS", 3)  # the same by aggregates over the patterns' table
    other, rates = representative.infer_truth(spark.createDataFrame(claims, "entity string, field string, value string, source string"), rounds=3)
    assert all(abs(p[tuple(r)[:3]] - r["p"]) < 1e-6 for r in other.collect()) and rates.count() == 4
    none, _ = representative.infer_truth(spark.createDataFrame([], "entity string, field string, value string, source string"))
    assert none.count() == 0


def test_best_by_quality_alone(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    evidence = np.array([[p >> i & 1 for i in range(6)] for p in range(64)], float)
    z = representative.quality(evidence, rng.integers(1, 100, 64).astype(float))
    assert all(z[a] <= z[b] for a in range(64) for b in range(64) if a & b == a) and z[63] == z.max()
    # without the check on all six: survivors are the planted best
    rows, best = [], set()
    for g in range(150):
        top = int(rng.integers(0, 4))
        for k in range(4):
            i = g * 4 + k
            good = k == top
            rows.append(finding(i, "a" if good else rng.choice(["b", "c"]), True if good else bool(rng.random() < 0.5), "critical" if good or rng.random() < 0.4 else "low", line=g + 1, cwe="C1" if good else None))
            if good:
                best.add(i)
    agents = spark.createDataFrame([("a", 9), ("b", 5), ("c", 7)], "agent string, trust int")
    got = {r["finding_id"] for r in representative.best_findings(spark.createDataFrame(rows, FINDING), agents).collect()}
    assert len(got) == 150 and len(got & best) >= 0.9 * 150


@pytest.mark.parametrize("path, want", [("a/b/c/d/e/f/../../../../../x.py", "a/x.py"), ("./a//b\\\\c.py ", "a/b/c.py"), ("../a/./b/", "../a/b"), ("/../a", "/a"), ("a/../../b", "../b"), ("a.b/..c", "a.b/..c"), ("", "."), (None, None)])
def test_one_spelling(spark, path, want):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(representative.clean_path("p")).first()[0] == want


def test_water_filling(spark):
    def amounts(rows, total=None):
        return {r["source"]: r["amount"] for r in mixing.levels(spark.createDataFrame(rows, "source string, w double, tokens long, k int"), total).collect()}

    s = amounts([("a", 0.5, 100, 1), ("b", 0.25, 1000, 1), ("c", 0.25, 1000, 1)], 1000)
    assert s["a"] == 100 and s["b"] == pytest.approx(450) and s["c"] == pytest.approx(450)
    assert amounts([("a", 0.5, 100, 2), ("b", 0.5, 50, 1)], 1000) == {"a": 200.0, "b": 50.0}
    assert amounts([("a", 0.0, 10, 1), ("b", None, 10, None)]) == {"a": 0.0, "b": 0.0}
    many = amounts([(f"s{i}", 1.0 + i % 7, 10 * i, 1) for i in range(12_000)], 1e8)  # any number of sources
    assert len(many) == 12_000 and sum(many.values()) == pytest.approx(1e8)


def test_mixture_keeps_its_cap(spark):
    texts = [(i, "a", "" if i % 3 else None) for i in range(9)] + [(10 + i, "a", f"some words {i}") for i in range(5)] + [(100 + i, "b", f"other words by {i}") for i in range(300)]
    df = spark.createDataFrame(texts, "doc_id long, source string, text string")
    t = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 3)], "source string, target_share double, max_repeats int")
    used, report = mixing.mixture(df, t, "/opt/tokenizers/byte_bpe_50k.tiktoken")
    rows = used.collect()
    assert {r["doc_id"] for r in rows if r["source"] == "a"} == {10, 11, 12, 13, 14} and all(r["repeats"] == 2 for r in rows if r["source"] == "a")
    assert all(r["repeats"] <= 3 and r["tokens"] > 0 for r in rows)
    a = {r["source"]: r for r in report.collect()}
    assert a["a"]["used"] == a["a"]["amount"] == 2 * a["a"]["tokens"] and 0 <= a["b"]["amount"] - a["b"]["used"] < 8


def test_mixture(spark):
    rng = random.Random(1)
    docs = [(i, "ab"[i % 3 == 0], " ".join(rng.choices(["alpha", "beta", "gamma"], k=rng.randrange(1, 40)))) for i in range(300)] + [(900, "a", None), (901, "z", "text"), (902, None, "text")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumn("tokens", F.lit(1))
    t = spark.createDataFrame([("a", 0.3, 1), ("b", 0.7, 3), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    used, report = mixing.mixture(df, t, "/opt/tokenizers/byte_bpe_50k.tiktoken")
    r = {x["source"]: x for x in report.collect()}
    assert r["none"]["used"] == 0 and abs(r["a"]["share"] + r["b"]["share"] - 1) < 1e-9
    for s in "ab":
        assert 0 <= r[s]["amount"] - r[s]["used"] <= 60
    assert used.agg(F.max("repeats")).first()[0] <= 3 and used.where("source = 'a'").agg(F.max("repeats")).first()[0] == 1
    assert sorted(map(tuple, used.collect())) == sorted(map(tuple, mixing.mixture(df.repartition(5), t, "/opt/tokenizers/byte_bpe_50k.tiktoken")[0].collect()))


def brute_edits(tokens, valid, alphabet, most=2):
    """Breadth-first search over edits."""
    seen, level = {tokens}, [tokens]
    for cost in range(most + 1):
        if any(valid(t) for t in level):
            return cost
        new = []
        for t in level:
            for i in range(len(t) + 1):
                new += [t[:i] + a + t[i:] for a in alphabet]
                if i < len(t):
                    new += [t[:i] + t[i + 1 :], *(t[:i] + a + t[i + 1 :] for a in alphabet)]
        level = [t for t in set(new) if t not in seen]
        seen |= set(level)
    return most + 1


def test_chart_against_search():
    g = Grammar("e : t | e '+' t\nt : 'a' | 'x' e 'y'", {"+": "+", "a": "a", "x": "(", "y": ")"})

    def valid(s):
        v = g.costs(list(s))[g.index["e"]]
        return v == 0

    rng = random.Random(3)
    for _ in range(60):
        s = "".join(rng.choice("a+()") for _ in range(rng.randrange(1, 6)))
        want = brute_edits(s, valid, "a+()")
        got = g.costs(list(s))[g.index["e"]]
        assert got == want or want == 3 and got >= 3, s


GOOD = {
    "go": ["package a\n\nimport (\n\t\"x\"\n)\n\nfunc f(a string, b ...int) (string, error) {\n\tfor i := 0; i < 3; i++ {\n\t\tx[i] = g(a)\n\t}\n\tif err != nil {\n\t\treturn \"\", err\n\t} else if m := map[string]int{\"a\": 1}; m[\"a\"] > 1 {\n\t}\n\tgo func() { c <- 1 }()\n\treturn a, nil\n}\n", "package a\ntype T struct {\n\tA int `json:\"a\"`\n\tB []*T\n}\nfunc (t *T) Get() string { return t.A }\nvar x = []int{\n\t1, -2,\n}\n"],
    "js": ["import { a } from './b';\nexport default class A extends B { static x = 1; get y() { return this.z ?? 0; } async f(...r) { await g(`t${1}`); } }\nconst f = async (a, { b, c: [d] = [] }) => { for (const [k, v] of Object.entries(a)) { if (/x[/]/.test(k)) continue; } };\nlet x = a ? b : { c, 'd': 1, ...e }\nx = y\ndo { x++ } while (x < 3);\nswitch (x) { case 1: case 2: y(); break; default: z() }\n", ""],
    "ts": ["interface A<T> extends B { readonly x?: Map<string, number>; f(a: string): void; [k: string]: unknown }\ntype U = 'a' | { b: number[] };\nexport enum E { X = 1, Y }\nabstract class C<T> implements D { private x: number = 1; constructor(private readonly y?: string) { super(); } get<K extends string>(k: K): T | null { return (this as any).m![k] as T; } }\n"],
    "java": ["package a.b;\nimport java.util.*;\n@X(y = 1)\npublic final class A<T extends B> extends C implements D {\n  private static final int[] T = { 1, 2, };\n  public A() { this(1); }\n  @Override public <R> List<? extends R> f(final String a, int... b) throws E {\n    for (int i = 0; i < 3; i++) { x[i] += (int) y; }\n    for (var s : list) g(s -> s.h(), A::new);\n    try (R r = o()) { } catch (E | F e) { throw new G(\"x\"); } finally { }\n    return new int[3].length > 0 ? null : cond;\n  }\n}\nenum K { A, B(1) { }; }\n"],
    "py": ["", "@d\nasync def f(a, *b, c: int = 1, **k) -> None:\n    '''doc'''\n    x, *y = [i async for i in z if i], {**k}, a[1:2, ::3]\n    with open(a) as g, h:\n        return lambda q=1: (yield)\n    try:\n        pass\n    except (A, B) as e:\n        raise C from e\n    else: x += 1; y = 2\n    finally:\n        del x\n", "if a not in b and c is not d: print(f'{x}' 'y', end='')\nelif x := 1:\n\tpass\n"],
}
BAD = {
    "go": ["", "package a\nfunc f( {\n}\n", "package a\nfunc f() {\n\tx := := 1\n}\n", "func f() {}\n", "package a\n<<<<<<< HEAD\nvar x = 1\n=======\nvar x = 2\n>>>>>>> b\n"],
    "js": ["const a = ;", "f(a, b;", "if (a) { b();", "x = 'abc\n", "import a from b;", "const x = = 1;"],
    "ts": ["interface A { x: }", "let a: = 1;"],
    "java": ["class A { void f() { int x = 1 } }", "class A { void f() { a + b; } }", "package a\nclass A {}", "class A { def f(self): }"],
    "py": ["if a:\nb\n", "x = (1,\n", "def f():\n    a\n   b\n", "else:\n    x\n", "f(x) = 1\n", "a\x00b\n", "print 'x'\n"],
}


@pytest.mark.parametrize("lang", list(GOOD))
def test_syntax(lang):
    r = Repairer(lang)
    for s in GOOD[lang]:
        assert r.repair(s)[0] == 0, s
    for s in BAD[lang]:
        assert r.repair(s)[0] > 0, s


def test_python_agrees_with_its_own_parser():
    import inspect
    import json.decoder
    import json.encoder
    import string
    import textwrap as tw

    r, rng = Repairer("py"), random.Random(5)
    for m in (json.decoder, json.encoder, string, tw):
        source = inspect.getsource(m)
        assert r.repair(source)[0] == 0, m
        lines = source.split("\n")
        for _ in range(12):
            cut = list(lines)
            i = rng.randrange(len(cut))
            cut[i] = cut[i][: len(cut[i]) // 2] if rng.random() < 0.5 else cut[i].replace(")", "", 1)
            text = "\n".join(cut)
            try:
                ast.parse(text)
                good = True
            except SyntaxError:
                good = False
            assert (r.repair(text)[0] == 0) == good, (m, i, cut[i])


def test_syntax_table(spark):
    asts = spark.createDataFrame([(1, "a.py"), (1, "a.py"), (2, "b.js"), (3, "c.go"), (4, "d.txt"), (None, "e.py"), (6, None), (7, "f.py")], "file_id long, path string")
    files = spark.createDataFrame([(1, "r", "x = ("), (2, "r", ""), (3, "r", None), (4, "r", "?"), (7, None, "x = 1")], "file_id long, repo string, content string")
    got = parsing.syntax_check(asts, files)
    assert {(r["file_id"], r["edits"] > 0) for r in got.collect()} == {(1, True), (2, False), (7, False)}
    total = [r for r in parsing.invalid_rates(got).collect() if r["repo"] is None and r["language"] is None and r["files"] == 3]
    assert total and total[0]["invalid"] == 1
    assert parsing.syntax_check(asts, files.where("false")).count() == 0
