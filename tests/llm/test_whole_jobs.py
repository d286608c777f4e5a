"""Training-data queries on small inputs made to need the whole job, against brute force."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from fernglass.llm import history, queries
from fernglass.llm.syntax.repair import Repairer


def test_repetition_decided_by_share_alone(spark, tmp_path):
    rng = random.Random(4)
    texts = [" ".join(rng.choices([f"q{i}" for i in range(300)], k=200)) for _ in range(300)]
    texts += [("one two three four five six seven eight nine. " * 30)] * 150
    a, b = [f"a{i}" for i in range(100)], [f"b{i}" for i in range(100)]
    texts.append(" ".join(a + b + a))  # share 0.317; triples abstains, squeeze and vocabulary vote against

    def share(text):
        w = text.replace(".", " ").split()
        runs = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        return 1 - len(set(runs)) / len(runs)

    pq.write_table(pa.table({"doc_id": list(range(len(texts))), "text": texts}), str(tmp_path / "documents.parquet"))
    got = {r[0] for r in queries.p10_found(spark, str(tmp_path)).collect()}
    assert got == {i for i, t in enumerate(texts) if share(t) >= 0.3} and len(texts) - 1 in got


def test_first_repeat_in_ranges_longer_than_a_chunk(spark, monkeypatch):
    from pyspark.sql import functions as F

    # 8 repeats 3 and 5: 3 stands behind the first chunk of one range, 5 at the start of another that goes on behind it
    ranges = spark.createDataFrame([(1, n) for n in (0, 1, 2, 3, 4, 8)] + [(2, n) for n in (5, 6, 7, 8)], "tree int, node long")
    monkeypatch.setattr(history, "_keys", lambda classes, trees, m: classes.select("node", "sk").join(ranges, "node").select((F.col("tree").cast("long") * (1 << 56)).alias("key"), "node", "sk"))
    monkeypatch.setattr(history, "least_common_bits", lambda threshold: 0)
    rows = [(i, " ".join([f"w{j}" for j in range(30)] + [f"x{i}"] if i in (3, 5, 8) else [f"y{i}_{j}" for j in range(30)])) for i in range(9)]
    df = spark.createDataFrame(rows, "id long, body string")
    for chunk in (100, 2):
        forest = history.PrefixForest.create(spark, "id", ["body"], threshold=0.7).add(df.where("id < 8"))
        got, _ = forest.match(df.where("id = 8"), chunk=chunk)
        assert [tuple(r) for r in got.collect()] == [(8, 3)], chunk


CHAIN = "a" + "".join(f".b(x{i}).c(y)" for i in range(20))
PAIRS = [(f"'k{i}'", str(i) if i % 2 else "'v'") for i in range(100)]
LONG = [
    ("java", "class A { void f() { x = %s; } }", CHAIN, CHAIN + "."),
    ("js", "const x = %s;", CHAIN, CHAIN.replace(").c", ")c", 1)),
    ("py", "x = {%s}\n", ", ".join(f"{k}: {v}" for k, v in PAIRS), ", ".join(f"{k}: {v}" for k, v in PAIRS) + ", 3"),
    ("js", "const x = {%s};", ", ".join(f"{k}: {v}" for k, v in PAIRS), ", ".join(f"{k}: {v}" for k, v in PAIRS) + " 3"),
    ("go", "package a\nvar x = map[string]any{%s}\n", ", ".join(f"{k}: {v}" for k, v in PAIRS).replace("'", '"'), ", ".join(f"{k} {v}" for k, v in PAIRS).replace("'", '"')),
    ("py", "%s\n", "x = " + " + ".join(f"a{i} * {i}" for i in range(40)), " + ".join(f"a{i} * {i}" for i in range(40)) + " = 3"),
]


@pytest.mark.parametrize("lang,frame,good,bad", LONG)
def test_long_units_are_parsed_whole(lang, frame, good, bad):
    r = Repairer(lang)
    assert r.repair(frame % good)[0] == 0
    assert r.repair(frame % bad)[0] > 0


ITEMS = [
    ("js", "function f(1, a, b) {}"), ("js", "import {1, a, b} from 'm';"), ("js", "x = {1, a, b}"), ("js", "for (i; i; i; i) {}"), ("js", "for (a = 1; a = 1; a = 1; a = 1; a = 1) {}"),
    ("py", "def f(1, a, b):\n    pass\n"), ("py", "1, a, b = g()\n"), ("py", "from m import a, 1, b, c\n"), ("py", "from m import (a, b, 's', c, d)\n"),
]


@pytest.mark.parametrize("lang,text", ITEMS)
def test_no_item_of_a_list_goes_unparsed(lang, text):
    r = Repairer(lang)
    assert r.repair(text)[0] > 0
    assert r.repair(text.replace("1, a", "a").replace(", 1", "").replace(", 's'", "").replace("; i; i; i", "; i; i").replace("; a = 1; a = 1; a = 1; a = 1", "; a = 1; a = 1"))[0] == 0


FRAMES = [
    ("js", "x = {%s};", "k%d: 1", "m%d: a.b(c)"), ("ts", "const x = {%s};", "k%d: 1", "m%d: a.b(c)"), ("py", "x = {%s}\n", "'k%d': 1", "a%d: b.c"),
    ("go", "package a\nvar x = map[string]int{%s}\n", '"k%d": 1', "a%d: b.c(d)"), ("java", "class A { int[] x = {%s}; }", "%d", "a.b%d"),
]


@pytest.mark.parametrize("lang,frame,even,odd", FRAMES)
def test_edits_do_not_depend_on_the_length_of_a_list(lang, frame, even, odd):
    found = set()
    for n in (4, 10, 24, 60, 120):
        items = [(odd if i % 2 else even) % i for i in range(n)]
        assert Repairer(lang).repair(frame % ", ".join(items))[0] == 0
        items[2] += " 3 3"
        one = Repairer(lang).repair(frame % ", ".join(items))[0]
        items[0] += " 3"
        found.add((one, Repairer(lang).repair(frame % ", ".join(items))[0]))
    assert found == {(1, 2)}


@pytest.mark.parametrize("n", [3, 8, 9, 10, 14])
def test_edits_of_a_body_are_those_of_its_statements(n):
    assert Repairer("js").repair("function f() { " + "a b; " * n + "c(); " * 9 + "}")[0] == n


@pytest.mark.parametrize("n", [1, 2, 3, 20])
def test_equal_items_are_edited_one_by_one(n):
    assert Repairer("js").repair("x = {a: 1, " + "b: 3 3, " * n + "c: 2};")[0] == n
