import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from fernglass.llm import neardup, pages, sketch
from fernglass.llm.history import PrefixForest, widened_depth

SCHEMA = "id long, title string, body string"


def corpus(seed=5, n=60):
    """Clusters of edited texts among unlike ones, with copies, NULLs and empty texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(900)]
    rows, i = [], 0
    for _ in range(n):
        base = rng.sample(words, 40)
        for _ in range(rng.choice([1, 1, 1, 2, 4])):
            text = list(base)
            for _ in range(rng.choice([0, 1, 3, 7, 9])):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((i, " ".join(text[:5]), " ".join(text[5:])))
            i += 1
    rows += [(i, rows[0][1].upper(), rows[0][2]), (i + 1, None, None), (i + 2, "", ""), (i + 3, None, rows[1][2]), (None, "x", "y")]
    return rows


def sets(rows):
    return {r[0]: frozenset(sketch.WORD.findall(f"{r[1] or ''} {r[2] or ''}".lower())) for r in rows if r[0] is not None}


def similar(a, b, t):
    return bool(a | b) and len(a & b) >= t * len(a | b)


def brute_groups(rows, t):
    s = sets(rows)
    ids = sorted(s)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and similar(s[i], s[j], t):
                parent[find(j)] = find(i)
    groups = {}
    for i in ids:
        groups.setdefault(find(i), set()).add(i)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


def found_groups(df):
    groups = {}
    for r in df.collect():
        groups.setdefault(r["group_id"], set()).add(r["id"])
    return {frozenset(g) for g in groups.values()}


def test_groups_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    got = neardup.near_duplicate_groups(df, "id", ["title", "body"], threshold=0.7)
    assert found_groups(got) == brute_groups(rows, 0.7)
    pairs = {tuple(r) for r in neardup.group_pairs(got).collect()}
    assert len(pairs) == sum(len(g) * (len(g) - 1) // 2 for g in brute_groups(rows, 0.7))
    assert all(a < b for a, b in pairs)


def test_groups_survive_large_buckets(spark):
    """With two rows a bucket, everything else goes the way for large buckets."""
    rows = corpus(7, 12) + [(1000 + i, "a b c d e f g h i j", f"k l m n o p q r s t u{i}") for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = neardup.near_duplicate_groups(df, "id", ["title", "body"], threshold=0.7, chunk=2)
    assert found_groups(got) == brute_groups(rows, 0.7)


def test_groups_of_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert neardup.near_duplicate_groups(empty, "id", ["title", "body"]).count() == 0
    clash = spark.createDataFrame([(1, "a b c", "f", "x"), (2, "a b c", "f", "y"), (2, "a b c", "f", "y")], "id long, t string, f string, node string")
    got = neardup.near_duplicate_groups(clash, "id", ["t", "f"])
    assert {r["id"] for r in got.collect()} == {1, 2}


def test_superminhash_estimates_similarity():
    rng = random.Random(1)
    errors = []
    for _ in range(60):
        a = [f"x{rng.randrange(10**9)}" for _ in range(60)]
        b = a[: rng.randrange(60)] + [f"y{rng.randrange(10**9)}" for _ in range(30)]
        doc, code, h = sketch.word_sets([" ".join(a), " ".join(b)])
        sig = sketch.superminhash(2, doc, code, h, 128)
        j = len(set(a) & set(b)) / len(set(a) | set(b))
        errors.append((sig[0] == sig[1]).mean() - j)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05
    doc, code, h = sketch.word_sets(["only", "", None])
    assert (sketch.superminhash(3, doc, code, h, 16)[0] != 0xFFFFFFFF).all()


def brute_first(rows, prints, new, t):
    s = sets(rows)
    out = {}
    for i in new:
        for j in sorted(s):
            if j < i and (similar(s[i], s[j], t) or prints.get(i) is not None and prints.get(i) == prints.get(j)):
                out[i] = j
                break
    return out


def test_forest_batch_by_batch_and_at_once(spark):
    rows = [r for r in corpus(9, 50) if r[0] is not None]
    random.Random(2).shuffle(rows)
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    prints = {i: ("p1" if i % 31 == 3 else None) for i, *_ in rows}
    schema = SCHEMA + ", fp string"
    df = spark.createDataFrame([(*r, prints[r[0]]) for r in rows], schema)
    n = len(rows)
    want = brute_first(rows, prints, range(n // 2, n), 0.7)
    new = lambda: PrefixForest.create(spark, "id", ["title", "body"], "fp", threshold=0.7, max_runs=2).add(df.where(f"id < {n // 2}"))
    forest = new()
    got, _ = forest.match(df.where(f"id >= {n // 2}"))
    assert {r["entry_id"]: r["first_id"] for r in got.collect()} == want
    with pytest.raises(FileExistsError):  # one writer
        forest.match(df.where("false"))
    steps, grown = {}, new()
    for lo, hi in ((n // 2, 3 * n // 4), (3 * n // 4, n)):
        got, grown = grown.match(df.where(f"id >= {lo} AND id < {hi}"), chunk=1)
        steps |= {r["entry_id"]: r["first_id"] for r in got.collect()}
    assert steps == want
    assert len(grown.runs) <= 2  # merged
    none, _ = grown.match(df.where("false"))
    assert none.count() == 0


OTHER_SESSION = """
import sys
sys.path.insert(0, {root!r})
from fernglass.llm.history import PrefixForest
from fernglass.session import build_session
spark = build_session("local[2]", 2)
df = spark.createDataFrame({rows!r}, "id long, title string, body string, fp string")
PrefixForest.create(spark, "id", ["title", "body"], "fp", {path!r}, threshold=0.7).add(df)
"""


def test_forest_across_two_sessions(spark, tmp_path):
    rows = [(*r, None) for r in corpus(9, 20) if r[0] is not None]
    half, path = len(rows) // 2, f"file://{tmp_path}/forest"
    code = OTHER_SESSION.format(root=str(Path(__file__).resolve().parents[2]), rows=rows[:half], path=path)
    subprocess.run([sys.executable, "-c", code], check=True, capture_output=True, timeout=300)
    want = brute_first(rows, {}, [r[0] for r in rows[half:]], 0.7)
    got, _ = PrefixForest.open(spark, path).match(spark.createDataFrame(rows[half:], SCHEMA + ", fp string"))
    assert {r["entry_id"]: r["first_id"] for r in got.collect()} == want and want
    assert PrefixForest.open(spark, path).version == 2


def test_pages_read_for_a_batch_do_not_grow_with_history(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(pages, "PAGE_BYTES", 1 << 12)
    batch, read = spark.range(40).select(F.xxhash64("id").alias("lo"), F.xxhash64("id").alias("hi")), []
    for n in (20_000, 200_000):
        path = f"file://{tmp_path}/t{n}"
        pages.write_pages(spark.range(n).select(F.xxhash64("id").alias("key"), "id"), path)
        met = pages.pages_of(spark, [path], batch)
        read.append(met.select("file", "page").distinct().count())
        assert met.groupBy("lo").count().count() == 40
    assert read[1] < 1.5 * read[0] and read[0] > 10


def test_widening():
    assert widened_depth(0.7, 0.995, 64) == 7
    assert widened_depth(0.2, 0.9999, 2) == 1
