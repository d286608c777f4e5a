"""Queries on small tables of their own, against brute force over all rows."""

import random

import pyarrow as pa
import pyarrow.parquet as pq

from fernglass.operators import evaluate
from fernglass.plans import catalogue


def put(folder, name, rows, schema):
    pq.write_table(pa.Table.from_pylist(rows, schema=schema), str(folder / f"{name}.parquet"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


PART = pa.schema([("p_partkey", pa.int64()), ("p_size", pa.int32())])


def test_cycle_nodes_over_all_edges(spark, tmp_path):
    n = 49
    part = [{"p_partkey": k, "p_size": 40 if k % 3 else 10} for k in range(1, n + 1)]
    put(tmp_path, "part", part, PART)
    after = {k: {(k * 7 + 3) % n + 1} | ({(k * 13 + 5) % n + 1} if k % 3 == 0 else set()) for k in range(1, n + 1)}

    def behind(k):
        got, todo = set(), list(after[k])
        while todo:
            x = todo.pop()
            if x not in got:
                got.add(x)
                todo += after[x]
        return got

    reach = {k: behind(k) for k in after}
    on = {k for k in after if k in reach[k]}
    want = on | {x for k in on for x in reach[k]}
    assert 0 < len(want) < n
    assert rows(catalogue.cycle_nodes(spark, str(tmp_path))) == sorted(((k,) for k in want), key=repr)


ASTS = pa.schema([
    ("file_id", pa.int64()), ("path", pa.string()), ("imports", pa.list_(pa.struct([("path", pa.string()), ("alias", pa.string()), ("line", pa.int32())]))),
    ("symbols", pa.list_(pa.struct([("kind", pa.string()), ("name", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32())]))),
    ("calls", pa.list_(pa.struct([("callee", pa.string()), ("line", pa.int32())]))),
])


def parsed(file_id, path, symbols=(), calls=(), imports=()):
    return {
        "file_id": file_id, "path": path, "imports": [{"path": m, "alias": None, "line": 1} for m in imports],
        "symbols": [{"kind": "function", "name": n, "start_line": a, "end_line": b} for n, a, b in symbols], "calls": [{"callee": c, "line": at} for c, at in calls],
    }


def test_symbols_in_all_windows(spark, tmp_path):
    spans = [("a", 1, 45), ("b", 230, 290), ("c", 1000, 1001), ("d", 281, 320)]
    put(tmp_path, "file_asts", [parsed(1, "a.py", spans)], ASTS)
    want = {}
    for w in range(30):
        n = sum(lo <= w * 40 + 40 and hi >= w * 40 + 1 for _, lo, hi in spans)
        if n:
            want[(1, w)] = n
    assert {(f, w): n for f, w, n in rows(catalogue.symbols_in_windows(spark, str(tmp_path)))} == want and (1, 25) in want


def test_calls_resolve_to_imported_files(spark, tmp_path):
    asts = [
        parsed(1, "p/main.py", [("go", 1, 9), ("own", 20, 21)], [("lib.load", 3), ("own", 4), ("far", 5)], ["p.lib"]),
        parsed(2, "p/lib.py", [("load", 1, 2), ("own", 3, 4)]),
        parsed(3, "q/other.py", [("load", 1, 2), ("own", 3, 4), ("far", 5, 6)]),
        parsed(4, "q/alone.py", [("run", 1, 9)], [("load", 2)], ["missing.thing"]),
    ]
    put(tmp_path, "file_asts", asts, ASTS)
    put(tmp_path, "files", [{"path": a["path"]} for a in asts], pa.schema([("path", pa.string())]))
    want = [(1, "go", 1, "own"), (1, "go", 2, "load"), (1, "go", 2, "own"), (1, "go", 3, "far"), (4, "run", 2, "load"), (4, "run", 3, "load")]
    assert rows(catalogue.call_resolution(spark, str(tmp_path)).select("file_id", "caller", "to_file", "callee")) == want


def test_calibration_fit_of_scores_as_they_are(spark):
    rng = random.Random(5)
    pooled = [(k / 1000, rng.randrange(1, 6)) for k in sorted(rng.sample(range(1, 1000), 90))]
    pooled = [(x, n, sum(rng.random() < x for _ in range(n))) for x, n in pooled]
    want = []
    for i in range(len(pooled)):  # min-max form
        low = [min(sum(h for *_, h in pooled[b : c + 1]) / sum(n for _, n, _ in pooled[b : c + 1]) for c in range(i, len(pooled))) for b in range(i + 1)]
        want.append((pooled[i][0], round(max(low), 9)))
    df = spark.createDataFrame(pooled, "x double, n long, hits long").repartition(3)
    assert [(x, round(y, 9)) for x, y in evaluate.isotonic_fit(df)] == want
    assert sorted((x, round(y, 9)) for x, y in evaluate.fitted(df).collect()) == want
    assert evaluate.isotonic_fit(df.where("false")) == []


FINDINGS = pa.schema([("finding_id", pa.int64()), ("file", pa.string()), ("cwe", pa.string()), ("score", pa.float64()), ("verified", pa.bool_())])


def test_calibration_fit_keeps_three_digits(spark, tmp_path):
    data = [(1, "f", 0.001, True), (2, "g", 0.002, False), (3, "h", 0.501, False), (4, "i", 0.502, True)]
    put(tmp_path, "findings", [{"finding_id": i, "file": f, "cwe": "A", "score": s, "verified": v} for i, f, s, v in data], FINDINGS)
    assert rows(catalogue.calibration_fit(spark, str(tmp_path))) == [(0.001, 0.333333333), (0.002, 0.333333333), (0.501, 0.333333333), (0.502, 1.0)]
