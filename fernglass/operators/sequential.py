"""Operators whose state runs along a sequence: packing, squeezing, data flow in a file, and JSON in noisy text.

The machines are plain functions, tested as such; they run in batches, a sequence being an array in one row.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pack(sizes: list[int], target: int, least: int) -> list[tuple[int, int]]:
    """(first, last) of runs of consecutive items of at most target together; a last run below least joins the one before."""
    out: list[tuple[int, int]] = []
    start, total = 0, 0
    for i, s in enumerate(sizes):
        if i > start and total + s > target:
            out.append((start, i - 1))
            start, total = i, 0
        total += s
    if sizes:
        if out and total < least:
            out[-1] = (out[-1][0], len(sizes) - 1)
        else:
            out.append((start, len(sizes) - 1))
    return out


def admit(sizes: list[int], budget: int, floor: int = 0) -> list[int]:
    """The size granted to each item in order: all of it, what is left if that is at least floor (squeezed), or 0 (skipped)."""
    left, out = budget, []
    for s in sizes:
        grant = s if s <= left else left if floor and left >= floor else 0
        left -= grant
        out.append(grant)
    return out


def squeeze_lines(lines: list[str], keep: int, floor: int = 5) -> list[str]:
    """The first and last lines around a note of how many are left out, so that at most keep stay (floor each at least)."""
    head = tail = max(floor, keep // 2)
    if len(lines) <= head + tail:
        return lines
    return [*lines[:head], f"... {len(lines) - head - tail} lines ...", *lines[-tail:]]


def balanced_json(text: str | None, last: bool = False) -> str | None:
    """The first (or last) balanced object or array in a text, brackets in its strings not counted, if it is valid JSON."""
    if not text:
        return None
    found = None
    at = 0
    while at < len(text):
        if text[at] not in "{[":
            at += 1
            continue
        depth, quoted, escaped = [], False, False
        for i in range(at, len(text)):
            c = text[i]
            if quoted:
                escaped, quoted = (c == "\\" and not escaped), quoted if escaped or c != '"' else False
            elif c == '"':
                quoted = True
            elif c in "{[":
                depth.append("}" if c == "{" else "]")
            elif c in "}]":
                if not depth or depth.pop() != c:
                    break
                if not depth:
                    try:
                        json.loads(text[at : i + 1])
                    except ValueError:
                        break
                    found = text[at : i + 1]
                    if not last:
                        return found
                    at = i
                    break
        at += 1
    return found


_ASSIGN = re.compile(r"^\s*(?:var\s+|let\s+|const\s+|[A-Za-z_][\w<>\[\], ]*\s+)?([A-Za-z_$][\w$]*)\s*(?::[^=]*)?(?::=|=)(?!=)\s*(.*)$")
_NAME = re.compile(r"[A-Za-z_$][\w$]*")


def flows(lines: list[str], sources: list[str], sinks: list[str], cleaners: list[str]) -> list[tuple[int, int, str, bool]]:
    """(source line, sink line, name, cleaned): values of a file that come from a source and reach a sink, line by line.

    A name is tainted by an assignment whose right side holds a source or a tainted name, and no longer by one that does
    not. A cleaner on the way marks the flow as cleaned.
    """
    tainted: dict[str, tuple[int, bool]] = {}
    out = []
    for no, line in enumerate(lines, 1):
        code = line.split("//")[0].split("#")[0]
        names = set(_NAME.findall(code))
        if any(s in code for s in sinks):
            out += [(tainted[n][0], no, n, tainted[n][1] or any(c in code for c in cleaners)) for n in sorted(names & tainted.keys())]
        m = _ASSIGN.match(code)
        if m:
            right = set(_NAME.findall(m[2]))
            cleaned = any(c in m[2] for c in cleaners)
            if any(s in m[2] for s in sources):
                tainted[m[1]] = (no, cleaned)
            elif right & tainted.keys():
                origin = min(tainted[n] for n in right & tainted.keys())
                tainted[m[1]] = (origin[0], origin[1] or cleaned)
            else:
                tainted.pop(m[1], None)
    return out


def map_rows(df: DataFrame, column: str, keys: list[str], function: Callable[[object], list[tuple]], schema: str) -> DataFrame:
    """(keys..., schema): the function's rows for each row's column, in Arrow batches."""
    fields = T._parse_datatype_string(schema).fields
    sel = df.select(*keys, column)
    full = T.StructType([*(sel.schema[k] for k in keys), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(full)
        for batch in batches:
            rows = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                rows += [(*row[:-1], *out) for out in function(row[-1])]
            cols = list(zip(*rows)) or [[]] * len(full)
            yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(cols, arrow)], schema=arrow)

    return sel.mapInArrow(run, full)


def packed_symbols(symbols: DataFrame, key: str, target: int, least: int) -> DataFrame:
    """(key, run_no, first_line, last_line, size): symbols of a file (start_line, end_line) packed by their lines."""
    items = symbols.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start_line", "end_line"))).alias("items"))

    def run(rows) -> list[tuple]:
        sizes = [r["end_line"] - r["start_line"] + 1 for r in rows]
        return [(i, rows[a]["start_line"], rows[b]["end_line"], sum(sizes[a : b + 1])) for i, (a, b) in enumerate(pack(sizes, target, least))]

    return map_rows(items, "items", [key], run, "run_no int, first_line int, last_line int, size int")
