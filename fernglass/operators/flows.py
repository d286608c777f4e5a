"""Flows of data: what a function does with each of its parameters, and paths of such steps from entry points to sinks.

Summaries are made function by function; paths are a join of summaries with themselves, round by round.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernglass.functions.verdicts import path_confidence
from fernglass.session import materialize

_NAME = re.compile(r"[A-Za-z_$][\w$]*")
_ASSIGNED = re.compile(r"^\s*(?:(?:var|let|const|final|auto|[A-Z][\w<>\[\], ]*|int|long|double|boolean|string|char)\s+)?([A-Za-z_$][\w$]*)\s*(?::\s*[^=]+)?(?::=|=)(?![=>])\s*(.+)$")
_CALL = re.compile(r"([A-Za-z_$][\w$.]*)\s*\(")
_GUARD = re.compile(r"^\s*(?:\}?\s*else\s+)?(?:if|elif|while|unless|guard|assert)\b")
SUMMARY = "file_id long, function string, param int, name string, what string, target string, argument int, line int, cleaned boolean, guarded boolean"


def indent(line: str) -> int:
    """Columns of a line's leading blanks, a tab being four."""
    n = 0
    for c in line:
        if c not in " \t":
            break
        n += 4 if c == "\t" else 1
    return n


def brace_balance(line: str) -> int:
    """Opening less closing braces of a line, those in strings not counted."""
    depth, quote, skip = 0, "", False
    for c in line:
        if skip:
            skip = False
        elif quote:
            skip, quote = c == "\\", "" if c == quote else quote
        elif c in "\"'`":
            quote = c
        else:
            depth += (c == "{") - (c == "}")
    return depth


def split_list(text: str) -> list[str]:
    """The parts of a list at its top-level commas, without outer blanks; brackets and strings keep theirs."""
    parts, depth, quote, at, skip = [], 0, "", 0, False
    for i, c in enumerate(text):
        if skip:
            skip = False
        elif quote:
            skip, quote = c == "\\", "" if c == quote else quote
        elif c in "\"'`":
            quote = c
        elif c in "([{<":
            depth += 1
        elif c in ")]}>" and depth:
            depth -= 1
        elif c == "," and not depth:
            parts.append(text[at:i].strip())
            at = i + 1
    last = text[at:].strip()
    return [*parts, last] if last or parts else []


def bracketed(text: str, at: int) -> str:
    """What stands between the bracket at a place and the one that closes it; to the end without one."""
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] == "(") - (text[i] == ")")
        if not depth:
            return text[at + 1 : i]
    return text[at + 1 :]


def parameters(language: str, signature: str) -> list[str]:
    """The names of a function's parameters in order, without types, defaults, stars and, in Python, self and cls."""
    start = signature.find("(")
    if language == "go" and re.match(r"\s*func\s*\(", signature):  # behind the receiver
        close = signature.find(")", start)
        start = signature.find("(", close)
    if start < 0:
        return []
    out = []
    for p in split_list(bracketed(signature, start)):
        p = re.sub(r"^(?:@\w+(?:\([^)]*\))?\s*)*(?:(?:final|public|private|protected|readonly)\s+)*", "", p.split("=")[0]).strip().lstrip("*.&")
        names = _NAME.findall(p)
        if not names:
            continue
        name = names[-1] if language == "java" else names[0]
        if language == "python" and name in ("self", "cls"):
            continue
        out.append(name)
    return out


def summarised(language: str, lines: Sequence[str], first: int, sinks: Sequence[str], cleaners: Sequence[str]) -> list[tuple]:
    """(param, name, what, target, argument, line, cleaned, guarded) of what a function does with its parameters.

    lines are the function's, the first being number first of its file. what is call (a parameter's value is given to
    another function's argument), sink or return. A name carries the parameters that its last assignment was made of; a
    cleaner on the way marks them cleaned, a condition on a line around marks what stands in its block as guarded.
    """
    head = ""
    body = 0
    for body, line in enumerate(lines):
        head += line + "\n"
        if head.count("(") and head.count("(") == head.count(")"):
            break
    names = parameters(language, head)
    carried: dict[str, dict[int, bool]] = {n: {i: False} for i, n in enumerate(names)}
    braced = language != "python"
    guards: list[tuple[int, frozenset[int]]] = []
    depth = brace_balance(lines[body]) if len(lines) > body else 0
    out: list[tuple] = []
    for no, line in enumerate(lines[body + 1 :], first + body + 1):
        code = re.split(r"//|(?<!\S)#", line)[0]
        if not code.strip():
            continue
        level = depth if braced else indent(line)
        guards = [(at, who) for at, who in guards if level > at]
        found = {p: c for n in _NAME.findall(code) for p, c in carried.get(n, {}).items()}
        safe = frozenset().union(*(who for _, who in guards)) if guards else frozenset()
        cleans = any(c in code for c in cleaners)
        if _GUARD.match(code) and found:
            guards.append((level, frozenset(found)))
        for p in sorted(found):
            if any(s in code for s in sinks):
                out.append((p, names[p], "sink", next(s for s in sinks if s in code), 0, no, found[p] or cleans, p in safe))
            if re.match(r"\s*return\b", code):
                out.append((p, names[p], "return", "", 0, no, found[p] or cleans, p in safe))
        for m in _CALL.finditer(code):
            callee = m[1].rsplit(".", 1)[-1]
            if callee in ("if", "for", "while", "switch", "return", "catch", "func", "function") or any(c.rstrip("(") == callee for c in (*cleaners, *sinks)):
                continue
            for k, a in enumerate(split_list(bracketed(code, m.end() - 1))):
                for p, c in sorted({p: c for n in _NAME.findall(a) for p, c in carried.get(n, {}).items()}.items()):
                    out.append((p, names[p], "call", callee, k, no, c or any(x in a for x in cleaners), p in safe))
        m = _ASSIGNED.match(code)
        if m:
            made = {p: c or any(x in m[2] for x in cleaners) for n in _NAME.findall(m[2]) for p, c in carried.get(n, {}).items()}
            if made:
                carried[m[1]] = made
            else:
                carried.pop(m[1], None)
        depth += brace_balance(code)
    return out


def summaries(functions: DataFrame, sinks: Sequence[str], cleaners: Sequence[str]) -> DataFrame:
    """SUMMARY of functions (file_id, language, function, start_line, body array of lines); NULL bodies give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, language, name, first, body in zip(*(c.to_pylist() for c in batch.columns)):
                rows += [(i, name, *r) for r in summarised(language or "", body, first, sinks, cleaners)]
            rows = [(i, name, p, n, what, target, k, no, bool(c), bool(g)) for i, name, p, n, what, target, k, no, c, g in rows]
            cols = list(zip(*rows)) or [[]] * 10
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds)], names=["file_id", "function", "param", "name", "what", "target", "argument", "line", "cleaned", "guarded"])

    return functions.where("body IS NOT NULL").select("file_id", "language", "function", "start_line", "body").mapInArrow(run, SUMMARY)


def paths(summary: DataFrame, calls: DataFrame, entries: DataFrame, depth: int = 6) -> DataFrame:
    """(file_id, function, param, hops, sink_file, sink_line, sink, cleaned, guarded, confidence, steps): simple paths from the
    parameters of entries (file_id, function) to sinks, over at most depth calls.

    calls has (file_id, caller, to_file, callee), the resolved edges. A path visits a function's parameter once. Each round
    joins what was reached with the summaries and is written down; the number of paths can grow with calls ** depth, which
    is the question's. In the order of the sources' files, the sink's lines and the hops where sorted by them.
    """
    s = materialize(summary.distinct(), "summary")
    step = s.where("what = 'call'").join(calls.select("file_id", F.col("caller").alias("function"), "to_file", F.col("callee").alias("target")).distinct(), ["file_id", "function", "target"])
    step = materialize(step.select("file_id", "function", "param", "to_file", F.col("target").alias("to_function"), F.col("argument").alias("to_param"), "cleaned", "guarded", "line"), "steps")
    key = lambda f, n, p: F.concat_ws(":", f.cast("string"), n, p.cast("string"))
    at = s.join(entries.select("file_id", "function").distinct(), ["file_id", "function"], "left_semi").select("file_id", "function", "param").distinct()
    here = at.select("file_id", "function", "param", F.col("file_id").alias("f"), F.col("function").alias("n"), F.col("param").alias("p"), F.array(key(F.col("file_id"), F.col("function"), F.col("param"))).alias("steps"), F.lit(False).alias("c"), F.lit(False).alias("g"))
    sinks = s.where("what = 'sink'").select(F.col("file_id").alias("f"), F.col("function").alias("n"), F.col("param").alias("p"), F.col("line").alias("sink_line"), F.col("target").alias("sink"), "cleaned", "guarded").distinct()
    out = None
    for hop in range(depth + 1):
        ends = here.join(sinks, ["f", "n", "p"]).select("file_id", "function", "param", F.lit(hop + 2).alias("hops"), F.col("f").alias("sink_file"), "sink_line", "sink", (F.col("c") | F.col("cleaned")).alias("cleaned"), (F.col("g") | F.col("guarded")).alias("guarded"), "steps")
        out = ends if out is None else out.union(ends)
        if hop == depth:
            break
        there = step.select(F.col("file_id").alias("f"), F.col("function").alias("n"), F.col("param").alias("p"), "to_file", "to_function", "to_param", "cleaned", "guarded")
        moved = here.join(there, ["f", "n", "p"]).withColumn("k", key(F.col("to_file"), F.col("to_function"), F.col("to_param"))).where("NOT array_contains(steps, k)")
        here = materialize(moved.select("file_id", "function", "param", F.col("to_file").alias("f"), F.col("to_function").alias("n"), F.col("to_param").alias("p"), F.concat("steps", F.array("k")).alias("steps"), (F.col("c") | F.col("cleaned")).alias("c"), (F.col("g") | F.col("guarded")).alias("g")).distinct(), "reach")
        if not here.limit(1).count():
            break
    return out.withColumn("confidence", F.round(path_confidence(F.col("hops"), F.col("cleaned").cast("int"), F.lit(False)), 9)).distinct()
