"""Source files that do not parse: least syntax repairs by error-correcting chart parsing, and rates of invalid files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernglass.llm.syntax.languages import EXTENSION
from fernglass.llm.syntax.repair import Repairer

#: A worker process keeps what it has learnt about shapes from one task to the next.
_REPAIRERS: dict[str, Repairer] = {}
_MARKER = re.compile(r"(?m)^(?:<{7}|>{7}|={7})(?:\s|$)")
#: Results of contents that a task remembers, for files that were scanned again.
SEEN = 50_000
#: More edits a line than this, from the head of the text on, speak for another language than the extension's.
FOREIGN = 0.3


def kind_of(content: str, edits: float, places: list[int], opened: bool) -> str:
    """What the places of edits (lines) and their number say of an invalid text: conflict, truncated, mismatch or edit.

    A conflict has a place within the lines of its markers. Of a truncated text brackets are open, and once they are closed no
    place lies before its last lines. A text of another language needs many edits from its head on.
    """
    lines = content.rstrip().count("\n") + 1
    marks = [content.count("\n", 0, m.start()) + 1 for m in _MARKER.finditer(content)]
    if marks and any(marks[0] - 1 <= p <= marks[-1] + 1 for p in places):
        return "conflict"
    spread = edits > 3 and edits > FOREIGN * lines and bool(places) and min(places) <= 0.3 * lines + 1
    if places and min(places) >= lines - 1 and (opened or lines > 3):
        return "truncated"
    return "mismatch" if spread else "edit"


def judged(content: str, repairer: Repairer, markup: bool = True, places: bool = True) -> tuple[int, str | None, list[int] | None]:
    """(edits found, kind, lines to edit) of a text; kind and lines are NULL for valid ones, and where places are not asked for."""
    edits, opened = repairer.repair(content, markup)
    if not edits or not places:
        return int(edits), None, None
    at = repairer.places(content, markup)
    closers = repairer.closers(content) if opened else ""
    if closers:  # the same with what is open closed at the end: fewer edits, of which the closing ones are at the last line
        closed = f"{content}\n{closers}\n"
        fewer = repairer.repair(closed, markup)[0] + len(closers)
        if fewer <= edits:
            last = content.rstrip().count("\n") + 1
            edits, at = fewer, sorted({min(p, last) for p in repairer.places(closed, markup)} | {last})
    return int(edits), kind_of(content, edits, at, opened), at


def syntax_check(asts: DataFrame, files: DataFrame, places: bool = True) -> DataFrame:
    """(file_id, repo, language, edits, kind, lines): every record of asts with content, once, judged by its path's extension.

    lines are those to edit, kind is what they say (kind_of); both are NULL for valid content, and without places.

    asts has (file_id, path), files (file_id, repo, content). language is what the extension stands for; records of other
    extensions, without a content or with a NULL id or path give no row, repeated records give one. edits is 0 if and only
    if the content is valid; empty content is for Python, JavaScript and TypeScript, and for Java, but not for Go. NULL
    bytes and bytes of other encodings are invalid outside of strings and comments.
    """
    record = asts.where("file_id IS NOT NULL AND path IS NOT NULL").select(F.col("file_id").cast("long").alias("file_id"), F.lower(F.regexp_extract("path", r"(\.[^./\\]+)$", 1)).alias("ext")).distinct()
    text = files.where("content IS NOT NULL").select(F.col("file_id").cast("long").alias("file_id"), "repo", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairers = _REPAIRERS
        seen: dict[tuple[str, int], tuple[int, str | None, list[int] | None]] = {}
        for batch in batches:
            ids, exts, repos, out, langs, kinds, lines = [], batch.column(1).to_pylist(), [], [], [], [], []
            for i, ext, repo, content in zip(batch.column(0).to_pylist(), exts, batch.column(2).to_pylist(), batch.column(3)):
                lang = EXTENSION.get(ext)
                if lang is None:
                    continue
                if lang not in repairers:
                    repairers[lang] = Repairer(lang)
                s = content.as_py()
                key = (ext, xxhash.xxh3_64_intdigest(s))
                found = seen.get(key)
                if found is None:
                    found = judged(s, repairers[lang], ext != ".ts", places)
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen[key] = found
                ids.append(i)
                repos.append(repo)
                langs.append({"js": "javascript", "ts": "typescript", "py": "python"}.get(lang, lang))
                out.append(found[0])
                kinds.append(found[1])
                lines.append(found[2])
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(repos, pa.string()), pa.array(langs, pa.string()), pa.array(out, pa.int32()), pa.array(kinds, pa.string()), pa.array(lines, pa.list_(pa.int32()))], names=["file_id", "repo", "language", "edits", "kind", "lines"])

    return text.join(record, "file_id").select("file_id", "ext", "repo", "content").mapInArrow(run, "file_id long, repo string, language string, edits int, kind string, lines array<int>").distinct()


def invalid_rates(checked: DataFrame) -> DataFrame:
    """(repo, language, files, invalid, rate) of each repo and language, of each repo (language NULL), and of all (both NULL)."""
    rates = checked.rollup("repo", "language").agg(F.count("*").alias("files"), F.sum((F.col("edits") > 0).cast("int")).alias("invalid"))
    return rates.withColumn("rate", F.round(F.col("invalid") / F.col("files"), 6))
