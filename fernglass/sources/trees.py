"""Source trees over several roots, and what version control says of their files."""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernglass.functions import text as T

FILES = "path string, language string, content string, lines int"


def _plain(path: str) -> str:
    return re.sub(r"^file:/*", "/", path)


def scanned(spark: SparkSession, root: str, include: Sequence[str] = (), exclude: Sequence[str] = (), max_bytes: int = 262_144, follow_links: bool = False) -> DataFrame:
    """(path, language, content, lines) of the files below root, of known languages and up to max_bytes.

    exclude has parts of a path or globs on its base name, include globs on the base name of which one must fit (none: all).
    Links are left out unless follow_links; what is a link is found by listing names, not contents. Bytes that are no UTF-8
    come out as replacement characters.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    if max_bytes:
        raw = raw.where(F.col("length") <= max_bytes)
    path = F.regexp_replace("path", r"^file:/*", "/")
    raw = raw.withColumn("path", path).where(~T.is_excluded(F.col("path"), tuple(exclude)))
    if include:
        raw = raw.where(reduce(lambda a, b: a | b, (T.base_name(F.col("path")).rlike(T.glob_pattern(g)) for g in include)))
    if not follow_links and os.path.isdir(_plain(root)):
        links = [os.path.join(d, n) for d, ds, ns in os.walk(_plain(root)) for n in (*ds, *ns) if os.path.islink(os.path.join(d, n))]
        if links:
            out = spark.createDataFrame([(x,) for x in links], "link string")
            raw = raw.join(out, (F.col("path") == F.col("link")) | F.startswith(F.col("path"), F.concat("link", F.lit("/"))), "left_anti")
    language = T.looked_up(F.when(F.lower(T.base_name(F.col("path"))) == "dockerfile", ".dockerfile").otherwise(T.extension(F.col("path"))), T.LANGUAGES, "")
    text = F.decode("content", "UTF-8")
    return raw.where(language != "").select("path", language.alias("language"), text.alias("content"), (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).alias("lines"))


def below(root: str, path: str) -> str:
    """The absolute path of a path below root; one that leads out of it is refused, links resolved."""
    base = os.path.realpath(_plain(root))
    full = os.path.realpath(os.path.join(base, _plain(path)))
    if full != base and not full.startswith(base + os.sep):
        raise ValueError(f"{path} is not below {root}")
    return full


def scanned_roots(spark: SparkSession, root: str, roots: Sequence[str] = (), most: int = 100_000, **options) -> DataFrame:
    """scanned over several folders below root (root itself for none), each path once; more files than most are refused."""
    places = [below(root, r) for r in roots if r.strip()] or [below(root, ".")]
    for p in places:
        if not os.path.exists(p):
            raise FileNotFoundError(p)
    files = reduce(DataFrame.union, (scanned(spark, p, **options) for p in dict.fromkeys(places))).dropDuplicates(["path"])
    if most and files.select("path").limit(most + 1).count() > most:
        raise ValueError(f"more than {most} files")
    return files


def single_file(spark: SparkSession, path: str) -> DataFrame:
    """One file whatever its language, "text" where it is unknown; for a root that is a file and whose scan gives none."""
    text = F.decode("content", "UTF-8")
    raw = spark.read.format("binaryFile").load(path)
    return raw.select(F.regexp_replace("path", r"^file:/*", "/").alias("path"), T.language_of(F.col("path")).alias("language"), text.alias("content"), T.line_count(text).alias("lines"))


def discovered(spark: SparkSession, target: str, **options) -> DataFrame:
    """The files of a target: of a folder its scan, of a file the file itself."""
    return single_file(spark, target) if os.path.isfile(_plain(target)) else scanned_roots(spark, target, **options)


def named_classes(spark: SparkSession, root: str) -> DataFrame:
    """(file, cwe) of files whose name begins with a class and _: CWE89_x.java is of CWE-89. Only names are read; empty files are not listed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.regexp_replace("path", r"^file:/*", "/").alias("file"))
    number = F.regexp_extract(T.base_name(F.col("file")), r"^CWE(\d+)_", 1)
    return files.where(number != "").select("file", F.concat(F.lit("CWE-"), number).alias("cwe"))


# version control


def split_range(spec: str) -> tuple[str, str | None]:
    """(range, kind) of a range with or without a kind before a colon; only git and arc are kinds."""
    kind, colon, rest = spec.partition(":")
    return (rest, kind) if colon and kind in ("git", "arc") else (spec, None)


def repository_root(path: str, markers: Sequence[str] = (".git", ".arc")) -> tuple[str, str] | None:
    """(folder, kind) of the nearest folder at or above a path that holds a marker, or None."""
    here = os.path.abspath(_plain(path))
    here = here if os.path.isdir(here) else os.path.dirname(here)
    while True:
        for m in markers:
            if os.path.exists(os.path.join(here, m)):
                return here, m.lstrip(".")
        above = os.path.dirname(here)
        if above == here:
            return None
        here = above


def _lines(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(text,)], "t string").select(F.posexplode(F.split("t", "\n")).alias("n", "line"))


def changed_in_names(spark: SparkSession, text: str, root: str) -> DataFrame:
    """(path) of a list of names, one a line, blank lines left out; each once, below root."""
    names = _lines(spark, text).select(F.trim(F.regexp_replace("line", "\r", "")).alias("name")).where("name <> ''")
    return names.select(T.clean_path(F.concat_ws("/", F.lit(root), "name")).alias("path")).distinct()


def changed_in_status(spark: SparkSession, text: str, root: str) -> DataFrame:
    """(path) of a short status: two letters and a name a line, of a renamed file the new name; deleted ones left out."""
    rows = _lines(spark, text).select(F.regexp_replace("line", "\r", "").alias("line")).where(F.length("line") > 3)
    state, name = F.trim(F.substring("line", 1, 2)), F.trim(F.substring("line", 4, 1 << 20))
    name = F.when(name.contains(" -> "), F.regexp_extract(name, r" -> (.*)$", 1)).otherwise(name)
    return rows.where(~state.contains("D")).select(T.clean_path(F.concat_ws("/", F.lit(root), F.trim(name, F.lit('"')))).alias("path")).distinct()


def changed_in_log(spark: SparkSession, text: str, root: str) -> DataFrame:
    """(path) of a log with names: headers (commit, Author, Date, and what has a colon but neither slash nor point) left out."""
    line = F.trim("line")
    header = (line.contains(":") & ~line.rlike(r"[/.]")) | line.rlike(r"^(commit |Author|Date)")
    return _lines(spark, text).where((line != "") & ~header).select(T.clean_path(F.concat_ws("/", F.lit(root), line)).alias("path")).distinct()


def blame_porcelain(text: str) -> dict[str, str]:
    """commit, author, summary and time (epoch seconds) of one line's porcelain blame."""
    out = {"commit": "", "author": "", "summary": "", "time": ""}
    for line in text.split("\n"):
        if not out["commit"] and re.match(r"\S{40}", line):
            out["commit"] = line.split()[0]
        for key, word in (("author", "author "), ("summary", "summary "), ("time", "author-time ")):
            if line.startswith(word):
                out[key] = line[len(word) :]
    return out


#: commit (author date zone line) text
BLAME = r"^([0-9a-fA-F]{6,40})\s+\((.+?)\s+(\d{4}-\d{2}-\d{2}[T ]?\S*)(?:\s+[+\-]\d{4})?\s+(\d+)\)\s?(.*)$"


def blamed(lines: DataFrame, column: str = "line") -> DataFrame:
    """lines with commit, author, date, at and text of a plain blame's lines; of others the first word where it may be a commit."""
    line = F.regexp_replace(column, "\r$", "")
    names = ("commit", "author", "date", "at", "text")
    found = {n: F.trim(F.regexp_extract(line, BLAME, i + 1)) for i, n in enumerate(names)}
    first = F.regexp_extract(line, r"^\s*(\S+)", 1)
    found["commit"] = F.when(found["commit"] != "", found["commit"]).when(F.length(first) >= 6, first).otherwise("")
    return lines.withColumns(found)


def git(root: str, *arguments: str, seconds: int = 30) -> str:
    """What git prints; an error where it fails."""
    done = subprocess.run(["git", *arguments], cwd=_plain(root), capture_output=True, text=True, timeout=seconds)
    if done.returncode:
        raise RuntimeError(done.stderr.strip())
    return done.stdout


def changed_files(spark: SparkSession, root: str, spec: str = "") -> DataFrame:
    """(path) of the files added, copied, modified or renamed in a range, or against the last commit."""
    place, _ = split_range(spec)
    return changed_in_names(spark, git(root, "diff", "--name-only", "--diff-filter=ACMR", place or "HEAD"), root)


def current_branch(root: str) -> str:
    return git(root, "rev-parse", "--abbrev-ref", "HEAD").strip()


def tracked_files(spark: SparkSession, root: str) -> DataFrame:
    return changed_in_names(spark, git(root, "ls-files"), root)
