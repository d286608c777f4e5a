"""Small documents that steer a run: rule tables, rate tables, examples, notes with a head, settings, models."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Sequence
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    import yaml
except ImportError:  # only the readers of YAML need it
    yaml = None

RULES = "id string, language string, categories array<string>, patterns array<string>, callees array<string>, negative boolean, position int"
EXAMPLES = "skill string, path string, language string, code string, note string"
#: The schema of calibration models that are read and written.
MODEL_VERSION = 1


def _yaml():
    if yaml is None:
        raise ImportError("reading YAML needs the yaml package")
    return yaml


def rule_rows(text: str) -> list[dict]:
    """The rules of a YAML text of one or more documents, each a list of rules; what is no rule, and patterns that are no
    regular expressions, are left out. A rule holds for each of its languages."""
    rows: list[dict] = []
    for document in _yaml().safe_load_all(text):
        for r in document if isinstance(document, list) else ():
            if not isinstance(r, dict) or not r.get("id"):
                continue
            sound = []
            for p in r.get("patterns") or ():
                try:
                    re.compile(p)
                    sound.append(p)
                except (re.error, TypeError):
                    continue
            for language in r.get("languages") or [r.get("language") or ""]:
                rows.append({"id": str(r["id"]), "language": str(language).lower(), "categories": [str(c).lower() for c in r.get("categories") or ()], "patterns": sound, "callees": [str(c) for c in r.get("callees") or ()], "negative": bool(r.get("negative"))})
    return rows


def rule_table(spark: SparkSession, *paths: str) -> DataFrame:
    """The rules of YAML files (RULES), in the order of the files."""
    rows = [r for p in paths for r in rule_rows(open(p, encoding="utf-8").read())]
    return spark.createDataFrame([(*r.values(), i) for i, r in enumerate(rows)], RULES)


def rates(spark: SparkSession, path: str) -> DataFrame:
    """(model, in_rate, out_rate) of a YAML mapping of models to input and output; default is a model like the others."""
    book = _yaml().safe_load(open(path, encoding="utf-8")) or {}
    book = book.get("models", book)
    return spark.createDataFrame([(m, float(r.get("input") or 0), float(r.get("output") or 0)) for m, r in book.items() if isinstance(r, dict)], "model string, in_rate double, out_rate double")


def example_rows(text: str) -> list[dict]:
    """The examples of a JSON text, one object or an array of them; those without code, and texts that are no JSON, give none."""
    try:
        got = json.loads(text)
    except ValueError:
        return []
    return [e for e in (got if isinstance(got, list) else [got]) if isinstance(e, dict) and e.get("code")]


def examples(spark: SparkSession, folders: Sequence[str]) -> DataFrame:
    """The examples (EXAMPLES) of the JSON files below each folder; the folder's name is the skill."""
    rows = []
    for folder in folders:
        for d, _, names in sorted(os.walk(folder)):
            for n in sorted(names):
                if n.lower().endswith(".json"):
                    path = os.path.join(d, n)
                    rows += [(os.path.basename(os.path.normpath(folder)), path, e.get("language"), e["code"], e.get("note")) for e in example_rows(open(path, encoding="utf-8", errors="replace").read())]
    return spark.createDataFrame(rows, EXAMPLES)


def headed(text: str) -> tuple[dict, str]:
    """(head, body) of a text that begins with a YAML head between lines of ---; an error without one."""
    t = text.lstrip("﻿")
    m = re.match(r"---[ \t]*\r?\n([\s\S]*?)\r?\n---[ \t]*(?:\r?\n|\Z)", t)
    if not m:
        raise ValueError("no head between lines of ---" if not t.startswith("---") else "the head does not end")
    head = _yaml().safe_load(m[1])
    if not isinstance(head, dict) or not head.get("name"):
        raise ValueError("the head has no name")
    return {"kind": "scanner", **head}, t[m.end() :].strip()


def headed_notes(spark: SparkSession, root: str, file_name: str) -> DataFrame:
    """(name, kind, head, body, path) of the folders of root that hold the file; folders that begin with _ are left out, and
    so are notes with a broken head."""
    rows = []
    for d in sorted(os.listdir(root)) if os.path.isdir(root) else ():
        path = os.path.join(root, d, file_name)
        if d.startswith("_") or not os.path.isfile(path):
            continue
        try:
            head, body = headed(open(path, encoding="utf-8").read())
        except ValueError:
            continue
        rows.append((str(head["name"]), str(head["kind"]), json.dumps(head, sort_keys=True, default=str), body, path))
    return spark.createDataFrame(rows, "name string, kind string, head string, body string, path string")


def special_note(root: str, folder: str, file_name: str) -> tuple[dict, str] | None:
    """The note of a folder whose name begins with _, or None where there is none."""
    if not folder.startswith("_"):
        raise ValueError(f"{folder} does not begin with _")
    path = os.path.join(root, folder, file_name)
    return headed(open(path, encoding="utf-8").read()) if os.path.isfile(path) else None


def notes(path: str, most: int = 8192) -> str:
    """A text of at most so many bytes, without outer blanks; empty where there is none."""
    if not os.path.isfile(path):
        return ""
    with open(path, "rb") as f:
        return f.read(most).decode("utf-8", "ignore").strip()


def save_notes(path: str, text: str, most: int = 8192, marker: str = "\n[...truncated]") -> None:
    """A text written aside and then put in its place; of a longer one as much as fits before the marker."""
    raw = text.encode()
    if len(raw) > most:
        raw = raw[: most - len(marker.encode())].decode("utf-8", "ignore").encode() + marker.encode()
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(f"{path}.tmp", "wb") as f:
        f.write(raw)
    os.replace(f"{path}.tmp", path)


def save_model(knots: DataFrame, path: str) -> None:
    """Knots (x, y) of a calibration with the version of their schema."""
    knots.select(F.lit(MODEL_VERSION).alias("version"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).coalesce(1).write.mode("overwrite").json(path)


def load_model(spark: SparkSession, path: str) -> list[tuple[float, float]]:
    """The knots of a calibration in the order of x; another version is refused. A calibration has few knots by nature."""
    rows = spark.read.schema("version int, x double, y double").json(path).orderBy("x").collect()
    if any(r["version"] != MODEL_VERSION for r in rows):
        raise ValueError(f"a calibration of another version than {MODEL_VERSION}")
    return [(r["x"], r["y"]) for r in rows]


@dataclass(frozen=True)
class Settings:
    """What a run may be told; a file's settings go over the defaults, a call's over the file's."""

    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = (".git/", "node_modules/", "vendor/")
    max_bytes: int = 262_144
    max_files: int = 100_000
    votes: int = 1
    min_score: float = 0.0
    fail_on: str = ""
    level: str = "balanced"
    budget_tokens: int = 0
    context_window: int = 0
    extra: dict = field(default_factory=dict)

    @classmethod
    def load(cls, path: str | None = None, **over) -> Settings:
        kept = (_yaml().safe_load(open(path, encoding="utf-8")) or {}) if path else {}
        known = {f.name for f in fields(cls)}
        made = cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in kept.items() if k in known}, extra={k: v for k, v in kept.items() if k not in known})
        return replace(made, **{k: v for k, v in over.items() if v is not None}).checked()

    def checked(self) -> Settings:
        if self.max_bytes < 0 or self.max_files < 0 or self.votes < 1 or not 0 <= self.min_score <= 1:
            raise ValueError("a setting is out of its range")
        if self.fail_on and self.fail_on not in ("critical", "high", "medium", "low", "info"):
            raise ValueError(f"no severity: {self.fail_on}")
        return self

    def context_budget(self) -> int:
        """The budget, at most 0.7 of the window; without one 0.7 of the window; without either that of the level."""
        most = int(self.context_window * 0.7)
        if self.budget_tokens > 0:
            return min(self.budget_tokens, most) if most else self.budget_tokens
        return most or {"minimal": 40_000, "extreme": 120_000}.get(self.level.lower(), 80_000)


def backoff(base: float, most: float, attempt: int, jitter: float = 0.5) -> float:
    """Seconds before the next attempt: base doubled each time, at most most, a quarter less to a quarter more by jitter of 0 to 1."""
    if base <= 0:
        return 0.0
    wait = base * min(1 << max(0, attempt - 1), 1024)
    wait = min(wait, most) if most > 0 else wait
    wait = wait * (0.75 + 0.5 * jitter)
    return min(wait, most) if most > 0 else wait
