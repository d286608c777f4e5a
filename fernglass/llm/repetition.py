"""Repetition inside a document: measured exactly, and judged by rules whose accuracies are inferred, not assumed.

Rules on repeated word runs, sentences, lines, paragraphs, compressibility and vocabulary vote that a text is repetitive,
that it is not, or abstain. Expectation-maximisation over the counts of vote patterns (at most 3 to the number of rules,
whatever the size of the corpus) estimates each rule's votes under either truth; a document's score is the posterior.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernglass.session import materialize

WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: name: (a value of at least this votes for repetition, one of at most this against it). A text of which 0.3 of the 8-word
#: runs repeat has at least 0.3 of its 3-word runs and words repeated: those rules never vote against it.
RULES = {"runs": (0.3, 0.12), "triples": (0.3, 0.15), "sentences": (0.25, -1.0), "lines": (0.25, -1.0), "paragraphs": (0.25, -1.0), "squeeze": (4.5, 1.2), "vocabulary": (0.72, 0.28)}
SLICE = 4096


def run_shares(n_docs: int, doc: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
    """Of the runs of n consecutive words of each document the share that began earlier in it; doc ascends and is below 2^14."""
    if len(code) < n:
        return np.zeros(n_docs)
    with np.errstate(over="ignore"):
        x = (code.astype(np.uint64) + np.uint64(1)) * _GOLDEN
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        h = np.zeros(len(code) - n + 1, np.uint64)
        for i in range(n):
            h = h * np.uint64(0x5851F42D4C957F2D) + x[i : len(x) - n + 1 + i]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        key = (doc[: len(h)].astype(np.uint64) << np.uint64(50)) | (h >> np.uint64(14))
    key = np.sort(key[doc[: len(h)] == doc[n - 1 :]])
    d = (key >> np.uint64(50)).astype(np.int64)
    total = np.bincount(d, minlength=n_docs)
    again = np.bincount(d[1:][key[1:] == key[:-1]], minlength=n_docs)
    return again / np.maximum(total, 1)


def _repeated(parts: list[str]) -> float:
    """The share of characters in parts that came before; 0 for fewer than four parts."""
    parts = [p for p in (p.strip() for p in parts) if len(p) > 3]
    total = sum(map(len, parts))
    if len(parts) < 4 or not total:
        return 0.0
    return 1 - sum(map(len, set(parts))) / total


def measures(texts: list[str | None]) -> dict[str, np.ndarray]:
    """The rules' values of each text; runs is the share of 8-word runs that began earlier."""
    words = [WORD.findall(t.lower()) if t else [] for t in texts]
    size = np.array([len(w) for w in words])
    flat = [w for ws in words for w in ws]
    code = pd.factorize(np.array(flat, dtype=object))[0] if flat else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(texts)), size)
    raw = [(t or "").encode() for t in texts]
    return {
        "runs": run_shares(len(texts), doc, code, 8),
        "triples": run_shares(len(texts), doc, code, 3),
        "sentences": np.array([_repeated(_SENTENCE.findall(t or "")) for t in texts]),
        "lines": np.array([_repeated((t or "").split("\n")) for t in texts]),
        "paragraphs": np.array([_repeated((t or "").split("\n\n")) for t in texts]),
        "squeeze": np.array([len(b) / len(zlib.compress(b, 1)) if b else 1.0 for b in raw]),
        "vocabulary": run_shares(len(texts), doc, code, 1),
    }


def fit(votes: np.ndarray, count: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray, np.ndarray]:
    """(share of class 1, P(vote 1 | class, voting) as rules x 2, posterior of each pattern) by expectation-maximisation.

    votes is patterns x rules of -1 (abstains), 0 or 1. It starts from the majority of each pattern's votes. Abstaining tells
    nothing of the class. Rules are taken to be no worse than chance, and a few pseudo-votes say so before there are any, so
    no probability is 0.
    """
    n, rules = votes.shape
    if not n:
        return 0.0, np.full((rules, 2), 0.5), np.zeros(0)
    yes, no = votes == 1, votes == 0
    post = np.clip((yes.sum(1) + 0.1) / (yes.sum(1) + no.sum(1) + 1.0), 0.02, 0.98)
    prior, rate = 0.5, np.zeros((rules, 2))
    for _ in range(rounds):
        prior = float((post * count).sum() / count.sum())
        for c, weight in enumerate(((1 - post) * count, post * count)):
            up, down = weight @ yes, weight @ no
            rate[:, c] = (up + 1 + c) / (up + down + 3)
        rate[:, 0], rate[:, 1] = np.minimum(rate[:, 0], 0.5), np.maximum(rate[:, 1], 0.5)
        odds = np.log(max(prior, 1e-9) / max(1 - prior, 1e-9)) + yes @ np.log(rate[:, 1] / rate[:, 0]) + no @ np.log((1 - rate[:, 1]) / (1 - rate[:, 0]))
        new = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return prior, rate, post


def repetition(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, share, probability, votes): the share of 8-word runs that began earlier, the posterior of being repetitive,
    and how many rules vote for it.

    Words are runs of letters and digits, lower case; fewer than eight give share 0, as do NULL and empty texts. Rows are
    judged one by one over their whole text; rules and posteriors are fitted on all rows. An empty table gives no rows.
    """
    names = list(RULES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                m = measures(part.column(1).to_pylist())
                pattern = np.zeros(part.num_rows, np.int64)
                for name in names:
                    high, low = RULES[name]
                    pattern = pattern * 3 + np.where(m[name] >= high, 2, np.where(m[name] <= low, 1, 0))
                yield pa.record_batch([part.column(0), pa.array(m["runs"]), pa.array(pattern)], names=["doc_id", "share", "pattern"])

    voted = materialize(documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, share double, pattern long"), "votes")
    seen = [(r["pattern"], r["count"]) for r in voted.groupBy("pattern").count().collect()]  # at most 3^7 rows
    votes = np.array([[p // 3 ** (len(names) - 1 - i) % 3 - 1 for i in range(len(names))] for p, _ in seen], np.int64).reshape(-1, len(names))
    _, _, post = fit(votes, np.array([n for _, n in seen], float))
    scores = documents.sparkSession.createDataFrame([(p, float(x), int((v == 1).sum())) for (p, _), x, v in zip(seen, post, votes)], "pattern long, probability double, votes int")
    return voted.join(F.broadcast(scores), "pattern").select("doc_id", "share", "probability", "votes")
