"""Evaluation texts inside training text, by suffix arrays over the training text.

Each batch of documents is a shard: its words are numbered, every place from which a passage could start is sorted by the
words that follow (a suffix array), and every suffix of every test item is looked up by binary search. Passages found are
joined along the text to the longest verbatim matches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
#: Every task holds the test set; of one with more characters than this a part at a time.
MAX_TEST_CHARS = 64_000_000


def _packed(codes: np.ndarray, at: np.ndarray, words: int, bits: int) -> list[np.ndarray]:
    """The first words codes from each place, packed into as few uint64 columns as hold them, most significant first."""
    per = 64 // bits
    cols = []
    for first in range(0, words, per):
        n = min(per, words - first)
        col = np.zeros(len(at), np.uint64)
        for i in range(first, first + n):
            col = (col << np.uint64(bits)) | codes[at + i]
        cols.append(col)
    return cols


def _search(cols: list[np.ndarray], probe: list[np.ndarray], right: bool) -> np.ndarray:
    """Binary search of all probes in the sorted columns at once: the first place not before (right: after) each probe."""
    lo = np.zeros(len(probe[0]), np.int64)
    hi = np.full(len(probe[0]), len(cols[0]), np.int64)
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        safe = np.minimum(mid, len(cols[0]) - 1)
        less, same = np.zeros(len(mid), bool), np.ones(len(mid), bool)
        for c, p in zip(cols, probe):
            v = c[safe]
            less |= same & (v < p)
            same &= v == p
        go = less | same if right else less
        lo = np.where(open_ & go, mid + 1, lo)
        hi = np.where(open_ & ~go, mid, hi)
    return lo


class TestSuffixes:
    """The test items' words, numbered from 1, and their suffixes that hold a passage."""

    __test__ = False

    def __init__(self, items: list[tuple[int, str]], least: int):
        self.least = least
        self.number: dict[str, int] = {}
        codes, owner, at = [], [], []
        for item, text in items:
            words = WORD.findall(text.lower())
            at.extend(range(len(codes), len(codes) + len(words) - least + 1))
            codes.extend(self.number.setdefault(w, len(self.number) + 1) for w in words)
            owner.extend([item] * len(words))
            codes.append(0)
            owner.append(item)
        self.bits = max(1, len(self.number).bit_length())
        self.codes, self.owner, self.at = np.array(codes, np.uint64), np.array(owner, np.int64), np.array(at, np.int64)
        self.probe = _packed(self.codes, self.at, least, self.bits)

    def matches(self, texts: list[str | None]) -> tuple[np.ndarray, ...]:
        """(text, item, words, place in text, place among all test words) of the longest verbatim matches per diagonal."""
        codes, owner, first = [], [], []
        get = self.number.get
        for i, t in enumerate(texts):
            words = WORD.findall(t.lower()) if t else []
            first.append(len(codes))
            codes.extend([get(w, 0) for w in words])
            codes.append(0)
            owner.append(len(words) + 1)
        seq, doc = np.array(codes, np.uint64), np.repeat(np.arange(len(texts)), owner)
        # a passage holds test words only: places with fewer than least of them ahead need no place in the array
        gap = np.flatnonzero(seq == 0)
        ahead = gap[np.searchsorted(gap, np.arange(len(seq)))] - np.arange(len(seq)) if len(seq) else gap
        at = np.flatnonzero(ahead >= self.least)
        none = np.zeros(0, np.int64)
        if not len(at) or not len(self.at):
            return none, none, none, none, none
        cols = _packed(seq, at, self.least, self.bits)
        order = np.lexsort(cols[::-1])
        sa, cols = at[order], [c[order] for c in cols]
        lo, hi = _search(cols, self.probe, False), _search(cols, self.probe, True)
        n = hi - lo
        test = np.repeat(self.at, n)
        place = sa[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        diagonal = np.lexsort((test, place - test))
        test, place = test[diagonal], place[diagonal]
        start = np.ones(len(test), bool)
        start[1:] = (np.diff(test) != 1) | (np.diff(place) != 1)
        s = np.flatnonzero(start)
        length = np.diff(np.r_[s, len(test)]) + self.least - 1
        d = doc[place[s]]
        return d, self.owner[test[s]], length, place[s] - np.array(first)[d], test[s]


def leaked_passages(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", least: int = 12) -> DataFrame:
    """(doc_id, item_id, words, doc_word): the longest verbatim match of each document and item that share a passage.

    A passage is least or more consecutive words (runs of letters and digits, lower case). words is the match's length,
    doc_word the number of the document's word where it begins (from 0; the first of several as long). Whole texts are
    searched. NULL and short texts, and NULL ids, give no rows; a document under two ids counts twice, an item's copies
    too. The test set is broadcast; one of more than MAX_TEST_CHARS characters in parts, with a pass over the documents for
    each.
    """
    test = items.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    size = test.agg(F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("n")).first()["n"]
    parts = -(-size // MAX_TEST_CHARS)
    if parts > 1:
        part = lambda k: items.where(F.pmod(F.xxhash64(item_id), F.lit(parts)) == k)
        return reduce(DataFrame.union, (_passages(documents, part(k), doc_id, item_id, text, least) for k in range(parts)))
    return _passages(documents, items, doc_id, item_id, text, least)


def _passages(documents: DataFrame, items: DataFrame, doc_id: str, item_id: str, text: str, least: int) -> DataFrame:
    """leaked_passages of a test set that every task holds as a whole."""
    test = items.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    held = documents.sparkSession.sparkContext.broadcast([(r["i"], r["t"]) for r in test.collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suffixes = TestSuffixes(held.value, least)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            d, item, words, place, _ = suffixes.matches(batch.column(1).to_pylist())
            best = np.lexsort((place, -words, item, d))
            d, item, words, place = d[best], item[best], words[best], place[best]
            keep = np.ones(len(d), bool)
            keep[1:] = (np.diff(d) != 0) | (np.diff(item) != 0)
            yield pa.record_batch([pa.array(ids[d[keep]], pa.int64()), pa.array(item[keep], pa.int64()), pa.array(words[keep], pa.int64()), pa.array(place[keep], pa.int64())], names=["doc_id", "item_id", "words", "doc_word"])

    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    return docs.mapInArrow(run, "doc_id long, item_id long, words long, doc_word long")


def without_leaks(documents: DataFrame, passages: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The documents that hold no passage, with all their columns."""
    return documents.join(passages.select(F.col("doc_id").alias("_leaked")).distinct(), F.col(doc_id) == F.col("_leaked"), "left_anti")


def leaked_items(passages: DataFrame) -> DataFrame:
    """(item_id, documents, longest): how often and how long each leaked test item occurs."""
    return passages.groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.max("words").alias("longest"))
