"""Word sets, SuperMinHash signatures and prefix keys, vectorised over batches of documents."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash

WORD = re.compile(r"[a-z0-9_]+")
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalising step of splitmix64, on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_sets(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document index, word code, hash of each code) of the distinct words of each text; NULL has none."""
    docs, words = [], []
    for i, t in enumerate(texts):
        s = set(WORD.findall(t.lower())) if t else ()
        docs.append(len(s))
        words.extend(s)
    doc = np.repeat(np.arange(len(docs), dtype=np.int64), docs)
    if not words:
        return doc, np.zeros(0, np.int64), np.zeros(0, np.uint64)
    code, uniq = pd.factorize(np.array(words, dtype=object))
    h = xxhash.xxh64_intdigest
    return doc, code, np.fromiter((h(w) for w in uniq), np.uint64, len(uniq))


def fingerprints(n_docs: int, doc: np.ndarray, code: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A 63-bit hash of each document's word set, the same for equal sets; -1 for an empty set."""
    parts = mix(hashes)[code] if len(code) else np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(n_docs, np.uint64)
        np.add.at(total, doc, parts)
        size = np.bincount(doc, minlength=n_docs).astype(np.uint64)
        f = (mix(total + size * _GOLDEN) >> np.uint64(1)).astype(np.int64)
    f[size == 0] = -1
    return f


def superminhash(n_docs: int, doc: np.ndarray, code: np.ndarray, hashes: np.ndarray, m: int = 128) -> np.ndarray:
    """SuperMinHash signatures, n_docs x m of uint32.

    Each word draws, rank by rank, the next place of its own random permutation of the m places and leaves there the
    value rank + random fraction (8 and 24 bits). A place keeps its least value. Values of one word are spread over
    different places, which lowers the variance against independent hashes; a document is done, and takes part no
    longer, at the rank at which all its places are filled, since later ranks only bring larger values.
    """
    sig = np.full(n_docs * m, 0xFFFFFFFF, np.uint32)
    if not len(code):
        return sig.reshape(n_docs, m)
    perm = np.tile(np.arange(m, dtype=np.uint8), (len(hashes), 1))
    rows = np.arange(len(hashes))
    base = doc * m
    with np.errstate(over="ignore"):
        for rank in range(m):
            r = mix(hashes + np.uint64(rank + 1) * _GOLDEN)
            pick = rank + ((r >> np.uint64(32)) % np.uint64(m - rank)).astype(np.int64)
            place = perm[rows, pick]
            perm[rows, pick] = perm[:, rank]
            value = (np.uint32(rank) << np.uint32(24)) | (r & np.uint64(0xFFFFFF)).astype(np.uint32)
            np.minimum.at(sig, base + place[code], value[code])
            if rank % 2:
                open_docs = (sig.reshape(n_docs, m) == 0xFFFFFFFF).any(axis=1)
                live = open_docs[doc]
                if not live.any():
                    break
                if live.mean() < 0.7:
                    doc, code, base = doc[live], code[live], base[live]
    return sig.reshape(n_docs, m)


def tree_places(trees: int, depth: int, m: int, seed: int = 7) -> np.ndarray:
    """For each tree (or band) the signature places that make up its key, drawn without replacement within a tree."""
    rng = np.random.default_rng(seed)
    return np.stack([rng.permutation(m)[:depth] for _ in range(trees)])


def prefix_keys(sig: np.ndarray, places: np.ndarray) -> np.ndarray:
    """n x trees of int64: one byte of each of up to 8 places, first place highest, so that equal prefixes are ranges."""
    b = (mix(sig.astype(np.uint64) + _GOLDEN) & np.uint64(0xFF)).astype(np.uint64)
    out = np.zeros((len(sig), len(places)), np.uint64)
    for d in range(places.shape[1]):
        out = (out << np.uint64(8)) | b[:, places[:, d]]
    return out.view(np.int64)


def sketch64(sig: np.ndarray) -> np.ndarray:
    """64 one-bit values of each signature: two sets of similarity J agree in (1 + J) / 2 of them on average."""
    bits = (mix(sig[:, :64].astype(np.uint64) * _GOLDEN) >> np.uint64(17)) & np.uint64(1)
    return (bits << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64)


def bucket_pairs(batches: Iterator[pa.RecordBatch], chunk: int, done: int = 0) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of rows (key, node) that come sorted by both, a partition holding whole keys.

    Within a run of equal keys, distinct nodes are ranked by their order; each node b is paired with the nodes a of rank
    done to done + chunk - 1 before it. A third column, if there is one, tells which nodes are wanted as b. upto is the last such a where b has further ones behind it, else NULL. At most
    chunk nodes of a run are held, however long it is.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("upto", pa.int64())])
    key = last = None
    head: list[int] = []
    rank = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        k, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        wanted = batch.column(2).to_numpy(zero_copy_only=False) if batch.num_columns > 2 else np.ones(len(k), bool)
        starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        ends = np.r_[starts[1:], len(k)]
        # runs of one row can't pair, but the first may go on and the last may
        keep = np.flatnonzero((ends - starts > 1) | (starts == 0) | (ends == len(k)))
        left, right, upto = [], [], []
        for s, e in zip(starts[keep].tolist(), ends[keep].tolist()):
            if s or key != k[0]:
                head, rank, last = [], 0, None
            for x, want in zip(n[s:e].tolist(), wanted[s:e].tolist()):
                if x == last:
                    continue
                last = x
                if head and want:
                    left.extend(head)
                    right.extend([x] * len(head))
                    upto.extend([head[-1] if rank > done + chunk else None] * len(head))
                if done <= rank < done + chunk:
                    head.append(x)
                rank += 1
            if len(left) > 200_000:
                yield pa.record_batch([pa.array(left, pa.int64()), pa.array(right, pa.int64()), pa.array(upto, pa.int64())], schema=schema)
                left, right, upto = [], [], []
        key = k[-1]
        if left:
            yield pa.record_batch([pa.array(left, pa.int64()), pa.array(right, pa.int64()), pa.array(upto, pa.int64())], schema=schema)
