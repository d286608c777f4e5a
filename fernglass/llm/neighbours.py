"""The most similar vectors of every vector, by an inverted file of randomly rotated one-bit codes.

Unit vectors are put into the lists of their nearest centroids. Within a list a vector is kept as the signs of its rotated
residual, packed, with the scalars that correct an inner product with them. A query's inner products with all of a list
are estimated from the packed bits, and the estimates' error bounds tell which vectors can be among its k most similar;
only these are compared exactly. Equal vectors are one class all the way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fernglass.session import materialize

#: Sampled vectors per centroid, for fitting; with MAX_LISTS this bounds the sample of a group (98,304 vectors).
SAMPLE_PER_LIST = 24
MAX_LISTS = 4096
#: Vectors of a list that are scanned as one block; longer lists are split.
BLOCK = 4096
#: Kinds of vectors (provider, model, length) whose models are held at once: as many as have so many bytes of centroids and
#: rotations. Others follow in further passes.
MODEL_BYTES = 256 << 20
#: Standard deviations of an estimate that its bound allows for.
BOUND = 2.2


def usable(vec: bytes | None, dim: int | None) -> np.ndarray | None:
    """The unit vector of little-endian float32 values, if there are dim finite ones that are not all zero."""
    if vec is None or dim is None or dim <= 0 or len(vec) != 4 * dim:
        return None
    v = np.frombuffer(vec, "<f4").astype(np.float64)
    if not np.isfinite(v).all() or not v.any():
        return None
    v /= np.abs(v).max()
    return v / np.linalg.norm(v)


def rotation(d: int, seed: int = 5) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def centroids(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids by spherical k-means."""
    c = sample[:: max(1, len(sample) // lists)][:lists].copy()
    for _ in range(rounds):
        a = np.concatenate([(sample[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(sample), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, a, sample)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 1e-6, total / np.maximum(norm, 1e-6), c).astype(np.float32)
    return c


def _words(bits: np.ndarray) -> np.ndarray:
    packed = np.packbits(bits, axis=1, bitorder="little")
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


class Codes:
    """One-bit codes of the vectors of a block, relative to the list's centroid."""

    def __init__(self, x: np.ndarray, centre: np.ndarray, turn: np.ndarray):
        self.x, self.centre, self.turn = x, centre, turn
        r = x - centre
        self.norm = np.linalg.norm(r, axis=1)
        o = (r @ turn) / np.maximum(self.norm, 1e-9)[:, None]
        self.bits = _words(o > 0)
        self.ones = np.bitwise_count(self.bits).sum(1).astype(np.float32)
        d = x.shape[1]
        self.fit = np.maximum(np.abs(o).sum(1) / math.sqrt(d), 1e-6)  # inner product of the vector and its code
        self.scale = (self.norm / (math.sqrt(d) * self.fit)).astype(np.float32)
        self.error = (BOUND * self.norm * np.sqrt(np.maximum(1 - self.fit**2, 0)) / self.fit / math.sqrt(max(1, d - 1))).astype(np.float32)
        self.base = (r @ centre + centre @ centre).astype(np.float32)

    def estimate(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(estimated inner products of queries and vectors, bounds of their errors); queries are taken to 4 bits a value."""
        r = q - self.centre
        t = r @ self.turn
        low = t.min(1, keepdims=True)
        step = np.maximum((t.max(1, keepdims=True) - low) / 15, 1e-9)
        u = np.rint((t - low) / step).astype(np.uint8)
        part = np.zeros((len(q), len(self.x)), np.float32)
        for j in range(4):
            plane = _words((u >> j) & 1 == 1)
            count = np.zeros(part.shape, np.uint16)
            for w in range(plane.shape[1]):
                count += np.bitwise_count(plane[:, w][:, None] & self.bits[:, w][None, :])
            part += np.float32(1 << j) * count
        signed = 2 * (low * self.ones[None, :] + step * part) - t.sum(1, keepdims=True)
        norm = np.linalg.norm(r, axis=1)[:, None]
        slack = norm * self.error[None, :] + step * 0.5 * self.scale[None, :] * math.sqrt(q.shape[1])
        return self.base[None, :] + (r @ self.centre)[:, None] + self.scale[None, :] * signed, slack


def nearest_in_block(codes: Codes, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, cosine): each query's k most similar of the block, itself excepted, if at least as similar as least."""
    est, slack = codes.estimate(q)
    own = q_ids[:, None] == ids[None, :]
    low = np.where(own, -np.inf, est - slack)
    need = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(q), -np.inf)
    i, j = np.nonzero((est + slack >= np.maximum(need, least)[:, None]) & ~own)
    cos = np.concatenate([np.einsum("ij,ij->i", q[i[s : s + 65536]], codes.x[j[s : s + 65536]], dtype=np.float64) for s in range(0, len(i), 65536)]) if len(i) else np.zeros(0)
    good = cos >= least
    i, j, cos = i[good], j[good], cos[good]
    order = np.lexsort((ids[j], -cos, i))
    i, j, cos = i[order], j[order], cos[order]
    start = np.flatnonzero(np.r_[True, np.diff(i) != 0]) if len(i) else np.zeros(0, np.int64)
    rank = np.arange(len(i)) - np.repeat(start, np.diff(np.r_[start, len(i)]))
    top = rank < k
    return q_ids[i[top]], ids[j[top]], cos[top]


def most_similar(vectors: DataFrame, k: int = 10, least: float = -1.0, probes: int = 12, vec_id: str = "vec_id", provider: str = "provider", model: str = "model", dim: str = "dim", vec: str = "vec") -> DataFrame:
    """(a, b, cosine, rank): the k most similar vectors b of each vector a among those of its provider and model.

    Vectors of a byte length other than 4 dim, with a value that is not finite, or all zero take no part, nor do those with
    a NULL among id, provider, model and dim; vectors of different lengths are not similar. Equal similarities are ranked
    by the smaller id. Pairs below least are left out. Every vector is indexed and queried; only the centroids are fitted on
    a bounded sample. What is lost is pairs of which neither searches the other's list; probes lists are searched.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, g, v) for i, g, n, b in zip(*(c.to_pylist() for c in batch.columns)) if (v := usable(b, n)) is not None]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2].astype("<f4").tobytes() for r in rows], pa.binary())], names=["id", "g", "v"])

    spark = vectors.sparkSession
    kind = F.to_json(F.struct(F.col(provider).alias("p"), F.col(model).alias("m"), F.col(dim).alias("d")))
    source = vectors.where(F.col(vec_id).isNotNull() & F.col(provider).isNotNull() & F.col(model).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), kind.alias("g"), F.col(dim).cast("int"), F.col(vec))
    flat = materialize(source.mapInArrow(decode, "id long, g string, v binary").withColumn("f", F.xxhash64("g", "v")), "vectors")
    classes = materialize(flat.groupBy("g", "f").agg(F.min("id").alias("id"), F.min_by("v", "id").alias("v")).select("id", "g", "f", "v"), "classes")
    kinds = classes.groupBy("g").agg(F.count("*").alias("n"), F.first(F.octet_length("v")).alias("bytes")).orderBy("g").collect()  # a row per kind
    lists = {r["g"]: max(1, min(MAX_LISTS, round(math.sqrt(r["n"])))) if r["n"] > 2 * k * SAMPLE_PER_LIST else 1 for r in kinds}
    passes, held_bytes = [[]], 0
    for r in kinds:
        need = r["bytes"] * (lists[r["g"]] + r["bytes"] // 4)
        if passes[-1] and held_bytes + need > MODEL_BYTES:
            passes.append([])
            held_bytes = 0
        passes[-1].append(r["g"])
        held_bytes += need
    found = [_near_of(classes if len(passes) == 1 else classes.where(F.col("g").isin(gs)), {g: lists[g] for g in gs}, k, least, probes) for gs in passes if gs]
    near = reduce(DataFrame.union, found) if found else spark.createDataFrame([], "a long, b long, cosine double, rank int")
    # from classes to vectors: of a class, only its k + 1 smallest ids can be among anyone's k nearest
    member = flat.join(classes.select("f", "g", F.col("id").alias("c")), ["g", "f"]).select("id", "c")
    first = Window.partitionBy("c").orderBy("id")
    heads = member.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1).select(F.col("c").alias("b"), F.col("id").alias("other"))
    plural = heads.groupBy("b").agg(F.count("*").alias("n")).where("n > 1").select(F.col("b").alias("a"), "b", F.lit(1.0).alias("cosine"))
    wide = near.select("a", "b", "cosine").union(plural).join(heads, "b").select("a", "other", "cosine")
    pairs = member.select(F.col("c").alias("a"), "id").join(wide, "a").where("id <> other").select(F.col("id").alias("a"), F.col("other").alias("b"), "cosine")
    return _ranked(pairs, k)


def _near_of(classes: DataFrame, lists: dict[str, int], k: int, least: float, probes: int) -> DataFrame:
    """most_similar of classes (id, g, f, v) of kinds whose models are held together."""
    spark = classes.sparkSession
    model_of = {}
    for g, n in lists.items():  # a bounded sample of each kind
        sample = classes.where(F.col("g") == g).orderBy(F.xxhash64("id"), "id").limit(n * SAMPLE_PER_LIST).select("v").collect()
        s = np.frombuffer(b"".join(r["v"] for r in sample), "<f4").reshape(len(sample), -1)
        model_of[g] = (centroids(s, n), rotation(s.shape[1]))
    number = {g: i for i, g in enumerate(sorted(model_of))}
    held = spark.sparkContext.broadcast((model_of, number))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, numbers = held.value
        for batch in batches:
            gs = np.array(batch.column(1).to_pylist(), object)
            vs = batch.column(2).to_pylist()
            found: list[list[int] | None] = [None] * len(vs)
            for g in set(gs.tolist()):
                at = np.flatnonzero(gs == g)
                c = models[g][0]
                x = np.frombuffer(b"".join(vs[i] for i in at), "<f4").reshape(len(at), -1)
                for s in range(0, len(at), 2048):
                    near = np.argsort(-(x[s : s + 2048] @ c.T), axis=1, kind="stable")[:, :probes]
                    for i, row in zip(at[s : s + 2048], near.tolist()):
                        found[i] = [numbers[g] * MAX_LISTS + z for z in row]
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.int64()))], names=["id", "v", "near"])

    put = materialize(classes.select("id", "g", "v").mapInArrow(assign, "id long, v binary, near array<long>"), "lists")
    length = put.groupBy(F.col("near")[0].alias("list")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))  # a row per list
    index = put.select(F.col("near")[0].alias("list"), "id", "v").join(F.broadcast(length), "list").select("list", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), F.lit(0).alias("role"), "id", "v")
    asked = put.select(F.explode("near").alias("list"), "id", "v").join(F.broadcast(length), "list").select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("role"), "id", "v")
    rows = index.union(asked).repartition("list", "block").sortWithinPartitions("list", "block", "role", "id")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, numbers = held.value
        names = {i: g for g, i in numbers.items()}
        cell, codes, ids, vs = None, None, [], []
        for batch in batches:
            spot, block, role = (batch.column(i).to_numpy() for i in range(3))
            one, blobs = batch.column(3).to_numpy(), batch.column(4).to_pylist()
            cut = np.flatnonzero(np.r_[True, (np.diff(spot) != 0) | (np.diff(block) != 0) | (np.diff(role) != 0)]) if len(spot) else np.zeros(0, np.int64)
            for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(spot)]):
                if cell != (spot[s], block[s]):
                    cell, codes, ids, vs = (spot[s], block[s]), None, [], []
                if role[s] == 0:
                    ids.append(one[s:e])
                    vs.extend(blobs[s:e])
                    continue
                if not vs:
                    continue
                if codes is None:
                    c, turn = models[names[cell[0] // MAX_LISTS]]
                    codes = Codes(np.frombuffer(b"".join(vs), "<f4").reshape(len(vs), -1), c[cell[0] % MAX_LISTS], turn)
                    own = np.concatenate(ids)
                for at in range(s, e, 256):
                    q = np.frombuffer(b"".join(blobs[at : min(e, at + 256)]), "<f4").reshape(min(e, at + 256) - at, -1)
                    a, b, cos = nearest_in_block(codes, own, q, one[at : min(e, at + 256)], k, least)
                    yield pa.record_batch([pa.array(a), pa.array(b), pa.array(cos)], names=["a", "b", "cosine"])

    found = rows.mapInArrow(scan, "a long, b long, cosine double")
    both = materialize(found, "near")
    both = both.union(both.select("b", "a", "cosine")).groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
    return _ranked(both, k)


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("a").orderBy(F.desc("cosine"), "b")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def with_chunks(pairs: DataFrame, vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """pairs (vec_a, vec_b) with the file, lines, symbol and text of the code of either vector, NULL where it is missing.

    vectors has (vec_id, chunk_key), chunks (chunk_key, payload): UTF-8 JSON, of which what is cut off or missing is NULL. Of a
    chunk that is there more than once the first in order of its payload counts.
    """
    text = F.decode("payload", "UTF-8")
    whole = chunks.where("chunk_key IS NOT NULL AND payload IS NOT NULL").groupBy("chunk_key").agg(F.min(text).alias("t"))
    code = F.from_json("t", "file string, start_line int, end_line int, symbol string, text string")
    shown = vectors.join(whole, "chunk_key").select("vec_id", code.alias("code"))
    a, b = shown.select(F.col("vec_id").alias("vec_a"), F.col("code").alias("code_a")), shown.select(F.col("vec_id").alias("vec_b"), F.col("code").alias("code_b"))
    return pairs.join(a, "vec_a", "left").join(b, "vec_b", "left").select("vec_a", "vec_b", "code_a", "code_b")
