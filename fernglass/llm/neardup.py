"""Near-duplicate groups, and duplicates of new batches against all history.

Both sketch each row's set of words (maximal runs of a-z, 0-9 and _ of the lower-cased columns, joined by a blank; NULL
is empty) with SuperMinHash, find candidates by equal parts of the signature, and verify every candidate on the exact
word sets. Rows with equal word sets form one class and are sketched, searched and verified once. A row without any
word is similar to nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernglass.llm import sketch
from fernglass.operators.components import connected_components
from fernglass.session import materialize

#: A table of ids is broadcast up to this count of rows (8 bytes each), and joined by shuffle beyond.
BROADCAST_IDS = 1_000_000
#: Rows that are sketched at once in a Python worker.
SLICE = 4096
#: Classes of a bucket that are met as one block; larger buckets are split over as many tasks as they have blocks.
BUCKET = 4096
#: Word sets that a task remembers so as not to sketch copies again.
SEEN = 200_000


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            cols = [part.column(i).to_pylist() for i in range(1, part.num_columns)]
            yield part.column(0), [" ".join(x or "" for x in row) for row in zip(*cols)]


def _texts(df: DataFrame, id_col: str, text_cols: Sequence[str]) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), *(F.col(c).cast("string").alias(f"t{i}") for i, c in enumerate(text_cols))).where("id IS NOT NULL")


def signature_table(df: DataFrame, id_col: str, text_cols: Sequence[str], m: int = 128, words: bool = False) -> DataFrame:
    """(id, f, sk, sig): hash of the word set, 64-bit sketch, signature of 16-bit values; with words the words' hashes (w). Written once.

    sig, sk and w are NULL where the same task has brought them for an equal set, and where the set is empty (f = -1).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for ids, texts in _slices(batches):
            doc, code, hashes = sketch.word_sets(texts)
            f = sketch.fingerprints(len(texts), doc, code, hashes)
            first = np.zeros(len(f), bool)
            for i, x in enumerate(f.tolist()):
                if x != -1 and x not in seen:
                    first[i] = True
                    seen.add(x)
            if len(seen) > SEEN:
                seen.clear()
            at = np.cumsum(first) - 1
            pick = first[doc]
            sig = sketch.superminhash(int(first.sum()), at[doc[pick]], code[pick], hashes, m)
            short = (sketch.mix(sig.astype(np.uint64)) & np.uint64(0xFFFF)).astype("<u2")
            blob, sk = short.tobytes(), sketch.sketch64(sig)
            rows = [blob[a * 2 * m : (a + 1) * 2 * m] if x else None for a, x in zip(at.tolist(), first.tolist())]
            cols = {"id": ids, "f": pa.array(f, pa.int64()), "sk": pa.array([int(sk[a]) if x else None for a, x in zip(at.tolist(), first.tolist())], pa.int64()), "sig": pa.array(rows, pa.binary())}
            if words:
                size = np.bincount(doc[pick], minlength=len(f)) if len(doc) else np.zeros(len(f), np.int64)
                held = hashes[code[pick]].view(np.int64) if len(code) else np.zeros(0, np.int64)
                cols["w"] = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(held, pa.int64()), mask=pa.array(~first))
            yield pa.record_batch(list(cols.values()), names=list(cols))

    schema = "id long, f long, sk long, sig binary" + (", w array<long>" if words else "")
    return materialize(_texts(df, id_col, text_cols).mapInArrow(run, schema), "sig")


def tree_rows(signed: DataFrame, node: str, trees: int, depth: int, m: int = 128) -> DataFrame:
    """(key long, node long), one row per tree: the first depth values of the tree's order of places, with its number.

    Keys have 40 bits: what falls together by chance only is refused when verified.
    """
    places = sketch.tree_places(trees, depth, m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                sig = np.frombuffer(b"".join(part.column(1).to_pylist()), "<u2").reshape(-1, m)
                keys = sketch.prefix_keys(sig, places).view(np.uint64)
                with np.errstate(over="ignore"):
                    keys = sketch.mix(keys * np.uint64(trees + 1) + np.arange(1, trees + 1, dtype=np.uint64)) >> np.uint64(24)
                yield pa.record_batch([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(part.column(0).to_numpy(), trees))], names=["key", "node"])

    return signed.where("sig IS NOT NULL").select(F.col(node).alias("node"), "sig").mapInArrow(run, "key long, node long")


def candidates(rows: DataFrame, chunk: int, done: int = 0) -> DataFrame:
    """(a, b, upto) of nodes that share a key, see sketch.bucket_pairs; repeated pairs are merged."""
    ordered = rows.repartition("key").sortWithinPartitions("key", "node")
    pairs = ordered.mapInArrow(lambda it: sketch.bucket_pairs(it, chunk, done), "a long, b long, upto long")
    return pairs.groupBy("a", "b").agg(F.max("upto").alias("upto"))


def least_common_bits(threshold: float) -> int:
    """In how many of 64 places sketches of sets of this similarity agree at least, but for four standard deviations."""
    p = (1 + threshold) / 2
    return math.floor(64 * p - 4 * math.sqrt(64 * p * (1 - p)))


def close_sketches(pairs: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose 64-bit sketches agree as far as sets of this similarity do but for four standard deviations."""
    least = least_common_bits(threshold)
    a, b = sketches.select(F.col("node").alias("a"), F.col("sk").alias("sa")), sketches.select(F.col("node").alias("b"), F.col("sk").alias("sb"))
    return pairs.join(a, "a").join(b, "b").where(F.bit_count(F.col("sa").bitwiseXOR(F.col("sb"))) <= 64 - least)


def _word_hashes(df: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _slices(batches):
            doc, code, hashes = sketch.word_sets(texts)
            size = np.bincount(doc, minlength=len(texts))
            values = hashes[code].view(np.int64) if len(code) else np.zeros(0, np.int64)
            words = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(values, pa.int64()))
            yield pa.record_batch([ids, words], names=["id", "w"])

    return df.mapInArrow(run, "id long, w array<long>")


def as_similar(x: Column, y: Column, threshold: float) -> Column:
    """Whether the common part of two sets is at least threshold of all they hold; empty sets are similar to nothing."""
    common, n = F.size(F.array_intersect(x, y)), F.size(x) + F.size(y)
    return (n > 0) & (common >= F.lit(threshold) * (n - common) - 1e-9)


def verified(pairs: DataFrame, docs: DataFrame, id_col: str, text_cols: Sequence[str], reps: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of nodes whose exact word sets are as similar as threshold; reps has (node, id): whose text to take.

    Only the texts of rows in reps that occur in a pair are read into words: by a broadcast of their ids up to
    BROADCAST_IDS, by a shuffle join beyond.
    """
    need = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(reps, "node")
    need = materialize(need.select("node", "id"), "need")
    keys = need.select("id")
    if need.count() <= BROADCAST_IDS:
        keys = F.broadcast(keys)
    words = _word_hashes(_texts(docs, id_col, text_cols).join(keys, "id", "left_semi")).join(need, "id").select("node", "w")
    both = pairs.select("a", "b").join(words.toDF("a", "wa"), "a").join(words.toDF("b", "wb"), "b")
    return both.where(as_similar(F.col("wa"), F.col("wb"), threshold)).select("a", "b")


def near_duplicate_groups(df: DataFrame, id_col: str, text_cols: Sequence[str], threshold: float = 0.8, trees: int = 72, depth: int = 8, m: int = 128, chunk: int = 64) -> DataFrame:
    """(id, group_id, links): rows in a group of at least two, the group's number, and the row's links between unlike texts.

    Rows are linked if their word sets are as similar as threshold (Jaccard); groups are what links connect. SuperMinHash
    signatures, banding (trees bands of depth places), verification and union-find. Rows of one bucket are paired with
    its first chunk of classes; where a bucket has more, the classes that are not yet in the bucket's largest component
    are paired with all of it, block by block and by sketch first, so that no link between components is lost and no bucket is
    one task's. An empty table, NULL texts and NULL ids give
    no rows; repeated rows count by id. Columns other than those named play no part.
    """
    signed = signature_table(df, id_col, text_cols, m)
    classes = signed.where("f <> -1").groupBy(F.col("f").alias("node")).agg(F.min("id").alias("id"), F.max("sk").alias("sk"))
    rows = tree_rows(signed, "f", trees, depth, m)
    found = materialize(candidates(rows, chunk), "cand")
    links = materialize(verified(close_sketches(found, classes, threshold), df, id_col, text_cols, classes, threshold), "links")
    comp = connected_components(links)
    if found.where("upto IS NOT NULL").limit(1).count():
        big = rows.join(found.where("upto IS NOT NULL").select(F.col("b").alias("node")).distinct(), "node", "left_semi").select("key").distinct()
        rest = rows.join(big, "key", "left_semi").distinct().join(comp.toDF("node", "c"), "node", "left").withColumn("c", F.coalesce("c", "node"))
        rest = materialize(rest, "rest")
        top = rest.groupBy("key", "c").count().groupBy("key").agg(F.max_by("c", F.struct("count", "c")).alias("top"), F.ceil(F.sum("count") / BUCKET).cast("int").alias("blocks"))
        told = rest.join(classes.select("node", "sk"), "node").join(top, "key")
        odd = told.where("c <> top").select("key", F.col("node").alias("x"), F.col("c").alias("cx"), F.col("sk").alias("sx"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        all_ = told.select("key", "node", "c", "sk", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"))
        close = F.bit_count(F.col("sx").bitwiseXOR(F.col("sk"))) <= 64 - least_common_bits(threshold)
        more = odd.join(all_, ["key", "block"]).where((F.col("cx") != F.col("c")) & close).select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct()
        links = materialize(links.union(verified(close_sketches(more, classes, threshold), df, id_col, text_cols, classes, threshold)).distinct(), "links")
        comp = connected_components(links)
    degree = links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count("*").alias("links"))
    sizes = signed.where("f <> -1").select("id", F.col("f").alias("node"))
    lone = sizes.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node").join(comp, "node", "left_anti").select("node", F.col("node").alias("component"))
    label = comp.union(lone).join(degree, "node", "left").select("node", F.col("component").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
    return sizes.join(label, "node").select("id", "group_id", "links")


def group_pairs(groups: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of rows of a group."""
    a, b = groups.select("group_id", F.col("id").alias("a")), groups.select("group_id", F.col("id").alias("b"))
    return a.join(b, "group_id").where("a < b").select("a", "b")
