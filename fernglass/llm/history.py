"""Duplicates of new batches against all history: a prefix forest on disk that is searched, grown and merged, never rebuilt.

Each tree orders the classes of equal word sets by one permutation of their signature: seven bytes of it, behind the tree's
number, are a long, so that entries with a common prefix are a range of a sorted run. A batch's keys become a run of their
own; then the ranges of its keys are looked up in all runs by binary search, in the pages that hold them only. Prefixes are
widened (shortened) until the wanted share of pairs at the threshold has a common one in some tree. Candidates are verified
on exact word sets, which are looked up by id in the same way; fingerprints are a third sorted table. Runs are merged when
there are many, the smaller ones first. A forest is a folder: another session opens it and goes on.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fernglass.llm import sketch
from fernglass.llm.neardup import SLICE, as_similar, least_common_bits, signature_table
from fernglass.llm.pages import read_ranges, read_rows, starts_and_ends, write_pages
from fernglass.session import materialize, scratch_path

#: Bytes of a prefix; with the tree's number before them they fill a long.
DEEPEST = 7
#: Candidates that are compared at once in a task.
PAIRS = 2_000_000


def widened_depth(threshold: float, recall: float, trees: int, deepest: int = DEEPEST) -> int:
    """The longest prefix that pairs at the threshold share in at least one tree with probability recall.

    Prefixes are widened byte by byte from the deepest on until the expected recall is reached.
    """
    depth = deepest
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def _print(fp: Column) -> Column:
    """The key of a fingerprint, which is compared itself too."""
    return F.shiftrightunsigned(F.xxhash64(fp), 1)


def _folder(spark: SparkSession, path: str):
    """(file system, path) of a folder."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def _keys(classes: DataFrame, trees: int, m: int) -> DataFrame:
    """(key, node, sk) of each class in each tree: the tree's number, then DEEPEST bytes of its order of places."""
    places = sketch.tree_places(trees, DEEPEST, m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                sig = np.frombuffer(b"".join(part.column(2).to_pylist()), "<u2").reshape(-1, m)
                keys = sketch.prefix_keys(sig, places) | (np.arange(trees, dtype=np.int64) << (8 * DEEPEST))
                yield pa.record_batch([pa.array(keys.ravel()), pa.array(np.repeat(part.column(0).to_numpy(), trees)), pa.array(np.repeat(part.column(1).to_numpy(), trees))], names=["key", "node", "sk"])

    return classes.select("node", "sk", "sig").mapInArrow(run, "key long, node long, sk long")


def _candidates(least: int, chunk: int, done: int):
    """Work on a page of keys: (a, b, upto), for each asked class b the classes a before it whose sketches are close.

    Of a range's candidates in the order of a those of rank done to done + chunk - 1 come out; upto is the last of them where
    there are more, else NULL.
    """

    def work(ranges: dict[str, pa.Array], page: pa.Table) -> pa.RecordBatch | None:
        keys, node, sk = (page.column(c).to_numpy() for c in ("key", "node", "sk"))
        b, sb = ranges["node"].to_numpy(), ranges["sk"].to_numpy()
        start, end = starts_and_ends(keys, ranges)
        n = end - start
        out = []
        at = 0
        while at < len(b):
            upto = max(at + 1, int(np.searchsorted(np.cumsum(n[at:]), PAIRS, "right")) + at)
            k = n[at:upto]
            q = np.repeat(np.arange(at, upto), k)
            i = start[q] + np.arange(len(q)) - np.repeat(np.cumsum(k) - k, k)
            near = (node[i] < b[q]) & (64 - np.bitwise_count(sk[i].view(np.uint64) ^ sb[q].view(np.uint64)) >= least)
            q, a = q[near], node[i[near]]
            order = np.lexsort((a, q))
            q, a = q[order], a[order]
            first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
            size = np.diff(np.r_[first, len(q)])
            rank = np.arange(len(q)) - np.repeat(first, size)
            take = (rank >= done) & (rank < done + chunk)
            more = np.repeat(size > done + chunk, size)
            last = np.repeat(a[np.minimum(first + done + chunk, first + size) - 1], size) if len(q) else a
            out.append((a[take], b[q[take]], np.where(more, last, -1)[take], more[take]))
            at = upto
        a, b, last, more = (np.concatenate(x) for x in zip(*out)) if out else [np.zeros(0, np.int64)] * 4
        if not len(a):
            return None
        return pa.record_batch([pa.array(a), pa.array(b), pa.array(last, mask=~more.astype(bool))], names=["a", "b", "upto"])

    return work


def _sets(ranges: dict[str, pa.Array], page: pa.Table) -> pa.RecordBatch | None:
    """Work on a page of word sets: (node, w) of the asked nodes."""
    start, end = starts_and_ends(page.column("node").to_numpy(), ranges)
    rows = page.select(["node", "w"]).take(pa.array(start[start < end])).combine_chunks()
    return rows.to_batches()[0] if rows.num_rows else None


def _marks(ranges: dict[str, pa.Array], page: pa.Table) -> pa.RecordBatch | None:
    """Work on a page of fingerprints: (id, mark), the least id before each asked one that has its fingerprint."""
    start, end = starts_and_ends(page.column("h").to_numpy(), ranges)
    prints, marks = page.column("fp").to_pylist(), page.column("mark").to_pylist()
    out = []
    for i, fp, s, e in zip(ranges["id"].to_pylist(), ranges["fp"].to_pylist(), start.tolist(), end.tolist()):
        least = min((marks[k] for k in range(s, e) if prints[k] == fp and marks[k] < i), default=None)
        if least is not None:
            out.append((i, least))
    return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], names=["id", "mark"]) if out else None


@dataclass(frozen=True)
class PrefixForest:
    """Accepted entries in a folder: sorted runs of keys, of word sets by id, and of fingerprints."""

    path: str
    id_col: str
    text_cols: tuple[str, ...]
    fingerprint: str | None
    threshold: float = 0.8
    recall: float = 0.995
    trees: int = 64
    m: int = 128
    max_runs: int = 12
    #: (name, classes) of each run, the folders below path.
    runs: tuple[tuple[str, int], ...] = ()
    version: int = 0

    @classmethod
    def create(cls, spark: SparkSession, id_col: str, text_cols: Sequence[str], fingerprint: str | None = None, path: str | None = None, **parameters) -> PrefixForest:
        """An empty forest in a folder that all executors share, by default a new one in the scratch folder that goes with the session."""
        path = path or scratch_path(spark, "forest")
        return cls(path, id_col, tuple(text_cols), fingerprint, **parameters)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> PrefixForest:
        """The forest that was last saved in the folder."""
        system, folder = _folder(spark, f"{path}/versions")
        latest = max(int(f.getPath().getName()) for f in system.listStatus(folder) if f.getPath().getName().isdigit())
        kept = json.loads(spark.read.text(f"{path}/versions/{latest}", wholetext=True).first()[0])
        return cls(**{**kept, "path": path, "text_cols": tuple(kept["text_cols"]), "runs": tuple((n, c) for n, c in kept["runs"])})

    def _saved(self, spark: SparkSession, runs: tuple[tuple[str, int], ...]) -> PrefixForest:
        """The forest with these runs, noted in the folder as its next version: written aside, then renamed."""
        new = replace(self, runs=runs, version=self.version + 1)
        system, folder = _folder(spark, f"{self.path}/versions")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        out = system.create(path(folder, f"_{new.version}"), True)
        out.write(bytearray(json.dumps(asdict(new)).encode()))
        out.close()
        if system.exists(path(folder, str(new.version))) or not system.rename(path(folder, f"_{new.version}"), path(folder, str(new.version))):
            raise FileExistsError(f"another writer has saved version {new.version} of {self.path}")
        return new

    def _folders(self, what: str) -> list[str]:
        return [f"{self.path}/{name}/{what}" for name, _ in self.runs]

    def _grown(self, df: DataFrame, classes: DataFrame) -> PrefixForest:
        """The forest with one more run: df's keys, word sets and fingerprints."""
        name = f"run-{uuid.uuid4().hex}"
        tables = [(_keys(classes, self.trees, self.m), "keys", F.shiftright("key", 8 * DEEPEST)), (classes.select("node", "f", "w"), "sets", None)]
        if self.fingerprint is not None:
            fp = F.col(self.fingerprint).cast("string")
            marks = df.where(fp.isNotNull()).groupBy(fp.alias("fp")).agg(F.min(F.col(self.id_col).cast("long")).alias("mark")).where("mark IS NOT NULL")
            tables.append((marks.select(_print(F.col("fp")).alias("h"), "mark", "fp"), "marks", F.shiftright(_print(F.col("fp")), 55)))
        with ThreadPoolExecutor(len(tables)) as pool:  # jobs of their own, side by side
            list(pool.map(lambda t: write_pages(t[0], f"{self.path}/{name}/{t[1]}", t[2]), tables))
        return self._saved(df.sparkSession, (*self.runs, (name, classes.count())))

    def _merged(self, spark: SparkSession) -> PrefixForest:
        """The forest with its smaller runs made one, if there are more than max_runs; of equal word sets the least id stays."""
        if len(self.runs) <= self.max_runs:
            return self
        small = sorted(self.runs, key=lambda r: r[1])
        take = next((k for k in range(2, len(small)) if sum(n for _, n in small[:k]) < small[k][1] / 2 and len(small) - k < self.max_runs), len(small))
        part = replace(self, runs=tuple(small[:take]))
        name = f"run-{uuid.uuid4().hex}"
        together = lambda what: reduce(DataFrame.union, (read_rows(spark, p) for p in part._folders(what)))
        stay = materialize(together("sets").groupBy("f").agg(F.min_by(F.struct("node", "w"), "node").alias("s")).select("s.node", "f", "s.w"), "stay")
        write_pages(stay, f"{self.path}/{name}/sets")
        write_pages(together("keys").join(stay.select("node"), "node", "left_semi").select("key", "node", "sk"), f"{self.path}/{name}/keys", F.shiftright("key", 8 * DEEPEST))
        if self.fingerprint is not None:
            marks = together("marks").groupBy("fp").agg(F.min("mark").alias("mark"))
            write_pages(marks.select(_print(F.col("fp")).alias("h"), "mark", "fp"), f"{self.path}/{name}/marks", F.shiftright(_print(F.col("fp")), 55))
        return self._saved(spark, (*(r for r in self.runs if r not in small[:take]), (name, stay.count())))

    def _classes(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(id, f) of each row, and (f, node, sk, sig, w) of each distinct word set; node is its least id."""
        signed = signature_table(df, self.id_col, self.text_cols, self.m, words=True)
        owners = signed.where("f <> -1").groupBy("f").agg(F.min("id").alias("node"), F.min(F.when(F.col("sig").isNotNull(), F.col("id"))).alias("carrier"))
        carried = signed.where("sig IS NOT NULL").select(F.col("id").alias("carrier"), "sk", "sig", "w").dropDuplicates(["carrier"])
        return signed.select("id", "f"), materialize(owners.join(carried, "carrier").select("f", "node", "sk", "sig", "w"), "cls")

    def add(self, df: DataFrame) -> PrefixForest:
        """The forest with df's entries accepted, whatever they repeat."""
        _, classes = self._classes(df)
        return self._grown(df, classes)._merged(df.sparkSession)

    def match(self, df: DataFrame, chunk: int = 64) -> tuple[DataFrame, PrefixForest]:
        """(entry_id, first_id) of df's entries that repeat one of a smaller id, in the forest or in df; the grown forest.

        first_id is the smallest such id. An entry repeats another of equal non-NULL fingerprint, or whose word set is as
        similar as the threshold; an entry without words repeats none by its text. Of a range's classes those of close
        sketches are compared, the first chunk of them first; classes that found none before the chunk's end go on with the
        next, so a range may be of any size. What is read are the pages of df's own ranges and candidates. An empty df gives
        no rows; rows with a NULL id give none.
        """
        spark = df.sparkSession
        ids, classes = self._classes(df)
        grown = self._grown(df, classes)
        depth = widened_depth(self.threshold, self.recall, self.trees)
        rest = (1 << 8 * (DEEPEST - depth)) - 1
        mine = _keys(classes, self.trees, self.m).select((F.col("key") - F.col("key").bitwiseAND(rest)).alias("lo"), F.col("key").bitwiseOR(F.lit(rest)).alias("hi"), "node", "sk")
        mine = materialize(mine, "probe")
        own = classes.select(F.col("node").alias("b"), F.col("w").alias("wb"))
        best, done, live = None, 0, None
        while True:
            asked = mine if live is None else mine.join(live, mine["node"] == live["b"], "left_semi")
            pairs = read_ranges(spark, grown._folders("keys"), asked, _candidates(least_common_bits(self.threshold), chunk, done), "a long, b long, upto long")
            pairs = materialize(pairs.groupBy("a", "b").agg(F.min("upto").alias("upto")), "pairs")
            nodes = pairs.select(F.col("a").alias("lo"), F.col("a").alias("hi")).distinct()
            words = read_ranges(spark, grown._folders("sets"), nodes, _sets, "node long, w array<long>").dropDuplicates(["node"]).toDF("a", "wa")
            found = pairs.select("a", "b").join(words, "a").join(own, "b").where(as_similar(F.col("wa"), F.col("wb"), self.threshold)).select("b", "a")
            found = found if best is None else found.union(best)
            best = materialize(found.groupBy("b").agg(F.min("a").alias("a")), "best")
            # a class stays open while any of its ranges has classes left before the best match
            open_ = pairs.where("upto IS NOT NULL").groupBy("b").agg(F.min("upto").alias("upto")).join(best, "b", "left").where("a IS NULL OR a > upto")
            live = materialize(open_.select("b"), "live")
            if not live.limit(1).count():
                break
            done += chunk
        near = ids.join(classes.select("f", "node"), "f").join(best.toDF("node", "a"), "node", "left").select("id", F.least("node", "a").alias("first"))
        if self.fingerprint is not None:
            fp = F.col(self.fingerprint).cast("string")
            asked = df.where(fp.isNotNull() & F.col(self.id_col).isNotNull()).select(_print(fp).alias("lo"), _print(fp).alias("hi"), F.col(self.id_col).cast("long").alias("id"), fp.alias("fp"))
            near = near.union(read_ranges(spark, grown._folders("marks"), asked, _marks, "id long, first long"))
        out = near.where("first < id").groupBy("id").agg(F.min("first").alias("first")).select(F.col("id").alias("entry_id"), F.col("first").alias("first_id"))
        return materialize(out, "repeats"), grown._merged(spark)
