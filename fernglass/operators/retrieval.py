"""Exact retrieval of a stated query set against all rows: cosine, keyword and shingle scores, and line search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernglass.functions import text as T
from fernglass.operators.windows import lines

#: Query rows that are held by each task at once; more are taken in further rounds over the corpus.
BLOCK = 4096


def cosine_topk(corpus: DataFrame, queries: DataFrame, k: int = 8, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(query, id, score, rank): the k rows of the corpus of highest cosine for each query, the smaller id first among equals.

    Vectors of other lengths and zero vectors score 0, NULL ones take no part. Queries are held in blocks of at most BLOCK
    rows, against each of which a scan of the corpus keeps its own k best per task before anything is shuffled.
    """
    spark = corpus.sparkSession
    asked = queries.where(F.col(vec).isNotNull()).select(F.col(id_col).cast("long").alias("query"), F.col(vec).cast("array<double>").alias("q"))
    blocks = max(1, -(-asked.count() // BLOCK))
    asked = asked.withColumn("_block", F.pmod(F.xxhash64("query"), F.lit(blocks)))
    base = corpus.where(F.col(vec).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"))
    out = None
    for b in range(blocks):
        rows = asked.where(F.col("_block") == b).select("query", "q").collect()
        by_len: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in {len(r["q"]) for r in rows}:
            same = [r for r in rows if len(r["q"]) == n]
            q = np.array([r["q"] for r in same], dtype=np.float64).reshape(len(same), n)
            norm = np.linalg.norm(q, axis=1, keepdims=True)
            by_len[n] = (np.array([r["query"] for r in same]), q / np.where(norm == 0, 1, norm))
        held = spark.sparkContext.broadcast(by_len)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            best: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # of each length of query: scores and ids of the k best so far
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, vs = batch.column(0).to_numpy(), batch.column(1).to_pylist()
                sizes = np.array([len(v) for v in vs])
                for n, (names, q) in held.value.items():
                    score = np.zeros((len(q), len(ids)))
                    at = np.flatnonzero(sizes == n)
                    if len(at) and n:
                        x = np.array([vs[i] for i in at], dtype=np.float64)
                        norm = np.linalg.norm(x, axis=1, keepdims=True)
                        score[:, at] = q @ (x / np.where(norm == 0, 1, norm)).T
                    score = np.round(score, 12)
                    all_ids = np.broadcast_to(ids, score.shape)
                    if n in best:
                        score, all_ids = np.hstack([best[n][0], score]), np.hstack([best[n][1], all_ids])
                    order = np.lexsort((all_ids, -score), axis=1)[:, :k]
                    best[n] = np.take_along_axis(score, order, 1), np.take_along_axis(all_ids, order, 1)
            for n, (score, at) in best.items():
                names = held.value[n][0]
                yield pa.record_batch([pa.array(np.repeat(names, score.shape[1])), pa.array(at.ravel()), pa.array(score.ravel())], names=["query", "id", "score"])

        part = base.mapInArrow(run, "query long, id long, score double")
        out = part if out is None else out.union(part)
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def keyword_topk(corpus: DataFrame, terms: list[str], k: int, id_col: str, text: str) -> DataFrame:
    """(id, score): the k texts in which the terms occur most often in all (repeated terms count again), none with 0."""
    t = F.lower(F.coalesce(F.col(text), F.lit("")))
    score = sum((T.occurrences(t, F.lit(x.lower())) for x in terms if x), F.lit(0))
    return corpus.select(F.col(id_col).alias("id"), score.alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(k)


def shingle_topk(corpus: DataFrame, queries: DataFrame, k: int, id_col: str, text: str, query_id: str, query_text: str, language: str | None = None, query_language: str | None = None) -> DataFrame:
    """(query, id, score, rank): the k texts of highest 3-gram Jaccard similarity for each query, none with 0.

    The corpus' grams are joined with the queries' grams, so only texts with something in common are scored, and counted
    before the scores are made. With languages, a text of another language than the query's does not count; one without, in
    any case, fits all.
    """
    spoken = lambda name: F.lower(F.coalesce(F.col(name), F.lit(""))) if name else F.lit("")
    c = corpus.select(F.col(id_col).alias("id"), spoken(language).alias("lc"), T.shingles(F.col(text)).alias("g")).withColumn("n", F.size("g"))
    q = queries.select(F.col(query_id).alias("query"), spoken(query_language).alias("lq"), T.shingles(F.col(query_text)).alias("g")).withColumn("m", F.size("g"))
    grams = q.select("query", "lq", "m", F.explode("g").alias("gram"))
    met = c.select("id", "lc", "n", F.explode("g").alias("gram")).join(grams, "gram").where("lc = lq OR lc = '' OR lq = ''")
    common = met.groupBy("query", "id", "n", "m").agg(F.count("*").alias("x"))
    scored = common.select("query", "id", (F.col("x") / (F.col("n") + F.col("m") - F.col("x"))).alias("score"))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search_lines(df: DataFrame, keys: list[str], text: str, pattern: str, width: int = 240) -> DataFrame:
    """(keys..., line_no, line): lines in which the pattern is found, cut to width characters. Texts without it are not split."""
    hit = df.where(F.col(text).rlike(f"(?m){pattern}"))
    return lines(hit, keys, text).where(F.col("line").rlike(pattern)).withColumn("line", F.substring("line", 1, width))


def kept_or_first(candidates: DataFrame, group: str, keep: Column, order: str, n: int) -> DataFrame:
    """The candidates that keep holds for; of groups where it holds for none the first n by order."""
    some = candidates.where(keep).select(group).distinct()
    w = Window.partitionBy(group).orderBy(order)
    rest = candidates.join(some, group, "left_anti").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
    return candidates.where(keep).unionByName(rest)
