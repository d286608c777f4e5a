"""A mixture of sources with target shares of all tokens, by capped water-filling.

Tokens are those of a public byte-pair vocabulary whose file is a parameter. A source can bring at most max_repeats times
its tokens; what a source falls short of its share is spread over the others in proportion to their shares until nothing
overflows. Each source then brings all of its documents some whole number of times, and a seeded sample once more.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fernglass.session import materialize

#: The word pattern that goes with the byte-level vocabularies (a fixed value of theirs).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Slots of a source's sampling order; the cut falls into one of them and is then made exactly.
SLOTS = 1024


def token_counts(documents: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, keep..., tokens): tokens of each whole text; NULL has 0. The vocabulary file must be on every machine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column(0).to_pylist()]
            yield pa.record_batch([*batch.columns[1:], pa.array(n, pa.int64())], names=[*batch.schema.names[1:], "tokens"])

    sel = documents.select(F.col(text), F.col(doc_id).cast("long").alias("doc_id"), *keep)
    schema = T.StructType([*sel.schema.fields[1:], T.StructField("tokens", T.LongType())])
    return sel.mapInArrow(run, schema)


def levels(sizes: DataFrame, total: float | None = None) -> DataFrame:
    """sizes (source, w, k, tokens) with cap and amount: what each source is to bring, by capped water-filling.

    The amount is least(cap, level * w), cap being k * tokens. The level starts at total / sum of w; sources over their cap
    are clamped, and what they lack raises the level of the rest, until nobody is over: each round is one aggregate, and
    rounds end because each clamps a further source. If all are clamped the mixture is smaller than total, by default all
    tokens. Negative and NULL numbers count as 0; without any weight all amounts are 0.
    """
    number = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0))
    s = sizes.withColumns({c: number(c) for c in ("w", "k", "tokens")}).withColumn("cap", (F.col("k") * F.col("tokens")).cast("double"))
    s = materialize(s, "sizes")
    level = None
    while True:
        over = (F.col("w") > 0) & (F.col("cap") <= F.lit(level) * F.col("w")) if level is not None else F.lit(False)
        got = s.agg(F.sum("tokens").alias("all"), F.sum(F.when(over, F.col("cap")).otherwise(0.0)).alias("full"), F.sum(F.when(over, 0.0).otherwise(F.col("w"))).alias("free")).first()
        size = float(got["all"] or 0) if total is None else float(total)
        new = (size - got["full"]) / got["free"] if got["free"] else None
        if new is None or level is not None and new <= level * (1 + 1e-12):
            break
        level = new
    return s.withColumn("amount", F.when(F.col("w") > 0, F.least("cap", F.lit(level) * F.col("w"))).otherwise(0.0)) if level is not None else s.withColumn("amount", F.lit(0.0))


def mixture(documents: DataFrame, targets: DataFrame, vocabulary: str, total: float | None = None, seed: int = 17, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """((doc_id, source, tokens, repeats) of each document used, (source, target_share, max_repeats, tokens, amount, used, share)).

    targets has (source, target_share, max_repeats). Documents of other or NULL sources are not used, nor are those without
    tokens. All of a source's documents are used floor(amount / tokens) times, and those first in a seeded order once more
    until the amount is reached, so no source misses its amount by more than one document, and no document is used more
    than max_repeats times. Sources without tokens have share 0. Any number of sources will do: sizes, levels and cuts are
    tables, of which the driver sees one row of sums a round.
    """
    plan = targets.select(F.col(source).alias("source"), "target_share", "max_repeats").where("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("w"), F.max("max_repeats").alias("k"))
    counted = token_counts(documents.withColumn("source", F.col(source)), vocabulary, doc_id, text, ("source",)).join(plan.select("source"), "source", "left_semi")
    order = F.xxhash64("doc_id", F.lit(seed))
    counted = materialize(counted.where("tokens > 0").withColumn("slot", F.pmod(order, F.lit(SLOTS)).cast("int")).withColumn("order", order), "tokens")
    slots = materialize(counted.groupBy("source", "slot").agg(F.sum("tokens").alias("n")), "slots")  # sources x SLOTS rows at most
    share = levels(plan.join(slots.groupBy("source").agg(F.sum("n").alias("tokens")), "source", "left"), total)
    whole = F.coalesce(F.floor(F.try_divide(F.col("amount"), F.col("tokens"))), F.lit(0)).cast("int")
    share = materialize(share.withColumn("whole", F.least(whole, F.col("k").cast("int"))).withColumn("rest", F.col("amount") - F.col("whole") * F.col("tokens")), "amounts")
    cum = F.sum("n").over(Window.partitionBy("source").orderBy("slot"))  # SLOTS rows a source
    ends = slots.join(share.where("rest > 0 AND whole < k").select("source", "rest"), "source").withColumn("cum", cum).where("cum > rest")
    cuts = ends.groupBy("source").agg(F.min("slot").alias("cut"), F.min(F.struct("slot", F.col("rest") - F.col("cum") + F.col("n")))["col2"].alias("room"))
    placed = counted.join(materialize(share.select("source", "whole").join(cuts, "source", "left"), "cuts"), "source")
    edge = placed.where("slot = cut")
    ahead = F.sum("tokens").over(Window.partitionBy("source").orderBy("order", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, 0))
    edge = edge.withColumn("extra", (ahead <= F.col("room")).cast("int"))
    rest = placed.where("cut IS NULL OR slot <> cut").withColumn("extra", F.coalesce((F.col("slot") < F.col("cut")).cast("int"), F.lit(0)))
    used = rest.unionByName(edge).select("doc_id", "source", "tokens", (F.col("whole") + F.col("extra")).alias("repeats")).where("repeats > 0")
    got = used.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("used"))
    weights = F.sum("w").over(Window.partitionBy())  # one row per source
    report = share.select("source", F.coalesce(F.try_divide(F.col("w"), weights), F.lit(0.0)).alias("target_share"), F.col("k").cast("int").alias("max_repeats"), F.col("tokens").cast("long").alias("tokens"), "amount")
    report = report.join(got, "source", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    everything = F.sum("used").over(Window.partitionBy())
    report = report.withColumn("share", F.coalesce(F.try_divide(F.col("used"), everything), F.lit(0.0)))
    return used, report
