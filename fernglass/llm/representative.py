"""The best representative of each group of duplicate findings, and values fused field by field.

Every value that some source gives for a field of a group is a fact that is true or not. Sources differ in sensitivity
(how often they give a true value) and in specificity (how rarely a false one); both are inferred together with the facts
by expectation-maximisation. Facts are counted by who gave and who did not give them, so a step of the inference reads
these patterns only. The same two-sided model, with the qualities of a record as its sources, says how probably a record
is its group's best: that chooses the survivor.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fernglass.functions import text
from fernglass.functions.findings import CONFIDENCES, SEVERITIES, rank
from fernglass.session import materialize

#: Patterns of sources that are fitted on the driver; beyond, each step is an aggregate over their table.
MAX_PATTERNS = 200_000
#: Rates that sources start with, and pseudo-claims of such ones: (sensitivity, specificity), weight of both.
START, PSEUDO = (0.7, 0.8), 10.0


def clean(c: Column | str) -> Column:
    """Lower case without outer blanks; blank is NULL."""
    c = F.lower(F.trim(F.col(c) if isinstance(c, str) else c))
    return F.when(c != "", c)


def clean_path(path: Column | str) -> Column:
    """One spelling of a path: forward slashes, no empty or . parts, every .. resolved, no outer blanks."""
    return text.clean_path(F.trim(F.col(path) if isinstance(path, str) else path))


def _fit(patterns: list[tuple[list[str], list[str], int]], rounds: int, prior: float, threshold: float) -> tuple[list[float], dict[str, tuple[float, float]]]:
    """The probability of each pattern (sources for, sources against, facts), and the sources' rates."""
    names = sorted({s for yes, no, _ in patterns for s in (*yes, *no)})
    number = {s: i for i, s in enumerate(names)}
    count = np.array([n for *_, n in patterns], float)
    side = []
    for k in (0, 1):
        who = np.array([number[s] for row in patterns for s in row[k]], np.int64)
        side.append((who, np.repeat(np.arange(len(patterns)), [len(row[k]) for row in patterns])))
    (yes, at_yes), (no, at_no) = side
    sens, spec = np.full(len(names), START[0]), np.full(len(names), START[1])
    n = len(patterns)

    def posterior() -> np.ndarray:
        odds = np.log(prior / (1 - prior)) + np.bincount(at_yes, np.log(sens / (1 - spec))[yes], n) + np.bincount(at_no, np.log((1 - sens) / spec)[no], n)
        return 1 / (1 + np.exp(-odds))

    for _ in range(rounds):
        p = posterior()
        true, false = count * p, count * (1 - p)
        tp, t = np.bincount(yes, true[at_yes], len(names)), np.bincount(np.r_[yes, no], true[np.r_[at_yes, at_no]], len(names))
        tn, f = np.bincount(no, false[at_no], len(names)), np.bincount(np.r_[yes, no], false[np.r_[at_yes, at_no]], len(names))
        new = (tp + PSEUDO * START[0]) / (t + PSEUDO), (tn + PSEUDO * START[1]) / (f + PSEUDO)
        moved = max(np.abs(new[0] - sens).max(), np.abs(new[1] - spec).max())
        sens, spec = new
        if moved < threshold:
            break
    return posterior().tolist(), {s: (float(sens[i]), float(spec[i])) for s, i in number.items()}


def _fit_table(patterns: DataFrame, rounds: int, prior: float, threshold: float) -> tuple[DataFrame, DataFrame]:
    """As _fit, for any number of patterns (id, yes, no, n) and sources, as tables (id, p) and (s, sens, spec)."""
    given = F.explode(F.concat(F.transform("yes", lambda s: F.struct(s.alias("s"), F.lit(True).alias("o"))), F.transform("no", lambda s: F.struct(s.alias("s"), F.lit(False).alias("o"))))).alias("x")
    votes = materialize(patterns.select("id", "n", given).select("id", "n", "x.s", "x.o"), "votes")
    rates = materialize(votes.select("s").distinct().select("s", F.lit(START[0]).alias("sens"), F.lit(START[1]).alias("spec")), "rates")

    def posterior() -> DataFrame:
        weight = F.when(F.col("o"), F.log(F.col("sens") / (1 - F.col("spec")))).otherwise(F.log((1 - F.col("sens")) / F.col("spec")))
        odds = votes.join(rates, "s").groupBy("id").agg((F.sum(weight) + float(np.log(prior / (1 - prior)))).alias("odds"))
        return odds.select("id", (1 / (1 + F.exp(-F.col("odds")))).alias("p"))

    for _ in range(rounds):
        true, false = F.col("n") * F.col("p"), F.col("n") * (1 - F.col("p"))
        total = votes.join(posterior(), "id").groupBy("s").agg(
            ((F.sum(F.when(F.col("o"), true).otherwise(0.0)) + PSEUDO * START[0]) / (F.sum(true) + PSEUDO)).alias("sens"),
            ((F.sum(F.when(~F.col("o"), false).otherwise(0.0)) + PSEUDO * START[1]) / (F.sum(false) + PSEUDO)).alias("spec"),
        )
        new = materialize(total, "rates")
        moved = new.join(rates.toDF("s", "a", "b"), "s").agg(F.max(F.greatest(F.abs(F.col("sens") - F.col("a")), F.abs(F.col("spec") - F.col("b")))).alias("m")).first()["m"]
        rates = new
        if moved is None or moved < threshold:
            break
    return posterior(), rates


def infer_truth(claims: DataFrame, rounds: int = 20, prior: float = 0.5, threshold: float = 1e-4) -> tuple[DataFrame, DataFrame]:
    """Facts (entity, field, value, p) with their probability, and (s, sens, spec) of each source.

    claims has (entity, field, value, source): one source may give several values for a field. A source that gives some
    value for a field of an entity is taken to deny the other values given there. NULLs and repeated claims are ignored;
    no claims give no facts. Source counts start with a few pseudo-claims. Facts are counted by the sets of sources for and
    against them; the model is fitted on these counts, on the driver up to MAX_PATTERNS of them.
    """
    c = claims.where("entity IS NOT NULL AND field IS NOT NULL AND value IS NOT NULL AND source IS NOT NULL")
    said = c.groupBy("entity", "field", "value").agg(F.sort_array(F.collect_set("source")).alias("yes"))
    heard = c.groupBy("entity", "field").agg(F.sort_array(F.collect_set("source")).alias("all"))
    facts = materialize(said.join(heard, ["entity", "field"]).select("entity", "field", "value", "yes", F.array_except("all", "yes").alias("no")), "facts")
    counted = materialize(facts.groupBy("yes", "no").agg(F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()), "patterns")
    spark = claims.sparkSession
    rows = counted.limit(MAX_PATTERNS + 1).collect()
    if len(rows) <= MAX_PATTERNS:
        p, rates = _fit([(r["yes"], r["no"], r["n"]) for r in rows], rounds, prior, threshold) if rows else ([], {})
        scored = spark.createDataFrame([(r["id"], x) for r, x in zip(rows, p)], "id long, p double")
        rates = spark.createDataFrame([(s, *x) for s, x in rates.items()], "s string, sens double, spec double")
    else:
        scored, rates = _fit_table(counted, rounds, prior, threshold)
    scored = counted.join(scored, "id").select("yes", "no", "p")
    return facts.join(scored, ["yes", "no"]).select("entity", "field", "value", "p"), rates


def quality(evidence: np.ndarray, count: np.ndarray, rounds: int = 100) -> np.ndarray:
    """The probability that a record is its group's best, for each pattern of evidence (patterns x qualities of 0 or 1).

    A record is the best or not; a quality is more often at its group's maximum in the best ones (sensitivity) than in the
    others (1 - specificity). Both are inferred over the patterns' counts, a quality never speaking against its maximum.
    """
    if not len(evidence):
        return np.zeros(0)
    z = evidence.mean(1) * 0.98 + 0.01
    for _ in range(rounds):
        a, b = z * count, (1 - z) * count
        sens = (a @ evidence + 2) / (a.sum() + 3)
        false = np.minimum((b @ evidence + 1) / (b.sum() + 3), sens)
        share = np.clip(a.sum() / count.sum(), 1e-6, 1 - 1e-6)
        odds = np.log(share / (1 - share)) + evidence @ np.log(sens / false) + (1 - evidence) @ np.log((1 - sens) / (1 - false))
        new = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
        if np.abs(new - z).max() < 1e-9:
            break
        z = new
    return z


#: Finding fields that are facts about a place: one value, or every value judged true.
ONE_VALUE = ("severity", "confidence", "verified")
MANY_VALUES = ("cwe", "owasp")
TEXTS = ("description", "code_sample", "cwe", "owasp", "verifier_comment")


def best_findings(findings: DataFrame, agents: DataFrame) -> DataFrame:
    """One row per place with at least two findings: its surviving record and fused fields.

    (place, records, finding_id, n_best, quality, truth, severity, confidence, verified, cwe, owasp). A place is the same file
    (whatever its spelling), rule_id (without case and outer blanks), start_line and end_line; rows with a NULL among these
    are in no place. Evidence of a record is which of six qualities it has as well as the best of its place: verified,
    severity, confidence, trust of its agent, recency, filled fields (n_best of them). The survivor is the record that is
    most probably the best (quality, inferred over all places); of those as probable the one with more maxima, then, if not
    all six, of the most probable values (truth), then of the smallest id. Fused severity, confidence and verified are the
    most probable values, cwe and owasp all values of probability 0.5 or more, NULL or empty where nobody gives one.
    Repeated rows count as records. A place may hold any share of the rows: groups are reduced by pre-aggregated maxima only.
    """
    trust = agents.select(clean("agent").alias("_agent"), "trust").where("_agent IS NOT NULL").groupBy("_agent").agg(F.max("trust").alias("_trust"))
    key = F.struct(clean_path("file").alias("file"), clean("rule_id").alias("rule"), F.col("start_line").alias("s"), F.col("end_line").alias("e"))
    filled = sum((F.coalesce(F.trim(F.col(t)) != "", F.lit(False)).cast("int") for t in TEXTS), F.lit(0))
    rows = findings.where("file IS NOT NULL AND rule_id IS NOT NULL AND start_line IS NOT NULL AND end_line IS NOT NULL").select(
        key.alias("place"), F.col("finding_id").cast("long").alias("finding_id"), clean("agent").alias("_agent"),
        F.when(F.col("verified"), 2).when(~F.col("verified"), 1).otherwise(0).alias("q1"),
        rank(clean("severity"), SEVERITIES).alias("q2"),
        rank(clean("confidence"), CONFIDENCES).alias("q3"),
        F.coalesce(F.unix_micros(F.col("created_at").cast("timestamp")), F.lit(-(1 << 62))).alias("q5"),
        filled.alias("q6"),
        clean("severity").alias("severity"), clean("confidence").alias("confidence"), F.col("verified").cast("string").alias("verified"), F.upper(clean("cwe")).alias("cwe"), F.upper(clean("owasp")).alias("owasp"),
    )
    many = rows.groupBy("place").agg(F.count("*").alias("records")).where("records > 1")
    rows = rows.join(many, "place").join(trust, "_agent", "left").withColumn("q4", F.coalesce("_trust", F.lit(-(1 << 31))))
    rows = materialize(rows.drop("_trust"), "places")
    fields = (*ONE_VALUE, *MANY_VALUES)
    given = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields))).alias("g")
    claims = rows.select(F.col("place").alias("entity"), "finding_id", F.coalesce("_agent", F.lit("")).alias("source"), given).select("entity", "finding_id", "g.field", "g.value", "source")
    facts, _ = infer_truth(claims.drop("finding_id"))
    facts = materialize(facts.withColumn("p", F.round("p", 9)), "facts")
    fused = facts.groupBy(F.col("entity").alias("place")).agg(
        *(F.max_by(F.when(F.col("field") == f, F.col("value")), F.when(F.col("field") == f, F.struct("p", "value"))).alias(f) for f in ONE_VALUE),
        *(F.sort_array(F.collect_set(F.when((F.col("field") == f) & (F.col("p") >= 0.5), F.col("value")))).alias(f) for f in MANY_VALUES),
    )
    qs = ["q1", "q2", "q3", "q4", "q5", "q6"]
    tops = rows.groupBy("place").agg(*(F.max(q).alias("m" + q) for q in qs))
    pattern = sum(F.when(F.col(q) == F.col("m" + q), 1 << i).otherwise(0) for i, q in enumerate(qs))
    judged = rows.join(tops, "place").select("place", "records", "finding_id", pattern.alias("pattern"))
    seen = [(r["pattern"], r["count"]) for r in judged.groupBy("pattern").count().collect()]  # at most 2^6 rows
    evidence = np.array([[p >> i & 1 for i in range(len(qs))] for p, _ in seen], float).reshape(-1, len(qs))
    score = quality(evidence, np.array([n for _, n in seen], float))
    scores = findings.sparkSession.createDataFrame([(p, round(float(x), 12), int(e.sum())) for (p, _), x, e in zip(seen, score, evidence)], T.StructType.fromDDL("pattern int, quality double, n_best int"))
    believed = claims.where("value IS NOT NULL").join(facts, ["entity", "field", "value"]).groupBy(F.col("entity").alias("place"), "finding_id").agg(F.sum(F.col("p") - 0.5).alias("known"))
    judged = judged.join(F.broadcast(scores), "pattern").join(believed, ["place", "finding_id"], "left").withColumn("truth", F.round(0.5 + F.coalesce("known", F.lit(0.0)) / len(fields), 9))
    first = F.struct(-F.col("quality"), -F.col("n_best"), F.when(F.col("n_best") < len(qs), -F.col("truth")).otherwise(0.0), "finding_id")
    best = judged.groupBy("place", "records").agg(F.min_by(F.struct("finding_id", "n_best", "quality", "truth"), first).alias("b"))
    return best.join(fused, "place", "left").select("place", "records", "b.*", *fields)
