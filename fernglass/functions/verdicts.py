"""Row functions over reviews and verdicts of findings: normal forms, outcomes of gates, and what they change in a finding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from fernglass.functions.findings import CONFIDENCES, SEVERITIES, confidence_rank, rank

#: The gates of a review, and the order in which a failing one gives the reason.
GATES = ("control", "reachability", "validation", "api_contract", "environment", "impact")
REASON_ORDER = ("validation", "api_contract", "environment", "control", "reachability", "impact")
#: Spellings of a gate's states.
PASS = ("pass", "ok", "yes", "supports", "true")
FAIL = ("fail", "blocked", "no", "refutes", "false")
NOT_APPLICABLE = ("n/a", "na", "not applicable", "unknown-na")
#: Spellings of verdicts.
TRUE_POSITIVE = ("tp", "true_positive", "true-positive", "true positive", "confirmed")
FALSE_POSITIVE = ("fp", "false_positive", "false-positive", "false positive", "refuted")
OPEN = ("inconclusive", "unknown", "needs_more_context")


def folded(c: Column) -> Column:
    """Lower case without outer blanks, empty for NULL."""
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def gate(c: Column) -> Column:
    """pass, fail, n/a, or empty for anything else."""
    f = folded(c)
    return F.when(f.isin(*PASS), "pass").when(f.isin(*FAIL), "fail").when(f.isin(*NOT_APPLICABLE), "n/a").otherwise("")


def gate_outcome(review: Column) -> Column:
    """What a review of six gates comes to; unknown for NULL and for one in which no gate is set.

    A failing defence (validation, contract, environment) refutes, then failing control or reach; a failing impact alone
    leaves a weakness in depth. Without a failing gate a review is confirmed if all gates are set and one passes.
    """
    g = {k: gate(review[k]) for k in GATES}
    failing = lambda *names: sum(((g[n] == "fail").cast("int") for n in names), F.lit(0)) > 0
    set_ = sum(((g[n] != "").cast("int") for n in GATES), F.lit(0))
    passing = sum(((g[n] == "pass").cast("int") for n in GATES), F.lit(0))
    return (
        F.when(review.isNull() | (set_ == 0), "unknown")
        .when(failing("validation", "api_contract", "environment"), "refuted_defended")
        .when(failing("control", "reachability"), "refuted_no_control")
        .when(failing("impact"), "defense_in_depth")
        .when((set_ < len(GATES)) | (passing == 0), "inconclusive")
        .otherwise("confirmed")
    )


def failing_reason(review: Column, reasons: dict[str, Column]) -> Column:
    """The reason of the first failing gate that has one, in REASON_ORDER; empty without."""
    found = [F.when((gate(review[k]) == "fail") & (F.coalesce(reasons[k], F.lit("")) != ""), reasons[k]) for k in REASON_ORDER if k in reasons]
    return F.coalesce(*found, F.lit(""))


def gates_applied(review: Column, reasons: dict[str, Column], verified: Column, false_positive: Column, severity: Column, fp_reason: Column) -> dict[str, Column]:
    """outcome, verified, false_positive, severity, fp_reason and defense_in_depth of a finding after its review."""
    outcome, why = gate_outcome(review), failing_reason(review, reasons)
    refuted, depth, confirmed = outcome.startswith("refuted"), outcome == "defense_in_depth", outcome == "confirmed"
    impact = F.coalesce(reasons["impact"], F.lit("")) if "impact" in reasons else F.lit("")
    return {
        "outcome": outcome,
        "verified": verified | confirmed,
        "false_positive": (false_positive | refuted) & ~confirmed,
        "severity": F.when(depth, "low").otherwise(severity),
        "fp_reason": F.when(confirmed, "").when(refuted & (why != ""), why).when(refuted & (fp_reason == ""), "refuted by gate review").when(depth & (impact != "") & (fp_reason == ""), F.concat(F.lit("defense-in-depth: "), impact)).otherwise(fp_reason),
        "defense_in_depth": depth,
    }


def verdict(c: Column) -> Column:
    """tp, fp, inconclusive, or empty for anything else."""
    f = folded(c)
    return F.when(f.isin(*TRUE_POSITIVE), "tp").when(f.isin(*FALSE_POSITIVE), "fp").when(f.isin(*OPEN), "inconclusive").otherwise("")


def deep_verdict(c: Column, review: Column) -> Column:
    """confirmed, refuted or inconclusive: a review that decides overrides the word."""
    word, outcome = folded(c), gate_outcome(review)
    bare = F.when(word.isin("confirmed", "refuted"), word).otherwise("inconclusive")
    return F.when(outcome.startswith("refuted"), "refuted").when(outcome.isin("confirmed", "defense_in_depth"), "confirmed").otherwise(bare)


def is_unclear(c: Column) -> Column:
    """Whether a verdict is missing or open."""
    return folded(c).isin("", "inconclusive", "unknown")


def is_open(word: Column, review: Column) -> Column:
    """Whether a finding is unresolved: by its verdict, or by a review that decides nothing."""
    return F.coalesce(word, F.lit("")).isin("inconclusive", "needs_more_context") | (review.isNotNull() & gate_outcome(review).isin("inconclusive", "unknown"))


def severity_name(c: Column) -> Column:
    """One of SEVERITIES, or empty."""
    f = folded(c)
    return F.when(f.isin(*SEVERITIES), f).when(f == "informational", "info").otherwise("")


def confidence_name(c: Column) -> Column:
    """One of CONFIDENCES, or empty."""
    f = folded(c)
    return F.when(f.isin(*CONFIDENCES), f).when(f == "med", "medium").otherwise("")


def _named(r: Column) -> Column:
    return F.when(r == 3, "high").when(r == 2, "medium").otherwise("low")


def resolved_confidence(confidence: Column, severity: Column, verified: Column, false_positive: Column, verifier: Column, deep: Column, traced: Column, lowered: Column) -> Column:
    """The confidence after all evidence: floors by verdicts, trace and severity, then one step down for lowered rows.

    A confirmed verdict asks for high, a trace or a severity of high or more for medium; one confirmed verdict keeps a
    lowered row at medium, two keep it at high. Anything else is low.
    """
    by_verifier = ~false_positive & verified & folded(verifier).isin("true_positive", "tp", "confirmed", "true")
    by_deep = folded(deep) == "confirmed"
    floor = F.when(by_verifier | by_deep, 3).when(traced | severity.isin("critical", "high"), 2).otherwise(0)
    start = F.greatest(confidence_rank(confidence_name(confidence)), floor)
    strong = F.when(by_verifier & by_deep, 3).when(by_verifier | by_deep, 2).otherwise(0)
    step = F.greatest(start - 1, F.lit(1))
    return _named(F.when(lowered, F.greatest(step, strong)).otherwise(F.greatest(start, F.lit(1))))


def guarded(severity: Column, confidence: Column, tags: Column, guarded_: Column, kind: Column, sanitizer: Column) -> dict[str, Column]:
    """severity, confidence and tags of a finding whose flow runs under a guard, or through a known sanitizer (empty: none)."""
    on = guarded_ | (sanitizer != "")
    lower = F.element_at(F.create_map(*(F.lit(x) for kv in (("critical", "high"), ("high", "medium"), ("medium", "low")) for x in kv)), F.when(severity.isin("critical", "high", "medium"), severity).otherwise("medium"))
    added = F.concat(
        F.when(guarded_, F.array(F.lit("taint-guarded"))).otherwise(F.array().cast("array<string>")),
        F.when(guarded_ & (kind != ""), F.array(F.concat(F.lit("guard:"), kind))).otherwise(F.array().cast("array<string>")),
        F.when(sanitizer != "", F.array(F.concat(F.lit("sanitizer:"), sanitizer))).otherwise(F.array().cast("array<string>")),
    )
    return {
        "severity": F.when(on & severity.isin("critical", "high", "medium"), lower).otherwise(severity),
        "confidence": F.when(on & ((F.lower(confidence) == "high") | (confidence == "")), "medium").otherwise(confidence),
        "tags": F.array_union(F.coalesce(tags, F.array().cast("array<string>")), added),
    }


def consensus(proponent: Column, opponent: Column, p_concedes: Column, o_concedes: Column) -> Column:
    """The verdict that two turns agree on: the other side's where one concedes, both sides' where they are equal, else NULL."""
    p, o = verdict(proponent), verdict(opponent)
    return F.when((p != "") & (o != ""), F.when(p_concedes, o).when(o_concedes, p).when(p == o, p))


def path_confidence(hops: Column, sanitizers: Column, returns: Column) -> Column:
    """Confidence of a path: less with each hop beyond two and with a sanitizer, a little more through a return; 0.2 to 0.99."""
    base = F.lit(0.85) - F.when(hops >= 3, 0.05 * (hops - 2)).otherwise(0.0) - F.when(sanitizers > 0, 0.2).otherwise(0.0) + F.when(returns, 0.02).otherwise(0.0)
    return F.least(F.greatest(base, F.lit(0.2)), F.lit(0.99))


def has_feedback(*lists: Column, notes: Column) -> Column:
    """Whether a critique says anything: an element in one of its lists, or notes."""
    return sum(((F.coalesce(F.size(x), F.lit(0)) > 0).cast("int") for x in lists), F.lit(0)).cast("int").__gt__(0) | (folded(notes) != "")


def rank_of(c: Column, order: Sequence[str]) -> Column:
    """rank without regard to case and outer blanks."""
    return rank(folded(c), order)
