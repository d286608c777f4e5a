"""Rules on text lines and names, merging of decisions, priorities, and splitting to size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernglass.operators.windows import lines


def rule_matches(df: DataFrame, keys: Sequence[str], language: str, text: str, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(keys..., line_no, rule): lines that hold a rule's literal (rule, language, literal), by language, in letter case.

    The rules are a fixed list: they become one expression per line that keeps only those that hit, instead of a join of
    lines and rules. Texts in which no literal occurs are not split.
    """
    any_hit = F.lit(False)
    for _, lang, literal in rules:
        any_hit |= (F.col(language) == lang) & F.contains(F.col(text), F.lit(literal))
    rows = lines(df.where(any_hit), [*keys, language], text)
    hits = F.array_compact(F.array(*(F.when((F.col(language) == lang) & F.contains("line", F.lit(literal)), F.lit(r)) for r, lang, literal in rules)))
    return rows.withColumn("rule", F.explode(hits)).select(*keys, "line_no", "rule")


def extract_marks(df: DataFrame, keys: Sequence[str], text: str, pattern: str, groups: Sequence[str]) -> DataFrame:
    """(keys..., line_no, groups...): the pattern's groups of each line in which it is found."""
    rows = lines(df.where(F.col(text).rlike(pattern)), keys, text).where(F.col("line").rlike(pattern))
    return rows.select(*keys, "line_no", *(F.regexp_extract("line", pattern, i + 1).alias(g) for i, g in enumerate(groups)))


def first_rule(name: Column, rules: Sequence[tuple[str, str, float]]) -> tuple[Column, Column]:
    """(kind, weight) of the first rule (kind, pattern, weight) whose pattern a name matches; NULL if none does."""
    kind, weight = F.lit(None).cast("string"), F.lit(None).cast("double")
    for k, p, w in reversed(list(rules)):
        kind, weight = F.when(name.rlike(p), F.lit(k)).otherwise(kind), F.when(name.rlike(p), F.lit(w)).otherwise(weight)
    return kind, weight


def by_priority(df: DataFrame, key: str, first: DataFrame, order: str) -> DataFrame:
    """df with position: rows whose key is in first (key, priority) by priority, then the rest by order."""
    p = first.groupBy(key).agg(F.min("priority").alias("priority"))
    return df.join(p, key, "left").withColumn("position", F.struct(F.col("priority").isNull().alias("rest"), F.coalesce("priority", F.lit(0)).alias("p"), F.col(order).alias("o")))


def merge_decisions(rows: DataFrame, decisions: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """Rows after decisions: of the rows a decision names the first by order stays, or none if it drops them; rows that no
    decision names stay. A row that several decisions name goes by each.

    decisions has a row per decision (ids array, drop), or, where one may name any number of rows, a row per name
    (decision, drop, key)."""
    if "ids" in decisions.columns:
        named = decisions.withColumn("_d", F.monotonically_increasing_id()).select("_d", "drop", F.explode("ids").alias(key)).distinct()
    else:
        named = decisions.select(F.col("decision").alias("_d"), "drop", key).distinct()
    w = Window.partitionBy("_d").orderBy(*order)
    kept = named.where("NOT drop").join(rows, key).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select(*rows.columns).distinct()
    return kept.union(rows.join(named.select(key).distinct(), key, "left_anti").select(*rows.columns))


def split_to_size(ranges: DataFrame, keys: Sequence[str], start: str, end: str, most: int, rounds: int = 4) -> DataFrame:
    """Ranges of more than most lines cut in half, round by round, at most so many times; what is still longer stays."""
    for _ in range(rounds):
        size = F.col(end) - F.col(start) + 1
        middle = F.floor((F.col(start) + F.col(end)) / 2).cast("int")
        halves = F.array(F.struct(F.col(start).alias("a"), middle.alias("b")), F.struct((middle + 1).alias("a"), F.col(end).alias("b")))
        whole = F.array(F.struct(F.col(start).alias("a"), F.col(end).alias("b")))
        ranges = ranges.select(*keys, F.explode(F.when(size > most, halves).otherwise(whole)).alias("r")).select(*keys, F.col("r.a").alias(start), F.col("r.b").alias(end))
    return ranges


def downgraded(findings: DataFrame, reached: DataFrame, file: str, is_test: Column, is_entry: Column) -> DataFrame:
    """findings with reason: test file, or neither reached nor an entry file; NULL for the rest. reached has (file)."""
    r = reached.select(F.col("file").alias(file)).distinct().withColumn("_r", F.lit(True))
    reason = F.when(is_test, "test").when(F.col("_r").isNull() & ~is_entry, "unreached")
    return findings.join(r, file, "left").withColumn("reason", reason).drop("_r")



def markers(df: DataFrame, keys: Sequence[str], text: str, pattern: str) -> DataFrame:
    """(keys..., line_no, rule, reason) of the lines with a marker, the pattern's first group being the rule, the second a reason.

    Both come without outer blanks, the reason empty where there is none. Texts without a marker are not split.
    """
    found = extract_marks(df, keys, text, pattern, ["rule", "reason"])
    return found.withColumns({"rule": F.trim("rule"), "reason": F.trim("reason")})


def of_categories(table: Sequence[tuple], categories: Sequence[str]) -> list[tuple]:
    """The rules (id, language, categories, ...) of one of the categories, in any case; all of them for none."""
    wanted = {c.lower() for c in categories}
    return [r for r in table if not wanted or wanted & {c.lower() for c in r[2]}]


def pattern_matches(df: DataFrame, keys: Sequence[str], language: str, text: str, rules: Sequence[tuple[str, str, Sequence[str]]]) -> DataFrame:
    """(keys..., line_no, rule): lines that one of a rule's patterns (rule, language, patterns) matches, once per rule.

    Patterns that are no regular expressions are left out. Texts that no pattern of their language matches are not split.
    """
    import re

    def sound(p: str) -> bool:
        try:
            re.compile(p)
        except re.error:
            return False
        return True

    tests = [(r, lang, "|".join(f"(?:{p})" for p in patterns if sound(p))) for r, lang, patterns in rules]
    tests = [t for t in tests if t[2]]
    some = F.lit(False)
    for _, lang, p in tests:
        some |= (F.col(language) == lang) & F.col(text).rlike(f"(?m){p}")  # as its lines do
    rows = lines(df.where(some), [*keys, language], text)
    hits = F.array_compact(F.array(*(F.when((F.col(language) == lang) & F.col("line").rlike(p), F.lit(r)) for r, lang, p in tests)))
    return rows.withColumn("rule", F.explode(hits)).select(*keys, "line_no", "rule")


def callee_matches(calls: DataFrame, language: str, callee: str, rules: Sequence[tuple[str, str, Sequence[str]]]) -> DataFrame:
    """calls with rule: the rules (rule, language, names) that name a callee, whole or by what follows its last point."""
    whole = F.trim(F.col(callee))
    last = F.regexp_extract(whole, r"([^.]*)$", 1)
    hits = F.array_compact(F.array(*(F.when((F.col(language) == lang) & (whole.isin(*names) | last.isin(*names)), F.lit(r)) for r, lang, names in rules if names)))
    return calls.withColumn("rule", F.explode(hits))
