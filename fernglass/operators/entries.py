"""Entry points of programs: ordered rules on a function's signature, the lines around it, its name and its file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (language, symbol kinds, what is looked at, pattern, kind of entry, weight); the first that fits counts.
#: name and path are the symbol's and the file's, file is the whole text, and two of them joined by & must both fit.
RULES = (
    ("go", "function method", "signature", r"\bhttp\.ResponseWriter\b|\*http\.Request\b", "http", 0.95),
    ("go", "function method", "signature", r"\*gin\.Context\b|gin\.HandlerFunc\b", "http", 0.9),
    ("go", "function method", "signature", r"echo\.Context\b", "http", 0.9),
    ("go", "function method", "signature", r"\*fiber\.Ctx\b", "http", 0.9),
    ("go", "function method", "name&file", r"^main$&(?m)^package\s+main\b", "cli", 0.95),
    ("go", "function method", "name", r"(?i)^(Consume|OnMessage|Handle|Handler|Process|Worker)$", "consumer", 0.55),
    ("go", "function method", "body4", r"cobra\.Command|RunE:", "cli", 0.7),
    ("go", "function method", "name&path", r"^[A-Z]&(?i)(^|/)pkg/", "exported", 0.4),
    ("python", "function", "above1", r"@\w*(app|router|api|blueprint)\.(route|get|post|put|patch|delete|options|head|websocket)\b|@\w*\.(get|post|put|patch|delete)\(", "http", 0.9),
    ("python", "function", "above1", r"@\w*click\.command\b|@command\b", "cli", 0.85),
    ("python", "function", "above1", r"@\w*scheduled\b|@cron\b", "scheduled", 0.8),
    ("python", "function", "above1", r"@\w*(consumer|handler|task|listener|subscribe|on_message)\b", "consumer", 0.7),
    ("python", "function", "name", r"^main$", "cli", 0.6),
    ("python", "function", "name&path", r"^[^_]&(?i)__init__\.py$", "exported", 0.4),
    ("javascript", "function method", "above3", r"\b(app|router)\.(get|post|put|patch|delete|use|all|head|options|ws)\s*\(", "http", 0.85),
    ("javascript", "function method", "signature", r"\b(app|router)\.(get|post|put|patch|delete|use|all|head|options|ws)\s*\(", "http", 0.85),
    ("javascript", "function method", "signature", r"\((req|request)\s*[,)].*?(res|response)\s*[,)]?", "http", 0.7),
    ("javascript", "function method", "body3", r"\bctx\.(request|body|query|params)\b", "http", 0.7),
    ("javascript", "function method", "above3", r"\b(cron\.schedule|setInterval|setTimeout)\s*\(", "scheduled", 0.6),
    ("javascript", "function method", "name", r"(?i)on(Message|Event|Request|Connect)|consume|handler", "consumer", 0.55),
    ("javascript", "function method", "above3line", r"(?m)^\s*export\s+(default\s+)?(async\s+)?function\b", "exported", 0.4),
    ("java", "method", "around1", r"@(GetMapping|PostMapping|PutMapping|DeleteMapping|RequestMapping|PatchMapping)\b", "http", 0.92),
    ("java", "method", "signature&file", r"public&@(RestController|Controller)\b", "http", 0.55),
    ("java", "method", "around1", r"@Scheduled\b", "scheduled", 0.8),
    ("java", "method", "signature", r"public\s+static\s+void\s+main\s*\(", "cli", 0.95),
)


def entry_points(records: DataFrame, contents: DataFrame, language: Column, rules=RULES) -> DataFrame:
    """(file_id, name, ordinal, kind, weight) of the symbols that a rule takes for an entry point, once per file and name.

    records has (file_id, path, symbols), contents (file_id, content). Of several of one name the weightiest stays, of equals
    the first. A file's lines are cut once and looked at in place: texts are not repeated for each symbol. Files without a
    content, NULL symbols and languages without rules give no rows.
    """
    f = records.join(contents.where("content IS NOT NULL"), "file_id").withColumn("lines", F.split("content", "\n")).withColumn("lang", language)
    part = lambda a, b: F.array_join(F.slice("lines", F.greatest(a, F.lit(1)), F.greatest(F.least(b, F.size("lines")) - F.greatest(a, F.lit(1)) + 1, F.lit(0))), "\n")

    def judged(s: Column, i: Column) -> Column:
        a, b = s["start_line"], F.greatest(s["end_line"], s["start_line"])
        before = F.coalesce(F.try_element_at(F.filter(F.slice("lines", 1, F.greatest(F.least(a - 1, F.size("lines")), F.lit(0))), lambda x: F.trim(x) != ""), F.lit(-1)), F.lit(""))
        seen = {
            "name": s["name"], "path": F.col("path"), "file": F.col("content"), "signature": part(a, a), "body4": part(a, F.least(a + 4, b)), "body3": part(a, F.least(a + 3, b)),
            "above1": before, "above3": part(a - 3, a - 1), "above3line": F.concat(part(a - 3, a - 1), F.lit("\n"), part(a, a)), "around1": F.concat(before, F.lit("\n"), part(a - 1, F.least(b, a + 1))),
        }
        kind, weight = F.lit(None).cast("string"), F.lit(None).cast("double")
        for lang, kinds, where, pattern, k, w in reversed(rules):
            langs = ("javascript", "typescript") if lang == "javascript" else (lang,)
            fits = F.col("lang").isin(*langs) & s["kind"].isin(*kinds.split())
            for place, p in zip(where.split("&"), pattern.split("&")):
                fits &= F.coalesce(seen[place].rlike(p), F.lit(False))
            kind, weight = F.when(fits, F.lit(k)).otherwise(kind), F.when(fits, F.lit(w)).otherwise(weight)
        return F.struct(s["name"].alias("name"), i.alias("ordinal"), kind.alias("kind"), weight.alias("weight"))

    valid = F.filter(F.transform("symbols", lambda s, i: F.struct(s.alias("s"), i.alias("i"))), lambda x: x["s"]["name"].isNotNull() & (x["s"]["start_line"] >= 1))
    found = f.select("file_id", F.explode(F.filter(F.transform(valid, lambda x: judged(x["s"], x["i"])), lambda r: r["kind"].isNotNull())).alias("r")).select("file_id", "r.*")
    best = found.groupBy("file_id", "name").agg(F.min_by(F.struct("ordinal", "kind", "weight"), F.struct(-F.col("weight"), "ordinal")).alias("b"))
    return best.select("file_id", "name", "b.*")
