"""Text functions: white space, fingerprints, token estimates, shingles, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All white space of Unicode, as one regular expression for Java's engine.
SPACE = r"(?U)\s+"


def squeeze(c: Column) -> Column:
    """Carriage returns removed, runs of white space to one blank, ends trimmed; NULL is empty."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "\r", ""), SPACE, " "))


def fold(c: Column) -> Column:
    """squeeze in lower case."""
    return F.lower(squeeze(c))


def specific(c: Column) -> Column:
    """The folded text if it has at least 32 bytes and 4 words, else empty."""
    t = fold(c)
    return F.when((F.octet_length(t) >= 32) & (F.size(F.split(t, " ")) >= 4), t).otherwise("")


def fingerprint(rule: Column, agent: Column, file: Column, code: Column, description: Column) -> Column:
    """16 hex digits over rule, agent, file and the code without regard to white space, or the description where there is none."""
    body = F.when(squeeze(code) != "", squeeze(code)).otherwise(squeeze(description))
    parts = [F.coalesce(x, F.lit("")) for x in (rule, agent, file)]
    return F.substring(F.sha2(F.concat_ws("|", *parts, body), 256), 1, 16)


def line_count(c: Column) -> Column:
    """Line breaks plus one; 0 for empty and NULL."""
    t = F.coalesce(c, F.lit(""))
    return F.when(t == "", 0).otherwise(F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1)


def token_estimate(c: Column) -> Column:
    """A rough count of model tokens from bytes: a quarter below 64 bytes, else 1 in 3.6 of the non-blank ones, line breaks, and a sixth of blanks."""
    t = F.coalesce(c, F.lit(""))
    n = F.octet_length(t)
    count = lambda pattern: F.length(t) - F.length(F.regexp_replace(t, pattern, ""))
    blank, breaks = count(r"[ \t]"), count(r"[\n\r]")
    long = F.floor((n - blank - breaks) * 100 / 360) + breaks + F.floor(blank / 6)
    return F.when(n < 64, F.floor((n + 3) / 4)).otherwise(long).cast("long")


def shingles(c: Column) -> Column:
    """The set of 3-grams of the words (a-z, 0-9, _ in lower case); words below three characters whole."""
    words = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9_]", " "), " +"), lambda w: w != "")
    grams = lambda w: F.when(F.length(w) < 3, F.array(w)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 2, F.lit(1))), lambda i: F.substr(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(F.transform(words, grams)))


def jaccard(a: Column, b: Column) -> Column:
    """Common through all elements of two sets; 0 if one is empty."""
    x = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(x / (F.size(a) + F.size(b) - x))


def occurrences(text: Column, term: Column) -> Column:
    """How often a non-empty term occurs in a text, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("long")


def base_name(path: Column) -> Column:
    """What follows the last slash."""
    return F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1)


def extension(path: Column) -> Column:
    """The lower-case suffix with its point, or empty."""
    return F.lower(F.regexp_extract(base_name(path), r"(\.[^.]*)$", 1))


def last_segment(callee: Column) -> Column:
    """A call's last name: what follows the last point, arrow or double colon, without a bracket part."""
    return F.regexp_extract(F.trim(F.regexp_replace(callee, r"[\[(].*$", "")), r"([^.:>\-]*)$", 1)


def one_line(c: Column, limit: int) -> Column:
    """Folded to one line and cut to limit characters, with three points if it was cut."""
    t = squeeze(c)
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit("..."))).otherwise(t)


def is_test_path(path: Column) -> Column:
    """Whether a path looks like a test or fixture."""
    p = F.lower(F.translate(path, "\\", "/"))
    return p.rlike(r"(_test\.go|\.(test|spec)\.(js|ts))$|/(test|tests|fixtures|__tests__)/") | (base_name(p).startswith("test_") & p.endswith(".py"))


def is_entry_path(path: Column) -> Column:
    """Whether a path looks like a program's entry file."""
    return F.lower(F.translate(path, "\\", "/")).rlike(r"(main\.go|__main__\.py|manage\.py|app\.py|index\.(js|ts)|server\.js|main\.java|application\.java)$")


#: Languages by suffix; a file named dockerfile is one too.
LANGUAGES = {
    ".go": "go", ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".kt": "kotlin",
    ".rb": "ruby", ".php": "php", ".rs": "rust", ".c": "c", ".h": "c", ".cc": "cpp", ".cpp": "cpp", ".hpp": "cpp", ".cs": "csharp", ".scala": "scala",
    ".swift": "swift", ".sh": "shell", ".bash": "shell", ".zsh": "shell", ".sql": "sql", ".tf": "terraform", ".yml": "yaml", ".yaml": "yaml",
    ".json": "json", ".toml": "toml", ".xml": "xml", ".html": "html", ".dockerfile": "dockerfile",
}
#: Languages that are parsed, by suffix.
PARSED = {".go": "go", ".py": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java"}


def looked_up(key: Column, table: dict[str, str], other: str) -> Column:
    """The table's value of a key."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key), F.lit(other))


def language_of(path: Column) -> Column:
    """The language that a path's suffix (or name) stands for, "text" for others."""
    return F.when(F.lower(base_name(path)) == "dockerfile", "dockerfile").otherwise(looked_up(extension(path), LANGUAGES, "text"))


def parser_language(path: Column) -> Column:
    """The language whose parser reads a path, empty for others."""
    return looked_up(extension(path), PARSED, "")


def clean_path(path: Column) -> Column:
    """One spelling of a path: forward slashes, no empty or . parts, every .. resolved."""
    p = F.translate(path, "\\", "/")
    up = lambda acc: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(p.startswith("/"), acc).otherwise(F.concat(acc, F.array(F.lit(".."))))
    step = lambda acc, x: F.when((x == "") | (x == "."), acc).when(x == "..", up(acc)).otherwise(F.concat(acc, F.array(x)))
    parts = F.aggregate(F.split(p, "/"), F.array().cast("array<string>"), step)
    whole = F.concat(F.when(p.startswith("/"), "/").otherwise(""), F.array_join(parts, "/"))
    return F.when(p.rlike(r"(^|/)\.{0,2}(/|$)"), F.when(whole == "", ".").otherwise(whole)).otherwise(p)


def dir_name(path: Column) -> Column:
    """What stands before the last slash, . without one."""
    p = F.translate(path, "\\", "/")
    return F.when(p.contains("/"), F.regexp_replace(p, r"/[^/]*$", "")).otherwise(".")


def relative_to(root: Column | str, path: Column) -> Column:
    """The path below root, or the path itself where it is not below it."""
    r = F.concat(F.regexp_replace(F.lit(root) if isinstance(root, str) else root, r"/+$", ""), F.lit("/"))
    return F.when(F.startswith(path, r), F.substr(path, F.length(r) + 1)).otherwise(path)


def contains_word(text: Column, word: str) -> Column:
    """Whether a word occurs that no letter, digit or _ continues on either side."""
    import re

    return text.rlike(rf"(?<![A-Za-z0-9_]){re.escape(word)}(?![A-Za-z0-9_])")


def cache_key(*parts: Column) -> Column:
    """SHA-256 over parts with NUL between them; NULL is a part of its own, unlike empty."""
    return F.sha2(F.concat_ws("\x00", *(F.coalesce(x.cast("string"), F.lit("\x01")) for x in parts)), 256)


def receiver_name(receiver: Column) -> Column:
    """The type's last name in a receiver: (s *pkg.Service) is Service; empty for NULL."""
    inner = F.trim(F.regexp_replace(F.trim(F.coalesce(receiver, F.lit(""))), r"^[()]+|[()]+$", ""))
    last = F.regexp_replace(F.element_at(F.split(inner, r"\s+"), -1), r"^\*", "")
    return F.regexp_extract(last, r"([^.]*)$", 1)


def thousands(n: Column) -> Column:
    """A whole number with a comma after each three digits."""
    return F.format_number(n, 0)


def glob_pattern(glob: str) -> str:
    """A glob on a base name as a regular expression."""
    import re

    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in glob[i + 1 :]:
            end = glob.index("]", i + 1)
            out += "[" + glob[i + 1 : end].replace("!", "^", 1).replace("\\", "\\\\") + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def is_excluded(path: Column, patterns: tuple[str, ...]) -> Column:
    """Whether one of the patterns is part of the path, or as a glob matches its base name; empty patterns do not count."""
    hit = F.lit(False)
    for p in filter(None, patterns):
        hit |= F.contains(path, F.lit(p)) | base_name(path).rlike(glob_pattern(p))
    return hit


def infra_kind(path: Column, content: Column) -> Column:
    """The kind of infrastructure file: dockerfile, terraform, workflow, compose, kubernetes or empty."""
    base, ext, text = F.lower(base_name(path)), extension(path), F.coalesce(content, F.lit(""))
    yaml = ext.isin(".yml", ".yaml")
    manifest = text.contains("apiVersion") & text.rlike("kind: (Deployment|Pod|Service|Ingress|ConfigMap|Secret|StatefulSet|DaemonSet|Job|CronJob|Role|ClusterRole|ServiceAccount|NetworkPolicy)")
    return (
        F.when(base.rlike(r"^dockerfile($|\.)|\.dockerfile$"), "dockerfile")
        .when(ext.isin(".tf", ".tfvars"), "terraform")
        .when(yaml & F.translate(path, "\\", "/").contains(".github/workflows/"), "workflow")
        .when(base.rlike(r"^(docker-)?compose\.ya?ml$"), "compose")
        .when(yaml & manifest, "kubernetes")
        .otherwise("")
    )
