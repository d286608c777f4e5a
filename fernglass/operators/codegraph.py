"""Symbols, calls and imports of parsed files, and the edges between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernglass.functions import text as T

#: Suffixes that an import may leave out, those of one that begins with a point, and what a folder stands for.
SUFFIXES = ("", ".go", ".py", ".js", ".ts", ".java")
BESIDE = ("", ".go", ".py", ".js", ".jsx", ".ts", ".tsx", ".java")
INDEXES = ("index.js", "index.ts", "__init__.py")


def records(asts: DataFrame) -> DataFrame:
    """One record per file_id, the longest in symbols and calls: partial and repeated parses fall away."""
    size = F.struct(F.coalesce(F.size("symbols"), F.lit(0)) + F.coalesce(F.size("calls"), F.lit(0)), F.coalesce(F.size("imports"), F.lit(0)))
    return asts.groupBy("file_id").agg(F.max_by(F.struct("path", "imports", "symbols", "calls"), size).alias("r")).select("file_id", "r.*")


def symbols(rec: DataFrame) -> DataFrame:
    """(file_id, ordinal, kind, name, start_line, end_line)."""
    return rec.select("file_id", F.posexplode("symbols").alias("ordinal", "s")).select("file_id", "ordinal", "s.kind", "s.name", "s.start_line", "s.end_line")


def nodes(rec: DataFrame) -> DataFrame:
    """(file_id, ordinal, name, node): the functions and methods of each file, once per name.

    The first of a name is called by it; a later one by its receiver's type and the name, if it has a receiver, else it is
    left out. Of several of one such name the last stays.
    """
    s = rec.select("file_id", F.posexplode("symbols").alias("ordinal", "s")).where("s.kind IN ('function', 'method') AND s.name IS NOT NULL")
    s = s.select("file_id", "ordinal", F.col("s.name").alias("name"), T.receiver_name(F.col("s.receiver")).alias("of"))
    first = s.groupBy("file_id", "name").agg(F.min("ordinal").alias("first"))
    named = s.join(first, ["file_id", "name"]).withColumn("node", F.when(F.col("ordinal") == F.col("first"), F.col("name")).when(F.col("of") != "", F.concat_ws(".", "of", "name")))
    return named.where("node IS NOT NULL").groupBy("file_id", "node").agg(F.max("ordinal").alias("ordinal"), F.max_by("name", "ordinal").alias("name"))


def calls(rec: DataFrame) -> DataFrame:
    """(file_id, call_no, callee, line)."""
    return rec.select("file_id", F.posexplode("calls").alias("call_no", "c")).select("file_id", "call_no", "c.callee", "c.line")


def imports(rec: DataFrame) -> DataFrame:
    """(file_id, path, import_no, import, line)."""
    return rec.select("file_id", "path", F.posexplode("imports").alias("import_no", "m")).select("file_id", "path", "import_no", F.col("m.path").alias("import"), "m.line")


def enclosing(calls_: DataFrame, symbols_: DataFrame, block: int = 64) -> DataFrame:
    """Each call with the symbol of smallest span around its line (the earlier of equals); calls outside of all do not come out.

    Spans are cut into blocks of lines that join with the file.
    """
    s = symbols_.where("start_line <= end_line").withColumn("_b", F.explode(F.sequence(F.floor(F.col("start_line") / block), F.floor(F.col("end_line") / block)))).withColumnsRenamed({"kind": "_k"}).drop("_k")
    c = calls_.withColumn("_b", F.floor(F.col("line") / block))
    j = c.join(s, ["file_id", "_b"]).where("line BETWEEN start_line AND end_line")
    best = F.min_by(F.struct("name", "start_line", "end_line"), F.struct(F.col("end_line") - F.col("start_line"), F.col("ordinal")))
    return j.groupBy("file_id", "call_no", "callee", "line").agg(best.alias("s")).select("file_id", "call_no", "callee", "line", F.col("s.name").alias("caller"), F.col("s.start_line").alias("caller_line"))


def resolve_calls(within: DataFrame, symbols_: DataFrame, links: DataFrame) -> DataFrame:
    """(file_id, caller, to_file, callee) edges of calls by name: to symbols of the same file and of files it links to, and
    only where there are none to symbols of that name anywhere; a function's calls of itself are left out.

    Names are met once: a call's own and linked files are asked for each name, and what none of them has is joined by name.
    """
    c = within.select("file_id", "caller", T.last_segment(F.col("callee")).alias("callee")).distinct()
    s = symbols_.select(F.col("file_id").alias("to_file"), F.col("name").alias("callee")).where("callee IS NOT NULL").distinct()
    asked = c.select("file_id", "callee").distinct()
    places = asked.select("file_id", "callee", F.col("file_id").alias("to_file")).union(asked.join(links.select("file_id", "to_file").distinct(), "file_id").select("file_id", "callee", "to_file"))
    near = places.distinct().join(s, ["to_file", "callee"]).select("file_id", "callee", "to_file")
    far = asked.join(near, ["file_id", "callee"], "left_anti").join(s, "callee").select("file_id", "callee", "to_file")
    edges = c.join(near.union(far), ["file_id", "callee"]).select("file_id", "caller", "to_file", "callee")
    return edges.where("NOT (file_id = to_file AND caller = callee)")


def resolve_imports(imports_: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, import_no, target): the path that an import means, or ext: and the import.

    In this order: a path beside the importing file (.. resolved) for imports that begin with a point, with a suffix left
    out, or its index file; a path of the project, points read as slashes or as they are; a file of that base name in
    Python, then Go, if there is only one. All candidates of an import are joined with the paths at once, and the first
    in order that exists is taken.
    """
    f = files.select(F.col("path").alias("target")).where("target IS NOT NULL").distinct()
    exact = f.select(F.concat(F.lit("="), F.col("target")).alias("key"), "target")
    keys = f.select(F.lower("target").alias("key"), "target").union(f.select(F.lower(F.regexp_replace("target", r"\.[^./]*$", "")), "target")).groupBy("key").agg(F.min("target").alias("target"))
    base = f.groupBy(F.concat(F.lit("/"), F.lower(T.base_name(F.col("target")))).alias("key")).agg(F.min("target").alias("target"), F.count("*").alias("n")).where("n = 1").select("key", "target")
    imp = F.trim("import")
    i = imports_.where(imp != "").select("file_id", "import_no", imp.alias("imp"), "path")
    beside = T.clean_path(F.concat_ws("/", T.dir_name(F.col("path")), "imp"))
    dotted = F.lower(F.replace("imp", F.lit("."), F.lit("/")))
    last = F.lower(F.element_at(F.split("imp", r"[/.]"), -1))
    relative = [F.lower(F.concat(beside, F.lit(s))) for s in BESIDE] + [F.concat(F.lit("="), beside, F.lit("/" + x)) for x in INDEXES]
    plain = [F.concat(x, F.lit(s)) for s in SUFFIXES for x in (dotted, F.lower("imp"))] + [F.concat(F.lit("/"), last, F.lit(s)) for s in (".py", ".go")]
    asked = i.withColumn("c", F.when(F.col("imp").startswith("."), F.array(*relative)).otherwise(F.array(*plain))).select("file_id", "import_no", "imp", F.posexplode("c").alias("p", "key"))
    known = keys.union(exact).union(base)
    found = asked.join(known, "key", "left").groupBy("file_id", "import_no", "imp").agg(F.min_by("target", F.when(F.col("target").isNotNull(), F.col("p"))).alias("target"))
    return found.select("file_id", "import_no", F.coalesce("target", F.concat(F.lit("ext:"), F.col("imp"))).alias("target"))


def lookup(names: DataFrame, symbols_: DataFrame) -> DataFrame:
    """names (file_id, name) with every symbol of that name: (file_id, name, to_file, ordinal, own), own telling the file's own ones."""
    s = symbols_.select(F.col("file_id").alias("to_file"), "name", "ordinal").where("name IS NOT NULL")
    return names.join(s, "name").select("file_id", "name", "to_file", "ordinal", (F.col("file_id") == F.col("to_file")).alias("own"))


def referenced(chunks: DataFrame, symbols_: DataFrame, links: DataFrame) -> DataFrame:
    """chunks (chunk, file_id, name) with the file that defines the name: its own, else the first of those it links to.

    (chunk, name, to_file, near), near being 0 for the own file and 1 for a linked one; names that neither defines do not come out.
    """
    s = symbols_.select(F.col("file_id").alias("to_file"), "name").where("name IS NOT NULL").distinct()
    where = chunks.select("file_id").distinct().select("file_id", F.col("file_id").alias("to_file"), F.lit(0).alias("near")).union(links.select("file_id", "to_file", F.lit(1)).where("file_id <> to_file").distinct())
    met = chunks.join(where, "file_id").join(s, ["to_file", "name"])
    best = met.groupBy("chunk", "name").agg(F.min(F.struct("near", "to_file")).alias("b"))
    return best.select("chunk", "name", "b.to_file", "b.near")


def siblings(symbols_: DataFrame, at: DataFrame, n: int) -> DataFrame:
    """The n symbols of a file nearest to each place of at (place, file_id, line), by distance of lines, then order."""
    from pyspark.sql import Window

    s = symbols_.where("start_line <= end_line")
    far = F.greatest(F.col("start_line") - F.col("line"), F.col("line") - F.col("end_line"), F.lit(0))
    met = at.join(s, "file_id").withColumn("distance", far).where("distance > 0")
    w = Window.partitionBy("place").orderBy("distance", "ordinal")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("place", "ordinal", "name", "distance", "rank")
