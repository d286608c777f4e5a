"""Symbols, imports and calls out of source text, file by file in Arrow batches.

Comments and literals are blanked first, so that what is found is code and keeps its line. Python is read by its own parser
where it parses; the other languages, and what does not parse, by declarations and matched braces.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernglass.functions import text as T

SCHEMA = "file_id long, path string, language string, imports array<struct<path string, alias string, line int>>, symbols array<struct<kind string, name string, start_line int, end_line int, receiver string>>, calls array<struct<callee string, line int>>, loc int"
_ARROW = pa.schema([
    ("file_id", pa.int64()), ("path", pa.string()), ("language", pa.string()), ("imports", pa.list_(pa.struct([("path", pa.string()), ("alias", pa.string()), ("line", pa.int32())]))),
    ("symbols", pa.list_(pa.struct([("kind", pa.string()), ("name", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("receiver", pa.string())]))),
    ("calls", pa.list_(pa.struct([("callee", pa.string()), ("line", pa.int32())]))), ("loc", pa.int32()),
])
_QUOTED = r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\''
_HIDDEN = {
    "python": re.compile(r'#[^\n]*|"""[\s\S]*?"""|\'\'\'[\s\S]*?\'\'\'|' + _QUOTED),
    "java": re.compile(r'//[^\n]*|/\*[\s\S]*?\*/|"""[\s\S]*?"""|' + _QUOTED),
    "go": re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|`[^`]*`|" + _QUOTED),
    "javascript": re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|`(?:[^`\\]|\\[\s\S])*`|" + _QUOTED),
}
_HIDDEN["typescript"] = _HIDDEN["javascript"]
_NAME = r"[A-Za-z_$][\w$]*"
_CALL = re.compile(rf"({_NAME}(?:\s*\??\.\s*{_NAME})*)\s*\(")
_NO_CALL = frozenset("if for while switch catch return function func def class and or not in is lambda await yield new typeof throw else elif with assert synchronized super case go defer select range import var const type".split()) - {"super"}
_DECLARES = re.compile(r"(?:\bfunc(?:\s*\([^()]*\))?|\bfunction\s*\*?|\bdef|\bclass|\bnew)\s*$")
_IMPORT_JS = re.compile(r"""(?m)^[ \t]*import\b[^'"\n;]*(?:\n[^'"\n;]*)*?['"]([^'"\n]+)['"]|\brequire\s*\(\s*['"]([^'"\n]+)['"]\s*\)""")
_METHOD_JS = re.compile(rf"(?m)^[ \t]*(?:(?:public|private|protected|static|async|readonly|override|abstract|get|set)\s+)*\*?\s*(#?{_NAME})\s*(?:<[^<>()]*>)?\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^{{}};=]+)?\{{")
_FUNCTION_JS = re.compile(rf"\bfunction\s*\*?\s*({_NAME})\s*(?:<[^<>()]*>)?\(")
_CLASS = re.compile(rf"\b(?:class|interface)\s+({_NAME})")
_METHOD_JAVA = re.compile(rf"(?m)^[ \t]*(?:@[\w.]+(?:\([^()]*\))?\s*)*(?:(?:public|private|protected|static|final|abstract|native|synchronized|default|strictfp)\s+)*(?:<[^()]*?>\s*)?(?!return\b|new\b|else\b|throw\b)({_NAME}[\w.<>\[\], ?]*?)\s+({_NAME})\s*\([^(){{}};]*\)\s*(?:throws\s+[\w., ]+)?\s*[{{;]")
_FUNC_GO = re.compile(rf"(?m)^func\s*(\([^()\n]*\))?\s*({_NAME})\s*(?:\[[^\]\n]*\])?\(")
_IMPORT_GO = re.compile(rf'(?:^|[\s(;])(?:({_NAME}|\.)\s+)?"([^"\n]+)"')
_IMPORT_JAVA = re.compile(r"(?m)^[ \t]*import\s+([^;\n]+);")


class _Text:
    """A text with its code alone, its line starts and the braces that belong together."""

    def __init__(self, text: str, language: str):
        self.text = text
        self.code = _HIDDEN[language].sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.close: dict[int, int] = {}
        stack: list[int] = []
        for m in re.finditer(r"[{}]", self.code):
            if m[0] == "{":
                stack.append(m.start())
            elif stack:
                self.close[stack.pop()] = m.start()

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def end(self, at: int) -> int:
        """The line where the block that opens behind a place ends; the place's own line without one."""
        brace, semi = self.code.find("{", at), self.code.find(";", at)
        if brace < 0 or 0 <= semi < brace:
            return self.line(at)
        return self.line(self.close.get(brace, brace))


def _calls(t: _Text, last_only: bool) -> list[dict]:
    out = []
    for m in _CALL.finditer(t.code):
        name = re.sub(r"\s+", "", m[1])
        head = name.split(".")[0]
        if head in _NO_CALL or _DECLARES.search(t.code[max(0, m.start() - 200) : m.start()]):
            continue
        out.append({"callee": name.rsplit(".", 1)[-1] if last_only else name, "line": t.line(m.start())})
    return out


def _python(text: str) -> tuple[list, list, list]:
    imports, symbols, calls = [], [], []
    for n in ast.walk(ast.parse(text)):
        if isinstance(n, ast.Import):
            imports += [{"path": a.name, "alias": a.asname, "line": n.lineno} for a in n.names]
        elif isinstance(n, ast.ImportFrom):
            imports.append({"path": "." * n.level + (n.module or ""), "alias": None, "line": n.lineno})
        elif isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            symbols.append({"kind": "class" if isinstance(n, ast.ClassDef) else "function", "name": n.name, "start_line": n.lineno, "end_line": n.end_lineno, "receiver": None})
        elif isinstance(n, ast.Call):
            calls.append({"callee": ast.unparse(n.func), "line": n.lineno})
    return imports, symbols, calls


def _indented(t: _Text) -> tuple[list, list, list]:
    """Python that does not parse: declarations by line, their ends by indentation."""
    imports, symbols = [], []
    lines = t.code.split("\n")
    for i, line in enumerate(lines):
        m = re.match(rf"\s*(?:from\s+([.\w]+)\s+import\b|import\s+([\w.]+))", line)
        if m:
            imports.append({"path": m[1] or m[2], "alias": None, "line": i + 1})
        m = re.match(rf"(\s*)(?:async\s+)?(def|class)\s+({_NAME})", line)
        if m:
            end = i
            for j in range(i + 1, len(lines)):
                if lines[j].strip():
                    if len(lines[j]) - len(lines[j].lstrip()) <= len(m[1]):
                        break
                    end = j
            symbols.append({"kind": "class" if m[2] == "class" else "function", "name": m[3], "start_line": i + 1, "end_line": end + 1, "receiver": None})
    return imports, symbols, _calls(t, False)


def extract(language: str, text: str) -> tuple[list[dict], list[dict], list[dict]]:
    """(imports, symbols, calls) of a text of one of the parsed languages, each in the order of its lines."""
    if language == "python":
        try:
            got = _python(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            got = _indented(_Text(text, language))
    else:
        t = _Text(text, language)
        imports, symbols = [], []
        add = lambda kind, name, at, receiver=None: symbols.append({"kind": kind, "name": name, "start_line": t.line(at), "end_line": t.end(at), "receiver": receiver})
        if language == "go":
            for m in re.finditer(r"(?m)^import\b\s*(\()?", t.code):
                stop = t.code.find(")" if m[1] else "\n", m.end())
                bare = _HIDDEN["go"].sub(lambda h: re.sub(r"[^\n]", " ", h[0]) if h[0][0] == "/" else h[0], text)
                for x in _IMPORT_GO.finditer(bare, m.end(), stop if stop >= 0 else len(text)):
                    imports.append({"path": x[2], "alias": x[1], "line": t.line(x.start(2))})
            for m in _FUNC_GO.finditer(t.code):
                add("method" if m[1] else "function", m[2], m.start(), m[1])
        elif language == "java":
            imports = [{"path": re.sub(r"^static\s+", "static ", m[1].strip()), "alias": None, "line": t.line(m.start(1))} for m in _IMPORT_JAVA.finditer(t.code)]
            for m in _CLASS.finditer(t.code):
                add("class", m[1], m.start())
            for m in _METHOD_JAVA.finditer(t.code):
                add("method", m[2], m.start(2))
        else:
            for m in _IMPORT_JS.finditer(text):
                k = 1 if m[1] else 2
                if t.code[m.start() : m.start() + 12].strip():
                    imports.append({"path": m[k], "alias": None, "line": t.line(m.start(k))})
            for m in _FUNCTION_JS.finditer(t.code):
                add("function", m[1], m.start())
            inside = []
            for m in _CLASS.finditer(t.code):
                add("class", m[1], m.start())
                brace = t.code.find("{", m.end())
                if brace in t.close:
                    inside.append((brace, t.close[brace]))
            for m in _METHOD_JS.finditer(t.code):
                if m[1] not in _NO_CALL and any(a < m.start(1) < b for a, b in inside):
                    add("method", m[1], m.start(1))
        got = imports, symbols, _calls(t, language == "java")
    return tuple(sorted(x, key=lambda r: r.get("start_line") or r.get("line")) for x in got)


def parsed(files: DataFrame, file_id: str = "file_id", path: str = "path", content: str = "content") -> DataFrame:
    """The parse record of each file of a parsed language (SCHEMA); files without a content or of other languages give none.

    Rows are read one by one, so repeated ids come out repeated. What a file lacks is an empty array.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, p, language, body in zip(*(batch.column(k).to_pylist() for k in range(4))):
                imports, symbols, calls = extract(language, body)
                rows.append({"file_id": i, "path": p, "language": language, "imports": imports, "symbols": symbols, "calls": calls, "loc": body.count("\n") + 1})
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    language = T.parser_language(F.col(path))
    return files.where(F.col(content).isNotNull() & F.col(path).isNotNull() & (language != "")).select(F.col(file_id).cast("long"), path, language.alias("language"), content).mapInArrow(run, SCHEMA)
