"""Files that nobody wrote by hand: generated, minified, vendored, dependency locks, data kept as code.

Generation notices are looked for by one multi-pattern automaton in the comments that a file begins or ends with: it finds
the stems of what such a notice says, and the line around a stem tells whether it speaks of the file itself. Headers of
copied projects name a project and its release beside a licence or a source. Directories, lock files and suffixes are rules
on the path; squeezed code, data and rows of numbered members are told by shares of the content.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stems that the automaton looks for, lower case; the sentences below decide.
GENERATION = ("generat", "génér", "gener", "erzeugt", "produ", "machine", "automat", "autom\u00e1t", "creado", "créé", "output of", "overwritten", "will be lost", "überschrieben")
ORIGIN = ("licen", "bsd", "mit", "apache", "gpl", "mpl", "upstream", "vendored", "copied", "forked", "borrowed", "homepage", "http", "git.", "author", "contributor")

_SUBJECT = r"(?:(?:this|the|these|diese[rs]?|die|das|ce|cet|cette|le|la|el|este|esta|questo|dit|do not (?:edit|modify|change|touch)\W+(?:this )?)\s*)?(?:\w+\s+)?(?:source )?(?:file|code|module|class|stub|script|document|header|binding|contents?|datei|quelltext|quellcode|modul|fichier|archivo|fichero|c[oó]digo|bestand)s?\s+(?:(?:is|are|was|were|has been|have been|wurden?|wird|ist|a été|est|fue|ha sido|es|werd|will be)\s+)?(?:(?:[^\n.;]|\.(?=\S)){0,40}?\s)??"
_BY_TOOL = r"(?:generated|regenerated|generiert|erzeugt|généré|produced|produit|generado|generata|gegenereerd)"
_BY_ITSELF = r"(?:auto|machine|tool)[-\s]?(?:matically|matisch|matiquement|m[aá]ticamente)?[-\s]*(?:generated|generiert|erzeugt|généré|produced|produit|generado|written|created|creado|emitted|built|made|compiled|re-?built)"
_LEAD = r"(?:^|\n)[\s/*#;<!\-\"'%>(]*(?:@|note:|warning:|attention:|achtung:)?\s*"
#: Sentences that say that the file itself comes out of a tool.
NOTICE = re.compile(
    rf"{_LEAD}(?:{_SUBJECT}{_BY_TOOL}\b|(?:(?:this|the|source|file|code|module|class|stub|is|was|has|been|part|of)\s+){{0,5}}{_BY_ITSELF}\b(?=\s*(?:by|from|with|using|via|on|at|for|file|code|stub|tool|par|por|aus|von|avec|\W|$))(?!\s+(?:file|code|stub)s?\s+(?:is|are|was|were|must|should|can|that|which|go|live)\b)"
    rf"|{_BY_TOOL}(?:\s+(?:automatically|automatisch|automatiquement))?\s*(?:by|from|with|using|via|on|at|stub|file|code|par|por|aus|von|avec|[,;:.(!]|$|\n)(?!\w*\s*(?:is|are|was|were|must|should|can|that|which|go|live)\b))"
    r"|(?:do not|don't|never) (?:edit|modify|change|touch)\b[^\n]{0,60}\b(?:output of|generated|regenerate|overwritten)|\boutput of [^\n]{1,60}(?:do not|don't) (?:edit|modify)"
    r"|(?:changes|edits|modifications)(?: \w+){0,5} (?:will|would|shall) be (?:lost|overwritten)|nicht von hand (?:ge|be|zu|ver)|(?:ne pas (?:modifier|éditer)|no (?:editar|modificar))[^\n]{0,60}(?:généré|generado|automat|autom)"
)
_RELEASE = re.compile(r"(?:^|\n)[\s/*#;<!\-]*(?:@(?:version|release|module|name|preserve)\b[^\n]*|(?!copyright)(?:[\w.@/&+-]+[ \t]+){1,5}(?:version[ \t]+|release[ \t]+|v)?\d+\.\d+(?:\.\d+)?(?:[-+.][\w.]+)?(?:[ \t]*[|,(*-][^\n]*)?)[ \t*/]*(?=\n|$)")
_LICENCE = re.compile(r"\b(?:licen[cs]ed?|mit|bsd(?:-\d)?(?:-clause)?|apache|l?gpl|mpl|isc|public domain|copying)\b")
_SOURCE = re.compile(r"(?:upstream|homepage|origin|project page|source|repository|website)\s*:\s*\S|https?://\S+|\bgit[.@]\S+")
_COPIED = re.compile(r"(?:^|\n)[\s/*#;<!\-]*(?:this (?:file|code|module|directory) (?:is|was) )?(?:(?:a )?(?:verbatim |modified )?cop(?:y of|ied (?:verbatim )?from)|vendored (?:copy of|from|in from)|forked from|imported (?:verbatim )?from upstream|borrowed from)\s+\S")

VENDOR_DIR = re.compile(r"(^|/)(node_modules|bower_components|jspm_packages|third[_-]?party|thirdparty|vendor|vendors|vendored|godeps|_workspace|deps|site-packages|dist-packages|\.yarn|pods|carthage|(static|public|assets)/lib)/|^(\./)*([^/]+/)?externals?/[^/]+/.", re.I)
LOCK_FILE = re.compile(r"(^|/)(package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.yaml|bun\.lockb?|composer\.lock|gemfile\.lock|cargo\.lock|poetry\.lock|pipfile\.lock|uv\.lock|pdm\.lock|go\.sum|gopkg\.lock|glide\.lock|mix\.lock|pubspec\.lock|podfile\.lock|packages\.lock\.json|flake\.lock|\.terraform\.lock\.hcl)$", re.I)
MINIFIED_NAME = re.compile(r"[.-](min|bundle|chunk)\.(js|mjs|cjs|css)$", re.I)
GENERATED_NAME = re.compile(r"(\.pb\.(go|cc|h|dart)|_pb2(_grpc)?\.pyi?|\.(g|gen|generated|designer)\.[a-z]+|_generated\.[a-z]+|_gen\.go|grpc\.java|\.g\.dart)$", re.I)
#: What parser generators call the files they write.
PARSER_NAME = re.compile(r"(^|/)(y\.tab\.[ch]|lex\.yy\.cc?|(parsetab|lextab|yytab)\d*\.[a-z]+|[^/]+(parser|lexer)\.(tokens|interp))$", re.I)
CODE = re.compile(r"\.(py|go|java|js|jsx|mjs|cjs|ts|tsx|c|cc|cpp|h|hpp|cs|rb|php|rs|kt|scala|swift)$", re.I)

_COMMENT = re.compile(r"\s*(//|#|/\*|\*|--|<!--|;)")
_LITERAL = re.compile(r'"""[\s\S]*?"""|\'\'\'[\s\S]*?\'\'\'|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`[^`]*`')
_NAME = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*")
_LONG = re.compile(r"[^\n]{301,}")
_NUMBER = re.compile(r"\d+")
#: Members numbered one after another, and the share of lines that they take, from which on they are a tool's.
MEMBERS, MEMBER_SHARE = 8, 0.6


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, words in (("generated", GENERATION), ("vendored", ORIGIN)):
        for w in words:
            a.add_word(w, kind)
    a.make_automaton()
    return a


def header(content: str) -> str:
    """The comments before the first line of code."""
    out, at, quote = [], 0, None
    while at < len(content):
        end = content.find("\n", at)
        end = len(content) if end < 0 else end
        line = content[at:end]
        at = end + 1
        s = line.strip()
        if quote:
            out.append(s)
            quote = None if quote in s else quote
        elif s[:3] in ('"""', "'''"):
            out.append(s)
            quote = None if s.count(s[:3]) > 1 else s[:3]
        elif not s or _COMMENT.match(line):
            out.append(s)
        else:
            break
    return "\n".join(out)


def footer(content: str) -> str:
    """The comments after the last line of code."""
    out = []
    end = len(content)
    while end > 0:
        at = content.rfind("\n", 0, end) + 1
        line = content[at:end]
        if line.strip() and not _COMMENT.match(line):
            break
        out.append(line.strip())
        end = at - 1
    return "\n".join(out[::-1])


def noticed(comments: str, repo: str, automaton: ahocorasick.Automaton) -> str | None:
    """What the comments around a file's code say of it: generated, vendored or nothing.

    A licence alone says nothing: it takes a project's name with a release beside a licence, or a source of another project
    with either, or the words that something was copied in. The repo's own name is no other project.
    """
    low = comments.lower()
    kinds = {kind for _, kind in automaton.iter(low)}
    if "generated" in kinds and NOTICE.search(low):
        return "generated"
    if "vendored" in kinds:
        if _COPIED.search(low):
            return "vendored"
        release, licence, source = _RELEASE.search(low), _LICENCE.search(low), _SOURCE.search(low)
        own = release and repo and re.search(rf"(?<![\w-]){re.escape(repo)}(?![\w-])", release[0])
        if release and not own and (licence or source):
            return "vendored"
    return None


def numbered(content: str) -> float:
    """The share of lines that go with members numbered one after another, if there are at least MEMBERS of them."""
    lines = [x for x in content.split("\n") if len(x) > 3]
    best, run, first, last = 0, 0, None, None
    for line in lines:
        found = [int(x) for x in _NUMBER.findall(line) if len(x) < 7]
        step = None if last is None else next((x for x in (last, last + 1) if x in found), None)
        if step is not None:
            run, last = run + 1, step
        elif found:
            run, first, last = 1, found[-1], found[-1]
        elif last is not None:
            continue
        if last is not None and last - first + 1 >= MEMBERS:
            best = max(best, run)
    return best / max(1, len(lines))


def classify(path: str | None, content: str, automaton: ahocorasick.Automaton) -> str | None:
    """The kind of a file that is not hand-written, else None."""
    path = path or ""
    if LOCK_FILE.search(path):
        return "lock"
    repo = path.lstrip("./").partition("/")[0].lower() if "/" in path.lstrip("./") else ""
    said = noticed(f"{header(content)}\n{footer(content)}", repo, automaton)
    if VENDOR_DIR.search(path) or said == "vendored":
        return "vendored"
    if said or GENERATED_NAME.search(path) or PARSER_NAME.search(path):
        return "generated"
    if MINIFIED_NAME.search(path):
        return "minified"
    if not CODE.search(path) or len(content) < 400:
        return None
    bare = _LITERAL.sub('""', content)
    names = sum(map(len, _NAME.findall(bare)))
    if names < 0.1 * len(content):
        return "data"
    if sum(map(len, _LONG.findall(bare))) > 0.5 * len(bare):
        return "minified"
    if numbered(bare) >= MEMBER_SHARE:
        return "generated"
    return None


def not_handwritten(files: DataFrame, id_col: str = "file_id", path: str = "path", content: str = "content") -> DataFrame:
    """(id, kind) of the files that are not hand-written; kind is generated, minified, vendored, lock or data.

    Files whose content is NULL give no row, nor do empty ones unless their path tells. A NULL path has no path rules.
    Rows are judged one by one, so repeated ids come out repeated. Whole contents are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = _automaton()
        for batch in batches:
            ids, kinds = [], []
            for i, p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                kind = classify(p, c.as_py(), a)
                if kind:
                    ids.append(i)
                    kinds.append(kind)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(kinds, pa.string())], names=["id", "kind"])

    return files.select(F.col(id_col).cast("long"), path, content).where(F.col(content).isNotNull()).mapInArrow(run, "id long, kind string")
