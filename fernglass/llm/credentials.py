"""Credentials in source text: found over the whole corpus, and masked without changing anything else.

1. Index: every text brings its literals, and the evidence that a context gives for some of them (a name that speaks of a
   password, an address with a password in it, an authorization header, a private key, a command's flag, a note in a
   comment, a value of a token's shape).
2. Corpus: owners are counted over all literals of a value. A value that a context speaks for is confirmed unless many
   unrelated owners have it: such a one is a placeholder or a sample out of a manual.
3. Re-scan: every text is searched for all confirmed values by one automaton, so that a value confirmed by one place is
   found and masked in all others, whatever surrounds it there.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernglass.llm.sketch import mix
from fernglass.session import counted, materialize

#: Confirmed values are broadcast as one automaton up to this count; beyond, texts and values meet by a join on eight bytes.
MAX_PATTERNS = 100_000
#: A value is taken for a placeholder if more owners than this, and more than OWNER_SHARE of all owners, have it.
MAX_OWNERS, OWNER_SHARE = 12, 0.02
#: Of longer values the automaton holds the last TAIL characters, the rest is compared where those are found.
TAIL = 64
#: Bits (as powers of 2, least and most) of the filter that tells which eight bytes can be a confirmed value's (beyond MAX_PATTERNS).
FILTER_BITS, MOST_BITS = 26, 28
#: Bytes of texts whose runs of eight are tried at once.
PART = 1 << 19

_NOT_KEY = re.compile(r"(?i)(?:^|_)(?:pub|public|primary|foreign|sort|partition|cache|row|index|map|object|bucket|chunk|dict|lookup|group|host|idempotency|routing|shard)_?key$|(?:^|_)(?:next|page|csrf_field)_?token$")
_STRING = r'"""(?:[^"\\]|\\.|"(?!""))*"""|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`[^`]*`'
_WORDS_OF_KEYS = ("pass", "pwd", "pw", "secret", "token", "credential", "auth", "bearer", "identity", "key")
_KEYED = re.compile(rf"""(?i)(?:pass(?:word|wd|phrase|code)?|pwd|pw|secret|token|credentials?|auth|bearer|identity|(?<!pub)(?<!public)(?<!public[_.\-])(?<!pub[_.\-])(?<=[a-z_.\-])key)s?_?\d*(?![A-Za-z0-9_])["'\]]?[ \t]*(?::[ \t]*[A-Za-z_][\w<>\[\]|]*[ \t]*(?==))?(?::=|=>|==?|:|[ \t])[ \t]*(?:((?:{_STRING})(?:[ \t]*\+[ \t]*(?:{_STRING}))*)|([^\s"'`,;<>{{}}()\[\]$#]{{8,}})[ \t]*\r?(?=\n|\Z))""")
_FLAG = re.compile(r"""(?i)--?(?:password|passwd|pass|pwd|token|secret|api-?key|access-?key)[= \t]+["']?([^\s"'`,;<>{}()$]{8,})""")
_PIECE = re.compile(_STRING)
_URL = re.compile(r"""://([^\s:/@"'`<>]*):([^\s@/"'`<>]+)@""")
_AUTH = re.compile(r"(?i)\b(bearer|basic|token)[ \t]+([A-Za-z0-9._~+/\-]{8,}=*)")
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----((?:\\r|\\n|[\s\"'+,;#/*\-.]|[A-Za-z0-9+/=]|[A-Za-z\-]+: [^\n\\]+)*?)(?=-----END|$|[^A-Za-z0-9+/=\\\s\"'+,;#*.\-:])")
_JWT = re.compile(r"\beyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{16,}")
_CLOUD = re.compile(r"\bA(?:KIA|SIA|GPA|IDA|ROA)[A-Z0-9]{16}\b")
_PAIR = re.compile(r"""(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])""")
_NOTE = re.compile(r"(?i)\b(?:credentials?|login|password|passwd)\b[^\n:=\"']{0,24}[:=][ \t]*(?:[A-Za-z0-9_.\-@]+[:/])([^\s\"'`,;]{8,})")
_SHAPED = re.compile(r"(?<![A-Za-z0-9_.\-/+=])[a-z]{2,8}(?:[-_.][a-z0-9]{1,6})?[-_.](?=[a-z0-9]{0,40}[A-Z])(?=[A-Z0-9]{0,40}[a-z])[A-Za-z0-9]{18,}(?![A-Za-z0-9_.\-/+=])")
_LITERAL = re.compile(r"(?<=[\"'`\s,;()\[\]{}<>:=@])(?=[^\s\"'`,;()\[\]{}<>@]*[0-9][^\s\"'`,;()\[\]{}<>@]*)[^\s\"'`,;()\[\]{}<>@]{8,}|(?<=[\"'`])[^\s\"'`]{8,}(?=[\"'`])")
_COMMENT = re.compile(r"#|//|--|/\*|<!--|^\s*[*;]")
_PROSE_WORDS = ("pw", "pass", "secret", "token", "key", "login", "logon", "cred")
_PROSE_WORD = re.compile(r"(?i)(?<![A-Za-z0-9_])(?:pwd?|pass(?:wd|words?|phrase|code)?|secret|token|login|logon|cred(?:ential)?s?)(?![A-Za-z0-9_])|(?:(?<=api)|(?<=access)|(?<=secret)|(?<=private)|(?<=api[ _-])|(?<=access[ _-])|(?<=secret[ _-])|(?<=private[ _-]))key(?![A-Za-z0-9_])")
_PROSE = re.compile(r"(?:(?<=\s)(?:is|was|are)|[:=/]|->)[ \t]+[\"'`]?([^\s\"'`,;]{8,})")
_COMMAND = re.compile(r"""(?i)\b(?:sshpass[ \t]+-p|(?:mysql|mysqldump|mariadb|7z)\b[^\n|;]*?[ \t]-p(?=[^ \t])|redis-cli\b[^\n|;]*?[ \t]-a|unzip[ \t]+-P|(?:docker|podman|helm|oc|az)\b[^\n|;]*?\blogin\b[^\n|;]*?[ \t]-p|(?:curl|wget|http)\b[^\n|;]*?[ \t](?:-u|--user)[ \t=]+["']?[^\s:"']+:|-pass(?:in|out)?[ \t]+pass:)[ \t]*["']?([^\s"'`|;<>()]{6,})""")
_COMMAND_WORDS = ("sshpass", "mysql", "mariadb", "7z", "redis-cli", "unzip", "docker", "podman", "helm", "oc ", "az ", "curl", "wget", "http ", "-pass")
_CAMEL = re.compile(r"([a-z0-9])([A-Z])")

_REFERENCE = re.compile(r"(?i)^(?:\$|%\w+%|\{\{|<|@|#\{|vault:|sm://|ssm:|ref\+|secret://|secrets?[:/]|kms:|env[:.]|file:|op://|arn:|keyring:|config:|https?://[^@]*$|/|\./)|\$\{|\{\{|process\.env|os\.environ|getenv")
#: Base 64 that begins with a slash, no path: letters of either case and digits, with a sign or padding that paths lack.
_SLASHED = re.compile(r"/(?=[^\n]*[0-9])(?=[^\n]*[a-z])(?=[^\n]*[A-Z])(?:[A-Za-z0-9/]*\+[A-Za-z0-9+/]*={0,2}|[A-Za-z0-9+/]*=)")
_HOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|-+|_+|#+|0+|1+|\?+)$|your[-_ ]|replace|change[-_ ]?me|changeit|todo|fixme|example|placeholder|dummy|sample|redacted|set[-_]in|insert[-_ ]|put[-_ ]|to[-_]be|n/?a$|none$|null$|undefined|hidden|masked|(?:1234567|abcdef|qwerty)")
_WORDS = re.compile(r"(?:[a-z]+_)*[A-Za-z]?[a-z]+(?:[A-Z][a-z]+)*\d{0,3}|(?:[a-z]+\.)+[A-Za-z]?[a-z]+(?:[A-Z][a-z]+)*\d{0,3}|[A-Z]?[a-z]*(?:[-_. ][A-Z]?[a-z]+)*|[A-Z_\-]+|[a-z_]+\.[a-z_.]+")
_DIGEST = re.compile(r"(?i)^(?:sha\d+|md5|blake2b?|sha)[-:]|^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$")


def plausible(value: str, least: int = 8) -> bool:
    """Whether a literal can be a secret: long, without blanks, no reference, placeholder, digest, id or plain words."""
    if len(value) < least or re.search(r"\s", value) or _REFERENCE.search(value) and not _SLASHED.fullmatch(value) or _HOLDER.search(value) or _DIGEST.search(value):
        return False
    if len(set(value)) < 5 or _WORDS.fullmatch(value):
        return False
    turns = sum(a.islower() != b.islower() for a, b in zip(value, value[1:]) if a.isalpha() and b.isalpha())
    return any(c.isdigit() for c in value) or any(not c.isalnum() and c not in "-_. /" for c in value) and turns > 1 or turns >= 4


def _places(low: str, words: tuple[str, ...]) -> list[int]:
    """Where one of the words begins."""
    places = set()
    for word in words:
        at = low.find(word)
        while at >= 0:
            places.add(at)
            at = low.find(word, at + 1)
    return sorted(places)


def _keyed(text: str, low: str) -> Iterator[re.Match]:
    """The matches of _KEYED, tried only where one of its words begins."""
    if len(low) != len(text):
        yield from _KEYED.finditer(text)
        return
    end = 0
    for at in _places(low, _WORDS_OF_KEYS):
        if at >= end and (m := _KEYED.match(text, at)):
            end = m.end()
            yield m


def _noted(text: str, low: str) -> Iterator[tuple[int, int]]:
    """Values that a comment tells in prose: pw for the x box is VALUE, login user / VALUE."""
    words = map(re.Match.end, _PROSE_WORD.finditer(text)) if len(low) != len(text) else (m.end() for at in _places(low, _PROSE_WORDS) if (m := _PROSE_WORD.match(text, at)))
    done = -1
    for at in words:
        if at <= done:
            continue
        first = text.rfind("\n", 0, at) + 1
        done = text.find("\n", at)
        done = len(text) if done < 0 else done
        if not _COMMENT.search(text[first:at]):
            continue
        for v in _PROSE.finditer(text, at, done):
            value = v[1].rstrip(".)")
            if re.search(r"\d", value) and plausible(value) and not re.search(r"[(\[{]|://|\.\w+\.|/\w+/", value):
                yield v.start(1), v.start(1) + len(value)


def _inner(literal: str) -> tuple[int, int]:
    q = 3 if literal[:3] in ('"""', "'''") and len(literal) >= 6 else 1
    return q, len(literal) - q


def spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, value) of each part of the text that its context shows to be a credential; value joins the pieces."""
    out: list[tuple[int, int, str]] = []
    low = text.lower()
    for m in _PEM.finditer(text) if "PRIVATE KEY" in text else ():
        if len(re.sub(r"\\[rn]|[^A-Za-z0-9+/=]", "", m[1])) >= 32:
            out.append((m.start(), m.end(), m[0]))
    for m in _keyed(text, low):
        at = m.start()
        while at and (text[at - 1].isalnum() or text[at - 1] in "_.-"):
            at -= 1
        name = _CAMEL.sub(r"\1_\2", re.match(r"[\w.\-]+", text[at:m.end()])[0])
        if _NOT_KEY.search(name):
            continue
        if m[1] is None:
            if plausible(m[2]) and re.search(r"\d", m[2]) and not re.search(r"[=(]|://|\w\.\w+\.", m[2][:-2]):
                out.append((m.start(2), m.end(2), m[2]))
            continue
        pieces = []
        for p in _PIECE.finditer(text, m.start(1), m.end(1)):
            a, b = _inner(p[0])
            pieces.append((p.start() + a, p.start() + b))
        value = "".join(text[a:b] for a, b in pieces)
        if plausible(value) and not _AUTH.match(value) and "-----BEGIN" not in value:
            out.extend((a, b, value) for a, b in pieces if b > a)
    for a, b in _noted(text, low):
        out.append((a, b, text[a:b]))
    for m in _COMMAND.finditer(text) if any(w in low for w in _COMMAND_WORDS) else ():
        if plausible(m[1], 6):
            out.append((m.start(1), m.end(1), m[1]))
    for m in _FLAG.finditer(text) if "-" in text else ():
        if plausible(m[1]):
            out.append((m.start(1), m.end(1), m[1]))
    for m in _URL.finditer(text) if "://" in text else ():
        if not _REFERENCE.search(m[2]) and not _HOLDER.search(m[2]) and plausible(m[2], 6):
            out.append((m.start(2), m.end(2), m[2]))
    for m in _AUTH.finditer(text) if "bearer" in low or "basic" in low or "token" in low else ():
        value = m[2]
        if m[1].lower() == "basic":
            try:
                user, colon, secret = base64.b64decode(value, validate=True).decode().partition(":")
            except (binascii.Error, ValueError):
                continue
            good = bool(colon) and plausible(secret, 6)
        else:
            good = len(value) >= 16 and bool(re.search(r"\d", value)) and plausible(value)
        if good:
            out.append((m.start(2), m.end(2), value))
    for m in _JWT.finditer(text) if "eyJ" in text else ():
        out.append((m.start(), m.end(), m[0]))
    for m in _CLOUD.finditer(text) if any(x in text for x in ("AKIA", "ASIA", "AGPA", "AIDA", "AROA")) else ():
        line = m.end()
        for _ in range(3):  # its own line and the two after it
            line = text.find("\n", line) + 1 or len(text)
        for p in _PAIR.finditer(text, m.end(), line):
            if re.search(r"[a-z]", p[0]) and re.search(r"[A-Z]", p[0]):
                out.append((p.start(), p.end(), p[0]))
                break
    for m in _NOTE.finditer(text) if "credential" in low or "login" in low or "passw" in low else ():
        if plausible(m[1]):
            out.append((m.start(1), m.end(1), m[1]))
    for m in _SHAPED.finditer(text):
        if not _WORDS.fullmatch(re.split(r"[-_.]", m[0])[-1]) and plausible(m[0]):
            out.append((m.start(), m.end(), m[0]))
    return out


def _hash(value: str) -> int:
    return xxhash.xxh64_intdigest(value) - (1 << 63)


def patterns(text: str) -> list[tuple[str, str, tuple[int, ...]]]:
    """(value, pattern, marks) of each credential that a context shows: what to search for, and the parts of it to cover.

    marks holds starts and ends within the pattern, one after another. The pattern of a value in pieces goes from its first
    piece to its last, and a value below eight characters is searched with the characters beside it.
    """
    out, at = [], 0
    found = spans(text)
    while at < len(found):
        end = at + 1
        while end < len(found) and found[end][2] == found[at][2] and found[end][0] >= found[end - 1][1] and "\n" not in text[found[end - 1][1] : found[end][0]] and found[at][2] != text[found[at][0] : found[at][1]]:
            end += 1
        first, last, value = found[at][0], found[end - 1][1], found[at][2]
        lead = 1 if last - first < 8 and first else 0
        trail = 1 if last - first < 8 and last < len(text) else 0
        marks = tuple(x - first + lead for s, e, _ in found[at:end] for x in (s, e))
        if last - first + lead + trail >= 8:
            out.append((value, text[first - lead : last + trail], marks))
        at = end
    return out


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("owner", pa.string()), ("h", pa.int64()), ("pattern", pa.string()), ("marks", pa.list_(pa.int32()))])
    for batch in batches:
        out: list[tuple] = []
        seen: set[tuple[str | None, int]] = set()
        for owner, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py()
            if not text:
                continue
            for value, pattern, marks in patterns(text):
                out.append((owner, _hash(value), pattern, marks))
            if owner is not None:
                seen.update((owner, _hash(x)) for x in set(_LITERAL.findall(text)))
        out.extend((owner, h, None, None) for owner, h in seen)
        cols = list(zip(*out)) or [[]] * 4
        yield pa.record_batch([pa.array(c, t.type) for c, t in zip(cols, schema)], schema=schema)


def _edge(text: str, at: int) -> bool:
    return not (0 <= at < len(text)) or not text[at].isalnum()


def automaton(wanted: list[tuple[str, tuple[int, ...]]]) -> ahocorasick.Automaton:
    """The search for (pattern, marks): each word's value is the patterns that end with it."""
    tails: dict[str, list[tuple[str, tuple[int, ...]]]] = {}
    for pattern, marks in wanted:
        tails.setdefault(pattern[-TAIL:], []).append((pattern, tuple(marks)))
    a = ahocorasick.Automaton()
    for tail, ones in tails.items():
        a.add_word(tail, ones)
    a.make_automaton()
    return a


def locate(text: str, a: ahocorasick.Automaton) -> list[tuple[int, int, tuple[int, ...]]]:
    """(start, end, marks) of the patterns' places in the text that no letter or digit continues, without overlaps, the longest first."""
    found = []
    for end, ones in a.iter(text) if len(a) else ():
        for pattern, marks in ones:
            s, e = end + 1 - len(pattern), end + 1
            if s >= 0 and (len(pattern) <= TAIL or text.startswith(pattern, s)):
                if (_edge(text, s - 1) or not text[s].isalnum()) and (_edge(text, e) or not text[e - 1].isalnum()):
                    found.append((s, e, marks))
    out: list[tuple[int, int, tuple[int, ...]]] = []
    for s, e, marks in sorted(found, key=lambda x: (x[0], -x[1])):
        if not out or s >= out[-1][1]:
            out.append((s, e, marks))
    return out


def mask(text: str, places: list[tuple[int, int]], fill: str = "*") -> str:
    """The text with each place covered, character by character but for line ends, so that no other position moves."""
    parts, last = [], 0
    for s, e in places:
        parts += [text[last:s], re.sub(r"[^\r\n]", fill, text[s:e])]
        last = e
    return "".join(parts) + text[last:]


def _masked(text: str, a: ahocorasick.Automaton) -> tuple[list[int], str] | None:
    places = locate(text, a)
    if not places:
        return None
    lines, at, line, covered = [], 0, 1, []
    for s, _, marks in places:
        first = s + marks[0]
        line += text.count("\n", at, first)
        at = first
        lines.append(line)
        covered += [(s + x, s + y) for x, y in zip(marks[::2], marks[1::2])]
    return sorted(set(lines)), mask(text, covered)


_RESULT = pa.schema([("tbl", pa.string()), ("row_id", pa.int64()), ("lines", pa.list_(pa.int64())), ("masked", pa.string())])


def _scanned(batch: pa.RecordBatch, automata: Iterator[ahocorasick.Automaton]) -> pa.RecordBatch:
    out = []
    for i, (text, a) in enumerate(zip(batch.column(2), automata)):
        got = _masked(text.as_py(), a)
        if got:
            out.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), *got))
    cols = list(zip(*out)) or [[]] * 4
    return pa.record_batch([pa.array(c, t.type) for c, t in zip(cols, _RESULT)], schema=_RESULT)


def _anchor(pattern: str) -> bytes:
    """The eight bytes of a pattern that it is looked up by: those of most different bytes, the last of them.

    A key's last bytes may be the blanks before its closing line, which are in any text.
    """
    raw = pattern.encode()
    at = max(range(len(raw) - 7), key=lambda i: (len(set(raw[i : i + 8])), i))
    return raw[at : at + 8]


def _codes(raw: np.ndarray) -> np.ndarray:
    """All runs of eight bytes, as numbers."""
    raw = np.ascontiguousarray(raw)
    return mix(np.ndarray(max(0, len(raw) - 7), "<u8", raw, strides=(1,)).astype(np.uint64))


def _near(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of a text, code), each once, of the runs of eight bytes of texts that pass the filter."""
    texts = texts.cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    mask = np.uint64(len(table) * 64 - 1)
    passes = lambda c, bit: c[(table[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1]
    rows, codes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for start in range(int(bounds[0]), int(bounds[-1]), PART):
        code = _codes(raw[start : min(start + PART + 7, int(bounds[-1]))])
        at = passes(np.arange(len(code)), code & mask) if len(code) else np.zeros(0, np.int64)
        at = passes(at, (code[at] >> np.uint64(32)) & mask)
        row = np.searchsorted(bounds, at + start, "right") - 1
        inside = at + start + 8 <= bounds[row + 1]
        rows.append(row[inside])
        codes.append(code[at[inside]])
    row, code = np.concatenate(rows), np.concatenate(codes)
    order = np.lexsort((code, row))
    row, code = row[order], code[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
    return row[first], code[first]


def _filter(codes: DataFrame, n: int) -> np.ndarray:
    """The bits of a filter of n codes, two a code, as words: 64 bits a code or 2^FILTER_BITS, 2^MOST_BITS at most."""
    bits = min(MOST_BITS, max(FILTER_BITS, (64 * n).bit_length()))
    bit = F.explode(F.array(F.col("code"), F.expr("shiftrightunsigned(code, 32)"))).alias("bit")
    low = codes.select(bit).select(F.col("bit").bitwiseAND((1 << bits) - 1).alias("bit"))
    words = low.groupBy(F.shiftright("bit", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("b")).toArrow()
    table = np.zeros(1 << (bits - 6), np.int64)
    table[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return table.view(np.uint64)


def _joined(rows: DataFrame, sure: DataFrame) -> DataFrame:
    """The re-scan for any number of confirmed values: texts and values meet by eight bytes of a value (_anchor).

    Every run of eight bytes of every text is tried against a filter; those that pass are joined with the values, by the
    text's key alone. Of the texts themselves only those that may hold a value are moved to where its values are.
    """
    context = rows.sparkSession.sparkContext

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = _codes(np.frombuffer(b"".join(map(_anchor, batch.column(0).to_pylist())), np.uint8))[::8]
            yield pa.record_batch([*batch.columns, pa.array(codes.view(np.int64))], names=["pattern", "marks", "code"])

    known, n = counted(sure.mapInArrow(coded, "pattern string, marks array<int>, code long"), "known")
    held = context.broadcast(_filter(known.select("code"), n))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, code = _near(batch.column(2), held.value)
            at = pa.array(row)
            yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), pa.array(code.view(np.int64))], names=["tbl", "row_id", "code"])

    pairs = rows.mapInArrow(near, "tbl string, row_id long, code long").join(known, "code")
    key = F.xxhash64("tbl", "row_id").alias("code")
    wanted, found = counted(pairs.groupBy("tbl", "row_id").agg(F.collect_set(F.struct("pattern", "marks")).alias("wanted")), "wanted")  # of one text
    hold = context.broadcast(_filter(wanted.select(key), found))

    def may_hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = hold.value
        mask = np.uint64(len(table) * 64 - 1)
        for batch in batches:
            code = batch.column(3).to_numpy().view(np.uint64)
            keep = np.ones(len(code), bool)
            for bit in (code & mask, (code >> np.uint64(32)) & mask):
                keep &= (table[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
            yield batch.select([0, 1, 2]).filter(pa.array(keep))

    some = rows.select("tbl", "row_id", "text", key).mapInArrow(may_hold, "tbl string, row_id long, text string")
    of = wanted.select(F.col("tbl").alias("t"), F.col("row_id").alias("r"), "wanted")
    hit = some.join(of, F.col("tbl").eqNullSafe(F.col("t")) & F.col("row_id").eqNullSafe(F.col("r"))).select("tbl", "row_id", "text", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _scanned(batch, (automaton([(w["pattern"], w["marks"]) for w in one]) for one in batch.column(3).to_pylist()))

    return hit.mapInArrow(run, "tbl string, row_id long, lines array<long>, masked string")


def find_credentials(texts: DataFrame, max_owners: int = MAX_OWNERS, owner_share: float = OWNER_SHARE) -> DataFrame:
    """(tbl, row_id, lines, masked): texts with credentials, the lines where they begin (from 1), the text with them masked.

    texts has (tbl, row_id, owner, text); only texts with a credential come out. A value that more than max_owners owners
    have, and more than owner_share of all owners, is none. NULL and empty texts have none; a NULL owner counts for no one.
    A credential over several lines counts at its first. Repeated rows come out once per row. Every text is searched for
    every confirmed value, however many there are.
    """
    index = materialize(texts.select("owner", "text").mapInArrow(_index, "owner string, h long, pattern string, marks array<int>"), "literals")
    context = index.where("pattern IS NOT NULL")
    everybody = index.agg(F.countDistinct("owner").alias("n")).first()["n"]
    owned = index.join(context.select("h").distinct(), "h", "left_semi").groupBy("h").agg(F.countDistinct("owner").alias("owners"))
    good = owned.where(F.col("owners") <= max(max_owners, owner_share * everybody)).select("h")
    sure = materialize(context.join(good, "h", "left_semi").groupBy("pattern").agg(F.min("marks").alias("marks")), "sure")
    rows = texts.where("text IS NOT NULL").select("tbl", F.col("row_id").cast("long").alias("row_id"), "text")
    if sure.count() > MAX_PATTERNS:
        return _joined(rows, sure)
    held = rows.sparkSession.sparkContext.broadcast([(r["pattern"], tuple(r["marks"])) for r in sure.collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(held.value)
        for batch in batches:
            yield _scanned(batch, (a for _ in range(batch.num_rows)))

    return rows.mapInArrow(run, "tbl string, row_id long, lines array<long>, masked string")
