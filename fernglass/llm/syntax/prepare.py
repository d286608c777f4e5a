"""What lexers of regular expressions can't see: code inside of literals, markup inside of code, words that their place reserves."""

from __future__ import annotations

import re

_REGEX = r"(?:(?<=[=(,:;!&|?{}\[])|(?<=[=(,:;!&|?{}\[] )|(?<=return ))/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
_JUMP = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'|" + _REGEX + r"|[`{}]|<(?=[A-Za-z_$>])")
_TEMPLATE = re.compile(r"\\[\s\S]|`|\$\{")
_PLAIN = re.compile(r"\s*[A-Za-z_$][\w$.]*(?:<[^`(){};]*>)?\s*\}")
_TAG = re.compile(r"\s*([A-Za-z_$][\w$.:-]*)?")
_ATTRIBUTE = re.compile(r"[A-Za-z_$][\w$.:-]*")
_BLANK = re.compile(r"(?:\s|//[^\n]*|/\*[\s\S]*?\*/)*")
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_BEFORE_MARKUP = re.compile(r"(?:[(,=?:\[{;&|!}]|=>|\breturn|\bdefault|\byield|\Aawait|\A)\s*\Z")
#: What stands for code that is wrong whatever is around it.
WRONG = "`"


class _Script:
    """A script with templates' and markup's code taken out of them: `a${b}` becomes (``+(b)), <a b={c}>{d}</a> becomes (0,(c),(d))."""

    def __init__(self, text: str, markup: bool, lines: bool = False):
        self.s, self.markup, self.lines = text, markup, lines
        self.out: list[str] = []

    def code(self, i: int, inner: bool) -> int:
        """From i to the brace that closes the part (inner), or to the end; the place after it."""
        s, depth = self.s, 0
        while True:
            m = _JUMP.search(s, i)
            if not m:
                self.out.append(s[i:])
                if inner:
                    self.out.append(WRONG)
                return len(s)
            self.out.append(s[i : m.start()])
            t, i = m[0], m.end()
            if t == "`":
                i = self.kept(self.template, i)
            elif t == "}" and inner and not depth:
                return i
            elif t == "<":
                before = s[max(0, m.start() - 24) : m.start()]
                if self.markup and _BEFORE_MARKUP.search(before) and not re.match(r"[A-Za-z_$][\w$]*\s*(?:,|extends\b|=(?!=)|>\s*\()", s[i : i + 80]):
                    i = self.kept(self.element, i)
                else:
                    self.out.append(t)
            else:
                depth += (t == "{") - (t == "}")
                self.out.append(t)

    def kept(self, read, i: int) -> int:
        """What read takes from i on; with lines, as many line ends come out as were in it."""
        first = len(self.out)
        end = read(i)
        if self.lines:
            self.out.append("\n" * max(0, self.s.count("\n", i, end) - "".join(self.out[first:]).count("\n")))
        return end

    def template(self, i: int) -> int:
        """A template behind its first quote."""
        first = len(self.out)
        self.out.append("(''")
        while True:
            m = _TEMPLATE.search(self.s, i)
            if not m:
                self.out.append(WRONG)
                return len(self.s)
            i = m.end()
            if m[0] == "`":
                if len(self.out) == first + 1:
                    self.out[first] = "''"
                else:
                    self.out.append(")")
                return i
            if m[0] == "${" and (name := _PLAIN.match(self.s, i)):
                i = name.end()  # a name, or a type in a type, can't be wrong
            elif m[0] == "${":
                self.out.append("+(")
                i = self.code(i, True)
                self.out.append(")")

    def element(self, i: int) -> int:
        """Markup behind its <; what is wrong in it is left as WRONG."""
        s = self.s
        self.out.append("(0")
        m = _TAG.match(s, i)
        name, i = m[1] or "", m.end()
        while True:
            i = _BLANK.match(s, i).end()
            if s.startswith("/>", i):
                self.out.append(")")
                return i + 2
            if s.startswith(">", i):
                i += 1
                break
            if s.startswith("{", i):
                i = _BLANK.match(s, i + 1).end()
                if not s.startswith("...", i):
                    self.out.append(WRONG)
                else:
                    i += 3
                i = self.part(i)
                continue
            m = _ATTRIBUTE.match(s, i)
            if not m or not name:
                self.out.append(WRONG + ")")
                return i
            i = _BLANK.match(s, m.end()).end()
            if s.startswith("=", i):
                i = _BLANK.match(s, i + 1).end()
                q = _QUOTED.match(s, i)
                if q:
                    i = q.end()
                elif s.startswith("{", i):
                    i = self.part(i + 1)
                elif s.startswith("<", i):
                    self.out.append(",")
                    i = self.element(i + 1)
                else:
                    self.out.append(WRONG)
        while True:
            m = re.compile(r"[<{]").search(s, i)
            if not m:
                self.out.append(WRONG + ")")
                return len(s)
            i = m.end()
            if m[0] == "{":
                end = _BLANK.match(s, i).end()
                i = end + 1 if s.startswith("}", end) else self.part(end + 3 if s.startswith("...", end) else end)
            elif s.startswith("/", i):
                m = _TAG.match(s, i + 1)
                i = _BLANK.match(s, m.end()).end()
                if (m[1] or "") != name or not s.startswith(">", i):
                    self.out.append(WRONG)
                    i -= 1
                self.out.append(")")
                return i + 1
            else:
                self.out.append(",")
                i = self.element(i)

    def part(self, i: int) -> int:
        """An expression in braces, from behind the first one."""
        self.out.append(",(")
        i = self.code(i, True)
        self.out.append(")")
        return i


def script(text: str, markup: bool, lines: bool = False) -> str:
    """JavaScript or TypeScript without substitutions in templates and, with markup, without elements; with lines, on its lines."""
    if text.startswith("#!"):
        text = "//" + text
    marked = markup and ("/>" in text or "</" in text)
    if not marked and ("`" not in text or "${" not in text):
        return text
    x = _Script(text, marked, lines)
    x.code(0, False)
    return "".join(x.out)


_PY_JUMP = re.compile(r"#[^\n]*|(?<![\w])([rRbBuUfF]{0,2})(\"\"\"|'''|\"|')")
_F_PART = re.compile(r"\{\{|\}\}|\\[\s\S]|[{}]|\n")
_PY_INNER = re.compile(r"(?<![\w])([rRbBuUfF]{0,2})(\"\"\"|'''|\"|')|[()\[\]{}]|!=|[!:]|#")


def _string_end(s: str, i: int, quote: str) -> int:
    """The place after a plain string from behind its first quote, or -1."""
    while True:
        m = re.compile(r"\\[\s\S]|" + quote + ("" if len(quote) == 3 else r"|\n")).search(s, i)
        if not m or m[0] == "\n":
            return -1
        i = m.end()
        if m[0] == quote:
            return i


def _f_string(s: str, i: int, quote: str, raw: bool, parts: list[str], spec: bool = False) -> int:
    """The place after an f-string (or a format, up to its brace) from behind its first quote, or -1; its expressions go to parts."""
    while i < len(s):
        if not spec and s.startswith(quote, i):
            return i + len(quote)
        if spec and s[i] == "}":
            return i
        m = _F_PART.match(s, i)
        if not m:
            i += 1
            continue
        t = m[0]
        if t == "\n" and len(quote) == 1 or t == "}":
            return -1
        if t[0] == "\\" and raw:
            i += 1
            continue
        if t == "{":
            i = _f_value(s, i + 1, quote, raw, parts)
            if i < 0:
                return -1
            continue
        i = m.end()
    return -1


def _f_value(s: str, i: int, quote: str, raw: bool, parts: list[str]) -> int:
    """The place after a replacement field from behind its brace, or -1."""
    start, depth = i, 0
    while True:
        m = _PY_INNER.search(s, i)
        if not m:
            return -1
        t = m[0]
        if m[2]:
            end = _f_string(s, m.end(), m[2], "r" in m[1].lower(), parts) if "f" in m[1].lower() else _string_end(s, m.end(), m[2])
            if end < 0:
                return -1
            i = end
            continue
        if t == "#":
            return -1
        if t in ("(", "[", "{"):
            depth += 1
        elif depth and t in (")", "]", "}"):
            depth -= 1
        elif not depth and t in ("}", "!", ":"):
            value = s[start : m.start()].strip()
            if value.endswith("=") and not value.endswith(("==", "!=", "<=", ">=")):
                value = value[:-1]
            parts.append(value)
            i = m.end()
            if t == "!":
                c = re.compile(r"[rsa]\s*(?=[:}])").match(s, i)
                if not c:
                    return -1
                i, t = c.end() + 1, s[c.end()]
            if t == ":":
                i = _f_string(s, i, quote, raw, parts, spec=True)
                if i < 0:
                    return -1
                i += 1
            return i
        elif t in (")", "]"):
            return -1
        i = m.end()


def f_strings(text: str) -> tuple[str, list[str]]:
    """Python with f-strings as plain ones, and the expressions that stood in them; what is wrong in one is left as ? ."""
    out, parts, i = [], [], 0
    while True:
        m = _PY_JUMP.search(text, i)
        if not m:
            out.append(text[i:])
            return "".join(out), parts
        if not m[2]:
            out.append(text[i : m.end()])
            i = m.end()
            continue
        formatted = "f" in m[1].lower()
        end = _f_string(text, m.end(), m[2], "r" in m[1].lower(), parts) if formatted else _string_end(text, m.end(), m[2])
        if end < 0:  # left to the lexer, or wrong in itself
            if formatted:
                out.append(text[i : m.start()] + "?")
            else:
                out.append(text[i : m.end()])
            i = m.end()
            continue
        out.append(text[i : m.start()] + "''" if formatted else text[i:end])
        i = end


_SOFT = {"java": {"record", "sealed", "permits", "yield", "when"}, "ts": {"infer", "asserts", "override", "unique", "module", "global", "target"}, "js": {"target"}}
_JAVA_DECLARES = {"class", "interface", "abstract", "public", "private", "protected", "static", "strictfp", "final"}


def _is_name(t: str) -> bool:
    return t[:1].isalpha() or t[:1] in "_$"


def softened(language: str, tokens: list[str]) -> list[str]:
    """The tokens with words that only their place reserves as what they are there."""
    if _SOFT.get(language, set()).isdisjoint(tokens):
        return tokens
    out = list(tokens)
    at = [i for i, t in enumerate(tokens) if not t.isspace() and not t.startswith(("//", "/*"))]
    tok = [tokens[i] for i in at] + [""] * 3
    case = False
    for k in range(len(at)):
        t, before, after = tok[k], tok[k - 1] if k else "", tok[k + 1]
        new = None
        if language == "java":
            if t == "case":
                case = True
            elif t in (";", "{", "}", "->"):
                case = False
            if t == "record" and before != "." and _is_name(after) and tok[k + 2] in ("(", "<"):
                new = "@record"
            elif t == "sealed" and after in _JAVA_DECLARES:
                new = "final"
                if before == "-" and k > 1 and tok[k - 2] == "non":
                    out[at[k - 1]] = out[at[k - 2]] = " "
            elif t == "permits" and (_is_name(before) or before == ">") and _is_name(after):
                new = "@permits"
            elif t == "yield" and before in (";", "{", "}", "->", ":", ")", "else") and (after not in ("=", ".", "(", ")", ";", ",", "++", "--", "[", "::", "+=", "-=") or after == "("):
                new = "return"
            elif t == "when" and case and (_is_name(before) or before == ")"):
                new = "@when"
        elif t == "target" and before == "." and k > 1 and tok[k - 2] == "new":
            out[at[k - 1]] = out[at[k - 2]] = " "
        elif language == "ts":
            if t == "infer" and _is_name(after) and before not in (".", ":") or t == "infer" and before == ":" and _is_name(after):
                new = "keyof"
            elif t == "asserts" and _is_name(after) and after != "is" and before == ":":
                new = " "
            elif t == "override" and before in ("{", "}", ";", "public", "protected", "private", "static", "readonly", "abstract", ")") and (_is_name(after) or after in ("[", "*") or after[:1] in "\"'#"):
                new = "public"
            elif t == "unique" and after == "symbol":
                new = " "
            elif t == "module" and before in ("", ";", "}", "declare", "export", ")") and (after[:1] in "\"'" and after or _is_name(after)) and tok[k + 2] in ("{", ".", ";"):
                new = "namespace"
            elif t == "global" and before == "declare" and after == "{":
                new = "namespace global"
        if new is not None:
            out[at[k]] = new
    if "namespace global" in out:
        i = out.index("namespace global")
        out[i : i + 1] = ["namespace", "global"]
    return out
