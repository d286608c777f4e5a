"""The least repair of a source text: brackets are reduced from within, unit by unit, each shape parsed once by the chart."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

from fernglass.llm.syntax import languages as L
from fernglass.llm.syntax.chart import BIG, Grammar
from fernglass.llm.syntax.prepare import f_strings, script, softened

#: Longer units are tried whole by a recogniser, which is exact; those that are no valid unit are shortened, and repaired
#: in pieces if they stay longer.
LONGEST = 56
_KINDS = {"(": L.GROUPS, "[": L.GROUPS + 0x4000, "{": L.GROUPS + 0x8000}
_FIRST_BRACE = chr(L.GROUPS + 0x8000)
_BRACE = f"[{chr(L.GROUPS + 0x8000)}-{chr(L.GROUPS + 0xBFFF)}]"
_OTHER = f"{chr(L.GROUPS)}-{chr(L.GROUPS + 0x7FFF)}"
_INNER = re.compile(r"\(([^()\[\]{}]*)\)|\[([^()\[\]{}]*)\]|\{([^()\[\]{}]*)\}")
#: Equal items of a list, beyond two, and of a header or list with semicolons, beyond three: no grammar counts further.
_AGAIN = re.compile(r"([^,;\n]{1,40},)\1\1+")
_UNITS = re.compile(r"([^,;\n]{1,40};)\1\1\1+")
#: Leading operands of a list, which only the pieces of invalid units go without.
_LISTED = re.compile(r"(?<![^,])(?:-?[nsi],)+(?=-?[nsi],)")
PIECE = 14
#: What is learnt is forgotten beyond these counts, between two texts; characters for groups end at 16,384.
MOST_SHAPES, MOST_PROFILES = 300_000, 12_000
#: Characters from here on are line starts of Python, with the indentation.
INDENT = 0xE0000
_LINE = re.compile(f"[{chr(INDENT)}-{chr(INDENT + 0xFFFF)}]")
#: Characters before a word of Python that may be reserved at the start of a line.
_SOFT = {"match": "\ue001", "case": "\ue002", "type": "\ue003"}
_MARKS = re.compile(f"[{chr(INDENT)}-{chr(INDENT + 0xFFFF)}{''.join(_SOFT.values())}]")
#: Characters that stand at the start of each line where places are asked for.
_AT = 0x100000
_PLACES = re.compile(f"[{chr(_AT)}-{chr(_AT + 0xFFFD)}]")
_F_STRING = re.compile(r"(?<!\w)(?:[fF][rR]?|[rR][fF])[\"']")
_MODULE = re.compile(r"(?:import [\w.*]+; ?|@\w+ )*(?:open )?module [\w.]+ \{ ?((?:(?:requires|exports|opens|uses|provides)( [\w.]+)+(?: ?, ?[\w.]+)* ?; ?)*)\}")


def _collapsed(shape: str) -> str:
    """The shape with fewer equal items in a row: no kind of item goes, so it is valid if and only if it was."""
    return _UNITS.sub(r"\1\1\1", _AGAIN.sub(r"\1\1", shape))


class Repairer:
    """Least repairs for one language; what it learns about shapes is kept."""

    def __init__(self, language: str):
        self.language = language
        self.tokens = L.Tokens(language)
        self.grammar = Grammar(L.GRAMMARS[language], self.tokens.chars)
        self.lists = L.LISTS[language]
        self.only_whether = False
        self.noted: set[int] | None = None
        self.shapes: dict[str, np.ndarray] = {}
        self.valid: dict[str, frozenset[int]] = {}
        self.edits = 0.0
        self.contents: dict[str, tuple[str, float]] = {}
        self.profiles: dict[tuple, str] = {}
        self.groups: dict[str, tuple[str, dict[str, float]]] = {}
        w = self.tokens.words
        if language in ("js", "ts"):
            after = "".join(w[k] for k in ("else", "catch", "finally", "from", "as", "of", "in", *(("satisfies",) if language == "ts" else ()))) + ".,)=?:o*<>A~;-"
        elif language == "java":
            after = "".join(w[k] for k in ("else", "catch", "finally")) + ".,);:?o*-<>"
        else:
            after = ""
        more = rf"|;(?=\n*{w['else']})" if "else" in w else ""
        last = rf"(?!\n*{w['else']})" if "else" in w else ""
        self.unit = re.compile(rf"(?:[^;]{more})*?(?:;{last}|{_BRACE}(?![{re.escape(after)}{_OTHER}]|\Z)|\Z)") if language in ("js", "ts", "java") else re.compile(r"[^;]*(?:;|\Z)")
        self.after = {w[k]: rules for k, rules in (("if", ("expr", "seq")), ("while", ("expr", "seq")), ("switch", ("expr", "seq")), ("for", ("forhead",)), ("catch", ("catchp",))) if k in w}
        self.controls = {w[k] for k in ("else", "try", "finally", "do") if k in w}
        self.bodies = {w[k] for k in ("interface", "struct", "switch", "select") if k in w}
        self.switches = {w[k] for k in ("switch", "select") if k in w and language == "go"}
        self.function = w["function"] if language in ("js", "ts") else ""
        self.labels = {"", *(w[k] for k in ("case", "default") if k in w)}
        self.openers = "".join(w[k] for k in ("do", "for", "if", "switch") if k in w)
        self.ends = "insp)]}" + "".join(w[k] for k in ("break", "continue", "fallthrough", "return")) if language == "go" else ""
        words = "".join(sorted({c for c in w.values() if ord(c) >= L.WORDS}))
        self.member = re.compile(rf"\.[{words}]") if words else None

    # shapes

    def vector(self, shape: str) -> np.ndarray:
        """The costs of a shape without brackets as each symbol of the grammar."""
        v = self.shapes.get(shape)
        if v is None:
            short = _collapsed(shape)
            if len(short) > LONGEST:
                v = self.shapes[shape] = self._long(self._essential(short))
                return v
            short = self._essential(short)
            if short in self.shapes:
                v = self.shapes[shape] = self.shapes[short]
                return v
            v = self.grammar.costs([self.groups.get(c, c) for c in short])
            self.shapes[shape] = self.shapes[short] = v
        return v

    def derived(self, shape: str) -> frozenset[int]:
        """The symbols that a shape without brackets is valid as."""
        return self.grammar.derived([self.groups.get(c, c) for c in shape])

    def _long(self, shape: str) -> np.ndarray:
        """As vector, for a shape longer than LONGEST: 0 is exact, any other cost an upper bound."""
        v = self.shapes.get(shape)
        if v is None:
            short = self._essential(self._shortened(shape))
            pieces = [short] if len(short) <= LONGEST else [short[i : i + PIECE] for i in range(0, len(short), PIECE)]
            v = np.clip(sum(self.vector(p).astype(int) for p in pieces), 1, BIG).astype(np.int16)
            v[list(self.derived(shape))] = 0
            self.shapes[shape] = v
        return v

    def _essential(self, shape: str) -> str:
        """The shape with groups told apart only by what can matter after the token before them: fewer kinds, the same costs."""
        out = []
        for i, c in enumerate(shape):
            g = self.groups.get(c)
            if g and i:
                before, keep = shape[i - 1], ()
                if g[0] == "(":
                    keep = ("args", "params", "rparams") if before == "i" or before in self.groups else self.after.get(before, ())
                elif g[0] == "{":
                    control = before in self.controls or i > 1 and before in self.groups and self.groups[before][0] == "(" and shape[i - 2] in self.after
                    keep = ("cases",) if i > 1 and shape[i - 2] == self.tokens.words.get("switch") else ("stmts", "elems", "cases") if not self.switches.isdisjoint(shape[:i]) else ("stmts",) if control else ("stmts", "elems") if self.language == "go" and before not in self.bodies else ()
                costs = {r: x for r, x in g[1].items() if r in keep}
                if 0 in costs.values():
                    c = self._character(g[0], costs)
            out.append(c)
        return "".join(out)

    def _character(self, bracket: str, costs: dict[str, float]) -> str:
        """The character of groups with these costs by rule."""
        key = (bracket, tuple(sorted(costs.items())))
        c = self.profiles.get(key)
        if c is None:
            c = self.profiles[key] = chr(_KINDS[bracket] + len(self.profiles) % 0x4000)
            self.groups[c] = (bracket, costs)
        return c

    @staticmethod
    def _shortened(s: str) -> str:
        """An invalid shape with operands joined that any expression may be made of; it may come out valid."""
        old = ""
        while old != s and len(s) > LONGEST:
            old = s
            s = re.sub(r"([insp])\.i", r"i", s)
            s = re.sub(r"(?<![.i])[ins][o\-][ins](?![.])", "i", s)
            s = re.sub(r",i=[ins](?=,)", "", s)
            s = _collapsed(_LISTED.sub("", s))
        return s

    def zero(self, shape: str) -> frozenset[int]:
        """The symbols that a shape without brackets is valid as; what is learnt is kept."""
        got = self.valid.get(shape)
        if got is None:
            short = self._essential(_collapsed(shape))
            got = self.valid.get(short)
            if got is None:
                got = self.valid[short] = self.derived(short)
            self.valid[shape] = got
        return got

    def cost(self, shape: str, rule: str) -> float:
        if not shape:
            return float(self.grammar.make[self.grammar.index[rule]])
        if self.grammar.index[rule] in self.zero(shape):
            return 0.0
        if self.only_whether:
            return 1.0
        return self._repaired(shape, rule)

    def _repaired(self, shape: str, rule: str, most: float = BIG) -> float:
        """The cost of an invalid shape; of a list that is longer than LONGEST or holds equal items in a row, of those items
        that are not valid, each by itself.

        Where more than most items fail, their number is enough to know.
        """
        items, short = shape.split(","), _collapsed(shape)
        if len(items) > 2 and (len(short) > LONGEST or short != shape):
            items = items if items[-1] else items[:-1]
            failing = [x for x in items if not x or not self._valid(x, rule)]
            if len(failing) > most:
                return float(len(failing))
            if failing and self._valid(",".join(x for x in items if x and self._valid(x, rule)), rule):
                return sum(max(1.0, self.cost(x, rule)) if x else 1.0 for x in failing)
            return max(float(len(failing)), float(self.vector(shape)[self.grammar.index[rule]]))  # equal items are one there
        return float(self.vector(shape)[self.grammar.index[rule]])

    def units(self, text: str, rule: str) -> float:
        """The cost of a list of units: of those that are not valid, each repaired by itself."""
        failing = self._failing(text, rule)
        return float(len(failing)) if self.only_whether else sum(max(1.0, self.cost(x, rule)) for x in failing)

    def _valid(self, shape: str, rule: str) -> bool:
        return self.grammar.index[rule] in (self.zero(shape) if shape else self.grammar.nullable)

    def _failing(self, text: str, rule: str) -> list[str]:
        """The units of a list that are not valid, not even together with those after them."""
        out: list[str] = []
        wait, mark, parts = "", 0, 0
        for u in self.unit.findall(text):
            bare = u.replace("\n", "")
            if not bare:
                continue
            nameless = bare[0] == self.function and bare[1:2] in self.groups and self.groups[bare[1]][0] == "(" and rule != "member"
            fits = not nameless and self._valid(bare, rule)
            if wait and self._valid(wait + bare, rule):
                del out[mark:]  # such as do ... while (...), or for a; b; c
                wait = ""
                continue
            fits = fits or bare.endswith(";") and bare[-2:-1] >= _FIRST_BRACE and self._valid(bare[:-1], rule)
            if not fits and self.language in ("js", "ts") and "\n" in u:
                runs = self._runs(u, rule)
                fits = not runs
                tail = u.rstrip("\n").rpartition("\n")[2]
                if runs and tail and tail[0] in self.openers:
                    out += runs
                    wait, mark, parts = tail, len(out) - (runs[-1] == tail), 1
                    continue
                out += runs
            elif not fits:
                out.append(bare)
            if wait and parts < 2:
                wait, parts = wait + bare, parts + 1
            elif not fits and any(x in self.openers for x in bare[:3]):
                wait, mark, parts = bare, len(out) - 1, 1
            else:
                wait = ""
        return out

    def _runs(self, unit: str, rule: str) -> list[str]:
        """What is not valid of a unit whose statements may end at line ends: lines alone where they are, runs of others joined."""
        out, run = [], ""
        for line in (*filter(None, unit.split("\n")), ""):
            if line and not self._valid(line, rule):
                run += line
                continue
            if run and not self._valid(run, rule):
                out.append(run)
            run = ""
        return out

    def _list(self, text: str, rule: str) -> float:
        """The cost of what braces hold, as a list of units."""
        if rule == "enums":  # constants, then members
            head, semi, members = text.partition(";")
            return self.cost(_collapsed(head.replace("\n", "")) + semi, "enums") + self.units(members, "member")
        cost = self.units(text, self.lists[rule])
        return cost + 1 if rule == "cases" and text.strip("\n")[:1] not in self.labels else cost

    # brackets

    def group(self, m: re.Match) -> str:
        """The character of a bracketed part without brackets inside; where it has to be repaired, its lines are noted."""
        whole = m[0]
        if self.noted is not None:
            before = self.edits
            clean = _PLACES.sub("", whole)
            c = self.group_of(clean)
            if self.edits > before:
                start = next((ord(x) - _AT for x in reversed(m.string[: m.start()]) if ord(x) >= _AT), 1)
                rule = next((r for r, x in self.groups[c][1].items() if not x and r in self.lists), None)
                self._note(whole[1:-1], start, self._failing(clean[1:-1], self.lists[rule]) if rule else None)
            return c
        return self.group_of(whole)

    def _note(self, marked: str, start: int, failing: list[str] | None) -> None:
        """Notes the first lines of failing units of a text with its lines, or of its start if they can't be found in it."""
        clean, lines, now = [], [], start
        for x in marked:
            if ord(x) >= _AT:
                now = ord(x) - _AT
            elif x != "\n":
                clean.append(x)
                lines.append(now)
        text = "".join(clean)
        for unit in failing or [""]:
            at = text.find(unit) if unit else -1
            self.noted.add(lines[at] if 0 <= at < len(lines) else start)

    def places(self, text: str, markup: bool = True) -> list[int]:
        """The lines (from 1, up to 65,533) where a text has to be edited: of left brackets, and where units that fail begin."""
        self.noted, self.edits = set(), 0.0
        try:
            if self.language == "py":
                self._python(text)
            else:
                if self.language in ("js", "ts"):
                    text = script(text, markup, True)
                lexed = softened(self.language, L.LEXER[self.language].findall(text))
                out, line, before = [chr(_AT + 1)], 1, ""
                for t in lexed:
                    c = self.tokens[t]
                    ends = t.count("\n")
                    if c == "\n" and self.language == "go":
                        c = ";" if before and before in self.ends else ""
                    elif c == "\n" and self.language == "java":
                        c = ""
                    out.append(c)
                    before = c or before
                    if ends:
                        line += ends
                        out.append(chr(_AT + min(line, 0xFFFD)))
                shape = "".join(out)
                if self.language == "java":
                    shape = re.sub(r"@i(?:\.i)*(\([^()]*\))?", "", shape)
                elif self.language != "go":
                    shape = self.member.sub(".i", shape)
                shape, left, _ = self.reduced(shape)
                self._note(shape, 1, failing) if (failing := self._failing(_PLACES.sub("", shape), "top")) else None
            return sorted(self.noted)
        finally:
            self.noted = None

    def closers(self, text: str) -> str:
        """The brackets that close what is open at the end of a text."""
        stack: list[str] = []
        for t in L.LEXER[self.language].findall(text):
            if t in ("(", "[", "{"):
                stack.append({"(": ")", "[": "]", "{": "}"}[t])
            elif stack and t == stack[-1]:
                stack.pop()
        return "".join(reversed(stack))

    def group_of(self, whole: str) -> str:
        """The character of a bracketed part, its edits being counted."""
        known = self.contents.get(whole)
        if known is not None:
            self.edits += known[1]
            return known[0]
        bracket, text = whole[0], whole[1:-1]
        if self.language == "py":
            text = _MARKS.sub("", text)
        wanted = [w[1:-1] for w, _ in self.grammar.groups[bracket]]
        costs: dict[str, float] = {}
        if bracket == "{":
            # first whether it fits a rule, without repair: then no other one need be repaired
            own = [r for r in wanted if r in self.lists or r == "enums" and self.language == "java"]
            before, self.only_whether = self.only_whether, True
            costs = {r: self._list(text, r) for r in own}
            self.only_whether = before
            bare = _collapsed(text.replace("\n", ""))
            fits = frozenset() if ";" in bare else self.zero(bare) if bare else self.grammar.nullable  # only lists of units hold ;
            costs.update((r, 0.0) for r in wanted if r not in costs and self.grammar.index[r] in fits)
            if 0 in costs.values():
                costs = {r: 0.0 if costs.get(r) == 0 else 1.0 for r in wanted}
            else:
                costs = {r: self._list(text, r) for r in own}
        rest = [r for r in wanted if r not in costs]
        if rest:
            bare = text.replace("\n", "")
            ends = float(bare.count(";")) if bracket == "{" else 0.0  # each would have to go if the content were no list of units
            if costs and min(costs.values()) < ends:
                costs.update(dict.fromkeys(rest, ends))
            else:
                fits = {r for r in rest if self._valid(_collapsed(bare), r)}
                if fits or 0 in costs.values():
                    costs.update((r, 0.0 if r in fits else 1.0) for r in rest)
                else:
                    for r in rest:
                        costs[r] = max(ends, self._repaired(bare, r, min(costs.values(), default=BIG)))
        # its own edits are counted here; around it it is what it fits best, and anything else at one edit more: so what
        # holds a broken part is not repaired again, and there are few kinds of groups, hence few shapes
        least = min(costs.values(), default=0.0)
        self.edits += least
        c = self._character(bracket, {r: 0.0 if x == least else 1.0 for r, x in costs.items()})
        if len(whole) < 600 and len(self.contents) < 300_000:
            self.contents[whole] = c, least
        return c

    def reduced(self, s: str) -> tuple[str, int, int]:
        """(the text with all matched brackets reduced, brackets left over, those of them that open)."""
        while True:
            t, n = _INNER.subn(self.group, s)
            if not n:
                break
            s = t
        left = sum(s.count(b) for b in "()[]{}")
        if left and self.noted is not None:
            now = 1
            for x in s:
                if ord(x) >= _AT:
                    now = ord(x) - _AT
                elif x in "()[]{}":
                    self.noted.add(now)
        opened = sum(s.count(b) for b in "([{")
        return (re.sub(r"[()\[\]{}]", "", s) if left else s), left, opened

    def repair(self, text: str, markup: bool = True) -> tuple[float, bool]:
        """(least number of edits found, whether brackets are open at the end); 0 if and only if the text is valid.

        markup tells whether scripts may hold elements.
        """
        if len(self.shapes) > MOST_SHAPES or len(self.profiles) > MOST_PROFILES:
            for learnt in (self.shapes, self.valid, self.contents, self.profiles, self.groups):
                learnt.clear()
            type(self)._statement.cache_clear()
        self.edits = 0.0
        if self.language == "py":
            return self._python(text)
        if self.language in ("js", "ts"):
            text = script(text, markup)
        lexed = softened(self.language, L.LEXER[self.language].findall(text))
        if self.language == "java" and "module" in text and _MODULE.fullmatch(re.sub(r"\s+", " ", re.sub(r"//[^\n]*|/\*[\s\S]*?\*/", " ", text)).strip()):
            return 0.0, False
        shape = "".join(map(self.tokens.__getitem__, lexed))
        if self.language == "go":
            shape = re.sub(rf"([{re.escape(self.ends)}])\n+", r"\1;", shape + "\n").replace("\n", "")
        elif self.language == "java":
            shape = re.sub(r"@i(?:\.i)*(\([^()]*\))?", "", shape.replace("\n", ""))
        else:
            shape = self.member.sub(".i", shape)
            shape = re.sub(r"\n+", "\n", shape)
        shape, left, opened = self.reduced(shape)
        self.only_whether = True
        cost = self.units(shape, "top")
        self.only_whether = False
        if cost:
            cost = self.units(shape, "top")
        return left + self.edits + cost + self._order(shape), opened > 0

    def _order(self, shape: str) -> float:
        """Go begins with its package clause, before imports and these before all else."""
        if self.language != "go":
            return 0.0
        w = self.tokens.words
        s = re.sub(r"^;+", "", shape)
        if not s.startswith(w["package"]) or s.count(w["package"]) > 1:
            return 1.0
        body = re.search(f"(?:^|;)[{w['func']}{w['var']}{w['const']}{w['type']}]", s)
        return 1.0 if body and w["import"] in s[body.start() :] else 0.0

    # Python

    def _python(self, text: str) -> tuple[float, bool]:
        parts: list[str] = []
        if _F_STRING.search(text):
            text, parts = f_strings(text)
        text = "".join((text, *(f"\n({p}\n)" for p in parts)))
        lexed = L.LEXER["py"].findall(text.lstrip("﻿"))
        out, fresh, width = [chr(INDENT)], True, 0
        get = self.tokens.__getitem__
        row = 1
        case = drop = False  # in a line that begins with case names are bound by as, which no grammar of values has
        for t in lexed:
            if drop:
                drop = bool(t.isspace())
                continue
            if case and t == "as":
                drop = True
                continue
            if t == "\n":
                row += 1
                fresh, width = True, 0
            elif fresh and t[0] in " \t\f":
                for ch in t:
                    width = width + 1 if ch == " " else (width // 8 + 1) * 8 if ch == "\t" else 0
            else:
                c = get(t)
                if c:
                    if fresh and self.noted is not None:
                        out.append(chr(_AT + min(row, 0xFFFD)))
                    if fresh:
                        out.append(chr(INDENT + min(width, 0xFFFF)))
                        fresh, case = False, t == "case"
                        if t in _SOFT:
                            out.append(_SOFT[t])
                    out.append(c)
                row += t.count("\n")
        shape, left, opened = self.reduced("".join(out))
        if self.noted is not None:
            rows = [ord(x) - _AT for x in _PLACES.findall(shape)]
            marked = re.split(f"({_LINE.pattern})", re.sub(f"({_PLACES.pattern})({_LINE.pattern})", r"\2\1", shape))
            lines = [(ord(a) - INDENT, _PLACES.sub("", b), next(map(ord, _PLACES.findall(b)), _AT + 1) - _AT) for a, b in zip(marked[1::2], marked[2::2]) if _PLACES.sub("", b)]
            at: list[int] = []
            self._blocks([x[:2] for x in lines], at)
            self.noted.update(lines[i][2] if i < len(lines) else (rows or [1])[-1] for i in at)
            return 0.0, False
        parts = re.split(f"({_LINE.pattern})", shape)
        lines = [(ord(a) - INDENT, b) for a, b in zip(parts[1::2], parts[2::2]) if b]
        return left + self.edits + self._blocks(lines), opened > 0

    @lru_cache(maxsize=100_000)  # noqa: B019 one repairer a process
    def _statement(self, s: str) -> tuple[float, str, bool]:
        """(cost, kind, whether a block must follow) of a logical line."""
        w = self.tokens.words
        first = s[0]
        for soft, mark in _SOFT.items():
            if first == mark:
                plain = self._statement(s[1:])
                if not plain[0] and not plain[2] or len(s) < 3:
                    return plain
                hard = w["@" + soft] + s[2:]
                if soft == "type":
                    return min(plain, (self.cost(hard, "typest"), "plain", False))
                at = hard.rfind(":")
                return min(plain, (self.cost(hard[:at], soft + "head") + (self.cost(hard[at + 1 :], "line") if hard[at + 1 :] else 0), soft, not hard[at + 1 :])) if at > 0 else plain
        kinds = {w["else"]: ("else", "elsehead"), w["elif"]: ("elif", "elifhead"), w["except"]: ("except", "exhead"), w["finally"]: ("finally", "finhead")}
        compound = {w[k]: k for k in ("if", "while", "for", "def", "class", "with", "try")}
        if first == "@":
            return self.cost(s, "deco"), "deco", False
        if first in kinds or first in compound or first == w["async"]:
            kind, rule = kinds.get(first, (compound.get(first) or compound.get(s[1:2], "def"), "head"))
            # where the head ends: tried without repair, and repaired only where most of it is valid
            cuts = [i for i, c in enumerate(s) if c == ":"]
            if not cuts:
                return 1 + self.cost(s, rule), kind, True
            at = min(cuts, key=lambda i: (not self._valid(s[:i], rule)) + bool(s[i + 1 :] and not self._valid(s[i + 1 :], "line")))
            return self.cost(s[:at], rule) + (self.cost(s[at + 1 :], "line") if s[at + 1 :] else 0), kind, not s[at + 1 :]
        return self.cost(s, "line"), "plain", False

    def _blocks(self, lines: list[tuple[int, str]], at: list[int] | None = None) -> float:
        """The cost of logical lines (indentation, shape) as blocks; at gets the numbers of those that have to be edited."""
        before = {"else": ("if", "elif", "for", "while", "except"), "elif": ("if", "elif"), "except": ("try", "except"), "finally": ("try", "except", "tryelse")}
        total = 0.0
        stack: list[list] = [[0, None]]  # indentation, kind of the last statement there
        need = False

        def leave(last: str | None) -> float:
            return 1.0 if last in ("try", "deco") else 0.0

        for number, (width, s) in enumerate(lines):
            before_it = total
            if need:
                if width > stack[-1][0]:
                    stack.append([width, None])
                else:
                    total += 1
                    need = False
            elif width > stack[-1][0]:
                total += 1
                stack.append([width, None])
            if width < stack[-1][0]:
                while len(stack) > 1 and width < stack[-1][0]:
                    total += leave(stack.pop()[1])
                if width != stack[-1][0]:
                    total += 1
                    stack.append([width, None])
            cost, kind, need = self._statement(s)
            total += cost
            last = stack[-1][1]
            inside = stack[-2][1] if len(stack) > 1 else None
            if (kind == "case") != (inside == "match"):
                total += 1
            if kind in before:
                if last not in before[kind]:
                    total += 1
                if kind == "else" and last == "except":
                    kind = "tryelse"
                elif kind in ("else", "finally"):
                    kind = "plain"
            else:
                if last == "try" or last == "deco" and kind not in ("def", "class", "deco"):
                    total += 1
            stack[-1][1] = kind
            if at is not None and total > before_it:
                at.append(number)
        rest = (1 if need else 0) + sum(leave(k) for _, k in stack)
        if at is not None and rest:
            at.append(len(lines))
        return total + rest
