"""A chart parser that finds the least number of token insertions, deletions and substitutions that make a text valid.

A grammar is written in lines "name : alternative | alternative"; a word is a rule's name, a token in single quotes, one
of the token kinds ID NUM STR, or a group such as (args), [index] or {block}: a bracketed part whose content derives the
rule named. A trailing ? makes a word optional. Groups are single tokens on their level, with the cost of their content
for every rule that groups of this bracket ask for, so a text is parsed level by level.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np

#: More than any repair costs; three of them still fit into 16 bits.
BIG = np.int16(10_000)
#: Insertions that one step of a derivation may add at a place; longer ones are made of several steps.
NEAR = 1


class Grammar:
    """A grammar in binary form with the least costs of unary chains; tokens are single characters."""

    def __init__(self, text: str, chars: dict[str, str]):
        rules: list[tuple[str, list[str]]] = []
        for line in re.split(r"\n(?=\s*\w+ :)", text.strip()):
            name, _, body = line.strip().partition(" :")
            for alt in re.split(r"\s\|(?=\s|$)|^\|", " " + body):
                words = alt.split()
                forms = [[]]
                for w in words:
                    forms = [f + [w[:-1]] for f in forms] + forms if w.endswith("?") and len(w) > 1 and not w.startswith("'") or w.endswith("'?") else [f + [w] for f in forms]
                rules += [(name, f) for f in forms]
        self.start = sorted({n for n, _ in rules})
        heads = set(self.start)
        self.index: dict[str, int] = {}
        unary: list[tuple[int, int]] = []
        binary: list[tuple[int, int, int]] = []
        empty: set[int] = set()

        def sym(w: str) -> int:
            return self.index.setdefault(w, len(self.index))

        for name, form in rules:
            a = sym(name)
            ids = [sym(w) for w in form]
            if not ids:
                empty.add(a)
            elif len(ids) == 1:
                unary.append((a, ids[0]))
            else:
                while len(ids) > 2:
                    pair = sym("~" + " ".join(map(str, ids[-2:])))
                    if (pair, ids[-2], ids[-1]) not in binary:
                        binary.append((pair, ids[-2], ids[-1]))
                    ids[-2:] = [pair]
                binary.append((a, ids[0], ids[1]))
        binary = sorted(set(binary))
        n = len(self.index)
        self.size = n
        leaf = {w: k for w, k in self.index.items() if w not in heads and not w.startswith("~")}
        self.groups = {b: [(w, self.index.get(w[1:-1])) for w in leaf if w[0] == b and len(w) > 2] for b in "([{"}
        self.chars = {chars[w.strip("'")]: k for w, k in leaf.items() if w[0] not in "([{"}
        self.leaves = np.array(sorted(leaf.values()))
        # cost of making a symbol out of nothing: one for each token
        make = np.full(n, BIG, np.int16)
        make[self.leaves] = 1
        for a in empty:
            make[a] = 0
        for _ in range(n):
            old = make.copy()
            for a, b in unary:
                make[a] = min(make[a], make[b])
            for a, b, c in binary:
                make[a] = min(make[a], make[b] + make[c])
            if (old == make).all():
                break
        self.make = make
        # cost of one symbol out of another by unary rules, or by binary ones whose other part is made out of nothing
        step = np.full((n, n), BIG, np.int16)
        np.fill_diagonal(step, 0)
        for a, b in unary:
            step[a, b] = 0
        for a, b, c in binary:
            step[a, b] = min(step[a, b], make[c])
            step[a, c] = min(step[a, c], make[b])
        for k in range(n):
            np.minimum(step, step[:, k : k + 1] + step[k : k + 1, :], out=step)
        np.minimum(step, BIG, out=step)
        # kept as a list by target: most symbols can't be had from most others within NEAR tokens
        target, source = np.nonzero(step <= NEAR)
        self.source, self.weight = source, step[target, source]
        self.into = np.flatnonzero(np.r_[True, np.diff(target) != 0])  # every symbol is its own source at least
        self.left = np.array([b for _, b, _ in binary])
        self.right = np.array([c for _, _, c in binary])
        self.heads, self.at = np.unique([a for a, _, _ in binary], return_index=True)
        self._states([(self.index[a], [self.index[w] for w in form]) for a, form in dict.fromkeys((a, tuple(f)) for a, f in rules)])

    def base(self, token: str | tuple[str, dict[str, float]]) -> np.ndarray:
        """The costs of one token as each symbol; a group is (bracket, costs of its content by rule)."""
        v = np.full(self.size, BIG, np.int16)
        v[self.leaves] = 1
        if isinstance(token, tuple):
            bracket, costs = token
            for w, _ in self.groups[bracket]:
                v[self.index[w]] = costs.get(w[1:-1], 1)
        elif token in self.chars:
            v[self.chars[token]] = 0
        return v

    def costs(self, tokens: list[str | tuple[str, dict[str, float]]]) -> np.ndarray:
        """The least cost of the tokens as each symbol of the grammar."""
        n = len(tokens)
        if not n:
            return self.make
        v = np.minimum(self._closed(np.stack([self.base(t) for t in tokens])), self.make + 1)
        lefts, rights = [None, v[:, self.left]], [None, v[:, self.right]]  # by width: a row for each place, a column for each rule
        for width in range(2, n + 1):
            m = n - width + 1
            both = lefts[1][:m] + rights[width - 1][1 : 1 + m]
            for k in range(2, width):
                np.minimum(both, lefts[k][:m] + rights[width - k][k : k + m], out=both)
            v = np.minimum(v[:m], v[1 : m + 1]) + np.int16(1)  # a token deleted
            v[:, self.heads] = np.minimum(v[:, self.heads], np.minimum.reduceat(both, self.at, axis=1))
            v = self._closed(np.minimum(v, BIG))
            lefts.append(v[:, self.left])
            rights.append(v[:, self.right])
        return v[0]

    def _closed(self, v: np.ndarray) -> np.ndarray:
        """Rows of costs after unary rules and insertions."""
        return np.minimum(np.minimum.reduceat(v[:, self.source] + self.weight, self.into, axis=1), BIG)

    @cache
    def of(self, rule: str) -> int:
        """The number of a rule's symbol."""
        return self.index[rule]

    # derivations without repair

    def _states(self, rules: list[tuple[int, list[int]]]) -> None:
        """Each place in each rule as a number: the symbol behind it (-1 at the end), and the rule's head."""
        self.behind: list[int] = []
        self.head: list[int] = []
        self.first_states: dict[int, list[tuple[int, list[int]]]] = {}
        leaves = set(self.leaves.tolist())
        self.firsts: dict[int, set[int]] = {k: {k} if k in leaves else set() for k in range(self.size)}
        self.nullable: set[int] = set()
        old = None
        while old != (old := (sum(map(len, self.firsts.values())), len(self.nullable))):
            for a, form in rules:
                if all(b in self.nullable for b in form):
                    self.nullable.add(a)
                for b in form:
                    self.firsts[a] |= self.firsts[b]
                    if b not in self.nullable:
                        break
        for a, form in rules:
            if form:
                self.first_states.setdefault(a, []).append((len(self.behind), form))
            self.behind += [*form, -1]
            self.head += [a] * (len(form) + 1)
        self.predictions: dict[tuple[int, frozenset[int]], list[int]] = {}

    def _predicted(self, symbol: int, fits: frozenset[int]) -> list[int]:
        """The starts of the symbol's rules that may begin with a token that fits these leaves."""
        got = self.predictions.get((symbol, fits))
        if got is None:
            if len(self.predictions) > 200_000:
                self.predictions.clear()
            got = self.predictions[symbol, fits] = []
            for state, form in self.first_states.get(symbol, ()):
                for b in form:
                    if not fits.isdisjoint(self.firsts[b]):
                        got.append(state)
                        break
                    if b not in self.nullable:
                        break
                else:
                    got.append(state)
        return got

    def derived(self, tokens: list[str | tuple[str, dict[str, float]]]) -> frozenset[int]:
        """The symbols with rules that derive just these tokens, those of cost 0: Earley's algorithm, for any length."""
        fits = []
        for t in tokens:
            if isinstance(t, tuple):
                fits.append(frozenset(self.index[w] for w, _ in self.groups[t[0]] if t[1].get(w[1:-1], 1) == 0))
            else:
                fits.append(frozenset([self.chars[t]] if t in self.chars else ()))
        fits.append(frozenset())
        behind, nullable, leaves = self.behind, self.nullable, set(self.leaves.tolist())
        waits: list[dict[int, list[tuple[int, int]]]] = []
        agenda = [(s, 0) for a in self.first_states for s in self._predicted(a, fits[0])]
        for i, fit in enumerate(fits):
            wait: dict[int, list[tuple[int, int]]] = {}
            waits.append(wait)
            seen, done, after = set(), set(), []
            while agenda:
                item = agenda.pop()
                if item in seen:
                    continue
                seen.add(item)
                state, at = item
                b = behind[state]
                if b < 0:
                    a = self.head[state]
                    if at < i and (a, at) not in done:  # what is empty was passed over below
                        done.add((a, at))
                        agenda += [(s + 1, o) for s, o in waits[at].get(a, ())]
                elif b in leaves:
                    if b in fit:
                        after.append((state + 1, at))
                else:
                    if b not in wait:
                        wait[b] = []
                        agenda += [(s, i) for s in self._predicted(b, fit)]
                    wait[b].append(item)
                    if b in nullable:
                        agenda.append((state + 1, at))
            agenda = after
            if not agenda:
                break
        return frozenset(a for a, at in done if not at) if i == len(tokens) else frozenset()
