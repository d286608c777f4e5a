"""Valid and invalid snippets of each language: what its grammar knows."""

import ast
import random

import pytest

from fernglass.llm.syntax.repair import Repairer

GOOD = {
    "java": [
        'record P(int x, String y) {}',
        'public record P<T>(T x) implements Q { P { if (x == null) throw new E(); } static int z = 1; }',
        'sealed interface S permits A, B {}',
        'public abstract sealed class S permits A {} non-sealed class A extends S {} final class B extends S {}',
        'class A { int f(int x) { return switch (x) { case 1, 2 -> 3; case 4 -> { yield 5; } default -> throw new E(); }; } }',
        'class A { void f(int x) { switch (x) { case 1 -> g(); default -> { h(); } } } }',
        'class A { Object o = (Runnable) () -> {}; }',
        'class A<T extends B & C> { <T extends A & B> void f() {} }',
        'class A { void f(Object o) { if (o instanceof String s && s.length() > 1) g(s); } }',
        'class A { String s = """\n  hi "x"\n  """; }',
        'class A { void f() { var x = new ArrayList<>(); for (var e : x) {} } }',
        '@interface X { int y() default 1; String[] z() default {}; }',
        'class A { int[] f()[] { return null; } int x[], y; }',
        'class A { void f() { int x = y ? z : w; a: for (;;) break a; } }',
        'package a;\nimport static a.b.C.*;\nclass A { static { x(); } { y(); } }',
        'enum E { A(1) { void f() {} }, B; E(int... x) {} }',
        'class A { void f() { Function<A, B> g = A::b; h(int[]::new); } }',
        'class A { List<Map<String, List<int[]>>> x = new HashMap<>(); }',
        'class A { void f() throws X, Y { try { } catch (final X | Y e) { } } }',
        'class A { @A(b = {1, 2}, c = @D) private final int x = 1; void f(@N final String a, int... b) {} }',
        'class A { boolean f(Object o) { return switch (o) { case Integer i when i > 1 -> true; case null, default -> false; }; } }',
        'import java.util.List;',
        'class A { void f() { x.<String>g(); A.super.h(); new B().new C(); } }',
        "class A { char c = '\\u0041'; long l = 0xFFL; double d = 1e-3; float f = .5f; }",
        'class A { void f() { synchronized (this) { } assert x > 1 : "m"; do { } while (x); } }',
        'interface A { default void f() {} private void g() {} static void h() {} }',
        'class A { Comparator<A> c = (a, b) -> a.x - b.x; Supplier<A> s = () -> { return null; }; }',
        'class A { var f(Object o) { return o instanceof P(int x, var y) ? x : 0; } }',
        'module a.b { requires transitive c; exports d to e; }',
    ],
    "ts": [
        'type A<T> = { [K in keyof T]?: T[K] };',
        'type A<T> = { readonly [K in keyof T]-?: T[K]; };',
        "const a = ['x'] as const;",
        "declare module 'a' { export const x: number; }",
        'class A<T = string, U extends B = C> {}',
        'const f = <T,>(x: T): T => x;',
        'const f = <T extends A>(x: T) => { return x; };',
        'const f = async <T>(x: T): Promise<T> => x;',
        'type A = typeof b;',
        'type B = A extends infer U ? U : never;',
        'let x = y!;',
        'function f(this: A, x?: number): asserts x is string {}',
        'type F = new (...args: any[]) => T;',
        'abstract class A { abstract f(): void; protected abstract readonly x: number; }',
        'let x: [a: string, b?: number, ...c: D[]];',
        "export type { A } from './b';",
        "import type { A, B } from 'c';",
        "import { type A, b } from 'c';",
        "enum A { X = 'a', Y = 1 << 2 }",
        'declare const enum B { C }',
        'declare function f(x: number): void;',
        'declare global { interface Window { x: any } }',
        'let f: (x: number, y?: string) => void = (x) => {};',
        'type T = `a${string}b`;',
        'function isA(x: any): x is A { return true; }',
        'class A { constructor(private x: number, readonly y = 1) {} get z(): number { return 1; } static #p = 1; declare q: string; override r() {} }',
        'let x = <any>y;',
        'let z = a as unknown as B;',
        "type A = B['c'][number];",
        'export default interface A { b: c }',
        'export = foo;',
        "import x = require('y');",
        'function f<T extends keyof U, U>(a: T): a is any;\nfunction f(a) {}',
        'const x = { a: 1 } satisfies B;',
        'type A = { f(): void; readonly [k: string]: any; new (x: number): A; get b(): string }',
        'namespace A.B { export const c = 1; }',
        'for (const x of y as Z[]) {}',
        "type U = | 'a' | 'b';",
        'let x: unique symbol;',
        "@Dec() class A { @Input() x: string; @Output() y = new E<string>(); @H('c', ['$e']) f() {} }",
        'let a: A<B<C>>;',
        'abstract class X { private constructor(); }',
        'class A { [key: string]: any; static readonly B: C = 1; f?(): void; }',
        'type X = A extends B ? C : D;',
        'let v = f<string>(x);',
        'type G = keyof typeof x;',
        'let t: readonly string[];',
        "type Fn = typeof import('x');",
        'if (a < b && c > d) {}',
        'const x = a < b ? c : d;',
        'class A implements B, C {}',
        'function f({ a, b }: { a: string; b?: number } = {}): void {}',
        'export abstract class A {}',
        'export declare const x: number;',
        'export as namespace X;',
        'type A = asserts;',
        'let x = y as any as string[];',
        'a ??= b; c &&= d; e ||= f;',
        'let big = 10n;',
        'type R = Record<string, (a: number) => Promise<void>>;',
        'try { x() } catch { y() }',
        'let fn = function <T>(x: T) {};',
        'accessor;',
    ],
    "js": [
        'x = a?.[0];',
        'x = a?.b?.(c);',
        'function* g() { yield* h(); yield; const x = yield y; }',
        'const o = { get a() { return 1 }, set a(v) {}, async *b() {}, [c]: 1, async d() {}, *e() {} };',
        "class A { static { f(); } #x = 1; static async *g() {} get [k]() { return 1 } 'str'() {} 1() {} }",
        'label: for (;;) { continue label; }',
        'for await (const x of y) {}',
        "import * as a from 'b'; import c, { d as e, default as f } from 'g'; export * as h from 'i'; export { j as default };",
        'x = `a${`b${c}`}d`;',
        'x = a ? b : c ? d : e;',
        'if (a) b; else c',
        'x = /[/]/g.test(y) / 2;',
        'var a = function () {}(), b = (() => {})();',
        'new A; new A.B(c); new (f())();',
        'x = y ?? z; x **= 2; x = 2 ** 3;',
        'const {a = 1, ...b} = c, [d, , e = 2, ...f] = g;',
        'async () => { await x; }',
        'x = async y => z;',
        "import('a').then(b => c);",
        'import.meta.url;',
        'new.target;',
        'switch (a) { case 1: { b } default: c }',
        'do x++; while (y)',
        'throw new E(`x`)',
        'delete a.b, void 0, typeof c;',
        'x = <div className="a" {...b}>text {c} <br/> {/* c */}</div>;',
        "const A = () => (<><B x={1} y='2'/>it's {a && <C>d</C>}</>);",
        'function f() { return <A.B c={() => { d(); }}>{e.map(x => <li key={x}>{x}</li>)}</A.B>; }',
        'x = a < b; y = c > d;',
        'export default function () {}',
        'export default class extends A {}',
        'export default async function f() {}',
        'let async = 1; let of = 2; get = 3;',
        'x = { async: 1, get: 2, of, set };',
        'debugger;',
        ';;;',
        '#!/usr/bin/env node\nx()',
        'a\n++b',
        'return_ = 1',
        'x = {a, b}, y = [,,1]',
        'if (a) {} else if (b) {} else {}',
        'while(1);',
        'for (var i in o) ;',
        'for (let i = 0, n = a.length; i < n; i++) {}',
        'x = a\n  .b()\n  .c()',
        'const f = ({a, b}) => ({...a, b})',
        'export const a = 1, b = 2;',
        "'use strict'",
        'x = !function () {}()',
        'let x = y in z && a instanceof B',
        'class A extends (B, C) {}',
        'x = y => ({})',
        'with_ = 1',
        'var { a: { b } } = c',
        'x = 0x1F + 0b11 + 0o7 + 1_000 + .5e-3',
        "export { default } from 'a'; export { default as b } from 'c'",
    ],
    "go": [
        'package a\ntype N interface { ~int | ~string }\n',
        'package a\ntype N interface { ~int | float64; comparable; F() int }\n',
        'package a\nfunc F[T any, U ~[]T](x T) (y U, err error) { return }\n',
        'package a\ntype S[T any] struct { x T; *B; c.D `json:"a"` }\nfunc (s *S[T]) F() {}\n',
        'package a\nvar x = S[int]{1}\nvar y = F[string](z)\n',
        'package a\nfunc f() { for i := range 10 { } ; for range ch { } ; for i, v := range x { } }\n',
        'package a\nfunc f() { switch x := y.(type) { case int, string: z() ; case nil: default: } }\n',
        'package a\nfunc f() { select { case x, ok := <-c: ; case c <- 1: ; default: } }\n',
        'package a\nvar f = func(a, b int, c ...string) (int, error) { return 1, nil }\n',
        'package a\nfunc f() { defer func() { recover() }() ; go g(x...) }\n',
        'package a\nvar x = []struct{ a int; b string }{{1, "x"}, {a: 2}}\n',
        'package a\nvar m = map[string][]int{"a": {1, 2}, `b`: nil}\n',
        'package a\nvar c chan<- int; var d <-chan int; var e = make(chan struct{})\n',
        'package a\nfunc f() { L: for { break L } ; goto L }\n',
        'package a\nfunc f() { if v, ok := m[k]; ok && v > 1 { } else if x { } else { } }\n',
        'package a\nconst ( A = iota; B; C = 1 << iota )\n',
        'package a\nvar a, b = x[1:2], y[:3:4]\n',
        'package a\nfunc f() { x := &T{A: 1}; *p = 2; p.q++ ; x.y, z = 1, 2 }\n',
        'package a\nimport ( . "x"; _ "y"; z "w" )\n',
        "package a\nvar r = 'a'; var s = '\\n'; var f = 1e3; var h = 0x1p-2; var i = 2i\n",
        'package a\ntype F func(int) error\ntype A = B\ntype C [5]int\ntype D [N]map[string]*E\n',
        'package a\nfunc f() { if (T{1}) == y { } ; for _, x := range []int{1} { } }\n',
        'package a\nfunc f() {\n\tx.\n\t\ty()\n\tz(a,\n\t\tb,\n\t)\n}\n',
        'package a\nfunc f() { var x interface{ F() } = y; _ = x.(interface{ G() }) }\n',
        'package a\nvar x = [...]int{1: 2}\n',
        'package a\nfunc f() { switch { case a: fallthrough; case b: } ; switch x := f(); x { } }\n',
        'package a\nvar _ I = (*T)(nil)\nvar _ = []byte("x")\n',
        'package a\nfunc f() (int, error)\n',
    ],
    "py": [
        "match x:\n    case 1 | 2:\n        a\n    case [a, *b] if c:\n        d\n    case {'k': v, **r}:\n        e\n    case P(x=1, y=Q()):\n        f\n    case _:\n        pass\n",
        "match x, y:\n    case (1, -2) as z:\n        pass\n    case 'a' 'b' | None:\n        pass\n",
        'match = 1\nmatch.x = 2\nprint(match)\nmatch(x)\nmatch[0] = 1\n',
        'type X = int\ntype Y[T] = list[T]\n',
        'type = 1\nprint(type(x))\n',
        "x = f'{a['b']}'\n",
        'x = f"{x!r:>{w}} {y=}"\n',
        'def f(a, /, b, *, c=1, **d): pass\n',
        'def f[T: int, *U, **V](x: T) -> U: ...\n',
        'class A[T](B, metaclass=C): x: int = 1\n',
        'with (open(a) as b, open(c) as d,): pass\n',
        'try:\n    a\nexcept* E as e:\n    b\n',
        'x = [i for i in y if i for j in z]\n',
        'lambda: 0\nlambda x, *y, z=1, **k: (yield)\n',
        "print(*a, **b, sep='')\n",
        'x[1:2, ::3, ...]\n',
        'a = b = c\na, *b = c\n(a, b), c = d\n',
        "assert x, 'm'\nraise E from None\ndel a[0], b.c\nglobal q\n",
        '@a.b(c)\n@d\nasync def f():\n    async with a as b, c: pass\n    async for x in y: await z\n    return [x async for x in y]\n',
        'if (n := f()) > 1: pass\n',
        'x = 1 if a else 2\n',
        'x: list[int]\n',
        'return_ = not a is not b\n',
        'def f():\n  x = yield\n  yield from y\n  yield a, b\n',
        'while x: break\nelse: pass\nfor a in b, c: continue\nelse: pass\n',
        'a = \'\'\'x\n\'y\'\'\'\nc = b\'x\' b"y"\n',
        'x = a if b else lambda: c\n',
        'f(x for x in y)\n',
        'from . import a\nfrom ..b import (c as d,)\nimport e.f as g, h\nfrom x import *\n',
        "x = {**a, 'b': 1}\ny = {*a, 1}\nz = {k: v for k, v in w}\n",
        'def f(): return\n',
        'x = 1_000 + 0xFF + 1e5j + .5\n',
        'if a:\n  pass\nelif b:\n  pass\nelse:\n  pass\n',
        'x @= y; z //= 2; w **= 3\n',
        'a < b < c != d not in e\n',
        "print(a, end='') ; b\n",
        'case = 1\ncase(x)\n_ = 2\n',
        'nonlocal_ = 1\n',
        "def f(*, a): pass\ndef g(*args: int, b: str = 'x', **kw: dict) -> None: pass\n",
        'x = *a, b\nfor x in *a, b: pass\nreturn_ = x[*a]\n',
        'a = (\n  1,\n  # c\n  2\n)\n',
        'class A: pass\nclass B(): x = 1; y = 2\n',
        'try: pass\nfinally: pass\n',
        'f(a)(b)[c].d\n',
        'f(**a, b=1)\nf(a=1, *b)\nf(*a, b)\n',
    ],
}
BAD = {
    "py": [
        'def f(a=1, b): pass\n',
        'f(a=1, 2)\n',
        'f(**a, b)\n',
        'def f(*): pass\n',
        'def f(**a, b): pass\n',
        'match x:\ncase 1:\n  pass\n',
        'match x:\n    case 1\n        pass\n',
        'match x:\n    a = 1\n',
        'case 1:\n    pass\n',
        "x = f'{a b}'\n",
        'x = (1, 2\n',
        'type X = \n',
        'def f(a, a=): pass\n',
        'lambda a=1, b: 2\n',
        'x = 5 +\n',
        'for x in: pass\n',
        'import\n',
        'from a import\n',
        'class A(:\n  pass\n',
        '1 = x\n',
        'f() = 1\n',
        'a + 1 = 2\n',
        'x = yield = 1\n',
        'None = 1\n',
        'else: pass\n',
        '  x = 1\n',
        'if a\n  b\n',
        'return x y\n',
        "print 'a'\n",
        'x = [1, 2\ny = 3\n',
        'def f():\n',
        '@a\nx = 1\n',
        'try:\n  pass\n',
        'x == = 1\n',
        'del f()\n',
        'a b\n',
        "'abc\n",
    ],
    "java": [
        'record P {}',
        'class A { void f() { switch (x) { case 1 -> } } }',
        'class A { int x = ; }',
        'class A { void f( { } }',
        'class { }',
        'class A { void f() { if x { } } }',
        'class A { void f() { x = 1 } }',
        'class A { void f() { for (int i = 0; i < 3) { } } }',
        'class A { void f() { return return; } }',
        'class A { int f() { a b c; } }',
        'class A { <T extends> void f() {} }',
        'import java.util.*',
        'class A { void f() { try { } } }',
        'class A { void f() { else { } } }',
        'sealed interface S permits {}',
        "class A { String s = 'abc'; }",
        'class A { void f() { int 1x = 2; } }',
        'class A { void f() { foo(; } }',
        'public class A { public public int x; int; }',
        'class A } {',
    ],
    "ts": [
        'let x: = 1;',
        'interface A { b: }',
        'type A = ;',
        'class A { x: number = }',
        'function f(x: ) {}',
        'const f = <T(x) => x;',
        'enum A { X = }',
        'let a = b as ;',
        "import { a b } from 'c';",
        'type A<T = > = T;',
        'declare module { }',
        'interface { a: b }',
        'let x = {a: 1 b: 2};',
        'abstract f(): void;',
    ],
    "js": [
        'x = <div>;',
        'x = <a></b>;',
        'x = a?.;',
        'function f( {}',
        'if (a {',
        'let = = 1',
        'const a;',
        "import a b from 'c'",
        'export a',
        'x = {a: 1, b}}',
        'for (let i = 0; i < 3) {}',
        'class A { f( }',
        'x = [1, 2',
        'return }',
        'a b',
        'var 1a = 2',
        "x = 'a",
        'new',
        'x = y +',
        'if () {}',
        'switch (a) { x }',
        'break a b',
        'async function',
        '() => ',
        '{ a: 1, b: 2 c: 3 }',
        'function () {}',
        'x = `a${b`;',
    ],
    "go": [
        'package a\ntype N interface { ~ }\n',
        'package a\nfunc f() { if x \n{ } }\n',
        'package a\nvar x int = \n',
        'package a\nfunc f() { for i := 0; i < 3 { } }\n',
        'package a\nfunc f() { x := }\n',
        'package a\nfunc f() { return } }\n',
        'package a\nfunc () {}\n',
        'package a\nimport x\n',
        'package a\nfunc f() { a b }\n',
        'package a\nx := 1\n',
        'package a\nfunc f() { if { } }\n',
        'package a\ntype S struct { a int b int }\n',
        'package a\nfunc f() { else { } }\n',
        'package a\nvar x = []int{1, 2\n',
        'package a\nfunc f(a int,, b int) {}\n',
        'package a\nfunc f() { case 1: }\n',
        'package a\nfunc f() { x++ + 1 }\n',
        'package a\nfunc f() { var x }\n',
        'package\n',
        'package a\nfunc f() { y = if x { } }\n',
    ],
}


@pytest.mark.parametrize("lang", list(GOOD))
def test_snippets(lang):
    r = Repairer(lang)
    assert [s for s in GOOD[lang] if r.repair(s)[0]] == []
    assert [s for s in BAD[lang] if not r.repair(s)[0]] == []


LONG = {
    "py": ["x = " + " + ".join(f"f(a{i})" for i in range(20)), " and ".join(f"not a.b({i})[0]" for i in range(15)), "x = " + " if a else ".join("bcd" * 5) + " if a else y", "a" + "".join(f".b(x{i})" for i in range(20))],
    "js": ["x = " + " + ".join(f"f(a{i})" for i in range(20)), "x = " + "".join(f"a{i} ? b{i} : " for i in range(15)) + "c", "a" + "".join(f".b(x{i})" for i in range(20))],
    "go": ["package a\nvar x = " + " + ".join(f"f(a{i})" for i in range(20)) + "\n"],
    "java": ["class A { int x = " + " + ".join(f"f(a{i})" for i in range(20)) + "; }", "class A { int x = " + "".join(f"a{i} ? b{i} : " for i in range(15)) + "c; }"],
}


@pytest.mark.parametrize("lang", list(LONG))
def test_long_statements(lang):
    r = Repairer(lang)
    assert [s for s in LONG[lang] if r.repair(s)[0]] == []
    assert [s for s in LONG[lang] if not r.repair(s.replace("(", "((", 1) if "(" in s else s + " ?")[0]] == []


def test_python_agrees_on_generated_statements():
    rng, r = random.Random(11), Repairer("py")

    def expr(n):
        if n <= 1:
            return rng.choice(["a", "b.c", "3", "'s'", "f(x)", "d[k]", "-e"])
        k = rng.randrange(1, n)
        return rng.choice(["{0} + {1}", "{0} and {1}", "({0}, {1})", "f({0}, k={1})", "[{0} for q in {1}]", "{{{0}: {1}}}", "({0} if {1} else z)", "{0} < {1}", "g({0})[{1}]"]).format(expr(k), expr(n - k))

    for n in [20, 60, 120, 200] * 6:
        s = f"x = {expr(n)}\n"
        toks = list(s)
        if rng.random() < 0.5:
            at = rng.randrange(len(toks))
            toks[at] = rng.choice(["", ",", ")", "+", " "])
        s = "".join(toks)
        try:
            ast.parse(s)
            good = True
        except SyntaxError:
            good = False
        assert (r.repair(s)[0] == 0) == good, s


PLACES = [
    ("py", "a = 1\nb = = 2\nc = 3\n", [2]), ("py", "def f():\n    x = 1\n   y = 2\nz = 3\n", [3]), ("py", "a = 1\nif a:\n", [2]), ("py", "x = (1,\n  2\ny = 3\n", [1]),
    ("js", "const a = 1;\nf(a,, b);\nlet c = `x\ny`;\nconst = 3;\n", [2, 5]), ("go", "package a\n\nfunc f() {\n\tx := 1\n\ty := := 2\n\tz()\n}\n", [5]),
    ("java", "class A {\n  int x = 1;\n  void f() {\n    g();\n    h(\n  }\n}\n", [5]), ("ts", "interface A {\n  a: string;\n  b: ;\n}\n", [1]),
]


@pytest.mark.parametrize("lang, text, want", PLACES)
def test_places_of_edits(lang, text, want):
    r = Repairer(lang)
    assert r.repair(text)[0] > 0
    got = r.places(text)
    assert want[0] in got, got
    assert len(got) <= len(want) + (4 if lang == "java" else 1) and r.repair(text)[0] > 0 and r.places("" if lang != "go" else "package a\n") == []


@pytest.mark.parametrize("text, want", [
    ("class A {\n" + "  int y = 1;\n" * 30 + "  void f() {\n    g();\n    h(", "truncated"), ("class A {\n<<<<<<< a\n  int x = 1;\n=======\n  int x = 2;\n>>>>>>> b\n  int y;\n}\n", "conflict"),
    ("def f(a):\n    return a\n\ndef g(b):\n    print(b)\n    if b:\n        return f(b)\n\nx = [i for i in y]\nimport os\nfor i in z:\n    f(i)\n", "mismatch"), ("class A {\n  int x = ;\n" + "  int y = 1;\n" * 30 + "}\n", "edit"),
])
def test_kinds_by_places(text, want):
    from fernglass.llm import parsing

    assert parsing.judged(text, Repairer("java"))[1] == want
