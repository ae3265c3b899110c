import ast
import datetime as dt
import random

import pytest

from lodestone.llm import grammars, lexing, p4_syntax
from lodestone.llm.derivatives import Grammar

T0 = dt.datetime(2024, 1, 1)
FILES = "file_path string, repo string, source_bytes binary, ingested_at timestamp, language string, extra string"


def test_derivatives_of_a_small_grammar():
    g = Grammar("list = '(' { item } ')' ; item = 'a' | list ;", "list")
    assert g.nullable(g.run("(a(aa)a)")) and g.run("(a))") is g.empty and g.failing("(a))") == 3
    cut = g.run("(a(")
    assert cut is not g.empty and not g.nullable(cut)


def test_a_small_memo_changes_no_outcome():
    g = Grammar("list = '(' { item } ')' ; item = 'a' | list ;", "list", most=5)
    for _ in range(20):
        assert g.nullable(g.run("((((a))))")) and g.run(")") is g.empty


VALID = {
    "python": ["", "# only\n", "x = 1", "def f(a, *b, c=1, **d):\n  return (a\n  , b)\n", "match x:\n    case [1, *_] if y: pass\n", "async def g():\n\tawait x\n", "f'{a!r:>{w}}' 'b'", "with (a as b, c as d): pass\n", "class A:\n    '''d'''\n\n    x: int = 1 # c\n"],
    "javascript": ["", "// c", "const {a, ...b} = c?.d ?? `x${`y`}`", "x = y\n++z", "var r = /a[/]b/g;", "class A { static x = 1; get y() { return 1 } }", "export default async () => ({})"],
    "typescript": ["type A<T> = { [K in keyof T]?: T[K] }", "function f<T>(x: T): x is string;", "enum E { A = 1 }", "let x = <T,>(y: T): T => y as any;"],
    "java": ["package a.b;\nimport java.util.*;\nclass A<T extends B> { int[] x = {1}; void f() { for (var i : y) { } x = a ? b : c -> d; } }", "record P(int a) { }", "@interface X { int v() default 1; }"],
    "go": ["package a\n\nfunc (t *T) F(x ...int) (a, b int) {\n\tif v, ok := m[k]; ok {\n\t\treturn\n\t}\n}\n", "package a\n\ntype T struct {\n\tA int `json:\"a\"`\n}\n", "// only a comment\n"],
    "rust": ["fn f<'a>(x: &'a str) -> Option<u32> { match x { \"a\" | \"b\" => Some(1), _ => None } }", "#[derive(X)]\npub struct S { a: Vec<Vec<u8>> }", "impl<T> A for B<T> where T: C { const X: u8 = b'x'; }", "/// doc\nmod a;"],
}
BROKEN = {
    "python": ["def f(:\n  pass\n", "x = (1", "if a\n  b\n", "<<<<<<< HEAD\nx = 1\n=======\n", "  x = 1\n y = 2\n", "f'{a'", "x = 'a\n", "package a\n\nimport (\n)\n"],
    "javascript": ["{\"a\": 1, \"b\": 2}", "function f( { }", "x = \"a", "a b", "const x: number = 1;", "class A { /** x }"],
    "typescript": ["function f(x: number { }", "<!doctype html><html>", "interface A { x: ; }"],
    "java": ["class A { void f() { int x = 1 } }", "class A {", "# Title\n\nprose here", "class A { String s = \"x; }"],
    "go": ["package a\n\nfunc f( {\n}\n", "package a\n\nfunc f() {\n\tx := map[string]int{\"a: 1}\n}\n", "id;a;b\n1;2;3\n"],
    "rust": ["fn f() -> u32 { 1 ", "fn f( { }", "let x = “a”;", "fn f() { g(1 }"],
}


MORE_VALID = {
    "python": ['type X[T: int, *Ts, **P] = int', 'f(*a, b, *c, d=1, *e, **k)', 'def f(a, /, b, *, c=1, **k): pass', 'def f(a, b=1, /, c=2, *d, e, f=3, **g): pass', 'a.b[c] += 1', '(a.b) : int = 3', 'for a, *b in c: pass', '[a, b] = c = d', 'x = 1_000.5e-3j', 'lambda *a, k=1, **b: 0', 'x[1:2, ...] = 3', 'with a as (b, c): pass', 'f(x for x in y)', 'del a, b[0], (c.d)', 'async def f():\n    async for x in y: await z', "print(*a, sep='')", 'x = 0', 'x = 00', 'x = .5', 'lambda: (yield)', 'class A(B, metaclass=C): pass', 'if x:\n\ty\n\tz', 'for x[0] in y: pass', "match x:\n    case {'a': None, **r}: pass\n    case [1, *_]: pass\n    case A(b=1): pass", 'a = yield b', 'x: int', 'f(a)(b).c = 3', '(yield)', '@a.b(c)\ndef f(): pass'],
    "javascript": ['while (x) /re/.exec(y)', 'const {a, b: [c]} = d', '[a, b] = [b, a]', '({a} = b)', 'a.b.c = d = 3', 'for (const x of y) {}', 'for (let i = 0, n = 3; i < n; i++) {}', 'x = 0b1n', 'a?.b?.[c]', 'x ||= y', 'let x', 'if (a) /x/.test(b)', 'f().x = 3', 'a[b]++', 'x = y => z', 'var a = 1_000'],
    "typescript": ['class A { declare y: string; a!: string }', 'let w = <any>x', 'let s: unique symbol', 'declare global { interface A { b: string } }', 'export = a;', "import a = require('b');", 'declare const x: number;', 'let v = a as B', 'a!.b = 3', '(a as any).b = 3', 'export as namespace X;', 'abstract class A { abstract f(): void; }', 'let unique = 3'],
    "java": ['class A { void f(Object o) { switch (o) { case Integer i when i > 5 -> g(); default -> h(); } } }', 'non-sealed class A {}', 'module a.b { requires java.base; exports a.b to c, d; requires transitive x; }', 'open module a { uses b.C; provides a.B with c.D, e.F; }', "class A { char c = '\\n'; char d = '\\u0041'; char e = '\\''; }", 'class A { void f() { x++; --y; a.b().c(); new B(); a[0] = 3; this.x = y; super.f(); x >>>= 3; f(); } }', 'class A { long x = 0xFFL; double d = 1.5e3d; float f = .5f; int i = 1_000; }', 'class A { void f() { for (i = 0, j = 1; i < 3; i++, j--) g(); } }', 'class A { int x() { return switch (y) { case 1 -> 2; default -> { yield 3; } }; } }', 'class A { A() { this(1); } }', 'class A { void f() { a.new B(); a.<T>g(); (x) = 3; int[] b = {1}; b[0]++; } }'],
    "rust": ['/* a /* b */ c */ fn f() {}', 'fn f() { let x = 1_000u32 + 0xff + 1e3 + 2.0f64 + 1usize; }', 'fn f() { x.0.1 = 3; }'],
    "go": ['package a\nvar x = 1_000 + 0xff + .5 + 1e3 + 3i + 0777\n'],
}
MORE_BROKEN = {
    "python": ['f() = 3', 'None = 1', 'del f()', 'for 1 in x: pass', '(a, b) += 1', 'def f(a=1, b): pass', 'def f(*a, *b): pass', 'f(a=1, 2)', 'x = 012', 'if x:\n\ty\n        z', 'x = 12abc', 'f(**k, *a)', 'def f(**k, a): pass', 'lambda a=1, b: 0', '1 + 1 = x', 'f(x for x in y, 1)', 'a.b: int = = 3', 'x + 1: int'],
    "javascript": ['1 = x', 'const x;', 'f() = 3', 'x = 3px', 'a + b = c', 'for (const x) {}'],
    "typescript": ['1 = x', 'const x: number;'],
    "java": ['class A { void f() { 3 + 4; } }', "class A { char c = 'ab'; }", 'class A { void f() { x; } }', 'class A { int x = 12abc; }', 'class A { void f() { a + b = c; } }'],
    "go": ['package a\nvar x = 12abc\n', 'package a\nvar x = 0xZZ\n'],
    "rust": ['fn f() { let x = 12abc; }'],
}


@pytest.mark.parametrize("lang,text", [(k, t) for every in (VALID, MORE_VALID) for k, ts in every.items() for t in ts])
def test_valid(lang, text):
    assert grammars.parse(lang, text)[0] == "ok"


@pytest.mark.parametrize("lang,text", [(k, t) for every in (BROKEN, MORE_BROKEN) for k, ts in every.items() for t in ts])
def test_broken(lang, text):
    assert grammars.parse(lang, text)[0] != "ok"


def test_truncation_and_place():
    assert grammars.parse("java", "class A { void f() {")[0] == "truncated"
    text = "x = 1\ny = = 2\n"
    verdict, at = grammars.parse("python", text)
    assert verdict == "broken" and p4_syntax.locate("python", text, at)[1:] == (2, "=")


def test_python_agrees_with_the_compiler(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/files.parquet").filter("lower(file_path) like '%.py'").select("file_path", "source_bytes").distinct().collect()
    for r in rows:
        try:
            ast.parse(bytes(r["source_bytes"] or b""))
            fine = True
        except (SyntaxError, ValueError):
            fine = False
        assert (grammars.parse("python", lexing.decode(bytes(r["source_bytes"] or b"")))[0] == "ok") == fine, r["file_path"]


@pytest.mark.filterwarnings("ignore")
def test_mutants_agree_with_the_compiler(spark):
    """Tokens deleted, repeated or replaced at random: the verdict is the compiler's but for what it tells of names."""
    rnd = random.Random(5)
    rows = spark.read.parquet("/root/testdata/sf0.001/files.parquet").filter("lower(file_path) like '%.py' and source_bytes is not null").select("source_bytes").collect()
    texts = [lexing.decode(bytes(r["source_bytes"])) for r in rows]
    wrong = invalid = 0
    for k in range(600):
        text = rnd.choice(texts)
        spans = [m.span() for m in lexing.LEXERS["python"].finditer(text) if m.group().strip()]
        if len(spans) < 20:
            continue
        (a, b), (c, d) = rnd.choice(spans), rnd.choice(spans)
        mutant = (text[:a] + text[b:], text[:b] + " " + text[a:b] + text[b:], text[:a] + text[c:d] + text[b:])[k % 3]
        try:
            compile(mutant, "x", "exec", dont_inherit=True)
            fine = True
        except (SyntaxError, ValueError) as e:
            fine = "duplicate argument" in str(e)
        invalid += not fine
        wrong += (grammars.parse("python", mutant)[0] == "ok") != fine
    assert invalid > 300 and wrong <= 2


def test_report(spark):
    bom = "﻿x = 1\r\ny = 2\r".encode()
    rows = [
        ("r/a.py", "r", b"def f(:", T0, None, "q"), ("r/a.py", "r", b"x = 1", T0 + dt.timedelta(days=1), None, "q"), ("r/b.PY", "r", b"x = (", T0, "go", "q"), ("r/b.PY", "r", b"x = (", T0, "go", "q"),
        ("r/c.py", None, bom, None, None, "q"), ("r/d.go", "s", None, T0, None, "q"), ("r/e.md", "r", b"# (", T0, None, "q"), (None, "r", b"x", T0, None, "q"), ("r/f.rs", "r", b"fn f() { \xff", T0, None, "q"), ("noext", "r", b"(", T0, None, "q"),
    ]
    df = spark.createDataFrame(rows, FILES)
    got = {r["file_path"]: r["status"] for r in p4_syntax.syntax_report(df).collect()}
    assert got == {"r/a.py": "ok", "r/b.PY": "truncated", "r/c.py": "ok", "r/d.go": "ok", "r/f.rs": "broken"}
    assert {r["file_path"] for r in p4_syntax.found(df).collect()} == {"r/b.PY", "r/f.rs"}
    rates = {(r["repo"], r["language"]): (r["files"], r["broken"], r["share"]) for r in p4_syntax.rates(df).collect()}
    assert rates[("r", "python")] == (2, 1, 0.5) and rates[(None, "python")] == (1, 0, 0.0)
    assert p4_syntax.found(df.limit(0)).count() == 0


def test_very_long_file():
    assert grammars.parse("python", "x = [\n" + "    1,\n" * 200_000 + "]\n")[0] == "ok"
    assert grammars.parse("javascript", "f(" * 3000 + ")" * 3000)[0] == "ok"
