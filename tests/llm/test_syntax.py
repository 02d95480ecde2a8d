import ast
import sys
from pathlib import Path

import pytest

from graphloom.llm import syntax
from graphloom.llm.lexers import LANGUAGES, language
from graphloom.llm.peg import Grammar, Kinds

VALID = {
    "py": [
        "", "# c", "x = 1\n", "def f(a, *, b=1, **k) -> int:\n    return a\n", "async def g():\n  async with a as b, c:\n    await d\n", "match x:\n  case {'a': 1, **r} if r:\n    pass\n  case _:\n    pass\n",
        "x = [i async for i in y if i]\n", "f'{a!r:>{w}} {b[\"c\"]}'\n", "print(*a, sep='')\n", "try:\n  pass\nexcept* E as e:\n  pass\n", "type X[T: int] = list[T]\n", "a = b = yield c\n", "with (open(a) as b, c):\n pass\n",
        "x = lambda a, /, b=1, *c: a if b else c\n", "if x:\n\ty\nelse:\n\tz\n", "class A[T](B, metaclass=M): x: int = 1; y = 2\n", "a[1:2, ::3] += b\n", "x = (yield)\n", "'a' \"b\"\\\n'c'\n", "@d.e(1)\ndef f(): ...\n", "\ufeffx = 1\n", "not x\r\nif y:\r\n  z\r\n",
    ],
    "js": [
        "", "// c", "#!/usr/bin/env node\nfoo()\n", "const f = async ({a, b: [c = 1]}, ...d) => ({a})\nfoo()\n", "for (const k in o) if (k) continue; else break\n", "class A extends B { static #x = 1; get y() { return this.#x } async *z() {} }\n",
        "a = b ? c : d => e\n", "x = `a${`b${c}`}d`\n", "y = /[/]\\/x/g.test(a) / 2\n", "import a, {b as c} from 'd'\nexport * as e from 'f'\n", "if (a) return\nelse b()\n", "label: while (1) { break label }\n", "do x++; while (x < 5)\n", "new A().b?.[c]?.(d)\n",
        "switch (a) { case 1: b(); break; default: c() }\n", "let {a, ...b} = c, d\n", "async function* f() { for await (const x of y) yield* x }\n", "a ??= b ** c\n", "export default class {}\n", "!function(){}()\n", "var x = {get a() { return 1 }, async b() {}, [c]: 2, 'd': 3, e}\n",
    ],
    "ts": [
        "function f<T extends U>(a: T, b?: string): a is X { return a as any }\n", "interface A<T> extends B { (x: number): string; readonly [k: string]: T; m?(): void }\n", "type X = { [K in keyof T]?: T[K] } | (A & B)[] | `a${string}`\n",
        "enum E { A = 1, B }\nabstract class C { private constructor(public a: string) { super() } abstract m(): void }\n", "const x = <T,>(a: T) => a!\n", "let y: Map<string, Array<number>> = new Map<string, number[]>()\n", "declare module 'x' { export const a: number }\n",
        "type F = (a: number, ...b: string[]) => Promise<void>\n", "type C = A extends infer B ? B : never\n", "export type { A } from './a'\n", "function g(a: string): void\nfunction g(a: any) {}\n",
    ],
    "go": [
        "package a\n", "package a\nimport (\n\t\"fmt\"\n\tx \"y\"\n)\nfunc (s *S[T]) F(a, b int, c ...string) (int, error) {\n\tif v, err := g(); err != nil {\n\t\treturn 0, err\n\t}\n\treturn 1, nil\n}\n",
        "package a\ntype T struct {\n\tA, B int `json:\"a\"`\n\t*C\n}\nvar x = map[string][]T{\"a\": {{A: 1}}, \"b\": nil}\n", "package a\nfunc f() { for i := range x { go func() { <-c }() }; select { case v := <-c: _ = v; default: } }\n",
        "package a\nfunc g[K comparable, V any](m map[K]V) { switch x := m.(type) { case int: case nil: } }\n", "package a\ntype I interface {\n\tM(int) error\n\t~int | string\n}\n",
    ],
    "java": [
        "", "package a.b;\nimport static c.D.*;\n@A(x = {1, 2}) public final class B<T extends C & D> extends E<T> implements F { int[] a = {1}; B() { super(); } <R> R m(final int... x) throws G { return (R) x; } }\n",
        "enum E implements F { A(1) { void m() {} }, B; private int x; }\n", "record R(int a, String b) { R { if (a < 0) throw new X(); } }\n", "class A { void m() { var x = switch (y) { case 1, 2 -> 3; default -> { yield 4; } }; for (int i = 0, j = 1; i < j; i++) {} for (var a : b) {} } }\n",
        "class A { Object f = (a, b) -> a::c; String s = \"\"\"\n  x \"y\"\n  \"\"\"; boolean b = o instanceof String t && t.isEmpty(); int[][] q = new int[2][]; }\n", "interface I { default int m() { return 1; } static void n() {} }\n@interface J { int v() default 1; }\n",
    ],
    "rs": [
        "", "use a::{b::*, c as d};\npub(crate) fn f<'a, T: Clone + 'a>(x: &'a mut T, (a, b): (u8, i32)) -> Result<Vec<T>, Box<dyn E>> where T: Send { let x = y?; if let Some(z) = x { return z } else { loop { break 'a' } } }\n",
        "impl<T> A for B<T> { const C: u8 = 1; type D = E; fn m(&self) -> impl Iterator<Item = u8> + '_ { self.x.iter().map(|a| a + 1) } }\n", "enum E { A, B(u8), C { x: i32 } }\nstruct S(pub u8);\nstruct U;\n",
        "fn f() { match x { 1 | 2 => a(), 3..=5 if b => {} Some(ref c) | D { e, .. } => {} _ => unreachable!(\"{}\", x), } }\n", "fn f() { let s = r#\"a \" b\"#; let c = '\\''; let v: Vec<Vec<u8>> = vec![vec![0; 3]]; for i in 0..n { x[i] as u8; } }\n",
        "/* a /* b */ c */ #![x] mod m { }\nmacro_rules! q { ($a:expr) => { $a }; }\n", "async fn f() { x.await?; async move { 1 }.await }\ntrait T: A + B { fn m(&self); }\n",
    ],
}
BROKEN = {
    "py": ["def f(:\n  pass\n", "if x:\npass\n", "x = (1,\n", "'abc\n", "print 'x'\n", "f() = 1\n", "a = = b\n", "  x = 1\n", "if x:\n    a\n  b\n", "f'{a'\n", "class A\n  pass\n", "<<<<<<< HEAD\nx = 1\n=======\n", "x = $a\n", "else:\n  pass\n", "def f():\n"],
    "js": ["function f( {", "const x = ;", "let a: string = 1", "x = `a${b`", "'abc", "if (a { }", "<<<<<<< HEAD\nx\n=======\ny\n>>>>>>> b\n", "class A { foo }} ", "/* a", "func f() {}", "# a b c", "a b c", "for (;;", "export 1 +", "dd))"],
    "ts": ["function f(a: ): void {}", "interface A { x: }", "type = ", "let x: Map<string = 1", "enum E { 1 + }", "const {{ name }} = 1"],
    "go": ["", "// c\n", "package a\nfunc f( {}\n", "package a\nx := 1\n", "package a\nfunc f() {\n\tif x\n\t{\n\t}\n}\n", "package a\nfunc f() { a b }\n", "package a\nvar s = \"x\n", "package a\nfunc f() { return 1 2 }\n"],
    "java": ["class A { void m( { } }", "class A { int x = ; }", "class A { void m() { return 1 } }", "package a\nclass B {}", "class A { String s = \"x; }", "import a.b", "class A { if (x) {} }"],
    "rs": ["fn f( { }", "let x = 1;", "fn f() { let x = ; }", "struct A { x u8 }", "fn f() { a b }", "/* /* */", "fn f() -> { }", "impl { fn }", "fn f() { r#\"a\" }"],
}


@pytest.mark.parametrize(("ext", "source"), [(e, s) for e, x in VALID.items() for s in x])
def test_valid(ext, source):
    assert language(ext).valid(source), language(ext).failure(source)


@pytest.mark.parametrize(("ext", "source"), [(e, s) for e, x in BROKEN.items() for s in x])
def test_broken(ext, source):
    assert not language(ext).valid(source)
    at, cause = syntax.why(ext, source)
    assert 0 <= at <= len(source) and cause


def test_python_agrees_with_the_interpreter():
    """On the standard library the grammar takes what Python takes."""
    lib = Path(ast.__file__).parent
    seen = 0
    for path in sorted(lib.glob("*.py"))[:120]:
        source = path.read_text(encoding="utf-8", errors="replace")
        assert language("py").valid(source) == syntax.python_accepts(source), path
        seen += 1
    assert seen > 50


def test_truncated_files_never_crash():
    sys.setrecursionlimit(20_000)
    for ext, sources in VALID.items():
        for s in sources:
            for k in range(0, len(s), 3):
                if not language(ext).valid(s[:k]):
                    syntax.why(ext, s[:k])


def test_place_and_cause():
    assert syntax.why("js", "a;\n<<<<<<< HEAD\nb;\n=======\nc;\n>>>>>>> x\n") == (3, "merge conflict")
    assert syntax.why("py", "x = (1,\n")[1] == "truncated"
    assert syntax.why("go", "import logging\n\ndef f():\n    return 1\n")[1] == "wrong extension: py"
    assert syntax.why("java", "PK\x03\x04")[1] == "binary"
    at, _ = syntax.why("js", "function f() {\n  return a b;\n}\n")
    assert at == len("function f() {\n  return a ")


def test_long_and_deep_sources():
    sys.setrecursionlimit(20_000)
    assert language("js").valid("a();\n" * 50_000)
    assert language("py").valid("x = " + "(" * 150 + "1" + ")" * 150 + "\n")
    assert language("js").valid("x = " + "[" * 3000 + "]" * 3000)


def test_notation():
    k = Kinds()
    g = Grammar("file = stmt*\nstmt: memo = NAME @(args)? ';'\nargs = (NAME (',' NAME)*)?", k, (";",))
    n, c = k["NAME"], k[","]
    good = g.group("(", n + c + n)
    bad = g.group("(", c)
    assert g.match("file", n + good + k[";"] + n + k[";"]) == (True, 5)
    assert g.match("file", n + bad + k[";"]) == (False, 1)
    assert g.match("file", "") == (True, 0)
    with pytest.raises(ValueError):
        Grammar("a = nothing", Kinds(), ())


def test_operator(spark):
    rows = [
        (1, "r", "a.py", "x = 1\n", 9), (1, "r", "a.py", "x = 1\n", 9), (2, "r", "b.py", "x = (\n", 9), (2, "r", "b.py", "x = (\n", 9), (3, "r", "c.js", None, 9), (4, "q", "d.txt", "?", 9),
        (5, "q", None, "x", 9), (6, "q", "e.go", "", 9), (7, "q", "f.py", "", None),
    ]
    files = spark.createDataFrame(rows, "file_id bigint, repo string, path string, source string, valid int")
    assert sorted(r.file_id for r in syntax.invalid_files(files).collect()) == [2, 6]
    got = {(r.repo, r.language): (r.files, r.invalid, r.rate) for r in syntax.rates(files, syntax.parse_files(files)).collect()}
    assert got == {("r", "python"): (2, 1, 0.5), ("q", "go"): (1, 1, 1.0), ("q", "python"): (1, 0, 0.0)}
    assert syntax.parse_files(files.limit(0)).collect() == []


def test_all_languages_load():
    assert {language(e).name for e in LANGUAGES} == {"python", "javascript", "typescript", "go", "java", "rust"}


@pytest.mark.parametrize(
    ("ext", "head", "part", "end"),
    [
        ("js", "if (a) { b(); }", " else if (a) { b(); }", "\n"), ("ts", "x = ", "a ? b : ", "c;\n"), ("java", "class A { void f() { if (a) { b(); }", " else if (a) { b(); }", " } }"),
        ("go", "package p\nfunc f() {\nif a { b() }", " else if a { b() }", "\n}\n"), ("rs", "fn f() { if a { b(); }", " else if a { b(); }", " }"),
    ],
)
def test_long_chains_are_parsed_to_their_end(ext, head, part, end):
    limit = sys.getrecursionlimit()
    chain = head + part * 6000
    for kinds in (None, language(ext).lexed):
        check = (lambda s: syntax.is_valid(ext, s)) if kinds is None else (lambda s: syntax.valid_lexed(ext, s, kinds(s)[3]))
        assert check(chain + end) is True and check(chain + " else else" + end) is False
    assert syntax.why(ext, chain + " else else" + end)[0] > len(chain) - 9
    assert sys.getrecursionlimit() == limit


def _template(depth: int, inner: str = "a + 1") -> str:
    return inner if not depth else "`x ${" + _template(depth - 1, inner) + "} y`"


@pytest.mark.parametrize("depth", [1, 3, 4, 5, 9])
def test_nesting_has_no_bound(depth):
    for ext in ("js", "ts"):
        assert syntax.is_valid(ext, f"const a = {_template(depth)};\n")
        assert not syntax.is_valid(ext, f"const a = {_template(depth, 'a +')};\n")
        assert not syntax.is_valid(ext, f"const a = {_template(depth)[:-1]};\n")
    comment = "/* a " * depth + "*/ " * depth
    assert syntax.is_valid("rs", f"{comment}\nfn f() {{}}\n")
    assert not syntax.is_valid("rs", f"{comment[:-3]}\nfn f() {{}}\n")
    hashes = "#" * depth
    assert syntax.is_valid("rs", f'fn f() {{ let a = r{hashes}"a "b" c\n"{hashes}; }}\n')
    assert not syntax.is_valid("rs", f'fn f() {{ let a = r{hashes}"a "{hashes[1:]}; }}\n')


def test_place_of_an_error_behind_deep_nesting():
    src = f"const a = {_template(6)};\nconst = 2;\n"
    assert syntax.why("js", src)[0] == src.index("= 2")
    src = "/* a " * 7 + "*/ " * 7 + "\nfn f( {}\n"
    assert syntax.why("rs", src) == (len(src), "truncated") or not syntax.is_valid("rs", src)


PYTHON = [
    "08\n", "0_7\n", "00\n", "0\n", "08.5\n", "09e1\n", "07j\n", "1_000\n", "1__0\n", "0x1f + 0b1\n", "f(**a, *b)\n", "f(*a, **b)\n", "f(a=1, *b)\n", "f(**a, b=1)\n", "f(**a, b)\n", "f(x for x in y)\n", "f(a, b for b in c)\n",
    "'a' b'b'\n", "b'a' b'b'\n", "'a' 'b'\n", "'\\x1'\n", "'\\x12'\n", "'\\N{foo}'\n", "'\\N{DIGIT ONE}'\n", "r'\\x1'\n", "b'\\x1'\n", "'\\\\x1'\n", "def f(a=1, b): pass\n", "def f(a=1, *, b): pass\n", "def f(a, /, b=1, *c, d, **e): pass\n",
    "def f(*): pass\n", "def f(*, a): pass\n", "def f(/, a): pass\n", "def f(**a, b): pass\n", "def f(a, *b, c=1, d): pass\n", "def f(a,): pass\n", "def f(a: int = 1, /, b): pass\n", "lambda a=1, b: 0\n", "lambda a, b=1, *c: 0\n", "lambda: 0\n", "match x:\n case b'a': pass\n",
]


@pytest.mark.parametrize("source", PYTHON)
def test_python_agrees_with_its_own_parser(source):
    assert language("py").valid(source) is syntax.python_accepts(source)


def in_java(body: str) -> str:
    return "class A { void f() { " + body + " } }"


GOOD = {
    "java": [in_java(x) for x in ("a();", "a.b().c();", "a++;", "--a;", "a.b[1] = 2;", "new A();", "new A().b();", "this.<T>f();", "super.f();", "(a).b();", "List<String> l = new ArrayList<>();", "a = b -> c;", "foo(a)[1]++;", "new int[3].clone();", "a.new B();")],
    "js": ["a = 1;", "[a, b] = c;", "({a} = b);", "x ??= 1;", "const a = 1, b = 2;", "let a;", "for (const x of y) {}", "a = b = c;", "a > b ? c : d;", "x >>= 1;", "if (a) b = c; else d = !e;", "a ? b = 1 : c = 2;", "let f = async x => { y = 1 };"],
    "ts": ["declare const x: number;", "export declare const y: string;", "abstract class A { abstract f(): void; }", "x = y as any;", "a!.b = 1;"],
}
BAD = {
    "java": [in_java(x) for x in ("1 + 2;", "a;", "(limit);", "a.b;", "a[1];", "-a;", "(int) a;", "a ? b : c;", "List<> l = null;", "a() + b();")] + ["public public class A {}", "class A { public private int x; }"],
    "js": ["1 = 2;", "a++ = 3;", "const x;", "a + b = c;", "!a = b;", "export export const a = 1;", "null = 1;", "const a = 1, b;"],
    "ts": ["1 = 2;", "const x;"],
}


@pytest.mark.parametrize("ext", GOOD)
def test_statements(ext):
    assert [s for s in GOOD[ext] if not syntax.is_valid(ext, s)] == [] and [s for s in BAD[ext] if syntax.is_valid(ext, s)] == []
