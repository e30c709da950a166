import ast

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.llm import lexers, syntax
from weftgraph.llm.glr import END, Grammar, Parser

GOOD = {
    "a.py": [
        "x = 1  # 'quoted'\ny = 2  # \"\nmatch x:\n  case {'a': 'b' | 'c' as d, **e} | A.B(1, f=[-1, *g]) as h if h: pass\n  case (1 | None), _: pass\nf\"{9*\"a\"}b{c[\"d\"]}\"\n",
        "f(*a, b, c=1, *d, e=2, **g, h=3)\ndef f(a, /, b=1, *, c, d=2, **e): pass\ndef g(a=1, /, b=2, *c: *T): pass\nlambda a, /, b=1, *c, d: 0\n",
        "(a) = 1\n(a.b): int = 2\n[a, *b], (c, d.e[0]) = x\na[0].b += 1\nfor a, (b, c[1]) in d: pass\ndel (a, b[0]), [c.d]\nwith f() as (a, b), g() as c.d: pass\nf().x = 1\n",
        "f'{a!r:>{w}} {{x}} {b[\"k\"]:%Y:%m} {c=} {d == e} {x if y else z} \\N{DASH}'\nrf'\\d{n}'\nf'{(lambda x: x)(1)}{ {1: 2}[1] }{*a, b}'\nf\"\"\"{\n a\n}\"\"\"\n00\n0_0\n09.5\n1_0j\n.5e-3\nf(x for x in y)\n",
        "", "\n  \n", "x = 1", "def f(a, *b, c=1, **d) -> int:\n    '''doc'''\n    return {k: [x, (1, 2)] for k, x in a.items() if x}\n",
        "class A(B, metaclass=M):\n  x: int = 3\n\n  @deco(1)\n  async def f(self):\n    async with a as b, c: pass\n    await x; yield\n",
        "try:\n\tpass\nexcept (A, B) as e:\n\traise X from e\nelse:\n\tpass\nfinally:\n\tpass\n", "if a: b\nelif c: d\nelse:\n  e\n", "lambda x, *y: x if y else -1",
        "match x:\n  case [1, *_]:\n    pass\n  case {'a': b} if b: pass\n", "match = 1; case = match\nprint(f'{x!r}', b'a' 'c')\n", "x = [\n  1,\n# c\n  2,\n]\n", "a[1:2, ::3] @= b ** -c\n",
        "from . import (a as b, c,)\nimport a.b as c\nglobal x\nassert a, 'b'\ndel a[0]\n", "x = y = yield\nwith open(a) as f, b: pass\nwhile True: break\n", "if (n := 3) > 2: pass\n",
    ],
    "a.js": [
        "[a.b, c[0]] = d; ({ a: b.c } = d); a().b = 1; (a) = 2; a.b++; --c[0]; for (a.b of c) ; for (x in y) ;", "", "var a = 1, b\nlet c = a / b / 2;", "const r = /[({]+$/g.test(x) ? a : b", "x => { return { a, b: 1, ...c, get d() { return 1 }, async *e() {} } }",
        "class A extends B { static #p = 1; constructor(a) { super(a) } get x() { return 1 } static { f() } async *[k]() {} }", "for (const [a, b] of c) ; for (let i = 0; i < 3; i++) { continue }",
        "label: while (1) { break label }\ndo x++; while (x < 3)\nif (a) b; else c", "import a, { b as c } from 'd'\nexport default function () {}\nexport { a as b }", "const f = async (a = 1, { b, c = 2 }, ...d) => await a?.b?.[0]?.(1)",
        "var t = `a ${b + `c ${d}`} e`", "switch (a) { case 1: case 2: f(); break; default: g() }", "try { a() } catch { b() } finally { c() }", "a = b\n(c)\n;[1, , 2]", "x = function* () { yield* a }; new A; new A.B(1).c",
    ],
    "a.jsx": ["const a = <div className='x' {...p}>it's {b} <B/> </div>;", "function F() { return (<><A b={c > 1}>text</A></>) }"],
    "a.ts": [
        "interface A<T extends B = C> extends D { a?: number; readonly b: string[]; f(x: T): void; [k: string]: any; new (x: number): A }", "type A = { [K in keyof T]?: T[K] } | 'a' | ((x: number) => void)",
        "export class A<T> implements B { private readonly x: number = 1; constructor(public a: string, b?: number) { super() } m<U>(this: A, x: U): x is string { return true } }",
        "enum E { A = 1, B } declare module 'm' { export function f(a: number): void }", "let x = <any>y as const; let z = a!.b satisfies C; f<number>(1); const m = new Map<string, Array<number>>()",
        "function f(a: number): asserts a is string { }\nabstract class B { abstract m(): void; }\nnamespace N { export const a = 1 }", "import type { A } from 'b'; export type { A }; const a = (x: number): string => `${x}`; type C = A extends B ? D : never",
    ],
    "a.go": [
        "package a", "package a\n\nimport (\n\t\"b\"\n\tc \"d/e\"\n)\n\ntype T struct {\n\ta, b int `json:\"a\"`\n\t*C\n}\n\nfunc (t *T) f(a, b int, c ...string) (x int, err error) {\n\tif x := 1; x > 0 {\n\t\treturn x, nil\n\t} else if y {\n\t}\n\treturn\n}\n",
        "package a\nfunc f() {\n\tfor i := 0; i < 3; i++ {\n\t}\n\tfor k, v := range m {\n\t}\n\tfor range x {\n\t}\n\tswitch x := y.(type) {\n\tcase int, *T:\n\tdefault:\n\t}\n\tselect {\n\tcase v := <-c:\n\tcase d <- 1:\n\t}\n\tgo func() { defer g() }()\n}\n",
        "package a\nvar x = map[string][]int{\"a\": {1, 2}, \"b\": nil}\nconst (\n\tA = iota\n\tB\n)\nfunc F[T any, K ~int | string](a T) Map[K, T] { return G[T](a).h[1:2] }\n", "package a\nvar s = `raw } \" text`\nvar r = '\\n'\ntype I interface {\n\tf(int) error\n\tG\n}\n", "package a\nfunc f() bool { return a&b == 1 && c &^ d != 0 || !(e | f < *g) }\n",
    ],
    "A.java": [
        "class A { void f() { a = b = 1; a.b[0] += 2; (x) = 3; i++; --this.j; g(); a.<T>h(); new B(); c.new D(); this.k = l; super.m(); for (i = 0, j = 1; ; i++, g()) {} A::new; } }".replace(" A::new;", ""), "", "package a.b; import static c.D.*; public class A<T extends B & C> extends D<T[]> implements E, F { private static final int[] X = {1, 2}; @Override public <U> List<Map<String, U>> f(final int a, String... b) throws G { for (int i = 0; i < 3; i++) ; for (var x : y) { } return a > 0 ? b : null; } }",
        "enum E { A(1) { int f() { return 1; } }, B; E() {} } interface I { default void f() {} int g(); } record R(int a) { } @interface J { int v() default 1; }",
        "class A { void f() { Runnable r = () -> {}; x.map(a -> a + 1).map(B::new); int y = (int) z; Object o = new A() { }; try (X a = b; c) { } catch (D | E e) { } finally { } switch (a) { case 1 -> f(); default -> { } } int s = switch (q) { case A, B -> 1; default -> 2; }; if (o instanceof B b) { } label: while (true) break label; switch (o) { case B b when b.x > 1 -> f(); default -> {} } int when = 1; String t = \"\"\"\n x \"q\" \"\"\"; } static { } }",
    ],
    "a.rs": [
        "", "use a::{b::c, d as e, *};\n#[derive(Debug)]\npub struct S<'a, T: Clone + 'a> where T: Copy { pub a: &'a T, b: [u8; 4] }\nenum E { A, B(u8), C { x: i32 } = 3 }\nimpl<T> Tr for S<'_, T> { const X: u8 = 1; type Y = Vec<Vec<T>>; fn f(&mut self, a: i64) -> Result<(), Box<dyn Err + Send>> { Ok(()) } }",
        "fn f() { let (a, mut b) = (1, 2.0e3); let c: Vec<_> = x.iter().map(|y| y + 1).collect::<Vec<i32>>(); if let Some(z) = w && z > 1 { } match a { 1 | 2 => {}, 3..=5 if b => x(), E::C { x, .. } => { } _ => () } for i in 0..10 { } 'l: loop { break 'l } while let Some(_) = it.next() { } let s = S { a: 1, ..d }; println!(\"{}\", a); vec![1; 3]; return; }",
        "macro_rules! m { ($x:expr) => { $x }; }\nunsafe extern \"C\" fn g(x: *const u8) {}\npub(crate) async fn h<const N: usize>(f: impl Fn(u8) -> u8) where { f(r#\"a\"b\"#.len() as u8).await?; }\ntrait Q: A + B { fn a(&self); fn b() {} }\nstatic mut X: &str = \"a\\\"\"; mod m { } union U { a: u8 } /* a /* b */ c */ const Y: &str = r##\"a\"#b\"##;",
    ],
    "a.c": [
        "", "#include <a.h>\n#define X(a) \\\n  (a)\ntypedef struct s { int a : 3; union { float f; } u; } t;\nenum e { A = 1, B, };\nstatic const unsigned char d[] = { 0x1, 0x2, };\nint (*fp)(int, void *), *p = 0;\nint main(int argc, char **argv) { int a = (int)b * sizeof(t), c[3] = {[0] = 1}; if (a) { goto x; } else for (;;) break; do { a++; } while (a < 3); switch (a) { case 1: default: ; } x: return p->q.r[1] ? a : ~b; }",
        "int f(void) { return a && b || c & d && !e; }", "#ifdef A\nint f(void) {\n#else\nint f(int a) {\n#endif\n  return 0;\n}\n",
    ],
    "a.cpp": [
        "#include <v>\nnamespace a::b { template <typename T, int N = 3> class C : public D<T>, private E { public: C() : x(1), y{2} {} virtual ~C() = default; T f(const T &a) const override; C &operator=(const C &) = delete; int operator()(int a) { return a; } private: std::vector<std::vector<int>> x; static constexpr int z = 1; }; }",
        "using namespace std; template <class T> T C<T>::f(const T &a) const { for (auto &x : y) { } auto l = [&, this](int a) mutable -> int { return a; }; try { throw E(\"a\"); } catch (const E &e) { } int *p = new int[3]; delete[] p; return static_cast<int>(a) + (b >> 2); }",
        "enum class E : int { A, B }; struct S { int a; S *n = nullptr; }; using V = std::map<int, S>; int main() { auto [a, b] = f(); if (int x = 1; x) { } std::cout << \"a\" << R\"(raw \")\" << R\"x(a)\" b)x\"; return a < b && c > d and not e or f; }",
    ],
}
BAD = {
    "a.py": ["f() = 1", "del f()", "def f(x=1, y): pass", "f(a=1, 2)", "f(**k, *a)", "0777", "x = f'{x'", "x = f'{}'", "f'{a b}'", "f'}'", "a + b = 1", "for f() in x: pass", "def f(*): pass", "(a, b) += 1", "f'{a!}'", "lambda x=1, y: 0", "def f(:\n  pass", "if a\n  b", "x = (1", "def f():\nreturn 1", "  x = 1\n y = 2", "'''never ended", "<<<<<<< HEAD\nx = 1\n=======\ny = 2\n>>>>>>> b\n", "for x in y:\n", "x = 1 2", "@a\nx = 1", "1abc", "int main() { return 0; }", "try:\n  pass\n", "else:\n  pass\n"],
    "a.js": ["1 = 2", "a + b = 3", "1++", "++'a'", "for (1 of x) {}", "function f( {", "let x = ;", "if (a {", "const a = 'x\n';", "a b", "{ ( }", "<<<<<<< ours\na()\n", "def f():\n  pass", "class { x y z }", "404: Not Found", "for (;) {}", "x = {a: 1,, b: 2}", "function f(a: number) {}", "`never ${a"],
    "a.ts": ["let x: = 1", "interface A { a: }", "function f(a number) {}", "<!DOCTYPE html>\n<html></html>", "a:\n  - name: b\n    size: 3 of 4\n"],
    "a.go": ["package a\nfunc f() { g() := 1 }\n", "package a\nfunc f( {\n}", "package a\nfunc f() {\n", "func f() {}", "package a\nx := 1\n", "package a\nfunc f() int { return }}\n", "import a"],
    "A.java": ["class A { void f() { foo; } }", "class A { void f() { 1 + 2; } }", "class A { void f() { g() = 1; } }", "class A { void f() { a.b; } }", "class A { void f() { for (i; i < 3; i++) {} } }", "class A {", "class A { int f( { } }", "class A { int x = 1 }", "int f() { return 1; }}", "public class A { void f() { g(1; } }", "class A { void f() { x y z; } }"],
    "a.rs": ["fn f( {}", "fn f() { let x = ; }", "struct", "fn f() {", "use a::b", "fn f() { g(1; }", "fn f() -> { }", "import os"],
    "a.c": ["int main( {", "int f() { return 1 }", "int f() { g(1; }", "int f() {", "#if A\nint x;\n", "def f(): pass", "Error 503, please retry\n", "int a = ;", "}"],
    "a.cpp": ["class A {", "template <class T", "int f() { return 1 }", "namespace a {", "class A { int x } ;", "import os\nx = 1"],
}


@pytest.mark.parametrize("name, text", [(n, t) for n, ts in GOOD.items() for t in ts])
def test_valid(name, text):
    assert lexers.for_path(name).check(text) is None


@pytest.mark.parametrize("name, text", [(n, t) for n, ts in BAD.items() for t in ts])
def test_invalid(name, text):
    assert lexers.for_path(name).check(text) is not None


def test_texts_of_comments_only():
    for name, text in (("a.py", "# a\n\n# b"), ("a.js", "// a"), ("a.ts", "/* a\n */\n"), ("A.java", "// a\n"), ("a.rs", "//! a"), ("a.c", "/* a */"), ("a.cpp", "// a"), ("a.h", "#pragma once\n")):
        assert lexers.for_path(name).check(text) is None, name
    assert lexers.for_path("a.go").check("// a\n") is not None  # the package clause is missing


def test_line_of_the_error():
    assert lexers.for_path("a.js").check("a()\n/* x\n y */\nb(;\nc()") == 4
    assert lexers.for_path("a.py").check("x = '''a\nb'''\n\ny = = 1\n") == 4
    assert lexers.for_path("a.go").check("package a\n\nfunc f() {\n  x := := 1\n}\n") == 4


def test_header_is_c_or_cpp():
    h = lexers.for_path("x.h")
    assert h.check("int f(int a);\n") is None and h.check("class A { public: A(); };\n") is None and h.check("class A {") is not None


def test_memo_does_not_change_verdicts(monkeypatch):
    texts = [t for n in ("a.py",) for t in GOOD[n] + BAD[n]]
    py = lexers.Python()
    first = [py.check(t) for t in texts]
    monkeypatch.setattr("weftgraph.llm.glr.LIMIT", 1)  # forgets before every file
    assert [py.check(t) for t in texts] == first == [py.check(t) for t in texts]


_line = st.sampled_from(["x = 1", "if x:", "else:", "  y = (2", "  y)", "def f(a, b=1):", "    return a", "  pass", "for i in x: pass", "'''", "x = [", "]", "lambda: 0", "a = b if c else d", "  x +", "try:", "except E:"])


@settings(max_examples=300, deadline=None)
@given(st.lists(_line, max_size=6))
def test_python_agrees_with_its_own_parser(rows):
    text = "\n".join(rows) + "\n"
    try:
        ast.parse(text)
        ok = True
    except SyntaxError:
        ok = False
    assert (lexers.for_path("a.py").check(text) is None) == ok


def test_ambiguous_grammar():
    p = Parser(Grammar("e: e '+' e | e '*' e | 'x'", "e"), {"'+'": "+", "'*'": "*", "'x'": "x", END: "\x02"})
    assert p.accepts(p.run(p.start, "x+x*x+x")) and not p.accepts(p.run(p.start, "x+")) and p.run(p.start, "x+*") == -1


def test_files_and_rates(spark):
    c = spark.createDataFrame(
        [("r/a.py", "x = 1"), ("r\\b.py", "x = ("), ("r/b.py", "x = ("), ("r/c.md", "("), ("r/d.js", None), (None, "x"), ("r/e.go", ""), ("q/f.py", "y = = 1"), ("r/g.rs", "fn f() {} " * 20000)],
        "file_path string, content string",
    ).selectExpr("*", "'x' as language", "1 as error_line")
    m = spark.createDataFrame([("r/a.py", "code", "r"), ("r/b.py", "code", "r"), ("r/b.py", "code", "r"), ("r/e.go", "code", "r"), ("r\\g.rs", "code", "r"), ("q/f.py", "paper", "q")], "file_path string, file_type string, repo string")
    assert [(r["file_path"], r["language"], r["error_line"]) for r in syntax.invalid_files(c, m).collect()] == [("r/b.py", "Python", 1)]
    assert sorted((r["language"], r["n_files"], r["n_invalid"], r["invalid_rate"]) for r in syntax.rates(c, m).collect()) == [("Go", 1, 0, 0.0), ("Python", 2, 1, 0.5), ("Rust", 1, 0, 0.0)]
    assert syntax.invalid_files(c.limit(0), m).count() == 0


HEAD = "#ifdef A\nint f(void) {\n#else\nint f(int a) {\n#endif\n  return 0;\n}\n"


@pytest.mark.parametrize(
    "name, text, line",
    [
        ("a.c", HEAD + "#if B\nint x;\n#else\nint y = ;\n#endif\n", 11),
        ("a.c", HEAD + "#if B\nint x;\n#elif C\n<<<<<<< HEAD\nint y;\n#else\nint z;\n#endif\n", 11),
        ("a.cpp", HEAD + "#if B\nint x;\n#else\n#if C\nint y;\n#else\nint z = ;\n#endif\n#endif\nint w;\n", 14),
        ("a.h", HEAD + "#if B\nint x;\n#else\nint y = ;\n#endif\n", 11),
        ("a.c", HEAD + "#if B\nint x;\n#elif C\nint y;\n#else\nint z;\n#endif\n", None),
        ("a.c", HEAD + "#if B\n#if C\nint x;\n#else\nint y;\n#endif\n#else\n#if D\nint z;\n#else\nint w;\n#endif\n#endif\n", None),
        ("a.c", "int g(int a) {\n#ifdef A\n  if (a) {\n#elif defined(B)\n  while (a) {\n#else\n  a++;\n#endif\n  a--;\n#if defined(A)\n  }\n#endif\n#ifndef A\n#ifdef B\n  }\n#endif\n#endif\n  return a;\n}\n", None),
        ("a.h", HEAD + "#ifdef __cplusplus\nclass K { public: int a; };\n#else\nint new;\n#endif\n", None),
    ],
)
def test_every_branch_is_read(name, text, line):
    assert lexers.for_path(name).check(text) == line
