import pytest

from weftgraph.functions import extract as X
from weftgraph.sources import code
from weftgraph.sources.extraction import rows_of
from weftgraph.sources.files import listing


def values(spark, expr, xs, name="x"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], f"i int, {name} string")
    return [r["v"] for r in df.select("i", expr.alias("v")).orderBy("i").collect()]


def test_paths_and_ids(spark):
    names = ["foo.py", "a\\Foo.RS", "x.md", "y.pdf", "p/q.png", "v.mp4", "z.xyz", "Makefile", None, ".gitignore"]
    assert values(spark, X.file_type("x"), names) == ["code", "code", "document", "paper", "image", "video", None, None, None, None]
    assert values(spark, X.language("x"), ["foo.py", "a.tsx", "b", None]) == ["python", "typescript", None, None]
    assert values(spark, X.file_stem("x"), ["a/b/c.py", "c.py", "d\\e.tar.gz", "x/noext"]) == ["b_c", "c", "d_e.tar", "x_noext"]
    assert values(spark, X.target_id("x"), ["Foo.Bar", "(", "a b_", "Ünï"]) == ["foo_bar", "", "a_b", "ünï"]
    assert values(spark, X.node_id("x", "x"), [" a/b "]) == ["a_b::a_b"]
    assert values(spark, X.sanitize("x"), ["a\x00b\x01\n\t", "x" * 500, None]) == ["ab\n\t", "x" * 256, None]


def test_pages_and_urls(spark):
    assert values(spark, X.html_to_text("x"), ["<html><title>T</title><p>Hi  there</p></html>", "<p></p>", ""]) == ["T Hi there", "(empty page)", "(empty page)"]
    assert values(spark, X.looks_like_html("x"), ["<!DOCTYPE html>", "plain", None]) == [True, False, None]
    urls = ["https://a.org/x/page.html?q=1", "https://a.org/doc.pdf", "http://a.org", "https://arxiv.org/abs/1234.5"]
    assert values(spark, X.url_filename("x"), urls) == ["page.html", "doc.pdf", "index.html", "1234.5"]
    assert values(spark, X.is_pdf_url("x"), urls) == [False, True, False, True]
    hosts = ["localhost", "10.1.2.3", "172.16.0.1", "172.32.0.1", "192.168.1.1", "127.0.0.1", "8.8.8.8", "example.org", "100.64.0.1", "169.254.1.1"]
    assert values(spark, X.is_private_host("x"), hosts) == [True, True, True, False, True, True, False, False, True, True]
    assert values(spark, X.salvage_json("x"), ['ok {"a": {"b": 1}} done', "none"]) == ['{"a": {"b": 1}}', ""]


def lines(spark, text):
    return X.lines(spark.createDataFrame([("f", text), ("empty", ""), ("null", None)], "file string, text string"), "file", "text")


def test_documents(spark):
    md = "# T\r\n## A\n[x](setup.md) [y](http://z) [w](#top)\n### D\n## B\n"
    h = sorted((r["line_no"], r["level"], r["title"], r["parent_line"]) for r in X.nesting(X.headings(lines(spark, md), "file"), "file").collect())
    assert h == [(1, 1, "T", None), (2, 2, "A", 1), (4, 3, "D", 2), (5, 2, "B", 1)]
    assert [r["target"] for r in X.markdown_links(lines(spark, md), "file").collect()] == ["setup.md"]
    p = sorted((r["p"], r["line_no"], r["label"]) for r in X.paragraphs(lines(spark, "\n\none\ntwo\n\n" + "x" * 90 + "\n"), "file").where("file = 'f'").collect())
    assert p == [(0, 3, "one"), (1, 6, "x" * 77 + "...")]
    r = [(x["title"], x["mark"]) for x in X.rst_headings(lines(spark, "Top\n===\n\ntext\n\nSub\n----\n"), "file").collect()]
    assert sorted(r) == [("Sub", "-"), ("Top", "=")]
    t = [(x["line_no"], x["tag"], x["text"]) for x in X.rationale(lines(spark, "x = 1\n# WHY: because\n  // TODO: later\n# no tag"), "file").collect()]
    assert sorted(t) == [(2, "WHY", "because"), (3, "TODO", "later")]


@pytest.mark.parametrize(
    "path, text, functions, classes",
    [
        ("a/m.py", 'class G:\n    """Doc."""\n    @deco(1)\n    def greet(self, name: str = "x)") -> int:\n        return helper(name)\n\nasync def helper(x):\n    pass\n', [("greet", "G", ["name"]), ("helper", "", ["x"])], ["G"]),
        ("m.rs", "pub struct S;\nimpl<'a> S {\n    #[inline]\n    pub fn go(&self, n: i64) -> i64 { n }\n}\nfn free() {}\n", [("go", "S", ["n"]), ("free", "", [])], ["S"]),
        ("m.go", "type T struct {\n}\nfunc (t *T) Run(a, b int) int {\n return a\n}\n// func no() {}\nfunc main() {}\n", [("Run", "T", ["a", "b"]), ("main", "", [])], ["T"]),
        ("m.ts", "export class C {\n  m(a: number): number { if (a) { return f(a); } return `}${1}`; }\n}\nexport function f(x: number) { return x; }\nconst g = async (y) => y;\n", [("m", "C", ["a"]), ("f", "", ["x"]), ("g", "", ["y"])], ["C"]),
        ("M.java", "public class M {\n  class In {\n    int a() { return 1; }\n  }\n  @Override\n  public static int b(int x, String... y) throws E { return 2; }\n}\n", [("a", "In", []), ("b", "M", ["x", "y"])], ["M", "In"]),
        ("m.c", "#include <a.h>\nstatic int f(int a, char *b) {\n  char c = '{';\n  return a;\n}\nint main(void) { return f(1, 0); }\n", [("f", "", ["a", "b"]), ("main", "", [])], []),
        ("m.cpp", "class K {\n public:\n  /// doc\n  int q(int a) { return a; }\n};\nint K::r(int b) { return b; }\n", [("q", "K", ["a"]), ("r", "K", ["b"])], ["K"]),
        ("m.rb", "class A\n  def b(c)\n    c\n  end\nend\n", [("b", "A", ["c"])], ["A"]),
    ],
)
def test_declarations(path, text, functions, classes):
    p = code.parse(text, code.language_of(path))
    assert [(f.name, f.owner, f.params) for f in p.functions] == functions
    assert [c.name for c in p.classes] == classes
    assert code.parse(text.replace("\n", "\r\n"), p.language).functions[0].line == p.functions[0].line


def test_annotations_belong_to_the_declaration():
    text = "/// doc\n[[nodiscard]]\ntemplate <class T>\nint f(T a) { return 1; }\n"
    assert [(f.first, f.line) for f in code.parse(text, "cpp").functions] == [(2, 4)]
    text = "/** doc */\n@A(x = 1)\n@B\npublic int f() { return 1; }\n"
    assert [(f.first, f.line) for f in code.parse(text, "java").functions] == [(2, 4)]


def test_rows_of_a_file():
    rows = list(rows_of("a/m.py", "import os\nclass G:\n    def greet(self):\n        # WHY: x\n        return helper(1)\n"))
    ids = {r[1] for r in rows if r[0] == "node"}
    assert ids == {"a_m", "a_m::G", "a_m::G::greet", "a_m::rationale::4"}
    edges = {(r[6], r[7], r[8]) for r in rows if r[0] == "edge"}
    assert edges == {
        ("a_m", "os", "imports"), ("a_m", "a_m::G", "contains"), ("a_m::G", "a_m::G::greet", "contains"), ("a_m::G::greet", "helper", "calls"),
        ("a_m::rationale::4", "a_m::G::greet", "rationale_for"),
    }
    assert list(rows_of("x.unknown", "text")) == [] and list(rows_of("x.py", None)) == []
    assert [r[1] for r in rows_of("x.py", "")] == ["x"]


def test_listing_honours_ignore_rules(tmp_path):
    for p in ("a.py", "b.log", "sub/keep.log", "sub/c.py", "build/x.py", ".hidden.py", ".git/config", "deep/build/y.py"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    (tmp_path / ".gitignore").write_text("*.log\n!keep.log\n/build/\n# note\n")
    assert [p for p, _ in listing(str(tmp_path))] == [".gitignore", ".hidden.py", "a.py", "deep/build/y.py", "sub/c.py", "sub/keep.log"]


def imported(path, text):
    return [m for _, m in code.imports(code.parse(text, code.language_of(path)))]


@pytest.mark.parametrize(
    "path, text, modules",
    [
        ("a.py", 'import os, sys as s\nfrom . import rel, other as o\nfrom ..a.b import c\n"""\nimport fake\n"""\n# import no\nx = 1; import late\nfrom m import (\n  a,\n  b,\n)\nimport x.y, \\\n  z\n', ["os", "sys", "other", "rel", "a.b", "late", "m", "x.y", "z"]),
        ("a.js", 'import {\n  a,\n  b as c,\n} from "mod"\nimport d from \'./d\'\nimport "side"\nexport * from "all"\nexport { e } from "e"\nconst f = require("f"), g = await import(`g`)\n// import "no"\nconst s = "import x from \\"y\\"";\nobj.require("no")\n', ["mod", "./d", "side", "all", "e", "f", "g"]),
        ("a.ts", "import type { A } from 'types'\nimport B = require('b')\n", ["types", "b"]),
        ("a.rs", "use std::{fs, io::{self, Read as R}};\npub use crate::a::*;\nuse x;\n// use no;\nextern crate serde;\n", ["std::fs", "std::io", "std::io::Read", "crate::a", "x", "serde"]),
        ("a.go", 'package a\nimport "fmt"\nimport (\n\t"os"\n\tx "a.b/c"\n\t// "no"\n\t_ "d"\n)\nfunc f() string {\n\tg(\n\t\t"arg",\n\t)\n\treturn "ok"\n}\n', ["fmt", "os", "a.b/c", "d"]),
        ("A.java", "package a;\nimport java.util.List;\nimport static a.B.*;\nclass C { String s = \"import x.y;\"; }\n", ["java.util.List", "a.B.*"]),
        ("a.scala", "import a.b.{C, D => E}\nimport f._\nimport g.h, i.j\n", ["a.b.C", "a.b.D", "f", "g.h", "i.j"]),
        ("a.kt", "import a.b.C as D\n", ["a.b.C"]),
        ("a.c", '#include <a/b.h>\n#  include "c.h"\n/* #include <no.h> */\n', ["a/b.h", "c.h"]),
        ("a.swift", "@testable import A\nimport struct B.C\n", ["A", "B.C"]),
        ("a.css", "@import url('a.css');\n@import \"b.css\";\n@import url(c.css);\n/* @import 'no'; */\n", ["a.css", "b.css", "c.css"]),
        ("a.ex", "defmodule A do\n  alias B.{C, D}\n  use E, opt: 1\nend\n", ["B.C", "B.D", "E"]),
        ("a.rb", "require 'a/b'\nrequire_relative(\"c\")\n# require 'no'\n", ["a/b", "c"]),
        ("a.php", "<?php\nuse A\\B;\nuse C\\{D, E as F};\nrequire_once 'g.php';\n$f = function () use ($x) { };\n", ["A\\B", "C\\D", "C\\E", "g.php"]),
        ("a.cs", "using System;\nusing static A.B;\nusing X = C.D;\nclass K { void f() { using (var x = y()) { } } }\n", ["System", "A.B", "C.D"]),
        ("a.hs", "module A where\nimport qualified Data.Map as M\nimport B (c)\n-- import No\n", ["Data.Map", "B"]),
        ("a.lua", "local a = require('a.b')\n-- require('no')\n", ["a.b"]), ("a.dart", "import 'package:a/b.dart' as b;\n", ["package:a/b.dart"]),
        ("a.sh", "source ./a.sh\n# source no\n. b/c.sh\n", ["./a.sh", "b/c.sh"]), ("a.zig", 'const std = @import("std");\n', ["std"]),
        ("a.py", "", []), ("a.md", "import a", []),
    ],
)
def test_imports(path, text, modules):
    got = imported(path, text) if code.language_of(path) else []
    assert sorted(got) == sorted(modules)


def test_a_tree_read_by_the_file_source_equals_the_local_one(spark, tmp_path):
    from weftgraph.sources.extraction import languages
    from weftgraph.sources.files import detect

    root = tmp_path / "t"
    (root / "a" / "b").mkdir(parents=True)
    (root / ".git").mkdir()
    for name, text in {"x.py": "x = 1\n", "a/y.js": "y()\n", "a/b/z.md": "# Z\n", "a/b/no.py": "", "a/skip.py": "s", ".git/c.py": "c", "p.pdf": "%PDF", "bin.xyz": "b"}.items():
        (root / name).write_text(text)
    (root / "a" / "bad.py").write_bytes(b"\xff = 1")
    (root / ".gitignore").write_text("skip.py\n")
    (root / "a" / "b" / ".gitignore").write_text("no.py\n")
    columns = ["file_path", "size_bytes", "file_type", "language", "content_hash", "content"]
    local, uri = (sorted(map(tuple, detect(spark, r).select(columns).collect())) for r in (str(root), f"file://{root}"))
    assert local == uri and [r[0] for r in local] == ["a/b/z.md", "a/bad.py", "a/y.js", "p.pdf", "x.py"]
    known = {r["language"]: r for r in languages(spark).collect()}
    assert known["typescript"]["extensions"] == ["ts", "tsx"] and known["haskell"]["imports"] and len(known) == len(set(code.EXTENSIONS.values()))
