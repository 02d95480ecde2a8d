import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from graphloom.llm import layout
from graphloom.llm.layout import Layout, Upstream, copies, judged, not_handwritten, provenances, rare, shingles, tool_mark

HAND = "import { a } from './a';\n\n" + "\n\n".join(
    f"// Step {k} of the walk over the rows.\nexport function step{k}(rows, limit) {{\n  const first{k} = rows[{k}];\n  if (limit > {k * 7}) {{\n    return first{k}.map((x) => x + limit);\n  }}\n  {'for (const r of rows) use(r);' if k % 2 else 'while (next()) drain(limit);'}\n  return load{k}(rows, 'note {k}');\n}}"
    for k in range(8)
)
MINI = "!function(e,t){" + "".join(f"var a{k}=function(x){{for(var i=0;i<x.length;i++)x[i]&&x[i]({k})}};" for k in range(20)) + "}(this,0);"
TABLE = "T = [\n" + "".join("    " + ", ".join(str((k * 37 + j) % 9973) for j in range(10)) + ",\n" for k in range(40)) + "]\n"
BLOB = "export const D = [\n" + "".join(f"  '{random.Random(k).getrandbits(240):x}',\n" for k in range(30)) + "];\n"
ENUM = "pub enum F {\n" + "".join(f"    FIELD{k} = {k},\n" for k in range(15)) + "}\n"
NOTE = HAND + "\nconst note = '" + "a long note about how these rows came to be here, " * 60 + "';\n"


@pytest.mark.parametrize(
    ("ext", "source", "kind"),
    [("js", HAND, None), ("js", MINI, "minified"), ("py", TABLE, "data"), ("js", BLOB, "data"), ("rs", ENUM, "generated"), ("js", NOTE, None), ("js", "", None), ("py", "x = 1\n", None)],
)
def test_kind(ext, source, kind):
    assert Layout(ext, source).kind == kind


@pytest.mark.parametrize(
    ("source", "marked"),
    [
        ("# Code generated by x. DO NOT EDIT.\nx = 1\n", True), ("// Diese Datei wurde von x automatisch erzeugt.\n", True), ("/*\n * Fichier produit automatiquement par x ; ne pas modifier\n */\n", True),
        ("// <auto-generated source='a' />\n", True), ("x = 1\n# Code generated by x. DO NOT EDIT.\n", True), ("x = 1\n# Code generated by x. DO NOT EDIT.\ny = 2\n", False),
        ("# The header 'Code generated by ..., DO NOT EDIT' is written by the emitter, not by this file.\n", False), ("s = '// Code generated by x. DO NOT EDIT.'\n", False), ("", False),
        ("# Licence: see LICENCE\n#\n# Autogenerated from a.avsc on build 3.7 - do not modify by hand.\n", True), ("# This module generates reports.\n", False),
    ],
)
def test_marks(source, marked):
    assert tool_mark(source) is marked


def alike(a: np.ndarray, b: np.ndarray) -> float:
    return len(set(a.tolist()) & set(b.tolist())) / max(1, len(set(a.tolist()) | set(b.tolist())))


def test_copies_with_small_edits():
    own = lambda src: shingles(Layout("js", src).tokens)
    edited = "// local copy\n" + HAND.replace("first3", "second3", 1)
    assert alike(own(edited), own(HAND)) >= layout.SIMILARITY > alike(own(MINI), own(HAND))
    assert len(shingles([])) == 0 and len(shingles(["a"])) == 1


@given(st.sets(st.integers(0, 400), min_size=1, max_size=120), st.sets(st.integers(0, 400), max_size=40))
def test_similar_sets_share_a_rare_one(kept, noise):
    a, b = np.array(sorted(kept), np.int64), np.array(sorted(kept ^ noise), np.int64)
    if alike(a, b) >= layout.SIMILARITY:
        assert set(rare(a).tolist()) & set(rare(b).tolist())


OTHER = NOTE.replace("step", "phase").replace("rows", "items").replace("limit", "bound").replace("first", "head").replace("load", "fetch")
FILES = "file_id bigint, repo string, path string, source string"


def test_operator(spark):
    rows = [
        (1, "r", "src/a.js", HAND), (2, "r", "src/m.js", MINI), (2, "r", "src/m.js", MINI), (3, "r", "src/t.py", TABLE), (4, "r", "vendor/x/a.js", "foo();\n"), (5, "r", "vendor/own/m.js", MINI),
        (6, "r", "src/broken.py", TABLE + ")"), (7, "r", "src/copy.js", "// copied\n" + OTHER), (8, "r", "src/n.js", None), (9, "r", "./vendor/x/broken.js", "foo(;\n"), (10, "q", "vendor/x/a.js", "foo();\n"), (11, "r", "x.unknown", "?"),
    ]
    files = spark.createDataFrame(rows, FILES).selectExpr("*", "'x' as kind", "1 as valid")
    upstream = spark.createDataFrame([("lib", "1", "n.js", OTHER), ("lib", "1", "z.js", None)], "lib string, version string, path string, source string")
    regions = spark.createDataFrame(
        [("r", "vendor", " VENDORED", ""), ("r", ".\\vendor\\own/", "authored", ""), ("r", "vendor", "vendored", ""), ("r", None, None, "")], "repo string, rel_path string, provenance string, region string"
    )
    want = {2: "minified", 3: "data", 4: "region: vendored", 7: "vendored"}
    assert {r.file_id: r.kind for r in not_handwritten(files, upstream, regions).collect()} == want
    assert {r.file_id: r.provenance for r in provenances(files, regions).collect()} == {4: "vendored", 5: "authored", 9: "vendored"}
    known = Upstream(upstream)
    assert [(r.file_id, r.upstream) for r in copies(files, judged(files, known), known).collect()] == [(7, "lib/n.js")]
    assert judged(files.limit(0), Upstream(upstream.limit(0))).collect() == []
    assert not_handwritten(files.limit(0), upstream.limit(0), regions.limit(0)).collect() == []


MARK = "Code generated by x. DO NOT EDIT."


@pytest.mark.parametrize(
    ("ext", "source", "marked"),
    [
        ("go", "".join(f"// Licence, line {k}.\n" for k in range(40)) + f"// {MARK}\npackage p\n", True), ("js", f"/*\nA licence\nwithout stars\n*/\n// {MARK}\nfoo();\n", True),
        ("java", f"/*\n  A licence\n\n  {MARK}\n*/\npackage p;\n", True), ("py", "x = 1\n" + "# note\n" * 9 + f"# {MARK}\n" + "# more of the note that follows\n" * 99, True),
        ("rs", f"#![allow(dead_code)]\n// {MARK}\nfn f() {{}}\n", True), ("js", f"foo();\n/*\n{MARK}\n*/\nbar();\n", False), ("go", f"package p\n\nvar s = `\n// {MARK}\n`\n", False), ("py", f'"""\n{MARK}\n"""\n', False),
    ],
)
def test_marks_on_any_line_of_head_and_foot(ext, source, marked):
    assert tool_mark(source, ext) is marked


ROUTES = "from app import add_route\n\n" + "".join(f"add_route('{w}', handle_{w})\n" for w in "home login logout users orders carts items search help about terms export import stats health admin".split())
COMMAS = "a=1," + ",".join(f"b.{w}=c({w}.d),e[{w}]={{f:{w}}}" for w in "home login logout users orders carts items search help about terms stats health admin".split() * 3) + ";\n"
LONG_ROUTES = "".join(f"app.get('/{w}{v}', {w}.{v});\n" for w in "home login users orders carts items".split() for v in "show list edit drop find".split())


@pytest.mark.parametrize(("ext", "source", "kind"), [("py", ROUTES, None), ("js", COMMAS, "minified"), ("js", LONG_ROUTES, None)])
def test_kinds_by_canonical_layout(ext, source, kind):
    assert Layout(ext, source).kind == kind


def lines(ext: str, source: str) -> list[str]:
    return Layout(ext, source).canonical.emit()


@pytest.mark.parametrize("ext", ["js", "ts", "java"])
def test_layout_does_not_change_canonical_lines(ext):
    one = "class A { f(a) { for (;;) { b(a); } if (a) { c = 1; } else { d(); } } }" if ext != "java" else "class A { void f(int a) { for (;;) { b(a); } if (a) { c = 1; } else { d(); } } }"
    many = one.replace("{ ", "{\n  ").replace("; ", ";\n  // note\n").replace("(;;)", "(;\n;)")
    assert lines(ext, one) == lines(ext, many)
    assert lines(ext, one)[2:6] == ["for ( ; ; ) {", "b ( a ) ;", "}", "if ( a ) {"]


def test_canonical_lines_of_other_languages():
    assert lines("go", "package p\nfunc f() { a(); b() }\n") == ["package p", "func f ( ) {", "a ( ) ;", "b ( )", "}"]
    assert lines("py", "x = 1; y = (2,\n 3)\nif x: z = 4\n") == ["x = 1 ;", "y = ( 2 , 3 )", "if x : z = 4"]
    assert lines("rs", "fn f() { let a = B { c: 1 }; d(a) }") == ["fn f ( ) {", "let a = B { c : 1 } ;", "d ( a )", "}"]
    assert lines("js", "") == []
