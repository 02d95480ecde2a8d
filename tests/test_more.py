import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from graphloom import session
from graphloom.functions import names as nm
from graphloom.operators import entities, imports, passes, signals
from graphloom.parsers import go, python, typescript
from graphloom.plans import scanners

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))
FIXTURES = "diff_frames resolve_signals resolve_file resolve_imports resolve_sites test_edges provenance grpc_stack queue_stack websocket_stack".split()


@pytest.mark.parametrize("name", [*FIXTURES, *scanners.QUERIES, "python_graph", "python_nodes", "go_graph", "typescript_graph"])
def test_fixture_queries_match_their_sql(spark, name):
    from compare import connect, rows_of

    df = entry.queries()[name](spark, "/nowhere")
    cur = connect("/nowhere").execute(entry.oracle_sql()[name])
    got = rows_of(df.columns, df.collect())
    assert got and got == rows_of([d[0] for d in cur.description], cur.fetchall())


def one(spark, c):
    return spark.range(1).select(c.alias("c")).first().c


def test_names(spark):
    lit = F.lit
    assert [one(spark, nm.downgrade(lit(x))) for x in ("Strong", "Medium", "Weak")] == ["Medium", "Weak", "Weak"]
    refs = [("a::b::c", "x.y", 0, "x::y"), ("a::b::c", "x", 1, "a::b::x"), ("a::b::c", "", 2, "a"), ("a", "x", 1, "x"), ("a", None, 3, "")]
    assert [one(spark, nm.module_reference(lit(a), lit(b), lit(n))) for a, b, n, _ in refs] == [w for *_, w in refs]
    assert [one(spark, nm.join_path(lit(a), lit(b))) for a, b in (("/api/", "/x"), (None, "x/"), ("", ""), ("api", None))] == ["/api/x", "/x", "/", "/api"]
    assert one(spark, nm.word_occurrences(lit("run runs run_ (run)run"), lit("run"))) == 3 and one(spark, nm.word_occurrences(lit("x"), lit(""))) == 0
    assert one(spark, nm.mentions(lit("`a.b` AbcDef `1x` Abc AbcDef"))) == ["a.b", "AbcDef"]
    assert one(spark, nm.test_label(lit("tests/t.py::C::go[1-2]"))) == "C::go"
    assert [one(spark, nm.short_label(lit(q), lit(k))) for q, k in (("a::B::c", 4), ("a::B", 2), ("c", 4))] == ["B.c", "B", "c"]
    assert [one(spark, nm.feature(lit(p))) for p in ("src/features/cart.service.ts", "x/modules/users/a.py", "a/b.py")] == ["cart", "users", None]
    assert [tuple(one(spark, nm.byte_range(lit("aä\nb\n\nc"), lit(a), lit(b)))) for a, b in ((0, 0), (1, 2), (3, 9), (9, 9))] == [(0, 4), (4, 7), (7, 8), (8, 8)]
    assert [one(spark, nm.clean_doc(lit(t))) for t in ("/** Says a. */", "// TODO x", "", "# Copyright 2020", None)] == ["Says a.", None, None, None, None]
    assert one(spark, nm.constants(lit("AB = 1\nABC = 2\nABC == 3\nexport const XYZ_1: number = 4\n  NOT = 1"))) == ["ABC", "XYZ_1"]


def test_empty_tables(spark):
    df = lambda schema: spark.createDataFrame([], schema)
    nodes = df("id string, repo_id bigint, kind int, name string, qname string, parent_id string, file string, start_line int, end_line int, repo string")
    edges = df("edge_id bigint, src string, dst string, category int")
    assert signals.resolve_signals(df("id int, text string"), nodes, edges).collect() == []
    assert passes.test_edges(nodes).collect() == [] and passes.ancestors(edges, nodes).collect() == [] and passes.call_chains(edges, df("anchor string"), 3).collect() == []
    assert passes.provenance(nodes, df("node_id string, cell_type int, text string"), df("repo string, prefix string, provenance string")).collect() == []
    sites = df("site_id int, module string, owner string, shape string, base string, name string, category int")
    assert imports.resolve_sites(sites, nodes, df("module string, bound string, target string")).collect() == []


def test_inheritance_has_no_end_in_cycles(spark):
    e = spark.createDataFrame([("a", "b", 20), ("b", "c", 20), ("c", "a", 20), ("c", None, 20), ("a", "d", 4)], "src string, dst string, category int")
    got = {tuple(r) for r in passes.ancestors(e, spark.createDataFrame([("a",), ("a",)], "id string")).collect()}
    assert got == {("a", "b"), ("a", "c")}


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://x:7077"

    class Session:
        sparkContext = Context()  # noqa: N815
        conf = {}  # noqa: RUF012

    with pytest.raises(ValueError, match="checkpoint"):
        session.scratch_dir(Session())


@pytest.mark.parametrize("name", [x for x in dir(entities) if callable(getattr(entities, x)) and not x.startswith("_") and x not in ("Column", "DataFrame")])
def test_scanners_take_anything(spark, name):
    rows = [(1, "a.py", None), (2, "b.tsx", ""), (3, "docker-compose.yml", "services:\n"), (4, "Dockerfile", "ENV"), (5, "k.yaml", "kind:\n---\n---"), (6, "x.js", "x" * 100_000), (7, None, "@Controller(")]
    files = spark.createDataFrame(rows, "file_id bigint, path string, source string").selectExpr("*", "'x' as qname", "1 as n")
    run = getattr(entities, name)
    assert run(files).columns[0] == "file_id" and {r.file_id for r in run(files.unionByName(files)).collect()} <= {1, 2, 3, 4, 5, 6, 7}
    assert run(files.limit(0)).collect() == []


def test_python_items():
    got = python.items(7, "a/__init__.py", "from . import x\nfrom .b import *\nclass C(D, m.E, f()):\n  async def g(self):\n    def h(): return self.g() + super().g() + y.z() + w()()\n  k = g(1)\n")
    nodes = {r["qname"]: (r["kind"], r.get("parent_id")) for r in got if r["item"] == "node"}
    ids = {r["qname"]: r["id"] for r in got if r["item"] == "node"}
    assert nodes == {"a": (1, None), "a::C": (2, ids["a"]), "a::C::g": (4, ids["a::C"]), "a::C::g::h": (3, ids["a::C::g"])}
    assert [(r["module"], r["name"], r["level"]) for r in got if r["item"] == "import"] == [("", "x", 0)]
    sites = [(r["id"], r["shape"], r["base"], r["name"], r["category"]) for r in got if r["item"] == "site"]
    c, h = ids["a::C"], ids["a::C::g::h"]
    want = {
        (c, "Bare", None, "D", 20), (c, "Attribute", "m", "E", 20), (c, "ComplexReceiver", None, None, 20), (h, "SelfMethod", None, "g", 4), (h, "SuperMethod", None, "g", 4), (h, "Attribute", "y", "z", 4),
        (h, "ComplexReceiver", None, None, 4), (h, "Bare", None, "w", 4), (c, "Bare", None, "g", 4), (h, "Bare", None, "super", 4), (c, "Bare", None, "f", 4),
    }
    assert set(sites) == want
    assert python.items(1, "b.py", "def f(:") == [] and [r["qname"] for r in python.items(None, "b.py", "")] == ["b"]
    deep = "x = " + "(" * 150 + "1" + ")" * 150
    assert len(python.items(1, "c.py", deep)) <= 1 and len(python.items(1, "d.py", "f()\n" * 20_000)) == 20_001


def test_python_graph_of_empty_and_repeated_tables(spark):
    schema = "repo_id bigint, path string, source string"
    assert [df.collect() for df in python.graph(spark.createDataFrame([], schema))] == [[], [], []]
    rows = [(1, "a.py", "def f(): return g()\ndef g(): pass\n")] * 3 + [(None, "b.py", "x()")]
    nodes, edges, open_ = python.graph(spark.createDataFrame(rows, schema).selectExpr("*", "'n' as name", "1 as kind"))
    assert nodes.count() == 4 and edges.count() == 1 and [r.name for r in open_.collect()] in ([], ["x"])


def test_go_items():
    src = "package p\n/* func no() {} */\nfunc (t *T[K]) Run(f func() (int, error)) (a struct{ b int }, err error) {\n\tt.go_()\n\tx.y.z()\n\tif (f()) { return }\n}\nfunc Ext(a int) int\nfunc New[K any](k K) *T[K] { return nil }\n"
    got = go.items(1, "p.go", src)
    nodes = {r["qname"]: (r["kind"], r["start_line"], r["end_line"]) for r in got if r["item"] == "node"}
    assert nodes == {"p": (1, 0, 9), "p::T::Run": (4, 2, 6), "p::Ext": (3, 7, 7), "p::New": (3, 8, 8)}
    assert {(r["shape"], r["base"], r["name"]) for r in got if r["item"] == "site"} == {("SelfMethod", None, "go_"), ("ComplexReceiver", None, "z"), ("Bare", None, "f")}
    assert go.items(1, "x.go", "") == [] and go.items(1, "a/x.go", "package q\nfunc f() {")[0]["qname"] == "a"


def test_go_graph_of_an_empty_table(spark):
    assert [df.collect() for df in go.graph(spark.createDataFrame([], "repo_id bigint, path string, source string"))] == [[], [], []]


def test_typescript_items():
    src = "import d, { a as b, type T } from '../x/y.js';\nimport p from 'pkg';\n// import z from './z';\nclass A<T> extends m.B {\n  f(x: { k: number }): { v: string } {\n    return g(`${h()}`);\n  }\n}\nexport const k = (x) => f(x);\nconst r = /f(/.test(s);\nfunction* gen() { this.q?.(); o.p.w(); }\n"
    got = typescript.items(1, "src/u/index.ts", src)
    nodes = {r["qname"]: (r["kind"], r["start_line"], r["end_line"]) for r in got if r["item"] == "node"}
    assert nodes == {"src::u": (1, 0, 11), "src::u::A": (2, 3, 7), "src::u::A::f": (4, 4, 6), "src::u::k": (3, 8, 8), "src::u::gen": (3, 10, 10)}
    assert {(r["style"], r["module"], r.get("name"), r["alias"]) for r in got if r["item"] == "import"} == {("symbol", "src::x::y", "a", "b"), ("symbol", "src::x::y", "T", None), ("exact", "src::x::y", None, "d")}
    ids = {r["id"]: r["qname"] for r in got if r["item"] == "node"}
    sites = {(ids[r["id"]], r["shape"], r["base"], r["name"]) for r in got if r["item"] == "site"}
    assert {("src::u::A", "Attribute", "m", "B"), ("src::u::A::f", "Bare", None, "g"), ("src::u::k", "Bare", None, "f"), ("src::u::gen", "ComplexReceiver", None, "w")} <= sites
    assert typescript.items(1, "a.js", "")[0]["qname"] == "a" and len(typescript.items(1, "b.js", "f();\n" * 5000)) == 5001
