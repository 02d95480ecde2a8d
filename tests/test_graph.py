import math

import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.functions import vectors as vec
from graphloom.functions.ids import canonical_id
from graphloom.operators import analysis, extract, lookup, resolve, scan, store, traverse
from graphloom.plans import graph


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(make(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("0xA78AB9175C2EB1", "00a78ab9175c2eb1"), (" 8CF9C5F450F3DECF", "8cf9c5f450f3decf"), ("0", "0" * 16), ("0X0", "0" * 16),
        ("00000000000000000001", "0" * 15 + "1"), ("ffffffffffffffff", "f" * 16), ("no id", "no id"), ("", ""), (None, None),
        ("1ffffffffffffffff", "1ffffffffffffffff"), ("0x", "0x"),
    ],
)
def test_canonical_id(spark, given, want):
    assert one(spark, given, canonical_id) == want


@pytest.mark.parametrize(("given", "want"), [("//api//users/:id/", "/api/users/{}"), ("", "/"), (" /a/{x}/${y} ", "/a/{}/{}"), ("/", "/")])
def test_http_path(spark, given, want):
    assert one(spark, given, tx.normalise_http_path) == want


def test_small_text_functions(spark):
    assert one(spark, "a/b/c.test.py", tx.path_to_qname) == "a::b::c.test"
    assert one(spark, r"a\b\c.py", tx.basename) == "c.py"
    assert one(spark, "a::b::c::d", lambda c: tx.cluster_key(c, 2)) == "a::b"
    assert one(spark, "a", lambda c: tx.cluster_key(c, 2)) == ""
    assert one(spark, "see `alpha_1`, `x` and `Beta`", tx.backtick_identifiers) == ["alpha_1", "Beta"]
    assert one(spark, "TEST_x_test", tx.strip_test_affixes) == "x_test"
    assert one(spark, "x_spec", tx.strip_test_affixes) == "x"
    assert one(spark, "pkg::tests::a", tx.is_test_qname) and not one(spark, "pkg::latest::a", tx.is_test_qname)
    assert one(spark, "src/x.component.ts", tx.detect_language) == "angular" and one(spark, "x.unknown", tx.detect_language) is None
    frames = one(spark, 'File "a/b.py", line 7, in f\n at x (c/d.js:12)', tx.stack_frames)
    assert [(f.path, f.line) for f in frames] == [("a/b.py", "7"), ("c/d.js", "12")]


@pytest.mark.parametrize(("p", "t", "want"), [("*::tests::*", "a::tests::b", True), ("event_*", "x_event_", False), ("a.b", "axb", False), ("*", "", True)])
def test_glob(spark, p, t, want):
    df = spark.createDataFrame([(p, t)], "p string, t string")
    assert df.select(tx.glob_match(F.col("p"), F.col("t"))).first()[0] is want


def test_vectors(spark):
    p = one(spark, [1.0, 2.0, 3.0], vec.softmax, "array<double>")
    assert math.isclose(sum(p), 1.0) and p[2] > p[1] > p[0]
    assert one(spark, [3.0, 1.0, 3.0], lambda c: vec.top_places(c, 2), "array<double>") == [0, 2]
    assert one(spark, [0.5, 0.5], lambda c: vec.kl(c, c), "array<double>") == 0.0


def entities(spark, rows):
    return spark.createDataFrame(rows, "id string, repo string, method string, path string, confidence string")


def test_http_stack_levels(spark):
    routes = entities(spark, [("r1", "b", "GET", "/users/:id", "Strong"), ("r2", "b", "GET", "/api/users/{x}", "Weak"), ("r3", "b", "ANY", "/any", "Strong")])
    ends = entities(
        spark,
        [("e1", "a", "get", "/api/users/${id}", "Strong"), ("e2", "a", "GET", "/api/v1/users/:y", "Medium"), ("e3", "a", "GET", "/any", "Strong"), ("e4", "b", "GET", "/users/:id", "Strong")],
    )
    got = {(r.src, r.dst, r.level, r.confidence) for r in resolve.http_stack(ends, routes).collect()}
    assert got == {("e1", "r2", 0, "Weak"), ("e2", "r1", 2, "Medium")}


def test_contains_and_suffix(spark):
    a = spark.createDataFrame([("x", "getUser"), ("y", "Z"), ("n", None)], "id string, key string")
    b = spark.createDataFrame([("u", "user"), ("v", "getuserbyid"), ("w", "")], "id string, key string")
    want = {("x", "u"), ("x", "v"), ("x", "w"), ("y", "w")}
    assert {tuple(r) for r in resolve.contains_match(a, b).collect()} == want
    c = spark.createDataFrame([("c1", "/api/chat"), ("c2", "ws")], "id string, key string")
    d = spark.createDataFrame([("h1", "/chat"), ("h2", "default"), ("h3", "/other")], "id string, key string")
    assert {tuple(r) for r in resolve.suffix_match(c, d).collect()} == {("c1", "h1"), ("c1", "h2"), ("c2", "h1"), ("c2", "h2"), ("c2", "h3")}


def test_pairs_and_matches(spark):
    e = spark.createDataFrame([("a", "k", "Strong"), ("a", "k", "Weak"), ("b", "k", "Medium"), ("c", "z", "Strong"), ("d", None, "Strong")], "repo string, key string, confidence string")
    assert [tuple(r) for r in resolve.pair_across_repos(e).collect()] == [("a", "b", 1, "Medium")]
    x = spark.createDataFrame([("1", "a", "k", "Strong")], "id string, repo string, key string, confidence string")
    y = spark.createDataFrame([("2", "b", "k", "Weak"), ("3", "a", "k", "Strong")], "id string, repo string, key string, confidence string")
    assert [tuple(r) for r in resolve.match_by_key(x, y).collect()] == [("1", "2", "Weak")]


NODE = "id string, repo_id bigint, kind int, name string, qname string, parent_id string, file string, start_line int, end_line int"


def test_lookup(spark):
    n = spark.createDataFrame([("1", 1, 3, "f", "m::f", "m", "a.py", 0, 9), ("2", 1, 4, "f", "m::C::f", "c", "a.py", 3, 5), ("3", 2, 3, "h", "m::h", "m", "a.py", 0, 9)], NODE)
    e = spark.createDataFrame([("1", "2"), ("2", "2"), ("3", "2"), (None, "1")], "src string, dst string")
    assert {(r.id, r.degree) for r in lookup.degrees(e).collect()} == {("1", 2), ("2", 3), ("3", 1)}
    assert {(r.id, r.degree) for r in lookup.specificity(e).collect()} == {("1", 2), ("2", 4), ("3", 1)}
    assert [(r.id, r.candidates) for r in lookup.pick_primary(n.select("name", "id"), ["name"], lookup.degrees(e)).where("name = 'f'").collect()] == [("2", 2)]
    spans = spark.createDataFrame([("C.f",), ("m.f",), ("none",)], "span string")
    assert {(r.span, r.id) for r in lookup.resolve_span(spans, n, lookup.degrees(e)).collect()} == {("C.f", "2"), ("m.f", "1")}
    assert {r.name for r in lookup.unique_or_nothing(n, ["name"]).collect()} == {"h"}
    f = spark.createDataFrame([("x", "dir/a.py", 5), ("y", "a.py", 50)], "frame string, path string, line bigint")
    assert [(r.frame, r.id, r.spans) for r in resolve.frame_nodes(f, n).collect()] == [("x", "2", 3)]


def test_walks_on_a_cycle(spark):
    e = spark.createDataFrame([(1, "a", "b", 4), (2, "b", "c", 4), (3, "c", "a", 4), (4, "c", "d", 3)], "edge_id bigint, src string, dst string, category int")
    s = spark.createDataFrame([("a",)], "id string")
    assert {tuple(r) for r in traverse.walk(e, s, 9).collect()} == {("b", 1), ("c", 2), ("d", 3)}
    assert {tuple(r) for r in traverse.walk(e, s, 9, [4]).collect()} == {("b", 1), ("c", 2)}
    assert traverse.walk(e, s, 9, []).collect() == []
    assert {r.id for r in traverse.reachable_by(e, spark.createDataFrame([("d",)], "id string"), s, 5).collect()} == {"a"}
    assert {tuple(r) for r in traverse.impact(e, s, 3).collect()} == {("b", 1, 4), ("c", 2, 4), ("d", 3, 3)}


def test_activation_keeps_its_mass(spark):
    n = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    e = spark.createDataFrame([("a", "b", 4), ("a", "b", 4), ("b", "c", 3), ("x", "a", 4)], "src string, dst string, category int")
    s = spark.createDataFrame([("a",)], "id string")
    v = {r.id: r.score for r in traverse.activate(n, e, s).collect()}
    assert math.isclose(sum(v.values()), 1.0, rel_tol=1e-6) and v["a"] > v["b"] > v["c"] and "d" not in v
    twice = spark.createDataFrame([("a",), ("a",)], "id string")
    assert math.isclose(sum(r.score for r in traverse.activate(n, e, twice, rounds=3, epsilon=None).collect()), 0.5, rel_tol=0.3)


def files(spark, *rows):
    return spark.createDataFrame([(i, "r", p, s) for i, (p, s) in enumerate(rows)], "file_id bigint, repo string, path string, source string")


def test_extraction(spark):
    f = files(
        spark, ("a.py", "import os\nx = os.environ.get('KEY_A')\ny = os.environ[\"KEY_B\"]"), ("b.ts", "process.env.TOKEN; router.get('/users/:id', h); emitter.on('user.created', h)"),
        ("c.sql.py", 'q = "SELECT a FROM public.orders JOIN items ON 1"'), ("d.js", "res.send('x')"), ("e.py", "import dramatiq\nactor.send('jobs')"),
        ("package.json", '{"dependencies": {"react": "1"}, "devDependencies": {"vite": "2"}}'), ("Cargo.toml", '[package]\nname = "x"\n[dependencies]\ntokio = "1"\n'),
        (".env", "export A=1\n# no\nB = 2"), ("Dockerfile", "FROM ghcr.io/team/base:1 AS x"), (".github/workflows/x.yml", "on:\n  schedule:\n    - cron: '0 3 * * 1'\n"),
        ("requirements.txt", "Flask==2\n# c\n-r other\n"), ("go.mod", "module x\nrequire (\n\tgithub.com/a/b v1.2\n)\n"), ("n.py", None),
    )
    got = lambda df: {(r.file_id, r.qname) for r in df.collect()}
    assert got(extract.env_reads(f)) == {(0, "config:env:KEY_A"), (0, "config:env:KEY_B"), (1, "config:env:TOKEN")}
    assert got(extract.sql_tables(f)) == {(2, "data_entity:sql:orders"), (2, "data_entity:sql:items")}
    assert got(extract.needles(f, extract.QUEUE_PRODUCERS, "q:", literal=True).drop("needle")) == {(4, "q:jobs")}
    assert got(extract.calls_with_literal(f, extract.EVENT_HANDLERS, "e:")) == {(1, "e:user.created")}
    assert got(extract.dependencies(f)) == {(5, "package:npm:react"), (5, "package:npm:vite"), (6, "package:cargo:tokio"), (10, "package:pypi:flask"), (11, "package:gomod:github.com/a/b")}
    assert got(extract.dotenv_keys(f)) == {(7, "config:env:A"), (7, "config:env:B")}
    assert got(extract.dockerfile_bases(f)) == {(8, "infra:image:base")}
    assert got(extract.cron_schedules(f)) == {(9, "cron:0 3 * * 1")}
    assert {(r.method, r.path) for r in extract.routes(f).collect()} == {("GET", "/users/:id")}


def test_scans(spark):
    f = files(spark, ("x/node_modules/a/dist/b.js", ""), ("dist/m.0123456789ab.js", ""), ("dist/n.0123456789ab.css", ""), ("dist/o.0123456789ab.map", ""), ("src/a.py", ""))
    assert {(r.region, r.provenance, r.files) for r in scan.region_anchors(f).collect()} == {("x/node_modules", "vendored", 1), ("dist", "build_output", 3)}
    assert {(r.dir, r.hashed) for r in scan.bundle_dirs(f).collect()} == {("dist", 3)}
    d = spark.createDataFrame([(1, "intro\n# A b!\ntext\n## C\n"), (2, None), (3, ""), (4, "no heading")], "doc_id bigint, text string")
    assert {(r.doc_id, r.section, r.slug) for r in scan.markdown_sections(d).collect()} == {(1, 0, "overview"), (1, 1, "a-b"), (1, 2, "c"), (4, 0, "overview")}
    m = spark.createDataFrame([("r", "package.json", '{"name": "web"}'), ("r", "go.mod", "module example.com/team/tool")], "repo string, path string, source string")
    assert scan.manifest_name(m).first().name == "web"


def test_store(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "repo int, v string")
    path = str(tmp_path / "t")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    assert {r.status for r in store.write_sharded(rows, path, ["repo"]).collect()} == {"new"}
    changed = spark.createDataFrame([(1, "a"), (1, "b"), (3, "d")], "repo int, v string")
    assert {(r.repo, r.status) for r in store.write_sharded(changed, path, ["repo"]).collect()} == {(1, "same"), (2, "gone"), (3, "new")}
    assert {(r.repo, r.v) for r in store.read_sharded(spark, path, ["repo"]).collect()} == {(1, "a"), (1, "b"), (3, "d")}
    c = spark.createDataFrame([("n", 0, 1, "x"), ("n", 1, 1, "y")], "node_id string, ord int, cell_type int, text string")
    new = spark.createDataFrame([("n", 1, "z"), ("n", 2, "doc"), ("m", 2, "new")], "node_id string, cell_type int, text string")
    assert {tuple(r) for r in store.upsert_cells(c, new).collect()} == {("n", 0, 1, "z"), ("n", 1, 1, "y"), ("n", 2, 2, "doc"), ("m", 0, 2, "new")}


def test_overlap_and_rates(spark):
    a = spark.createDataFrame([("f", 1, 0, 200), ("f", 2, 5, 6)], "k string, id int, a int, z int")
    b = spark.createDataFrame([("f", 9, 100, 300), ("f", 8, 6, 7), ("g", 7, 0, 9)], "k string, id int, a int, z int")
    got = [tuple(r) for r in analysis.overlapping(a, b, ["k"]).collect()]
    assert sorted(got) == [("f", 1, 8), ("f", 1, 9), ("f", 2, 8)]
    r = spark.createDataFrame([("x", True), ("x", False), ("y", False)], "k string, p boolean")
    assert {(x.k, x.tries_90) for x in analysis.pass_rates(r, "k", F.col("p")).collect()} == {("x", 3.3219), ("y", math.inf)}


def put(spark, root, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).selectExpr("*", *(["timestamp'2025-01-01' added_at", "cast(null as timestamp) removed_at"] if name == "nodes" else [])).write.parquet(f"{root}/{name}.parquet")
    return str(root)


LIFE = NODE + ", confidence string"


def test_resolvers_take_whole_paths_and_names_and_real_frames(spark, tmp_path):
    ids = dict(zip("abcdefg", (f"{i:016x}" for i in range(1, 8)), strict=True))
    node = lambda k, repo, kind, name, qname, file=None, a=None, z=None: (ids[k], repo, kind, name, qname, None, file, a, z, "Strong")
    nodes = [
        node("a", 1, 9, None, "endpoint:get:/api/cache/${id}"), node("b", 2, 5, "/cache/:id", "route:/cache/:id"), node("c", 2, 5, "/cursor/policy", "route:/cursor/policy"),
        node("d", 3, 5, "/cache/{x}", "GET /cache/{x}"), node("e", 1, 9, None, "endpoint:GET:<unresolved>"), node("f", 1, 3, "f", "m::f", "src/m.py", 4, 9), node("g", 1, 1, "m", "m", "src/m.py", 0, 20),
    ]
    cells = [(ids["b"], 0, 5, 1, '{"method":"GET"}'), (ids["b"], 1, 5, 1, "POST"), (ids["c"], 0, 5, 1, '{"method":"GET"}')]
    root = put(
        spark, tmp_path, nodes=(nodes, LIFE), cells=(cells, "node_id string, ord int, cell_type int, payload_type int, text string"),
        shared_nodes=([("8", 40, "policy", "package:npm:policy"), ("9", 40, "cache", "package:npm:cache"), ("a", 40, "z", "package:npm:z")], "id string, kind int, name string, qname string"),
        documents=([(1, 'File "/srv/src/m.py", line 6, in f'), (1, 'File "/srv/src/m.py", line 6, in f'), (2, "at (x/m.py:2)"), (3, "none")], "doc_id bigint, text string"),
    )
    got = lambda name: {tuple(r) for r in graph.QUERIES[name].run(spark, root).collect()}
    assert got("http_stack") == {(ids["a"], ids["b"], 1, "Strong"), (ids["a"], ids["d"], 1, "Strong")}
    assert got("contains_match") == {("/cursor/policy", "policy"), ("/cache/:id", "cache"), ("/cache/{x}", "cache")}
    assert got("frame_nodes") == {("1:0", ids["f"], 2), ("2:0", ids["g"], 1)}


def test_chains_go_to_the_top_and_cycles_end(spark):
    n = [(str(i), str(i + 1)) for i in range(11)] + [("11", "gone"), ("a", "b"), ("b", "c"), ("c", "a"), ("x", "a"), ("s", "s")]
    got = {tuple(r) for r in traverse.parent_chain(spark.createDataFrame(n, "id string, parent_id string")).collect()}
    want = {(str(i), str(j), j - i) for i in range(12) for j in range(i + 1, 12)}
    want |= {("a", "b", 1), ("a", "c", 2), ("b", "c", 1), ("b", "a", 2), ("c", "a", 1), ("c", "b", 2), ("x", "a", 1), ("x", "b", 2), ("x", "c", 3)}
    assert got == want


@pytest.mark.parametrize(("name", "far"), [("activate", 9), ("activate_backward", 1), ("activate_repair", 9), ("activate_onboard", 9)])
def test_activation_goes_on_until_it_converges(spark, tmp_path, name, far):
    ids = [f"{i:016x}" for i in range(1, 10)]
    root = put(
        spark, tmp_path, nodes=([(x, 1, 3 if k else 5, "f", "m::f", None, "m.py", 0, 1, "Strong") for k, x in enumerate(ids)], LIFE),
        edges=([(k, 1, a, b, 4, "Strong", True) for k, (a, b) in enumerate(zip(ids, ids[1:], strict=False))], "edge_id bigint, repo_id bigint, src string, dst string, category int, confidence string, intra boolean"),
    )
    whole = {r.id: r.score for r in graph.QUERIES[name].run(spark, root).collect()}
    assert len(whole) == far and graph.QUERIES[name].sql is None
    if name == "activate":
        # the last node has no way out: its mass goes back to the seed, which keeps x of all
        x = 0.5 / (1 - 0.5**9)
        assert all(math.isclose(whole[i], x * 0.5**k, abs_tol=1e-5) for k, i in enumerate(ids))
