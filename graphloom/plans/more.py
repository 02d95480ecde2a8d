"""Queries of imports, signals, passes and names; what the tables have no cases of runs over small fixtures, in SQL too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import names as nm
from graphloom.functions import vectors as vec
from graphloom.functions.ids import canonical_id
from graphloom.operators import imports, lookup, passes, resolve, signals, traverse
from graphloom.plans.registry import Registry
from graphloom.schema import NONCRITICAL
from graphloom.sources import graph as g
from graphloom.sources import table
from graphloom.sources.graph import ctes

QUERIES = Registry()


def fixture(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def sql_rows(name: str, schema: str, rows: list[tuple]) -> str:
    """A fixture as a common table expression."""
    cols = [c.split() for c in schema.split(", ")]
    kinds = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "boolean": "BOOLEAN"}
    quote = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    values = ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)
    casts = ", ".join(f"CAST({c} AS {kinds[k]}) AS {c}" for c, k in cols)
    return f"{name} AS (SELECT {casts} FROM (VALUES {values}) t({', '.join(c for c, _ in cols)}))"


# -- lookups


@QUERIES.add("qnames_exact", f"{ctes('n')} SELECT qname, id FROM n WHERE qname IN (SELECT qname FROM activated)")
def qnames_exact(spark: SparkSession, root: str) -> DataFrame:
    """The nodes of exactly the qualified names that were activated."""
    return g.nodes(spark, root).select("qname", "id").join(table(spark, root, "activated").select("qname"), "qname", "left_semi")


@QUERIES.add(
    "node_id_by_qname",
    f"""{ctes('n e')}, d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e WHERE dst IS DISTINCT FROM src)
    WHERE id IS NOT NULL GROUP BY id), r AS (SELECT qname, id, count(*) OVER (PARTITION BY qname) AS candidates,
    row_number() OVER (PARTITION BY qname ORDER BY coalesce(degree, 0) DESC, id) AS k FROM n LEFT JOIN d USING (id)) SELECT qname, id, candidates FROM r WHERE k = 1""",
)
def node_id_by_qname(spark: SparkSession, root: str) -> DataFrame:
    return lookup.pick_primary(g.nodes(spark, root).select("qname", "id"), ["qname"], lookup.degrees(g.edges(spark, root)))


@QUERIES.add(
    "shortest_qnames",
    f"""{ctes('n')}, r AS (SELECT name, qname, id, row_number() OVER (PARTITION BY name ORDER BY NOT regexp_matches(qname, '(^|::)tests?::'), length(qname), qname, id) AS k FROM n WHERE name IS NOT NULL)
    SELECT name, qname, id FROM r WHERE k = 1""",
)
def shortest_qnames(spark: SparkSession, root: str) -> DataFrame:
    """For every name the node that lies in tests, else that of the shortest qualified name."""
    n = g.nodes(spark, root).where("name is not null")
    best = F.min(F.struct((~F.col("qname").rlike("(^|::)tests?::")).alias("t"), F.length("qname").alias("n"), "qname", "id"))
    return n.groupBy("name").agg(best.alias("b")).select("name", "b.qname", "b.id")


# -- reports


@QUERIES.add(
    "build_report",
    f"""{ctes('n e')}, a AS (SELECT repo_id, count(*) AS nodes, count(DISTINCT file) AS files FROM n GROUP BY repo_id),
    b AS (SELECT repo_id, count(CASE WHEN intra THEN 1 END) AS intra_edges, count(CASE WHEN NOT intra THEN 1 END) AS cross_edges FROM e GROUP BY repo_id)
    SELECT repo_id, nodes, files, coalesce(intra_edges, 0) AS intra_edges, coalesce(cross_edges, 0) AS cross_edges FROM a LEFT JOIN b USING (repo_id)""",
)
def build_report(spark: SparkSession, root: str) -> DataFrame:
    """Nodes, files and edges of every repository."""
    a = g.nodes(spark, root).groupBy("repo_id").agg(F.count("*").alias("nodes"), F.count_distinct("file").alias("files"))
    b = g.edges(spark, root).groupBy("repo_id").agg(F.count_if("intra").alias("intra_edges"), F.count_if(~F.col("intra")).alias("cross_edges"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return a.join(b, "repo_id", "left").select("repo_id", "nodes", "files", zero("intra_edges"), zero("cross_edges"))


@QUERIES.add(
    "kind_coverage",
    f"{ctes('n')} SELECT repo_id, bool_or(kind = 1) AS modules, bool_or(kind IN (2, 8)) AS types, bool_or(kind IN (3, 4)) AS functions, bool_or(kind = 5) AS routes FROM n GROUP BY repo_id",
)
def kind_coverage(spark: SparkSession, root: str) -> DataFrame:
    """Which kinds of nodes a repository has at all."""
    has = lambda *k: F.bool_or(F.col("kind").isin(*k))
    return g.nodes(spark, root).groupBy("repo_id").agg(has(1).alias("modules"), has(2, 8).alias("types"), has(3, 4).alias("functions"), has(5).alias("routes"))


_RECEIVER, _MAKER = r"(?m)^func \(\w+ \*?(\w+)\)", r"(?m)^func New(\w+)\("


@QUERIES.add(
    "go_services",
    f"""WITH f AS (SELECT DISTINCT file_id, repo, source FROM files WHERE path LIKE '%.go' AND source IS NOT NULL),
    r AS (SELECT repo, t, count(*) AS methods FROM (SELECT repo, unnest(regexp_extract_all(source, '{_RECEIVER}', 1)) AS t FROM f) GROUP BY repo, t),
    m AS (SELECT DISTINCT repo, t FROM (SELECT repo, unnest(regexp_extract_all(source, '{_MAKER}', 1)) AS t FROM f))
    SELECT repo, t AS name, methods, (repo, t) IN (SELECT repo, t FROM m) AS made FROM r WHERE methods >= 3""",
)
def go_services(spark: SparkSession, root: str) -> DataFrame:
    """Go types with three methods or more in a repository, and whether a function makes them."""
    f = table(spark, root, "files").where("path like '%.go' and source is not null").select("file_id", "repo", "source")
    found = f.select("file_id", "repo", F.regexp_extract_all("source", F.lit(_RECEIVER)).alias("r"), F.regexp_extract_all("source", F.lit(_MAKER)).alias("m")).distinct()
    counts = found.select("repo", F.explode("r").alias("name")).groupBy("repo", "name").agg(F.count("*").alias("methods")).where("methods >= 3")
    makers = found.select("repo", F.explode("m").alias("name")).distinct().withColumn("made", F.lit(True))
    return counts.join(makers, ["repo", "name"], "left").select("repo", "name", "methods", F.coalesce("made", F.lit(False)).alias("made"))


# -- names in texts


@QUERIES.add(
    "text_names",
    r"""WITH w AS (SELECT 'type' AS family, x AS name FROM (SELECT unnest(list_filter(list_transform(range(1, len(string_split(text, '`')) + 1), lambda i: CASE WHEN i % 2 = 0 THEN string_split(text, '`')[i] END),
      lambda x: x IS NOT NULL AND regexp_full_match(x, '[A-Z][A-Za-z0-9_]*'))) AS x FROM documents)
    UNION ALL SELECT 'attribute', unnest(list_distinct(regexp_extract_all(text, '\.([A-Za-z_][A-Za-z0-9_]*)', 1))) FROM documents
    UNION ALL SELECT 'stem', unnest(list_distinct(regexp_extract_all(text, '([A-Za-z0-9_]+)\.(?:py|js|ts|go|java|rs|rb|php|cs)\b', 1))) FROM documents
    UNION ALL SELECT 'camel', unnest(list_distinct(regexp_extract_all(text, '\b((?:[A-Z][a-z0-9]+){2,})\b', 1))) FROM documents)
    SELECT family, name, count(*) AS documents FROM w GROUP BY ALL""",
)
def text_names(spark: SparkSession, root: str) -> DataFrame:
    """Types, attributes, file stems and camel-case words that documents name, with how often."""
    t = F.col("text")
    camel = F.array_distinct(F.regexp_extract_all(t, F.lit(r"\b((?:[A-Z][a-z0-9]+){2,})\b")))
    families = {"type": nm.backtick_types(t), "attribute": nm.dotted_attributes(t), "stem": nm.file_stems(t), "camel": camel}

    def named(family: str, found: Column) -> Column:
        return F.transform(found, lambda x: F.struct(F.lit(family).alias("family"), x.alias("name")))

    pairs = F.concat(*[named(k, c) for k, c in families.items()])
    return table(spark, root, "documents").select(F.explode(pairs).alias("p")).groupBy("p.family", "p.name").agg(F.count("*").alias("documents"))


@QUERIES.add(
    "path_features",
    rf"""WITH f AS (SELECT DISTINCT file_id, path FROM files), x AS (SELECT regexp_extract(path, '(?:^|/)(?:{'|'.join(nm.CONTAINERS)})/([^/]+)', 1) AS name FROM f),
    y AS (SELECT regexp_replace(regexp_replace(lower(name), '\.[a-z]+$', ''), '[._-](?:{'|'.join(nm.FEATURE_SUFFIXES)})$', '') AS feature FROM x)
    SELECT feature, count(*) AS files FROM y WHERE feature <> '' GROUP BY feature""",
)
def path_features(spark: SparkSession, root: str) -> DataFrame:
    f = g.files(spark, root).select(nm.feature(F.col("path")).alias("feature")).where("feature is not null")
    return f.groupBy("feature").agg(F.count("*").alias("files"))


@QUERIES.add(
    "short_labels",
    f"""{ctes('n')} SELECT id, CASE WHEN kind = 4 AND len(string_split(qname, '::')) > 1 THEN array_to_string(string_split(qname, '::')[-2:], '.')
    ELSE string_split(qname, '::')[-1] END AS label FROM n""",
)
def short_labels(spark: SparkSession, root: str) -> DataFrame:
    return g.nodes(spark, root).select("id", nm.short_label(F.col("qname"), F.col("kind")).alias("label"))


@QUERIES.add("source_constants", r"""WITH f AS (SELECT DISTINCT file_id, source FROM files WHERE source IS NOT NULL)
    SELECT file_id, unnest(list_distinct(regexp_extract_all(source, '(?m)^(?:export\s+)?(?:const\s+)?([A-Z][A-Z0-9_]{2,})\s*(?::[^=\n]+)?=[^=]', 1))) AS name FROM f""")  # fmt: skip
def source_constants(spark: SparkSession, root: str) -> DataFrame:
    f = table(spark, root, "files").where("source is not null")
    return f.select("file_id", F.explode(nm.constants(F.col("source"))).alias("name")).distinct()


# -- signals


_TOKEN = r"(?:^|[\s(),])([^\s(),:]*\.[^\s(),:]*[^\s(),:.]):([0-9]+)"
_PYTHON = r'^\s*File "([^"]*)"[^\n]*?line ([0-9]+)'


@QUERIES.add(
    "signal_kinds",
    r"""WITH k AS (SELECT CASE WHEN contains(text, '+++ ') OR contains(text, '--- a/') OR contains(text, chr(10) || '@@ ') THEN 'diff'
      WHEN (contains(text, 'File "') AND contains(text, 'line ')) OR contains(text, '.go:') OR contains(text, chr(10) || '  at ') THEN 'stacktrace'
      WHEN contains(trim(text), '::') AND NOT regexp_matches(trim(text), '\s') THEN 'test' ELSE 'stacktrace' END AS signal FROM documents WHERE text IS NOT NULL)
    SELECT signal, count(*) AS documents FROM k GROUP BY signal""",
)
def signal_kinds(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "documents").where("text is not null").select(signals.signal_kind(F.col("text")).alias("signal"))
    return d.groupBy("signal").agg(F.count("*").alias("documents"))


@QUERIES.add(
    "path_frames",
    rf"""WITH l AS (SELECT doc_id, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS line FROM documents),
    p AS (SELECT doc_id, CASE WHEN regexp_matches(line, '{_PYTHON}') THEN list_zip(regexp_extract_all(line, '{_PYTHON}', 1), regexp_extract_all(line, '{_PYTHON}', 2))
      ELSE list_zip(regexp_extract_all(line, '{_TOKEN}', 1), regexp_extract_all(line, '{_TOKEN}', 2)) END AS f FROM l),
    x AS (SELECT doc_id, unnest(f) AS f FROM p)
    SELECT f[1] AS path, CAST(f[2] AS INTEGER) AS line, count(*) AS frames FROM x WHERE TRY_CAST(f[2] AS INTEGER) IS NOT NULL GROUP BY ALL""",
)
def path_frames(spark: SparkSession, root: str) -> DataFrame:
    """Every place ``path:line`` or Python frame that a document names."""
    d = table(spark, root, "documents").select("doc_id", F.explode(signals.path_frames(F.col("text"))).alias("f"))
    return d.groupBy(F.col("f.path").alias("path"), F.col("f.line").cast("int").alias("line")).agg(F.count("*").alias("frames"))


_DIFFS = ("id int, text string", [
    (1, "--- a/x/m.py\n+++ b/x/m.py\n@@ -3,3 +3,4 @@ def f():\n a\n-b\n+c\n+d\n e\n@@ -20 +30,2 @@\n+z\n"), (2, "+++ /dev/null\n@@ -1 +0,0 @@\n+no\n"), (3, "no diff\n+x"), (4, "+++ b/q.go\tstamp\n@@ -0,0 +1,2 @@\n+one\r\n+two"),
])


@QUERIES.add("diff_frames", "SELECT * FROM (VALUES (1, 'x/m.py', 4), (1, 'x/m.py', 5), (1, 'x/m.py', 30), (4, 'q.go', 1), (4, 'q.go', 2)) t(id, file, line)")
def diff_frames(spark: SparkSession, root: str) -> DataFrame:
    """The lines that the diffs of a fixture add."""
    return signals.diff_frames(fixture(spark, *_DIFFS))


_PLACES = ("id string, kind int, name string, qname string, file string, start_line int, end_line int", [
    ("a", 1, "m", "x::m", "x/m.py", 0, 40), ("b", 2, "C", "x::m::C", "x/m.py", 2, 20), ("c", 4, "go", "x::m::C::go", "x/m.py", 3, 9), ("d", 3, "go", "y::go", "y.py", 1, 2), ("e", 3, "solo", "solo", None, None, None),
])
_SIGNALS = ("id int, text string", [
    (1, _DIFFS[1][0][1]), (2, 'Traceback\n  File "/srv/x/m.py", line 8, in go\n'), (3, "tests/t.py::C::go"), (4, "t.py::solo"), (5, "t.py::go"), (6, "t.py::nothing"), (7, None),
])


@QUERIES.add("resolve_signals", "SELECT * FROM (VALUES (1, 'a'), (1, 'c'), (2, 'c'), (3, 'c'), (4, 'e'), (5, 'd')) t(id, node)")
def resolve_signals(spark: SparkSession, root: str) -> DataFrame:
    """Nodes that the diffs, traces and test ids of a fixture speak of."""
    edges = fixture(spark, "src string, dst string", [("d", "c"), ("d", "e")])
    return signals.resolve_signals(fixture(spark, *_SIGNALS), fixture(spark, *_PLACES), edges)


@QUERIES.add("resolve_file", f"WITH {sql_rows('p', *_PLACES)} SELECT v.path, p.id FROM (VALUES ('/a/b/m.py'), ('none.py'), ('y.py')) v(path) JOIN p ON regexp_extract(p.file, '([^/]*)$', 1) = regexp_extract(v.path, '([^/]*)$', 1)")
def resolve_file(spark: SparkSession, root: str) -> DataFrame:
    return signals.resolve_file(fixture(spark, "path string", [("/a/b/m.py",), ("none.py",), ("y.py",)]), fixture(spark, *_PLACES))


# -- imports and references


_TREE = ("id string, repo_id bigint, kind int, name string, qname string, parent_id string", [
    ("u", 1, 1, "users", "app::users", None), ("h", 1, 1, "helpers", "app::helpers", None), ("p", 1, 1, "app", "app", None), ("au", 1, 1, "auth", "app::auth", None), ("o", 2, 1, "helpers", "app::helpers", None),
    ("hp", 1, 3, "hash_password", "app::helpers::hash_password", "h"), ("in", 1, 3, "_inner", "app::helpers::_inner", "h"), ("U", 1, 2, "User", "app::users::User", "u"), ("lo", 1, 4, "login", "app::users::User::login", "U"),
    ("sa", 1, 4, "save", "app::users::User::save", "U"), ("dl", 1, 3, "do_login", "app::auth::do_login", "au"),
])
_IMPORTS = ("import_id int, repo_id bigint, from_module string, style string, module string, name string, alias string, level int", [
    (1, 1, "app::users", "symbol", "helpers", "hash_password", None, 1), (2, 1, "app::auth", "symbol", "", "helpers", None, 1), (3, 1, "app::auth", "symbol", "app.users", "User", None, 0),
    (4, 1, "app::auth", "module", "app.helpers", None, "hh", 0), (5, 1, "app::auth", "module", "os.path", None, None, 0), (6, 1, "app::auth", "exact", "app::users", None, None, 0), (7, 2, "app::helpers", "symbol", "app.users", "User", None, 0),
])
_SITES = ("site_id int, module string, owner string, shape string, base string, name string, category int", [
    (1, "h", None, "Bare", None, "_inner", 4), (2, "u", "U", "Bare", None, "hash_password", 4), (3, "u", "U", "SelfMethod", None, "login", 4), (4, "au", None, "Bare", None, "User", 4), (5, "au", None, "Attribute", "helpers", "hash_password", 4),
    (6, "au", None, "Attribute", "u", "login", 4), (7, "au", None, "Attribute", "User", "login", 4), (8, "au", None, "Attribute", "x", "save", 9), (9, "au", None, "SuperMethod", None, "save", 4), (10, "au", None, "Bare", None, "do_login", 9),
])


@QUERIES.add(
    "resolve_imports",
    "SELECT * FROM (VALUES (1, 'u', 'h', 'hash_password', 'hp'), (2, 'au', 'h', 'helpers', 'h'), (3, 'au', 'u', 'User', 'U'), (4, 'au', 'h', 'hh', 'h'), (6, 'au', 'u', 'users', 'u')) t(import_id, src, dst, bound, target)",
)
def resolve_imports(spark: SparkSession, root: str) -> DataFrame:
    """Relative, dotted and exact imports of a small package."""
    return imports.resolve_imports(fixture(spark, *_IMPORTS), fixture(spark, *_TREE))


@QUERIES.add(
    "resolve_sites",
    """SELECT * FROM (VALUES (1, 'in', 'scope'), (2, 'hp', 'scope'), (3, 'lo', 'scope'), (4, 'U', 'scope'), (5, 'hp', 'scope'), (6, NULL, 'unresolved'), (7, 'lo', 'scope'), (8, 'sa', 'unique'),
    (9, NULL, 'unresolved'), (10, 'dl', 'scope')) t(site_id, dst, rule)""",
)
def resolve_sites(spark: SparkSession, root: str) -> DataFrame:
    """Calls and references of a small package by what its imports bind."""
    nodes = fixture(spark, *_TREE)
    return imports.resolve_sites(fixture(spark, *_SITES), nodes, imports.bindings(imports.resolve_imports(fixture(spark, *_IMPORTS), nodes)))


@QUERIES.add(
    "resolve_refs",
    f"""{ctes('n')}, u AS (SELECT DISTINCT ref_id, {g._sql_id('from_module')} AS module, shape, name, category FROM unresolved_refs),
    sy AS (SELECT c.parent_id AS module, c.name, max(c.id) AS id FROM n c JOIN n p ON c.parent_id = p.id WHERE p.kind = 1 AND c.name IS NOT NULL GROUP BY ALL),
    me AS (SELECT c.parent_id AS owner, c.name, max(c.id) AS id FROM n c JOIN n p ON c.parent_id = p.id WHERE p.kind IN (2, 8) AND c.kind = 4 AND c.name IS NOT NULL GROUP BY ALL),
    so AS (SELECT name, min(id) AS id FROM sy GROUP BY name HAVING count(*) = 1), mo AS (SELECT name, min(id) AS id FROM me GROUP BY name HAVING count(*) = 1),
    r AS (SELECT ref_id, CASE WHEN shape = 'Bare' THEN sy.id END AS hit, CASE WHEN category = 9 AND shape = 'Bare' THEN so.id WHEN category = 9 AND shape = 'Attribute' THEN mo.id END AS sole
      FROM u LEFT JOIN sy ON u.module = sy.module AND u.name = sy.name LEFT JOIN so ON u.name = so.name LEFT JOIN mo ON u.name = mo.name)
    SELECT ref_id AS site_id, coalesce(hit, sole) AS dst, CASE WHEN hit IS NOT NULL THEN 'scope' WHEN sole IS NOT NULL THEN 'unique' ELSE 'unresolved' END AS rule FROM r""",
)
def resolve_refs(spark: SparkSession, root: str) -> DataFrame:
    """References that no import binds (the tables hold no import statements): by module and by unique name."""
    refs = table(spark, root, "unresolved_refs").select(
        F.col("ref_id").alias("site_id"), canonical_id(F.col("from_module")).alias("module"), F.lit(None).cast("string").alias("owner"), "shape", "base", "name", "category"
    ).dropDuplicates(["site_id"])
    none = fixture(spark, "module string, bound string, target string", [])
    return imports.resolve_sites(refs, g.nodes(spark, root), none)


# -- passes


@QUERIES.add(
    "settled_confidence",
    f"""{ctes('n e')}, t AS (SELECT src AS id FROM e WHERE category = 10 UNION SELECT dst FROM e WHERE category = 10),
    c AS (SELECT id, kind, CASE WHEN NOT starts_with(qname, 'route:') AND len(list_intersect(string_split(lower(qname), '::'), [{', '.join(repr(x) for x in NONCRITICAL)}])) > 0
      THEN 'Weak' ELSE confidence END AS c FROM n), z AS (SELECT kind, CASE WHEN c <> 'Weak' AND kind IN (5, 9) AND id NOT IN (SELECT id FROM t WHERE id IS NOT NULL) THEN 'Medium' ELSE c END AS confidence FROM c)
    SELECT kind, confidence, count(*) AS nodes FROM z GROUP BY ALL""",
)
def settled_confidence(spark: SparkSession, root: str) -> DataFrame:
    settled = passes.settle_confidence(g.nodes(spark, root).select("id", "kind", "qname", "confidence"), g.edges(spark, root))
    return settled.groupBy("kind", "confidence").agg(F.count("*").alias("nodes"))


_MODULES = ("id string, kind int, qname string", [
    ("a", 1, "app::core::users"), ("b", 1, "app::tests::test_users"), ("c", 1, "lib::users"), ("d", 1, "app::core::users_test"), ("e", 1, "tests::test_none"), ("f", 3, "app::users"), ("g", 1, "q::a::x::jobs"), ("h", 1, "q::b::x::jobs"),
    ("i", 1, "q::c::x::jobs"), ("j", 1, "q::d::x::jobs"), ("k", 1, "q::tests::jobs_spec"),
])


@QUERIES.add("test_edges", "SELECT * FROM (VALUES ('b', 'a'), ('d', 'a'), ('k', 'g'), ('k', 'h'), ('k', 'i')) t(src, dst)")
def test_edges(spark: SparkSession, root: str) -> DataFrame:
    """Test modules of a fixture with what they test."""
    return passes.test_edges(fixture(spark, *_MODULES))


_ORIGINS = ("id string, repo string, kind int, qname string, file string", [
    ("a", "r", 3, "x::f", "src/x.py"), ("b", "r", 3, "v::f", "vendor/lib/v.py"), ("c", "r", 3, "v::g", "vendor/own/v.py"), ("d", "r", 40, "package:npm:x", None), ("e", "r", 3, "s", None), ("f", "r", 3, "p", "api/x_pb2.py"), ("g", "q", 3, "v", "vendor/lib/v.py"),
    ("h", "r", 3, "o", "src/o.py"),
])


@QUERIES.add(
    "provenance", "SELECT * FROM (VALUES ('a', 'authored'), ('b', 'vendored'), ('c', 'authored'), ('d', 'dependency'), ('e', 'synthetic'), ('f', 'generated'), ('g', 'authored'), ('h', 'build_output')) t(id, provenance)"
)
def provenance(spark: SparkSession, root: str) -> DataFrame:
    """Where the nodes of a fixture come from, by cell, kind, region and name."""
    cells = fixture(spark, "node_id string, cell_type int, text string", [("h", 15, '{"provenance":"build_output"}'), ("a", 2, "doc")])
    regions = fixture(spark, "repo string, prefix string, provenance string", [("r", "vendor", "vendored"), ("r", "vendor/own", "authored")])
    return passes.provenance(fixture(spark, *_ORIGINS), cells, regions)


@QUERIES.add(
    "ancestors",
    f"""WITH RECURSIVE {g.SQL['n']}, {g.SQL['e']}, u AS (SELECT DISTINCT src, dst FROM e WHERE category = 20 AND src <> dst),
    w AS (SELECT n.id, u.dst AS ancestor FROM n JOIN u ON n.id = u.src WHERE kind IN (2, 8) UNION SELECT w.id, u.dst FROM w JOIN u ON w.ancestor = u.src WHERE w.id <> u.dst) SELECT id, ancestor FROM w""",
)
def ancestors(spark: SparkSession, root: str) -> DataFrame:
    return passes.ancestors(g.edges(spark, root), g.nodes(spark, root).where("kind in (2, 8)"))


@QUERIES.add(
    "call_chains",
    f"""WITH RECURSIVE {g.SQL['n']}, {g.SQL['e']}, c AS (SELECT DISTINCT src, dst FROM e WHERE category = 4 AND src IS NOT NULL AND dst IS NOT NULL),
    w AS (SELECT id AS anchor, id, 0 AS depth FROM n WHERE kind = 5 UNION SELECT anchor, dst, depth + 1 FROM w JOIN c ON w.id = c.src WHERE depth < 3)
    SELECT anchor, id, min(depth) AS depth FROM w GROUP BY anchor, id HAVING min(depth) > 0""",
)
def call_chains(spark: SparkSession, root: str) -> DataFrame:
    """What each route calls in three steps."""
    return passes.call_chains(g.edges(spark, root), g.nodes(spark, root).where("kind = 5").select(F.col("id").alias("anchor")), 3)


@QUERIES.add(
    "depth_histogram",
    f"""WITH RECURSIVE {g.SQL['n']}, {g.SQL['e']}, c AS (SELECT DISTINCT src, dst FROM e WHERE category = 4 AND src IS NOT NULL AND dst IS NOT NULL),
    w AS (SELECT id, 0 AS depth FROM n WHERE kind = 5 UNION SELECT dst, depth + 1 FROM w JOIN c ON w.id = c.src WHERE depth < 8), m AS (SELECT id, min(depth) AS depth FROM w GROUP BY id)
    SELECT depth, count(*) AS ids FROM m WHERE depth > 0 GROUP BY depth""",
)
def depth_histogram(spark: SparkSession, root: str) -> DataFrame:
    return passes.handlers_reached(g.edges(spark, root), g.nodes(spark, root).where("kind = 5").select("id"))


# -- stacks of services


_KEYS = ("id string, repo bigint, key string, confidence string", [
    ("c1", 1, "Users.Get", "Strong"), ("c2", 1, "Orders", "Medium"), ("c3", 2, "Users.List", "Strong"), ("c4", 3, None, "Strong"), ("c5", 3, "/Chat/room", "Weak"), ("c6", 3, "ws", "Strong"),
])
_SERVERS = ("id string, repo bigint, key string, confidence string", [("s1", 2, "Users", "Strong"), ("s2", 1, "Users", "Weak"), ("s3", 3, "Orders", "Strong"), ("s4", 1, "room", "Strong"), ("s5", 2, "default", "Medium")])


def _keyed_sql(key: str) -> str:
    rank = lambda c: f"CASE {c} WHEN 'Strong' THEN 2 WHEN 'Medium' THEN 1 ELSE 0 END"
    return f"""WITH {sql_rows('a', *_KEYS)}, {sql_rows('b', *_SERVERS)} SELECT a.id AS src, b.id AS dst,
    CASE least({rank('a.confidence')}, {rank('b.confidence')}) WHEN 2 THEN 'Strong' WHEN 1 THEN 'Medium' ELSE 'Weak' END AS confidence FROM a JOIN b ON {key} = b.key AND a.repo <> b.repo"""


@QUERIES.add("grpc_stack", _keyed_sql("split_part(a.key, '.', 1)"))
def grpc_stack(spark: SparkSession, root: str) -> DataFrame:
    """gRPC clients of a fixture with the services of other repositories that they call."""
    return resolve.grpc_stack(fixture(spark, *_KEYS), fixture(spark, *_SERVERS))


@QUERIES.add("queue_stack", _keyed_sql("a.key"))
def queue_stack(spark: SparkSession, root: str) -> DataFrame:
    """Producers with the consumers of their topic; events and commands meet by their names in the same way."""
    return resolve.match_by_key(fixture(spark, *_KEYS), fixture(spark, *_SERVERS))


@QUERIES.add(
    "websocket_stack",
    f"""WITH {sql_rows('a', *_KEYS)}, {sql_rows('b', *_SERVERS)}, x AS (SELECT id, lower(trim(key)) AS k FROM a WHERE key IS NOT NULL), y AS (SELECT id, lower(trim(key)) AS k FROM b WHERE key IS NOT NULL)
    SELECT x.id AS src, y.id AS dst FROM x, y WHERE ends_with(x.k, y.k) OR ends_with(y.k, x.k) OR x.k = 'ws' OR y.k IN ('ws', 'default')""",
)
def websocket_stack(spark: SparkSession, root: str) -> DataFrame:
    return resolve.suffix_match(fixture(spark, *_KEYS), fixture(spark, *_SERVERS))


# -- vectors


@QUERIES.add(
    "vector_tops",
    """WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), t AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x)) / len(v) + 1e-6) AS scale FROM s)
    SELECT vec_id, CAST(list_position(v, list_max(v)) - 1 AS INTEGER) AS top, CAST(len(list_filter(v, lambda x: x > v[1])) AS INTEGER) AS rank_of_first, round(v[1] / scale, 6) AS first_normed FROM t""",
)
def vector_tops(spark: SparkSession, root: str) -> DataFrame:
    """The place of the largest value, the rank of the first value, and the first value after RMS normalisation."""
    v = F.col("embedding")
    return table(spark, root, "embeddings").select(
        "vec_id", F.element_at(vec.top_places(v, 1), 1).cast("int").alias("top"), vec.rank_of(v, F.lit(0)).alias("rank_of_first"), F.round(F.element_at(vec.rms_norm(v), 1), 6).alias("first_normed")
    )


@QUERIES.add(
    "vector_divergence",
    """WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE) - CAST(list_max(embedding) AS DOUBLE))) AS e FROM embeddings), p AS (SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS p FROM s)
    SELECT vec_id, round(list_sum(list_transform(p, lambda x: CASE WHEN x >= 1e-12 THEN x * ln(x * len(p)) ELSE 0 END)), 6) AS divergence FROM p""",
)
def vector_divergence(spark: SparkSession, root: str) -> DataFrame:
    """How far the softmax of each vector is from the even distribution."""
    p = vec.softmax(F.col("embedding"))
    even = F.transform("embedding", lambda x: F.lit(1.0) / F.size("embedding"))
    return table(spark, root, "embeddings").select("vec_id", F.round(vec.kl(p, even), 6).alias("divergence"))


@QUERIES.add("activate_top")
def activate_top(spark: SparkSession, root: str) -> DataFrame:
    """The 100 nodes of the highest personalised PageRank from the routes."""
    return traverse.activate(g.nodes(spark, root), g.edges(spark, root), g.nodes(spark, root).where("kind = 5").select("id"), top=100)
