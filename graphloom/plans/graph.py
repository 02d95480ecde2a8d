"""Queries over the code graph: histograms, lookups, resolvers, walks, activation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.functions import text as tx
from graphloom.operators import lookup, resolve, traverse
from graphloom.plans.registry import Registry
from graphloom.sources import graph as g
from graphloom.sources import table
from graphloom.sources.graph import ctes

QUERIES = Registry()
_CONF = "CASE confidence WHEN 'Strong' THEN 2 WHEN 'Medium' THEN 1 ELSE 0 END"
_NAMED = "CASE r WHEN 2 THEN 'Strong' WHEN 1 THEN 'Medium' ELSE 'Weak' END"


# -- aggregation


@QUERIES.add("kind_histogram", f"{ctes('n')} SELECT {schema.named_sql('kind', schema.KINDS)} AS kind_name, count(*) AS nodes FROM n GROUP BY 1")
def kind_histogram(spark: SparkSession, root: str) -> DataFrame:
    n = g.nodes(spark, root)
    return n.groupBy(schema.named(F.col("kind"), schema.KINDS).alias("kind_name")).agg(F.count("*").alias("nodes"))


@QUERIES.add(
    "category_histogram", f"{ctes('e')} SELECT {schema.named_sql('category', schema.CATEGORIES)} AS category_name, count(*) AS edges FROM e GROUP BY 1"
)
def category_histogram(spark: SparkSession, root: str) -> DataFrame:
    e = g.edges(spark, root)
    return e.groupBy(schema.named(F.col("category"), schema.CATEGORIES).alias("category_name")).agg(F.count("*").alias("edges"))


@QUERIES.add(
    "totals",
    f"""{ctes('n e')} SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e WHERE intra) AS intra_edges,
    (SELECT count(*) FROM e WHERE NOT intra) AS cross_edges, (SELECT count(*) FROM parse_errors WHERE trim(entry) <> '') AS parse_errors""",
)
def totals(spark: SparkSession, root: str) -> DataFrame:
    n = g.nodes(spark, root).agg(F.count("*").alias("nodes"))
    e = g.edges(spark, root).agg(F.count_if("intra").alias("intra_edges"), F.count_if(~F.col("intra")).alias("cross_edges"))
    p = table(spark, root, "parse_errors").agg(F.count_if(F.trim("entry") != "").alias("parse_errors"))
    one = lambda df: df.withColumn("k", F.lit(1))  # noqa: E731 - each side is one row
    return one(n).join(one(e), "k").join(one(p), "k").drop("k")


@QUERIES.add(
    "service_graph",
    f"""{ctes('n s e')}, o AS (SELECT id, repo_id FROM n UNION ALL SELECT id, NULL FROM s WHERE id NOT IN (SELECT id FROM n))
    SELECT a.repo_id AS from_repo, b.repo_id AS to_repo, category, count(*) AS edges FROM e JOIN o a ON e.src = a.id JOIN o b ON e.dst = b.id
    WHERE a.repo_id <> b.repo_id GROUP BY ALL""",
)
def service_graph(spark: SparkSession, root: str) -> DataFrame:
    """Edges between repositories; ends are joined after edges between two ids are counted, which takes hubs apart."""
    owner = g.nodes(spark, root).select("id", "repo_id")
    counted = g.edges(spark, root).groupBy("src", "dst", "category").agg(F.count("*").alias("n"))
    a, b = owner.select(F.col("id").alias("src"), F.col("repo_id").alias("from_repo")), owner.select(F.col("id").alias("dst"), F.col("repo_id").alias("to_repo"))
    by_src = counted.join(a, "src").groupBy("from_repo", "dst", "category").agg(F.sum("n").alias("n"))
    return by_src.join(b, "dst").where("from_repo <> to_repo").groupBy("from_repo", "to_repo", "category").agg(F.sum("n").alias("edges"))


@QUERIES.add("rollup_kinds", f"{ctes('n')} SELECT repo_id, kind, count(*) AS nodes FROM n GROUP BY ROLLUP (repo_id, kind)")
def rollup_kinds(spark: SparkSession, root: str) -> DataFrame:
    return g.nodes(spark, root).rollup("repo_id", "kind").agg(F.count("*").alias("nodes"))


@QUERIES.add("cube_confidence", f"{ctes('e')} SELECT category, confidence, count(*) AS edges FROM e GROUP BY CUBE (category, confidence)")
def cube_confidence(spark: SparkSession, root: str) -> DataFrame:
    return g.edges(spark, root).cube("category", "confidence").agg(F.count("*").alias("edges"))


@QUERIES.add(
    "majority_defaults",
    f"""{ctes('n')}, k AS (SELECT 'kind' AS field, CAST(kind AS VARCHAR) AS value, count(*) AS nodes FROM n GROUP BY 2 UNION ALL
    SELECT 'confidence', confidence, count(*) FROM n GROUP BY 2) SELECT field, value, nodes FROM k WHERE nodes > (SELECT count(*) FROM n) // 2""",
)
def majority_defaults(spark: SparkSession, root: str) -> DataFrame:
    fields = F.array(
        F.struct(F.lit("kind").alias("field"), F.col("kind").cast("string").alias("value")),
        F.struct(F.lit("confidence").alias("field"), F.col("confidence").alias("value")),
    )
    counts = g.nodes(spark, root).select(F.explode(fields).alias("f")).groupBy("f.field", "f.value").agg(F.count("*").alias("nodes"))
    total = F.sum("nodes").over(W.partitionBy("field"))
    return counts.withColumn("t", total).where("nodes > t div 2").drop("t")


@QUERIES.add(
    "prefix_scopes",
    f"""{ctes('n')}, p AS (SELECT regexp_replace(qname, '::[^:]*$', '') AS prefix FROM n WHERE qname LIKE '%::%'), q AS (
    SELECT prefix, count(*) AS uses FROM p WHERE length(prefix) >= 10 GROUP BY prefix HAVING count(*) >= 3)
    SELECT prefix, uses, uses * (length(prefix) - 3) - (length(prefix) + 6) AS saving FROM q ORDER BY saving DESC, prefix LIMIT 25""",
)
def prefix_scopes(spark: SparkSession, root: str) -> DataFrame:
    """The 25 prefixes that save most when an alias of three letters stands for them."""
    p = g.nodes(spark, root).where(F.col("qname").contains("::")).select(F.regexp_replace("qname", "::[^:]*$", "").alias("prefix"))
    uses = p.where(F.length("prefix") >= 10).groupBy("prefix").agg(F.count("*").alias("uses")).where("uses >= 3")
    saving = F.col("uses") * (F.length("prefix") - 3) - (F.length("prefix") + 6)
    return uses.withColumn("saving", saving).orderBy(F.desc("saving"), "prefix").limit(25)


@QUERIES.add(
    "library_names",
    f"""{ctes('n c')}, l AS (SELECT DISTINCT repo_id, unnest(from_json(text, '["VARCHAR"]')) AS lib FROM c JOIN n ON c.node_id = n.id WHERE cell_type = 16),
    r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY lib) AS k FROM l)
    SELECT repo_id, string_agg(lib, ',' ORDER BY lib) AS libraries FROM r WHERE k <= 10 GROUP BY repo_id""",
)
def library_names(spark: SparkSession, root: str) -> DataFrame:
    libs = g.cells(spark, root).where("cell_type = 16").select(F.col("node_id").alias("id"), F.explode(F.from_json("text", "array<string>")).alias("lib"))
    per = libs.join(g.nodes(spark, root).select("id", "repo_id"), "id").groupBy("repo_id").agg(F.collect_set("lib").alias("libs"))
    return per.select("repo_id", F.array_join(F.slice(F.array_sort("libs"), 1, 10), ",").alias("libraries"))


@QUERIES.add(
    "file_scores",
    f"""{ctes('n')}, a AS (SELECT DISTINCT seeds_id, {g._sql_id('id')} AS id, qname, score FROM activated WHERE score IS NOT NULL AND NOT isnan(score)),
    t AS (SELECT file, count(*) AS entries, round(CAST(sum(CAST(score AS DECIMAL(30,12))) AS DOUBLE), 4) AS score FROM a JOIN n USING (id) WHERE file IS NOT NULL GROUP BY file)
    SELECT * FROM t ORDER BY score DESC, file LIMIT 50""",
)
def file_scores(spark: SparkSession, root: str) -> DataFrame:
    """The 50 files that gather most activation, with entries summed by id before they meet the nodes."""
    from graphloom.functions.ids import canonical_id

    a = table(spark, root, "activated").select("seeds_id", canonical_id(F.col("id")).alias("id"), "qname", "score")
    a = a.where("score is not null and not isnan(score)").distinct().groupBy("id").agg(F.count("*").alias("k"), F.sum(F.col("score").cast("decimal(30,12)")).alias("s"))
    n = g.nodes(spark, root).where("file is not null").select("id", "file")
    per = a.join(n, "id").groupBy("file").agg(F.sum("k").alias("entries"), F.round(F.sum("s").cast("double"), 4).alias("score"))
    return per.orderBy(F.desc("score"), "file").limit(50)


# -- lookups


@QUERIES.add("kind_index", f"{ctes('n')} SELECT kind, count(*) AS nodes, min(id) AS first_id, max(id) AS last_id FROM n GROUP BY kind")
def kind_index(spark: SparkSession, root: str) -> DataFrame:
    return g.nodes(spark, root).groupBy("kind").agg(F.count("*").alias("nodes"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@QUERIES.add("nodes_of_kind", f"{ctes('n')} SELECT id, qname FROM n WHERE kind = 2")
def nodes_of_kind(spark: SparkSession, root: str) -> DataFrame:
    return g.nodes(spark, root).where("kind = 2").select("id", "qname")


@QUERIES.add("qname_contains", f"{ctes('n')} SELECT id, qname FROM n WHERE contains(qname, 'ledger') AND contains(lower(qname), 'trace')")
def qname_contains(spark: SparkSession, root: str) -> DataFrame:
    n = g.nodes(spark, root)
    return n.where(F.col("qname").contains("ledger") & F.lower("qname").contains("trace")).select("id", "qname")


@QUERIES.add(
    "degrees",
    f"""{ctes('e')}, d AS (SELECT src AS id FROM e UNION ALL SELECT dst FROM e WHERE dst IS DISTINCT FROM src)
    SELECT id, count(*) AS degree FROM d WHERE id IS NOT NULL GROUP BY id""",
)
def degrees(spark: SparkSession, root: str) -> DataFrame:
    return lookup.degrees(g.edges(spark, root))


@QUERIES.add(
    "resolve_name",
    f"""{ctes('n e')}, d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e WHERE dst IS DISTINCT FROM src)
    WHERE id IS NOT NULL GROUP BY id), r AS (SELECT name, id, count(*) OVER (PARTITION BY name) AS candidates,
    row_number() OVER (PARTITION BY name ORDER BY coalesce(degree, 0) DESC, id) AS k FROM n LEFT JOIN d USING (id) WHERE name IS NOT NULL)
    SELECT name, id, candidates FROM r WHERE k = 1""",
)
def resolve_name(spark: SparkSession, root: str) -> DataFrame:
    named = g.nodes(spark, root).where("name is not null").select("name", "id")
    return lookup.pick_primary(named, ["name"], lookup.degrees(g.edges(spark, root)))


@QUERIES.add(
    "resolve_span",
    f"""{ctes('n e')}, d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e WHERE dst IS DISTINCT FROM src)
    WHERE id IS NOT NULL GROUP BY id), w AS (SELECT DISTINCT regexp_extract(qname, '([^:]+::[^:]+)$', 1) AS q FROM n WHERE kind = 4),
    h AS (SELECT q, id, qname, row_number() OVER (PARTITION BY q ORDER BY qname <> q, coalesce(degree, 0) DESC, id) AS k
      FROM n JOIN w ON regexp_extract(qname, '([^:]+::[^:]+)$', 1) = q LEFT JOIN d USING (id))
    SELECT replace(q, '::', '.') AS span, id, qname FROM h WHERE k = 1""",
)
def resolve_span(spark: SparkSession, root: str) -> DataFrame:
    n = g.nodes(spark, root)
    spans = n.where("kind = 4").select(F.replace(F.regexp_extract("qname", "([^:]+::[^:]+)$", 1), F.lit("::"), F.lit(".")).alias("span"))
    return lookup.resolve_span(spans, n, lookup.degrees(g.edges(spark, root)))


@QUERIES.add(
    "cluster_keys",
    f"""{ctes('n')} SELECT CASE WHEN len(string_split(qname, '::')) > 1 THEN array_to_string(list_slice(string_split(qname, '::'), 1,
    least(2, len(string_split(qname, '::')) - 1)), '::') ELSE '' END AS cluster, count(*) AS nodes FROM n GROUP BY 1""",
)
def cluster_keys(spark: SparkSession, root: str) -> DataFrame:
    return g.nodes(spark, root).groupBy(tx.cluster_key(F.col("qname"), 2).alias("cluster")).agg(F.count("*").alias("nodes"))


@QUERIES.add(
    "induced_subset",
    f"""{ctes('n e')}, k AS (SELECT id FROM n WHERE kind IN (3, 4)) SELECT category, count(*) AS edges FROM e
    WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k) GROUP BY category""",
)
def induced_subset(spark: SparkSession, root: str) -> DataFrame:
    _, inside = lookup.induced(g.nodes(spark, root), g.edges(spark, root), F.col("kind").isin(3, 4))
    return inside.groupBy("category").agg(F.count("*").alias("edges"))


@QUERIES.add(
    "neighbours", f"{ctes('n e')} SELECT id, count(*) AS outgoing, count(DISTINCT dst) AS targets, count(DISTINCT category) AS categories FROM n JOIN e ON id = src WHERE kind = 1 GROUP BY id"
)
def neighbours(spark: SparkSession, root: str) -> DataFrame:
    per = g.edges(spark, root).groupBy(F.col("src").alias("id")).agg(
        F.count("*").alias("outgoing"), F.count_distinct("dst").alias("targets"), F.count_distinct("category").alias("categories")
    )
    return per.join(g.nodes(spark, root).where("kind = 1").select("id"), "id", "left_semi")


@QUERIES.add(
    "node_cells",
    f"""{ctes('c')} SELECT node_id, count(*) AS cells, string_agg({schema.named_sql('cell_type', schema.CELLS)}, ',' ORDER BY cell_type, ord) AS types
    FROM c GROUP BY node_id""",
)
def node_cells(spark: SparkSession, root: str) -> DataFrame:
    c = g.cells(spark, root).groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("cell_type", "ord"))).alias("l"))
    return c.select("node_id", F.size("l").cast("bigint").alias("cells"), F.array_join(F.transform("l", lambda x: schema.named(x.cell_type, schema.CELLS)), ",").alias("types"))


@QUERIES.add(
    "unique_or_nothing",
    f"{ctes('n')} SELECT repo_id, name, min(id) AS id FROM n WHERE kind IN (3, 4) AND name IS NOT NULL GROUP BY repo_id, name HAVING count(*) = 1",
)
def unique_or_nothing(spark: SparkSession, root: str) -> DataFrame:
    return lookup.unique_or_nothing(g.nodes(spark, root).where("kind in (3, 4) and name is not null"), ["repo_id", "name"])


@QUERIES.add(
    "predicates",
    f"""{ctes('n')} SELECT kind IN (2, 7, 8) AND regexp_matches(qname, '{'|'.join(schema.SCHEMA_HINTS)}') AS schema_type,
    len(list_intersect(string_split(lower(qname), '::'), [{', '.join(repr(x) for x in schema.NONCRITICAL)}])) > 0 AS noncritical,
    kind IN {schema.LINKABLE} AS linkable, count(*) AS nodes FROM n GROUP BY ALL""",
)
def predicates(spark: SparkSession, root: str) -> DataFrame:
    return g.nodes(spark, root).groupBy(
        tx.is_schema_type(F.col("qname"), F.col("kind")).alias("schema_type"),
        tx.is_noncritical(F.col("qname")).alias("noncritical"),
        F.col("kind").isin(*schema.LINKABLE).alias("linkable"),
    ).agg(F.count("*").alias("nodes"))


@QUERIES.add(
    "word_search",
    f"{ctes('n')} SELECT qname, id FROM n WHERE (contains(lower(qname), 'stale') OR contains(lower(name), 'stale')) AND (contains(lower(qname), 'queue') OR contains(lower(name), 'queue'))",
)
def word_search(spark: SparkSession, root: str) -> DataFrame:
    """Nodes with every word of a query in their name or qualified name."""
    words = F.array(F.lit("stale"), F.lit("queue"))
    q, n = F.lower("qname"), F.lower(F.coalesce("name", F.lit("")))
    return g.nodes(spark, root).where(F.forall(words, lambda w: q.contains(w) | n.contains(w))).select("qname", "id")


# -- resolvers


def _shared(spark: SparkSession, root: str, kind: int) -> DataFrame:
    """Repositories that refer to shared nodes of a kind."""
    s = g.shared_nodes(spark, root).where(F.col("kind") == kind).select(F.col("id").alias("dst"), F.col("qname").alias("key"))
    e = g.edges(spark, root).groupBy("repo_id", "dst").agg(F.max(schema.conf_rank(F.col("confidence"))).alias("r"))
    return e.join(s, "dst").select(F.col("repo_id").alias("repo"), "key", schema.from_rank(F.col("r")).alias("confidence"))


def _shared_sql(kind: int) -> str:
    return f"""{ctes('s e')}, o AS (SELECT e.repo_id AS repo, qname AS key, max({_CONF}) AS r FROM e JOIN s ON e.dst = s.id WHERE s.kind = {kind} GROUP BY ALL),
    p AS (SELECT a.repo AS repo_a, b.repo AS repo_b, count(*) AS shared, min(least(a.r, b.r)) AS r FROM o a JOIN o b ON a.key = b.key AND a.repo < b.repo GROUP BY ALL)
    SELECT repo_a, repo_b, shared, {_NAMED} AS weakest FROM p"""


@QUERIES.add("shared_packages", _shared_sql(40))
def shared_packages(spark: SparkSession, root: str) -> DataFrame:
    return resolve.pair_across_repos(_shared(spark, root, 40))


@QUERIES.add("shared_config", _shared_sql(38))
def shared_config(spark: SparkSession, root: str) -> DataFrame:
    return resolve.pair_across_repos(_shared(spark, root, 38))


@QUERIES.add(
    "shared_schema",
    f"""{ctes('n')}, o AS (SELECT c.repo_id AS repo, c.name AS key, max(CASE p.confidence WHEN 'Strong' THEN 2 WHEN 'Medium' THEN 1 ELSE 0 END) AS r
    FROM n c JOIN n p ON c.parent_id = p.id WHERE c.kind IN (2, 8) AND p.kind = 1 AND c.name IS NOT NULL GROUP BY ALL),
    p AS (SELECT a.repo AS repo_a, b.repo AS repo_b, count(*) AS shared, min(least(a.r, b.r)) AS r FROM o a JOIN o b ON a.key = b.key AND a.repo < b.repo GROUP BY ALL)
    SELECT repo_a, repo_b, shared, {_NAMED} AS weakest FROM p""",
)
def shared_schema(spark: SparkSession, root: str) -> DataFrame:
    """Types of one simple name in two repositories, with the confidence of their modules."""
    n = g.nodes(spark, root)
    modules = n.where("kind = 1").select(F.col("id").alias("parent_id"), "confidence")
    types = n.where("kind in (2, 8) and name is not null").select(F.col("repo_id").alias("repo"), F.col("name").alias("key"), "parent_id")
    return resolve.pair_across_repos(types.join(modules, "parent_id"))


_VERB = "coalesce(json_extract_string(CASE WHEN json_valid(text) THEN text END, '$.method'), CASE WHEN NOT starts_with(ltrim(text), '{') THEN trim(text) END)"
_PARTS = """list_transform(list_filter(string_split(trim(path), '/'), lambda x: x <> ''),
      lambda x: CASE WHEN starts_with(x, ':') OR (starts_with(x, '{') AND ends_with(x, '}')) OR contains(x, '${') THEN '{}' ELSE x END)"""
_OPTIONAL = ", ".join(f"'{x}'" for x in resolve.OPTIONAL_SEGMENTS)


@QUERIES.add(
    "http_stack",
    f"""{ctes('n c')}, en AS (SELECT id, repo_id AS repo, upper(regexp_extract(qname, '^endpoint:([^:]*):', 1)) AS method, regexp_extract(qname, '^endpoint:[^:]*:(.*)$', 1) AS path, {_CONF} AS r
      FROM n WHERE kind = 9 AND qname LIKE 'endpoint:%:%'), rt AS (
    SELECT DISTINCT id, repo, upper(method) AS method, path, r FROM (
      SELECT n.id, repo_id AS repo, {_VERB} AS method, regexp_replace(qname, '^route:', '') AS path, {_CONF} AS r FROM n JOIN c ON c.node_id = n.id
        WHERE kind = 5 AND cell_type = 5 AND qname LIKE 'route:%'
      UNION ALL SELECT id, repo_id, regexp_extract(qname, '^([^ ]+) ', 1), regexp_replace(qname, '^[^ ]+ ', ''), {_CONF} FROM n WHERE kind = 5 AND regexp_matches(qname, '^[^ ]+ /')) WHERE method IS NOT NULL),
    ep AS (SELECT *, {_PARTS} AS p FROM en WHERE path <> '<unresolved>'), rp AS (SELECT *, '/' || array_to_string({_PARTS}, '/') AS key FROM rt),
    lv AS (SELECT *, 0 AS level, '/' || array_to_string(p, '/') AS key FROM ep UNION ALL SELECT *, 1, '/' || array_to_string(p[2:], '/') FROM ep WHERE p[1] IN ({_OPTIONAL})
      UNION ALL SELECT *, 2, '/' || array_to_string(p[3:], '/') FROM ep WHERE p[1] IN ({_OPTIONAL}) AND p[2] IN ({_OPTIONAL})),
    h AS (SELECT lv.id AS src, rp.id AS dst, level, least(lv.r, rp.r) AS r, min(level) OVER (PARTITION BY lv.id) AS best FROM lv JOIN rp USING (method, key) WHERE lv.repo <> rp.repo)
    SELECT DISTINCT src, dst, level, {_NAMED} AS confidence FROM h WHERE level = best""",
)
def http_stack(spark: SparkSession, root: str) -> DataFrame:
    """HTTP endpoints with the routes of other repositories that have their method and whole path."""
    n = g.nodes(spark, root).select("id", F.col("repo_id").alias("repo"), "kind", "qname", "confidence")
    part = lambda i: F.regexp_extract("qname", r"^endpoint:([^:]*):([\s\S]*)$", i)
    ends = n.where("kind = 9 and qname like 'endpoint:%:%'").select("id", "repo", part(1).alias("method"), part(2).alias("path"), "confidence")
    routes = n.where("kind = 5")
    said = F.coalesce(F.get_json_object("text", "$.method"), F.when(~F.ltrim("text").startswith("{"), F.trim("text")))
    verbs = g.cells(spark, root).where("cell_type = 5").select(F.col("node_id").alias("id"), said.alias("method")).where("method is not null")
    stacked = routes.where("qname like 'route:%'").join(verbs, "id").select("id", "repo", "method", F.regexp_replace("qname", "^route:", "").alias("path"), "confidence")
    # some front ends name a route by its method and path
    spelled = routes.where(r"qname rlike '^[^ ]+ /'").select(
        "id", "repo", F.substring_index("qname", " ", 1).alias("method"), F.regexp_replace("qname", "^[^ ]+ ", "").alias("path"), "confidence"
    )
    return resolve.http_stack(ends.where("path <> '<unresolved>'"), stacked.unionByName(spelled).distinct())


@QUERIES.add(
    "contains_match",
    f"""{ctes('s n')}, a AS (SELECT DISTINCT lower(name) AS ka FROM n WHERE kind = 5 AND name IS NOT NULL), b AS (SELECT DISTINCT lower(name) AS kb FROM s WHERE name IS NOT NULL)
    SELECT ka AS src, kb AS dst FROM a, b WHERE contains(ka, kb) OR contains(kb, ka)""",
)
def contains_match(spark: SparkSession, root: str) -> DataFrame:
    """Routes and shared nodes of which one's whole name contains the other's."""
    names = lambda n: n.where("name is not null").select(F.lower("name").alias("id"), F.lower("name").alias("key")).distinct()
    return resolve.contains_match(names(g.nodes(spark, root).where("kind = 5")), names(g.shared_nodes(spark, root)))


@QUERIES.add(
    "resolve_calls",
    f"""{ctes('n')}, u AS (SELECT DISTINCT call_id, {g._sql_id('from_id')} AS from_id, shape, base, name FROM unresolved_calls),
    cl AS (SELECT u.*, n.repo_id AS repo, n.file AS at, n.parent_id AS owner FROM u LEFT JOIN n ON u.from_id = n.id), fn AS (SELECT * FROM n WHERE kind IN (3, 4)),
    r AS (SELECT call_id, shape,
      CASE shape WHEN 'Bare' THEN (SELECT min(id) FROM fn WHERE fn.repo_id = cl.repo AND fn.file = cl.at AND fn.name = cl.name)
        WHEN 'SelfMethod' THEN (SELECT min(id) FROM fn WHERE kind = 4 AND fn.parent_id = cl.owner AND fn.name = cl.name)
        WHEN 'Attribute' THEN (SELECT min(m.id) FROM fn m WHERE m.kind = 4 AND m.name = cl.name AND m.parent_id =
          (SELECT min(k.id) FROM n k WHERE k.kind IN (2, 8) AND k.repo_id = cl.repo AND k.file = cl.at AND k.name = cl.base)) END AS hit,
      CASE WHEN shape IN ('Bare', 'SelfMethod', 'Attribute') THEN (SELECT CASE WHEN count(*) = 1 THEN min(id) END FROM fn WHERE fn.repo_id = cl.repo AND fn.name = cl.name) END AS sole FROM cl)
    SELECT call_id, coalesce(hit, sole) AS dst, CASE WHEN hit IS NOT NULL THEN 'scope' WHEN sole IS NOT NULL THEN 'unique' ELSE 'unresolved' END AS rule FROM r""",
)
def resolve_calls(spark: SparkSession, root: str) -> DataFrame:
    from graphloom.functions.ids import canonical_id

    calls = table(spark, root, "unresolved_calls").select("call_id", canonical_id(F.col("from_id")).alias("from_id"), "shape", "base", "name").dropDuplicates(["call_id"])
    return resolve.resolve_calls(calls, g.nodes(spark, root))


def frames(spark: SparkSession, root: str) -> DataFrame:
    found = table(spark, root, "documents").select("doc_id", F.posexplode(tx.stack_frames(F.col("text"))).alias("k", "f"))
    return found.select(F.concat_ws(":", "doc_id", "k").alias("frame"), "doc_id", "f.path", F.col("f.line").cast("bigint").alias("line"))


_FRAMES = r"""x AS (SELECT doc_id, 0 AS g, unnest(regexp_extract_all(text, 'File "([^"]+)", line ([0-9]+)', 1)) AS path,
    unnest(regexp_extract_all(text, 'File "([^"]+)", line ([0-9]+)', 2)) AS line FROM documents UNION ALL
    SELECT doc_id, 1, unnest(regexp_extract_all(text, '\(([A-Za-z0-9_./-]+\.[A-Za-z]+):([0-9]+)\)', 1)), unnest(regexp_extract_all(text, '\(([A-Za-z0-9_./-]+\.[A-Za-z]+):([0-9]+)\)', 2)) FROM documents)"""


@QUERIES.add("stack_frames", rf"WITH {_FRAMES} SELECT path, CAST(line AS BIGINT) AS line, count(*) AS frames FROM x GROUP BY ALL")
def stack_frames(spark: SparkSession, root: str) -> DataFrame:
    return frames(spark, root).groupBy("path", "line").agg(F.count("*").alias("frames"))


@QUERIES.add("frame_nodes")
def frame_nodes(spark: SparkSession, root: str) -> DataFrame:
    """The innermost nodes at the stack frames of the documents."""
    return resolve.frame_nodes(frames(spark, root).distinct(), g.nodes(spark, root))


@QUERIES.add(
    "span_nodes",
    rf"""{ctes('n c')}, d AS (SELECT DISTINCT regexp_extract(json_extract_string(text, '$.file'), '([^/]*)$', 1) AS base,
      CAST(json_extract_string(text, '$.start_line') AS BIGINT) + 2 AS line FROM c WHERE cell_type = 3),
    h AS (SELECT base, line, id, count(*) OVER (PARTITION BY base, line) AS spans, row_number() OVER (PARTITION BY base, line ORDER BY end_line - start_line, id) AS k
      FROM d JOIN n ON regexp_extract(file, '([^/]*)$', 1) = base AND line - 1 BETWEEN start_line AND end_line)
    SELECT base || ':' || line AS frame, id, spans FROM h WHERE k = 1""",
)
def span_nodes(spark: SparkSession, root: str) -> DataFrame:
    """The innermost nodes at the second line of everything that has a position."""
    at = g.cells(spark, root).where("cell_type = 3").select(F.from_json("text", "file string, start_line bigint").alias("p"))
    f = at.select(tx.basename(F.col("p.file")).alias("path"), (F.col("p.start_line") + 2).alias("line")).distinct()
    return resolve.frame_nodes(f.withColumn("frame", F.concat_ws(":", "path", "line")), g.nodes(spark, root))


@QUERIES.add(
    "doc_links",
    f"""{ctes('n')}, b AS (SELECT doc_id, generate_subscripts(string_split(text, '`'), 1) AS k, unnest(string_split(text, '`')) AS name FROM documents),
    i AS (SELECT doc_id, name, min(k) AS k FROM b WHERE k % 2 = 0 AND regexp_full_match(name, '[A-Za-z_][A-Za-z0-9_]{{2,}}') GROUP BY doc_id, name),
    t AS (SELECT name, min(id) AS id FROM n WHERE kind IN {schema.LINKABLE} AND name IS NOT NULL GROUP BY name),
    r AS (SELECT doc_id, id, row_number() OVER (PARTITION BY doc_id ORDER BY k, name) AS place FROM i JOIN t USING (name))
    SELECT doc_id, id FROM r WHERE place <= 25""",
)
def doc_links(spark: SparkSession, root: str) -> DataFrame:
    """Documents linked to the first 25 symbols that they name between backticks."""
    words = table(spark, root, "documents").select("doc_id", F.posexplode(tx.backtick_identifiers(F.col("text"))).alias("k", "name"))
    first = words.groupBy("doc_id", "name").agg(F.min("k").alias("k"))
    symbols = g.nodes(spark, root).where(F.col("kind").isin(*schema.LINKABLE) & F.col("name").isNotNull()).groupBy("name").agg(F.min("id").alias("id"))
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("k", "name"))
    return first.join(symbols, "name").withColumn("place", place).where("place <= 25").select("doc_id", "id")


@QUERIES.add(
    "token_seeds",
    f"""{ctes('n')}, w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{{3,}}'))) AS token FROM documents WHERE kind = 'issue'),
    t AS (SELECT id, lower(regexp_extract(qname, '([^:]*)$', 1)) AS token, count(*) OVER (PARTITION BY lower(regexp_extract(qname, '([^:]*)$', 1))) AS hits FROM n)
    SELECT token, id FROM t JOIN w USING (token) WHERE hits <= 20""",
)
def token_seeds(spark: SparkSession, root: str) -> DataFrame:
    """Nodes whose last name is a word of an issue, but for names that more than 20 nodes have."""
    words = table(spark, root, "documents").where("kind = 'issue'").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z_][A-Za-z0-9_]{3,})"))).alias("w"))
    words = words.select(F.lower("w").alias("token")).distinct()
    tails = g.nodes(spark, root).select("id", F.lower(tx.tail(F.col("qname"))).alias("token"))
    few = tails.groupBy("token").agg(F.count("*").alias("hits")).where("hits <= 20")
    return tails.join(few, "token", "left_semi").join(words, "token", "left_semi")


@QUERIES.add(
    "test_modules",
    f"""{ctes('f')}, q AS (SELECT file_id, repo, regexp_replace(regexp_replace(path, '\\.[^./]*$', ''), '/', '::', 'g') AS qname FROM f)
    SELECT repo, count(*) AS modules, count(CASE WHEN regexp_matches(lower(qname), '::(tests|test|__tests__|spec)::|^(tests|test|spec)::')
      OR regexp_matches(lower(regexp_extract(qname, '([^:]*)$', 1)), '^test_|(_test|_spec|\\.test|\\.spec)$') THEN 1 END) AS tests FROM q GROUP BY repo""",
)
def test_modules(spark: SparkSession, root: str) -> DataFrame:
    q = g.files(spark, root).select("repo", tx.path_to_qname(F.col("path")).alias("qname"))
    return q.groupBy("repo").agg(F.count("*").alias("modules"), F.count_if(tx.is_test_qname(F.col("qname"))).alias("tests"))


# -- walks


_SEEDS = "seeds AS (SELECT id FROM n WHERE kind = 5)"


def seeds(spark: SparkSession, root: str) -> DataFrame:
    return g.nodes(spark, root).where("kind = 5").select("id")


def _walk_sql(a: str, b: str, where: str) -> str:
    return f"""WITH RECURSIVE {', '.join(g.SQL[x] for x in ('n', 'e'))}, {_SEEDS}, st AS (SELECT DISTINCT {a} AS a, {b} AS b FROM e WHERE src IS NOT NULL AND dst IS NOT NULL AND {where}),
    w AS (SELECT id, 0 AS depth FROM seeds UNION SELECT b, depth + 1 FROM w JOIN st ON w.id = st.a WHERE depth < 3)
    SELECT id, min(depth) AS depth FROM w GROUP BY id HAVING min(depth) > 0"""


@QUERIES.add("walk_forward", _walk_sql("src", "dst", "category IN (4, 9, 5)"))
def walk_forward(spark: SparkSession, root: str) -> DataFrame:
    return traverse.walk(g.edges(spark, root), seeds(spark, root), 3, [4, 9, 5])


@QUERIES.add("walk_backward", _walk_sql("dst", "src", "true"))
def walk_backward(spark: SparkSession, root: str) -> DataFrame:
    return traverse.walk(g.edges(spark, root), seeds(spark, root), 3, None, backward=True)


@QUERIES.add(
    "reachable_by",
    f"""{_walk_sql('dst', 'src', 'category = 4').replace('SELECT id, min(depth) AS depth FROM w GROUP BY id', 'SELECT id, min(depth) AS depth FROM w WHERE id IN (SELECT id FROM n WHERE kind = 4) GROUP BY id')}""",
)
def reachable_by(spark: SparkSession, root: str) -> DataFrame:
    n = g.nodes(spark, root)
    return traverse.reachable_by(g.edges(spark, root), seeds(spark, root), n.where("kind = 4"), 3, [4])


@QUERIES.add(
    "impact",
    f"""{_walk_sql('src', 'dst', 'true').replace('SELECT id, min(depth) AS depth FROM w GROUP BY id HAVING min(depth) > 0', '')},
    m AS (SELECT id, min(depth) AS depth FROM w GROUP BY id), v AS (SELECT b.id, b.depth, category, row_number() OVER (PARTITION BY b.id ORDER BY edge_id) AS k
      FROM m a JOIN e ON e.src = a.id JOIN m b ON e.dst = b.id WHERE b.depth = a.depth + 1)
    SELECT id, depth, category FROM v WHERE k = 1""",
)
def impact(spark: SparkSession, root: str) -> DataFrame:
    return traverse.impact(g.edges(spark, root), seeds(spark, root), 3)


@QUERIES.add(
    "parent_chain",
    f"""WITH RECURSIVE {g.SQL['n']}, u AS (SELECT n.id, n.parent_id AS ancestor, 1 AS depth FROM n JOIN n p ON n.parent_id = p.id
    UNION ALL SELECT u.id, p.parent_id, depth + 1 FROM u JOIN n p ON u.ancestor = p.id JOIN n q ON p.parent_id = q.id WHERE depth < 6)
    SELECT id, ancestor, depth FROM u""",
)
def parent_chain(spark: SparkSession, root: str) -> DataFrame:
    return traverse.parent_chain(g.nodes(spark, root))


def _activation(name: str, profile: str, direction: str, specificity: str) -> None:
    @QUERIES.add(name)  # no SQL: rounds go on until scores change by less than the operator's epsilon
    def run(spark: SparkSession, root: str) -> DataFrame:
        return traverse.activate(g.nodes(spark, root), g.edges(spark, root), seeds(spark, root), profile, direction=direction, specificity=specificity)


_activation("activate", "default", "forward", "none")
_activation("activate_backward", "default", "backward", "none")
_activation("activate_repair", "repair", "undirected", "idf")
_activation("activate_onboard", "onboard", "forward", "inverse_idf")
