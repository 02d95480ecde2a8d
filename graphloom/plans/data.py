"""Queries over files, documents, events and vectors: scans, extraction, maintenance, rendering, analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import render, schema, streaming
from graphloom.functions import text as tx
from graphloom.functions import vectors as vec
from graphloom.functions.ids import canonical_id
from graphloom.operators import analysis, extract, scan, store
from graphloom.plans.registry import Registry
from graphloom.sources import graph as g
from graphloom.sources import table
from graphloom.sources.graph import ctes

QUERIES = Registry()


def sources(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "files").select("file_id", "repo", "path", "source")


_REGION = "CASE WHEN x IN ('node_modules', 'vendor', 'bower_components', '.venv', 'site-packages') THEN 'vendored' WHEN x IN ('target', 'dist', 'build', 'out', '__pycache__', '.cache', '.next', '.nuxt', '.angular', 'coverage') THEN 'build_output' END"


@QUERIES.add(
    "region_anchors",
    f"""{ctes('f')}, p AS (SELECT file_id, repo, string_split(path, '/') AS s FROM f), d AS (SELECT file_id, repo, s, generate_subscripts(s, 1) AS k, unnest(s) AS x FROM p),
    h AS (SELECT *, {_REGION} AS provenance, row_number() OVER (PARTITION BY file_id ORDER BY k) AS rn FROM d WHERE k < len(s) AND {_REGION} IS NOT NULL)
    SELECT repo, array_to_string(list_slice(s, 1, k), '/') AS region, min(provenance) AS provenance, count(*) AS files FROM h WHERE rn = 1 GROUP BY 1, 2""",
)
def region_anchors(spark: SparkSession, root: str) -> DataFrame:
    return scan.region_anchors(g.files(spark, root))


@QUERIES.add(
    "bundle_dirs",
    rf"""{ctes('f')} SELECT repo, regexp_replace(path, '/?[^/]*$', '') AS dir, count(*) AS hashed FROM f
    WHERE regexp_matches(regexp_extract(path, '([^/]*)$', 1), '\.[0-9a-f]{{8,}}\.(js|mjs|css|map)$') GROUP BY ALL HAVING count(*) >= 1""",
)
def bundle_dirs(spark: SparkSession, root: str) -> DataFrame:
    return scan.bundle_dirs(g.files(spark, root), 1)


@QUERIES.add(
    "languages",
    f"""{ctes('f')} SELECT CASE regexp_extract(path, '\\.([A-Za-z]+)$', 1) WHEN 'py' THEN 'python' WHEN 'go' THEN 'go' WHEN 'js' THEN 'typescript' WHEN 'ts' THEN 'typescript'
    WHEN 'rs' THEN 'rust' WHEN 'java' THEN 'java' END AS language, coalesce(lang, '-') AS label, count(*) AS files FROM f GROUP BY ALL""",
)
def languages(spark: SparkSession, root: str) -> DataFrame:
    return g.files(spark, root).groupBy(tx.detect_language(F.col("path")).alias("language"), F.coalesce("lang", F.lit("-")).alias("label")).agg(F.count("*").alias("files"))


@QUERIES.add(
    "module_names",
    f"""{ctes('f')}, q AS (SELECT repo, regexp_replace(regexp_replace(path, '\\.[^./]*$', ''), '/', '::', 'g') AS qname FROM f)
    SELECT repo, qname, count(*) AS files FROM q GROUP BY ALL HAVING count(*) > 1""",
)
def module_names(spark: SparkSession, root: str) -> DataFrame:
    """Module names that several files of a repository share."""
    q = g.files(spark, root).select("repo", tx.path_to_qname(F.col("path")).alias("qname"))
    return q.groupBy("repo", "qname").agg(F.count("*").alias("files")).where("files > 1")


@QUERIES.add(
    "markdown_headings",
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), h AS (SELECT doc_id, regexp_extract(line, '^##? (.*)', 1) AS heading FROM l WHERE regexp_matches(line, '^##? '))
    SELECT trim(heading) AS heading, count(*) AS sections, count(DISTINCT doc_id) AS documents FROM h GROUP BY 1""",
)
def markdown_headings(spark: SparkSession, root: str) -> DataFrame:
    s = scan.markdown_sections(table(spark, root, "documents")).where("heading <> ''")
    return s.groupBy(F.trim("heading").alias("heading")).agg(F.count("*").alias("sections"), F.count_distinct("doc_id").alias("documents"))


def _needle_sql(rows: list[tuple[str, str, str]], prefix: str) -> str:
    values = ", ".join("({}, '{}', '{}', [{}])".format(k, n.replace("'", "''"), name, ", ".join(f"'{x}'" for x in s.split())) for k, (n, name, s) in enumerate(rows))
    return f"""WITH f AS (SELECT DISTINCT file_id, source FROM files), t(k, needle, name, signals) AS (VALUES {values})
    SELECT '{prefix}' || name AS qname, count(DISTINCT file_id) AS files FROM f, t WHERE contains(source, needle)
    AND (len(signals) = 0 OR len(list_filter(signals, lambda x: contains(source, x))) > 0) GROUP BY 1"""


#: Needles of the synthetic sources, which hold none of the frameworks' own.
LOCAL_NEEDLES = [
    ("logger.debug(", "pylog", "logging"), ("console.debug(", "console", ""), ("log.Printf(", "golog", "fmt"), ("log.debug(", "javalog", ""),
    ("println!(", "rustout", ""), ("HashMap", "hashmap", "std::collections java.util"), ("Promise<", "promise", "async"),
]


@QUERIES.add("needles_local", _needle_sql(LOCAL_NEEDLES, "uses:"))
def needles_local(spark: SparkSession, root: str) -> DataFrame:
    return extract.needles(sources(spark, root), LOCAL_NEEDLES, "uses:").groupBy("qname").agg(F.count_distinct("file_id").alias("files"))


@QUERIES.add("data_sources", _needle_sql(extract.DATA_SOURCES, "data_source:"))
def data_sources(spark: SparkSession, root: str) -> DataFrame:
    return extract.needles(sources(spark, root), extract.DATA_SOURCES, "data_source:").groupBy("qname").agg(F.count_distinct("file_id").alias("files"))


@QUERIES.add("queue_consumers", _needle_sql(extract.QUEUE_CONSUMERS, "queue_consumer:"))
def queue_consumers(spark: SparkSession, root: str) -> DataFrame:
    return extract.needles(sources(spark, root), extract.QUEUE_CONSUMERS, "queue_consumer:").groupBy("qname").agg(F.count_distinct("file_id").alias("files"))


@QUERIES.add("queue_producers", _needle_sql(extract.QUEUE_PRODUCERS, "queue_producer:"))
def queue_producers(spark: SparkSession, root: str) -> DataFrame:
    return extract.needles(sources(spark, root), extract.QUEUE_PRODUCERS, "queue_producer:").groupBy("qname").agg(F.count_distinct("file_id").alias("files"))


@QUERIES.add("event_handlers")
def event_handlers(spark: SparkSession, root: str) -> DataFrame:
    return extract.calls_with_literal(sources(spark, root), extract.EVENT_HANDLERS, "event_handle:")


@QUERIES.add("env_reads")
def env_reads(spark: SparkSession, root: str) -> DataFrame:
    return extract.env_reads(sources(spark, root))


@QUERIES.add("sql_tables")
def sql_tables(spark: SparkSession, root: str) -> DataFrame:
    return extract.sql_tables(sources(spark, root))


@QUERIES.add("http_routes")
def http_routes(spark: SparkSession, root: str) -> DataFrame:
    return extract.routes(sources(spark, root))


@QUERIES.add("dependencies")
def dependencies(spark: SparkSession, root: str) -> DataFrame:
    return extract.dependencies(sources(spark, root))


# -- maintenance and export


@QUERIES.add(
    "changed_shards",
    f"""{ctes('n')}, h AS (SELECT repo_id, count(*) AS rows, count(CASE WHEN confidence = 'Weak' THEN 1 END) AS weak FROM n GROUP BY repo_id)
    SELECT repo_id, rows, CASE WHEN weak > 0 THEN 'changed' ELSE 'same' END AS status FROM h""",
)
def changed_shards(spark: SparkSession, root: str) -> DataFrame:
    """Repositories to write again when every weak node became a medium one."""
    old = g.nodes(spark, root)
    new = old.withColumn("confidence", F.when(F.col("confidence") == "Weak", "Medium").otherwise(F.col("confidence")))
    return store.changed_shards(new, store.shard_hashes(old, ["repo_id"]), ["repo_id"])


@QUERIES.add(
    "upsert_cells",
    f"""{ctes('c')}, x AS (SELECT DISTINCT node_id FROM c WHERE cell_type = 3), first AS (SELECT node_id, min(ord) AS o FROM c WHERE cell_type = 2 GROUP BY node_id)
    SELECT cell_type, text = '-' AS replaced, count(*) AS cells FROM (
      SELECT cell_type, CASE WHEN cell_type = 2 AND ord = first.o THEN '-' ELSE text END AS text FROM c LEFT JOIN first ON c.node_id = first.node_id
      UNION ALL SELECT 2, '-' FROM x WHERE node_id NOT IN (SELECT node_id FROM first)) GROUP BY ALL""",
)
def upsert_cells(spark: SparkSession, root: str) -> DataFrame:
    c = g.cells(spark, root).drop("payload_type")
    changes = c.where("cell_type = 3").select("node_id", F.lit(2).alias("cell_type"), F.lit("-").alias("text"))
    return store.upsert_cells(c, changes).groupBy("cell_type", (F.col("text") == "-").alias("replaced")).agg(F.count("*").alias("cells"))


@QUERIES.add(
    "remove_cells",
    f"""{ctes('c')} SELECT cell_type, count(*) AS cells FROM c WHERE NOT (cell_type = 2 AND node_id IN (SELECT node_id FROM c WHERE cell_type = 15)) GROUP BY cell_type""",
)
def remove_cells(spark: SparkSession, root: str) -> DataFrame:
    c = g.cells(spark, root)
    gone = c.where("cell_type = 15").select("node_id", F.lit(2).alias("cell_type"))
    return store.remove_cells(c, gone).groupBy("cell_type").agg(F.count("*").alias("cells"))


@QUERIES.add(
    "export_nodes",
    f"""{ctes('n c')}, o AS (SELECT node_id AS id, min(json_extract_string(text, '$.provenance')) AS provenance FROM c WHERE cell_type = 15 GROUP BY 1)
    SELECT repo_id, qname, min(n.id) AS id FROM n LEFT JOIN o USING (id) LEFT JOIN export_options x USING (repo_id)
    WHERE (coalesce(lower(provenance), '') NOT IN ('vendored', 'generated', 'build_output', 'dependency', 'synthetic') OR coalesce(include_noise, false))
    AND len(list_filter(coalesce(exclude_globs, []), lambda p: qname GLOB p)) = 0 GROUP BY ALL""",
)
def export_nodes(spark: SparkSession, root: str) -> DataFrame:
    return store.export_nodes(g.nodes(spark, root), g.cells(spark, root), table(spark, root, "export_options"))


@QUERIES.add(
    "export_edges",
    f"""{ctes('e')} SELECT {schema.named_sql('category', schema.RELATIONS).replace("'UNKNOWN'", "'cooccurs'")} AS relation,
    coalesce({schema.named_sql('category', schema.CONDUCTANCE).replace("'UNKNOWN'", 'NULL').replace("THEN '", 'THEN ').replace("' WHEN", ' WHEN').replace("' ELSE", ' ELSE')}::DOUBLE, 1.0) AS weight,
    count(*) AS edges FROM e WHERE src <> dst GROUP BY ALL""",
)
def export_edges(spark: SparkSession, root: str) -> DataFrame:
    pick = lambda names: F.try_element_at(F.create_map(*[F.lit(x) for p in names.items() for x in p]), F.col("category"))
    e = g.edges(spark, root).where("src <> dst")
    return e.groupBy(F.coalesce(pick(schema.RELATIONS), F.lit("cooccurs")).alias("relation"), F.coalesce(pick(schema.CONDUCTANCE), F.lit(1.0)).alias("weight")).agg(F.count("*").alias("edges"))


@QUERIES.add(
    "identity_ordinals",
    f"""{ctes('n')} SELECT id, CAST(row_number() OVER (PARTITION BY repo_id, file, kind ORDER BY start_line, id) - 1 AS INTEGER) AS ordinal FROM n WHERE file IS NOT NULL AND start_line IS NOT NULL""",
)
def identity_ordinals(spark: SparkSession, root: str) -> DataFrame:
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy("repo_id", "file", "kind").orderBy("start_line", "id")) - 1
    return g.nodes(spark, root).where("file is not null and start_line is not null").select("id", place.alias("ordinal"))


# -- rendering


@QUERIES.add(
    "prose",
    f"""{ctes('n c')}, b AS (SELECT node_id AS id, text, row_number() OVER (PARTITION BY node_id ORDER BY cell_type DESC, ord) AS k FROM c WHERE cell_type IN (1, 2)),
    l AS (SELECT id, list_slice(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> ''), 1, 3) AS lines FROM b WHERE k = 1)
    SELECT n.id, {schema.named_sql('kind', schema.KINDS)} || ' ' || qname || CASE WHEN file IS NOT NULL AND start_line IS NOT NULL
      THEN ' [' || file || ':' || (start_line + 1) || '-' || (end_line + 1) || ']' ELSE '' END
      || CASE WHEN len(lines) > 0 THEN chr(10) || array_to_string(list_transform(lines, lambda x: '  ' || trim(x, ' ')), chr(10)) ELSE '' END AS text
    FROM n LEFT JOIN l ON n.id = l.id""",
)
def prose(spark: SparkSession, root: str) -> DataFrame:
    return render.prose(g.nodes(spark, root), g.cells(spark, root))


@QUERIES.add(
    "topology",
    f"""{ctes('n e')} SELECT DISTINCT a.qname || ' -' || {schema.named_sql('category', schema.CATEGORIES)} || '-> ' || b.qname AS line
    FROM e JOIN n a ON e.src = a.id JOIN n b ON e.dst = b.id WHERE category IN (4, 9, 10)""",
)
def topology(spark: SparkSession, root: str) -> DataFrame:
    return render.topology(g.nodes(spark, root), g.edges(spark, root))


@QUERIES.add("graph_json")
def graph_json(spark: SparkSession, root: str) -> DataFrame:
    return render.graph_json(g.nodes(spark, root), g.edges(spark, root))


# -- events, vectors, analysis


@QUERIES.add(
    "event_windows",
    """SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS events,
    round(CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE), 4) AS value FROM events GROUP BY ALL""",
)
def event_windows(spark: SparkSession, root: str) -> DataFrame:
    return streaming.windowed(table(spark, root, "events"))


@QUERIES.add(
    "event_sessions",
    """WITH d AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM d)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS events FROM s GROUP BY user_id, k""",
)
def event_sessions(spark: SparkSession, root: str) -> DataFrame:
    return streaming.sessions(table(spark, root, "events"))


@QUERIES.add(
    "softmax_top",
    """WITH x AS (SELECT vec_id, label, list_transform(embedding, lambda v: exp(CAST(v AS DOUBLE))) AS e FROM embeddings), p AS (SELECT vec_id, label, list_transform(e, lambda v: v / list_sum(e)) AS p, e FROM x)
    SELECT vec_id, round(list_max(p), 6) AS top, round(p[label + 1], 6) AS own, len(list_filter(p, lambda v: v > p[label + 1])) AS rank FROM p""",
)
def softmax_top(spark: SparkSession, root: str) -> DataFrame:
    p = table(spark, root, "embeddings").select("vec_id", "label", vec.softmax(F.col("embedding")).alias("p"))
    return p.select(
        "vec_id", F.round(F.array_max("p"), 6).alias("top"), F.round(F.element_at("p", F.col("label") + 1), 6).alias("own"),
        vec.rank_of(F.col("p"), F.col("label")).cast("bigint").alias("rank"),
    )


@QUERIES.add(
    "label_rates",
    """WITH r AS (SELECT event_type, count(*) AS n, avg(CASE WHEN value > 10 THEN 1.0 ELSE 0.0 END) AS p FROM events GROUP BY 1)
    SELECT event_type, n, round(p, 6) AS p, round(1 - pow(1 - p, 5), 6) AS pass_5, CASE WHEN p <= 0 THEN 'infinity'::DOUBLE WHEN p >= 1 THEN 1.0 ELSE round(ln(0.1) / ln(1 - p), 4) END AS tries_90 FROM r""",
)
def label_rates(spark: SparkSession, root: str) -> DataFrame:
    return analysis.pass_rates(table(spark, root, "events"), "event_type", F.coalesce(F.col("value") > 10, F.lit(False)))


@QUERIES.add(
    "effect_classes",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), k AS (SELECT CASE WHEN regexp_matches(line, 'WARN|ERROR') THEN 'log'
    WHEN regexp_matches(line, '^ *(File|at) ') THEN 'frame' WHEN regexp_matches(line, '^##? ') THEN 'heading' WHEN regexp_matches(line, '^[-*] ') THEN 'item' ELSE 'none' END AS class FROM l)
    SELECT class, count(*) AS lines FROM k GROUP BY class""",
)
def effect_classes(spark: SparkSession, root: str) -> DataFrame:
    lines = table(spark, root, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    classes = [("log", "WARN|ERROR"), ("frame", "^ *(File|at) "), ("heading", "^##? "), ("item", "^[-*] ")]
    return lines.groupBy(analysis.first_class(F.col("line"), classes).alias("class")).agg(F.count("*").alias("lines"))


@QUERIES.add(
    "overlapping_lives",
    f"""{ctes('n')} SELECT a.repo_id, a.file, count(*) AS pairs FROM n a JOIN n b ON a.repo_id = b.repo_id AND a.file = b.file AND a.start_line <= b.end_line AND b.start_line <= a.end_line
    WHERE a.kind IN (2, 8) AND b.kind IN (3, 4) GROUP BY ALL""",
)
def overlapping_lives(spark: SparkSession, root: str) -> DataFrame:
    """Functions whose lines overlap those of a type in the same file."""
    n = g.nodes(spark, root).where("file is not null and start_line is not null").select("repo_id", "file", "kind", "id", F.col("start_line").alias("a"), F.col("end_line").alias("z"))
    pairs = analysis.overlapping(n.where("kind in (2, 8)").drop("kind"), n.where("kind in (3, 4)").drop("kind"), ["repo_id", "file"])
    return pairs.groupBy("repo_id", "file").agg(F.count("*").alias("pairs"))


@QUERIES.add(
    "activated_unknown",
    f"""{ctes('n')} SELECT seeds_id, count(DISTINCT ({g._sql_id('a.id')}, coalesce(a.qname, ''))) AS entries FROM activated a WHERE {g._sql_id('a.id')} NOT IN (SELECT id FROM n) GROUP BY seeds_id""",
)
def activated_unknown(spark: SparkSession, root: str) -> DataFrame:
    """Activated entries per seeds file whose id is no node's."""
    a = table(spark, root, "activated").select("seeds_id", canonical_id(F.col("id")).alias("id"), F.coalesce("qname", F.lit("")).alias("qname")).distinct()
    return a.join(g.nodes(spark, root).select("id"), "id", "left_anti").groupBy("seeds_id").agg(F.count("*").alias("entries"))
