"""Front ends: source text to nodes, imports and call sites of the code graph, and the edges that joins make of them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import imports as imp
from graphloom.session import materialise, ship

ITEMS = (
    "item string, repo_id bigint, file string, id string, kind int, name string, qname string, parent_id string, start_line int, end_line int,"
    " ord bigint, from_module string, style string, module string, alias string, level int, shape string, base string, category int"
)
MODULE, CLASS, FUNCTION, METHOD, INTERFACE, STRUCT = 1, 2, 3, 4, 7, 8
IMPORTS, CALLS, INHERITS = 3, 4, 20


def node_id(repo: int | None, qname: str, kind: int) -> str:
    """A stable id: equal for equal repository, qualified name and kind."""
    return hashlib.blake2b(f"{repo}\0{kind}\0{qname}".encode(), digest_size=8).hexdigest()


def parsed(rows: DataFrame, items: Callable[..., list[dict]]) -> DataFrame:
    """Rows of ``ITEMS`` that ``items`` gives for each of ``rows``, in Arrow batches."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ship(rows.sparkSession)
    kind = _parse_datatype_string(ITEMS)
    target = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                found = items(*row)
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema=target)

    return rows.mapInArrow(run, kind)


def assemble(found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges (src, dst, category) and unresolved sites of rows of ``ITEMS``.

    Imports become IMPORTS edges between modules, calls CALLS edges and bases INHERITS_FROM edges, each once. The type of a
    receiver other than the function's own isn't known, so methods called on variables stay unresolved.
    """
    found = materialise(found, "items")
    rows = found.where("item = 'node'").select("id", "repo_id", "kind", "name", "qname", "parent_id", "file", "start_line", "end_line")
    # a module of several files has the first of them
    nodes = materialise(rows.groupBy("id").agg(F.min(F.struct("file", *[c for c in rows.columns if c not in ("id", "file")])).alias("n")).select("id", "n.*"), "nodes")
    key = F.concat_ws("\x01", "file", F.lpad(F.col("ord").cast("string"), 10, "0"))
    stmts = found.where("item = 'import'").select(key.alias("import_id"), "repo_id", "from_module", "style", "module", "name", "alias", "level")
    met = materialise(imp.resolve_imports(stmts, nodes), "imports")
    linked = met.where("src <> dst").select("src", "dst", F.lit(IMPORTS).alias("category")).distinct()
    # a file lies in one module, so a site's module is its file's
    modules = rows.where(F.col("kind") == MODULE).select("repo_id", "file", F.col("id").alias("module")).distinct()
    types = nodes.where(F.col("kind").isin(CLASS, STRUCT)).select(F.col("id").alias("parent_id"), F.col("id").alias("owner"))
    around = nodes.select("id", "parent_id").join(types, "parent_id").select("id", "owner")
    sites = found.where("item = 'site'").select(F.concat_ws("\x01", "repo_id", key).alias("site_id"), "repo_id", "file", "id", "shape", "base", "name", "category")
    placed = sites.join(modules, ["repo_id", "file"]).join(around, "id", "left")
    hits = imp.resolve_sites(placed.select("site_id", "module", "owner", "shape", "base", "name", "category"), nodes, imp.bindings(met))
    both = materialise(placed.select("site_id", F.col("id").alias("src"), "category", "shape", "base", "name").join(hits, "site_id"), "sites")
    edges = linked.unionByName(both.where("dst is not null").select("src", "dst", "category").distinct())
    return nodes, edges, both.where("dst is null").select("src", "category", "shape", "base", "name").distinct()
