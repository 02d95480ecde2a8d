"""Imports to modules and bound names, and calls and references through them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.names import module_reference

#: Kinds of nodes.
MODULE, CLASS, FUNCTION, METHOD, STRUCT = 1, 2, 3, 4, 8
HANDLED_BY = 9


def symbol_tables(nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Modules (repo_id, qname, id), symbols right below a module (module, name, id, kind), methods of types (owner, name, id).

    Of several symbols of one name in a module the highest id counts.
    """
    modules = nodes.where(F.col("kind") == MODULE).groupBy("repo_id", "qname").agg(F.max("id").alias("id"))
    parents = nodes.select(F.col("id").alias("parent_id"), F.col("kind").alias("above"))
    child = nodes.where("name is not null").select("id", "name", "kind", "parent_id").join(parents, "parent_id")
    symbols = child.where(F.col("above") == MODULE).groupBy(F.col("parent_id").alias("module"), "name").agg(F.max(F.struct("id", "kind")).alias("s"))
    methods = child.where(F.col("above").isin(CLASS, STRUCT) & (F.col("kind") == METHOD)).groupBy(F.col("parent_id").alias("owner"), "name").agg(F.max("id").alias("id"))
    return modules, symbols.select("module", "name", "s.id", "s.kind"), methods


def resolve_imports(imports: DataFrame, nodes: DataFrame, separator: str = ".") -> DataFrame:
    """Modules that import statements mean, and what they bind: (import_id, src, dst, bound, target).

    ``imports`` are (import_id, repo_id, from_module, style, module, name, alias, level). Style ``module`` names a module by
    its path, whose first segment (for ``/`` paths the last) is bound unless there is an alias; style ``symbol`` takes a
    name out of a module: the submodule of that name if there is one, else the module's symbol. Style ``exact`` names a
    module by its qualified name and binds the last segment. What names no module of the repository gives no row.
    """
    modules, symbols, _ = symbol_tables(nodes)
    by = modules.select("repo_id", F.col("qname").alias("q"), F.col("id").alias("m"))
    plain = F.replace(F.col("module"), F.lit(separator), F.lit("::"))
    target = F.when(F.col("style") == "symbol", module_reference(F.col("from_module"), F.col("module"), F.coalesce("level", F.lit(0)))).when(F.col("style") == "exact", F.col("module")).otherwise(plain)
    rows = imports.withColumn("q1", target).withColumn("q2", F.when(F.col("style") == "symbol", F.concat_ws("::", F.nullif(F.col("q1"), F.lit("")), F.col("name"))))
    source = by.select("repo_id", F.col("q").alias("from_module"), F.col("m").alias("src"))
    first = by.select("repo_id", F.col("q").alias("q1"), F.col("m").alias("m1"))
    second = by.select("repo_id", F.col("q").alias("q2"), F.col("m").alias("m2"))
    met = rows.join(source, ["repo_id", "from_module"]).join(first, ["repo_id", "q1"], "left").join(second, ["repo_id", "q2"], "left")
    met = met.join(symbols.select(F.col("module").alias("m1"), "name", F.col("id").alias("symbol")), ["m1", "name"], "left")
    ends = F.split("q1", "::")
    own = F.when(F.col("style") == "symbol", F.col("name")).when((F.col("style") == "exact") | F.lit(separator == "/"), F.element_at(ends, -1)).otherwise(F.element_at(ends, 1))
    symbol = F.col("style") == "symbol"
    return met.select(
        "import_id", "src", F.coalesce("m2", "m1").alias("dst"), F.coalesce("alias", own).alias("bound"),
        F.when(symbol, F.coalesce("m2", "symbol")).otherwise(F.col("m1")).alias("target"),
    ).where("dst is not null")


def bindings(resolved: DataFrame) -> DataFrame:
    """What each module's imported names stand for (module, bound, target); the last import of a name counts."""
    return resolved.where("target is not null").groupBy(F.col("src").alias("module"), "bound").agg(F.max_by("target", "import_id").alias("target"))


def enclosing(nodes: DataFrame, chain: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The module around each node (id, module), itself for a module, and the nearest type around it (id, owner).

    ``chain`` are the ancestors of every node (id, ancestor, depth).
    """
    kinds = nodes.select(F.col("id").alias("ancestor"), "kind")
    up = chain.select("id", "ancestor", "depth").unionByName(nodes.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("depth"))).join(kinds, "ancestor")
    nearest = lambda *k: up.where(F.col("kind").isin(*k)).groupBy("id").agg(F.min_by("ancestor", "depth").alias("a"))
    return nearest(MODULE).select("id", F.col("a").alias("module")), nearest(CLASS, STRUCT).select("id", F.col("a").alias("owner"))


def resolve_sites(sites: DataFrame, nodes: DataFrame, bound: DataFrame) -> DataFrame:
    """Targets of sites (site_id, module, owner, shape, base, name, category) by imports and symbols: (site_id, dst, rule).

    A bare name means what an import binds, else the module's own symbol. An attribute means a symbol of the module, or a
    method of the type, that its base is bound to. A method of self is one of the owner. What handles a route may be the
    only function or method of its name anywhere. Super calls and complex receivers stay unresolved; all sites have a row.
    """
    _, symbols, methods = symbol_tables(nodes)
    b1 = bound.select("module", F.col("bound").alias("name"), F.col("target").alias("imported"))
    b2 = bound.select("module", F.col("bound").alias("base"), F.col("target").alias("on"))
    own = symbols.select("module", "name", F.col("id").alias("local"))
    in_module = symbols.select(F.col("module").alias("on"), "name", F.col("id").alias("of_module"))
    in_type = methods.select(F.col("owner").alias("on"), "name", F.col("id").alias("of_type"))
    of_self = methods.select("owner", "name", F.col("id").alias("of_self"))
    sole = lambda df, name: df.groupBy("name").agg(F.min("id").alias(name), F.count("*").alias("__n")).where("__n = 1").drop("__n")
    joined = sites.join(b1, ["module", "name"], "left").join(own, ["module", "name"], "left").join(b2, ["module", "base"], "left")
    joined = joined.join(in_module, ["on", "name"], "left").join(in_type, ["on", "name"], "left").join(of_self, ["owner", "name"], "left")
    joined = joined.join(sole(symbols, "only_symbol"), "name", "left").join(sole(methods, "only_method"), "name", "left")
    s, handler = F.col("shape"), F.col("category") == HANDLED_BY
    hit = F.when(s == "Bare", F.coalesce("imported", "local")).when(s == "Attribute", F.coalesce("of_module", "of_type")).when(s == "SelfMethod", F.col("of_self"))
    only = F.when(handler & (s == "Bare"), F.col("only_symbol")).when(handler & (s == "Attribute"), F.col("only_method"))
    rule = F.when(hit.isNotNull(), "scope").when(only.isNotNull(), "unique").otherwise("unresolved")
    return joined.select("site_id", F.coalesce(hit, only).alias("dst"), rule.alias("rule"))
