"""Queries of the operators for training data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import functions, langid, layout, packing, syntax, tokens, topn
from graphloom.plans.registry import Registry
from graphloom.session import materialise
from graphloom.sources import table

QUERIES = Registry()


@QUERIES.add("p1_found")
def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return syntax.invalid_files(table(spark, root, "files")).select("file_id")


@QUERIES.add("p1_rates")
def p1_rates(spark: SparkSession, root: str) -> DataFrame:
    files = table(spark, root, "files")
    return syntax.rates(files, syntax.parse_files(files))


@QUERIES.add("p3_found")
def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return functions.documented(table(spark, root, "files"))


@QUERIES.add("p3_pairs")
def p3_pairs(spark: SparkSession, root: str) -> DataFrame:
    return functions.pairs(table(spark, root, "files"))


def not_handwritten(spark: SparkSession, root: str) -> DataFrame:
    return layout.not_handwritten(table(spark, root, "files"), table(spark, root, "upstream_files"), table(spark, root, "regions"))


@QUERIES.add("p6_found")
def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return not_handwritten(spark, root).select("file_id")


@QUERIES.add("p6_kinds")
def p6_kinds(spark: SparkSession, root: str) -> DataFrame:
    return not_handwritten(spark, root)


@QUERIES.add("p9_found")
def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return langid.wrong_labels(langid.document_languages(langid.segments(table(spark, root, "documents"))))


@QUERIES.add("p9_languages")
def p9_languages(spark: SparkSession, root: str) -> DataFrame:
    return langid.document_languages(langid.segments(table(spark, root, "documents"), whole=False))


@QUERIES.add("p9_segments")
def p9_segments(spark: SparkSession, root: str) -> DataFrame:
    return langid.segments(table(spark, root, "documents"), whole=False)


#: Items that p2 keeps of every group.
BEST = 5


@QUERIES.add(
    "p2_found",
    """WITH a AS (SELECT seeds_id, qname, max(score + 0.0) AS score FROM activated
      WHERE qname IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY seeds_id, qname),
    r AS (SELECT *, row_number() OVER (PARTITION BY seeds_id ORDER BY score DESC, qname) AS n FROM a)
    SELECT seeds_id, qname FROM r WHERE n <= 5""",
)
def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return topn.top_n(table(spark, root, "activated"), "seeds_id", "qname", "score", BEST).select("seeds_id", "qname")


@QUERIES.add(
    "p2_ranked",
    """WITH a AS (SELECT seeds_id, qname, max(score + 0.0) AS score FROM activated
      WHERE qname IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY seeds_id, qname),
    r AS (SELECT *, row_number() OVER (PARTITION BY seeds_id ORDER BY score DESC, qname) AS n FROM a)
    SELECT seeds_id, qname, score, CAST(n AS INTEGER) AS rank FROM r WHERE n <= 5""",
)
def p2_ranked(spark: SparkSession, root: str) -> DataFrame:
    return topn.top_n(table(spark, root, "activated"), "seeds_id", "qname", "score", BEST)


@QUERIES.add("p7_ids")
def p7_ids(spark: SparkSession, root: str) -> DataFrame:
    return tokens.encode(table(spark, root, "documents"))


def containers(spark: SparkSession, root: str) -> list[tuple[str, int]]:
    return [(r.container, r.capacity_tokens) for r in table(spark, root, "containers").collect()]


def bins(spark: SparkSession, root: str) -> DataFrame:
    sizes = materialise(tokens.sizes(table(spark, root, "documents")), "doc-sizes")
    known = containers(spark, root)
    packed = [
        packing.pack_documents(sizes, [x for x in known if x[1] <= most]).select(F.lit(name).alias("packing"), "*")
        for name, most in known
    ]
    return reduce(DataFrame.unionByName, packed)


@QUERIES.add("p8_bins")
def p8_bins(spark: SparkSession, root: str) -> DataFrame:
    """For each size the whole documents, packed into containers of that size and, where they fit better, smaller ones."""
    return bins(spark, root)


@QUERIES.add("p8_unused")
def p8_unused(spark: SparkSession, root: str) -> DataFrame:
    """Containers and unused room of each packing by size."""
    each = bins(spark, root).groupBy("packing", "bin", "container", "capacity").agg(F.max("used").alias("used"))
    return each.groupBy("packing", "container", "capacity").agg(
        F.count("*").alias("containers"),
        F.sum("used").alias("used"),
        F.round(1 - F.sum("used") / F.sum("capacity"), 6).alias("unused"),
    )
