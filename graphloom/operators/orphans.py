"""References to records that don't exist, or don't exist yet or any more, at the time they are made.

Parents and children become one long table of tagged keys. Grouped by key and swept in time order, a parent row opens
and closes a life and a child row sees how many lives are open. A child that sees none is an orphan. Children of a key
that holds a large share of the rows are dealt to salted groups, to each of which the key's parent rows are copied.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A key is salted from this share of all child rows on, so there are at most 1000 such keys, and from so many rows on.
HEAVY_SHARE, HEAVY_ROWS = 0.001, 20_000
END = 2**63 - 1


@dataclass(frozen=True)
class Children:
    """A column that names records of the parent tables. ``key`` and ``at`` are the key and the time of the reference."""

    rows: DataFrame
    table: str
    row_id: str
    field: str
    key: Column
    at: str


@dataclass(frozen=True)
class Parents:
    """Records with a life from ``since`` (inclusive) to ``until`` (exclusive, null for open)."""

    rows: DataFrame
    key: Column
    since: str
    until: str


def orphan_references(children: Sequence[Children], parents: Sequence[Parents]) -> DataFrame:
    """Rows (table_name, row_id, field, at) of the references without a parent that is alive at their time.

    Null references are none. A reference with null time is an orphan only if no parent row of its key exists. A parent
    row without ``since`` or that ends before it begins is never alive, but exists. Resent rows count once. Empty tables
    give no rows, empty parents make every reference an orphan. Only the named columns of the inputs are read.
    """
    child = reduce(
        DataFrame.unionByName,
        [
            c.rows.select(
                c.key.alias("k"),
                F.coalesce(F.unix_micros(F.col(c.at).cast("timestamp")), F.lit(END)).alias("t"),
                F.lit(i).cast("tinyint").alias("source"),
                F.col(c.row_id).cast("bigint").alias("row_id"),
            ).where("k is not null")
            for i, c in enumerate(children)
        ],
    )
    parent = reduce(
        DataFrame.unionByName,
        [
            p.rows.select(p.key.alias("k"), F.unix_micros(p.since).alias("a"), F.unix_micros(p.until).alias("z"))
            for p in parents
        ],
    ).where("k is not null")
    lives = F.when(
        F.col("a").isNotNull() & (F.col("z").isNull() | (F.col("z") > F.col("a"))),
        F.array(
            F.struct(F.col("a").alias("t"), F.lit(1).alias("d"), F.lit(1).alias("n")),
            F.struct(F.col("z").alias("t"), F.lit(-1).alias("d"), F.lit(0).alias("n")),
        ),
    ).otherwise(F.array(F.struct(F.lit(0).cast("bigint").alias("t"), F.lit(0).alias("d"), F.lit(1).alias("n"))))
    events = parent.select("k", F.explode(lives).alias("e")).where("e.t is not null").select(
        "k", "e.t", F.lit(-1).cast("tinyint").alias("source"), F.lit(None).cast("bigint").alias("row_id"), "e.d", "e.n"
    )

    counts = child.groupBy("k").count()
    total = sum(c.rows.count() for c in children)
    least = max(HEAVY_ROWS, int(total * HEAVY_SHARE))
    # at most 1 / HEAVY_SHARE keys, or total / HEAVY_ROWS of them where that is less
    hot = {r.k: -(-r["count"] // least) for r in counts.where(F.col("count") >= least).collect()} if total >= least else {}
    if hot:
        spark = child.sparkSession
        salts = F.broadcast(spark.createDataFrame(list(hot.items()), "k string, s bigint"))
        child = child.join(salts, "k", "left").select(
            "k", "t", "source", "row_id",
            F.coalesce(F.pmod(F.xxhash64("row_id", "source"), F.col("s")), F.lit(0)).cast("int").alias("salt"),
        )
        events = events.join(salts, "k", "left").withColumn(
            "salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("s"), F.lit(1)).cast("int") - 1))
        ).drop("s")
    else:
        child, events = child.withColumn("salt", F.lit(0)), events.withColumn("salt", F.lit(0))
    long = child.withColumn("d", F.lit(0)).withColumn("n", F.lit(0)).unionByName(events)
    # at one time lives open and close before references look
    sweep = W.partitionBy("k", "salt").orderBy("t", F.col("source") >= 0).rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = long.withColumn("alive", F.sum("d").over(sweep)).withColumn("rows", F.sum("n").over(sweep))
    lost = seen.where("source >= 0").where(F.when(F.col("t") == END, F.col("rows") == 0).otherwise(F.col("alive") <= 0))
    names = F.array(*[F.struct(F.lit(c.table).alias("table_name"), F.lit(c.field).alias("field")) for c in children])
    return (
        lost.select(F.element_at(names, F.col("source") + 1).alias("s"), "row_id", "t")
        .select("s.table_name", "row_id", "s.field", F.when(F.col("t") < END, F.timestamp_micros("t")).alias("at"))
        .dropDuplicates(["table_name", "row_id", "field"])
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per table, field and month of the reference; the month of a null time is null."""
    return orphans.groupBy("table_name", "field", F.date_format("at", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("orphans")
    )
