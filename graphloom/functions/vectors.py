"""Array arithmetic as higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def softmax(v: Column) -> Column:
    """Stable softmax of an array."""
    top = F.array_max(v)
    exps = F.transform(v, lambda x: F.exp(x.cast("double") - top.cast("double")))
    total = F.aggregate(exps, F.lit(0.0), lambda a, x: a + x)
    return F.transform(exps, lambda x: x / total)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def rms_norm(v: Column, epsilon: float = 1e-6) -> Column:
    scale = F.sqrt(dot(v, v) / F.size(v) + epsilon)
    return F.transform(v, lambda x: x.cast("double") / scale)


def kl(p: Column, q: Column, epsilon: float = 1e-12) -> Column:
    """Divergence of ``q`` from ``p``; places where ``p`` is below epsilon are passed over."""
    parts = F.zip_with(p, q, lambda x, y: F.when(x >= epsilon, x * F.log(x / F.greatest(y, F.lit(epsilon)))).otherwise(0.0))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def rank_of(v: Column, at: Column) -> Column:
    """How many places of an array hold strictly more than the place ``at`` (from 0)."""
    own = F.element_at(v, at + 1)
    return F.size(F.filter(v, lambda x: x > own))


def top_places(v: Column, k: int) -> Column:
    """The places of the ``k`` largest values, largest first, of equal ones the first."""
    pairs = F.transform(v, lambda x, i: F.struct((-x.cast("double")).alias("neg"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: p.i)
