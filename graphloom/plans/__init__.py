"""Named queries over the engine's tables."""

from graphloom.plans import data, graph, more, parsed, problems, scanners
from graphloom.plans.registry import Query, Registry

ALL = Registry(problems.QUERIES | graph.QUERIES | data.QUERIES | more.QUERIES | scanners.QUERIES | parsed.QUERIES)

__all__ = ["ALL", "Query", "Registry"]
