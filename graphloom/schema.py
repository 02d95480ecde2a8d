"""The registries of the data model: kinds of nodes and cells, edge categories, and how edges conduct activation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ids are a stable contract.
KINDS = {
    1: "MODULE", 2: "CLASS", 3: "FUNCTION", 4: "METHOD", 5: "ROUTE", 6: "PACKAGE", 7: "INTERFACE", 8: "STRUCT", 9: "ENDPOINT",
    10: "ENUM", 11: "GRPC_SERVICE", 12: "GRPC_CLIENT", 13: "QUEUE_CONSUMER", 14: "QUEUE_PRODUCER", 15: "GRAPHQL_RESOLVER",
    16: "GRAPHQL_OPERATION", 17: "WS_HANDLER", 18: "WS_CLIENT", 19: "EVENT_HANDLER", 20: "EVENT_EMITTER", 21: "CLI_COMMAND",
    22: "CLI_INVOCATION", 23: "DATABASE", 24: "CACHE", 25: "BLOB_STORE", 26: "SEARCH_INDEX", 27: "EMAIL_SERVICE", 28: "COMPONENT",
    29: "HOOK", 30: "SERVICE", 31: "DIRECTIVE", 32: "PIPE", 33: "GUARD", 34: "COMPOSABLE", 35: "ATTRIBUTE", 36: "DATA_ENTITY",
    37: "CRON_JOB", 38: "CONFIG_KEY", 39: "INFRA_RESOURCE", 40: "PACKAGE_DEP", 41: "REGION", 42: "DOC_SECTION", 43: "STATE_VAR",
}
CATEGORIES = {
    1: "DEFINES", 2: "CONTAINS", 3: "IMPORTS", 4: "CALLS", 5: "USES", 6: "DOCUMENTS", 7: "TESTS", 8: "INJECTS", 9: "HANDLED_BY",
    10: "HTTP_CALLS", 11: "GRPC_CALLS", 12: "QUEUE_FLOWS", 13: "GRAPHQL_CALLS", 14: "WS_CONNECTS", 15: "EVENT_FLOWS",
    16: "SHARES_SCHEMA", 17: "CLI_INVOKES", 18: "ACCESSES_DATA", 19: "HAS_ATTRIBUTE", 20: "INHERITS_FROM", 21: "RETURNS_TYPE",
    22: "SHARES_DATA_ENTITY", 23: "SCHEDULES", 24: "SHARES_CRON_SCHEDULE", 25: "READS_CONFIG", 26: "DEFINES_CONFIG",
    27: "SHARES_CONFIG", 28: "INFRA_REFERENCES", 29: "SHARES_INFRA_REF", 30: "DEPENDS_ON", 31: "SHARES_DEPENDENCY", 32: "IMPLEMENTS",
}
CELLS = {
    1: "CODE", 2: "DOC", 3: "POSITION", 4: "INTENT", 5: "ROUTE_METHOD", 6: "ENDPOINT_HIT", 7: "TEST", 8: "ATTN", 9: "FAIL",
    10: "CONSTRAINT", 11: "DECISION", 12: "ENV", 13: "CONV", 14: "VECTOR", 15: "ORIGIN", 16: "IMPORTS",
}
# Weights of edge categories in activation, 1 where none is named, and what a profile changes.
WEIGHTS = {4: 5.0, 10: 5.0, 11: 5.0, 13: 5.0, 12: 4.0, 14: 4.0, 15: 4.0, 17: 3.0, 9: 4.0, 3: 3.0, 5: 3.0, 16: 2.0, 7: 2.0, 8: 2.0, 1: 1.0, 2: 1.0, 6: 0.5}
PROFILES = {
    "default": {},
    "repair": {4: 8.0, 5: 6.0, 18: 6.0, 25: 5.0, 3: 5.0, 7: 4.0},
    "review": {4: 6.0, 7: 6.0, 32: 5.0, 20: 5.0, 21: 4.0},
    "onboard": {2: 5.0, 3: 5.0, 9: 6.0, 1: 3.0, 6: 3.0},
}
# Relation and conductance of a category in exports.
RELATIONS = {
    1: "contains", 2: "contains", 3: "imports", 5: "imports", 4: "calls", 20: "extends", 32: "implements", 30: "depends_on",
    21: "returns", 8: "causes", 9: "causes", 10: "causes", 11: "causes", 12: "causes", 13: "causes", 14: "causes", 15: "causes",
    17: "causes", 18: "causes", 23: "causes", 25: "causes", 28: "causes",
}
CONDUCTANCE = {
    1: 1.0, 2: 1.0, 4: 0.8, 20: 0.8, 32: 0.8, 3: 0.5, 5: 0.5, 21: 0.5, 30: 0.5, 6: 0.3, 16: 0.3, 22: 0.3, 27: 0.3, 24: 0.3, 29: 0.3, 31: 0.3,
}
LINKABLE = (2, 3, 4, 7, 8, 10, 28, 30, 36, 43)
NONCRITICAL = ("tests", "test", "__tests__", "spec", "specs", "fixtures", "fixture", "examples", "example", "e2e", "__mocks__", "mocks", "testdata")
SCHEMA_HINTS = ("Schema", "Validator", "Type", "Model", "Entity", "DTO", "Input", "Output", "Params", "Request", "Response")


def named(c: Column, names: dict[int, str]) -> Column:
    """The registry name of an id, UNKNOWN where there is none."""
    lookup = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(lookup, c), F.lit("UNKNOWN"))


def named_sql(c: str, names: dict[int, str]) -> str:
    return f"CASE {c} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in names.items()) + " ELSE 'UNKNOWN' END"


def weights(profile: str = "default") -> dict[int, float]:
    """Weight of each edge category in a profile; an unknown profile is the default."""
    return {k: 1.0 for k in CATEGORIES} | WEIGHTS | PROFILES.get(profile, {})


def weight(c: Column, profile: str = "default") -> Column:
    lookup = F.create_map(*[F.lit(x) for pair in weights(profile).items() for x in pair])
    return F.coalesce(F.try_element_at(lookup, c), F.lit(1.0))


def weight_sql(c: str, profile: str = "default") -> str:
    return f"CASE {c} " + " ".join(f"WHEN {k} THEN {v}" for k, v in weights(profile).items()) + " ELSE 1.0 END"


def confidence(c: Column) -> Column:
    """Strong, Medium or Weak in one spelling; null and anything else is Weak."""
    low = F.lower(F.trim(c))
    return F.when(low == "strong", "Strong").when(low == "medium", "Medium").otherwise("Weak")


def confidence_sql(c: str) -> str:
    return f"CASE lower(trim({c})) WHEN 'strong' THEN 'Strong' WHEN 'medium' THEN 'Medium' ELSE 'Weak' END"


def conf_rank(c: Column) -> Column:
    return F.when(c == "Strong", 2).when(c == "Medium", 1).otherwise(0)


def from_rank(c: Column) -> Column:
    return F.when(c == 2, "Strong").when(c == 1, "Medium").otherwise("Weak")
