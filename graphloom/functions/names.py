"""Names in texts and paths as column expressions: imports, diffs, mentions, labels, documentation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*"


def downgrade(confidence: Column) -> Column:
    """One tier down; Weak stays."""
    return F.when(confidence == "Strong", "Medium").otherwise("Weak")


def module_reference(from_module: Column, module: Column, level: Column) -> Column:
    """The qualified name that a (relative) dotted reference in a module means: ``level`` segments up, then ``module``."""
    own = F.split(from_module, "::")
    base = F.array_join(F.slice(own, F.lit(1), F.greatest(F.size(own) - level, F.lit(0))), "::")
    name = F.replace(F.coalesce(module, F.lit("")), F.lit("."), F.lit("::"))
    return F.when(level == 0, name).otherwise(F.concat_ws("::", F.nullif(base, F.lit("")), F.nullif(name, F.lit(""))))


def join_path(prefix: Column, path: Column) -> Column:
    """A route below the prefix of its group: one slash between the parts, one at the start, none at the end."""
    both = F.concat(F.lit("/"), F.coalesce(prefix, F.lit("")), F.lit("/"), F.coalesce(path, F.lit("")))
    plain = F.regexp_replace(F.regexp_replace(both, "/+", "/"), "(.)/$", "$1")
    return plain


def backtick_types(text: Column) -> Column:
    """Identifiers between backticks that begin with a capital, in order."""
    odd = F.filter(F.split(text, "`"), lambda x, i: i % 2 == 1)
    return F.filter(odd, lambda x: x.rlike("^[A-Z][A-Za-z0-9_]*$"))


def dotted_attributes(text: Column) -> Column:
    """Names behind a dot, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"\.({_IDENTIFIER})")))


def file_stems(text: Column) -> Column:
    """Names without extension of the source files that a text names, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9_]+)\.(?:py|js|ts|go|java|rs|rb|php|cs)\b")))


def word_occurrences(text: Column, word: Column) -> Column:
    """How often a word stands in a text as a whole identifier."""
    quoted = F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), word, F.lit(r"\E(?![A-Za-z0-9_])"))
    return F.when(word == "", F.lit(0)).otherwise(F.regexp_count(text, quoted))


def mentions(text: Column) -> Column:
    """Identifiers between backticks and words in camel case with two humps or more, each once."""
    ticks = F.filter(F.filter(F.split(text, "`"), lambda x, i: i % 2 == 1), lambda x: x.rlike(rf"^{_IDENTIFIER}(?:\.{_IDENTIFIER})*$"))
    camel = F.regexp_extract_all(text, F.lit(r"\b((?:[A-Z][a-z0-9]+){2,})\b"))
    return F.array_distinct(F.concat(ticks, camel))


def test_label(label: Column) -> Column:
    """The end of a qualified name that a test id of the form ``path::Class::test[param]`` means."""
    parts = F.split(F.regexp_replace(label, r"\[[^\]]*\]$", ""), "::")
    return F.array_join(F.filter(parts, lambda x: (x != "") & ~x.contains(".") & ~x.contains("/")), "::")


def short_label(qname: Column, kind: Column) -> Column:
    """What a node is called in lists: ``Class.method`` for methods, else its last name."""
    parts = F.split(qname, "::")
    return F.when((kind == 4) & (F.size(parts) > 1), F.array_join(F.slice(parts, -2, 2), ".")).otherwise(F.element_at(parts, -1))


# Folders whose children are features, and what the names of features end in.
CONTAINERS = ("features", "modules", "components", "pages", "services", "domains", "packages", "apps")
FEATURE_SUFFIXES = ("service", "controller", "module", "component", "handler", "repository", "model", "test", "spec")


def feature(path: Column) -> Column:
    """The feature that a path belongs to: the segment behind a container folder, without usual suffixes; null without one."""
    name = F.regexp_extract(path, rf"(?:^|/)(?:{'|'.join(CONTAINERS)})/([^/]+)", 1)
    plain = F.regexp_replace(F.regexp_replace(F.lower(name), r"\.[a-z]+$", ""), rf"[._-](?:{'|'.join(FEATURE_SUFFIXES)})$", "")
    return F.nullif(plain, F.lit(""))


def byte_range(source: Column, first: Column, last: Column) -> Column:
    """Bytes (start, stop) of the lines ``first`` to ``last``, both from 0 and inclusive; beyond the end it is the end."""
    lines = F.split(source, "\n")
    before = lambda n: F.aggregate(
        F.slice(lines, F.lit(1), F.greatest(F.least(n, F.size(lines)), F.lit(0))), F.lit(0), lambda a, x: a + F.octet_length(x) + 1
    )
    total = F.octet_length(source)
    return F.struct(F.least(before(first), total).alias("start"), F.least(before(last + 1), total).alias("stop"))


def clean_doc(text: Column, cap: int = 500) -> Column:
    """Documentation without comment marks and boilerplate, cut to ``cap`` characters; null if nothing is left."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(text, r"(?m)^[ \t]*(?:/\*\*?|\*/|\*(?!/)|//[/!]?|#+|\"\"\"|''')[ \t]?", ""), r"\*/\s*$", ""))
    noise = plain.rlike(r"(?is)^\s*(?:copyright\b|licensed under|spdx-license|eslint-|@ts-|todo\b|fixme\b)")
    return F.when(noise | (plain == ""), None).otherwise(F.substring(plain, 1, cap))


def constants(source: Column) -> Column:
    """Names in capitals that a line begins by binding."""
    return F.array_distinct(F.regexp_extract_all(source, F.lit(r"(?m)^(?:export\s+)?(?:const\s+)?([A-Z][A-Z0-9_]{2,})\s*(?::[^=\n]+)?=(?!=)")))
