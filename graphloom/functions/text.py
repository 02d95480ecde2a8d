"""Text functions as column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.schema import NONCRITICAL, SCHEMA_HINTS


def basename(c: Column) -> Column:
    """What follows the last slash of either kind."""
    return F.regexp_extract(c, r"([^/\\]*)$", 1)


def tail(c: Column) -> Column:
    """The last segment of a qualified name."""
    return F.element_at(F.split(c, "::"), -1)


def path_to_qname(c: Column) -> Column:
    """A path without its extension, with ``::`` between segments."""
    return F.regexp_replace(F.regexp_replace(c, r"\.[^./\\]*$", ""), r"[/\\]", "::")


def normalise_http_path(c: Column) -> Column:
    """One spelling of a route: single slashes, ``{}`` for parameters (``:x``, ``{x}``, ``${...}``), ``/`` for none."""
    parts = F.filter(F.split(F.trim(c), "/"), lambda x: x != "")
    param = lambda x: x.startswith(":") | (x.startswith("{") & x.endswith("}")) | x.contains("${")
    return F.concat(F.lit("/"), F.array_join(F.transform(parts, lambda x: F.when(param(x), "{}").otherwise(x)), "/"))


def cluster_key(qname: Column, depth: int) -> Column:
    """The first ``depth`` segments of a qualified name, but never its last; empty for a name of one segment."""
    parts = F.split(qname, "::")
    n = F.least(F.lit(depth), F.size(parts) - 1)
    return F.when(n > 0, F.array_join(F.slice(parts, F.lit(1), F.greatest(n, F.lit(1))), "::")).otherwise("")


def is_noncritical(qname: Column) -> Column:
    return F.arrays_overlap(F.split(F.lower(qname), "::"), F.array(*map(F.lit, NONCRITICAL)))


def is_test_qname(qname: Column) -> Column:
    low = F.lower(qname)
    return low.rlike(r"::(tests|test|__tests__|spec)::|^(tests|test|spec)::") | tail(low).rlike(r"^test_|(_test|_spec|\.test|\.spec)$")


def strip_test_affixes(name: Column) -> Column:
    """A name without ``test_`` before it or, failing that, one test suffix behind it."""
    return F.when(F.lower(name).startswith("test_"), F.substring(name, 6, 1 << 30)).otherwise(
        F.regexp_replace(name, r"(?i)(_test|_spec|\.test|\.spec)$", "")
    )


def is_generated_proto(path: Column) -> Column:
    return path.rlike(r"\.pb-grpc\.go$|\.pb(json|enum|server)\.dart$|_pb2(_grpc)?\.py$|\.pb\.")


def is_test_fixture(path: Column, qname: Column) -> Column:
    return path.rlike(r"_test\.(go|dart|py)$|\.(spec|test)\.[jt]s$|_spec\.rb$|/(tests|__tests__|test)/") | is_test_qname(qname)


def is_schema_type(qname: Column, kind: Column) -> Column:
    return kind.isin(2, 7, 8) & qname.rlike("|".join(SCHEMA_HINTS))


def glob_match(pattern: Column, text: Column) -> Column:
    """Whether a text matches a pattern in which ``*`` stands for anything."""
    escaped = F.regexp_replace(pattern, r"([.\\+?^$()\[\]{}|])", r"\\$1")
    return F.rlike(text, F.concat(F.lit("^"), F.replace(escaped, F.lit("*"), F.lit(".*")), F.lit("$")))


def backtick_identifiers(text: Column) -> Column:
    """Identifiers of three letters or more between backticks, in order."""
    parts = F.split(text, "`")
    odd = F.filter(parts, lambda x, i: i % 2 == 1)
    return F.filter(odd, lambda x: x.rlike("^[A-Za-z_][A-Za-z0-9_]{2,}$"))


def detect_language(path: Column) -> Column:
    """The language label of a path's extension, null for others."""
    ext = F.regexp_extract(path, r"\.([A-Za-z]+)$", 1)
    # Labels of extensions.
    labels = {
        "py": "python", "go": "go", "js": "typescript", "jsx": "typescript", "vue": "vue", "rs": "rust", "java": "java", "kt": "java",
        "cs": "csharp", "rb": "ruby", "php": "php", "swift": "swift", "c": "c_cpp", "cpp": "c_cpp", "cc": "c_cpp", "cxx": "c_cpp",
        "h": "c_cpp", "hpp": "c_cpp", "scala": "scala", "clj": "clojure", "cljs": "clojure", "cljc": "clojure", "dart": "dart",
        "ex": "elixir", "exs": "elixir", "sol": "solidity", "tf": "terraform", "hcl": "terraform", "proto": "proto",
    }
    lookup = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    angular = ext.isin("ts", "tsx") & path.contains(".component.ts")
    return F.when(angular, "angular").when(ext.isin("ts", "tsx"), "typescript").otherwise(F.try_element_at(lookup, ext))


def always_region(name: Column) -> Column:
    """What a directory's name says of what lies below it."""
    return F.when(name.isin("node_modules", "vendor", "bower_components", ".venv", "site-packages"), "vendored").when(
        name.isin("target", "dist", "build", "out", "__pycache__", ".cache", ".next", ".nuxt", ".angular", "coverage"), "build_output"
    )


def stack_frames(text: Column) -> Column:
    """Paths and 1-based lines of stack frames: ``File "x", line n`` and ``(x.ext:n)``."""
    python = r'File "([^"]+)", line ([0-9]+)'
    other = r"\(([A-Za-z0-9_./-]+\.[A-Za-z]+):([0-9]+)\)"
    pick = lambda p, g: F.regexp_extract_all(text, F.lit(p), F.lit(g))
    return F.concat(F.arrays_zip(pick(python, 1).alias("path"), pick(python, 2).alias("line")), F.arrays_zip(pick(other, 1).alias("path"), pick(other, 2).alias("line")))


def library_name(module: Column, lang: Column) -> Column:
    """The library that an import names, null for relative imports."""
    first = lambda sep: F.element_at(F.split(module, sep), 1)
    scoped = F.regexp_extract(module, r"^(@[^/]+/[^/]+|[^/]+)", 1)
    relative = module.startswith(".") | module.startswith("/")
    return (
        F.when(relative | (module == ""), None)
        .when(lang == "typescript", scoped)
        .when(lang == "python", first(r"\."))
        .when(lang == "rust", F.when(~first("::").isin("crate", "self", "super", "std"), first("::")))
        .when(lang == "java", F.array_join(F.slice(F.split(module, r"\."), 1, 2), "."))
        .when(lang == "go", F.when(module.contains("."), module))
        .otherwise(module)
    )
