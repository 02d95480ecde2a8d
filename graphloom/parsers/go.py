"""The Go front end: packages, types, functions, methods, imports and calls.

Comments and literals are blanked first, so that what is left can be read by patterns; a package is one module, whatever
number of files it has.
"""

from __future__ import annotations

import re
from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.parsers import CALLS, FUNCTION, INTERFACE, METHOD, MODULE, STRUCT, assemble, node_id, parsed

_SKIP = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|\"(?:\\.|[^\"\\\n])*\"|`[^`]*`|'(?:\\.|[^'\\\n])+'")
_PACKAGE = re.compile(r"^\s*package\s+(\w+)", re.MULTILINE)
_IMPORT = re.compile(r"^import\s*(?:\(([^)]*)\)|([^\n]*))", re.MULTILINE)
_SPEC = re.compile(r"([\w.]+)?[ \t]*\"([^\"\n]+)\"")
_TYPE = re.compile(r"^type\s+(\w+)(?:\[[^\]\n]*\])?\s+(struct|interface)\b", re.MULTILINE)
_FUNC = re.compile(r"^func\s*(?:\(\s*(?:(\w+)\s+)?\*?\s*(\w+)(?:\[[^\]\n]*\])?\s*\)\s*)?(\w+)\s*(?:\[[^\]\n]*\]\s*)?\(", re.MULTILINE)
_CALL = re.compile(r"(?:(?<![\w.)\]])(\w+)\.|(\.))?\b(\w+)\(")
_MODULE = re.compile(r"^\s*module\s+(\S+)", re.MULTILINE)
# Words before a parenthesis that call nothing.
_WORDS = frozenset("if for switch select func return go defer range case interface struct map chan import package var const type else".split())


def _blank(src: str) -> str:
    """The source with comments and literals as blanks, of the same length and lines."""
    return _SKIP.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), src)


def _close(text: str, at: int, pair: str) -> int:
    """Where the bracket that opens at ``at`` closes, or the end."""
    depth = 0
    for m in re.compile(f"[{re.escape(pair)}]").finditer(text, at):
        depth += 1 if m[0] == pair[0] else -1
        if not depth:
            return m.start()
    return len(text)


def _body(text: str, at: int) -> tuple[int, int]:
    """The braces of a function's body after its parameters, which open at ``at``; a declaration without one ends its line."""
    i = _close(text, at, "()") + 1
    while i < len(text) and text[i] != "\n":
        if text[i] == "(":
            i = _close(text, i, "()")
        elif text[i] == "{":
            if not re.search(r"(?:interface|struct)\s*\Z", text[max(0, i - 20) : i]):
                return i, _close(text, i, "{}")
            i = _close(text, i, "{}")
        i += 1
    return i, i


def items(repo: int | None, path: str, source: str, prefix: str | None = None) -> list[dict]:
    """Nodes, imports and sites of a source; ``prefix`` is the path of the repository's module, that its imports begin with."""
    text = _blank(source)
    package = _PACKAGE.search(text)
    if not package:
        return []
    folder = path.replace("\\", "/").rpartition("/")[0]
    module = folder.replace("/", "::") or package[1]
    top = node_id(repo, module, MODULE)
    ends = [m.start() for m in re.finditer("\n", text)]
    line = lambda at: bisect_left(ends, at)
    out = [{"item": "node", "id": top, "kind": MODULE, "name": module.rsplit("::", 1)[-1], "qname": module, "start_line": 0, "end_line": line(len(text))}]
    for m in _IMPORT.finditer(text):
        # the paths themselves are blanked
        for s in _SPEC.finditer(source, m.start(), m.end()):
            alias, whole = s[1] if s[1] not in ("import", ".", "_") else None, s[2]
            inner = whole[len(prefix) :].lstrip("/") if prefix and (whole == prefix or whole.startswith(prefix + "/")) else whole
            out.append({"item": "import", "from_module": module, "style": "exact", "module": inner.replace("/", "::"), "alias": alias, "level": 0})
    for m in _TYPE.finditer(text):
        kind, qname = STRUCT if m[2] == "struct" else INTERFACE, f"{module}::{m[1]}"
        out.append({"item": "node", "id": node_id(repo, qname, kind), "kind": kind, "name": m[1], "qname": qname, "parent_id": top, "start_line": line(m.start()), "end_line": line(_close(text, m.end(), "{}"))})
    for m in _FUNC.finditer(text):
        own, kind = (f"{module}::{m[2]}", METHOD) if m[2] else (module, FUNCTION)
        above, qname = node_id(repo, own, STRUCT) if m[2] else top, f"{own}::{m[3]}"
        id_ = node_id(repo, qname, kind)
        first, last = _body(text, m.end() - 1)
        out.append({"item": "node", "id": id_, "kind": kind, "name": m[3], "qname": qname, "parent_id": above, "start_line": line(m.start()), "end_line": line(last)})
        for c in _CALL.finditer(text, first, last):
            if c[3] in _WORDS:
                continue
            shape = "ComplexReceiver" if c[2] else "Bare" if not c[1] else "SelfMethod" if c[1] == m[1] else "Attribute"
            out.append({"item": "site", "id": id_, "shape": shape, "base": c[1] if shape == "Attribute" else None, "name": c[3], "category": CALLS})
    for k, row in enumerate(out):
        row |= {"repo_id": repo, "file": path, "ord": k}
    return out


def parse(files: DataFrame) -> DataFrame:
    """Rows of ``ITEMS`` for the Go files among ``files`` (repo_id, path, source), with imports by the module of each go.mod at the top.

    Null sources, other extensions and sources without a package give nothing. Resent rows give the same again.
    """
    own = files.where("path = 'go.mod'").groupBy(F.col("repo_id").cast("bigint").alias("repo_id")).agg(F.min(F.regexp_extract("source", _MODULE.pattern.replace("^", "(?m)^", 1), 1)).alias("prefix"))
    rows = files.where("path like '%.go' and source is not null").select(F.col("repo_id").cast("bigint"), "path", "source")
    return parsed(rows.join(own, "repo_id", "left").select("repo_id", "path", "source", "prefix"), items)


def graph(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges (src, dst, category) and unresolved sites of the Go files among ``files`` (repo_id, path, source)."""
    return assemble(parse(files))
