"""The TypeScript and JavaScript front end: modules, classes, functions, methods, imports, bases and calls.

Comments and literals are blanked first, so that what is left can be read by patterns. A specifier that is a relative path is
a module of the repository; others name packages and bind nothing.
"""

from __future__ import annotations

import posixpath
import re
from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.parsers import CALLS, CLASS, FUNCTION, INHERITS, METHOD, MODULE, assemble, node_id, parsed

_SKIP = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|(?<=[=(,:!&|?{};\[])\s*/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_IMPORT = re.compile(r"^[ \t]*import\s+(?:type\s+)?([^;'\"`]*?)\s*\bfrom\s*['\"]([^'\"\n]+)['\"]", re.MULTILINE)
_NAMED = re.compile(r"(?:\btype\s+)?([\w$]+)(?:\s+as\s+([\w$]+))?")
_CLASS = re.compile(r"\bclass\s+([\w$]+)(?:\s*<[^{]*?>)?(?:\s+extends\s+([\w$]+)(?:\.([\w$]+))?)?[^{;]*\{")
_FUNCTION = re.compile(r"\bfunction\s*\*?\s*([\w$]+)\s*(?:<[^(]*>)?\s*\(")
_ARROW = re.compile(r"\bconst\s+([\w$]+)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:<[^(]*>\s*)?(?:\(|[\w$]+\s*=>)")
_METHOD = re.compile(r"(?:^|[{};])[ \t]*(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*\*?\s*([\w$]+)\s*(?:<[^(]*>)?\s*\(", re.MULTILINE)
_CALL = re.compile(r"(?:(?<![\w$.)\]])([\w$]+)(?:\?)?\.|(\.))?(?<![\w$])([\w$]+)\s*\(")
# Words before a parenthesis that call nothing.
_WORDS = frozenset("if for while switch catch function return typeof await new import do else throw with constructor in of instanceof void delete yield case super async".split())


def _close(text: str, at: int) -> int:
    """Where the bracket that opens at ``at`` closes, or the end."""
    pair = text[at] + {"(": ")", "{": "}"}[text[at]]
    depth = 0
    for m in re.compile(f"[{re.escape(pair)}]").finditer(text, at):
        depth += 1 if m[0] == pair[0] else -1
        if not depth:
            return m.start()
    return len(text)


def module_name(path: str) -> str:
    """The qualified name of a file's module; an ``index`` file is its folder."""
    plain = re.sub(r"(?:\.d)?\.[cm]?[jt]sx?$", "", path.replace("\\", "/"))
    return re.sub(r"(.)/index$", r"\1", plain).replace("/", "::")


def _block(text: str, at: int) -> tuple[int, int]:
    """The braces of the body behind the parameters that open at ``at``; nothing for a declaration that ends without one."""
    i = _close(text, at) + 1
    m = re.compile(r"\s*(?::\s*(?:\{[^{}]*\})?[^{};=\n]*)?\s*(?:=>\s*)?\{").match(text, i)
    return (m.end() - 1, _close(text, m.end() - 1)) if m else (i, i)


def items(repo: int | None, path: str, source: str) -> list[dict]:
    """Nodes, imports and sites of a source."""
    text = _SKIP.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)
    ends = [m.start() for m in re.finditer("\n", text)]
    line = lambda at: bisect_left(ends, at)
    module = module_name(path)
    top = node_id(repo, module, MODULE)
    out = [{"item": "node", "id": top, "kind": MODULE, "name": module.rsplit("::", 1)[-1], "qname": module, "start_line": 0, "end_line": len(ends)}]
    for m in _IMPORT.finditer(source):
        if not text[m.start() : m.end()].lstrip().startswith("import") or not m[2].startswith("."):
            continue
        whole = posixpath.normpath(posixpath.join(posixpath.dirname(path.replace("\\", "/")), m[2]))
        row = {"item": "import", "from_module": module, "module": module_name(whole), "level": 0}
        inner = re.search(r"\{([^}]*)\}", m[1])
        rest = re.sub(r"\{[^}]*\}", "", m[1])
        out += [row | {"style": "symbol", "name": n[1], "alias": n[2]} for n in _NAMED.finditer(inner[1])] if inner else []
        out += [row | {"style": "exact", "alias": n} for n in re.findall(r"\*\s*as\s+([\w$]+)", rest) + re.findall(r"^\s*([\w$]+)\s*(?:,|$)", rest)]
    # bodies: where they lie, the node, what lies around it
    spans: list[tuple[int, int, str]] = []

    def add(name: str, kind: int, above: str, qname: str, start: int, body: tuple[int, int]) -> str:
        own = node_id(repo, f"{qname}::{name}", kind)
        out.append({"item": "node", "id": own, "kind": kind, "name": name, "qname": f"{qname}::{name}", "parent_id": above, "start_line": line(start), "end_line": line(body[1])})
        spans.append((*body, own))
        return own

    for m in _CLASS.finditer(text):
        body = (m.end() - 1, _close(text, m.end() - 1))
        own = add(m[1], CLASS, top, module, m.start(), body)
        if m[2]:
            out.append({"item": "site", "id": own, "shape": "Attribute" if m[3] else "Bare", "base": m[2] if m[3] else None, "name": m[3] or m[2], "category": INHERITS})
        for k in _METHOD.finditer(text, body[0], body[1]):
            inside = text.count("{", body[0], k.start(1)) - text.count("}", body[0], k.start(1))
            block = _block(text, k.end() - 1)
            if inside == 1 and k[1] not in _WORDS - {"constructor"} and block[0] < block[1]:
                add(k[1], METHOD, own, f"{module}::{m[1]}", k.start(1), block)
    for m in _FUNCTION.finditer(text):
        add(m[1], FUNCTION, top, module, m.start(), _block(text, m.end() - 1))
    for m in _ARROW.finditer(text):
        block = _block(text, m.end() - 1) if text[m.end() - 1] == "(" else (m.end(), m.end())
        arrow = "=>" in text[_close(text, m.end() - 1) : block[0] + 1] if text[m.end() - 1] == "(" else True
        if text[m.end() - 1] == "(" and not arrow:
            after = re.compile(r"\s*(?::[^={};]*)?=>").match(text, _close(text, m.end() - 1) + 1)
            if not after:
                continue
            block = (after.end(), text.find("\n", after.end()) if "\n" in text[after.end() :] else len(text))
        add(m[1], FUNCTION, top, module, m.start(), block)
    spans.sort(key=lambda s: s[1] - s[0])
    declared = {m.start(1) for p in (_FUNCTION, _METHOD) for m in p.finditer(text)}
    head = re.compile(r"\s*(?::[^;{}]*)?\{")
    for c in _CALL.finditer(text):
        if c[3] in _WORDS or c.start(3) in declared and head.match(text, _close(text, c.end() - 1) + 1):
            continue
        own = next((o for a, b, o in spans if a < c.start(3) < b), top)
        shape = "ComplexReceiver" if c[2] else "Bare" if not c[1] else "SelfMethod" if c[1] == "this" else "SuperMethod" if c[1] == "super" else "Attribute"
        out.append({"item": "site", "id": own, "shape": shape, "base": c[1] if shape == "Attribute" else None, "name": c[3], "category": CALLS})
    for k, row in enumerate(out):
        row |= {"repo_id": repo, "file": path, "ord": k}
    return out


def parse(files: DataFrame) -> DataFrame:
    """Rows of ``ITEMS`` for the TypeScript and JavaScript files among ``files`` (repo_id, path, source); null sources give nothing."""
    return parsed(files.where(r"path rlike '\\.[cm]?[jt]sx?$' and source is not null").select(F.col("repo_id").cast("bigint"), "path", "source"), items)


def graph(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges (src, dst, category) and unresolved sites of the files among ``files`` (repo_id, path, source)."""
    return assemble(parse(files))
