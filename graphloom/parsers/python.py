"""The Python front end: modules, classes, functions, imports, bases and calls by the interpreter's own syntax tree.

A file is parsed once, on its own; what it says of others is resolved afterwards by joins.
"""

from __future__ import annotations

import ast
import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.parsers import CALLS, CLASS, FUNCTION, INHERITS, METHOD, MODULE, assemble, node_id, parsed


def module_name(path: str) -> str:
    """The qualified name of a file's module; a package's ``__init__`` is the package."""
    parts = path.replace("\\", "/").removesuffix(".py").split("/")
    return "::".join(parts[:-1] if parts[-1] == "__init__" and len(parts) > 1 else parts)


def _target(e: ast.expr) -> tuple[str, str | None, str | None]:
    """Shape, base and name of what is called or inherited from."""
    if isinstance(e, ast.Name):
        return "Bare", None, e.id
    if isinstance(e, ast.Attribute):
        on = e.value
        if isinstance(on, ast.Name):
            return ("SelfMethod", None, e.attr) if on.id in ("self", "cls") else ("Attribute", on.id, e.attr)
        if isinstance(on, ast.Call) and isinstance(on.func, ast.Name) and on.func.id == "super":
            return "SuperMethod", None, e.attr
        return "ComplexReceiver", None, e.attr
    return "ComplexReceiver", None, None


def items(repo: int | None, path: str, source: str) -> list[dict]:
    """Nodes, imports and sites of a source; none if it isn't valid."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    module = module_name(path)
    top = node_id(repo, module, MODULE)
    last = source.count("\n")
    out = [{"item": "node", "id": top, "kind": MODULE, "name": module.rsplit("::", 1)[-1], "qname": module, "start_line": 0, "end_line": last}]
    # nodes of the tree with what lies around them: id, qualified name, whether that is a class
    stack: list[tuple[ast.AST, str, str, bool]] = [(x, top, module, False) for x in reversed(tree.body)]
    while stack:
        n, above, qname, in_class = stack.pop()
        inner = (above, qname, in_class)
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            kind = CLASS if isinstance(n, ast.ClassDef) else METHOD if in_class else FUNCTION
            full = f"{qname}::{n.name}"
            own = node_id(repo, full, kind)
            out.append({"item": "node", "id": own, "kind": kind, "name": n.name, "qname": full, "parent_id": above, "start_line": n.lineno - 1, "end_line": (n.end_lineno or n.lineno) - 1})
            if kind == CLASS:
                for b in n.bases:
                    shape, base, name = _target(b)
                    out.append({"item": "site", "id": own, "shape": shape, "base": base, "name": name, "category": INHERITS})
            inner = (own, full, kind == CLASS)
        elif isinstance(n, ast.Import):
            out += [{"item": "import", "from_module": module, "style": "module", "module": a.name, "alias": a.asname, "level": 0} for a in n.names]
        elif isinstance(n, ast.ImportFrom):
            # relative imports of a package's own module start at the package
            level = max(0, n.level - (path.endswith("__init__.py")))
            out += [{"item": "import", "from_module": module, "style": "symbol", "module": n.module or "", "name": a.name, "alias": a.asname, "level": level} for a in n.names if a.name != "*"]
        elif isinstance(n, ast.Call):
            shape, base, name = _target(n.func)
            out.append({"item": "site", "id": above, "shape": shape, "base": base, "name": name, "category": CALLS})
        stack += [(x, *inner) for x in reversed(list(ast.iter_child_nodes(n)))]
    for k, row in enumerate(out):
        row |= {"repo_id": repo, "file": path, "ord": k}
    return out


def parse(files: DataFrame) -> DataFrame:
    """Rows of ``ITEMS`` for the Python files among ``files`` (repo_id, path, source).

    Null sources, other extensions and invalid sources give nothing. Resent rows give the same again.
    """
    return parsed(files.where("path like '%.py' and source is not null").select(F.col("repo_id").cast("bigint"), "path", "source"), items)


def graph(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges (src, dst, category) and unresolved sites of the Python files among ``files`` (repo_id, path, source)."""
    return assemble(parse(files))
