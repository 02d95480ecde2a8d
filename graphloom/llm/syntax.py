"""Source files that do not parse: packrat grammars over every file, the place and cause of a failure, and rates.

Every file is parsed on its own, in one pass over the table without a shuffle. Rows of a resent file give the same result
and become one where results are counted.
"""

from __future__ import annotations

import ast
import re
import sys
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.arrow import map_rows, spread
from graphloom.llm.lexers import LANGUAGES, language

RESULT = "file_id bigint, ext string, valid boolean, position int, line int, cause string"
_MARKERS = re.compile(r"^(?:<{7}|={7}|>{7}|\|{7})(?:[ \r\n]|$)", re.MULTILINE)
_BINARY = re.compile("[\x00-\x08\x0e-\x1a\x1c-\x1f�]")


def extension(path: str | None) -> str:
    """The lower-case extension of a path, without the dot; empty if there is none."""
    name = (path or "").replace("\\", "/").rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[1].lower() if "." in name else ""


def python_accepts(source: str) -> bool:
    """The exact check of Python sources that the grammar rejects."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(source)
        return True
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False


def _deep(check: Callable, *given):
    """``check(*given)``, and again without the bound on recursion if a long chain of one rule reaches it.

    Rules call each other in Python alone, whose frames lie on the heap, so only memory bounds the second run.
    """
    try:
        return check(*given)
    except RecursionError:
        limit = sys.getrecursionlimit()
        sys.setrecursionlimit(1 << 30)
        try:
            return check(*given)
        finally:
            sys.setrecursionlimit(limit)


def is_valid(ext: str, source: str) -> bool | None:
    """Whether the grammar of ``ext`` consumes the whole source; None if there is no such grammar."""
    lang = language(ext)
    if lang is None:
        return None
    return _deep(lang.valid, source) or ext == "py" and python_accepts(source)


def valid_lexed(ext: str, source: str, kinds: list[str]) -> bool:
    """``is_valid`` for a source whose tokens' kinds are known."""
    return _deep(language(ext).valid_kinds, "".join(kinds)) or ext == "py" and python_accepts(source)


def why(ext: str, source: str) -> tuple[int, str]:
    """The furthest position that an invalid source was read to, and the cause."""
    at, how = _deep(language(ext).failure, source)
    if _BINARY.search(source):
        return at, "binary"
    if (m := _MARKERS.search(source)) and at >= m.start() - 1:
        return at, "merge conflict"
    if source.lstrip()[:14].lower().startswith(("<!doctype html", "<html")):
        return at, "wrong extension: html"
    if not (ext in ("js", "ts") and at > 0.9 * len(source)):
        for other in LANGUAGES:
            if other not in (ext, "ts" if ext == "js" else "") and is_valid(other, source):
                return at, f"wrong extension: {other}"
    if how in ("unclosed bracket", "unexpected end") or how == "unterminated literal" and "\n" not in source[at:].rstrip():
        return at, "truncated"
    return at, how


def _parser():
    sys.setrecursionlimit(20_000)

    def rows(file_id, path, source):
        ext = extension(path)
        if source is None or (ok := is_valid(ext, source)) is None:
            return [(file_id, ext, None, None, None, None)]
        if ok:
            return [(file_id, ext, True, None, None, None)]
        at, cause = why(ext, source)
        return [(file_id, ext, False, at, source.count("\n", 0, at), cause)]

    return rows


def parse_files(files: DataFrame) -> DataFrame:
    """One row per row of ``files`` (file_id, path, source): whether it is valid in the language of its extension.

    ``position`` and ``line`` (both 0-based) tell how far an invalid source could be read, ``cause`` why it ends there.
    ``valid`` is null for a null source and for extensions without a grammar. An empty source is valid where the language
    allows an empty file. Other columns of ``files`` are neither read nor kept.
    """
    return map_rows(spread(files.select("file_id", "path", "source")), _parser, RESULT)


def invalid_files(files: DataFrame) -> DataFrame:
    """The distinct files that do not parse, with position, line and cause."""
    return parse_files(files).where("not valid").dropDuplicates(["file_id"])


def rates(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """Files, invalid files and their share per repository and language, and the causes seen."""
    once = parsed.where("valid is not null").dropDuplicates(["file_id"])
    owner = files.select("file_id", "repo").dropDuplicates(["file_id"])
    names = F.create_map(*[F.lit(x) for e, c in LANGUAGES.items() for x in (e, c.name)])
    return (
        once.join(owner, "file_id")
        .groupBy("repo", F.element_at(names, F.col("ext")).alias("language"))
        .agg(
            F.count("*").alias("files"),
            F.count_if(~F.col("valid")).alias("invalid"),
            F.array_sort(F.collect_set("cause")).alias("causes"),
        )
        .withColumn("rate", F.round(F.col("invalid") / F.col("files"), 6))
    )
