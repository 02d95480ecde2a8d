"""Generated, minified, bundled, vendored files and data stored as code.

A file is lexed, put into canonical layout and compared with it (``canonical``). A file whose statements expand to many
more lines than it has was minified or bundled; one of records that are laid out alike and count in equal steps was
written by a tool; one of nearly nothing but literals is data. Marks that tools leave in comments before or after the
code, known third-party sources and the regions of a repository tell the rest.
"""

from __future__ import annotations

import re
import sys
from functools import lru_cache
from itertools import compress

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.arrow import map_rows, spread
from graphloom.llm.canonical import Canonical
from graphloom.llm.lexers import NL0, language
from graphloom.llm.syntax import extension, is_valid, valid_lexed
from graphloom.session import materialise

RESULT = "file_id bigint, ext string, expansion double, uniformity double, literals double, kind string, n int, rare array<bigint>, valid boolean"
#: Canonical lines to one original line from which a file is minified, and the code characters it needs at least.
EXPANSION, EXPANSION_CHARS = 4.0, 200
#: Share of the lines that are records and of their steps that are equal from which a file is generated, with so many
#: lines at least; and the same without steps, for files of very many records.
UNIFORMITY, STEPS, LINES = 0.7, 0.8, 8
PERFECT, PERFECT_LINES = 0.95, 200
#: Share of a file that is literals (by tokens, and by characters of numbers and of strings without blanks).
LITERALS, OPAQUE = 0.7, 0.6
#: Five-token shingles that a copy shares with its original, of those in either.
SHINGLE, SIMILARITY = 5, 0.8
#: Bits of the filter that shingles of files have to pass before they are moved: 2 MiB whatever the size of the upstream.
FILTER_BITS = 1 << 24

# What tools write into their output, in several languages.
_TOOL_MARK = re.compile(
    r"code generated\b.*\bdo not (?:edit|modify)|@generated\b|<auto-?generated|auto-?generated (?:file|from|by|code)|generated automatically"
    r"|(?:this|the) (?:file|code|source) (?:is|was|has been) (?:\w+ )?(?:auto-?)?(?:matically )?(?:generated|produced|created) (?:automatically )?(?:by|from|with)"
    r"|(?:automatically|machine)[- ](?:generated|written|produced)\b.*\b(?:by|from|do not)|\bgenerated (?:by|from|with)\b.*\b(?:do not|don't|overwritten|lost|edit)"
    r"|generated from the .*\bschema\b|produced by \w[\w.-]*.*\bedit the (?:template|source|schema)|changes will be (?:lost|overwritten)"
    r"|end of the output of|regenerate instead of|do not (?:edit|modify|change|touch)(?: this file| by hand|[,.;!]|$).*\bgenerat"
    r"|automatisch (?:erzeugt|generiert|erstellt)|(?:generado|producido|creado) autom[áa]ticamente|(?:g[ée]n[ée]r[ée]|produit|cr[ée][ée]) automatiquement"
    r"|(?:gerado|produzido|criado) automaticamente|automatisch (?:gegenereerd|aangemaakt|gemaakt)|generato automaticamente"
    r"|(?:сгенерирован|создан)\w* автоматически|автоматически (?:сгенерирован|создан)|自動生成|自動的に生成",
    re.IGNORECASE,
)
_NOT_A_MARK = re.compile(r"is written by|not by this file|by hand|n't generated|not generated|hand-?written|emit(?:s|ter)|the header ['\"`]", re.IGNORECASE)
_BY_HAND = re.compile(r"(?:modify|edit|change) (?:this file )?by hand", re.IGNORECASE)
_HASH_LINE = re.compile(r"^[ \t]*#(?![\[!])", re.MULTILINE)


def margins(ext: str, text: str, tokens: list[str], pieces: list[str], solid: np.ndarray) -> tuple[str, str]:
    """What stands before the first and after the last token: comments, however long they are.

    ``solid`` tells which of the ``pieces`` of the text are the tokens with the blanks before them.

    Inner attributes of a Rust file belong to its head.
    """
    k = 0
    while ext == "rs" and tokens[k : k + 3] == ["#", "!", "["]:
        depth, k = 1, k + 3
        while depth and k < len(tokens):
            depth += (tokens[k] == "[") - (tokens[k] == "]")
            k += 1
    if k >= len(tokens):
        return text, ""
    at = np.flatnonzero(solid)
    return text[: sum(map(len, pieces[: at[k] + 1])) - len(tokens[k])], text[len(text) - sum(map(len, pieces[at[-1] + 1 :])) :]


def marked(*comments: str) -> bool:
    """Whether a line of ``comments`` says that a tool made the file."""
    return any(_TOOL_MARK.search(c) and not _NOT_A_MARK.search(_BY_HAND.sub("", c)) for x in comments for c in x.split("\n"))


def tool_mark(src: str, ext: str | None = None) -> bool:
    """Whether a comment at the head or the foot of the file says that a tool made it; without ``ext``, ``#`` means Python."""
    return marked(*Layout(ext or ("py" if _HASH_LINE.search(src) else "js"), src).margins)


class Layout:
    """What the layout of a source has in common with its canonical one."""

    def __init__(self, ext: str, src: str) -> None:
        lang = language(ext)
        text = "\n" + src if ext == "py" else src
        pieces, texts, _, kinds = lang.lexed(text, ends=False)
        c = self.canonical = Canonical(lang, pieces, texts, kinds)
        self.tokens = c.tokens
        self.margins = margins(ext, text, c.tokens, pieces, c.solid)
        self.kinds = kinds
        self.chars, self.lines = int(c.widths.sum()), c.lines
        self.expansion = c.expansion
        # numbers, and strings without a blank
        opaque = 0
        if 2 * c.widths[c.literal].sum() > self.chars:
            opaque = sum([len(t) for t in compress(c.tokens, c.literal.tolist()) if not (" " in t or "\n" in t)])
        lit, words = int(c.literal.sum()), c.words
        self.literals = lit / max(1, lit + words)
        self.opaque = opaque / max(1, self.chars)
        self.uniformity, self.count = c.uniformity()

    @property
    def kind(self) -> str | None:
        if self.chars >= EXPANSION_CHARS:
            if self.literals >= LITERALS and self.literals + self.opaque >= 1.1 or self.opaque >= OPAQUE:
                return "data"
            if self.expansion >= EXPANSION:
                return "minified"
        if self.uniformity >= UNIFORMITY and self.count >= LINES and self.canonical.counting() >= STEPS:
            return "generated"
        if self.uniformity >= PERFECT and self.count >= PERFECT_LINES:
            return "generated"
        return None


class _Hashes(dict):
    """Numbers of tokens as they are met, and stable 64-bit hashes by number."""

    def __init__(self) -> None:
        super().__init__()
        self.hashes = np.zeros(1 << 12, np.uint64)

    def __missing__(self, t: str) -> int:
        n = len(self)
        if n == len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros(n, np.uint64)])
        self.hashes[n] = xxhash.xxh3_64_intdigest(t)
        self[t] = n
        return n

    def of(self, tokens: list[str]) -> np.ndarray:
        if len(self) > 300_000:
            self.clear()
        found = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        return self.hashes[found]


_TOKEN_HASHES = _Hashes()
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingles(tokens: list[str]) -> np.ndarray:
    """The distinct hashes of runs of five tokens in ascending order; fewer tokens are one run."""
    if not tokens:
        return np.zeros(0, np.int64)
    h = _TOKEN_HASHES.of(tokens)
    n = max(1, len(h) - SHINGLE + 1)
    total = np.zeros(n, np.uint64)
    for i, m in enumerate(_MIX[: min(SHINGLE, len(h))]):
        x = h[i : i + n] * m
        total += x ^ (x >> np.uint64(29))
    total ^= total >> np.uint64(32)
    total *= _MIX[1]
    found = np.sort((total ^ (total >> np.uint64(31))).view(np.int64))
    new = np.ones(len(found), bool)
    new[1:] = found[1:] != found[:-1]
    return found[new]


def rare(found: np.ndarray) -> np.ndarray:
    """The shingles of which two sources must share one if they are similar enough: the first in one order for all.

    Of n shingles any other set with the similarity has all but n - ceil(0.8 n), so one of the first n - ceil(0.8 n) + 1.
    The order is that of the hashes, which is as good as random, so shingles that are in every file are seldom first.
    """
    n = len(found)
    return found[: n - int(np.ceil(SIMILARITY * n - 1e-9)) + 1] if n else found


def _bits(found: np.ndarray) -> np.ndarray:
    return (found.view(np.uint64) % np.uint64(FILTER_BITS)).astype(np.int64)


def _judge(shared):
    def make():
        sys.setrecursionlimit(20_000)
        words, values = shared.value
        bits = np.zeros(FILTER_BITS // 64, np.uint64)
        bits[words] = values

        def rows(file_id, path, source):
            ext = extension(path)
            if not source or language(ext) is None:
                return [(file_id, ext, *[None] * 7)]
            a = Layout(ext, source)
            kind = a.kind or ("marked" if marked(*a.margins) else None)
            own, hits = shingles(a.tokens), None
            if not kind and len(own):
                at = _bits(own)
                known = (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
                # no one source can share more than all of them together
                if known.sum() >= SIMILARITY * len(own) - 1e-9:
                    first = len(rare(own))
                    hits = own[:first][known[:first]].tolist()
            return [(file_id, ext, a.expansion, a.uniformity, a.literals, kind, len(own), hits, valid_lexed(ext, source, a.kinds) if kind else None)]

        return rows

    return make


def _rare_rows():
    def rows(file_id, path, source):
        ext = extension(path)
        if not source or language(ext) is None:
            return []
        found = shingles(Layout(ext, source).tokens)
        first = len(rare(found))
        return [(file_id, len(found), h, w, i < first) for i, (h, w) in enumerate(zip(found.tolist(), _bits(found).tolist(), strict=True))]

    return rows


def _similar():
    sys.setrecursionlimit(20_000)

    @lru_cache(1000)
    def known(path: str, source: str) -> tuple[np.ndarray, list[str]]:
        ext = extension(path)
        _, texts, _, kinds = language(ext).lexed("\n" + source if ext == "py" else source, ends=False)
        return shingles([t for t, k in zip(texts, kinds, strict=True) if k and k != "\n" and not NL0 <= ord(k[0]) < 0xF900]), kinds

    def rows(file_id, path, source, up, up_path, up_source):
        (a, kinds), (b, _) = known(path, source), known(up_path, up_source)
        shared = len(np.intersect1d(a, b, assume_unique=True))
        alike = shared / max(1, len(a) + len(b) - shared)
        return [(file_id, up, alike)] if alike >= SIMILARITY and valid_lexed(extension(path), source, kinds) else []

    return rows


class Upstream:
    """Known third-party sources (lib, path, source): their first shingles, and a filter of fixed size for all of them."""

    def __init__(self, upstream: DataFrame) -> None:
        named = upstream.where("source <> ''").select(F.concat_ws("/", "lib", "path").alias("name"), "path", "source")
        # one of the names of equal sources
        self.sources = named.groupBy("path", "source").agg(F.min("name").alias("name")).withColumn("file_id", F.xxhash64("path", "source"))
        found = materialise(map_rows(self.sources.select("file_id", "path", "source"), _rare_rows, "up bigint, m int, h bigint, bit bigint, first boolean"), "upstream")
        self.rare = found.where("first").select("up", "m", "h").distinct()
        # at most FILTER_BITS / 64 words
        words = found.select(F.shiftright("bit", 6).alias("w"), F.expr("shiftleft(1L, int(bit % 64))").alias("v"))
        rows = words.groupBy("w").agg(F.bit_or("v").alias("v")).toPandas()
        spark = upstream.sparkSession
        self.filter = spark.sparkContext.broadcast((rows["w"].to_numpy(np.int64), rows["v"].to_numpy(np.int64).view(np.uint64)))


def copies(files: DataFrame, laid: DataFrame, upstream: Upstream) -> DataFrame:
    """Valid files that are like an upstream source (file_id, upstream): the most similar one, of equal ones the first by name.

    Files and sources meet by their first shingles, for which no pair of the similarity is missed; only those that meet
    are compared, by all their shingles. ``laid`` are rows of ``judged``.
    """
    met = laid.where("rare is not null").select("file_id", "n", F.explode("rare").alias("h")).distinct()
    # sizes of similar sets are near each other
    near = F.col("n").between(F.ceil(SIMILARITY * F.col("m") - 1e-9), F.floor(F.col("m") / SIMILARITY + 1e-9))
    pairs = met.join(upstream.rare, "h").where(near).select("file_id", "up").distinct()
    pairs = materialise(pairs, "pairs")
    known = upstream.sources.select(F.col("file_id").alias("up"), F.col("path").alias("up_path"), F.col("source").alias("up_source"))
    texts = files.select("file_id", "path", "source").join(pairs.select("file_id").distinct(), "file_id", "left_semi").dropDuplicates(["file_id"])
    both = texts.join(pairs, "file_id").join(known, "up").select("file_id", "path", "source", "up", "up_path", "up_source")
    alike = map_rows(both, _similar, "file_id bigint, up bigint, alike double")
    named = alike.join(upstream.sources.select(F.col("file_id").alias("up"), "name"), "up")
    return named.groupBy("file_id").agg(F.min_by("name", F.struct(-F.col("alike"), F.col("name"))).alias("upstream"))


def judged(files: DataFrame, upstream: Upstream) -> DataFrame:
    """One row per row of ``files`` (file_id, path, source) with its layout and what kind of file that makes it.

    ``kind`` is minified, generated, data, marked (by a tool's comment) or null; ``valid`` is only known where there is a
    kind. ``rare`` are the file's first shingles that an upstream source may have too. A null or empty source and an
    extension without a lexer have no layout.
    """
    return map_rows(spread(files.select("file_id", "path", "source")), _judge(upstream.filter), RESULT)


def plain_path(c: Column) -> Column:
    """A path with forward slashes, without empty and ``.`` segments."""
    parts = F.split(F.replace(F.trim(c), F.lit("\\"), F.lit("/")), "/")
    return F.array_join(F.filter(parts, lambda x: (x != "") & (x != ".")), "/")


def provenances(files: DataFrame, regions: DataFrame) -> DataFrame:
    """``file_id`` and provenance of the files below a region; the deepest region counts, at one depth authored first.

    Regions are looked up for the distinct directories, not for every file.
    """
    folder = F.regexp_replace(plain_path(F.col("path")), r"/?[^/]*$", "")
    named = files.select("file_id", F.trim("repo").alias("repo"), folder.alias("dir")).dropDuplicates(["file_id"])
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    dirs = named.select("repo", "dir").distinct().select("repo", "dir", F.posexplode(F.array_distinct(above)).alias("depth", "prefix"))
    provenance = F.regexp_replace(F.lower(F.trim("provenance")), r"[\s-]+", "_")
    known = (
        regions.select(F.trim("repo").alias("repo"), plain_path(F.col("rel_path")).alias("prefix"), provenance.alias("provenance"))
        .where("provenance is not null and prefix is not null")
        .groupBy("repo", "prefix")
        .agg(F.min_by("provenance", F.struct(F.col("provenance") != "authored", "provenance")).alias("provenance"))
    )
    best = dirs.join(known, ["repo", "prefix"]).groupBy("repo", "dir").agg(F.max_by("provenance", "depth").alias("provenance"))
    return named.join(best, ["repo", "dir"]).select("file_id", "provenance")


def not_handwritten(files: DataFrame, upstream: DataFrame, regions: DataFrame) -> DataFrame:
    """Valid files that aren't hand-written, with the reason: a kind of ``judged``, ``vendored`` for copies of upstream
    sources, or the provenance of their region."""
    below = materialise(provenances(files, regions), "provenances")
    known = Upstream(upstream)
    laid = materialise(judged(files, known).where("kind is not null or size(rare) > 0"), "laid")  # read twice below
    made = laid.where("kind is not null and valid").select("file_id", "kind").dropDuplicates(["file_id"])
    copied = copies(files, laid.where("kind is null"), known).select("file_id", F.lit("vendored").alias("kind"))
    made = materialise(made.unionByName(copied), "made")
    placed = below.where("provenance <> 'authored'")
    rest = placed.join(made, "file_id", "left_anti")
    inside = files.join(rest, "file_id").select("file_id", "path", "source", "provenance")
    checked = map_rows(inside, _validity, "file_id bigint, kind string").dropDuplicates(["file_id"])
    return made.join(below.where("provenance = 'authored'"), "file_id", "left_anti").unionByName(checked)


def _validity():
    sys.setrecursionlimit(20_000)

    def rows(file_id, path, source, provenance):
        ok = source is not None and is_valid(extension(path), source)
        return [(file_id, f"region: {provenance}")] if ok else []

    return rows
