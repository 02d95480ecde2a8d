"""Functions paired with their documentation.

Each file is read once, by the lexer of its language: that finds functions and methods, the comments around them and the
types they lie in. Together functions and types are a symbol table across files, keyed by repository, module, owner, name
and normalised signature. A declaration without a body that carries the documentation is joined with the definition of its
own owner or of an owner that extends or implements it; then functions without documentation, or with a trivial one, are
dropped.
"""

from __future__ import annotations

import posixpath
import re
import sys
from bisect import bisect_right
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from hashlib import blake2b
from itertools import accumulate, compress

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.arrow import map_rows, spread
from graphloom.llm.lexers import NL0, language
from graphloom.llm.syntax import extension, valid_lexed
from graphloom.session import materialise

RESULT = (
    "file_id bigint, ext string, owner string, name string, params string, start_line int, end_line int,"
    " documentation string, code string, body boolean"
)
#: Rows of the symbol table: functions, and types (without a name) with the types they extend or implement. ``scope`` is the
#: owner, in Rust with the trait of the impl block.
SYMBOLS = RESULT + ", repo string, path string, module string, scope string, ambient boolean, trivial boolean, bases array<string>"
#: The same without code and text, which it takes to tell which function is documented by what: ``documentation`` is 128 bits
#: that stand for what a declaration without a body says.
KEYS = (
    "file_id bigint, ext string, name string, params string, start_line int, documentation string, body boolean,"
    " repo string, module string, scope string, ambient boolean, trivial boolean, bases array<string>"
)
#: Documentation with fewer words is trivial.
LEAST_WORDS = 4

_OPEN, _CLOSE = {"(", "[", "{"}, {")", "]", "}"}
#: Up, down or level by kind; kinds before folding are in the first plane.
_STEP = np.zeros(1 << 16, np.int8)
_STEP[[ord(c) for c in "([{"]], _STEP[[ord(c) for c in ")]}"]] = 1, -1
_IDENTIFIER = re.compile(r"#?[\w$]+\Z")
_RUST_NAME = re.compile(r"(?:r#)?[^\W\d]\w*\Z")

# Words and forms that say nothing about a function.
_DIRECTIVE = re.compile(
    r"\s*(?:nolint\b|eslint[-\s]|tslint:|jshint\b|jslint\b|noinspection\b|rustfmt|go:\w|\+build\b|lint:|nosec\b|nosonar\b|noqa\b"
    r"|type:\s*ignore|pylint:|pyright:|mypy:|flake8:|isort:|yapf:|fmt:|ruff:|prettier-ignore|istanbul\b|c8 ignore|v8 ignore|checkstyle:|clang-format\b"
    r"|spotless:|@?formatter:|@ts-\w|biome-ignore|deno-\w|pragma:|coverage:|codecov|spell-?checker:|cspell:|language=|region\b|endregion\b"
    r"|clippy::|cargo-\w|swagger:|sourceMappingURL|webpack\w+:)",
    re.IGNORECASE,
)
_PLACEHOLDERS = re.compile(
    r"\b(?:todo|fixme|xxx|tbd|hack|tba|wip)\b[:\s-]*(?:document this|write me|add (?:docs|documentation|description))?"
    r"|\b(?:no description(?: (?:provided|available|yet))?|description here|(?:add|insert) description(?: here)?|docstring(?: here)?|see above|see below|undocumented|not documented|lorem ipsum"
    r"|document(?:ed)? (?:this|me)|write me|placeholder|summary here|missing documentation|auto-?generated method stub|inheritdoc)\b",
    re.IGNORECASE,
)
_SECTIONS = re.compile(
    r"\s*(?:#+\s*)?(?:args|arguments|parameters|params|returns?|yields?|raises|throws|errors|examples?|panics|safety|attributes"
    r"|keyword args|keyword arguments|other parameters|notes?|see also|references|warnings?)\s*:?\s*",
    re.IGNORECASE,
)
_PARAM_SECTION = re.compile(r"\s*(?:#+\s*)?(?:args|arguments|parameters|params|attributes|raises|throws|keyword arg\w*|other parameters)\s*:?\s*", re.IGNORECASE)
_TAG = re.compile(
    r"\{@\w+[^}]*\}"
    r"|@(?:param|arg|argument|property|prop|throws|exception|template|typeparam|tparam|type)\b(?:[ \t]*\{[^}]*\})?(?:[ \t]+(?:\[[^\]]*\]|<\w+>|[\w.$*]+))?(?:[ \t]+-(?=\s|$))?"
    r"|[@\\](?:[a-z]\w*)(?:[ \t]*\{[^}]*\})?"
    r"|:(?:param|parameter|arg|argument|key|keyword|type|raises?|raise|except|exception|var|ivar|cvar|vartype|returns?|rtype|yields?|meta)\b[^:\n]*:"
    r"|<(?:/?(?:param|returns|summary|remarks|typeparam|exception))\b[^>]*>",
)
_DASHES = re.compile(r"\s*[-=~]{3,}\s*")
_PARAM_LINE = re.compile(r"\s*[*-]?\s*[`*]*(\w+)[`*]*\s*(?:\([^)]*\)\s*)?(:(?=\s|$)|-(?=\s))?")
_LINES = re.compile(r"\r\n|\n|\r")
#: A line without anything that tags, placeholders with marks or sections are made of.
_PLAIN = re.compile(r"[ \t]*[^\W\d_][\w \t,.;()'’\"!?-]*\Z")
#: Words that a plain line of a directive or with a placeholder has one of.
_SUSPECT = frozenset(
    "nolint eslint tslint jshint jslint noinspection rustfmt nosec nosonar noqa ignore istanbul clang deno pragma codecov spell spellchecker cspell region"
    " endregion clippy cargo swagger sourcemappingurl todo fixme xxx tbd hack tba wip description docstring see undocumented documented lorem document"
    " write placeholder summary documentation stub inheritdoc".split()
)
_WORD = re.compile(r"[぀-ゟ]+|[゠-ヿー]+|[一-鿿々]+|[^\W\d_぀-ヿ一-鿿]+(?:['’][^\W\d_]+)*")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_a-zA-Z]+")


def comment_lines(comment: str) -> list[str]:
    """The lines of a comment without its markers."""
    out = []
    for part in comment.split("\n") if "\r" not in comment else _LINES.split(comment):
        t = part.strip()
        line = t.startswith("//")
        if line:
            t = t[2:].lstrip("/!")
        elif t.startswith("/*"):
            t = t[2:].lstrip("*!")
        if t.endswith("*/"):
            t = t[:-2].rstrip("*")
        if not line:
            u = t.lstrip()
            if u.startswith("*") and not u.startswith("**"):
                t = u[2:] if u[1:2].isspace() else u[1:]
        out.append(t)
    return out


def words_left(lines: list[str], name: str, params: set[str]) -> list[str]:
    """The words of a documentation without the function's name, tags with parameter names, directives, placeholders."""
    kept, in_params, dashes = [], False, _DASHES
    for i, line in enumerate(lines):
        if _DIRECTIVE.match(line):
            continue
        marked = ":" in line or line.strip().startswith("#") or i + 1 < len(lines) and dashes.fullmatch(lines[i + 1])
        if marked and _SECTIONS.fullmatch(line):
            in_params = bool(_PARAM_SECTION.fullmatch(line))
            continue
        if in_params:
            # name : type, name (type): ..., * `name` - ...
            m = _PARAM_LINE.match(line)
            if m and (m[1] in params or m[2] and line[:1].isspace()):
                rest = line[m.end() :]
                line = "" if m[2] == ":" and re.match(r"\s*:", line[m.end(1) :]) and re.search(r"\w\s+:", line) else rest
        kept.append(line)
    text = _PLACEHOLDERS.sub(" ", _TAG.sub(" ", "\n".join(kept)))
    own = {p.lower() for p in _PARTS.findall(name)} | {name.lower()}
    return [w for w in _WORD.findall(text) if w.lower() not in own]


def is_trivial(lines: list[str], name: str, params: set[str] = frozenset()) -> bool:
    # mostly the first lines are plain words and say it already
    own, left = None, 0
    for line in lines:
        if not line:
            continue
        if not _PLAIN.match(line):
            break
        words = _WORD.findall(line.lower())
        if len(words) < LEAST_WORDS or not _SUSPECT.isdisjoint(words):
            break  # it may be a section, a directive or a placeholder
        if own is None:
            own = {p.lower() for p in _PARTS.findall(name)} | {name.lower()}
        left += sum([w not in own for w in words])
        if left >= LEAST_WORDS:
            return False
    return len(words_left(lines, name, params)) < LEAST_WORDS


@dataclass
class Function:
    owner: str
    name: str
    at: int
    start: int
    end: int
    params: list[str]
    types: list[str]
    doc: list[str] | None
    body: bool
    scope: str = ""
    ambient: bool = False


@dataclass
class Owner:
    """A type, an impl block or a Rust module: its span by token, and what it extends or implements."""

    start: int
    end: int
    name: str
    bases: list[str]
    ambient: bool

    @property
    def scope(self) -> str:
        return f"{self.name}<{self.bases[0]}>" if self.bases and self.bases[0].startswith("impl ") else self.name


class Starts:
    """Where tokens begin, by where they end."""

    def __init__(self, ends: Iterable[int], texts: list[str]) -> None:
        self.ends, self.texts = list(ends), texts

    def __getitem__(self, i: int) -> int:
        return self.ends[i] - len(self.texts[i])

    def __len__(self) -> int:
        return len(self.texts)


class Tokens:
    """Tokens and comments of a brace-language source with their offsets, and the partner of every bracket."""

    def __init__(self, ext: str, src: str, lexed=None) -> None:
        lang = language(ext)
        _, texts, ends, kinds = lexed or lang.lexed(src)
        self.src = src
        solid = [k != "\n" and k != "" for k in kinds]
        self.t = list(compress(texts, solid))
        self.at = Starts(compress(ends, solid), self.t)
        self.k = "".join(compress(kinds, solid))
        if len(self.k) != len(self.t):
            # a token with the regular expression after it is two
            t, stops, done = [], [], 0
            for i, k in enumerate(compress(kinds, solid)):
                if len(k) > 1 and (r := lang.with_regex.match(self.t[i])):
                    end = self.at.ends[i]
                    t += self.t[done:i] + [r[1], r[3]]
                    stops += self.at.ends[done:i] + [end - len(r[3]) - len(r[2]), end]
                    done = i + 1
            self.t = t + self.t[done:]
            self.at = Starts(stops + self.at.ends[done:], self.t)
        # brackets that belong together: at one depth the n-th that opens and the n-th that closes
        step = _STEP[np.frombuffer(self.k.encode("utf-16-le"), np.uint16)]
        depth = np.cumsum(step, dtype=np.int32)
        opens, closes = np.flatnonzero(step > 0), np.flatnonzero(step < 0)
        self.opens, self.depth = opens, depth[opens]
        a = opens[np.argsort(self.depth, kind="stable")].tolist()
        z = closes[np.argsort(depth[closes], kind="stable")].tolist()
        self.partner = dict(zip(a, z)) | dict(zip(z, a))  # noqa: B905 - an invalid source has more of one kind
        self.starts = [0, *accumulate([len(x) + 1 for x in src.split("\n")])]
        # own-line comments by the line they end on
        self.ends_on = {}
        for i in [i for i, x in enumerate(solid) if not x and texts[i][:1] == "/"]:
            b = ends[i]
            a = b - len(texts[i])
            begin = src.rfind("\n", 0, a) + 1
            rest = src.find("\n", b)
            if not src[begin:a].strip() and not src[b : rest if rest >= 0 else len(src)].strip():
                self.ends_on[self.line(b - 1)] = (self.line(a), a, b)

    def inside(self, bodies: list[int]) -> list[int]:
        """The opening parentheses right inside one of the braces ``bodies``."""
        out = []
        for b in bodies:
            first = int(np.searchsorted(self.opens, b))
            last = int(np.searchsorted(self.opens, self.partner.get(b, len(self.k))))
            at = self.opens[first + 1 : last][self.depth[first + 1 : last] == self.depth[first] + 1]
            out += [i for i in at.tolist() if self.k[i] == "(" and i in self.partner]
        return sorted(out)

    def words(self, lang_words: set[str], ext: str) -> list[int]:
        """The tokens that are one of some words of the language."""
        key = (ext, *sorted(lang_words))
        if key not in _WORD_KINDS:
            of = language(ext).kinds.of
            found = "".join(of[w] for w in lang_words if w in of)
            _WORD_KINDS[key] = re.compile(f"[{re.escape(found)}]" if found else r"(?!)")
        return [m.start() for m in _WORD_KINDS[key].finditer(self.k)]

    def line(self, offset: int) -> int:
        return bisect_right(self.starts, offset) - 1

    def documentation(self, first: int, skip: list[tuple[int, int]]) -> list[str] | None:
        """The comment that ends right above line ``first``, past the annotations on the lines of ``skip``."""
        over = {b: a for a, b in skip}
        while True:
            above = first - 1
            if above in self.ends_on:
                break
            if above in over and over[above] <= above:
                first = over[above]
                continue
            return None
        a, i, j = self.ends_on[above]
        pieces = [self.src[i:j]]
        # line comments right above each other are one comment
        while pieces[-1].startswith("//") and a - 1 in self.ends_on:
            a, i, j = self.ends_on[a - 1]
            if not self.src[i:j].startswith("//"):
                break
            pieces.append(self.src[i:j])
        return [x for p in reversed(pieces) for x in comment_lines(p)]

    def until(self, i: int, stop: set[str]) -> int:
        """The first token from ``i`` on that is in ``stop``, outside brackets."""
        while i < len(self.t) and self.t[i] not in stop:
            i = self.partner.get(i, i) + 1 if self.t[i] in _OPEN else i + 1
        return i


_WORD_KINDS: dict[tuple[str, ...], re.Pattern] = {}


def _arguments(k: Tokens, i: int, ext: str) -> tuple[list[str], list[str]]:
    """Names and normalised types of the parameters in the brackets that open at token ``i``."""
    names, types, part = [], [], []
    end = k.partner.get(i, i)
    depth = 0
    for j in range(i + 1, end + 1):
        x = k.t[j]
        if j == end or x == "," and depth == 0:
            if part:
                cut = part.index("=") if "=" in part else len(part)
                p = part[:cut]
                if ext in ("ts", "js", "rs"):
                    c = p.index(":") if ":" in p else len(p)
                    words = [w for w in p[:c] if re.fullmatch(r"[\w$]+", w) and w not in ("mut", "ref", "public", "private", "readonly", "protected")]
                    names.append(words[-1] if words else "")
                    types.append("".join(p[c + 1 :]))
                elif ext == "go":
                    names.append(p[0])
                    types.append("".join(p[1:]) or p[0])
                else:
                    names.append(p[-1])
                    types.append("".join(w for w in p[:-1] if w not in ("final",)))
            part = []
            continue
        depth += (x in _OPEN or x == "<") - (x in _CLOSE or x == ">")
        part.append(x)
    return names, types


_MODIFIERS = {
    "js": {"export", "default", "async", "static", "get", "set", "*", "function", "const"},
    "go": set(),
    "rs": {"pub", "const", "async", "unsafe", "extern", "default", "crate"},
}
_MODIFIERS["ts"] = _MODIFIERS["js"] | {"public", "private", "protected", "readonly", "abstract", "override", "declare"}
_NOT_METHODS = set("if for while switch catch function return typeof new await super import with do else throw".split())
_MEMBER_END = {";", "{", "}"}
_TYPE_WORDS = {"class", "interface", "enum", "record", "struct", "trait", "impl", "mod", "namespace"}


def _bases(k: Tokens, word: str, i: int, stop: int) -> list[str]:
    """Simple names of what a type extends or implements (``impl`` before the trait of an impl block), from its head."""
    out, name, depth, on, t = [], "", 0, word == "impl", k.t
    while i < stop:
        x = t[i]
        if x in _OPEN:
            i = k.partner.get(i, i) + 1
            continue
        if set(x) <= {"<", ">"}:
            depth += x.count("<") - x.count(">")
        elif depth <= 0 and word == "impl":
            if x == "for":
                return [f"impl {name}"] if name else []
            name = x if re.fullmatch(r"\w+", x) else name
        elif depth <= 0 and (x in ("extends", "implements", "permits") or on and x == ","):
            out, name, on = out + [name] * bool(name), "", x != "permits" and (on or x != ",")
        elif depth <= 0 and on and re.fullmatch(r"[\w$]+", x):
            name = x
        i += 1
    return out + [name] * bool(name) if word != "impl" else []


def _owners(k: Tokens, ext: str) -> list[Owner]:
    """Types, impl blocks and Rust modules."""
    out, t = [], k.t
    if ext == "go":
        return out
    for i in k.words(_TYPE_WORDS, ext):
        x = t[i]
        if i and t[i - 1] in (".", "::") or i + 1 >= len(t):
            continue
        j = i + 1
        name = t[j]
        if x == "impl":
            stop = k.until(j, {"{", ";"})
            words = [w for w in t[j:stop] if re.fullmatch(r"\w+", w)]
            name = t[t.index("for", j, stop) + 1] if "for" in t[j:stop] else re.sub(r"<.*", "", next((w for w in words if w[0].isupper()), words[0] if words else ""))
        elif not re.fullmatch(r"[\w$]+", name) or name in ("extends", "implements"):
            if x != "class":
                continue
            name = ""
        stop = k.until(j, {"{", ";", "}", ")", "="} if x != "impl" else {"{", ";"})
        if stop < len(t) and t[stop] == "{" and stop in k.partner:
            first = i
            while first and t[first - 1] in ("export", "default", "abstract", "declare"):
                first -= 1
            out.append(Owner(stop, k.partner[stop], name, _bases(k, x, j, stop), "declare" in t[first:i]))
    return out


def brace_functions(ext: str, src: str, lexed=None, types: list | None = None) -> list[Function]:
    """Functions of a source; the scopes of its types and what they extend or implement are added to ``types``."""
    k = Tokens(ext, src, lexed)
    t, at, out = k.t, k.at, []
    owners = _owners(k, ext)
    bodies = [o.start for o in owners]
    modifiers = _MODIFIERS.get(ext, set())
    if types is not None:
        for o in owners:
            if o.bases or o.name:
                around = [x.name for x in owners if x.start < o.start < x.end and x.name]
                types.append(("::".join([*around, o.scope]), [x.removeprefix("impl ") for x in o.bases]))

    def owner(i: int) -> str:
        return "::".join(o.name for o in owners if o.start < i < o.end and o.name)

    def add(name: int, first: int, call: int, skip: list[tuple[int, int]], own: str, end: int, body: bool) -> None:
        names, kinds = _arguments(k, call, ext) if call >= 0 and t[call] == "(" else ([t[call]] if call >= 0 else [], [""])
        doc = k.documentation(k.line(at[first]), skip)
        stop = at[end] + len(t[end]) if end < len(t) else len(src)
        around = [o for o in owners if o.start < name < o.end]
        scope = "::".join(o.scope for o in around if o.name) if around else own
        ambient = "declare" in t[first:name] or any(o.ambient for o in around)
        out.append(Function(own, t[name], at[name], at[first], stop, names, kinds, doc, body, scope, ambient))

    def back(i: int) -> tuple[int, list[tuple[int, int]]]:
        """The first token of a declaration before token ``i`` and the lines of the attributes before that."""
        j = i
        while j > 0 and (t[j - 1] in modifiers or ext == "rs" and (t[j - 1][0] == '"' or t[j - 1] == ")" and k.partner.get(j - 1, 0) and t[k.partner[j - 1] - 1] == "pub")):
            j = k.partner[j - 1] if t[j - 1] == ")" else j - 1
        first, skip = j, []
        while j > 0:
            if ext == "rs" and t[j - 1] == "]" and (p := k.partner.get(j - 1, 0)) and t[p - 1] in ("#", "!"):
                p -= 1 if t[p - 1] == "#" else 2
            elif ext in ("js", "ts") and (q := _decorator(j - 1)) >= 0:
                p = q
            else:
                break
            skip.append((k.line(at[p]), k.line(at[j - 1])))
            j = p
        return first, skip

    def _decorator(last: int) -> int:
        """The start of the decorator that ends at token ``last``, or -1."""
        j = k.partner.get(last, -1) - 1 if t[last] == ")" else last
        while j > 0 and re.fullmatch(r"[\w$]+", t[j]):
            if t[j - 1] == "@":
                return j - 1
            if t[j - 1] != ".":
                return -1
            j -= 2
        return -1

    n = len(t)
    if ext == "go":
        outer = [a for a in k.opens[k.depth == 1].tolist() if k.partner.get(a, -1) > a]
        for i in k.words({"func"}, ext):
            j, own = i + 1, ""
            at_or_before = bisect_right(outer, i) - 1
            if j >= n or at_or_before >= 0 and k.partner[outer[at_or_before]] > i:
                continue
            if t[j] == "(" and j in k.partner:
                after = k.partner[j] + 1
                words = [w for w in t[j:after] if _IDENTIFIER.match(w)]
                if after + 1 >= n or not _IDENTIFIER.match(t[after]) or t[after + 1] != "(":
                    continue
                own, j = words[-1] if words else "", after
            if _IDENTIFIER.match(t[j]) and j + 1 < n and t[j + 1] in ("(", "["):
                call = j + 1 if t[j + 1] == "(" else k.partner.get(j + 1, j) + 1
                body = _go_body(k, call)
                add(j, i, call, [], own, k.partner.get(body, body) if body >= 0 else k.partner.get(call, call), body >= 0)
    elif ext == "rs":
        for i in k.words({"fn"}, ext):
            if i + 1 < n and _RUST_NAME.match(t[i + 1]):
                first, skip = back(i)
                call = k.until(i + 2, {"(", "{", ";"})
                stop = k.until(k.partner.get(call, call) + 1, {"{", ";"}) if call < n and t[call] == "(" else n
                body = stop < n and t[stop] == "{"
                add(i + 1, first, call, skip, owner(i), k.partner.get(stop, stop) if body else min(stop, n - 1), body)
    elif ext in ("js", "ts"):
        for i in k.words({"function", "const"}, ext):
            if t[i] == "function":
                j = i + 2 if i + 1 < n and t[i + 1] == "*" else i + 1
                if (not i or t[i - 1] != ".") and j < n and _IDENTIFIER.match(t[j]):
                    call = k.until(j + 1, {"(", "{", ";"})
                    if call < n and t[call] == "(":
                        first, skip = back(i)
                        stop = _js_body(k, k.partner.get(call, call) + 1)
                        body = stop < n and t[stop] == "{"
                        add(j, first, call, skip, owner(i), k.partner.get(stop, stop) if body else min(stop, n - 1), body)
            elif i + 2 < n and _IDENTIFIER.match(t[i + 1]):
                call, arrow = _arrow(k, i + 2)
                if arrow >= 0:
                    first, skip = back(i)
                    if arrow + 1 < n and t[arrow + 1] == "{":
                        end = k.partner.get(arrow + 1, n - 1)
                    else:
                        end = min(k.until(arrow + 1, {";", "}"}), n - 1)
                    add(i + 1, first, call, skip, owner(i), end, True)
        for p in k.inside(bodies):
            # a method: only modifiers between it and the member before it
            i = p - 1
            if t[i] == ">":
                while i > 0 and t[i] != "<":
                    i -= 1
                i -= 1
            if not _IDENTIFIER.match(t[i]) or t[i] in _NOT_METHODS:
                continue
            first, skip = back(i)
            if not (skip or t[first - 1] in _MEMBER_END):
                continue
            stop = _js_body(k, k.partner[p] + 1)
            body = stop < n and t[stop] == "{"
            add(i, first, p, skip, owner(i), k.partner.get(stop, stop) if body else min(stop, n - 1), body)
    elif ext == "java":
        for i in k.inside(bodies):
            if not _IDENTIFIER.match(t[i - 1]):
                continue
            j = i - 1
            while j > 0 and not (t[j - 1] in _MEMBER_END or t[j - 1] == "," and _enum_constant(t, j)):
                j = k.partner[j - 1] if t[j - 1] in (")", "]") and j - 1 in k.partner else j - 1
            skip, first = [], j
            while first < i - 1 and t[first] == "@" and t[first + 1] != "interface":
                last = first + 1
                while last + 2 < i and t[last + 1] == ".":
                    last += 2
                if t[last + 1] == "(":
                    last = k.partner.get(last + 1, last + 1)
                skip.append((k.line(at[first]), k.line(at[last])))
                first = last + 1
            if "=" in t[first:i] or t[first] in ("return", "new", "throw") or t[i - 2] in ("new", ".", "@"):
                continue
            if first == i - 1 and not _enum_or_ctor(k, i, owners):
                continue
            stop = k.until(k.partner[i] + 1, {"{", ";", "}", ","})
            body = stop < n and t[stop] == "{"
            if not body and (stop >= n or t[stop] != ";" or first == i - 1):
                continue
            add(i - 1, first, i, skip[::-1], owner(i), k.partner.get(stop, stop), body)
    return out


def _arrow(k: Tokens, i: int) -> tuple[int, int]:
    """The parameters and the arrow of a constant's arrow function, from the token after its name; -1 without."""
    t, n = k.t, len(k.t)
    eq = i if t[i] == "=" else k.until(i, {"=", ";"})
    if eq >= n or t[eq] != "=":
        return -1, -1
    j = eq + 1 + (eq + 1 < n and t[eq + 1] == "async")
    if j >= n:
        return -1, -1
    call = j if t[j] == "(" else k.until(j, {"(", ";"}) if t[j] == "<" else -1
    if call >= 0 and call in k.partner:
        a = k.partner[call] + 1
        if a < n and t[a] == ":":
            a = k.until(a, {"=>", ";", "="})
        return call, a if a < n and t[a] == "=>" else -1
    return (j, j + 1) if call < 0 and j + 1 < n and t[j + 1] == "=>" else (-1, -1)


def _enum_constant(t: list[str], j: int) -> bool:
    return bool(re.fullmatch(r"[A-Z_]\w*", t[j]))


def _enum_or_ctor(k: Tokens, i: int, owners) -> bool:
    """Whether a member that begins with its name is a constructor."""
    inner = [o.name for o in owners if o.start < i < o.end]
    return bool(inner) and inner[-1] == k.t[i - 1]


def _js_body(k: Tokens, i: int) -> int:
    """The token of the body, or what ends a declaration without one, after the parameters."""
    t, n = k.t, len(k.t)
    if i < n and t[i] == ":":
        i += 1
        while i < n:
            if t[i] == "{":
                # a type literal goes on with a body or an operator
                after = k.partner.get(i, i) + 1
                if after < n and t[after] in ("{", "|", "&", "["):
                    i = after
                    continue
                return i if t[i - 1] not in (":", "|", "&", "<", "=>") else after
            if t[i] in (";", "}", ","):
                return i
            i = k.partner.get(i, i) + 1 if t[i] in _OPEN else i + 1
    return i


def _go_body(k: Tokens, call: int) -> int:
    """The token of a Go function's body after its parameters, or -1."""
    t, n = k.t, len(k.t)
    i = k.partner.get(call, call) + 1
    line = k.line(k.at[i - 1])
    while i < n and k.line(k.at[i]) == line:
        if t[i] == "{":
            if t[i - 1] not in ("interface", "struct"):
                return i
            i = k.partner.get(i, i) + 1
        elif t[i] in _OPEN:
            i = k.partner.get(i, i) + 1
        else:
            i += 1
        line = k.line(k.at[i - 1]) if i <= n else line
    return -1


def python_functions(src: str, lexed=None) -> list[Function]:
    """Functions of a Python source; a logical line begins one if its first words are ``def`` or ``async def``."""
    lang = language("py")
    shift = 0 if src.startswith("\ufeff") else -1
    _, t, ends, kinds = lexed or lang.lexed("\n" + src.removeprefix("\ufeff"))
    solid = list(map(bool, kinds))
    # comments are out, but the end of the text stays
    solid[-1] = True
    t, ends, kinds = list(compress(t, solid)), compress(ends, solid), list(compress(kinds, solid))
    at = Starts([x + shift for x in ends], t)
    # tokens that begin a logical line, with the width of its indentation
    lines, depth, n = [], 0, len(t)
    for i in [m.start() for m in _PY_MARKS.finditer("".join(kinds))]:
        k = kinds[i]
        if k in _OPEN:
            depth += 1
        elif k in _CLOSE:
            depth -= 1
        elif depth <= 0 and i + 1 < n and kinds[i + 1]:
            lines.append((i + 1, ord(k) - NL0))
    out: list[Function] = []
    scopes: list[tuple[int, str]] = []
    open_: list[tuple[int, Function]] = []
    for i, width in lines:
        while open_ and open_[-1][0] >= width:
            # the last token before this line's break
            open_.pop()[1].end = at[i - 2] + len(t[i - 2])
        j = i + 1 if t[i] == "async" else i
        if j + 1 >= n or t[j] not in ("def", "class"):
            continue
        while scopes and scopes[-1][0] >= width:
            scopes.pop()
        name = t[j + 1]
        if t[j] == "def":
            owner = "::".join(c for _, c in scopes)
            f = Function(owner, name, at[j + 1], at[i], len(src), *_python_header(t, kinds, j + 2), True)
            out.append(f)
            open_.append((width, f))
        scopes.append((width, name))
    last = next((i for i in range(n - 1, -1, -1) if kinds[i] and not NL0 <= ord(kinds[i][0]) < 0xF900), -1)
    for _, f in open_:
        f.end = at[last] + len(t[last])
    return out


_PY_MARKS = re.compile(r"[()\[\]{}\ue000-\uf8ff]")
_PLAIN_STRING = re.compile(r"[rRuU]?[\"']")


def _python_header(t: list[str], kinds: list[str], j: int) -> tuple[list[str], list[str], list[str] | None]:
    """Parameters, their (empty) types and the docstring of the function whose parameters begin at token ``j``."""
    n, depth, names, part = len(t), 0, [], []
    while j < n and not (t[j] == ":" and depth == 0):
        x = t[j]
        if depth == 1 and (x == "," or x == ")"):
            words = [w for w in part if w not in ("*", "**", "/")]
            if words:
                names.append(words[0])
            part = []
        elif depth == 1 and not NL0 <= ord(kinds[j][0]) < 0xF900:
            part.append(x)
        depth += (x in _OPEN) - (x in _CLOSE)
        j += 1
    j += 1
    if j < n and kinds[j] and NL0 <= ord(kinds[j][0]) < 0xF900:
        j += 1
    doc = []
    while j < n and _PLAIN_STRING.match(t[j]):
        doc.append(_UNQUOTE.sub(r"\2", t[j]))
        j += 1
    ends = j >= n or not kinds[j] or NL0 <= ord(kinds[j][0]) < 0xF900 or t[j] == ";"
    text = re.split(r"\r\n|\n|\r", "".join(doc)) if doc and ends else None
    return names, [""] * len(names), text


_UNQUOTE = re.compile(r"\A[rRuU]?(\"\"\"|\'\'\'|\"|')([\s\S]*)\1\Z")


def functions_of(ext: str, src: str, lexed=None, types: list | None = None) -> list[Function]:
    return python_functions(src, lexed) if ext == "py" else brace_functions(ext, src, lexed, types)


_NEEDED = {"py": "def", "go": "func", "rs": "fn", "java": "(", "js": "(", "ts": "("}
_QUALIFIER = re.compile(r"\b(?:\w+\.|\w+::)+")


def _read(path: str | None, source: str | None, types: list) -> tuple[str, list[Function]]:
    """Extension and functions of a file; none if it isn't valid. ``types`` takes its types."""
    ext = extension(path)
    lang = language(ext)
    if not source or lang is None:
        return ext, []
    lexed = lang.lexed("\n" + source.removeprefix("\ufeff") if ext == "py" else source)
    if ext in _NEEDED:
        of = lang.kinds.of
        begins = [_NEEDED[ext], *(_TYPE_WORDS if ext not in ("py", "go") else ())]
        if not any(of[w] in lexed[3] for w in begins if w in of):
            return ext, []  # nothing that a function or a type begins with
    return ext, functions_of(ext, source, lexed, types) if valid_lexed(ext, source, lexed[3]) else []


_JAVA_IMPORT = re.compile(r"^\s*import\s+(?:static\s+)?([\w.]+)\s*;", re.MULTILINE)
_TS_IMPORT = re.compile(r"^\s*import\s+([^;'\"]*?)\s+from\s+['\"](\.[^'\"]*)['\"]", re.MULTILINE)
_RUST_USE = re.compile(r"^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+((?:\w+::)+)(?:(\w+)(?:\s+as\s+(\w+))?|\{([^{}]*)\})\s*;", re.MULTILINE)
_TS_NAME = re.compile(r"([\w$]+)(?:\s+as\s+([\w$]+))?")


def _module(path: str) -> str:
    """A path without its extension, in TypeScript without that of a declaration file either."""
    return re.sub(r"(?:\.d)?\.\w+$", "", path.replace("\\", "/"))


def imported(ext: str, path: str, src: str) -> dict[str, str]:
    """Where the names that a source imports come from: ``=`` and a path that must be theirs, or ``~`` and a likely one."""
    out = {}
    if ext == "java":
        for m in _JAVA_IMPORT.finditer(src):
            out[m[1].rsplit(".", 1)[-1]] = "=" + m[1].replace(".", "/")
    elif ext in ("ts", "js"):
        for m in _TS_IMPORT.finditer(src):
            at = re.sub(r"\.[jt]sx?$", "", posixpath.normpath(posixpath.join(posixpath.dirname(path.replace("\\", "/")), m[2])))
            for n in _TS_NAME.finditer(re.sub(r"\btype\s+(?=[\w${])", "", m[1])):
                out[n[2] or n[1]] = f"~{at}/{n[1]}"
    elif ext == "rs":
        for m in _RUST_USE.finditer(src):
            parts = m[1].split("::")[:-1]
            inner = [x for x in parts if x not in ("crate", "self", "super")]
            for n in _TS_NAME.finditer(m[4]) if m[4] else [(None, m[2], m[3])]:
                if inner:
                    out[n[2] or n[1]] = ("~" if len(inner) < len(parts) else "=") + "/".join([*inner, n[1]])
    return out


def signature(f: Function) -> str:
    """The number of parameters and their types without qualifiers and blanks, as overloads are told apart by."""
    types = ",".join(f.types)
    return f"{len(f.params)}:" + (_QUALIFIER.sub("", types) if "." in types or "::" in types else types)


def _keyed(source: str, found: list[Function]) -> list[tuple[Function, str, int, bool | None]]:
    """Each function with its signature, its line, and whether its documentation is trivial."""
    out, line, at = [], 0, 0
    for f in sorted(found, key=lambda f: f.at):
        line, at = line + source.count("\n", at, f.at), f.at
        out.append((f, signature(f), line, None if f.doc is None else is_trivial(f.doc, f.name, set(f.params))))
    return out


def _text(f: Function) -> str | None:
    """The documentation without directives."""
    return None if f.doc is None else "\n".join(x.strip() for x in f.doc if not _DIRECTIVE.match(x)).strip()


def _ambient(path: str | None) -> bool:
    return (path or "").lower().endswith(".d.ts")


def _bases_by_scope(ext: str, path: str | None, source: str, types: list) -> list[tuple[str, list[str]]]:
    """The types of a source with where their bases come from: as ``imported`` says, or ``?`` and a name."""
    known = imported(ext, path or "", source) if any(bases for _, bases in types) else {}
    return [(scope, [known.get(b, "?" + b) for b in bases]) for scope, bases in types]


def _key_rows():
    sys.setrecursionlimit(20_000)

    def rows(file_id, path, source, repo=None):
        types = []
        ext, found = _read(path, source, types)
        module, out = _module(path or ""), []
        for f, params, line, trivial in _keyed(source, found):
            says = None if f.body or f.doc is None else blake2b(_text(f).encode(), digest_size=16).hexdigest()
            out.append((file_id, ext, f.name, params, line, says, f.body, repo, module, f.scope or f.owner, _ambient(path) or f.ambient, trivial, None))
        for scope, bases in _bases_by_scope(ext, path, source, types):
            out.append((file_id, ext, *[None] * 5, repo, module, scope, None, None, bases))
        return out

    return rows


def _extractor():
    sys.setrecursionlimit(20_000)

    def rows(file_id, path, source, repo=None):
        types = []
        ext, found = _read(path, source, types)
        module, out = _module(path or ""), []
        for f, params, line, trivial in _keyed(source, found):
            last = line + source.count("\n", f.at, max(f.at, f.end - 1))
            code = source[f.start : f.end].rstrip()
            scope = f.scope or f.owner
            out.append(
                (file_id, ext, f.owner, f.name, params, line, last, _text(f), code, f.body, repo, path, module, scope, _ambient(path) or f.ambient, trivial, None)
            )
        for scope, bases in _bases_by_scope(ext, path, source, types):
            out.append((file_id, ext, *[None] * 8, repo, path, module, scope, None, None, bases))
        return out

    return rows


def _columns(files: DataFrame) -> list[str]:
    return ["file_id", "path", "source", *[c for c in files.columns if c == "repo"]]


def symbols(files: DataFrame) -> DataFrame:
    """Functions and types of the valid files among ``files`` (file_id, path, source, repo if there is one); documentation may be trivial."""
    return map_rows(spread(files.select(*_columns(files))), _extractor, SYMBOLS)


def keys(files: DataFrame) -> DataFrame:
    """The same symbol table with the columns of ``KEYS``."""
    return map_rows(spread(files.select(*_columns(files))), _key_rows, KEYS)


def functions(files: DataFrame) -> DataFrame:
    """One row per function or method of the valid files among ``files`` (file_id, path, source).

    ``documentation`` is null where a function has none or a trivial one. Files with null or empty source, unknown
    extension or invalid source have no functions. Resent rows give the same functions again.
    """
    found = symbols(files).where("name is not null").withColumn("documentation", F.expr("if(trivial, null, documentation)"))
    return found.select(*[x.split()[0] for x in RESULT.split(", ")])


def _place() -> list[Column]:
    """128 bits that stand for a qualified name and signature, so that joins don't move the texts."""
    by = ["repo", "ext", "module", "scope", "name", "params"]
    return [F.xxhash64(*by).alias("k1"), F.xxhash64(F.lit(1), *by).alias("k2")]


def described(found: DataFrame) -> DataFrame:
    """File and line of every documented function, and ``at_file`` and ``at_line`` of the function that carries its documentation.

    ``found`` has the columns of ``KEYS``. A function with documentation of its own that isn't trivial carries it itself; any
    other definition takes what ``lent`` finds. Resent rows count once.
    """
    plain = found.where("name is not null")
    own = plain.where("not trivial").select("file_id", "start_line", F.col("file_id").alias("at_file"), F.col("start_line").alias("at_line"))
    met = plain.where("body and coalesce(trivial, true)").select("file_id", "start_line", *_place())
    met = met.join(lent(found).select(*_place(), F.col("at.file_id").alias("at_file"), F.col("at.start_line").alias("at_line")), ["k1", "k2"])
    return own.unionByName(met.select(*own.columns)).distinct()


def documented(files: DataFrame) -> DataFrame:
    """File and line of every function whose documentation stands directly above it or inside and isn't trivial.

    The rows come from the symbol table and its join; code and texts stay in the worker. A definition that a declaration
    elsewhere describes is left out after the join. Null, empty and invalid sources and unknown extensions give no rows; of
    ``files`` only file_id, path, source and repo are read.
    """
    found = described(materialise(keys(files), "keys"))  # read several times; the pass over the sources is made once
    return found.where("at_file = file_id and at_line = start_line").select("file_id", "start_line")


_HOME = ["repo", "ext"]


def _folder(module: str | Column) -> Column:
    return F.regexp_replace(module, r"/?[^/]*$", "")


def _endings(path: Column) -> Column:
    """A path, and what is left of it without its first folder, its first two and so on."""
    parts = F.split(path, "/")
    return F.transform(parts, lambda _, i: F.array_join(F.slice(parts, i + 1, F.size(parts)), "/"))


def bases_of(types: DataFrame) -> DataFrame:
    """What each type (repo, ext, module, scope, bases) extends or implements: (repo, ext, module, scope, up_module, up_scope, far).

    A base is the type that the import names, else one of that name in the same module, the same folder or, if there is
    only one, elsewhere in the repository; several that are equally near are none. ``far`` counts the steps up, as far as
    there are any; cycles end by themselves.
    """
    own = F.expr("replace(scope, '::', '/')")
    inner = F.regexp_replace("module", "/(mod|lib|index)$", "")
    up = F.struct(F.col("module").alias("up_module"), F.col("scope").alias("up_scope"))
    known = types.where("not contains(scope, '<')").select(
        *_HOME, up.alias("up"), F.element_at(F.split("scope", "::"), -1).alias("simple"),
        F.array_distinct(F.concat(_endings(F.concat(_folder("module"), F.lit("/"), own)), _endings(F.concat(inner, F.lit("/"), own)))).alias("named"),
    ).distinct()
    wanted = types.select(*_HOME, "module", "scope", F.explode("bases").alias("base")).distinct()
    simple, named = F.regexp_extract("base", r"([^/?=~]*)$", 1), F.expr("substring(base, 2)")

    def levels_of(module: Column, simple: Column) -> list[Column]:
        """Where a type is looked for, the nearest first, after the place that an import names."""
        at = [F.concat_ws("/", simple, module), F.concat_ws("/", simple, _folder(module)), simple]
        return [F.struct(F.lit(n).alias("near"), x.alias("key")) for n, x in enumerate(at, 1)]

    by_name = F.transform("named", lambda x: F.struct(F.lit(0).alias("near"), x.alias("key")))
    there = known.select(*_HOME, "up", F.inline(F.concat(by_name, F.array(*levels_of(F.col("up.up_module"), F.col("simple"))))))
    # a type that extends its namesake isn't its own base, so what else there is is told by two types and their number
    there = there.groupBy(*_HOME, "near", "key").agg(F.min("up").alias("up"), F.max("up").alias("__other"), F.count("*").alias("__of"))
    by_import = F.array(F.struct(F.lit(0).alias("near"), named.alias("key")))
    other = F.array(*levels_of(F.col("module"), simple))
    sought = F.when(F.col("base").startswith("="), by_import).when(F.col("base").startswith("?"), other).otherwise(F.concat(by_import, other))
    met = wanted.select("*", F.inline(sought)).join(there, [*_HOME, "near", "key"]).withColumn("__self", up)
    met = met.where("__of > 1 or up <> __self")
    one = F.expr("CASE WHEN __of = 1 THEN up WHEN __of = 2 AND up = __self THEN __other WHEN __of = 2 AND __other = __self THEN up END")
    met = met.select(*_HOME, "module", "scope", "base", "near", one.alias("up"))
    best = met.groupBy(*_HOME, "module", "scope", "base").agg(F.min_by("up", "near").alias("up"))
    direct = best.where("up is not null").select(*_HOME, "module", "scope", "up.*").distinct()
    direct = materialise(direct, "bases")
    # a class stands for its impl blocks only in Rust, where blocks have no bases above their trait
    step = direct.select(*_HOME, F.col("module").alias("m"), F.col("scope").alias("s"), F.col("up_module").alias("um"), F.col("up_scope").alias("us"))
    pair = [*_HOME, "module", "scope", "up_module", "up_scope"]
    level, levels = direct.withColumn("far", F.lit(1)), []
    while levels == [] or not level.isEmpty():
        levels.append(level)
        seen = reduce(DataFrame.unionByName, levels)
        above = level.withColumnsRenamed({"up_module": "m", "up_scope": "s"}).join(step, [*_HOME, "m", "s"])
        above = above.where("um <> module or us <> scope").select(*_HOME, "module", "scope", F.col("um").alias("up_module"), F.col("us").alias("up_scope")).distinct()
        level = materialise(above.join(seen, pair, "left_anti").withColumn("far", F.lit(len(levels) + 1)), "bases")
    return reduce(DataFrame.unionByName, levels)


def lent(found: DataFrame) -> DataFrame:
    """What definitions whose documentation is missing or trivial take from declarations (functions without a body).

    ``found`` has the columns of ``KEYS``. A definition takes the documentation of a declaration of the same repository, name
    and normalised signature: of its own module and owner first, then of the nearest types that its owner extends or
    implements, then an ambient one (TypeScript's ``declare`` and ``.d.ts``) of the same owner in the same folder or a module
    of the same name, if no other definition or declaration answers to it. Several that are equally near must say the same.
    Trivial documentation is dropped after the join. Result: repo, ext, name, params, module and scope of the definition,
    the documentation ``declared``, and ``at``, the file_id and start_line of the first declaration that says it.
    """
    key = [*_HOME, "name", "params"]
    place = [*key, "module", "scope"]
    plain = found.where("name is not null")
    declared = plain.where("not body").select(*place, "documentation", "trivial", "ambient", F.struct("file_id", "start_line").alias("at"))
    defined = plain.where("body").select(*place).distinct()
    # what still needs a declaration
    open_ = plain.where("body and coalesce(trivial, true)").select(*place).distinct()
    said = declared.where("documentation is not null").select(*place, "documentation", "trivial", "at")
    near = open_.join(said, place).withColumn("far", F.lit(0))
    above = bases_of(found.where("name is null").select(*_HOME, "module", "scope", "bases"))
    up = said.withColumnsRenamed({"module": "up_module", "scope": "up_scope"})
    inherited = open_.join(above, [*_HOME, "module", "scope"]).join(up, [*key, "up_module", "up_scope"]).drop("up_module", "up_scope")
    free = declared.where("ambient").join(defined, place, "left_anti")

    def alone(df: DataFrame, by: str, what: list[Column]) -> DataFrame:
        return df.withColumn("by", _folder("module") if by == "folder" else F.regexp_extract("module", r"([^/]*)$", 1)).groupBy(*key, "scope", "by").agg(*what)

    ambient = []
    for far, by in ((1 << 20, "folder"), (1 << 21, "stem")):
        said_by = [F.min(c).alias(c) for c in ("documentation", "trivial", "at")]
        one = alone(free, by, [*said_by, F.min("module").alias("a"), F.max("module").alias("z"), F.max("documentation").alias("__other")])
        one = one.where("a = z and documentation = __other").drop("a", "z", "__other")
        to = alone(defined, by, [F.min("module").alias("module"), F.max("module").alias("z")]).where("module = z").drop("z")
        ambient.append(to.join(one, [*key, "scope", "by"]).drop("by").withColumn("far", F.lit(far)))
    met = reduce(DataFrame.unionByName, [near, inherited, *ambient])
    level = met.groupBy(*place, "far").agg(F.min("documentation").alias("declared"), F.max("documentation").alias("__other"), F.min("trivial").alias("slight"), F.min("at").alias("at"))
    best = level.groupBy(*place).agg(*[F.min_by(c, "far").alias(c) for c in ("declared", "__other", "slight", "at")])
    return best.where("declared = __other and not slight").drop("__other", "slight")


def pairs(files: DataFrame) -> DataFrame:
    """Code and description of every documented function.

    A definition whose documentation is missing or trivial takes that of a declaration, as ``lent`` says. A declaration
    itself is no pair.
    """
    found = materialise(symbols(files), "symbols")  # read several times below; the pass over the sources is made once
    plain, best = found.where("name is not null"), lent(found)
    qname = F.concat_ws(
        "::", F.regexp_replace(F.regexp_replace("path", r"\.\w+$", ""), "/", "::"), F.when(F.col("owner") != "", F.col("owner")), F.col("name")
    )
    made = plain.where("body").select("file_id", qname.alias("qname"), "start_line", "end_line", "params", "documentation", "trivial", "code", *_place())
    # code moves once, to where its resent copies are; only functions without words of their own meet the declarations
    own = made.where("not trivial").select("file_id", "qname", "start_line", "end_line", "params", F.col("documentation").alias("description"), "code")
    taken = made.where("coalesce(trivial, true)").drop("documentation", "trivial").join(best.select(*_place(), F.col("declared").alias("description")), ["k1", "k2"])
    return own.unionByName(taken.select(*own.columns)).dropDuplicates(["file_id", "qname", "start_line", "params"])
