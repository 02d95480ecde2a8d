"""Lexers: a source text as a string of token kinds, with strings, comments, templates and line ends settled.

``findall`` does the work: every match is one token or comment with the blanks before it, and kinds are looked up by the
token's text; a comment's kind is empty. What nests deeper than the patterns do is put into a flat form first.
"""

from __future__ import annotations

import re
import unicodedata
from itertools import accumulate

from graphloom.llm.peg import Grammar, Kinds

ERROR = "\x01"
NL0 = 0xE000
_NAMED = re.compile(r"\\N\{[^{}]*\}")
INDENTS = re.compile("[\ue000-\uf8ff]")
SPLIT_INDENTS = re.compile("([\ue000-\uf8ff])")
#: Equal entries of a long list one after the other; no rule tells three of them from more.
LONG, RUNS = 64, re.compile(r"((?:[^,]{1,4},))\1{3,}")
BRACKET = re.compile(r"([()\[\]{}])")
INNERMOST = re.compile(r"[(\[{][^()\[\]{}]*+[)\]}]")
MISFIT = "\x03"
CLOSES = {"(": ")", "[": "]", "{": "}"}
TEXT_CACHE = 300_000
BLANKS = " \t\r\f\v\n\ufeff\u00a0"

_DQ = r'"(?:[^"\\\n]|\\[\s\S])*+"'
_SQ = r"'(?:[^'\\\n]|\\[\s\S])*+'"
_BLANK = r"[ \t\r\f\v\ufeff\u00a0]++"
_LINE_COMMENT = r"//[^\n]*+"
_INLINE_COMMENT = r"/\*(?:[^*\n]|\*(?!/))*+\*/"
_LONG_COMMENT = r"/\*(?:[^*]|\*(?!/))*+\*/"
_C_NUMBER = (
    r"0[xX][\da-fA-F_.]++(?:[pP][+-]?[\d_]++)?[a-zA-Z]?|0[bB][01_]++[a-zA-Z]?|0[oO][0-7_]++n?"
    r"|(?:\d[\d_]*+(?:\.(?!\.)[\d_]*+)?|\.\d[\d_]*+)(?:[eE][+-]?[\d_]++)?"
)


def _nested(expr: str, depth: int) -> str:
    """A template literal whose ``${}`` hold ``expr`` and templates to ``depth``."""
    inner = r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{))*+`"
    for _ in range(depth):
        braces = rf"\{{(?:[^{{}}`\"'/]|/(?![*/])|{_DQ}|{_SQ}|{_INLINE_COMMENT}|{inner})*+\}}"
        part = rf"\$\{{(?:[^{{}}`\"'/]|/(?![*/])|{_DQ}|{_SQ}|{_INLINE_COMMENT}|{inner}|{braces})*+\}}"
        inner = rf"`(?:[^`\\$]|\\[\s\S]|\$(?!\{{)|{part})*+`"
    return inner


def _ops(text: str) -> str:
    return "|".join(re.escape(x) for x in sorted(text.split(), key=len, reverse=True))


def _pattern(blank: str, *tokens: str) -> re.Pattern:
    return re.compile(rf"(?:{blank})*+({'|'.join(tokens)}|\Z|[\s\S])")


class _Texts(dict):
    """Kinds by text; comments and long literals are worked out each time, as they hardly come again."""

    def __init__(self, lang: Language) -> None:
        super().__init__(lang.fixed)
        self.lang = lang

    def __missing__(self, t: str) -> str:
        c = self.lang.NAME if t.isidentifier() else self.lang.kind(t)
        if c and len(t) < 80:
            if len(self) > TEXT_CACHE:
                self.clear()
                self.update(self.lang.fixed)
            self[t] = c
        return c


class _Folded(dict):
    """Characters of groups by their text before folding."""

    def __init__(self, lang: Language) -> None:
        super().__init__()
        self.lang = lang

    def __missing__(self, s: str) -> str:
        if len(self) > TEXT_CACHE:
            self.clear()
        self[s] = c = self.lang._group(s)
        return c


class Language:
    """A grammar with its lexer. ``keep`` is for subclasses: what a newline between two tokens becomes."""

    name = ""
    files: tuple[str, ...] = ()
    cut: tuple[str, ...] = (";",)
    pattern: re.Pattern
    #: Characters that only part tokens; a newline is one of them where it means nothing.
    blanks = BLANKS
    ident = re.compile(r"[^\W\d]\w*+\Z")

    def __init__(self) -> None:
        from importlib.resources import files

        here = files("graphloom.llm") / "grammars"
        self.kinds = Kinds()
        for c in ("NAME", "NUM", "STR", "TPL", "REGEX", "CHAR", "LIFETIME", "NL", "NLS"):
            self.kinds[c]
        self.grammar = Grammar("\n".join((here / f).read_text(encoding="utf-8") for f in self.files), self.kinds, self.cut)
        k = self.kinds
        self.NAME, self.NUM, self.STR = k["NAME"], k["NUM"], k["STR"]
        classes = {"NAME", "NUM", "STR", "TPL", "REGEX", "CHAR", "LIFETIME", "NL", "NLS", "¬"}
        self.fixed = {t: c for t, c in k.of.items() if t not in classes} | {"": ""}
        self.texts: dict[str, str] = _Texts(self)
        self.folded: dict[str, str] = _Folded(self)
        # the same with the blanks before a token
        self.spaced = re.compile(self.pattern.pattern.replace(")*+(", ")*+(?:", 1))

    # -- kinds

    def kind(self, t: str) -> str:
        raise NotImplementedError

    def plain(self, src: str) -> str:
        """The source as it is lexed, of the same length."""
        return src

    def kinds_of(self, src: str) -> str:
        k = "".join(map(self.texts.__getitem__, self.pattern.findall(self.plain(src))))
        if ERROR in k and (flat := self.flat(src)) is not None:
            k = "".join(map(self.texts.__getitem__, self.pattern.findall(self.plain(flat))))
        return k

    def lexed(self, src: str, ends: bool = True) -> tuple[list[str], list[str], list[int], list[str]]:
        """Tokens and comments with the blanks before them and without, where each of them ends, and their kinds; one pass.

        Without ``ends`` nothing tells where they end.
        """
        pieces = self.spaced.findall(self.plain(src))
        blanks = self.blanks
        found = [x.lstrip(blanks) for x in pieces]
        kinds = list(map(self.texts.__getitem__, found))
        if ERROR in kinds and (flat := self.flat(src)) is not None:
            return self.lexed(flat, ends)
        return pieces, found, list(accumulate(map(len, pieces))) if ends else [], kinds

    def flat(self, src: str) -> str | None:
        """``src`` with what nests deeper than the pattern put into a form of equal length that doesn't; None without any."""
        out, pos, begun, plain = [], 0, 0, self.plain(src)
        while True:
            m = self.pattern.match(plain, pos)
            t = m[1]
            if not t:
                return "".join([*out, src[begun:]]) if out else None
            pos = m.end()
            if ERROR in self.texts[t]:
                at = m.start(1)
                end = self.nested_end(plain, at)
                if end < 0:
                    return None
                out += [src[begun:at], self.stand_in(src[at:end])]
                pos = begun = end

    def nested_end(self, src: str, at: int) -> int:
        """Where what begins at ``at`` and nests too deep for the pattern ends, or -1 if it isn't that."""
        return -1

    def stand_in(self, text: str) -> str:
        """A text of equal length and lines, and of the kind that ``text`` has."""
        return text

    def lines(self, k: str) -> str:
        """``k`` with its newlines dropped or made tokens."""
        return k

    def ends_line(self) -> list[int]:
        """Kinds after which a newline can end a statement."""
        return []

    def begins_line(self) -> list[int] | None:
        """Kinds that a statement can begin with behind such a newline; None for all."""
        return None

    def content(self, bracket: str, c: str) -> str:
        return c

    def top(self, k: str) -> str:
        return k

    # -- folding

    def fold(self, k: str) -> tuple[str, int]:
        """Groups folded to single characters, the innermost first, and -1 or the index of the bracket that doesn't fit."""
        folded, n, whole = self.folded.__getitem__, 1, k
        while n:
            k, n = INNERMOST.subn(lambda m: folded(m[0]), k)
        if BRACKET.search(k) or MISFIT in k:
            return "", self._misfit(whole)
        return k, -1

    def _group(self, s: str) -> str:
        """The character of a bracketed group without brackets inside."""
        if CLOSES[s[0]] != s[-1]:
            return MISFIT
        inner = s[1:-1]
        if len(inner) > LONG:
            inner = RUNS.sub(r"\1\1\1", inner)
        return self.grammar.group(s[0], self.content(s[0], inner))

    def _misfit(self, k: str) -> int:
        stack = []
        for m in BRACKET.finditer(k):
            if m[0] in CLOSES:
                stack.append(CLOSES[m[0]])
            elif not stack or stack.pop() != m[0]:
                return m.start()
        return len(k)

    def matches(self, rule: str, src: str) -> bool:
        """Whether the whole text is ``rule``, as for the expressions inside string templates."""
        k, bad = self.fold(self.lines(self.kinds_of(src)))
        return bad < 0 and ERROR not in k and self.grammar.match(rule, k)[0]

    def valid(self, src: str) -> bool:
        """Whether the grammar consumes the whole text."""
        return self.valid_kinds(self.kinds_of(src))

    def valid_kinds(self, k: str) -> bool:
        k = self.lines(k)
        if ERROR in k:
            return False
        k, bad = self.fold(k)
        return bad < 0 and self.grammar.match("file", self.top(k))[0]

    # -- the place of an error

    def offsets(self, src: str) -> tuple[str, list[int]]:
        """The kinds before folding and where each stands."""
        chars, at = [], []
        flat = self.flat(src)
        for m in self.pattern.finditer(self.plain(src if flat is None else flat)):
            t = m[1]
            c = self.texts.get(t)
            for x in self.kind(t) if c is None else c:
                chars.append(x)
                at.append(m.start(1))
        return "".join(chars), at

    def aligned(self, k: str, at: list[int]) -> tuple[str, list[int]]:
        """``lines`` for kinds with offsets: it only drops newlines or makes one token of a run of them."""
        out, where, want = [], [], self.lines(k)
        j = 0
        for i, c in enumerate(k):
            if j < len(want) and want[j] == c and c != "\n":
                out.append(c)
                where.append(at[i])
                j += 1
            elif c == "\n" and j < len(want) and k[i + 1 : i + 2] != "\n" and want[j] != k[i + 1 : i + 2]:
                out.append(want[j])
                where.append(at[i])
                j += 1
        return "".join(out), where

    def failure(self, src: str) -> tuple[int, str]:
        """The furthest position that an invalid text was read to, and the kind of thing that went wrong there."""
        k, at = self.aligned(*self.offsets(src))
        at.append(len(src))
        if (e := k.find(ERROR)) >= 0:
            c = src[at[e]]
            opens = src.startswith("/*", at[e])
            return at[e], "unterminated literal" if c in "\"'`" or opens else "invalid character"
        _, bad = self.fold(k)
        if bad >= 0:
            return at[bad], "unclosed bracket" if bad >= len(k) else "mismatched bracket"
        return self._furthest(k, at, len(src))

    def _furthest(self, k: str, at: list[int], size: int) -> tuple[int, str]:
        # the innermost content with an error, by the same folding with offsets kept
        stack, cur, where, inner = [], [], [], {}
        for i, c in enumerate(k):
            if c in CLOSES:
                stack.append((c, cur, where, at[i]))
                cur, where = [], []
            elif c in ")]}":
                opened, outer, places, start = stack.pop()
                text = self.content(opened, "".join(cur))
                if len(text) != len(cur):
                    kept = [j for j, x in enumerate(cur) if x in text]
                    where = [where[j] for j in kept][: len(text)]
                outer.append(self.grammar.group(opened, text))
                places.append(start)
                inner[start] = (text, [*where, at[i]])
                cur, where = outer, places
            else:
                cur.append(c)
                where.append(at[i])
        text, places, rule = "".join(cur), [*where, size], "file"
        return self._descend(rule, text, places, inner, size)

    def _descend(self, rule: str, text: str, places: list[int], inner: dict, size: int) -> tuple[int, str]:
        _, far = self.grammar.match(rule, text)
        best = (places[min(far, len(places) - 1)], "unexpected end" if far >= len(text) and rule == "file" else "syntax")
        if far < len(text) and places[far] in inner:
            sub, at = inner[places[far]]
            for r in self.grammar.expected(rule, text, far):
                best = max(best, self._descend(r, sub, at, inner, size))
        return best


class Python(Language):
    name, files, cut = "python", ("python.peg",), ("NL",)
    _TQ = r'"""(?:[^"\\]|\\[\s\S]|"(?!""))*+"""' + r"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*+'''"
    _PLAIN = rf"(?:[rRbBuU]|[rR][bB]|[bB][rR])?(?:{_TQ}|{_DQ}|{_SQ})"

    @staticmethod
    def _fstring() -> str:
        strings = rf"{Python._TQ}|{_DQ}|{_SQ}"
        one = rf"\{{(?:[^{{}}\"']|{strings})*+\}}"
        two = rf"\{{(?:[^{{}}\"']|{strings}|{one})*+\}}"
        three = rf"\{{(?:[^{{}}\"']|{strings}|{two})*+\}}"

        def quoted(esc: str) -> str:
            esc += r"|\{\{|\}\}"
            return (
                rf'(?:"""(?:{esc}|[^"\\{{}}]|"(?!"")|{three})*+"""' + rf"|'''(?:{esc}|[^'\\{{}}]|'(?!'')|{three})*+'''"
                rf'|"(?:{esc}|[^"\\{{}}\n]|{three})*+"' + rf"|'(?:{esc}|[^'\\{{}}\n]|{three})*+')"
            )

        # in a raw string a backslash doesn't keep a brace from being a field
        return rf"(?:[fF][rR]|[rR][fF]){quoted(r'\\(?:[^{}]|(?=[{}]))')}|[fF]{quoted(r'\\N\{[^{}]*\}|\\(?:[^{}]|(?=[{}]))')}"

    def __init__(self) -> None:
        nl = r"(?:\r?\n|\r)(?:[ \t\f]*+(?:\#[^\r\n]*+)?(?:\r?\n|\r))*+[ \t\f]*+"
        number = (
            r"0[xX](?:_?[\da-fA-F])++|0[oO](?:_?[0-7])++|0[bB](?:_?[01])++"
            r"|(?:\d(?:_?\d)*+)?\.\d(?:_?\d)*+(?:[eE][+-]?\d(?:_?\d)*+)?[jJ]?"
            r"|\d(?:_?\d)*+(?:\.(?:[eE][+-]?\d(?:_?\d)*+)?[jJ]?|[eE][+-]?\d(?:_?\d)*+[jJ]?|[jJ])"
            # a whole number doesn't begin with 0 unless it is 0
            r"|(?:[1-9](?:_?\d)*+|0(?:_?0)*+)(?![\d_])"
        )
        ops = _ops("**= //= >>= <<= ... := -> == != <= >= += -= *= /= %= @= &= |= ^= ** // >> <<") + r"|[-+*/%@&|^~<>()\[\]{},:;=!]|\.(?!\d)"
        self.pattern = _pattern(
            r"[ \t\f]++", r"[A-Za-z_]\w*+(?![\"'])", nl, r"\#[^\r\n]*+", r"\\\r?\n", ops, number, self._fstring(), self._PLAIN, r"[^\W\d]\w*+"
        )
        self.is_f = re.compile(r"(?:[fF][rR]?|[rR][fF])[\"']")
        super().__init__()
        self.NL, self.BYTES = self.kinds["NL"], self.kinds["BYTES"]

    is_b = re.compile(r"(?:[bB][rR]?|[rR][bB])[\"']")
    _PREFIX = re.compile(r"\w*")
    _ESCAPE = re.compile(r"\\(?:(\\)|x([\da-fA-F]{2})?|u([\da-fA-F]{4})?|U([\da-fA-F]{8})?|N(\{[^{}]*\})?)")

    def _escapes(self, t: str) -> bool:
        """Whether the escapes of a string with a fixed form have it."""
        prefix = self._PREFIX.match(t)[0].lower()
        if "r" in prefix:
            return True
        for m in self._ESCAPE.finditer(t):
            c = m[0][1]
            if c == "x" and not m[2] or "b" not in prefix and (c == "u" and not m[3] or c == "U" and (not m[4] or int(m[4], 16) > 0x10FFFF)):
                return False
            if c == "N" and "b" not in prefix:
                try:
                    unicodedata.lookup(m[5][1:-1])
                except (KeyError, TypeError):
                    return False
        return True

    blanks = " \t\f"

    def kind(self, t: str) -> str:
        c = t[0]
        if c == "#" or c == "\\" and len(t) > 1:
            return ""
        if c in "\n\r":
            width = 0
            for x in t[max(t.rfind("\n"), t.rfind("\r")) + 1 :]:
                width = width + 8 - width % 8 if x == "\t" else 0 if x == "\f" else width + 1
            return chr(NL0 + min(width, 0x18FF))
        if t[-1] in "\"'" and len(t) > 1:
            if "\\" in t and not self._escapes(t):
                return ERROR
            if self.is_b.match(t):
                return self.BYTES
            return self.STR if not self.is_f.match(t) or self._fields(t) else ERROR
        if c.isdigit() or c == "." and len(t) > 1:
            return self.NUM
        return self.NAME if self.ident.match(t) else ERROR

    def _fields(self, t: str) -> bool:
        """Whether the expressions of an f-string are valid."""
        q = re.match(r"(\w+)(\"\"\"|'''|\"|')", t)
        body = t[q.end() : -len(q[2])]
        return self._format(body if "r" in q[1].lower() else _NAMED.sub("x", body))

    def _format(self, body: str) -> bool:
        i = 0
        while (i := body.find("{", i)) >= 0:
            if body.startswith("{{", i):
                i += 2
                continue
            depth, j, cut, bang = 0, i + 1, -1, -1
            while True:
                m = self.pattern.match(body, j)
                t = m[1]
                if not t:
                    return False
                if depth == 0 and t in ("}", ":", "!", ":="):
                    if t == "}":
                        break
                    if t == "!":
                        bang = m.start(1)
                    else:
                        cut = m.start(1)
                        break
                depth += (t in "([{") - (t in ")]}") if len(t) == 1 else 0
                j = m.end()
            stop = bang if bang >= 0 else m.start(1)
            expr = body[i + 1 : stop].strip()
            if expr.endswith("=") and not expr.endswith(("==", "!=", "<=", ">=")):
                expr = expr[:-1]
            if not self.matches("value", expr.replace("\n", " ")):
                return False
            if cut >= 0:
                # the format runs to the brace that closes the field
                depth, k = 1, cut + 1
                while k < len(body):
                    depth += (body[k] == "{") - (body[k] == "}")
                    if not depth:
                        break
                    k += 1
                if not self._format(body[cut + 1 : k]):
                    return False
                i = k + 1
            else:
                i = m.end()
        return True

    def kinds_of(self, src: str) -> str:
        return super().kinds_of("\n" + src.removeprefix("\ufeff"))

    def lines(self, k: str) -> str:
        return k

    def content(self, bracket: str, c: str) -> str:
        return INDENTS.sub("", c)

    def matches(self, rule: str, src: str) -> bool:
        k, bad = self.fold(super().kinds_of(src))
        return bad < 0 and ERROR not in k and self.grammar.match(rule, INDENTS.sub("", k))[0]

    def top(self, k: str) -> str:
        parts = SPLIT_INDENTS.split(k)
        group, nl = self.grammar.group, self.NL
        widths, blocks = [0], [[]]
        for i in range(1, len(parts), 2):
            line = parts[i + 1]
            if not line:
                continue
            w = ord(parts[i]) - NL0
            if w != widths[-1]:
                if w > widths[-1]:
                    widths.append(w)
                    blocks.append([])
                else:
                    while w < widths[-1]:
                        widths.pop()
                        done = blocks.pop()
                        blocks[-1].append(group("<", "".join(done)))
                    if w != widths[-1]:
                        blocks[-1].append(ERROR)
            blocks[-1].append(line + nl)
        while len(blocks) > 1:
            done = blocks.pop()
            blocks[-1].append(group("<", "".join(done)))
        return "".join(blocks[0])

    def offsets(self, src: str) -> tuple[str, list[int]]:
        k, at = super().offsets("\n" + src)
        return k, [max(0, x - 1) for x in at]

    def aligned(self, k, at):
        return k, at

    def failure(self, src: str) -> tuple[int, str]:
        if src.startswith("\ufeff"):
            at, why = self.failure(src[1:])
            return at + 1, why
        k, at = self.offsets(src)
        at.append(len(src))
        if (e := k.find(ERROR)) >= 0:
            return at[e], "unterminated literal" if src[at[e] : at[e] + 1] in "\"'fFrRbBuU" else "invalid character"
        _, bad = self.fold(k)
        if bad >= 0:
            return at[bad], "unclosed bracket" if bad >= len(k) else "mismatched bracket"
        # the first line at which no prefix of the file can go on
        starts = [i for i, c in enumerate(k) if NL0 <= ord(c) < 0xF900]
        low, high = 0, len(starts)
        while low < high:
            mid = (low + high) // 2
            if self._prefix(k[: starts[mid]]):
                low = mid + 1
            else:
                high = mid
        return at[min(starts[low] if low < len(starts) else len(k), len(at) - 1)], "indentation or syntax"

    def _prefix(self, k: str) -> bool:
        folded, bad = self.fold(k)
        return bad >= 0 or self.grammar.match("file", self.top(folded))[0]


class Braces(Language):
    """What the brace languages share."""

    blanks = BLANKS.replace("\n", "")

    def kind(self, t: str) -> str:
        c = t[0]
        if c == "\n":
            return "\n"
        if c == "/" and t[1:2] in ("/", "*"):
            # a comment over several lines ends a line
            if t[1] == "/" or len(t) > 3 and t.endswith("*/"):
                return "\n" if "\n" in t and "\n" not in self.blanks else ""
            return ERROR
        if c in "\"'`":
            return self.STR if len(t) > 1 and t[-1] == c else ERROR
        if c.isdigit() or c == "." and len(t) > 1:
            return self.NUM
        return self.NAME if self.ident.match(t) else ERROR

    def lines(self, k: str) -> str:
        return k.replace("\n", "")


class JavaScript(Braces):
    name, files, cut = "javascript", ("javascript.peg", "js_only.peg"), (";", "NLS")
    ident = re.compile(r"(?:[^\W\d]|\$)[\w$]*+\Z")

    def __init__(self) -> None:
        word = r"(?:[^\W\d]|\$)[\w$]*+"
        number = rf"(?:{_C_NUMBER})n?"
        before = _ops("=== !== == != => && || ?? = ( , : ; ! & | ? { [ + - * % < > ~ ^ += -= *= &&= ||= ??=")
        words = r"(?:return|typeof|case|in|of|delete|void|throw|do|else|await|yield|instanceof)(?![\w$])"
        regex = r"/(?![/*])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*+\])++/[a-z]*+"
        skip = rf"{_BLANK}|{_LINE_COMMENT}|{_INLINE_COMMENT}"
        ops = _ops(
            "... === !== **= <<= >>>= &&= ||= ??= => == != <= >= && || ?? ?. ++ -- += -= *= /= %= &= |= ^= << **"
        ).replace(r"\?\.", r"\?\.(?!\d)") + r"|[{}()\[\];,<>+\-*/%&|^!~?:=.@\#]"
        self.with_regex = re.compile(rf"({before}|{words})((?:{skip}|\n)*+)({regex})\Z")
        self.pattern = _pattern(
            _BLANK, rf"(?:{before}|{words})(?:{skip}|\n)*+{regex}", r"\n", word, _LINE_COMMENT, _LONG_COMMENT, r"/\*", number, _DQ, _SQ,
            _nested("", 3), ops,
        )
        super().__init__()
        k = self.kinds
        self.TPL, self.REGEX, self.NLS = k["TPL"], k["REGEX"], k["NLS"]
        no_end = "if else for while do case in of typeof delete new throw instanceof extends try finally default import export var const function class enum".split()
        enders = [c for t, c in k.of.items() if re.fullmatch(r"[a-z]\w*", t) and t not in no_end]
        enders += [k[x] for x in ("NAME", "NUM", "STR", "TPL", "REGEX", "++", "--")] + [")", "]", "}"]
        no_start = "in instanceof else catch finally extends implements as satisfies of".split()
        starters = [c for t, c in k.of.items() if re.fullmatch(r"[a-z]\w*", t) and t not in no_start]
        starters += [k[x] for x in ("NAME", "NUM", "STR", "REGEX", "++", "--", "@", "!", "~", "#")] + ["{"]
        e, s = re.escape("".join(enders)), re.escape("".join(starters))
        self.asi = re.compile(f"(?<=[{e}])\n+(?=[{s}])")
        self.enders, self.starters = list(map(ord, enders)), list(map(ord, starters))
        self.before_brace = re.compile(f"(?<=\\))\n+(?={{)")

    def kind(self, t: str) -> str:
        if t[0] == "`":
            return self.TPL if len(t) > 1 and self._template(t) else ERROR
        if len(t) > 1 and "/" in t and t[0] not in "\"'" and (m := self.with_regex.match(t)):
            return self.texts.get(m[1], ERROR) + self.REGEX
        return super().kind(t)

    def plain(self, src: str) -> str:
        # a first line for the shell is a comment
        return "//" + src[2:] if src.startswith("#!") else src

    def nested_end(self, src: str, at: int) -> int:
        return self._template_end(src, at) if src[at] == "`" else -1

    def stand_in(self, text: str) -> str:
        """The template with its expressions, if they are valid, as blanks; else as they are."""
        out, i = [], 0
        for a, z in self._fields(text):
            if not self.matches("expr", text[a:z]):
                return text
            out += [text[i:a], re.sub(r"[^\n]", "0", text[a:z])]
            i = z
        return "".join([*out, text[i:]])

    def _fields(self, t: str) -> list[tuple[int, int]]:
        """Where the expressions of a template that is all of ``t`` lie."""
        out, i = [], 1
        while i < len(t) - 1:
            if t[i] == "\\":
                i += 2
            elif t.startswith("${", i):
                end = self._braces_end(t, i + 2)
                out.append((i + 2, end - 1))
                i = end
            else:
                i += 1
        return out

    def _template_end(self, src: str, at: int) -> int:
        i = at + 1
        while i < len(src):
            if src[i] == "`":
                return i + 1
            if src.startswith("${", i):
                i = self._braces_end(src, i + 2)
                if i < 0:
                    return -1
            else:
                i += 1 + (src[i] == "\\")
        return -1

    def _braces_end(self, src: str, at: int) -> int:
        """Behind the brace that closes what begins at ``at``, or -1."""
        depth = 1
        while True:
            m = self.pattern.match(src, at)
            t = m[1]
            if not t:
                return -1
            at = m.end()
            if t == "`":
                at = self._template_end(src, m.start(1))
                if at < 0:
                    return -1
            elif t == "}":
                depth -= 1
                if not depth:
                    return at
            elif t[0] == "{" and len(t) == 1 or t.startswith("{") and self.with_regex.match(t):
                depth += 1

    def _template(self, t: str) -> bool:
        """Whether the expressions of a template literal are valid."""
        i = 1
        while i < len(t) - 1:
            if t[i] == "\\":
                i += 2
            elif t.startswith("${", i):
                depth, j = 0, i + 2
                while True:
                    m = self.pattern.match(t, j)
                    x = m[1]
                    if not x:
                        return False
                    if x == "}" and not depth:
                        break
                    for b in self.texts.get(x, x[:1] if self.with_regex.match(x) else ""):
                        depth += (b in "([{") - (b in ")]}")
                    j = m.end()
                if not self.matches("expr", t[i + 2 : m.start(1)]):
                    return False
                i = m.end()
            else:
                i += 1
        return True

    def lines(self, k: str) -> str:
        return self.asi.sub(self.NLS, self.before_brace.sub("", k)).replace("\n", "")

    def ends_line(self) -> list[int]:
        return self.enders

    def begins_line(self) -> list[int] | None:
        return self.starters

    def content(self, bracket: str, c: str) -> str:
        return c if bracket == "{" else c.replace(self.NLS, "")


class TypeScript(JavaScript):
    name, files = "typescript", ("javascript.peg", "ts_only.peg")


class Go(Braces):
    name, files = "go", ("go.peg",)

    def __init__(self) -> None:
        ops = _ops("... <<= >>= &^= := == != <= >= && || <- ++ -- += -= *= /= %= &= |= ^= << >> &^") + r"|[{}()\[\];,<>+\-*/%&|^!~:=.]"
        self.pattern = _pattern(
            _BLANK, r"\n", r"[^\W\d]\w*+", _LINE_COMMENT, _LONG_COMMENT, r"/\*", rf"(?:{_C_NUMBER})i?",
            _DQ, r"`[^`]*+`", r"'(?:\\[^'\n][^'\n]*+|\\'|[^'\\\n])'", ops,
        )
        super().__init__()
        k = self.kinds
        ends = "".join(k[x] for x in ("NAME", "NUM", "STR", "break", "continue", "fallthrough", "return", "++", "--")) + ")]}"
        self.asi = re.compile(f"(?<=[{re.escape(ends)}])\n+")
        self.enders = list(map(ord, ends))

    def ends_line(self) -> list[int]:
        return self.enders

    def kind(self, t: str) -> str:
        return self.NUM if t[0] == "'" and len(t) > 1 else super().kind(t)

    def lines(self, k: str) -> str:
        return self.asi.sub(self.kinds[";"], k).replace("\n", "")


class Java(Braces):
    name, files = "java", ("java.peg",)

    def __init__(self) -> None:
        ops = _ops("... -> :: <<= >>= == != <= >= && || ++ -- += -= *= /= %= &= |= ^= <<") + r"|[{}()\[\];,<>+\-*/%&|^!~?:=.@]"
        self.pattern = _pattern(
            rf"{_BLANK}|\n++", r"(?:[^\W\d]|\$)[\w$]*+", _LINE_COMMENT, _LONG_COMMENT, r"/\*", rf"(?:{_C_NUMBER})[lLfFdD]?",
            r'"""[ \t\r]*\n(?:[^"\\]|\\[\s\S]|"(?!""))*+"""', _DQ, r"'(?:\\[^\n][^'\n]*+|[^'\\\n])'", ops,
        )
        self.ident = JavaScript.ident
        super().__init__()
        self.CHAR = self.kinds["CHAR"]

    blanks = BLANKS

    def kind(self, t: str) -> str:
        return self.CHAR if t[0] == "'" and len(t) > 1 else super().kind(t)


class Rust(Braces):
    name, files = "rust", ("rust.peg",)

    def __init__(self) -> None:
        comment = r"/\*(?:[^*/]|\*(?!/)|/(?!\*))*+\*/"
        for _ in range(2):
            comment = rf"/\*(?:[^*/]|\*(?!/)|/(?!\*)|{comment})*+\*/"
        raws = "|".join(rf'(?:b|c)?r{h}"(?:[^"]|"(?!{h}))*+"{h}' if h else r'(?:b|c)?r"[^"]*+"' for h in ("", "#", "##", "###"))
        raws += r'|(?:b|c)?r\#{4,}+"'  # where it ends is looked for by itself
        number = (
            r"0x[\da-fA-F_]++|0b[01_]++|0o[0-7_]++"
            r"|\d[\d_]*+(?:\.(?![.\w])|\.\d[\d_]*+)?(?:[eE][+-]?[\d_]++)?"
        )
        ops = _ops("... ..= <<= :: -> => == != <= >= && || += -= *= /= %= &= |= ^= << ..") + r"|[{}()\[\];,<>+\-*/%&|^!~?:=.@\#$]"
        self.pattern = _pattern(
            rf"{_BLANK}|\n++", _LINE_COMMENT, comment, r"/\*", raws, r'[bc]?"(?:[^"\\]|\\[\s\S])*+"',
            r"b?'(?:\\(?:u\{[\da-fA-F_]*\}|x[\da-fA-F]{2}|[^\n])|[^'\\\n])'", r"'[^\W\d]\w*+", r"(?:r\#)?[^\W\d]\w*+",
            rf"(?:{number})(?:_?[iuf](?:8|16|32|64|128|size))?", ops,
        )
        self.ident = re.compile(r"(?:r#)?[^\W\d]\w*+\Z")
        super().__init__()
        self.CHAR, self.LIFETIME = self.kinds["CHAR"], self.kinds["LIFETIME"]

    blanks = BLANKS
    _NEST = re.compile(r"/\*|\*/")
    _RAW = re.compile(r"(?:b|c)?r(#{4,}+)\"")

    def nested_end(self, src: str, at: int) -> int:
        if m := self._RAW.match(src, at):
            end = src.find('"' + m[1], m.end())
            return end + 1 + len(m[1]) if end >= 0 else -1
        if src.startswith("/*", at):
            depth = 0
            for m in self._NEST.finditer(src, at):
                depth += 1 if m[0] == "/*" else -1
                if not depth:
                    return m.end()
        return -1

    def stand_in(self, text: str) -> str:
        if text.startswith("/*"):
            return re.sub(r"[^\n]", " ", text)
        return '"' + re.sub(r"[^\n]", "0", text[1:-1]) + '"'

    def kind(self, t: str) -> str:
        if t == "$":
            return self.kinds["$"]
        if len(t) > 1:
            if self._RAW.fullmatch(t):
                return ERROR
            if t[-1] == "'":
                return self.CHAR
            if t[0] == "'":
                return self.LIFETIME
            if '"' in t[:6] and t[-1] in '"#':
                return self.STR
        return super().kind(t)


LANGUAGES = {"py": Python, "js": JavaScript, "ts": TypeScript, "go": Go, "java": Java, "rs": Rust}
_LOADED: dict[str, Language] = {}


def language(ext: str) -> Language | None:
    """The language of a path's extension; one instance for each worker."""
    if ext not in _LOADED and ext in LANGUAGES:
        _LOADED[ext] = LANGUAGES[ext]()
    return _LOADED.get(ext)
