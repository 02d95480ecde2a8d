"""Packrat parsing-expression grammars over the token kinds of a source file.

A lexer turns a text into a string with one character for each token's kind. Brackets, and the indented blocks of
Python, are then folded from the inside out: a whole group becomes one character that says of which rules of the grammar
the group's content is a complete match. So no rule ever looks into a group, and whether a content matches a rule depends
on the content's kinds alone. That makes the packrat memo addressable by content instead of by position: it is shared by
all files, and for real code most groups and statements have been seen before.

Notation: ``'x'`` a token, ``NAME`` a token class, ``@(rule)`` a bracketed group whose content is all of ``rule`` (also
``@[``, ``@{`` and ``@<`` for an indented block), ``a / b`` ordered choice, ``* + ? & !`` as usual, ``.`` any token,
``rule: memo`` a rule whose matches are kept across files, keyed by what
lies before the next few groups and tokens of the ``cut`` set. A group's rules must match
to the end of the content.
"""

from __future__ import annotations

import re
from collections import Counter

_TOKEN = re.compile(r"\s*(?:#[^\n]*\n|(@[(\[{<])(\w+)[)\]}>]|'([^']+)'|(\w+)|([/*+?&!().=:]))")
GROUP0 = 0x20000
#: Kept entries of one memo before it starts anew; bounds a worker's memory.
MEMO_SIZE = 200_000


def _refs(e) -> list[str]:
    """The rules that an expression names, each as often as it does."""
    return [e[1]] if e[0] == "ref" else [x for part in e[1:] if isinstance(part, list) for x in _refs(part)]


class Kinds:
    """Characters for token kinds; brackets stand for themselves."""

    def __init__(self) -> None:
        self.of = {c: c for c in "()[]{}"}

    def __getitem__(self, name: str) -> str:
        return self.of.get(name) or self.of.setdefault(name, chr(0x100 + len(self.of)))


class Grammar:
    def __init__(self, text: str, kinds: Kinds, cut: tuple[str, ...]) -> None:
        self.kinds = kinds
        self.rules: dict[str, list] = {}
        self.memos: dict[str, dict[str, tuple[int, int]]] = {}
        self.group_rules: dict[str, list[str]] = {}
        self._parse(text)
        self.cut = re.compile("[" + re.escape("".join(kinds[c] for c in cut)) + f"{chr(GROUP0)}-\U0010ffff]")
        self.groups: dict[tuple[str, int], str] = {}
        self.info: list[tuple[str, int]] = []
        self.contents: dict[str, dict[str, str]] = {b: {} for b in "([{<"}
        # the rules as functions, and the state of one match
        self.space: dict[str, object] = {"cut": self.cut.search}
        self.firsts: dict[str, tuple[frozenset, frozenset, bool]] = dict.fromkeys(self.rules, (frozenset(), frozenset(), False))
        while any([self._grow(name) for name in self.rules]):
            pass
        exec(compile(self._source(), "grammar", "exec"), self.space)

    # -- reading the notation

    def _parse(self, text: str) -> None:
        toks, pos = [], 0
        text = text.rstrip() + "\n"
        while pos < len(text.rstrip()):
            m = _TOKEN.match(text, pos)
            if not m:
                raise ValueError(f"grammar: {text[pos : pos + 40]!r}")
            pos = m.end()
            if m[1]:
                bracket, rule = m[1][1], m[2]
                if rule not in self.group_rules.setdefault(bracket, []):
                    self.group_rules[bracket].append(rule)
                toks.append(("group", (bracket, rule)))
            elif m[3]:
                toks.append(("lit", self.kinds[m[3]]))
            elif m[4]:
                toks.append(("id", m[4]))
            elif m[5]:
                toks.append((m[5], m[5]))
        self.toks, i = toks, 0
        while i < len(toks):
            name, memo = toks[i][1], False
            i += 1
            if toks[i][0] == ":":
                memo, i = True, i + 2
            if toks[i][0] != "=":
                raise ValueError(f"grammar: '=' expected after {name}")
            body, i = self._choice(i + 1)
            self.rules[name] = body
            if memo:
                self.memos[name] = {}

    def _choice(self, i: int):
        options = []
        while True:
            seq = []
            while i < len(self.toks) and self.toks[i][0] not in ("/", ")"):
                if self.toks[i][0] == "id" and i + 1 < len(self.toks) and self.toks[i + 1][0] in ("=", ":"):
                    break
                item, i = self._item(i)
                seq.append(item)
            options.append(seq[0] if len(seq) == 1 else ["seq", *seq])
            if i < len(self.toks) and self.toks[i][0] == "/":
                i += 1
                continue
            return (options[0] if len(options) == 1 else ["or", *options]), i

    def _item(self, i: int):
        kind, value = self.toks[i]
        if kind in "&!":
            inner, i = self._item(i + 1)
            return [kind, inner], i
        if kind == "(":
            inner, i = self._choice(i + 1)
            i += 1
        elif kind == "lit":
            inner, i = ["set", frozenset(value)], i + 1
        elif kind == "group":
            inner, i = ["group", value], i + 1
        elif kind == ".":
            inner, i = ["any"], i + 1
        else:
            inner, i = (["set", frozenset(self.kinds[value])] if value.isupper() else ["ref", value]), i + 1
        while i < len(self.toks) and self.toks[i][0] in "*+?":
            inner, i = [self.toks[i][0], inner], i + 1
        return inner, i

    # -- what a rule can begin with: tokens, groups, and whether it can be empty

    def _grow(self, name: str) -> bool:
        before = self.firsts[name]
        self.firsts[name] = self._first(self.rules[name])
        return before != self.firsts[name]

    def _first(self, e) -> tuple[frozenset, frozenset, bool]:
        kind, none = e[0], frozenset()
        if kind == "set":
            return e[1], none, False
        if kind == "group":
            return none, frozenset([e[1]]), False
        if kind == "any":
            return none, none, True  # anything; taken for empty, which rules nothing out
        if kind == "ref":
            if e[1] not in self.firsts:
                raise ValueError(f"grammar: no rule {e[1]}")
            return self.firsts[e[1]]
        if kind in "&!":
            return none, none, True
        if kind in ("or", "seq"):
            tokens, groups, empty = none, none, kind == "seq"
            for x in e[1:]:
                t, g, n = self._first(x)
                tokens, groups = tokens | t, groups | g
                if kind == "or":
                    empty |= n
                elif not n:
                    return tokens, groups, False
            return tokens, groups, empty
        t, g, n = self._first(e[1])
        return t, g, n or kind != "+"

    def _can(self, first: tuple[frozenset, frozenset, bool], c: str) -> bool:
        tokens, groups, empty = first
        if empty or c in tokens:
            return True
        if ord(c) < GROUP0:
            return False
        b, mask = self.info[ord(c) - GROUP0]
        return any(b == bracket and mask & 1 << self.group_rules[bracket].index(rule) for bracket, rule in groups)

    # -- rules as Python source: functions of a position that give the end of the match, or -1

    def _set_of(self, e) -> frozenset | None:
        """The tokens that ``e`` is a plain choice of."""
        if e[0] == "set":
            return e[1]
        if e[0] == "or":
            parts = [self._set_of(x) for x in e[1:]]
            return None if None in parts else frozenset().union(*parts)
        if e[0] == "ref" and e[1] in self.rules and e[1] not in self.memos:
            return self._set_of(self.rules[e[1]]) if self.rules[e[1]][0] in ("set", "or") else None
        return None

    def _table(self, test) -> str:
        """The name of a table of answers by character, filled by ``test`` as characters are met."""

        class Answers(dict):
            def __missing__(self, c):
                self[c] = found = test(c)
                return found

        name = f"T{len(self.space)}"
        self.space[name] = Answers()
        return name

    def _var(self) -> str:
        self.vars += 1
        return f"v{self.vars}"

    def _emit(self, e, p: str, r: str, pad: str) -> list[str]:
        """Lines that match ``e`` at the position in variable ``p`` and leave the end, or -1, in variable ``r``."""
        kind, seen = e[0], [f"{pad}if {p} > far: far = {p}"]
        if (s := self._set_of(e)) is not None:
            if len(s) == 1:
                return [*seen, f"{pad}{r} = {p} + 1 if S[{p}] == {next(iter(s))!r} else -1"]
            name = f"T{len(self.space)}"
            self.space[name] = s
            return [*seen, f"{pad}{r} = {p} + 1 if S[{p}] in {name} else -1"]
        if kind == "any":
            return [*seen, f"{pad}{r} = {p} + 1 if {p} < N else -1"]
        if kind == "group":
            first = (frozenset(), frozenset([e[1]]), False)
            return [*seen, f"{pad}{r} = {p} + 1 if {self._table(lambda c: self._can(first, c))}[S[{p}]] else -1"]
        if kind == "ref":
            if e[1] not in self.rules:
                raise ValueError(f"grammar: no rule {e[1]}")
            if e[1] in self.once:  # as if it were written here
                first = self.firsts[e[1]]
                can = self._table(lambda c: self._can(first, c))
                out = [f"{pad}if {can}[S[{p}]]:", *self._emit(self.rules[e[1]], p, r, pad + " "), f"{pad}else:"]
                return [*out, f"{pad} {r} = -1", f"{pad} if {p} > far: far = {p}"]
            return [f"{pad}{r} = r_{e[1]}({p})"]
        if kind == "seq":
            out, at = [f"{pad}while True:"], p
            for x in e[1:]:
                to = self._var()
                out += self._emit(x, at, to, pad + " ")
                out += [f"{pad} if {to} < 0:", f"{pad}  {r} = -1", f"{pad}  break"]
                at = to
            return [*out, f"{pad} {r} = {at}", f"{pad} break"]
        if kind == "or":
            firsts = [self._first(x) for x in e[1:]]
            fit = self._table(lambda c: sum(1 << k for k, f in enumerate(firsts) if self._can(f, c)))
            m = self._var()
            out = [*seen, f"{pad}{m} = {fit}[S[{p}]]", f"{pad}{r} = -1", f"{pad}while {m}:"]
            for k, x in enumerate(e[1:]):
                out.append(f"{pad} if {m} & {1 << k}:")
                out += self._emit(x, p, r, pad + "  ")
                out.append(f"{pad}  if {r} >= 0: break")
            return [*out, f"{pad} break"]
        if e == ["*", ["any"]]:
            return [f"{pad}if N > far: far = N", f"{pad}{r} = N"]
        if kind in "?*+":
            first = self._first(e[1])
            can, x = self._table(lambda c: self._can(first, c)), self._var()
            if kind == "?":
                out = [f"{pad}{r} = {p}", f"{pad}if {can}[S[{p}]]:", *self._emit(e[1], p, x, pad + " "), f"{pad} if {x} >= 0: {r} = {x}"]
                return [*out, f"{pad}elif {p} > far: far = {p}"]
            out = [f"{pad}{r} = {p}", f"{pad}while True:", f"{pad} if not {can}[S[{r}]]:", f"{pad}  if {r} > far: far = {r}", f"{pad}  break"]
            out += [*self._emit(e[1], r, x, pad + " "), f"{pad} if {x} <= {r}: break", f"{pad} {r} = {x}"]
            return out + [f"{pad}if {r} == {p}: {r} = -1"] * (kind == "+")
        x = self._var()
        hit, miss = (p, "-1") if kind == "&" else ("-1", p)
        return [*self._emit(e[1], p, x, pad), f"{pad}{r} = {hit} if {x} >= 0 else {miss}"]

    def _source(self) -> str:
        """All rules as functions over the global text ``S`` of ``N`` kinds; ``far`` is the furthest position looked at.

        A rule's matches are kept by position for one text; those of a ``memo`` rule also across texts, by what was read.
        """
        out, count = ["far = 0"], len(self.rules)
        used = Counter(x for body in self.rules.values() for x in _refs(body))
        roots = {"file", "value", "expr", *self.memos, *(x for names in self.group_rules.values() for x in names)}
        self.once = {x for x in self.rules if used[x] == 1 and x not in roots and x not in _refs(self.rules[x])}
        for k, name in enumerate(self.rules):
            if name in self.once:
                continue
            self.vars = 0
            first = self.firsts[name]
            can = self._table(lambda c, first=first: self._can(first, c))
            head = f"r_{name}" if name not in self.memos else f"packrat_{name}"
            out += [
                f"def {head}(i):", " global far", f" if not {can}[S[i]]:", "  if i > far: far = i", "  return -1", f" key = i * {count} + {k}",
                " found = seen.get(key)", " if found is not None:", "  if found[1] > far: far = found[1]", "  return found[0]",
                " before, far = far, i", *self._emit(self.rules[name], "i", "end", " "), " seen[key] = end, far", " if before > far: far = before", " return end",
            ]
            if name in self.memos:
                self.space[f"memo_{name}"] = self.memos[name]
                out += [
                    f"def r_{name}(i):", " global far", f" if i >= N: return packrat_{name}(i)", " at, slices = i, []", " for _ in range(6):",
                    "  m = cut(S, at, N)", "  at = m.end() if m else N",
                    # one token of look-ahead, or a mark that the content ends here: S ends with that mark
                    "  key = S[i : at + 1]", f"  found = memo_{name}.get(key)", "  if found is not None:", "   end, extent = found",
                    "   if i + extent > far: far = i + extent", "   return i + end if end >= 0 else -1",
                    "  slices.append((at - i if at < N else N - i + 1, key))", "  if at >= N: break",
                    f" before, far = far, i", f" end = packrat_{name}(i)", " extent = far - i", " for reach, key in slices:",
                    # nothing outside the slice was looked at
                    "  if extent <= reach:", f"   if len(memo_{name}) > {MEMO_SIZE}: memo_{name}.clear()",
                    f"   memo_{name}[key] = (end - i if end >= 0 else -1, extent)", "   break", " if before > far: far = before", " return end",
                ]
        return "\n".join(out)

    # -- matching

    def match(self, rule: str, content: str) -> tuple[bool, int]:
        """Whether all of ``content`` matches, and the furthest position that was looked at."""
        space = self.space
        space["S"], space["N"], space["far"], space["seen"] = content + "\0", len(content), 0, {}
        end = space["r_" + rule](0)
        if end == len(content):
            return True, end
        return False, max(end, space["far"])

    def group(self, bracket: str, content: str) -> str:
        """The character of a group: equal for groups that match the same rules."""
        memo = self.contents[bracket]
        c = memo.get(content)
        if c is None:
            mask, space, n = 0, self.space, len(content)
            # one text, so what one rule has matched in it holds for the next
            space["S"], space["N"], space["far"], space["seen"] = content + "\0", n, 0, {}
            for k, rule in enumerate(self.group_rules.get(bracket, ())):
                if space["r_" + rule](0) == n:
                    mask |= 1 << k
            c = self.groups.get((bracket, mask))
            if c is None:
                c = self.groups[bracket, mask] = chr(GROUP0 + len(self.info))
                self.info.append((bracket, mask))
            if len(memo) > MEMO_SIZE:
                memo.clear()
            memo[content] = c
        return c

    def expected(self, rule: str, content: str, at: int) -> list[str]:
        """The rules that a group at ``at`` was asked for, best candidates for the place of an error inside it."""
        c = ord(content[at]) if at < len(content) else 0
        if c < GROUP0:
            return []
        bracket, mask = self.info[c - GROUP0]
        return [r for k, r in enumerate(self.group_rules.get(bracket, ())) if not mask & 1 << k]
