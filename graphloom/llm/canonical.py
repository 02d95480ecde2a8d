"""The canonical layout of a source, and what a file's own layout has in common with it."""

from __future__ import annotations

import re
from collections import Counter
from itertools import compress

import numpy as np

from graphloom.llm.lexers import NL0, Language, language

#: Characters of a canonical line; a longer statement is broken into lines of so many.
WIDTH = 100
#: Shapes that count as records, and how often one has to come.
SHAPES, AGAIN = 4, 3
#: Records from which on it can be told whether they count.
STEPS = 5
_NUMBER = re.compile(r"(\d{1,9})[\"'`]?\Z")


class _Tables:
    """What a kind means for the layout, by its code; one for each language."""

    def __init__(self, lang: Language) -> None:
        of = lang.kinds.of

        def table(kinds) -> np.ndarray:
            t = np.zeros(1 << 16, bool)
            t[[ord(c) for c in kinds]] = True
            return t

        named = lambda words: [of[w] for w in words if w in of]
        self.newline = table(["\n"])
        self.newline[NL0:0xF900] = True
        self.solid = ~(self.newline | table(["\x02"]))
        self.step = np.zeros(1 << 16, np.int8)
        self.step[[ord(c) for c in "([{"]], self.step[[ord(c) for c in ")]}"]] = 1, -1
        self.tight = table(["(", ")", "[", "]", *named((",", ";", "."))])
        self.literal = table([lang.kinds[x] for x in ("NUM", "STR", "BYTES", "TPL", "CHAR")])
        self.word = table([lang.NAME, *(c for w, c in of.items() if w.isalpha() and w.islower())])
        self.comma, self.semi = ord(of[","]), ord(of[";"])
        self.joined = table([")", "]", *named((",", ";", ".", "else", "while", "catch", "finally"))])
        self.ends, starts = table(map(chr, lang.ends_line())), lang.begins_line()
        self.starts = table(map(chr, starts)) if starts is not None else np.ones(1 << 16, bool)
        # before the brace of a block, which is never written into the line
        self.heads = table(["{", "}", *named((")", "else", "try", "finally", "do", "=>", "->", ";"))] if lang.name in ("java", "javascript", "typescript") else [])


_TABLES: dict[str, _Tables] = {}


class Canonical:
    """The tokens of a source in canonical lines.

    A statement is a line of its own, and so is an entry of a braced or bracketed group that doesn't fit into one line,
    but entries that are single literals fill lines. A line ends behind the brace that opens a block and before the one
    that closes it; lines longer than ``WIDTH`` are broken. Comments and blanks of the source don't matter.
    """

    def __init__(self, lang: Language, pieces: list[str], texts: list[str], kinds: list[str]) -> None:
        t = _TABLES.get(lang.name)
        if t is None:
            t = _TABLES[lang.name] = _Tables(lang)
        python = lang.name == "python"
        # a token with a regular expression behind it counts by its first kind
        codes = np.frombuffer("".join([k[:1] or "\x02" for k in kinds]).encode("utf-16-le"), np.uint16)
        solid = t.solid[codes]
        keep = solid.tolist()
        self.tokens = list(compress(texts, keep))
        k = codes[solid]
        self.k = k.tobytes().decode("utf-16-le")
        self.solid = solid
        n = len(k)
        # breaks of the source before each token
        breaks = np.array(["\n" in p for p in pieces], bool) if "\n" in lang.blanks else t.newline[codes]
        before = np.cumsum(breaks)[solid]
        starts = np.ones(n, bool)
        starts[1:] = before[1:] > before[:-1]
        self.starts = starts
        self.lines = int(starts.sum())
        self.literal = t.literal[k]
        self.words = int(t.word[k].sum())
        self.widths = np.fromiter(map(len, self.tokens), np.int64, n)
        room = np.zeros(n + 1, np.int64)
        np.cumsum(self.widths + ~t.tight[k], out=room[1:])
        # levels of brackets, which count as inside; in order of level each open one comes before what is right inside
        step = t.step[k]
        level = np.cumsum(step, dtype=np.int32) + (step < 0)
        order = np.argsort(level.astype(np.int16), kind="stable")
        opened = np.where(step[order] > 0, np.arange(n), -1)
        last = np.maximum.accumulate(opened) if n else opened
        around = np.zeros(n, np.uint16)  # the bracket right around each token
        around[order] = np.where((last >= 0) & (level[order] > 0), k[order][np.maximum(last, 0)], 0)
        top = (around == 0) | (around == ord("{")) | (step > 0)
        a, z = order[step[order] > 0], order[step[order] < 0]
        m = min(len(a), len(z))
        a, z = a[:m], z[:m]
        end = np.zeros(n + 1, bool)  # a line ends before this token
        end[0] = end[n] = True
        stops = (k == t.semi) & ((around == 0) | (around == ord("{")))
        if python:
            ends = starts & (level - (step > 0) == 0)
            ends[1:] |= stops[:-1]
            end[:n] |= ends
            stops = ends
        else:
            end[1:] |= stops
            if "\n" not in lang.blanks and n > 1:
                asi = starts[1:] & t.ends[k[:-1]] & t.starts[k[1:]] & top[:-1]
                asi &= (around[1:] == 0) | (around[1:] == ord("{")) | (step[1:] > 0)
                end[1:n] |= asi
                stops[:-1] |= asi
        counted = np.zeros(n + 1, np.int64)
        np.cumsum(stops, out=counted[1:])
        whole = counted[z] == counted[np.minimum(a + 1, n)]
        wide = ~whole | (room[z] - room[a] > WIDTH)
        if not python:
            braces = k[a] == ord("{")
            block = braces & (~whole | (room[z] - room[a] > 0.8 * WIDTH) | t.heads[k[np.maximum(a - 1, 0)]]) & (z > a + 1)
            end[a[block] + 1] = True
            end[z[block]] = True
            follow = np.zeros(n + 1, np.uint16)
            follow[:n] = k
            out = z[block][~t.joined[follow[z[block] + 1]]]
            end[out + 1] = True
        # entries of groups that don't fit
        split = np.zeros(n, bool)
        comma = k == t.comma
        for i, j in zip(a[wide & whole].tolist(), z[wide & whole].tolist(), strict=True):
            split[i + 1 : j] |= comma[i + 1 : j] & (level[i + 1 : j] == level[i])
        if split.any():
            # single literals between commas fill the line
            fill = np.zeros(n, bool)
            fill[2:] = split[2:] & self.literal[1:-1] & split[:-2]
            end[1:] |= split & ~fill
        self.begin = np.flatnonzero(end[:n])
        self.stop = np.append(self.begin[1:], n) if n else self.begin
        self.room = room[self.stop] - room[self.begin]
        self.count = int(np.maximum(1, -(-self.room // WIDTH)).sum())

    def emit(self) -> list[str]:
        """The canonical lines as text, for comparison and tests; what is longer than ``WIDTH`` isn't broken here."""
        return [" ".join(self.tokens[a:z]) for a, z in zip(self.begin.tolist(), self.stop.tolist(), strict=True)]

    @property
    def expansion(self) -> float:
        """Canonical lines to one line of the source."""
        return self.count / max(1, self.lines)

    def uniformity(self) -> tuple[float, int]:
        """The share of canonical lines that are records laid out alike in the source, and how many lines there are.

        Records are lines of the few shapes that come again and again; of one shape those count that the source breaks at
        the same tokens. Lines of no more than brackets don't count.
        """
        k, starts = self.k, self.starts.tobytes()
        shapes = [(k[a:z], starts[a:z]) for a, z in zip(self.begin.tolist(), self.stop.tolist(), strict=True) if z > a + 2]
        again = sum(c for _, c in Counter(shapes).most_common(SHAPES) if c >= AGAIN)
        return again / max(1, len(shapes)), len(shapes)

    def counting(self) -> float:
        """How regularly the records count: the share of steps that are the usual one, of the best-counting place.

        A place is a token's position in records of one shape; its number is the digits that it ends in. A tool that
        writes a record for each of a list numbers them in equal steps, by name, value or position.
        """
        k, by = self.k, {}
        for a, z in zip(self.begin.tolist(), self.stop.tolist(), strict=True):
            if z > a + 2:
                by.setdefault(k[a:z], []).append(a)
        best = 0.0
        for shape, rows in sorted(by.items(), key=lambda x: -len(x[1]))[:SHAPES]:
            if len(rows) < STEPS:
                continue
            for j in range(len(shape)):
                found = [_NUMBER.search(self.tokens[a + j]) for a in rows]
                if None in found:
                    continue
                numbers = [int(m[1]) for m in found]
                steps = Counter([b - a for a, b in zip(numbers, numbers[1:], strict=False)])
                step, times = steps.most_common(1)[0]
                if step:
                    best = max(best, times / (len(numbers) - 1))
        return best
