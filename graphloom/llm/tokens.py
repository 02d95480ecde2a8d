"""Encoding texts with a public byte-pair tokenizer by prefix dynamic programming.

For every prefix of a piece's bytes the last token of its encoding is stored; there is exactly one token that fits the
encoding of the prefix before it. So a piece of any length takes linear time, text can be appended without encoding
anything again but its end, and after an edit only the surroundings are encoded anew.
"""

from __future__ import annotations

import json
import os
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.arrow import spread
from graphloom.session import ship

#: Where the vocabulary files of the public tokenizers are, and the tokenizer of the queries.
TOKENIZERS = os.environ.get("GRAPHLOOM_TOKENIZERS", "/opt/tokenizers")
TOKENIZER = "byte_bpe_50k"
#: Fixed value: the pattern that splits a text before the merges of the byte-level tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE, BATCH_TOKENS = 500_000, 1 << 20
INFINITE = 1 << 40


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class BytePairs:
    """A byte-level byte-pair vocabulary with its merges."""

    def __init__(self, text: str) -> None:
        model = json.loads(text)["model"]
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        vocab = model["vocab"]
        size = max(vocab.values()) + 1
        #: Rank of the merge that forms a token, -1 for single bytes; the two parts; ranks of pairs.
        self.rank, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.pair: dict[tuple[int, int], int] = {}
        self.ids: dict[bytes, int] = {}
        for s, i in vocab.items():
            if all(c in letters for c in s) and len(s) == 1:
                self.ids[raw(s)] = i
        for r, (a, b) in enumerate(merges):
            t = vocab[a + b]
            self.pair[vocab[a], vocab[b]] = r
            if self.rank[t] < 0:
                self.rank[t], self.left[t], self.right[t] = r, vocab[a], vocab[b]
                self.ids[raw(a + b)] = t
        # the longest token by its last two bytes bounds the search
        self.longest: dict[bytes, int] = {}
        for t in self.ids:
            if len(t) > 1:
                self.longest[t[-2:]] = max(len(t), self.longest.get(t[-2:], 2))
        self.fits: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, tuple[int, ...]] = {}
        self.split = regex.compile(PATTERN).findall

    def compatible(self, a: int, b: int) -> bool:
        """Whether token ``b`` can follow ``a``: no merge across their border comes first at any time."""
        key = (a, b)
        found = self.fits.get(key)
        if found is not None:
            return found
        until_a = until_b = INFINITE  # ranks at which a and b become part of a longer token
        pair, rank = self.pair, self.rank
        while True:
            m = pair.get((a, b))
            if m is not None and m < until_a and m <= until_b:
                ok = False
                break
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                ok = True
                break
            if ra > rb:
                a, until_a = self.right[a], ra
            else:
                b, until_b = self.left[b], rb
        if len(self.fits) > 4 * CACHE:
            self.fits.clear()
        self.fits[key] = ok
        return ok

    def extend(self, data: bytes, last: list[int], size: list[int]) -> None:
        """Last tokens of the prefixes of ``data`` that ``last`` doesn't have yet; ``size`` has their lengths."""
        ids, longest = self.ids, self.longest
        for i in range(len(last), len(data) + 1):
            top = min(i, longest.get(data[i - 2 : i], 1)) if i > 1 else 1
            for k in range(top, 0, -1):
                t = ids.get(data[i - k : i])
                if t is not None and (i == k or self.compatible(last[i - k], t)):
                    last.append(t)
                    size.append(k)
                    break

    def encode_bytes(self, data: bytes) -> tuple[int, ...]:
        """Tokens of one piece."""
        if (t := self.ids.get(data)) is not None:
            return (t,)
        last, size = [-1], [0]
        self.extend(data, last, size)
        out, i = [], len(data)
        while i:
            out.append(last[i])
            i -= size[i]
        return tuple(reversed(out))

    def piece(self, p: str) -> tuple[int, ...]:
        found = self.cache.get(p)
        if found is None:
            if len(self.cache) > CACHE:
                self.cache.clear()
            found = self.encode_bytes(p.encode("utf-8", "replace"))
            if len(p) <= 64:
                self.cache[p] = found
        return found

    def encode(self, text: str) -> list[int]:
        """Tokens of a text, without special tokens."""
        out: list[int] = []
        cache = self.cache
        for p in self.split(text):
            found = cache.get(p)
            out += found if found is not None else self.piece(p)
        return out

    def count(self, text: str) -> int:
        cache, n = self.cache, 0
        for p in self.split(text):
            found = cache.get(p)
            n += len(found) if found is not None else len(self.piece(p))
        return n


class Encoding:
    """The tokens of a text that grows and changes; edits encode only what they touch."""

    #: Pieces before and after an edit that are split again; blanks and letters can join a neighbour.
    MARGIN = 3

    def __init__(self, model: BytePairs, text: str = "") -> None:
        self.model, self.text = model, ""
        self.pieces: list[str] = []
        self.ends: list[int] = []
        self.encoded = 0
        self._open: tuple[bytes, list[int], list[int]] = (b"", [-1], [0])
        self.append(text)

    @property
    def ids(self) -> list[int]:
        return [t for p in self.pieces for t in self._tokens(p)]

    def _tokens(self, p: str) -> tuple[int, ...]:
        data, last, size = self._open
        if len(p) > 64 and p.encode() == data:
            out, i = [], len(data)
            while i:
                out.append(last[i])
                i -= size[i]
            return tuple(reversed(out))
        return self.model.piece(p)

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, stop: int, new: str) -> None:
        """Put ``new`` in place of the characters from ``start`` to ``stop``."""
        if not 0 <= start <= stop <= len(self.text):
            raise ValueError("no such range")
        self.text = self.text[:start] + new + self.text[stop:]
        shift = len(new) - (stop - start)
        first = max(0, bisect_right(self.ends, start) - self.MARGIN)
        begin = self.ends[first - 1] if first else 0
        # split again until a border falls on an old one behind the edit
        old = {e + shift: k for k, e in enumerate(self.ends) if e >= stop}
        pieces, ends, rest, at = [], [], len(self.pieces), begin
        matched = 0
        for m in regex.finditer(PATTERN, self.text, pos=begin):
            pieces.append(m[0])
            at = m.end()
            ends.append(at)
            if at > start + len(new) and at in old:
                matched += 1
                if matched > self.MARGIN:
                    rest = old[at] + 1
                    break
            else:
                matched = 0
        tail_ends = [e + shift for e in self.ends[rest:]] if at < len(self.text) else []
        tail = self.pieces[rest:] if at < len(self.text) else []
        self.encoded = len(pieces)
        self.pieces[first:] = pieces + tail
        self.ends[first:] = ends + tail_ends
        if self.pieces and len(self.pieces[-1]) > 64:
            # the prefix table of a long last piece goes on where it ended
            data, last, size = self._open
            grown = self.pieces[-1].encode()
            if not grown.startswith(data) or not data:
                last, size = [-1], [0]
            self.model.extend(grown, last, size)
            self._open = (grown, last, size)


def vocabulary(name: str = TOKENIZER, folder: str = TOKENIZERS) -> str:
    with open(os.path.join(folder, f"{name}.json"), encoding="utf-8") as f:
        return f.read()


_MODELS: dict[int, BytePairs] = {}


def model_of(shared) -> BytePairs:
    """The model of a broadcast vocabulary, one for each worker."""
    if shared.id not in _MODELS:
        _MODELS.clear()
        _MODELS[shared.id] = BytePairs(shared.value)
    return _MODELS[shared.id]


class _Shared:
    """A broadcast with an id that workers can tell it by."""

    def __init__(self, spark, text: str) -> None:
        self.broadcast, self.id = spark.sparkContext.broadcast(text), hash(text)

    @property
    def value(self) -> str:
        return self.broadcast.value


def encode(documents: DataFrame, name: str = TOKENIZER, folder: str = TOKENIZERS) -> DataFrame:
    """``doc_id`` and ``ids`` of every document; an empty list for null and empty text. One row for each row."""
    spark = documents.sparkSession
    ship(spark)
    shared = _Shared(spark, vocabulary(name, folder))
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        encode_text = model_of(shared).encode
        for b in batches:
            docs, flat, ends = [], [], [0]
            for d, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                docs.append(d)
                if text.is_valid:
                    flat += encode_text(text.as_py())
                ends.append(len(flat))
                if len(flat) > BATCH_TOKENS:
                    yield _batch(docs, flat, ends, schema, np)
                    docs, flat, ends = [], [], [0]
            if docs:
                yield _batch(docs, flat, ends, schema, np)

    return spread(documents.select("doc_id", "text")).mapInArrow(run, "doc_id bigint, ids array<int>")


def _batch(docs: list[int], flat: list[int], ends: list[int], schema: pa.Schema, np) -> pa.RecordBatch:
    values = pa.array(np.array(flat, np.int32))
    lists = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), values)
    return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), lists], schema=schema)


def sizes(documents: DataFrame, name: str = TOKENIZER, folder: str = TOKENIZERS) -> DataFrame:
    """``doc_id`` and the number of tokens of its text, 0 for null and empty."""
    spark = documents.sparkSession
    ship(spark)
    shared = _Shared(spark, vocabulary(name, folder))
    schema = pa.schema([("doc_id", pa.int64()), ("tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = model_of(shared).count
        for b in batches:
            n = [count(t.as_py()) if t.is_valid else 0 for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(n, pa.int64())], schema=schema)

    return spread(documents.select(F.col("doc_id").cast("bigint"), "text")).mapInArrow(run, "doc_id bigint, tokens bigint")
