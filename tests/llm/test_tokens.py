import os
import random

import pytest

from graphloom.llm import tokens

pytestmark = pytest.mark.skipif(not os.path.exists(f"{tokens.TOKENIZERS}/byte_bpe_50k.json"), reason="no tokenizers")
PARTS = [
    "a", "b", "aa", "ing", " the", " ", "  ", "\n", "\t", "é", "日本", "ñ", "0", "12", "'s", "'ll", "'", "!!", "--", "=", "\x1c", "\x1f", "\x85", "\xa0", "\u200b", "　", "😀", "A", "THE", "zz", "abab", "\u0301", "Ⅷ", "½", "\x00", "<|endoftext|>",
]


@pytest.fixture(scope="module")
def model():
    return tokens.BytePairs(tokens.vocabulary())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def some(rng, n):
    return "".join(rng.choice(PARTS) for _ in range(rng.randint(0, n)))


def test_equals_the_library(model, library):
    rng = random.Random(7)
    for _ in range(3000):
        s = some(rng, 40)
        assert model.encode(s) == library(s), s
        assert model.count(s) == len(library(s))


def test_long_pieces(model, library):
    for s in ("a" * 20_000, "ab" * 9000 + "c", "=" * 5000, " " * 5000 + "x", "日" * 3000, "aA1" * 2000):
        assert model.encode(s) == library(s)


def test_every_token_encodes_itself(model):
    for data, t in list(model.ids.items())[::97]:
        last, size = [-1], [0]
        model.extend(data, last, size)
        assert (last[-1], size[-1]) == (t, len(data))


def test_appends_and_edits(model):
    rng = random.Random(3)
    for _ in range(120):
        e = tokens.Encoding(model, some(rng, 120))
        for _ in range(5):
            a = rng.randint(0, len(e.text))
            b = min(len(e.text), a + rng.randint(0, 6))
            new = some(rng, 5)
            want = e.text[:a] + new + e.text[b:]
            e.replace(a, b, new)
            assert e.text == want and e.ids == model.encode(want)
        e.append("x" * 90)
        e.append("xy" * 40)
        assert e.ids == model.encode(e.text)


def test_an_edit_encodes_little(model):
    e = tokens.Encoding(model, "some words of a text " * 2000)
    e.replace(20_000, 20_003, "new")
    assert e.encoded < 30 and e.ids == model.encode(e.text)


def test_operator(spark, library):
    rows = [(1, "Hello world"), (2, ""), (3, None), (4, " "), (5, "Hello world"), (6, "é" * 50_000), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as ids", "2 as tokens")
    got = {r.doc_id: list(r.ids) for r in tokens.encode(docs).collect()}
    assert got == {d: library(t) if t else [] for d, t in rows}
    assert {r.doc_id: r.tokens for r in tokens.sizes(docs).collect()} == {d: len(x) for d, x in got.items()}
    assert tokens.encode(docs.limit(0)).collect() == []
