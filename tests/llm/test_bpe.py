import random

import pytest
from tokenizers import Tokenizer

from footfall.llm import bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(PATH)


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def same(vocabulary, library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert vocabulary.encode(text) == ids, repr(text)
    assert vocabulary.decode(ids) == library.decode(ids, skip_special_tokens=False), repr(text)


CASES = [
    "", " ", "a", "Aaaaaaaaaaaaaaaaaaaa", "Hello, World! it's we'll 've '", "<|endoftext|>x<|startoftext|> <|ENDOFTEXT|><|endoftext|", "ΣΑΣ Σ ς İstanbul ǅ ß ﬁ",
    "é ́a ạ́ 가", "\x00\x01\x1c!\x1c!\x1d \x85\xa0　x​x﻿", "१२३ ² Ⅷ 一二三 🙂🙂🏽", "x" * 5000, "!?" * 3000, "ab" * 4000,
]


@pytest.mark.parametrize("text", CASES)
def test_cases(vocabulary, library, text):
    same(vocabulary, library, text)


def test_every_assigned_letter(vocabulary, library):
    for start in range(0, 0x40000, 97):
        same(vocabulary, library, "a".join(chr(c) for c in range(start, start + 97) if not 0xD800 <= c < 0xE000))


def test_random(vocabulary, library):
    draw = random.Random(3)
    for _ in range(3000):
        letters = draw.choice(["ab", "etaoinshr", "aàéñß", "th e\n", "!.'s t", "0123 ", "ththeinger"])
        same(vocabulary, library, "".join(draw.choice(letters) for _ in range(draw.randint(1, 60))))


def test_frames(spark):
    rows = [(1, "The thing <|endoftext|>", "x"), (1, "The thing <|endoftext|>", "x"), (None, None, None), (3, "", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    coded = bpe.encode(docs.drop("ids"), PATH)
    assert {r.doc_id: r.ids for r in coded.collect()}[3] == []
    back = bpe.decode(coded, PATH).collect()
    assert sorted(r.text for r in back) == ["", "", "the</w> thing</w> <|endoftext|>", "the</w> thing</w> <|endoftext|>"]
    out = bpe.digests(docs, PATH, ["doc_id"])
    assert out.count() == 4 and out.where("n_tokens = 0").count() == 2
    assert bpe.digests(docs.limit(0), PATH, ["doc_id"]).count() == 0


def test_pieces_are_spelled_once(vocabulary, library, monkeypatch):
    """Words that differ only in marks share the work on their letters, also when little is remembered."""
    vocabulary = bpe.Vocabulary(PATH)
    spelled = []
    plain = vocabulary.encode_word
    monkeypatch.setattr(vocabulary, "encode_word", lambda w: spelled.append(w) or plain(w))
    same(vocabulary, library, "Antionbleti antionbleti, antionbleti. antionbleti*** Kelvin kelvin;")
    assert len(spelled) == len(set(spelled)) and spelled.count("antionbleti") == 1
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    small = bpe.Vocabulary(PATH)
    for text in CASES:
        same(small, library, text * 3)
    assert len(small.pieces) <= 3
