"""Simple-8b and the token files: exact round trips, the tokenizers library, and plain counts."""

import random
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from footfall.llm import queries, simple8b, token_output
from footfall.llm.queries import vocabulary_path

VOCABULARY = vocabulary_path("byte_bpe_50k.json")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 70_000), st.integers(0, 2**64 - 1), st.sampled_from([0, 2**60 - 1, 2**60])), max_size=600))
def test_round_trip(values):
    words, escaped = simple8b.pack(np.array(values, np.uint64))
    out = simple8b.unpack(words, escaped)
    assert out[: len(values)].tolist() == values and not out[len(values) :].any()
    assert escaped.tolist() == [v for v in values if v >= 2**60]


def test_densest_words():
    """Each word holds as many of the next values as any selector allows."""
    draw = random.Random(2)
    values = [draw.choice([0, 0, 1, 5, 200, 3000, 50_000, 10**6, 2**61]) if draw.random() < 0.6 else 0 for _ in range(5000)]
    words, _ = simple8b.pack(np.array(values, np.uint64))
    at = 0
    for word in words.tolist():
        fits = [
            int(c)
            for c, w in zip(simple8b.COUNTS[1:], simple8b.WIDTHS[1:], strict=True)
            if all(v < 2 ** int(w) for v in values[at : at + int(c)])
        ]
        assert simple8b.COUNTS[word >> 60] == max(fits, default=1)
        at += int(simple8b.COUNTS[word >> 60])
    assert at >= len(values)


def test_slices():
    draw = np.random.default_rng(1)
    values = draw.integers(0, 50_257, 20_000).astype(np.uint64)
    values[::997] = 2**63
    words, escaped = simple8b.pack(values)
    starts = simple8b.offsets(words)
    for lo, hi in [(0, 0), (0, 1), (0, 20_000), (19_999, 20_000), (5, 777), (12_345, 12_346), (996, 998)]:
        assert (simple8b.unpack_range(words, escaped, starts, lo, hi) == values[lo:hi]).all()


ODD = [
    "", " ", "  two  blanks ", "a b", "don't  you're 's 't", " 's", "tab\tand\nline\r\n  end", "x  y   z", "é äb", "\x1c \x1f a \x85 b", "​ ﻿ c",
    "a\nb,\nc.\n\nd e\n f \ng, h", "line\n", "x\n<|endoftext|>\n <|endoftext|> <|endoftext|>\n y", "<|endoftext|>", "a <|endoftext|> b", "a<|endoftext|>b c", "日本 語 テスト", "नमस्ते दुनिया", "١٢ ٣", "½ ² a", "_ _a_ b", "🙂 🙂🙂 a", "'ll 've", "a 'll", "a ' b", "1 2 3a 4,5 6", "A" * 3000 + " " + "b c" * 2000, "　 a　b",
]


def test_pieces_give_the_ids_of_whole_texts():
    draw = random.Random(7)
    library = Tokenizer.from_file(VOCABULARY)
    encode = token_output.Encoder(VOCABULARY)
    assert encode.by_pieces
    signs = [*"ab Z09 _-'.,  \n\n\t", "<|endoftext|>", "word word, line.\nNext", " ", "é", "é", "ß", "中", "🙂", "‍", "\x1d", "²", "\n, ", "a, b. c", " ", "'s", "ǅ", "١"]
    texts = ODD + ["".join(draw.choices(signs, k=draw.randint(0, 60))) for _ in range(4000)]
    for part in (texts[:100], texts[100:]):
        for text, found in zip(part, encode(pa.array(part)), strict=True):
            assert found.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def folder(spark):
    from footfall.llm.common import shared_folder

    return f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"


@pytest.mark.parametrize("block_ids", [1 << 20, 50])
def test_files_against_plain_counts(spark, monkeypatch, block_ids):
    monkeypatch.setattr(token_output, "BLOCK_IDS", block_ids)
    monkeypatch.setattr(token_output, "FILE_BLOCKS", 3)
    texts = ODD * 4 + [None, None, "word " * 30_000]
    rows = [(7 * i % 101 - 20 if i % 9 else None, t, "x", 1.0) for i, t in enumerate(texts)] + [(3, "same", "x", 2.0)] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, start double").repartition(6)
    place = folder(spark)
    token_output.write(docs, place, VOCABULARY)
    found = sorted((r.start, r.key, r.n_tokens, r.ids_crc32, r.ids) for r in token_output.read(spark, place).collect())
    library = Tokenizer.from_file(VOCABULARY)
    want = sorted((k is not None, k or 0, (*library.encode(t or "", add_special_tokens=False).ids, 0)) for k, t, *_ in rows)
    assert sorted((k is not None, k or 0, tuple(ids)) for _, k, _, _, ids in found) == want
    at, last = 0, (False, 0)
    for start, key, n, crc, ids in found:
        assert start == at and n == len(ids) and crc == zlib.crc32(np.array(ids, "<u4").tobytes())
        assert last <= (key is not None, key or 0)
        at, last = at + n, (key is not None, key or 0)
    short = sorted((r.start, r.key, r.n_tokens, r.ids_crc32) for r in token_output.read(spark, place, ids=False).collect())
    assert short == [x[:4] for x in found]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    place = folder(spark)
    token_output.write(docs, place, VOCABULARY)
    assert token_output.read(spark, place).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in queries.op12_token_output(spark, sf).collect()}
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    library = Tokenizer.from_file(VOCABULARY)
    at = 0
    for key, text in docs:
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        assert tuple(rows[key]) == (key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(rows) == len(docs)
