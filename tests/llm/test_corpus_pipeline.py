"""The pipeline's stages against plain Python over the smallest documents, and on odd rows."""

import hashlib
import re
from itertools import pairwise

import corpus_pipeline as P
import pytest
from tokenizers import Tokenizer

from footfall.llm import decontam, pii
from footfall.llm.queries import PSEUDONYM_KEY, vocabulary_path
from tests.llm.test_decontam import brute as leaks
from tests.llm.test_quality_rules import brute as measures
from tests.llm.test_simhash import components, print_of

FOLDER = "/root/testdata/sf0.001"


def kept_by_rules(text):
    m = measures(text)
    letters = len(re.findall(r"[^\W\d_]", text))
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return not (
        m["n_words"] < 20
        or 100 * m["n_repeat_words"] > 30 * m["n_words"]
        or 10 * m["n_symbols"] > 3 * m["n_words"]
        or (len(lines) >= 4 and 2 * m["n_dup_lines"] > len(lines))
        or 10 * sum(c.isupper() for c in text) > 6 * letters
        or 10 * text.count("!") > 3 * m["n_words"]
        or m["word_chars"] > 20 * m["n_words"]
        or 10 * sum(a == b for a, b in pairwise(text.encode().split())) > 3 * m["n_words"]
    )


@pytest.fixture(scope="module")
def expected(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    first = {k: t for k, t in docs.items() if kept_by_rules(t)}
    keys = sorted(first)
    groups = components([print_of(first[k]) for k in keys])
    second = {k: first[k] for i, k in enumerate(keys) if groups[i] == i}
    third = {k: t for k, t in second.items() if not leaks(t, items)}
    replace = pii.Replacer(PSEUDONYM_KEY)
    fourth = {k: replace(t)[0] for k, t in third.items()}
    return [first, second, third, fourth]


def test_stages(spark, expected):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for (_, stage), want in zip(P.STAGES, expected, strict=False):
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == P.COLUMNS
        assert {r.doc_id: r.text for r in docs.collect()} == want
    assert len(expected[0]) < 200 and len(expected[1]) < len(expected[0]) and len(expected[2]) < len(expected[1])


def test_run(spark, expected):
    library = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    rows = P.run(spark, FOLDER).collect()
    assert {r.doc_id for r in rows} == set(expected[-1])
    for row in rows:
        ids = library.encode(expected[-1][row.doc_id], add_special_tokens=False).ids
        assert row.ids == ids and row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_rows(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text, None, None, None), (1, text, None, None, None), (None, text + " more", "en", "s", 5), (None, None, None, None, None), (2, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in P.STAGES:
        docs = stage(spark, docs, FOLDER)
        assert docs.count() == (3 if name == "quality rules" else 2 if name == "near-duplicates" and docs.where("doc_id is null").count() else docs.count())
    empty = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        empty = stage(spark, empty, FOLDER)
        assert empty.count() == 0
    assert decontam.OVERLAP == 0.8
