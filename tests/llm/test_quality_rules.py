import re
from collections import Counter

from pyspark.sql import functions as F

from footfall.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts = Counter(windows)
    inside = {j for i, w in enumerate(windows) if counts[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(inside),
    }


TEXTS = [
    None, "", " \t\n", "one", "a b c d e f g h", "a b c d e f g h " * 2, "a b c d e f g h x a b c d e f g h i j", "x " * 40, "l1 a\nl1 a\n\n \nl2\nl1 a",
    "# * $ % & | < > é 🙂🙂 ü ü", " ".join(f"w{i}" for i in range(30_000)), " ".join(f"w{i % 7000}" for i in range(30_000)), "\x0b\x0cz\x85y",
]


def test_measures(spark):
    docs = spark.createDataFrame([(i, t, i, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words long, failed string")
    for row in Q.ledger(docs).collect():
        want = brute(TEXTS[row.doc_id])
        assert {k: row[k] for k in want} == want, row.doc_id


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    entries = Q.ledger(docs)
    for row in entries.collect():
        want = brute(row.text)
        assert {k: row[k] for k in want} == want


def test_policy_and_ablation(spark):
    words = " ".join(f"w{i}" for i in range(40))
    texts = [words, "a few words", words.upper(), ("a b c d e f g h i j " * 5), " ".join(w + "%%" for w in words.split()), "HI!! YOU!!"]
    entries = Q.ledger(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))
    kept = {r.doc_id: r.kept for r in entries.select("doc_id", Q.keeps("web-1").alias("kept")).collect()}
    assert kept == {0: True, 1: False, 2: False, 3: False, 4: False, 5: False}
    table = {r.rule: (r.n_failed, r.n_failed_alone, r.n_kept_without) for r in Q.ablations(entries, "web-1").collect()}
    assert table["few_words"] == (2, 1, 2)
    assert table["symbols"] == (1, 1, 2)
    assert table["shouting"][0] == 2


def test_stuttering(spark):
    texts = ["a a a a a b b b b b c c c c c d d d d d e e e e e", " ".join(f"w{i}" for i in range(30)), None]
    rows = Q.ledger(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    assert {r.doc_id: r.n_same_next for r in rows} == {0: 20, 1: 0, 2: 0}
    assert {r.doc_id: r.failed >> 7 & 1 for r in rows} == {0: 1, 1: 0, 2: 0}


def test_clean_documents_stay(spark):
    folder = "/root/testdata/sf0.1"
    entries = Q.ledger(spark.read.parquet(f"{folder}/documents.parquet")).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    judged = entries.where(Q.keeps("base-1")).select("quality", Q.keeps("web-1").alias("kept"))
    counts = {(r.quality, r.kept): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
    assert (1, False) not in counts and counts.get((0, True), 0) < 0.02 * counts[0, False]


def test_empty(spark):
    assert Q.ledger(spark.createDataFrame([], "doc_id int, text string")).count() == 0


def test_no_python(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id int, text string")
    plan = Q.ledger(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan.split("Scan")[0])
    assert F is not None


def test_columns_of_any_name_keep_their_value(spark):
    from footfall.llm import simhash

    names = ["_text", "_words", "_lines", "_hashes", "_sorted", "_key", "_fp", "_group", "_at", "_searched", "fp", "n", "component"]
    rows = [(1, "a b c d e f", *names), (1, "a b c d e f", *names), (2, "a b c d e f", *names), (None, "x y", *names), (3, None, *names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    made = Q.ledger(docs).collect()
    assert len(made) == 5 and all(row[n] == n for row in made for n in names)
    assert sorted(r.n_words for r in made) == [0, 2, 6, 6, 6]
    kept = simhash.first_of_each(docs).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == [(0, "x y"), (1, "a b c d e f"), (3, "")]
    assert all(row[n] == n for row in kept for n in names)
