"""The prefix trie against plain prefix sets."""

import hashlib
import math
import random
import zlib

import pytest

from footfall.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string, seq long, n long"


def plain(rows):
    """The contract over (conv_id, turn, role, text), by sets of prefixes."""
    turns = {}
    for c, t, r, x in rows:
        turns.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    made = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = turns.get(c - int(math.fmod(c, 5)), [])  # the remainder has the sign of c, as in SQL
        made[c] = tuple(base[:h] + own[h:])
    nodes = {}
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], set()).add(c)
    children, leaves, saved = ({k: 0 for k in nodes} for _ in range(3))
    for k in nodes:
        if k:
            children[k[:-1]] += 1
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += children[k] == 0
            saved[k[:d]] += (len(members) - 1) * len(k[-1][1].encode()) if k else 0
    out = []
    for k, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(c for c in members if made[c] == k))
        parent = min(nodes[k[:-1]]) if k else None
        out.append((min(members), len(k), parent, len(members), children[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, folder, rows):
    spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA).repartition(4).write.parquet(f"{folder}/conversations.parquet")
    found = queries.op11_prefix_trie(spark, str(folder))
    assert found.columns[:8] == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in found.collect()), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_against_plain_prefixes(spark, tmp_path, monkeypatch, seed):
    """Few different turns, so that prefixes are shared at all depths, some conversations alike and one very long."""
    monkeypatch.setattr(prefix_trie, "BLOCK", 7)
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    draw = random.Random(seed)
    rows = []
    for c in draw.sample(range(-20, 400), 130):
        kind = draw.random()
        if kind < 0.3:
            said = [("user", "hello Ä"), ("bot", "hi")] * 3
        else:
            said = [(draw.choice(["user", None, ""]), draw.choice(["a", "b", "ß", None, ""])) for _ in range(draw.choice([1, 2, 3, 8, 12]))]
        rows += [(c, i if i or draw.random() < 0.5 else None, r, x) for i, (r, x) in enumerate(said)]
    long = [("user", str(i % 3)) for i in range(150)]
    for c, n in ((1000, 150), (1001, 140), (1003, 150), (1005, 97), (1010, 150)):
        rows += [(c, i, r, x) for i, (r, x) in enumerate(long[:n])]
    assert run(spark, tmp_path, rows) == plain(rows)


def test_odd_rows(spark, tmp_path):
    rows = [(5, 0, "u", "x"), (6, 0, "u", "x"), (6, 0, "u", "x"), (7, None, None, None), (8, 3, "u", ""), (23, 1, "only", "short"), (24, 2, "z", "z" * 100_000)]
    assert run(spark, tmp_path, rows + [(None, 1, "u", "x")]) == plain(rows)


def test_one_and_none(spark, tmp_path):
    (tmp_path / "a").mkdir()
    rows = [(23, 1, "only", "short")]  # nothing is left of it
    assert run(spark, tmp_path / "a", rows) == plain(rows)
    assert run(spark, tmp_path, []) == []


def test_two_fattest(spark):
    rows = [(a, b) for a in range(0, 40) for b in range(0, 70)] + [(2**40 - 1, 2**41), (2**41, 2**41 + 3), (0, 2**52 - 1)]
    for a, b, f in spark.createDataFrame(rows, "a long, b long").select("a", "b", prefix_trie.two_fattest(prefix_trie.F.col("a"), prefix_trie.F.col("b"))).collect():
        want = None
        if a < b:
            want = next(x for s in range(60, -1, -1) if (x := b >> s << s) > a)
        assert f == want


def test_long_edges_are_expanded(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 10)
    df = spark.createDataFrame([("a", 3, 57), ("b", 5, 5), ("c", 9, 8), ("d", 1, 10)], "k string, lo long, hi long")
    got = sorted((r.k, r.d) for r in prefix_trie._expanded(df, prefix_trie.F.col("lo"), prefix_trie.F.col("hi")).collect())
    assert got == sorted([("a", d) for d in range(3, 58)] + [("b", 5)] + [("d", d) for d in range(1, 11)])
