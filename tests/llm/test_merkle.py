"""The Merkle manifest against a plain recursive one."""

import hashlib
import random
import zlib

import pytest

from footfall.llm import merkle, queries


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes, fanout):
    """(root, siblings before and after each node on the way up, per leaf)."""
    trails = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        for i, trail in enumerate(trails):
            run, slot = runs[at[i] // fanout], at[i] % fanout
            trail.append((run[:slot], run[slot + 1 :]))
            at[i] //= fanout
        nodes = [h(*run) for run in runs]
    return nodes[0], trails


def plain(rows, fanout=8):
    """{row number: result} of rows (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for i, row in enumerate(rows):
        groups.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, plain_leaf(row), i))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs, trails = [], {}
    for name in names:
        leaves = sorted(groups[name])
        root, found = climb([x[2] for x in leaves], fanout)
        subs.append(root)
        trails |= {x[3]: t for x, t in zip(leaves, found, strict=True)}
    root, over = climb(subs, fanout)
    out = {}
    for i, row in enumerate(rows):
        n = names.index(row[2])
        path = trails[i] + over[n]
        own = plain_leaf(row)
        bad = list(row)
        if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[4] is not None:
            bad[4] = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in row[4])
        node = plain_leaf(bad)
        for left, right in path:
            node = h(*left, node, *right)
        proof = h("".join("".join(left) + "".join(right) for left, right in path))
        out[i] = (row[0], own, subs[n], root, proof, node, node == root)
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, idx long"


@pytest.mark.parametrize("seed", range(3))
def test_against_plain_trees(spark, tmp_path, seed):
    draw = random.Random(seed)
    langs = [None, "", "=", "de", "é", *[f"l{i}" for i in range(draw.choice([0, 3, 30]))]]
    rows = []
    for i in range(draw.choice([150, 700])):
        lang = draw.choice(langs) if draw.random() < 0.5 else "de"
        rows.append((draw.choice([None, i, i, i, -i, i % 50]), draw.choice([None, "S", ""]), lang, draw.choice([None, i]), draw.choice([None, "", "Abc É", "low", "A" * 3000])))
    rows += rows[:40]
    spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted(map(repr, (tuple(r) for r in queries.op13_merkle(spark, str(tmp_path)).collect())))
    assert found == sorted(map(repr, plain(rows).values()))


@pytest.mark.parametrize("sizes", [[1], [2], [8], [9], [64, 1], [65], [1] * 9, [513, 8]])
def test_shapes(spark, tmp_path, sizes):
    rows = [(i, "s", f"g{g}", 1, f"T{i}") for g, n in enumerate(sizes) for i in range(1000 * g, 1000 * g + n)]
    spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted(tuple(r) for r in queries.op13_merkle(spark, str(tmp_path)).collect())
    assert found == sorted(plain(rows).values())


def test_binary_trees(spark):
    """With two slots the offset is the XOR of the index with one."""
    rows = [(i, "s", "a", 1, str(i)) for i in range(37)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).drop("tree", "idx")
    made = merkle.manifest(docs.select("doc_id", "lang", merkle.leaf(*(merkle.F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))).alias("leaf")), "doc_id", "lang", fanout=2)
    want = plain(rows, 2)
    assert made.root.hex() == want[0][3]
    counts = {r["level"]: r["count"] for r in made.nodes().groupBy("level").count().collect()}
    assert counts == {0: 37, 1: 19, 2: 10, 3: 5, 4: 3, 5: 2, 6: 1}
    for r in made.proofs().select("doc_id", merkle.proof(merkle.F.col("path")).alias("p"), merkle.spelled(merkle.folded(merkle.F.col("leaf"), merkle.F.col("path"))).alias("f")).collect():
        assert r.p == want[r.doc_id][4] and r.f == want[r.doc_id][3]


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op13_merkle(spark, str(tmp_path)).count() == 0
