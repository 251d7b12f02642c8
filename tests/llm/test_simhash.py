import random
import re

import numpy as np
import pytest
import xxhash

from footfall.llm import simhash as S
from footfall.llm.components import connected

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def print_of(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    bits = 0
    for b in range(64):
        n = sum(xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for s in shingles)
        bits |= (2 * n > len(shingles)) << b
    return bits


def components(prints):
    """Least row of each chain, by comparing all pairs."""
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def corpus(seed=1):
    draw = random.Random(seed)
    words = [f"w{i}É" for i in range(3000)]
    texts = [None, "", " \n", "one", "ONE", "a b c"]
    for _ in range(60):
        base = [draw.choice(words) for _ in range(draw.randint(1, 300))]
        for _ in range(draw.randint(1, 6)):
            text = list(base)
            if draw.random() < 0.7:
                text[draw.randrange(len(text))] = draw.choice(words)
            texts.append(" ".join(text))
    return texts


@pytest.mark.parametrize("dense", [S.DENSE, 2])
def test_against_all_pairs(spark, dense):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, fp string")
    prints = [print_of(t) for t in texts]
    want = components(prints)
    rows = S.near_duplicates(docs, dense=dense).select("doc_id", S.hex16(S.F.col("fp")).alias("h"), "component").collect()
    assert len(rows) == len(texts)
    for row in rows:
        assert row.h == f"{prints[row.doc_id]:016x}" and row.component == want[row.doc_id]


@pytest.mark.parametrize("dense", [S.DENSE, 8])
def test_close_prints(spark, dense):
    """Fingerprints scattered around a few centres, so that cells are full."""
    draw = random.Random(4)
    prints = {0}
    for _ in range(4):
        centre = draw.getrandbits(64)
        for _ in range(150):
            x = centre
            for _ in range(draw.randint(0, 7)):
                x ^= 1 << draw.randrange(64)
            prints.add(x)
    prints = sorted(prints)
    frame = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in prints], "fp long")
    want = components(prints)
    found = {r.node: r.root for r in connected(S.links(frame, 4, dense)).collect()}
    groups, seen = {}, {}
    for x, w in zip(prints, want, strict=True):
        node = int(np.uint64(x).view(np.int64))
        groups.setdefault(w, set()).add(found.get(node, node))
        seen.setdefault(found.get(node, node), set()).add(w)
    assert all(len(g) == 1 for g in groups.values()) and all(len(g) == 1 for g in seen.values())


def test_grid_covers_all_distances():
    for n in (10, 10**5, 10**7, 10**9):
        masks = S.grid(n, 4)
        for _ in range(200):
            x = random.getrandbits(64)
            y = x
            for _ in range(4):
                y ^= 1 << random.randrange(64)
            assert any(all(((x >> 2 * s & 3).bit_count() == (y >> 2 * s & 3).bit_count()) for s in range(32) if m >> 2 * s & 3) for m in masks)


def test_bound(spark):
    draw = random.Random(9)
    pairs = [(draw.getrandbits(64), draw.getrandbits(64)) for _ in range(500)]
    signed = lambda x: int(np.uint64(x).view(np.int64))
    frame = spark.createDataFrame([(signed(x), signed(y)) for x, y in pairs], "x long, y long")
    rows = frame.select("x", "y", S.manhattan(S.counts_packed(S.F.col("x")), S.counts_packed(S.F.col("y"))).alias("d")).collect()
    for (x, y), row in zip(pairs, rows, strict=True):
        want = sum(abs((x >> 2 * s & 3).bit_count() - (y >> 2 * s & 3).bit_count()) for s in range(32))
        assert row.d == want <= (x ^ y).bit_count()


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 150), (7, 7), (None, 3), (300, 301), (301, 300)]
    found = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(61)} | {100: 100, 150: 100, 200: 100, 300: 300, 301: 300}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_first_of_each(spark):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(5, a, "p"), (3, a, "q"), (9, b, "r"), (9, b, "r"), (5, b, "s"), (None, a, "t"), (None, "z", "u"), (None, "z", "v"), (11, "only", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    kept = sorted(((r.doc_id or 0, r.text) for r in S.first_of_each(docs).collect()))
    assert kept == sorted([(0, "z"), (3, a), (5, b), (11, "only")])
    assert S.first_of_each(docs).columns == docs.columns
    assert S.first_of_each(docs.limit(0)).count() == 0 and S.near_duplicates(docs.limit(0)).count() == 0
