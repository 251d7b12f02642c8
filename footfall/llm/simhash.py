"""SimHash near-duplicates through the segment-popcount embedding.

A fingerprint is cut into 32 segments of two bits; the counts of set bits form a point whose
Manhattan distance to another point is never above the Hamming distance of the fingerprints. The
grid: segments are put into g blocks, and where the distance is at most d, at least g - d blocks
hold equal counts. Each choice of g - d blocks names one cell, so every link meets in a cell; there
the Manhattan distance prunes and the Hamming distance decides.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import ascii_words, cut, fresh, map_texts
from footfall.llm.components import connected

SEGMENTS = 32
#: Chance that two random two-bit segments hold equal counts.
EQUAL = 3 / 8
#: Expected candidates of a fingerprint above which more, finer cells are used.
CANDIDATES = 100
#: Fingerprints in a cell above which links are found through shared midpoints, not by pairs.
DENSE = 4096
PAIRS = 0x5555555555555555


def shingle_hashes(text: str, width: int, seed: int) -> np.ndarray:
    words = ascii_words(text)
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= width:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    return np.fromiter((xxhash.xxh64_intdigest(p, seed) for p in parts), np.uint64)


def fingerprint(text: str, width: int = 4, seed: int = 42) -> int:
    """64 bits, signed: a bit is set where over half of the shingle hashes have it; no words: 0."""
    hashes = shingle_hashes(text, width, seed)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, seed: int = 42) -> DataFrame:
    """(key, fp). Null texts count as empty; every row gives one row, whatever its key."""

    def make():
        return lambda texts: {"fp": [fingerprint(t, width, seed) for t in texts]}

    return map_texts(docs, text, make, "fp bigint", [key])


def grid(n: int, distance: int) -> list[int]:
    """Bit masks of the cells: the fewest blocks that keep the expected candidates low."""
    for blocks in range(distance + 1, 13):
        share = EQUAL ** (SEGMENTS * (blocks - distance) / blocks)
        if comb(blocks, distance) * n / 2 * share <= CANDIDATES:
            break
    edges = [round(SEGMENTS * i / blocks) for i in range(blocks + 1)]
    masks = [sum(3 << 2 * s for s in range(lo, hi)) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(masks, blocks - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def counts_packed(fp: Column) -> Column:
    """The counts of the 32 segments, two bits each."""
    high, low = F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(PAIRS)), fp.bitwiseAND(F.lit(PAIRS))
    return F.shiftleft(high.bitwiseAND(low), 1).bitwiseOR(high.bitwiseXOR(low))


def manhattan(a: Column, b: Column) -> Column:
    """Distance of two packed points: per segment |x - y| is 0, 1 or 2."""
    low, high = F.lit(PAIRS), F.lit(_signed(PAIRS << 1))
    # with x, y in {0, 1, 2}: both bits of x ^ y set means 1 against 2, so one; only the high bit, two
    diff = a.bitwiseXOR(b)
    ones, twos = diff.bitwiseAND(low), F.shiftrightunsigned(diff.bitwiseAND(high), 1)
    return F.bit_count(ones) + 2 * F.bit_count(twos.bitwiseAND(F.bitwise_not(ones)))


def _midpoints(dense: DataFrame, distance: int) -> DataFrame:
    """(hub, fp): all points within half the distance, flipping only bits that vary in dense cells.

    Two fingerprints within the distance share such a point, and two that share one are within it.
    """
    assert distance == 4

    def run(batches):
        for batch in batches:
            for fp, mask in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                bits = np.array([np.uint64(1) << np.uint64(i) for i in range(64) if mask >> i & 1], np.uint64)
                i, j = np.triu_indices(len(bits), 1)
                flips = np.concatenate([np.zeros(1, np.uint64), bits, bits[i] | bits[j]])
                hubs = (flips ^ np.int64(fp).view(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(hubs), pa.array(np.full(len(hubs), fp, np.int64))], ["hub", "fp"])

    return dense.select("fp", "mask").mapInArrow(run, "hub bigint, fp bigint")


def links(distinct: DataFrame, distance: int = 4, dense: int = DENSE) -> DataFrame:
    """(a, b): links between different fingerprints that connect all that lie within the distance.

    In cells of up to `dense` fingerprints all links come out; fuller cells, where pairs would grow
    with the square, give a star around each shared midpoint, which joins the same fingerprints.
    """
    masks = grid(distinct.count(), distance)
    packed = distinct.select("fp", counts_packed(F.col("fp")).alias("point"))
    cell = F.explode(
        F.array(*[F.struct(F.lit(i).alias("cell"), F.col("point").bitwiseAND(F.lit(_signed(m))).alias("at")) for i, m in enumerate(masks)])
    )
    cells = cut(packed.select("fp", "point", cell.alias("c")).select("c.cell", "c.at", "fp", "point"))
    full = cut(
        cells.groupBy("cell", "at")
        .agg(F.count(F.lit(1)).alias("n"), F.bit_or("fp").alias("any"), F.bit_and("fp").alias("all"))
        .where(F.col("n") > dense)
        .select("cell", "at", F.col("any").bitwiseAND(F.bitwise_not("all")).alias("mask"))
    )
    crowded = full.limit(1).count() > 0
    sparse = cells.join(full, ["cell", "at"], "left_anti") if crowded else cells
    x, y = sparse.alias("x"), sparse.alias("y")
    found = x.join(
        y,
        (F.col("x.cell") == F.col("y.cell"))
        & (F.col("x.at") == F.col("y.at"))
        & (F.col("x.fp") < F.col("y.fp"))
        & (manhattan(F.col("x.point"), F.col("y.point")) <= distance)
        & (F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= distance),
    ).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    if crowded:
        thick = cells.join(full, ["cell", "at"]).groupBy("fp").agg(F.bit_or("mask").alias("mask"))
        hubs = cut(_midpoints(thick, distance))
        centre = hubs.groupBy("hub").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
        found = found.union(hubs.join(centre, "hub").where("a <> fp").select("a", F.col("fp").alias("b")))
    return found.distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, seed: int = 42, distance: int = 4, dense: int = DENSE) -> DataFrame:
    """(key, fp, component): documents joined by chains of fingerprints within the distance.

    component is the least key of the chain. Texts without words share fingerprint 0. Repeated
    rows and copies have equal fingerprints, so they are linked before any pair is looked at. Rows
    with a null key are kept; their component is the least key that is not null, or null. An empty
    table gives an empty result.
    """
    marked = cut(fingerprints(docs, key, text, width, seed))
    distinct = cut(marked.groupBy("fp").agg(F.min(key).alias("least")))
    roots = connected(links(distinct, distance, dense)).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component"))
    labels = cut(rooted.join(named, "root").select("fp", "component"))
    return marked.join(labels, "fp", "left").select(key, "fp", "component")


def first_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row of each group of near-duplicates: the one with the least key.

    Rows whose key is null or not unique are told apart by their fingerprint, worked out again for
    these rows alone: of rows with equal key and fingerprint one stays, and where a group has only
    null keys one row per fingerprint stays. An empty table gives an empty one; columns of any name
    keep their value.
    """
    columns = docs.columns
    k, fp, group, at, searched = (fresh(docs, name) for name in ("key", "fp", "group", "at", "searched"))
    groups = near_duplicates(docs, key, text, **how)
    groups = cut(groups.select(F.col(key).alias(k), F.col("fp").alias(fp), F.col("component").alias(group)))
    odd = cut(groups.groupBy(k).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col(k).isNull()).select(k))
    gone = groups.where(F.col(k) != F.col(group)).select(k).union(odd).distinct()
    kept = docs.where(F.col(key).isNotNull()).join(gone, F.col(key) == F.col(k), "left_anti")
    if odd.limit(1).count():
        first = groups.where(F.col(k).eqNullSafe(F.col(group))).select(k, fp)
        rows = docs.join(odd, F.col(key).eqNullSafe(F.col(k)), "left_semi").withColumn(searched, F.col(text))
        width, seed = how.get("width", 4), how.get("seed", 42)
        marked = map_texts(rows, searched, lambda: lambda texts: {at: [fingerprint(t, width, seed) for t in texts]}, f"{at} bigint", columns)
        same = F.col(key).eqNullSafe(F.col(k)) & (F.col(at) == F.col(fp))
        kept = kept.unionByName(marked.join(first, same, "left_semi").dropDuplicates([key, at]).select(*columns))
    return kept


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
