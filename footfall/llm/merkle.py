"""Merkle manifest of a dataset: a hash tree per group of rows, and one over the groups' roots.

Level by level every node asks for its siblings by their computed indices (its own run of
`fanout` places, shifted by each slot offset) in one equijoin; the answers give the parts of the
proof left and right of the node, and the nodes of slot zero hash themselves and their answers
into the parents. A level is `fanout` times smaller than the one below, whatever the groups' sizes.
Digests travel as 32 bytes and are hashed as lowercase hex.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.numbering import numbered
from footfall.llm.common import stored

#: One step of a proof: the digests before and after the node in its run, joined.
STEP = "array<struct<left: binary, right: binary>>"


def spelled(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def hashed(*parts: Column) -> Column:
    """SHA-256 of digests, joined as lowercase hex."""
    return F.unhex(F.sha2(F.concat(*map(spelled, parts)).cast("binary"), 256))


def leaf(*columns: Column) -> Column:
    """Digest of a row: each value as its UTF-8 byte count, a colon and itself, or `-` for a null."""
    texts = [c.cast("string") for c in columns]
    fields = [F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.unhex(F.sha2(F.concat(*fields).cast("binary"), 256))


def tree_key(group: Column) -> Column:
    """A text that is never null, in the order: null, then the group's UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


@dataclass(frozen=True)
class Trees:
    """All levels of a set of trees: (tree, idx, n, digest, left, right), leaves first; and (tree, digest) of their roots."""

    levels: list[DataFrame]
    roots: DataFrame
    fanout: int


def _answered(nodes: DataFrame, fanout: int) -> DataFrame:
    """The nodes with the joined digests of their siblings before and after them."""
    live = nodes.where("n > 1")
    slot, first = F.col("idx") % fanout, F.col("idx") - F.col("idx") % fanout
    offset = F.explode(F.array(*[F.lit(k) for k in range(1, fanout)])).alias("offset")
    asked = live.select("tree", F.col("idx").alias("asker"), "n", slot.alias("slot"), first.alias("first"), offset)
    asked = asked.select("tree", "asker", "n", (F.col("first") + (F.col("slot") + F.col("offset")) % fanout).alias("idx"))
    answers = asked.where("idx < n").drop("n").join(live.select("tree", "idx", "digest"), ["tree", "idx"])
    told = answers.groupBy("tree", "asker").agg(F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("told"))

    def joined(side) -> Column:
        part = F.transform(F.filter("told", side), lambda x: F.hex(x["digest"]))
        return F.coalesce(F.unhex(F.array_join(part, "")), F.lit(b""))

    with_told = nodes.join(told.withColumnRenamed("asker", "idx"), ["tree", "idx"], "left")
    left, right = joined(lambda x: x["idx"] < F.col("idx")), joined(lambda x: x["idx"] > F.col("idx"))
    return with_told.select("tree", "idx", "n", "digest", left.alias("left"), right.alias("right"))


def grow(nodes: DataFrame, fanout: int = 8) -> Trees:
    """Trees over stored leaves (tree, idx, n, digest): idx counts from 0 to n - 1 in each tree.

    Runs of `fanout` nodes become their parent until one node is left; a run may be a single
    node, which is hashed as well. The number of levels follows from the largest n.
    """
    levels, most = [], nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        level = stored(_answered(nodes, fanout))
        levels.append(level)
        parent = F.when(F.col("n") == 1, F.col("digest")).otherwise(hashed(F.col("digest"), F.col("right")))
        up = F.ceil(F.col("n") / fanout)
        nodes = level.where(F.col("idx") % fanout == 0).select("tree", F.floor(F.col("idx") / fanout).alias("idx"), up.alias("n"), parent.alias("digest"))
        most = -(-most // fanout)
    return Trees(levels, nodes.select("tree", "digest"), fanout)


def paths(trees: Trees, roots: DataFrame) -> DataFrame:
    """(tree, idx, carried columns, path) of every leaf: its steps, and after them the path of its tree's row in `roots`.

    `roots` has (tree, path) and columns that all leaves of the tree get.
    """
    above = roots.withColumn("idx", F.lit(0).cast("long"))
    carried = [c for c in roots.columns if c not in ("tree", "path")]
    for level in reversed(trees.levels):
        own = F.when(F.col("n") > 1, F.array(F.struct("left", "right"))).otherwise(F.expr(f"cast(array() as {STEP})"))
        node = level.select("tree", "idx", own.alias("own"), F.floor(F.col("idx") / trees.fanout).alias("up")).alias("n")
        on = (F.col("n.tree") == F.col("a.tree")) & (F.col("n.up") == F.col("a.idx"))
        path = F.concat("n.own", "a.path").alias("path")
        above = node.join(above.alias("a"), on).select("n.tree", "n.idx", *[f"a.{c}" for c in carried], path)
    return above


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(path, digest, lambda node, step: hashed(step["left"], node, step["right"]))


def proof(path: Column) -> Column:
    """Digest of all siblings of a path, joined from the leaf's run up to the root's."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(spelled(s["left"]), spelled(s["right"]))), "").cast("binary"), 256)


@dataclass(frozen=True)
class Manifest:
    """rows: the given columns with tree, idx, n; trees per group; the tree over their roots; the root itself (None: no rows)."""

    rows: DataFrame
    groups: Trees
    top: Trees
    subroots: DataFrame
    root: bytes | None

    def nodes(self) -> DataFrame:
        """(tree, level, idx, digest) of all nodes of the group trees, leaves at level 0."""
        parts = [lv.select("tree", F.lit(i).alias("level"), "idx", "digest") for i, lv in enumerate(self.groups.levels)]
        roots = self.groups.roots.select("tree", F.lit(len(parts)).alias("level"), F.lit(0).cast("long").alias("idx"), "digest")
        return reduce(DataFrame.union, [*parts, roots])

    def proofs(self) -> DataFrame:
        """The rows with subroot and path, from their own run up to the root."""
        top = paths(self.top, self.top.roots.select("tree", F.expr(f"cast(array() as {STEP})").alias("path")))
        named = self.subroots.select(F.col("tree").alias("group"), "idx", F.col("digest").alias("subroot"))
        roots = named.join(top.select("idx", "path"), "idx").select(F.col("group").alias("tree"), "subroot", "path")
        return self.rows.join(paths(self.groups, roots), ["tree", "idx"])


def manifest(rows: DataFrame, key: str, group: str, digest: str = "leaf", fanout: int = 8) -> Manifest:
    """The manifest of rows that have a key, a group and a digest (32 bytes, see `leaf`).

    Within a group rows ascend by key, then digest, nulls first; equal rows are leaves of their
    own. A null group is a group, before all others. The groups' roots, in the UTF-8 order of the
    groups, are the leaves of the top tree. No rows: no nodes and root None. The rows may have any
    further columns but tree, idx and n.
    """
    held = rows.withColumn("tree", tree_key(F.col(group)))
    held = stored(numbered(held, [key, digest], ["tree"], "idx", size="n"))
    groups = grow(held.select("tree", "idx", "n", F.col(digest).alias("digest")), fanout)
    subroots = stored(numbered(groups.roots.withColumn("all", F.lit(0)), ["tree"], ["all"], "idx", size="n").drop("all"))
    top = grow(subroots.select(F.lit("").alias("tree"), "idx", "n", "digest"), fanout)
    root = top.roots.first()
    return Manifest(held, groups, top, subroots, bytes(root.digest) if root else None)
