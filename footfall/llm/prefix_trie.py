"""Z-fast trie over conversations: shared prefixes of turns, in tables that meet in equijoins.

A compacted node stands for the stretch of turns between two branching or ending points. It is
filed under its handle, the prefix whose length is the two-fattest number of that stretch, so that
fat binary search finds where a conversation leaves the trie in as many look-ups as its length
has bits. Conversations are inserted in batches: all that are left look for their exit at once,
edges are split where any of them leaves or ends, and of those that go on with the same turn one
becomes a leaf. At the end each edge is expanded into one node per turn.

A prefix is known by its depth and 128 bits: two XORs of hashes of (place, turn).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.functions.numbering import numbered
from footfall.llm.common import stored

#: Turns of one sequence whose XORs and sums run in one task; places that one row names when edges are expanded.
BLOCK = 4096
#: Members that one piece of a joined list names.
PIECE = 512


def turns_of(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(seq, pos, n, t1, t2, bytes): each conversation's turns in order, their 128-bit names and text lengths.

    Null turns come first; turns of equal number follow a hash of role and text, and repeated rows
    are turns of their own. A null role or text is empty. Rows without a conversation are left
    out. Other columns are not read.
    """
    who, what = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    rows = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("seq"),
        F.col(turn).alias("turn"),
        F.xxhash64(who, what).alias("t1"),
        F.xxhash64(F.lit("second"), what, F.octet_length(who), who).alias("t2"),
        F.octet_length(what).cast("long").alias("bytes"),
    )
    return numbered(rows, ["turn", "t1", "t2"], ["seq"], "pos", size="n").drop("turn")


def spliced(turns: DataFrame, step: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Turns and sequences (seq, length) where conversation c starts with the first h turns of c - c % step and goes on with its own after its first h.

    h is crc32 of c, modulo `most`. A first conversation with fewer turns gives all, an absent one none.
    """
    h = (F.crc32(F.col("seq").cast("string").cast("binary")) % most).alias("h")
    all_of = turns.where("pos = 0").select("seq", "n", (F.col("seq") - F.col("seq") % step).alias("base"), h)
    bases = all_of.where("seq = base").select("base", F.col("n").alias("base_n"))
    plan = stored(
        all_of.join(bases, "base", "left").select("seq", "base", "h", "n", F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken"))
    )
    name = ["t1", "t2", "bytes"]
    own = turns.join(plan.select("seq", "h", "taken"), "seq").where("pos >= h").select("seq", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), *name)
    heads = turns.where((F.col("pos") < most) & (F.col("seq") % step == 0)).select(F.col("seq").alias("base"), "pos", *name)
    given = plan.where("taken > 0").select("seq", "base", "taken").join(heads, "base").where("pos < taken").select("seq", "pos", *name)
    return own.union(given), plan.select("seq", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))


def prefixes(turns: DataFrame) -> DataFrame:
    """(seq, d, p1, p2, x1, x2, bytes, total): the name of each prefix of d turns, what its last turn adds to it, and text bytes so far."""
    x1, x2 = F.xxhash64("pos", "t1", "t2").alias("x1"), F.xxhash64("t2", "pos", "t1", F.lit("second")).alias("x2")
    rows = turns.select("seq", "pos", x1, x2, "bytes", F.floor(F.col("pos") / BLOCK).alias("block"))
    sums = {"p1": F.bit_xor("x1"), "p2": F.bit_xor("x2"), "total": F.sum("bytes")}
    blocks = rows.groupBy("seq", "block").agg(*[v.alias(k) for k, v in sums.items()])
    before = Window.partitionBy("seq").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    combined = {"p1": F.bit_xor("p1"), "p2": F.bit_xor("p2"), "total": F.sum("total")}
    blocks = blocks.select("seq", "block", *[F.coalesce(v.over(before), F.lit(0)).alias(f"b_{k}") for k, v in combined.items()])
    inside = Window.partitionBy("seq", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("*", *[v.over(inside).alias(k) for k, v in sums.items()]).join(blocks, ["seq", "block"])
    p1, p2 = (F.col(c).bitwiseXOR(F.col(f"b_{c}")).alias(c) for c in ("p1", "p2"))
    return rows.select("seq", (F.col("pos") + 1).alias("d"), p1, p2, "x1", "x2", "bytes", (F.col("total") + F.col("b_total")).alias("total"))


def two_fattest(a: Column, b: Column) -> Column:
    """The number in (a, b] with most trailing zero bits; null unless a < b."""
    top = F.length(F.bin(a.bitwiseXOR(b))) - 1
    return F.when(a < b, b.bitwiseAND(F.call_function("shiftleft", F.lit(-1).cast("long"), top)))


def _places(lo: Column, hi: Column) -> tuple[Column, Column]:
    """Two explodes, one after the other, that give all of lo..hi without a long array."""
    from_ = F.explode(F.sequence(lo, hi, F.lit(BLOCK).cast("long")))
    return from_, F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + BLOCK - 1, hi)))


def _expanded(df: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """One row per d in lo..hi; rows without any d go."""
    first, second = _places(F.col("_lo"), F.col("_hi"))
    held = df.withColumn("_lo", lo.cast("long")).withColumn("_hi", hi.cast("long")).where("_lo <= _hi")
    return held.withColumn("_from", first).withColumn("d", second).drop("_from", "_lo", "_hi")


NODE = ["to", "t1", "t2", "from", "f1", "f2", "rep"]


class Trie:
    """Compacted nodes (to, t1, t2, from, f1, f2, rep): the prefix that a node ends with, that of its parent, and a sequence that passes it."""

    def __init__(self, paths: DataFrame, sequences: DataFrame):
        """`paths`: stored `prefixes` of sequences that all differ; `sequences`: stored (seq, length, e1, e2)."""
        self.paths, self.sequences = paths, sequences
        longest = sequences.agg(F.max("length")).first()[0] or 0
        self.steps = int(longest).bit_length()
        self.nodes = self._insert()

    def _looked_up(self, df: DataFrame, seq: str, depth: Column, **names: str) -> DataFrame:
        """Adds columns of the prefix of `seq` at a depth; null where there is none."""
        p = self.paths.select(F.col("seq").alias("_seq"), F.col("d").alias("_d"), *[F.col(v).alias(k) for k, v in names.items()])
        df = df.withColumn("_at", depth)
        return df.join(p, (F.col(seq) == F.col("_seq")) & (F.col("_at") == F.col("_d")), "left").drop("_seq", "_d", "_at")

    def _filed(self, nodes: DataFrame) -> DataFrame:
        """New nodes with their handle (hd, h1, h2) and the prefix that leads into them (k1, k2)."""
        nodes = nodes.withColumn("hd", two_fattest(F.col("from"), F.col("to")))
        nodes = self._looked_up(nodes, "rep", F.col("hd"), h1="p1", h2="p2")
        return self._looked_up(nodes, "rep", F.col("from") + 1, k1="p1", k2="p2")

    def _exits(self, waiting: DataFrame, nodes: DataFrame) -> DataFrame:
        """For (seq, length, e1, e2, m, b1, b2), known to match a node at depth m: where it leaves the trie.

        (seq, length, e1, e2, m, edge columns g_*): the depth m of its last place in the trie, and
        the edge that m lies inside of, null where m is a node.
        """
        edges = [c for c in nodes.columns if c in NODE] + ["hd"]
        handles = nodes.select(*[F.col(c).alias(f"n_{c}") for c in edges], F.col("h1").alias("_h1"), F.col("h2").alias("_h2"))
        state = waiting.select("*", F.col("m").alias("lo"), F.col("length").alias("hi"), *[F.lit(None).cast("long").alias(f"c_{c}") for c in edges])
        for _ in range(self.steps):
            state = state.withColumn("f", two_fattest(F.col("lo"), F.col("hi")))
            state = self._looked_up(state, "seq", F.col("f"), q1="p1", q2="p2")
            hit = (F.col("f") == F.col("n_hd")) & (F.col("q1") == F.col("_h1")) & (F.col("q2") == F.col("_h2"))
            state = state.join(handles, hit, "left")
            found = F.col("n_hd").isNotNull()
            state = state.select(
                *waiting.columns,
                F.when(found, F.col("n_to")).otherwise(F.col("lo")).alias("lo"),
                F.when(found | F.col("f").isNull(), F.col("hi")).otherwise(F.col("f") - 1).alias("hi"),
                *[F.when(found, F.col(f"n_{c}")).otherwise(F.col(f"c_{c}")).alias(f"c_{c}") for c in edges],
            )
        # the last node found is matched as a whole, or the sequence leaves inside its edge
        state = state.withColumn("at", F.coalesce("c_to", "m"))
        state = self._looked_up(state, "seq", F.col("at") + 1, k1="p1", k2="p2", x1="x1", x2="x2")
        a1 = F.coalesce(F.col("k1").bitwiseXOR(F.col("x1")), F.when(F.col("length") == F.col("at"), F.col("e1")))
        a2 = F.coalesce(F.col("k2").bitwiseXOR(F.col("x2")), F.when(F.col("length") == F.col("at"), F.col("e2")))
        whole = F.col("c_to").isNull() | F.coalesce((a1 == F.col("c_t1")) & (a2 == F.col("c_t2")), F.lit(False))
        state = state.withColumn("whole", whole)
        children = nodes.select(*[F.col(c).alias(f"n_{c}") for c in edges], F.col("k1").alias("_k1"), F.col("k2").alias("_k2"))
        into = F.col("whole") & (F.col("at") == F.col("n_from")) & (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2"))
        state = state.join(children, into, "left")
        inside = ~F.col("whole") | F.col("n_to").isNotNull()
        edge = [F.when(~F.col("whole"), F.col(f"c_{c}")).otherwise(F.col(f"n_{c}")).alias(f"g_{c}") for c in NODE]
        known = F.when(~F.col("whole"), F.col("c_hd")).when(inside, F.col("n_from") + 1).otherwise(F.col("at"))
        state = stored(state.select("seq", "length", "e1", "e2", *edge, known.alias("known")))
        # how far the turns of the edge go on to agree
        on_edge = _expanded(state.where("g_to is not null"), F.col("known") + 1, F.least("length", F.col("g_to") - 1))
        on_edge = self._looked_up(on_edge.select("seq", "g_rep", "d"), "seq", F.col("d"), q1="p1", q2="p2")
        p = self.paths.select(F.col("seq").alias("_seq"), F.col("d").alias("_d"), "p1", "p2")
        agrees = (F.col("g_rep") == F.col("_seq")) & (F.col("d") == F.col("_d")) & (F.col("q1") == F.col("p1")) & (F.col("q2") == F.col("p2"))
        agreed = on_edge.join(p, agrees).groupBy("seq").agg(F.max("d").alias("deepest"))
        return state.join(agreed, "seq", "left").withColumn("m", F.coalesce("deepest", "known")).drop("deepest", "known")

    def _insert(self) -> DataFrame:
        left = self.sequences.where("length > 0").select("seq", "length", "e1", "e2", *[F.lit(0).cast("long").alias(c) for c in ("m", "b1", "b2")])
        nodes = None
        while left.limit(1).count():
            if nodes is None:
                exits = left.select("seq", "length", "e1", "e2", "m", *[F.lit(None).cast("long").alias(f"g_{c}") for c in NODE])
            else:
                exits = self._exits(left, nodes)
            exits = self._looked_up(exits, "seq", F.col("m") + 1, k1="p1", k2="p2", x1="x1", x2="x2")
            ends = F.col("length") == F.col("m")
            b1, b2 = (F.when(ends, F.col(f"e{i}")).otherwise(F.col(f"k{i}").bitwiseXOR(F.col(f"x{i}"))).alias(f"b{i}") for i in (1, 2))
            exits = stored(exits.select("seq", "length", "e1", "e2", "m", b1, b2, "k1", "k2", *[f"g_{c}" for c in NODE]))

            going = exits.where("length > m")
            first = F.min_by(F.struct("seq", "length", "e1", "e2", "m", "b1", "b2"), F.struct(F.xxhash64("seq"), F.col("seq")))
            leaves = going.groupBy(F.col("m").alias("_m"), "k1", "k2").agg(first.alias("s"))
            new = leaves.select(*[F.col(f"s.{c}").alias(n) for c, n in zip(["length", "e1", "e2", "m", "b1", "b2", "seq"], NODE, strict=True)])
            if nodes is not None:
                cuts = exits.where("g_to is not null").select(*[f"g_{c}" for c in NODE], F.col("m").alias("to"), F.col("b1").alias("t1"), F.col("b2").alias("t2")).distinct()
                split = cuts.select(*[F.col(f"g_{c}").alias(c) for c in ("to", "t1", "t2")]).distinct()
                last = cuts.select(*[F.col(f"g_{c}") for c in NODE], *[F.col(f"g_{c}").alias(c) for c in ("to", "t1", "t2")]).distinct()
                edge = Window.partitionBy("g_to", "g_t1", "g_t2").orderBy("to")
                above = [F.coalesce(F.lag(c).over(edge), F.col(f"g_{f}")).alias(f) for c, f in (("to", "from"), ("t1", "f1"), ("t2", "f2"))]
                parts = cuts.unionByName(last).select("to", "t1", "t2", *above, F.col("g_rep").alias("rep"))
                nodes = stored(nodes.join(split, ["to", "t1", "t2"], "left_anti").unionByName(self._filed(parts.unionByName(new))))
            else:
                nodes = stored(self._filed(new))
            placed = new.select(F.col("rep").alias("seq"))
            left = stored(going.join(placed, "seq", "left_anti").select("seq", "length", "e1", "e2", "m", "b1", "b2"))
        empty = self.sequences.limit(0).select(*[F.lit(0).cast("long").alias(c) for c in NODE])
        return empty if nodes is None else nodes.select(*NODE)


def _summed(nodes: DataFrame) -> DataFrame:
    """(id, n, least, leaves, weight, below): sums over all nodes of the subtree, in as many rounds as its height has bits.

    In round k a node has the sums of its descendants at distances under 2^k and knows its
    ancestor at distance 2^k, to which it gives them.
    """
    sums = {"n": F.sum, "least": F.min, "leaves": F.sum, "weight": F.sum, "below": F.sum}
    now = stored(nodes.select("id", "anc", "n", "least", "leaves", "weight", "below"))
    while now.where("anc is not null").limit(1).count():
        given = now.where("anc is not null").groupBy(F.col("anc").alias("id")).agg(*[f(c).alias(f"g_{c}") for c, f in sums.items()])
        further = now.where("anc is not null").select(F.col("id").alias("anc"), F.col("anc").alias("next"))
        more = [(F.least(c, f"g_{c}") if f is F.min else F.col(c) + F.coalesce(f"g_{c}", F.lit(0))).alias(c) for c, f in sums.items()]
        grown = now.join(given, "id", "left").select("id", "anc", *more).join(further, "anc", "left")
        now = stored(grown.select("id", F.col("next").alias("anc"), *sums))
    return now.drop("anc")


def joined_members(members: DataFrame, key: list[str], member: str) -> DataFrame:
    """(key, sha256): digest of each group's members in ascending order, comma-joined.

    Lists are joined in pieces of a few hundred members wherever these lie; the pieces of a group
    pass one task in order, which keeps the state of the hash only.
    """
    placed = numbered(members.select(*key, member), [member], key, "_i")
    pieces = placed.groupBy(*key, F.floor(F.col("_i") / PIECE).alias("_piece")).agg(F.array_join(F.sort_array(F.collect_list(member)).cast("array<string>"), ",").alias("_list"))
    ordered = pieces.repartition(*key).sortWithinPartitions(*key, "_piece")
    schema = members.select(*key).schema.add("sha256", "string")
    width = len(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            done = []
            for *group, _, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is not None and group == last:
                    state.update(b",")
                else:
                    if state is not None:
                        done.append((*last, state.hexdigest()))
                    last, state = group, hashlib.sha256()
                state.update(text.encode())
            if done:
                yield rows(done)
        if state is not None:
            yield rows([(*last, state.hexdigest())])

    def rows(done: list[tuple]) -> pa.RecordBatch:
        names = [*key, "sha256"]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == width else pa.int64()) for i, c in enumerate(zip(*done, strict=True))], names)

    return ordered.mapInArrow(run, schema)


def prefix_nodes(turns: DataFrame, sequences: DataFrame) -> DataFrame:
    """One row per distinct prefix of the sequences: (seq, depth, parent, n_seqs, n_children, n_leaves, saved_bytes, ends_sha256).

    `turns` has (seq, pos, t1, t2, bytes) with pos from 0 without gaps, `sequences` (seq, length),
    empty ones included; keys are whole numbers. seq and parent name a node by its least sequence,
    n_leaves counts childless nodes at or below it, saved_bytes what its subtree saves by keeping
    each prefix once, and ends_sha256 is taken over the sequences that end in it. Without sequences
    there are no rows; with any, the root (depth 0) is one of them.
    """
    every = stored(prefixes(turns))
    last = every.select("seq", F.col("d").alias("length"), F.col("p1").alias("e1"), F.col("p2").alias("e2"), "total")
    zero = {c: F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("e1", "e2", "total")}
    ends = stored(sequences.join(last, ["seq", "length"], "left").select("seq", "length", *zero.values()))
    name = ["length", "e1", "e2"]
    distinct = stored(ends.groupBy(*name).agg(F.min("seq").alias("seq"), F.count(F.lit(1)).alias("n"), F.max("total").alias("total")))
    paths = stored(every.join(distinct.select("seq"), "seq", "left_semi"))
    trie = Trie(paths, distinct.select("seq", *name))

    root = distinct.limit(1).select(*[F.lit(0).cast("long").alias(c) for c in ("to", "t1", "t2")], *[F.lit(None).cast("long").alias(c) for c in ("from", "f1", "f2", "rep")])
    node, up = F.struct("to", "t1", "t2"), F.when(F.col("from").isNotNull(), F.struct(F.col("from").alias("to"), F.col("f1").alias("t1"), F.col("f2").alias("t2")))
    nodes = trie.nodes.unionByName(root).withColumn("id", node).withColumn("anc", up)
    children = nodes.where("anc is not null").groupBy(F.col("anc").alias("id")).agg(F.count(F.lit(1)).alias("children"))
    here = distinct.select(F.struct(F.col("length").alias("to"), F.col("e1").alias("t1"), F.col("e2").alias("t2")).alias("id"), "n", F.col("seq").alias("least"), "total")
    nodes = nodes.join(children, "id", "left").join(here, "id", "left")
    nodes = trie._looked_up(nodes, "rep", F.col("to"), at_end="total")
    nodes = trie._looked_up(nodes, "rep", F.col("from"), at_start="total")
    n, total, at_end, at_start, children = (F.coalesce(F.col(c), F.lit(0)) for c in ("n", "total", "at_end", "at_start", "children"))
    nodes = stored(
        nodes.select(
            *["id", "anc", "to", "from", "rep", "least"],
            n.alias("n"),
            (children == 0).cast("long").alias("leaves"),
            (n * total).alias("weight"),
            (at_end - at_start).alias("below"),
            at_end.alias("at_end"),
            children.alias("children"),
        )
    )
    sums = stored(_summed(nodes))
    held = nodes.select("id", "anc", "to", "from", "rep", "at_end", "children", F.col("below").alias("own")).join(sums, "id")
    # under its end: what all members read from there on, less each edge once
    under = F.col("weight") - F.col("n") * F.col("at_end") - (F.col("below") - F.col("own"))
    parents = sums.select(F.col("id").alias("anc"), F.col("least").alias("above"))
    held = held.select("id", "anc", "to", "from", "rep", "at_end", "children", "n", "least", "leaves", under.alias("under")).join(parents, "anc", "left")
    held = stored(held)

    places = trie._looked_up(_expanded(held.where("rep is not null"), F.col("from") + 1, F.col("to")), "rep", F.col("d"), bytes="bytes", total="total")
    at_node = F.col("d") == F.col("to")
    made = places.select(
        F.col("least").alias("seq"),
        F.col("d").alias("depth"),
        F.when(F.col("d") == F.col("from") + 1, F.col("above")).otherwise(F.col("least")).alias("parent"),
        F.col("n").alias("n_seqs"),
        F.when(at_node, F.col("children")).otherwise(F.lit(1)).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("under") + (F.col("n") - 1) * (F.col("at_end") - F.col("total") + F.col("bytes"))).alias("saved_bytes"),
        F.when(at_node, F.col("id")).alias("id"),
    )
    top = held.where("rep is null").select(F.col("least").alias("seq"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent"), F.col("n").alias("n_seqs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("under").alias("saved_bytes"), "id")
    made = made.unionByName(top)

    # digests of who ends where: alone, or among copies
    alone = distinct.where("n = 1").select(*name, F.sha2(F.col("seq").cast("string").cast("binary"), 256).alias("sha256"))
    crowds = distinct.where("n > 1").select(*name)
    crowd = joined_members(ends.join(crowds, name, "left_semi"), name, "seq")
    told = alone.unionByName(crowd).select(F.struct(F.col("length").alias("to"), F.col("e1").alias("t1"), F.col("e2").alias("t2")).alias("id"), "sha256")
    nobody = F.sha2(F.lit(b""), 256)
    return made.join(told, "id", "left").withColumn("ends_sha256", F.coalesce("sha256", nobody)).drop("id", "sha256")
