"""What the numpy text models share: hashed word features, training on all rows, optimizers."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import shared_folder

#: Of `labelled_sample` alone, which no model is fitted on: documents per class, and the longest text.
SAMPLE_PER_CLASS = 2000
SAMPLE_CHARS = 20_000
#: Characters (and the least a row counts for) that one task trains on before the models of all tasks
#: are averaged, and the most tasks at a time.
PART_CHARS, ROW_CHARS, PARTS = 8_000_000, 200, 128
#: Numbers of a model that travel in one row.
BLOCK = 1 << 16
#: Words whose features a task remembers before it starts anew.
REMEMBERED = 120_000


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, allowed, key: str = "doc_id", text: str = "text", per_class: int = SAMPLE_PER_CLASS, extra: tuple[str, ...] = ()
) -> list[tuple]:
    """(text, label, *extra) of at most `per_class` labelled documents of each class.

    `allowed` is a condition on the key. Keys are drawn from the label table alone; the documents
    are then read once and joined with these few thousand keys. Null keys, texts and labels do not
    take part; a document that is there twice is used twice; texts over SAMPLE_CHARS are left out
    of the fit (not of the scores).
    """
    rows = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & allowed).select(key, F.col(label).cast("int").alias("_label"))
    order = [F.xxhash64(key, "_label"), F.col(key)]
    chosen = rows.where("_label = 0").orderBy(*order).limit(per_class).union(rows.where("_label = 1").orderBy(*order).limit(per_class))
    held = docs.select(key, text, *extra).where(F.length(text) <= SAMPLE_CHARS)
    found = held.join(F.broadcast(chosen), key).select(key, text, "_label", *extra).collect()
    return [tuple(r)[1:] for r in sorted(found, key=lambda r: (crc32(str(r[0]).encode()), r[1], r[2]))]


def labelled(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, key: str = "doc_id", text: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """(_order, text, _label, *extra) of all labelled documents whose key is allowed.

    Null keys, texts and labels do not take part; a document or label that is there twice is used twice.
    """
    marks = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & allowed).select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label"))
    held = docs.where(F.col(text).isNotNull() & allowed)
    joined = held.hint("shuffle_merge").join(marks, F.col(key) == F.col("_key"))
    return joined.select(F.xxhash64(key, text).alias("_order"), F.col(text).alias("text"), "_label", *[F.col(c).alias(c) for c in extra])


def fit_all(rows: DataFrame, model, rate: float, train: Callable, passes: int) -> int:
    """Train `model.p` on every row, in place; how many rows there are.

    rows: _order (a hash that deals the rows out and orders them), text, and what `train` reads; a
    stored table. They are dealt into turns of at most PARTS parts of some PART_CHARS characters each. In a turn
    each part takes its own steps from the same model, by `train(model, adagrad, table, epochs, seed)`,
    and every number becomes the mean of the parts that moved it; the sums of Spark's tasks come to
    the driver as one model. Rows that make a single part are gone through `passes` times by one
    task, else there are `again` rounds over all turns.
    """
    size = F.greatest(F.length("text"), F.lit(ROW_CHARS))
    chars, n = rows.agg(F.sum(size.cast("long")), F.count(F.lit(1))).first()
    if not n:
        return 0
    pieces = -(-chars // PART_CHARS)
    turns = -(-pieces // PARTS)
    parts = -(-pieces // turns)
    deal = F.pmod("_order", F.lit(parts * turns))
    dealt = rows.withColumn("_part", (deal % parts).cast("int")).withColumn("_turn", F.floor(deal / parts).cast("int"))
    if turns > 1:  # a folder per turn, so that each reads its own rows only
        place = f"{shared_folder(rows.sparkSession)}/footfall-turns-{uuid.uuid4().hex}"
        dealt.write.partitionBy("_turn").parquet(place)
        dealt = rows.sparkSession.read.schema(dealt.schema).parquet(place)
    adagrad = Adagrad(model.p, rate)
    _averaged(dealt.where("_turn = 0 and _part = 0").drop("_turn"), model, adagrad, rate, train, passes, 0)
    for turn in range(turns if pieces > 1 else 0):
        _averaged(dealt.where(F.col("_turn") == turn).drop("_turn"), model, adagrad, rate, train, 1, turn + 1)
    return n


def _flat(arrays: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([a.ravel() for a in arrays.values()]).astype(np.float32)


def _averaged(rows: DataFrame, model, adagrad: Adagrad, rate: float, train: Callable, epochs: int, seed: int) -> None:
    """One turn: all parts train from this model; each number and its sum become the mean over the parts that moved it."""
    shared = rows.sparkSession.sparkContext.broadcast((model, adagrad.sums))

    def work(key, table):
        from copy import deepcopy

        model, sums = deepcopy(shared.value)
        own = Adagrad(model.p, rate)
        own.sums = sums
        before, seen = _flat(model.p), _flat(sums)
        train(model, own, table.sort_by("_order"), epochs, seed * PARTS + key[0].as_py())
        moved, grown = _flat(model.p) - before, _flat(sums) - seen
        out = []
        for at in range(0, len(moved), BLOCK):
            where = np.flatnonzero(grown[at : at + BLOCK]).astype(np.int32)
            if len(where):
                out.append((at // BLOCK, where.tobytes(), moved[at + where].tobytes(), grown[at + where].tobytes()))
        return pa.Table.from_pydict(dict(zip(_BLOCK.names, zip(*out, strict=True), strict=True)) if out else {n: [] for n in _BLOCK.names}, _BLOCK)

    def mean(key, table):
        moved, grown, times = np.zeros(BLOCK), np.zeros(BLOCK), np.zeros(BLOCK)
        added = []
        for at, m, g in zip(table.column("at"), table.column("moved"), table.column("grown"), strict=True):
            added.append((np.frombuffer(at.as_buffer(), np.int32), np.frombuffer(m.as_buffer(), np.float32), np.frombuffer(g.as_buffer(), np.float32)))
        added.sort(key=lambda x: (x[1].tobytes(), x[2].tobytes()))  # sums do not depend on the order of the shuffle
        for at, m, g in added:
            moved[at] += m
            grown[at] += g
            times[at] += 1
        where = np.flatnonzero(times).astype(np.int32)
        row = (key[0].as_py(), where.tobytes(), *((x[where] / times[where]).astype(np.float32).tobytes() for x in (moved, grown)))
        return pa.Table.from_pydict(dict(zip(_BLOCK.names, [[x] for x in row], strict=True)), _BLOCK)

    schema = "block int, at binary, moved binary, grown binary"
    means = rows.groupBy("_part").applyInArrow(work, schema).groupBy("block").applyInArrow(mean, schema).collect()  # one model
    for arrays, column in ((model.p, "moved"), (adagrad.sums, "grown")):
        flat = _flat(arrays)
        for row in means:
            flat[row.block * BLOCK + np.frombuffer(row.at, np.int32)] += np.frombuffer(row[column], np.float32)
        at = 0
        for a in arrays.values():
            a[...] = flat[at : at + a.size].reshape(a.shape)
            at += a.size
    shared.unpersist()


_BLOCK = pa.schema([("block", pa.int32()), ("at", pa.binary()), ("moved", pa.binary()), ("grown", pa.binary())])


def class_weights(n0: int, n1: int) -> tuple[float, float]:
    """Weights of rows of label 0 and 1 that make both classes count the same."""
    return 0.5 / max(1, n0) * (n0 + n1), 0.5 / max(1, n1) * (n0 + n1)


def batches(order: np.ndarray, sizes: np.ndarray, rows: int, chars: int) -> list[np.ndarray]:
    """`order` cut into batches of at most `rows` rows and some `chars` characters, a longer text alone."""
    out, first, held = [], 0, 0
    for i, size in enumerate(sizes[order].tolist()):
        if i > first and (i - first >= rows or held + size > chars):
            out.append(order[first:i])
            first, held = i, 0
        held += size
    return [*out, order[first:]] if len(order) else out


class Words:
    """Rows of bucket numbers for words, remembered up to a bound; row 0 is padding."""

    def __init__(self, buckets: Callable[[str], list[int]], width: int, limit: int = REMEMBERED):
        self.buckets, self.width, self.limit = buckets, width, limit
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.made: list[list[int]] = [[0] * self.width]

    def ids(self, texts: list[list[str]], pad: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of all words with `pad` padding rows behind each text, and where each text starts."""
        if len(self.made) > self.limit:
            self.clear()
        rows, made = self.rows, self.made
        out, starts, empty = [], [], [0] * pad
        for words in texts:
            starts.append(len(out))
            try:
                out += [rows[w] for w in words]
            except KeyError:
                for w in words:
                    at = rows.get(w)
                    if at is None:
                        at = rows[w] = len(made)
                        made.append(self.buckets(w))
                    out.append(at)
            out += empty
        return np.array(out, np.int64), np.array(starts, np.int64)


class Adagrad:
    def __init__(self, parameters: dict[str, np.ndarray], rate: float):
        self.parameters, self.rate = parameters, rate
        self.sums = {k: np.full_like(v, 1e-3) for k, v in parameters.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        for k, g in grads.items():
            self.sums[k] += g * g
            self.parameters[k] -= self.rate * g / np.sqrt(self.sums[k])

    def rows(self, name: str, at: np.ndarray, grads: np.ndarray) -> None:
        """Step of some rows of a table; repeated rows add up."""
        self.rows_of(at, {name: grads})

    def rows_of(self, at: np.ndarray, grads: dict[str, np.ndarray]) -> None:
        """Step of the same rows of several tables, which are put in order once."""
        if not len(at):
            return
        if all(len(self.parameters[name]) <= 1 << 15 for name in grads):
            at = at.astype(np.int16)  # numpy sorts these by digits
        order = np.argsort(at, kind="stable")
        sorted_at = at[order]
        first = np.flatnonzero(np.concatenate([[True], sorted_at[1:] != sorted_at[:-1]]))
        where = sorted_at[first].astype(np.int64)
        for name, g in grads.items():
            total = np.add.reduceat(g[order], first, axis=0)
            sums = self.sums[name][where] + total * total
            self.sums[name][where] = sums
            self.parameters[name][where] -= self.rate * total / np.sqrt(sums)


    def rows_side_by_side(self, names: list[str], at: np.ndarray, grads: np.ndarray) -> None:
        """Step of the same rows of several float32 tables; grads: their columns behind each other, an even number."""
        if not len(at):
            return
        if all(len(self.parameters[name]) <= 1 << 15 for name in names):
            at = at.astype(np.int16)  # numpy sorts these by digits
        order = np.argsort(at, kind="stable")
        sorted_at = at[order]
        first = np.flatnonzero(np.concatenate([[True], sorted_at[1:] != sorted_at[:-1]]))
        where = sorted_at[first].astype(np.int64)
        total = sums_of_runs(grads.take(order, axis=0), first)
        begin = 0
        for name in names:
            g = total[:, begin : (begin := begin + self.parameters[name].shape[1])]
            sums = self.sums[name].take(where, axis=0)
            sums += g * g
            self.sums[name][where] = sums
            self.parameters[name][where] -= self.rate * g / np.sqrt(sums)


def sums_of_runs(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the float32 rows from each of `first` up to the next; pairs of columns are added as one complex number."""
    return np.add.reduceat(rows.view(np.complex64), first, axis=0).view(np.float32)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
