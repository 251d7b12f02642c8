"""Quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded from the mean of its words' hashed
embeddings and from what its words say together (repeats, variety); only documents have labels.
Gated attention weighs the passages, and the weighted sum of their encodings gives the score.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from footfall.llm.common import STEP_CHARS, map_texts, stored
from footfall.llm.nets import Adagrad, Words, batches, class_weights, fit_all, labelled, sigmoid

BUCKETS, SIZE, STATS, HIDDEN, GATE = 1 << 14, 12, 4, 16, 12
#: Words of a passage; the last one of a text may be shorter.
PASSAGE = 48
#: Longer words are cut into pieces of this many characters, each a word of the passage.
PIECE = 64
EPOCHS, BATCH, RATE = 8, 64, 0.05


def buckets(word: str) -> list[int]:
    """Hashes of a word's shape, of its signs, of its length and of its end."""
    cased = "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in word)
    shape = re.sub(r"(.)\1+", r"\1\1", cased)
    signs = "".join(c for c in word if not c.isalnum())
    parts = ("s" + shape, "g" + signs, f"n{min(len(word), 30)}", "e" + word[-3:].lower())
    return [crc32(p.encode("utf-8", "surrogatepass")) & (BUCKETS - 1) for p in parts]


def pieces(text: str) -> list[str]:
    """The words of a text; a long one in consecutive pieces, so that every character of it is read."""
    words = text.split()
    if max(map(len, words), default=0) <= PIECE:
        return words
    return [w[a : a + PIECE] for w in words for a in range(0, len(w), PIECE)]


class Bags:
    """Word rows of some texts, cut into passages; a text without words is one empty passage."""

    def __init__(self, words: Words, texts: list[str]):
        split = [pieces(t) for t in texts]
        self.ids, starts = words.ids(split, 1)  # one padding word ends each text and is part of its last passage
        sizes = np.diff(np.append(starts, len(self.ids)))
        per_text = -(-sizes // PASSAGE)
        self.first = np.cumsum(per_text) - per_text
        self.bag = np.repeat(np.arange(len(texts)), per_text)
        inside = np.arange(per_text.sum()) - np.repeat(self.first, per_text)
        self.starts = np.repeat(starts, per_text) + inside * PASSAGE
        self.sizes = np.diff(np.append(self.starts, len(self.ids)))
        self.stats = self._stats()

    def _stats(self) -> np.ndarray:
        passage = np.repeat(np.arange(len(self.starts)), self.sizes)
        same = np.zeros(len(self.ids), bool)
        same[1:] = (self.ids[1:] == self.ids[:-1]) & (passage[1:] == passage[:-1])
        key = np.sort(passage * (self.ids.max() + 1) + self.ids)
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        distinct = np.add.reduceat(first.astype(np.float32), self.starts)
        repeats = np.add.reduceat(same.astype(np.float32), self.starts)
        n = self.sizes.astype(np.float32)
        return np.stack([distinct / n, repeats / n, np.log1p(n) / 4, n < 8], 1).astype(np.float32)


class Model:
    def __init__(self, seed: int = 0):
        draw = np.random.default_rng(seed)

        def table(*shape: int) -> np.ndarray:
            return (draw.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        self.p = {
            "embedding": (draw.standard_normal((BUCKETS, SIZE)) * 0.1).astype(np.float32),
            "encode": table(SIZE + STATS, HIDDEN), "encode_0": np.zeros(HIDDEN, np.float32),
            "see": table(HIDDEN, GATE), "gate": table(HIDDEN, GATE), "weigh": table(GATE, 1)[:, 0],
            "out": table(HIDDEN, 1)[:, 0], "base": np.zeros(1, np.float32),
        }

    def words(self, rows: np.ndarray) -> np.ndarray:
        return self.p["embedding"][rows].sum(1)

    def forward(self, table: np.ndarray, bags: Bags) -> dict[str, np.ndarray]:
        p = self.p
        mean = np.add.reduceat(table[bags.ids], bags.starts, axis=0) / bags.sizes[:, None].astype(np.float32)
        x = np.concatenate([mean, bags.stats], 1)
        h = np.tanh(x @ p["encode"] + p["encode_0"])
        see, gate = np.tanh(h @ p["see"]), sigmoid(h @ p["gate"])
        e = (see * gate) @ p["weigh"]
        e = np.exp(e - np.maximum.reduceat(e, bags.first)[bags.bag])
        attention = e / np.add.reduceat(e, bags.first)[bags.bag]
        z = np.add.reduceat(h * attention[:, None], bags.first, axis=0)
        return {"x": x, "h": h, "see": see, "gate": gate, "attention": attention, "z": z, "logit": z @ p["out"] + p["base"][0]}

    def step(self, adagrad: Adagrad, bags: Bags, rows: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> None:
        """One step of the weighted log loss, back through the attention to the embeddings."""
        p = self.p
        used, local = np.unique(bags.ids, return_inverse=True)
        whole, bags.ids = bags.ids, local
        table = self.words(rows[used])
        table[used == 0] = 0
        f = self.forward(table, bags)
        bags.ids = whole
        error = ((sigmoid(f["logit"]) - labels) * weight / len(labels)).astype(np.float32)
        dz = np.outer(error, p["out"])[bags.bag]
        h, a, see, gate = f["h"], f["attention"][:, None], f["see"], f["gate"]
        da = (dz * h).sum(1)
        de = f["attention"] * (da - np.add.reduceat(f["attention"] * da, bags.first)[bags.bag])
        back = np.outer(de, p["weigh"])
        dsee, dgate = back * gate * (1 - see * see), back * see * gate * (1 - gate)
        dh = (a * dz + dsee @ p["see"].T + dgate @ p["gate"].T) * (1 - h * h)
        dx = (dh @ p["encode"].T)[:, :SIZE] / bags.sizes[:, None].astype(np.float32)
        spread = np.repeat(dx, bags.sizes, axis=0)
        grown = np.stack([np.bincount(local, spread[:, c], len(used)) for c in range(SIZE)], 1).astype(np.float32)
        grown[used == 0] = 0
        adagrad.rows("embedding", rows[used].ravel(), np.repeat(grown, rows.shape[1], axis=0))
        adagrad.step(
            {
                "out": error @ f["z"], "base": np.array([error.sum()], np.float32), "weigh": de @ (see * gate),
                "see": h.T @ dsee, "gate": h.T @ dgate, "encode": f["x"].T @ dh, "encode_0": dh.sum(0),
            }
        )

    def scorer(self):
        words = Words(buckets, 4)
        known: dict[str, np.ndarray | int] = {"n": 0, "table": np.zeros((0, SIZE), np.float32)}

        def score(texts: list[str]) -> np.ndarray:
            if len(words.made) > words.limit:
                known["n"], known["table"] = 0, np.zeros((0, SIZE), np.float32)
            bags = Bags(words, texts)
            if len(words.made) > known["n"]:
                fresh = self.words(np.array(words.made[known["n"] :]))
                if known["n"] == 0:
                    fresh[0] = 0
                known["table"] = np.concatenate([known["table"], fresh])
                known["n"] = len(words.made)
            return sigmoid(self.forward(known["table"], bags)["logit"])

        return score


def fit(samples: list[tuple[str, int]], seed: int = 0, epochs: int = EPOCHS) -> Model:
    """Fit on (text, label) rows with both classes weighing the same; no rows give even scores."""
    model = Model(seed)
    if samples:
        ones = sum(y for _, y in samples)
        train(model, Adagrad(model.p, RATE), samples, class_weights(len(samples) - ones, ones), epochs, seed + 1)
    return model


def train(model: Model, adagrad: Adagrad, samples: list[tuple[str, int]], weights: tuple[float, float], epochs: int, seed: int) -> None:
    """Steps over (text, label) rows, long and short texts mixed in each."""
    draw = np.random.default_rng(seed)
    words = Words(buckets, 4, limit=1 << 62)
    labels = np.array([y for _, y in samples], np.float32)
    weight = np.where(labels == 1, weights[1], weights[0]).astype(np.float32)
    sizes = np.array([len(t) for t, _ in samples])
    order, n = np.argsort(sizes, kind="stable"), -(-len(samples) // BATCH)
    members = [m for a in range(n) for m in batches(order[a::n], sizes, BATCH, STEP_CHARS)]
    bags = [Bags(words, [samples[i][0] for i in m]) for m in members]
    rows = np.array(words.made)
    for _ in range(epochs):
        for b in draw.permutation(len(bags)):
            model.step(adagrad, bags[b], rows, labels[members[b]], weight[members[b]])


def learn(docs: DataFrame, labels: DataFrame, allowed: Column, key: str = "doc_id", text: str = "text") -> Model:
    """The model fitted on all labelled documents whose key is allowed."""
    rows = stored(labelled(docs, labels, "quality", allowed, key, text))
    counts = {r["_label"]: r["count"] for r in rows.groupBy("_label").count().collect()}
    weights = class_weights(counts.get(0, 0), counts.get(1, 0))
    model = Model()

    def steps(model: Model, adagrad: Adagrad, table: pa.Table, epochs: int, seed: int) -> None:
        train(model, adagrad, list(zip(table.column("text").to_pylist(), table.column("_label").to_pylist(), strict=True)), weights, epochs, seed)

    fit_all(rows, model, RATE, steps, EPOCHS)
    return model


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text", column: str = "score") -> DataFrame:
    """Kept columns and the score of every whole text; null and empty texts are one empty passage."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = shared.value.scorer()
        return lambda texts: {column: scorer(texts).astype(float)}

    return map_texts(docs, text, make, f"{column} double", keep)


def attention(model: Model, text: str) -> list[float]:
    """The weights of a text's passages."""
    words = Words(buckets, 4)
    bags = Bags(words, [text])
    table = model.words(np.array(words.made))
    table[0] = 0
    return model.forward(table, bags)["attention"].tolist()
