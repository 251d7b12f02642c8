"""Toxicity by a convolutional classifier over hashed word embeddings.

A word is the sum of the embeddings of its own hash and of the hashes of its beginnings and its
end. Filters of several widths run over the words, the greatest answer of each filter over the
whole text is kept, and a logistic layer gives the score. Thresholds of the decision are calibrated
per language on documents that the fit did not see; the language is no input of the score.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import STEP_CHARS, map_texts, stored
from footfall.llm.nets import Adagrad, Words, batches, class_weights, fit_all, labelled, sigmoid

WORD = re.compile(r"[^\W_]+")
BUCKETS, SIZE, FILTERS, WIDTHS = 1 << 16, 16, 16, (1, 2, 3)
EPOCHS, BATCH, RATE = 6, 64, 0.08
PAD = max(WIDTHS) - 1
#: Every fifth labelled document calibrates the thresholds, which are multiples of 1 / LEVELS.
CALIBRATE, LEVELS = 5, 10_000


def buckets(word: str) -> list[int]:
    parts = (word, "3" + word[:3], "4" + word[:4], "5" + word[:5], "$" + word[-3:])
    return [crc32(p.encode("utf-8", "surrogatepass")) & (BUCKETS - 1) for p in parts]


def tokens(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Model:
    def __init__(self, seed: int = 0):
        draw = np.random.default_rng(seed)
        columns = FILTERS * sum(WIDTHS)
        self.p = {
            "embedding": (draw.standard_normal((BUCKETS, SIZE)) * 0.05).astype(np.float32),
            "filters": (draw.standard_normal((SIZE, columns)) * (1 / np.sqrt(SIZE))).astype(np.float32),
            "bias": np.zeros(FILTERS * len(WIDTHS), np.float32),
            "out": (draw.standard_normal(FILTERS * len(WIDTHS)) * 0.3).astype(np.float32),
            "base": np.zeros(1, np.float32),
        }

    def products(self, rows: np.ndarray) -> np.ndarray:
        """Each word's share of every filter at every place in its window; padding has none."""
        table = self.p["embedding"][rows].sum(1) @ self.p["filters"]
        return table

    def convolve(self, table: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Filter answers at every word; the windows of the last words reach into the padding."""
        out = np.empty((len(ids), FILTERS * len(WIDTHS)), np.float32)
        column = 0
        for k, width in enumerate(WIDTHS):
            part = out[:, k * FILTERS : (k + 1) * FILTERS]
            part[:] = table[ids, column : column + FILTERS]
            for j in range(1, width):
                column += FILTERS
                part[:-j] += table[ids[j:], column : column + FILTERS]
            column += FILTERS
        out[ids == 0] = 0  # a window that begins in the padding sees nothing of the next text
        return out

    def pooled(self, answers: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return np.maximum(np.maximum.reduceat(answers, starts, axis=0) + self.p["bias"], 0)

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return pooled @ self.p["out"] + self.p["base"][0]

    def scorer(self):
        """A function from texts to scores that remembers the products of frequent words."""
        words = Words(buckets, 5)
        known = {"n": 0, "table": np.zeros((0, FILTERS * sum(WIDTHS)), np.float32)}

        def score(texts: list[str]) -> np.ndarray:
            if len(words.made) > words.limit:
                known["n"] = 0
            ids, starts = words.ids([tokens(t) for t in texts], PAD)
            if len(words.made) > known["n"]:
                fresh = self.products(np.array(words.made[known["n"] :]))
                if known["n"] == 0:
                    fresh[0] = 0
                if len(known["table"]) < len(words.made):
                    grown = np.empty((max(len(words.made), 2 * len(known["table"])), fresh.shape[1]), np.float32)
                    grown[: known["n"]] = known["table"][: known["n"]]
                    known["table"] = grown
                known["table"][known["n"] : len(words.made)] = fresh
                known["n"] = len(words.made)
            return sigmoid(self.logits(self.pooled(self.convolve(known["table"], ids), starts)))

        return score


def fit(samples: list[tuple[str, int]], seed: int = 0, epochs: int = EPOCHS) -> Model:
    """Fit on (text, label) rows; one class only, or no rows, give a model of near even scores."""
    model = Model(seed)
    if samples:
        ones = sum(y for _, y in samples)
        train(model, Adagrad(model.p, RATE), samples, class_weights(len(samples) - ones, ones), epochs, seed + 1)
    return model


def train(model: Model, adagrad: Adagrad, samples: list[tuple[str, int]], weights: tuple[float, float], epochs: int, seed: int) -> None:
    """Steps over (text, label) rows."""
    draw = np.random.default_rng(seed)
    words = Words(buckets, 5, limit=1 << 62)
    split = [tokens(t) for t, _ in samples]
    ids, starts = words.ids(split, PAD)
    ends = np.append(starts[1:], len(ids))
    rows = np.array(words.made)
    labels = np.array([y for _, y in samples], np.float32)
    weight = np.where(labels == 1, weights[1], weights[0]).astype(np.float32)
    sizes = np.array([len(t) for t, _ in samples])
    for _ in range(epochs):
        for batch in batches(draw.permutation(len(samples)), sizes, BATCH, STEP_CHARS):
            here = np.concatenate([np.arange(starts[i], ends[i]) for i in batch])
            first = np.concatenate([[0], np.cumsum((ends - starts)[batch])[:-1]])
            used, local = np.unique(ids[here], return_inverse=True)
            table = model.products(rows[used])
            table[used == 0] = 0
            answers = model.convolve(table, local)
            pooled = model.pooled(answers, first)
            error = (sigmoid(model.logits(pooled)) - labels[batch]) * weight[batch] / len(batch)
            grads = {"out": error @ pooled, "base": np.array([error.sum()], np.float32)}
            back = np.outer(error, model.p["out"]) * (pooled > 0)
            grads["bias"] = back.sum(0)
            # only the word where a filter answered most passes the error on
            grown = np.zeros_like(table)
            for b in range(len(batch)):
                part = answers[first[b] : first[b + 1] if b + 1 < len(batch) else None]
                at = part.argmax(0) + first[b]
                column = 0
                for k, width in enumerate(WIDTHS):
                    cols = np.arange(FILTERS)
                    g = back[b, k * FILTERS : (k + 1) * FILTERS] * (local[at[k * FILTERS : (k + 1) * FILTERS]] != 0)
                    for j in range(width):
                        place = at[k * FILTERS : (k + 1) * FILTERS] + j
                        inside = place < len(local)
                        np.add.at(grown, (local[place[inside]], column + cols[inside]), g[inside])
                        column += FILTERS
            touched = np.flatnonzero(grown.any(1) & (used != 0))
            e = model.p["embedding"][rows[used[touched]]].sum(1)
            grads["filters"] = e.T @ grown[touched]
            back_e = grown[touched] @ model.p["filters"].T
            adagrad.rows("embedding", rows[used[touched]].ravel(), np.repeat(back_e, rows.shape[1], axis=0))
            adagrad.step(grads)


def best(scores: np.ndarray, zeros: np.ndarray, ones: np.ndarray) -> float | None:
    """The cut with the best balanced accuracy, nearest to 0.5; of each score: how many rows of label 0 and 1 have it."""
    if not zeros.sum() or not ones.sum():
        return None
    order = np.argsort(scores, kind="stable")
    cuts = np.unique(np.concatenate([scores, [0.5]]))
    at = np.searchsorted(scores[order], cuts)
    below, above = (np.concatenate([[0], np.cumsum(n[order])]) for n in (zeros, ones))
    right = (above[-1] - above[at]) / above[-1] + below[at] / below[-1]
    top = cuts[right >= right.max() - 1e-12]
    return float(top[np.argmin(np.abs(top - 0.5))])


def thresholds(scores: np.ndarray, labels: list[int], languages: list[str | None]) -> dict[str, float]:
    """Per language the cut with the best balanced accuracy; "" holds the cut over all, for languages not seen."""
    y = np.array(labels)

    def of(chosen: np.ndarray) -> float | None:
        return best(scores[chosen], y[chosen] == 0, y[chosen] == 1)

    whole = of(np.ones(len(y), bool))
    out = {"": 0.5 if whole is None else whole}
    for name in sorted({x for x in languages if x is not None}):
        cut = of(np.array([x == name for x in languages]))
        if cut is not None:
            out[name] = cut
    return out


def calibrated(scored: DataFrame) -> dict[str, float]:
    """`thresholds` over all rows (lang, score, _label): cuts are multiples of 1 / LEVELS, rows are counted by level in Spark."""
    level = F.floor(F.col("score") * LEVELS).cast("int").alias("level")
    counts = stored(scored.groupBy("lang", level).agg(F.count_if(F.col("_label") == 0).alias("zeros"), F.count_if(F.col("_label") == 1).alias("ones")))
    schema = "lang string, cut double"

    def cut(key, table):
        level, zeros, ones = (table.column(c).to_numpy() for c in ("level", "zeros", "ones"))
        return pa.table({"lang": [key[0].as_py()], "cut": pa.array([best(level / LEVELS, zeros, ones)], pa.float64())})

    each = counts.where("lang is not null").groupBy("lang").applyInArrow(cut, schema)
    whole = counts.groupBy("level").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"))
    whole = whole.groupBy(F.lit("").alias("lang")).applyInArrow(cut, schema)
    cuts = {r.lang: r.cut for r in each.where("cut is not null").collect()} | {"": 0.5} | {"": r.cut for r in whole.collect() if r.cut is not None}
    return dict(sorted(cuts.items()))


def learn(docs: DataFrame, labels: DataFrame, allowed: Column, key: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[Model, dict[str, float]]:
    """Model and thresholds from all labelled documents whose key is allowed."""
    rows = stored(labelled(docs.withColumnRenamed(lang, "lang"), labels, "toxic", allowed, key, text, ("lang",)))
    held = F.pmod(F.xxhash64("_order"), F.lit(CALIBRATE)) == 0
    kept = rows.where(~held).drop("lang")
    counts = {r["_label"]: r["count"] for r in kept.groupBy("_label").count().collect()}
    weights = class_weights(counts.get(0, 0), counts.get(1, 0))
    model = Model()

    def steps(model: Model, adagrad: Adagrad, table: pa.Table, epochs: int, seed: int) -> None:
        train(model, adagrad, list(zip(table.column("text").to_pylist(), table.column("_label").to_pylist(), strict=True)), weights, epochs, seed)

    fit_all(kept, model, RATE, steps, EPOCHS)
    return model, calibrated(score(rows.where(held), model, ["lang", "_label"]))


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text", column: str = "score") -> DataFrame:
    """Kept columns and the score of every whole text; null and empty texts get that of no words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = shared.value.scorer()
        return lambda texts: {column: scorer(texts).astype(float)}

    return map_texts(docs, text, make, f"{column} double", keep)


def flag(scored: DataFrame, cuts: dict[str, float], lang: str = "lang", column: str = "score") -> Column:
    """Whether a row reaches the threshold of its language, or the general one."""
    level = F.lit(cuts[""])
    for name, cut in cuts.items():
        if name:
            level = F.when(F.col(lang) == name, F.lit(cut)).otherwise(level)
    return F.col(column) >= level
